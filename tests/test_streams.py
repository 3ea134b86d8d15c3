"""Streams cut into one, three and thirty micro-batches give the same rows, and the counts of a listener add up."""

import pytest
from pyspark.sql import functions as F

from folioscan.operators import search
from folioscan.plans import graph_queries as Q
from folioscan.streaming import logs


@pytest.fixture(scope="module")
def lines():
    """The first events, in thirty files in order of seq."""
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/events.parquet").sort_by("event_id")


def streamed(spark, tmp_path, table, batches, shuffled=False):
    """Thirty files, read in so many batches, in order or not."""
    import os

    import pyarrow.parquet as pq

    size = -(-table.num_rows // 30)
    for k in range(30):
        path = tmp_path / f"{k:02d}.parquet"
        at = (k * 7) % 30 if shuffled else k
        pq.write_table(table.slice(at * size, size), path)
        os.utime(path, (1_600_000_000 + k, 1_600_000_000 + k))
    schema = spark.read.parquet(str(tmp_path)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 30 // batches).parquet(str(tmp_path))


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("batches", [1, 3, 30])
def test_order_of_arrival(spark, tmp_path, lines, batches):
    e = Q._lines(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    stream = Q._lines(streamed(spark, tmp_path, lines, batches))
    columns = ["pid", "seq", "streak", "restart"]
    assert rows(Q._ran(spark, logs.stream_streaks(stream), "t").select(columns)) == rows(logs.crash_streaks(e).select(columns))
    if batches > 1:
        columns = ["pid", "seq", "forwarded", "cut"]
        assert rows(Q._ran(spark, logs.stream_budget(stream, 500), "t").select(columns)) == rows(logs.budgeted(e, 500).select(columns))


@pytest.mark.parametrize("batches", [1, 3, 30])
def test_any_order(spark, tmp_path, lines, batches):
    """Tails and latest requests do not depend on the order in which files come."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = streamed(spark, tmp_path, lines, batches, shuffled=True)
    assert rows(logs.newest_tail(Q._ran(spark, logs.stream_tail(Q._lines(stream), 5), "t"))) == rows(logs.tail(Q._lines(e), 5).select("pid", "seq", "line"))
    ask = lambda t: t.where("event_type IN ('click', 'view')").select((F.col("user_id") % 9).alias("session"), F.floor(F.col("event_id") / 20).alias("request"), "event_id", (F.col("event_type") == "click").alias("asks"))
    got = logs.latest_answers(Q._ran(spark, logs.stream_latest(ask(stream)), "t"))
    want = logs.latest_requests(ask(e).where("asks"), ask(e).where("not asks")).select("session", "request", "event_id")
    assert rows(got) == rows(want) and want.count() > 3


@pytest.mark.parametrize("batches", [3, 30])
def test_searches(spark, tmp_path, batches):
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").slice(0, 60)
    parts = lambda t: t.select((F.col("doc_id") % 7).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("page", "text")).withColumn("page", F.col("page") * 100 + F.length("text").cast("int") % 100)
    stream = parts(streamed(spark, tmp_path, docs, batches, shuffled=True))
    found = search.hits(parts(spark.read.parquet(str(tmp_path))), search.pattern("the"), at=True)
    got = logs.first_hits(Q._ran(spark, logs.stream_capped(search.hits(stream, search.pattern("the")), 20), "t"), 20)
    assert rows(got) == rows(logs.first_hits(found.select("doc_id", "page", "first"), 20))
    counts = Q.progress_of(spark, search.hits(stream, search.pattern("the"), at=True), "t")
    assert len({b for b, *_ in counts}) >= batches and sum(n for _, n, _ in counts) == found.count() and sum(n for *_, n in counts) == found.where("at = 0").count()
