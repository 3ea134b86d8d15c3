"""The whole queries compare texts to their ends."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from folioscan.operators import report
from folioscan.plans.table_queries import WITHOUT_SQL
from tests.test_text_distances import levenshtein


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    start = "".join(rng.choice("abé") for _ in range(6400))
    rows = [(1, start + "x y" * 300, "en", "s"), (2, start + "z" * 500, "en", "s"), (3, "b" + start[:6399] + "z" * 40_000, "en", "s"), (4, "short", "en", "t"), (5, "sh ort", "en", "t")]
    out = tmp_path_factory.mktemp("ends")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{out}/documents.parquet")
    return str(out)


def test_distances_to_the_end(spark, folder):
    got = {r["doc_id"]: r["distance"] for r in WITHOUT_SQL["gate_text_distances_whole"](spark, folder).collect()}
    assert got == {2: 600 / 7000, 3: 39_501 / 46_400, 5: None}


def test_report_to_the_end(spark, folder):
    got = WITHOUT_SQL["gate_text_report_whole"](spark, folder).first()
    assert (got["measured"], got["too_short"], got["worst_id"], got["failures"], got["passed"]) == (2, 1, 3, 2, False)


def test_long_pairs_are_not_held_together():
    rng = random.Random(6)
    a = ["".join(rng.choice("ab") for _ in range(40)) + "x" * 150_000 for _ in range(64)]
    b = [t[20:] for t in a]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(64)), "a": a, "b": b})
    want = [levenshtein(x[:40], y[:20]) / len(x) for x, y in zip(a, b, strict=True)]
    del a, b
    tracemalloc.start()
    out = list(report._distances(30)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[0].column("distance").to_pylist() == want
    assert peak < 12_000_000  # 64 pairs are 19 MB
