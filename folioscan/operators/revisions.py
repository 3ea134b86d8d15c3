"""Revisions of numbered entries, change sets, free lists and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Inside a revision: a table's entry in use, then a stream's, then a table's free one.
PRECEDENCE = "CASE WHEN origin = 'table' AND kind <> 'free' THEN 0 WHEN origin = 'stream' AND kind <> 'free' THEN 1 WHEN origin = 'table' THEN 2 ELSE 3 END"


def newest(rows: DataFrame, by: list[str], order: list[Column], take: list[str]) -> DataFrame:
    """The first row of each key by ``order``; the others are dropped before the shuffle where they can be."""
    w = W.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, *take)


def effective(entries: DataFrame, as_of: int | None = None) -> DataFrame:
    """The entry of each object, newest revision first; up to a revision if one is given."""
    rows = entries if as_of is None else entries.where(F.col("rev") <= as_of)
    order = [F.desc("rev"), F.expr(PRECEDENCE), F.col("position")]
    return newest(rows, ["doc_id", "num"], order, ["rev", "origin", "kind", "generation", "position"])


def in_use(entries: DataFrame) -> DataFrame:
    """doc_id, in_use: objects whose newest entry is not free."""
    return effective(entries).where("kind <> 'free'").groupBy("doc_id").agg(F.count("*").alias("in_use"))


def applied(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Base entries (effective) after a change set: the last change of a number wins; what may not be freed stays."""
    last = newest(changes, ["doc_id", "num"], [F.desc("seq")], ["op", "value"])
    rows = base.select("doc_id", "num", "kind", "generation").join(last, ["doc_id", "num"], "full_outer")
    put, free = F.col("op").isin("set", "add"), F.col("op") == "free"
    live = F.coalesce(F.col("kind") != "free", F.lit(False))
    kind = F.when(put, "inuse").when(free & live, "free").otherwise(F.col("kind"))
    generation = F.when(put, F.coalesce(F.when(F.col("kind") == "compressed", 0).otherwise(F.col("generation")), F.lit(0))).when(free & live, F.when(F.col("kind") == "compressed", 1).otherwise(F.col("generation") + 1)).otherwise(F.col("generation"))
    out = rows.select("doc_id", "num", kind.alias("kind"), generation.cast("int").alias("generation"), F.when(put, F.col("value")).alias("value"))
    return out.where("kind is not null")


def allocated(base: DataFrame, added: DataFrame, referenced: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """doc_id, seq, num: new numbers above every number known or referenced, and from the declared size (doc_id, size) on."""
    known = base.select("doc_id", "num").union(referenced.select("doc_id", "num"))
    known = known if sizes is None else known.union(sizes.select("doc_id", F.col("size") - 1))
    top = known.groupBy("doc_id").agg(F.max("num").alias("top"))
    w = W.partitionBy("doc_id").orderBy("seq")
    return added.withColumn("_r", F.row_number().over(w)).join(top, "doc_id", "left").select("doc_id", "seq", (F.greatest(F.coalesce("top", F.lit(0)), F.lit(0)) + F.col("_r")).alias("num"))


def free_list(entries: DataFrame) -> DataFrame:
    """doc_id, num, next_free: freed numbers chained in order, the last one to 0."""
    return entries.where("kind = 'free'").select("doc_id", "num", F.lead("num", 1, 0).over(W.partitionBy("doc_id").orderBy("num")).alias("next_free"))


def revision_ranges(sizes: DataFrame) -> DataFrame:
    """doc_id, rev, start, end, gap of (doc_id, rev, start, end): whether a range begins where the one before ended."""
    return sizes.withColumn("gap", F.col("start") != F.lag("end", 1, 0).over(W.partitionBy("doc_id").orderBy("rev")))


def damaged(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """doc_id, num of untouched entries that are not the same after."""
    keys = ["doc_id", "num"]
    a = before.select(*keys, F.struct("kind", "generation").alias("_a")).join(changed.select(*keys).distinct(), keys, "left_anti")
    return a.join(after.select(*keys, F.struct("kind", "generation").alias("_b")), keys, "left").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def recovered(entries: DataFrame) -> DataFrame:
    """The last occurrence of each key by position."""
    return newest(entries, ["doc_id", "num"], [F.desc("position"), F.desc("rev")], ["kind", "position"])


def best_header(headers: DataFrame, fill: list[str]) -> DataFrame:
    """Of headers (doc_id, pos, root, ...) the latest with a root; its empty attributes from the latest header that has each."""
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(f"_{c}") for c in fill]
    rooted = F.when(F.col("root").isNotNull(), F.col("pos"))
    out = headers.groupBy("doc_id").agg(F.max_by(F.struct("root", "pos", *fill), rooted).alias("h"), *latest)
    return out.where("h.pos is not null").select("doc_id", "h.root", "h.pos", *(F.coalesce(F.col(f"h.{c}"), F.col(f"_{c}")).alias(c) for c in fill))
