"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the words by its weight, but no more than a
maximum number of epochs of its own words; what is above goes to the others
by weight until none is above.  The fixed point of that resharing is found in
one pass: with the sources ordered by cap / weight, the first k are capped
for exactly one k.

A source's share is then taken as whole repetitions of all its documents and
one seeded partial repetition: documents stand in a random order fixed by the
seed, and words are taken from the front until the target is met, so a
source misses its target by less than one word.  Running totals are made in
two steps (ranges of the order, then documents of a range), so that no source, and
no id that many documents share, has to fit into one task; equal rows are counted first.

Defined cases: a null text has size 0 and nothing is taken from it; the null
source is a source of its own, ordered last; documents with equal or null id
are ordered by their size; a source without words has target 0; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.llm.shared import n_words_of, text_of
from folioscan.storage import ranged

MAX_EPOCHS = 3
CYCLE = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, cycle: int = CYCLE, share: float = 1.0) -> DataFrame:
    """source, source_size -> also weight and target.  One row for each source, so the windows run over a small table."""
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    out = sizes.withColumn("weight", (F.row_number().over(order) - 1) % cycle + 1)
    out = out.withColumn("cap", F.col("source_size") * max_epochs)
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    zero = F.lit(0).cast("long")
    out = out.withColumns(
        {
            "_left": F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), zero),
            "_weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero),
        }
    )
    capped = F.col("cap") * F.col("_weights") <= F.col("_left") * F.col("weight")
    # The first uncapped source fixes the level for itself and all after it.
    level = F.first(F.when(~capped, F.struct("_left", "_weights")), ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.currentRow))
    out = out.withColumn("_level", level)
    target = F.when(F.col("_level").isNull(), F.col("cap").cast("double")).otherwise(F.col("_level._left") * F.col("weight") / F.col("_level._weights"))
    return out.select("source", "source_size", "weight", target.alias("target"))


def mixed(docs: DataFrame, seed: str = SEED, max_epochs: int = MAX_EPOCHS, cycle: int = CYCLE, size: Column | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, source, size, source_size, target, taken, n_whole (whole repetitions) and n_extra (words of the partial one)."""
    names = [f"_k{i}" for i in range(len(keep))]
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)))
    rows = docs.select(*(F.col(k).alias(n) for k, n in zip(keep, names, strict=True)), F.col("source").alias("_source"), key.alias("_key"), F.col("doc_id").alias("_id"), (n_words_of(text_of()) if size is None else size).cast("long").alias("_size"))
    order = ["_key", "_id", "_size", *names]
    rows = ranged(rows.groupBy("_source", *order).agg(F.count("*").alias("_times")), ["_source", *order], "mixing-rows")
    parts = rows.groupBy("_source", "_p").agg(F.sum(F.col("_size") * F.col("_times")).alias("_n"))  # one row for each source in a range
    targets = source_targets(parts.groupBy(F.col("_source").alias("source")).agg(F.sum("_n").alias("source_size")), max_epochs, cycle)
    starts = parts.select(F.col("_source").alias("_s"), F.col("_p").alias("_q"), (F.sum("_n").over(W.partitionBy("_source").orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).alias("_from"))
    starts = starts.join(targets.drop("weight"), F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    rows = rows.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_q")))
    inside = W.partitionBy("_source", "_p").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = F.col("_size") * F.col("_times")
    rows = rows.withColumn("_from", F.col("_from") + F.sum(whole).over(inside) - whole)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1))).withColumn("_from", F.col("_from") + F.col("_copy") * F.col("_size"))
    n_whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    extra = F.round(F.col("target") - n_whole * F.col("source_size")).cast("long")
    n_extra = F.least(F.greatest(extra - F.col("_from"), F.lit(0).cast("long")), F.col("_size"))
    rows = rows.withColumns({"_whole": n_whole, "_extra": n_extra})
    given = [F.col(n).alias(k) for k, n in zip(keep, names, strict=True)]
    taken = F.col("_whole") * F.col("_size") + F.col("_extra")
    return rows.select(*given, F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"), F.col("_whole").alias("n_whole"), F.col("_extra").alias("n_extra"))


def oracle_sql(seed: str = SEED, max_epochs: int = MAX_EPOCHS, cycle: int = CYCLE) -> str:
    """DuckDB SQL for op5_mixing."""
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '{seed}') AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
v AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {cycle} + 1 AS weight, source_size * {max_epochs} AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS wts FROM v
  WINDOW p AS (ORDER BY cap::DOUBLE / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, min(CASE WHEN NOT cap * wts <= lft * weight THEN cap::DOUBLE / weight END) OVER () AS edge FROM f),
e AS (SELECT lft AS elft, wts AS ewts FROM l WHERE NOT cap * wts <= lft * weight ORDER BY cap::DOUBLE / weight, source IS NULL, encode(source) LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN cap * wts <= lft * weight AND (edge IS NULL OR cap::DOUBLE / weight <= edge) THEN cap::DOUBLE ELSE (SELECT elft FROM e)::DOUBLE * weight / (SELECT ewts FROM e) END AS target FROM l),
o AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS b,
  CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS n FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (n * size + least(greatest(round(target - n * source_size)::BIGINT - b, 0), size))::BIGINT AS taken FROM o
"""
