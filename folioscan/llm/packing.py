"""Packing: optimal length buckets, and token-budget batches inside each bucket.

Texts longer than the longest sequence are cut into pieces of that length.
The histogram of piece lengths (at most MAX_LENGTH bins, counted over all
rows) goes to the driver, where dynamic programming picks the bucket
boundaries with the least padding.  A batch of a bucket holds as many pieces
as fit into the token budget when all are padded to the bucket's length.
Pieces are numbered inside a bucket in two steps (hash slots, as many as the number
of pieces asks for, then pieces of a slot), so that one bucket may hold any share of all
pieces.  Equal rows are counted before that and take as many numbers in a row, so
that no row, repeated however often, fills a slot; rows with equal or null ids are
told apart by their texts.

Defined cases: null and empty texts have no words and no pieces, and do not
appear; equal rows stand next to each other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.llm.shared import n_words_of, stored, text_of

MAX_LENGTH = 2048
BUCKETS = 16
BUDGET = 16_384
#: Hash slots of a bucket at least, and pieces of a slot about.
SLOTS, SLOT = 256, 500_000


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """At most ``buckets`` boundaries among the given ascending lengths, the last one included, with the least padding.

    cost(i, j): padding if lengths i..j-1 share the boundary lengths[j-1].
    """
    n = len(lengths)
    if not n:
        return []
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    rows = np.concatenate([[0], np.cumsum(counts)])
    words = np.concatenate([[0], np.cumsum(counts * lengths)])
    best = np.concatenate([[0], lengths * rows[1:] - words[1:]])
    cut = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, at = best.copy(), np.arange(n + 1)
        for j in range(1, n + 1):
            total = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (words[j] - words[:j])
            at[j] = int(np.argmin(total))
            new[j] = total[at[j]]
        cut.append(at)
        best = new
    out, j, k = [], n, len(cut) - 1
    while j > 0:
        out.append(int(lengths[j - 1]))
        j = int(cut[k][j])
        k = max(k - 1, 0)
    return out[::-1]


def packed(docs: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET, slots: int = SLOTS, n_tokens: Column | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, piece, first_token, n_tokens, bucket (from 0), bucket_length, batch (from 0 in its bucket) and place in the batch."""
    tokens = n_words_of(text_of()) if n_tokens is None else n_tokens
    told = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    rows = docs.select(*keep, told.alias("_text"), tokens.cast("long").alias("_n")).where("_n > 0").groupBy(*keep, "_text", "_n").agg(F.count("*").alias("_times"))
    rows = rows.select(*keep, "_text", "_times", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / max_length))).alias("piece"))
    rows = rows.select(*keep, "_text", "_times", "piece", (F.col("piece") * max_length).alias("first_token"), F.least(F.col("_n") - F.col("piece") * max_length, F.lit(max_length)).cast("long").alias("n_tokens"))
    rows = stored(rows, "packing-pieces")  # lengths are read three times, texts once
    histogram = rows.groupBy("n_tokens").agg(F.sum("_times")).orderBy("n_tokens").collect()  # at most max_length rows
    slots = max(slots, -(-sum(r[1] for r in histogram) // SLOT))
    bounds = best_boundaries(np.array([r[0] for r in histogram]), np.array([r[1] for r in histogram]), buckets)
    bucket, length = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k in range(len(bounds) - 1, -1, -1):
        inside = F.col("n_tokens") <= bounds[k]
        bucket, length = F.when(inside, F.lit(k)).otherwise(bucket), F.when(inside, F.lit(bounds[k]).cast("long")).otherwise(length)
    rows = rows.withColumns({"bucket": bucket, "bucket_length": length, "_key": F.xxhash64(F.lit(1), "doc_id", "piece", "_text")})
    rows = rows.withColumn("_slot", F.pmod("_key", F.lit(slots)).cast("int"))
    counts = rows.groupBy("bucket", "_slot").agg(F.sum("_times").alias("_c"))  # at most buckets * slots rows
    before = W.partitionBy("bucket").orderBy("_slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = counts.select("bucket", "_slot", (F.sum("_c").over(before) - F.col("_c")).alias("_from"))
    rows = rows.join(F.broadcast(starts), ["bucket", "_slot"])
    upto = W.partitionBy("bucket", "_slot").orderBy("_key", "doc_id", "piece", "n_tokens", "_text", *keep).rowsBetween(W.unboundedPreceding, W.currentRow)
    number = F.col("_from") + F.sum("_times").over(upto) - F.col("_times")
    each = F.greatest(F.floor(F.lit(budget) / F.col("bucket_length")), F.lit(1))
    rows = rows.withColumn("_number", number).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1))).withColumn("_number", F.col("_number") + F.col("_copy"))
    return rows.select(*keep, "piece", "first_token", "n_tokens", "bucket", "bucket_length", F.floor(F.col("_number") / each).cast("long").alias("batch"), (F.col("_number") % each).cast("long").alias("place"))
