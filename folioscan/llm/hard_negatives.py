"""Hard negatives: for each anchor and each of its positives, the best-scoring rows of other labels inside a window below the positive's score.

Scores are integer inner products.  A score is packed with its anchor, and with the
id of the scored row, into a key of bytes whose order is anchor, descending score,
id.  ``repartitionAndSortWithinPartitions`` brings the keys of an anchor together in
that order, and an iterator walks them once: a positive opens its window, a row of
another label goes to each open window that it fits, and a window closes when it is
full or the scores have fallen below it.  So an anchor's rows are never held, only
its few open windows.

Not all pairs travel.  Anchors in slices of SLICE meet all rows in blocks: a task
keeps a slice and reads the rows of its block batch by batch.  The first pass keeps
of each block the rows that can be among an anchor's positives; the second, knowing
the windows, keeps the rows that can be among the first of a window.  A row is only
left out when its own block holds enough better ones, so nothing is lost.

Defined cases: rows with a null label or vector, or with a null or non-finite
component, take no part; rows that are equal in id, label and whole components count
once; a null id is no anchor and comes last among ties, and equal ids with other
contents are rows of their own, ties among them going by a hash of the contents.
Vectors of different lengths are compared as if the shorter ended in zeros.  Whole
components and scores stay within what a long can hold a hundred of: beyond 2**56
they are cut to it.  Fewer rows give fewer positives and negatives; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.llm.shared import stored

#: Fixed values of the contract.
EVERY, POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 100, 5, 10, 30, 90, 256

#: Anchors that a task holds, and rows of a block at most; a block of fewer rows is made when that gives each task one.
SLICE = 65_536
BLOCK = 1_048_576
LEAST_BLOCK = 2048
#: Anchors scored at once.
STEP = 512
MOST = 1 << 56

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_CANDIDATE = "anchor long, anchor_rid long, score long, vec_id long, rid long, positive boolean"


def relabelled(rows: DataFrame) -> DataFrame:
    """The contract's labels: where vec_id is divisible by 7, the next of ten."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def quantised(rows: DataFrame, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """vec_id, label, q (whole components), rid of the rows that take part, each once."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    cut = lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale), F.lit(MOST)), F.lit(-MOST))
    rows = rows.where(F.col("label").isNotNull() & x.isNotNull() & finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, cut).alias("q"))
    most = F.coalesce(F.max(F.greatest(F.abs(F.array_min("q")), F.abs(F.array_max("q")))), F.lit(0))
    rows = stored(rows.select("vec_id", "label", "q"), "negatives-rows")
    kind = "smallint" if rows.agg(most).first()[0] < 1 << 15 else "bigint"
    rows = rows.select("vec_id", "label", F.col("q").cast(f"array<{kind}>").alias("q"))
    return rows.distinct().withColumn("rid", F.xxhash64("vec_id", "label", "q"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows of doubles, or of whole numbers where doubles would not be exact; shorter ones end in zeros."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    at = np.arange(int(sizes.sum()))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, at - np.repeat(offsets[:-1] - offsets[0], sizes)] = values[offsets[0] : offsets[-1]]
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and all of b, exact, cut to what is allowed."""
    dims = min(a.shape[1], b.shape[1])
    a, b = a[:, :dims], b[:, :dims]
    if not dims:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dims < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -MOST, MOST).astype(np.int64)


class Best:
    """Of each slot the first ``most`` rows of those offered, by descending score, then id (nulls last), then rid."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.held = [np.zeros(0, np.int64)] * 5  # slot, score, null id, id, rid
        self.least = np.full(slots, -(1 << 62))  # what a score must reach to matter

    def offer(self, *rows: np.ndarray) -> None:
        if not len(rows[0]):
            return
        slot, score, null, vec, rid = (np.concatenate(x) for x in zip(self.held, rows, strict=True))
        order = np.lexsort((rid, vec, null, -score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, slot)
        kept = np.arange(len(slot)) - first < self.most
        order = order[kept]
        self.held = [slot[kept], score[order], null[order], vec[order], rid[order]]
        slot = self.held[0]
        last = np.flatnonzero(np.diff(np.append(slot, -1)) != 0)
        full = last - np.searchsorted(slot, slot[last]) + 1 == self.most
        self.least[slot[last[full]]] = self.held[1][last[full]]


def _pieces(n: int, start: int) -> Iterator[tuple[int, int]]:
    """Ranges of n rows that double, so that a few rows soon tell what the others have to reach."""
    at, size = 0, start
    while at < n:
        yield at, min(at + size, n)
        at, size = at + size, min(2 * size, 8192)


def _scored(windows: bool):
    """Streams of anchors, then rows, of one block and slice after another; candidates of each."""

    def ended(anchors: dict | None) -> Iterator[pa.RecordBatch]:
        for k, best in enumerate(anchors["best"] if anchors else ()):
            slot, score, null, vec, rid = best.held
            owner = slot // (POSITIVES if windows else 1) + k * STEP
            if windows and len(slot):  # a row may fit several windows of an anchor
                owner, score, null, vec, rid = np.unique(np.stack([owner, score, null, vec, rid]), axis=1)
            if len(owner):
                columns = [pa.array(anchors["id"][owner]), pa.array(anchors["rid"][owner]), pa.array(score), pa.array(vec, mask=null.astype(bool)), pa.array(rid), pa.array(np.full(len(owner), not windows))]
                yield pa.RecordBatch.from_arrays(columns, _CANDIDATE.replace(",", "").split()[::2])

    def offered(anchors: dict, batch: pa.RecordBatch) -> None:
        x, label, rid = _matrix(batch.column("q")), batch.column("label").to_numpy(), batch.column("rid").to_numpy()
        null = np.asarray(batch.column("vec_id").is_null()).astype(np.int64)
        vec = batch.column("vec_id").fill_null(0).to_numpy()
        pieces = list(_pieces(len(x), 64 if not anchors["seen"] else 4096))
        anchors["seen"] += len(x)
        for k, best in enumerate(anchors["best"]):
            mine = slice(k * STEP, (k + 1) * STEP)
            own_label, own_rid, own_id = anchors["label"][mine, None], anchors["rid"][mine, None], anchors["id"][mine, None]
            for i, j in pieces:
                s = scores(anchors["x"][mine], x[i:j])
                same = own_label == label[None, i:j]
                if not windows:
                    fits = same & (s >= best.least[:, None])
                    fits &= (own_rid != rid[None, i:j]) | (own_id != vec[None, i:j]) | (null[None, i:j] == 1)
                    at, row = np.nonzero(fits)
                    best.offer(at, s[at, row], null[row + i], vec[row + i], rid[row + i])
                    continue
                other, hundred, parts = ~same, 100 * s, []
                for w in range(POSITIVES):
                    low = np.maximum(anchors["low"][mine, w], 100 * np.maximum(best.least.reshape(-1, POSITIVES)[:, w], -MOST))
                    at, row = np.nonzero(other & (hundred >= low[:, None]) & (hundred <= anchors["high"][mine, w, None]))
                    parts.append((at * POSITIVES + w, s[at, row], null[row + i], vec[row + i], rid[row + i]))
                best.offer(*(np.concatenate(p) for p in zip(*parts, strict=True)))

    def opened(rows: list[pa.RecordBatch]) -> dict:
        table = pa.Table.from_batches(rows).combine_chunks()
        at = lambda name: table[name].to_numpy()
        n = table.num_rows
        out = {"id": at("vec_id"), "rid": at("rid"), "label": at("label"), "x": _matrix(table["q"].chunk(0)), "seen": 0}
        steps = [min(STEP, n - k) for k in range(0, n, STEP)]
        out["best"] = [Best(size * POSITIVES, NEGATIVES) if windows else Best(size, POSITIVES) for size in steps]
        if windows:
            p = np.full((n, POSITIVES), -1)  # no window below zero holds anything
            found = table["found"].chunk(0)
            sizes = np.diff(found.offsets.to_numpy())
            row = np.repeat(np.arange(n), sizes)
            p[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = found.flatten().to_numpy()
            out["low"], out["high"] = LOW * p, HIGH * p
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, anchors = None, [], None
        for batch in batches:
            slot, block, asks = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("_slice", "_block", "_row"))
            cuts = [0, *(np.flatnonzero((np.diff(slot) != 0) | (np.diff(block) != 0) | (np.diff(asks) != 0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if (slot[i], block[i]) != now:
                    yield from ended(anchors)
                    now, waiting, anchors = (slot[i], block[i]), [], None
                if asks[i] == 0:
                    waiting.append(batch.slice(i, j - i))
                    continue
                if anchors is None and waiting:
                    anchors = opened(waiting)
                if anchors is not None:
                    offered(anchors, batch.slice(i, j - i))
        yield from ended(anchors)

    return run


def _candidates(rows: DataFrame, anchors: DataFrame, slices: int, blocks: int, windows: bool) -> DataFrame:
    """All anchors in slices against all rows in blocks: those rows of each block that can matter to an anchor."""
    none = F.lit(None).cast("array<bigint>")
    found = F.col("found") if windows else none
    dealt = F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(slices)).cast("int").alias("_slice")
    a = anchors.select(dealt, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(0).alias("_row"), "vec_id", "label", "q", "rid", found.alias("found"))
    dealt = F.pmod(F.xxhash64("rid", F.lit(5)), F.lit(blocks)).cast("int").alias("_block")
    r = rows.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"), dealt, F.lit(1).alias("_row"), "vec_id", "label", "q", "rid", none.alias("found"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = a.union(r).repartition(tasks, "_slice", "_block").sortWithinPartitions("_slice", "_block", "_row")
    return stored(both.mapInArrow(_scored(windows), _CANDIDATE), "negatives-candidates")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key: anchor, descending score, kind, id and contents of a candidate as bytes in that order; a positive stands before what ties with it."""
    turn = np.uint64(1 << 63)
    for b in batches:
        at = lambda k: b.column(k).to_numpy()  # noqa: B023, E731
        key = np.zeros(b.num_rows, [("anchor", ">u8"), ("anchor_rid", ">u8"), ("score", ">u8"), ("kind", "u1"), ("null", "u1"), ("id", ">u8"), ("rid", ">u8")])
        key["anchor"], key["anchor_rid"], key["rid"] = at("anchor").view(np.uint64) ^ turn, at("anchor_rid").view(np.uint64), at("rid").view(np.uint64)
        key["score"] = (-at("score")).view(np.uint64) ^ turn
        key["kind"] = ~np.asarray(b.column("positive"))
        key["null"], key["id"] = np.asarray(b.column("vec_id").is_null()), b.column("vec_id").fill_null(0).to_numpy().view(np.uint64) ^ turn
        raw = pa.py_buffer(key.tobytes())
        offsets = pa.py_buffer(np.arange(0, (b.num_rows + 1) * key.itemsize, key.itemsize, np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), b.num_rows, [None, offsets, raw])], ["key"])


def _emitted(keys: Iterator[tuple[bytes, None]]) -> Iterator[tuple]:
    """Negatives of the windows that positives open, in one walk over sorted keys."""
    anchor, windows = None, []
    for key, _ in keys:
        if key[:16] != anchor:
            anchor, windows = key[:16], []
        a, _, score, negative, null, vec, _ = struct.unpack(">QQQBBQQ", key)
        score, vec = (1 << 63) - score, None if null else vec - (1 << 63)
        if not negative:
            windows.append([vec, score, 0])
            continue
        closed = False
        for window in windows:
            if 100 * score > HIGH * window[1]:
                continue
            if 100 * score < LOW * window[1] or window[2] == NEGATIVES:
                closed = True
                continue
            window[2] += 1
            yield a - (1 << 63), window[0], window[2], vec, window[1], score
        if closed:
            windows = [w for w in windows if w[2] < NEGATIVES and 100 * score >= LOW * w[1]]


def mined(rows: DataFrame, every: int = EVERY, slice_size: int = SLICE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows: vec_id, label, embedding."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = stored(quantised(rows), "negatives-distinct")
    anchors = held.where(F.col("vec_id") % every == 0)
    n, n_anchors = held.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    slices, blocks = max(-(-n_anchors // slice_size), 1), max(-(-n // block), min(tasks, -(-n // LEAST_BLOCK)), 1)
    positives = _candidates(held, anchors, slices, blocks, windows=False)
    order = W.partitionBy("anchor", "anchor_rid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "rid")
    first = stored(positives.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= POSITIVES).select("anchor", "anchor_rid", "score", "vec_id", "rid", F.lit(True).alias("positive")), "negatives-positives")
    found = first.groupBy(F.col("anchor").alias("vec_id"), F.col("anchor_rid").alias("rid")).agg(F.collect_list("score").alias("found"))  # POSITIVES scores at most
    negatives = _candidates(held, anchors.join(found, ["vec_id", "rid"]), slices, blocks, windows=True)
    keys = first.union(negatives).mapInArrow(_packed, "key binary").rdd.map(lambda r: (bytes(r[0]), None))
    sorted_keys = keys.repartitionAndSortWithinPartitions(tasks, lambda k: zlib.crc32(k[:16]))
    return spark.createDataFrame(sorted_keys.mapPartitions(_emitted), RESULT)


def oracle_sql() -> str:
    """DuckDB SQL for op13_hard_negatives; ids are taken as unique."""
    return """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
