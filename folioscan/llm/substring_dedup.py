"""Substring deduplication with a log-structured fingerprint index.

A word is removed if a window of WINDOW words that covers it also starts at
another place of the corpus.  Of the fingerprints (hashes of ANCHOR words)
inside a window, the smallest is the window's anchor, so equal windows have
equal anchors; consecutive windows with the same anchor form a block.

The index keeps sorted immutable runs of (fingerprint, count), each a table
bucketed and sorted by fingerprint.  A new batch becomes a run of its own and is
merge-joined with the earlier runs, bucket by bucket and without a shuffle;
what occurs in both, or twice in the batch, is shared.  Runs beyond FAN_IN
are compacted into one.  An index that is handed from call to call, or opened again
in its folder, also keeps the blocks and the compressed texts of earlier calls, in
buckets by fingerprint and by text, so that a call shuffles of them only what shares
a fingerprint with it: blocks with a shared fingerprint, of this call and of earlier
ones, are verified window by window.

To verify, texts are put into slices.  A slice names each of its windows once
(ten bytes of hashes of all its words and of its anchor; the task that it is
sent to adds the bits of its number), so a passage that a third of all documents
share reaches a task once for each slice, and what windows a task gets depends
on their hashes alone, not on how often they or their anchors occur.  The
answer is one bit a window.

Equal texts (by 128 bits) are handled once: all their windows repeat.

Defined cases: null and empty texts have no words; texts of fewer than
WINDOW words lose nothing, copies or not; repeated rows are copies; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.shared import stored, text_of
from folioscan.llm.textnum import mix, slices, windows, word_hashes

WINDOW = 35
ANCHOR = 8
BATCHES = 6
FAN_IN = 4
#: Windows of a task that verifies, about, and texts and bytes of a slice at most.
SLOT = 2_000_000
SLICE_TEXTS = 256
SLICE_BYTES = 4 << 20
#: Bits of a block's length in a spot (start * 2**SPOT_BITS + length).
SPOT_BITS = 6
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class FingerprintIndex:
    """Sorted immutable runs of fingerprints, and the places and texts of the calls that added to them, as bucketed tables.

    With a path, a folder in the shared storage, the tables lie there, and each call ends
    with a line for each of them in a manifest under a new version; ``open`` takes the
    newest version up in another session.  A call that failed leaves no version.  Tables
    beyond FAN_IN of a kind are merged into one.
    """

    KEYS = {"runs": "fp", "blocks": "fp", "texts": "tid"}
    COLUMNS = {"runs": "fp BIGINT, n BIGINT", "blocks": "fp BIGINT, tid BINARY, spot BIGINT", "texts": "tid BINARY, packed BINARY"}
    MANIFEST = "version long, kind string, name string, buckets int"

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, buckets: int | None = None, path: str | None = None):
        self.spark, self.fan_in, self.path, self.version = spark, fan_in, path and path.rstrip("/"), 0
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.blocks: list[str] = []
        self.texts: list[str] = []
        self._old: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str, fan_in: int = FAN_IN) -> FingerprintIndex:
        """The index that lies in a folder, as its last complete call left it."""
        lines = spark.read.schema(cls.MANIFEST).json(f"{path.rstrip('/')}/manifest")
        lines = lines.where(F.col("version") == lines.agg(F.max("version")).first()[0]).collect()  # a few for each kind
        index = cls(spark, fan_in, lines[0]["buckets"], path)
        index.version = lines[0]["version"]
        for kind, key in cls.KEYS.items():
            names = sorted(r["name"] for r in lines if r["kind"] == kind)
            for name in names:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cls.COLUMNS[kind]}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {index.buckets} BUCKETS LOCATION '{index.path}/{name}'")
            setattr(index, kind, names)
        return index

    def rows(self, kind: str) -> list[DataFrame]:
        return [self.spark.table(name) for name in getattr(self, kind)]

    def remember(self, sketch: DataFrame, texts: DataFrame) -> None:
        """Keeps places and texts of a call (tid, fps, spots; tid, packed), once for each text, and commits."""
        known = reduce(DataFrame.union, [t.select("tid") for t in self.rows("texts")]) if self.texts else None
        new = texts if known is None else texts.join(known, "tid", "left_anti")
        name = self._write(new, "texts")
        places = sketch.join(self.spark.table(name).select("tid"), "tid", "left_semi").select("tid", F.explode(F.arrays_zip("fps", "spots")).alias("b"))
        self.blocks.append(self._write(places.select(F.col("b.fps").alias("fp"), "tid", F.col("b.spots").alias("spot")), "blocks"))
        self.texts.append(name)
        for kind in ("blocks", "texts"):
            if len(getattr(self, kind)) > self.fan_in:
                self.compact(kind)
        self.commit()

    def commit(self) -> None:
        self.version += 1
        if self.path:
            lines = [(self.version, kind, name, self.buckets) for kind in self.KEYS for name in getattr(self, kind)]
            self.spark.createDataFrame(lines, self.MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        self._drop(self._old)
        self._old = []

    def _write(self, rows: DataFrame, kind: str = "runs") -> str:
        name, key = f"fingerprint_{kind}_{uuid.uuid4().hex}", self.KEYS[kind]
        out = rows.repartition(self.buckets, key).write.bucketBy(self.buckets, key).sortBy(key)
        (out.option("path", f"{self.path}/{name}") if self.path else out).saveAsTable(name)
        return name

    def add(self, fingerprints: DataFrame) -> DataFrame:
        """Adds a batch (column fp); returns its fingerprints that occur twice or in an earlier batch."""
        name = self._write(fingerprints.groupBy("fp").agg(F.count("*").alias("n")))
        run = self.spark.table(name)
        found = [run.where("n > 1").select("fp")]
        found += [run.select("fp").hint("merge").join(old.select("fp"), "fp", "left_semi") for old in self.rows("runs")]
        shared = stored(reduce(DataFrame.union, found), "shared-fingerprints")
        self.runs.append(name)
        if len(self.runs) > self.fan_in:
            self.compact()
        return shared

    def compact(self, kind: str = "runs") -> None:
        """Merges all tables of a kind into one; the old ones go with the next commit, or at once if none of them was committed."""
        old, rows = getattr(self, kind), reduce(DataFrame.union, self.rows(kind))
        setattr(self, kind, [self._write(rows.groupBy("fp").agg(F.sum("n").alias("n")) if kind == "runs" else rows, kind)])
        self._old += old

    def close(self) -> None:
        """Drops all tables; those in a folder of their own stay there and can be opened again."""
        self._drop(self.runs + self.blocks + self.texts + self._old)
        self.runs, self.blocks, self.texts, self._old = [], [], [], []

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def blocks_of(words: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, number of windows and fingerprint of each block of consecutive windows with one anchor."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none, none.astype(np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(row[: len(words) - window + 1] == row[window - 1 :])
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    prints = windows(words, anchor, 3)
    width = window - anchor + 1
    least = np.empty(len(starts), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(prints, width)
    for at in range(0, len(starts), 1 << 16):
        some = starts[at : at + (1 << 16)]
        least[at : at + (1 << 16)] = view[some].argmin(axis=1) + some
    first = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(starts) != 1) | (np.diff(row[starts]) != 0)]))
    count = np.diff(np.concatenate([first, [len(starts)]]))
    begin = starts[first]
    return row[begin], begin - offsets[row[begin]], count, prints[least[first]]


def _sketched(keep: tuple[str, ...], window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                words, offsets = word_hashes(batch.column("_text"))
                row, start, count, prints = blocks_of(words, offsets, window, anchor)
                ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values))  # noqa: E731, B023
                shas = [hashlib.sha256(b" ".join(t.encode().split())).hexdigest() for t in batch.column("_text").to_pylist()]
                columns = [*(batch.column(k) for k in keep), batch.column("tid"), pa.array(np.diff(offsets)), pa.array(shas, pa.string()), lists(prints.view(np.int64)), lists((start << SPOT_BITS) + count)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "tid", "n_words", "sha", "fps", "spots"])

    return run


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array([pack.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())], ["tid", "packed"])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a slice, named by its first text, so that nothing can part it: lists of keys, texts and blocks."""
    for batch in batches:
        at, sizes, parts = 0, np.cumsum(np.asarray(pc.binary_length(batch.column("packed")), dtype=np.int64)), [0]
        while at < batch.num_rows:
            to = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, side="right"))
            at = min(max(to, at + 1), at + SLICE_TEXTS, batch.num_rows)
            parts.append(at)
        ends = pa.array(parts, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("tid").take(ends[:-1]), *(pa.ListArray.from_arrays(ends, c) for c in batch.columns)], ["slice", *batch.schema.names])


def _windows_of(texts: list[bytes], prints: pa.ListArray, spots: pa.ListArray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and place of each window that may repeat; its hash, and that of it and its anchor."""
    words, offsets = word_hashes(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    row = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(spots)))
    spot, fp = np.asarray(spots.flatten()), np.asarray(prints.flatten()).view(np.uint64)
    count, start = spot & (2**SPOT_BITS - 1), spot >> SPOT_BITS
    block = np.repeat(np.arange(len(spot)), count)
    place = start[block] + np.arange(len(block)) - (np.cumsum(count) - count)[block]
    hashes = windows(words, window, 5)[(offsets[row][block] + place)] if len(block) else np.zeros(0, np.uint64)
    return row[block], place, hashes, mix(hashes ^ mix(fp[block]))


def _named(window: int, slots: int):
    """The distinct windows of each slice by slot, ten bytes each, and a bit for those that the slice holds twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                texts = [unpack.decompress(z) for z in batch.column("packed")[k].values.to_pylist()]
                _, _, hashes, both = _windows_of(texts, batch.column("fps")[k].values, batch.column("spots")[k].values, window)
                slot, codes, twice, _ = coded(hashes, both, slots)
                first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
                raw = codes.tobytes()
                out = [(int(slot[i]), raw[10 * i : 10 * j], np.packbits(twice[i:j]).tobytes()) for i, j in zip(first, [*first[1:], len(slot)], strict=True)]
                name = pa.array([batch.column("slice")[k].as_py()] * len(out), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), name, *(pa.array([o[n] for o in out], pa.binary()) for n in (1, 2))], ["slot", "slice", "codes", "twice"])

    return run


def coded(hashes: np.ndarray, both: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct windows of a slice, by slot and code: slot, code (rows of ten bytes), whether it occurs twice; and which of them each window is."""
    slot = mix(both) % np.uint64(slots)
    order = np.lexsort((both, hashes, slot))
    hashes_, both_, slot_ = hashes[order], both[order], slot[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes_[1:] != hashes_[:-1]) | (both_[1:] != both_[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    code = np.empty((int(new.sum()), 10), np.uint8)
    code[:, :8] = hashes_[new].astype("<u8").view(np.uint8).reshape(-1, 8)
    code[:, 8:] = both_[new].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :2]
    return slot_[new], code, np.bincount(which, minlength=len(code)) > 1, which


def _verified(table: pa.Table) -> pa.Table:
    """Of one slot: for each slice a bit for each of its windows, set if it occurs twice there or in another slice."""
    codes, twice = table.column("codes").combine_chunks(), table.column("twice").to_pylist()
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, 10)
    ends = np.cumsum(np.asarray(pc.binary_length(codes)) // 10)
    _, which, times = np.unique(np.ascontiguousarray(raw).view("V10").ravel(), return_inverse=True, return_counts=True)
    repeats = times[which] > 1
    out = []
    for begin, end, own in zip([0, *ends[:-1]], ends, twice, strict=True):
        bits = repeats[begin:end] | np.unpackbits(np.frombuffer(own, np.uint8), count=end - begin).astype(bool)
        out.append(np.packbits(bits).tobytes() if bits.any() else None)
    keep = pa.array([i for i, o in enumerate(out) if o is not None], pa.int64())
    return pa.table({"slice": table.column("slice").take(keep), "slot": table.column("slot").take(keep), "bits": pa.array([o for o in out if o is not None], pa.binary())})


def _cleaned(window: int, slots: int):
    """Of slices with their marks: removed words and digest of the rest of each text that loses words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                texts = [unpack.decompress(z) for z in batch.column("packed")[k].values.to_pylist()]
                row, place, hashes, both = _windows_of(texts, batch.column("fps")[k].values, batch.column("spots")[k].values, window)
                slot, _, _, which = coded(hashes, both, slots)
                repeats = np.zeros(len(slot), bool)
                for mark in batch.column("marks")[k].as_py():
                    a, b = np.searchsorted(slot, np.array([mark["slot"], mark["slot"] + 1], np.uint64))
                    repeats[a:b] = np.unpackbits(np.frombuffer(mark["bits"], np.uint8), count=b - a)
                gone_row, gone_at = row[repeats[which]], place[repeats[which]]
                removed, shas = [], []
                for i in (losers := np.unique(gone_row)):
                    words = texts[i].split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    starts = gone_at[gone_row == i]
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    shas.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("tid")[k].values.take(pa.array(losers)), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["tid", "removed", "kept"])

    return run


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES, index: FingerprintIndex | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_words, n_removed, kept_sha256.

    The documents join the index in batches, and all of them are judged at once.
    If an index is given, windows of the documents of earlier calls count too, and
    it keeps these documents; else a new one is used and dropped.
    """
    if not anchor <= window < anchor + 2**SPOT_BITS:
        raise ValueError("a window must hold 1 to 63 fingerprints")
    spark = docs.sparkSession
    given = index is not None
    index = index or FingerprintIndex(spark)
    key = F.unhex(F.md5("_text"))
    texts = docs.select(*keep, text_of().alias("_text")).withColumn("tid", key)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[: len(keep)])
    sketch = stored(texts.mapInArrow(_sketched(keep, window, anchor), f"{fields}, tid binary, n_words long, sha string, fps array<long>, spots array<long>"), "substring-sketch")
    batch = F.pmod(F.xxhash64("tid"), F.lit(batches))
    shared = [index.add(sketch.where(batch == b).select(F.explode("fps").alias("fp"))) for b in range(batches)]
    shared = stored(reduce(DataFrame.union, shared).distinct(), "shared-fingerprints")  # a plain side of the join, so that Spark can split the hot fingerprints of the other
    places = sketch.select("tid", F.explode(F.arrays_zip("fps", "spots")).alias("b")).select("tid", F.col("b.fps").alias("fp"), F.col("b.spots").alias("spot"))
    met = [p.join(shared, "fp").select("tid", "fp", "spot") for p in (places, *index.rows("blocks"))]  # earlier places lie in buckets by fp and stay where they are
    alive = reduce(DataFrame.union, met).groupBy("tid").agg(F.collect_set(F.struct("fp", "spot")).alias("b"))
    alive = alive.select("tid", F.col("b.fp").alias("fps"), F.col("b.spot").alias("spots"))
    least = 2 * window - 1  # characters of the shortest text with a window
    packed = docs.select(text_of().alias("_text")).where(F.length("_text") >= least).select(key.alias("tid"), F.col("_text").alias("text"))
    packed = packed.mapInArrow(_compressed, "tid binary, packed binary")
    if given:
        packed = stored(packed.groupBy("tid").agg(F.first("packed").alias("packed")), "substring-packed")
    if index.texts:
        alive = stored(alive, "substring-blocks")
    earlier = [t.join(alive.select("tid"), "tid", "left_semi") for t in index.rows("texts")]  # of earlier texts only those with a shared place
    all_texts = reduce(DataFrame.union, earlier, packed).groupBy("tid").agg(F.first("packed").alias("packed"))
    alive = stored(all_texts.join(alive, "tid").mapInArrow(_sliced, "slice binary, tid array<binary>, packed array<binary>, fps array<array<long>>, spots array<array<long>>"), "substring-alive")
    copies = sketch.select("tid")
    for old in index.rows("texts"):
        copies = copies.union(old.join(sketch.select("tid").distinct(), "tid", "left_semi").select("tid"))
    copied = copies.groupBy("tid").agg(F.count("*").alias("n")).where("n > 1").select("tid", F.lit(True).alias("copied"))
    if given:
        copied = stored(copied, "substring-copied")
        index.remember(sketch.select("tid", "fps", "spots").dropDuplicates(["tid"]), packed)
    else:
        index.close()
    n_blocks = alive.agg(F.sum(F.size(F.flatten("spots")))).first()[0] or 0
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_blocks * (window - anchor + 1) // SLOT))
    named = alive.mapInArrow(_named(window, slots), "slot long, slice binary, codes binary, twice binary")
    marks = named.groupBy("slot").applyInArrow(_verified, "slice binary, slot long, bits binary")
    marks = marks.groupBy("slice").agg(F.collect_list(F.struct("slot", "bits")).alias("marks"))
    cleaned = alive.join(marks, "slice").mapInArrow(_cleaned(window, slots), "tid binary, removed long, kept string")
    found = cleaned.join(copied, "tid", "full_outer")
    out = sketch.select(*keep, "tid", "n_words", "sha").join(found, "tid", "left")
    gone = F.col("copied") & (F.col("n_words") >= window)
    removed = F.when(gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0).cast("long")))
    sha = F.when(gone, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept", "sha"))
    return out.select(*keep, "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"))


def oracle_sql(window: int = WINDOW) -> str:
    """DuckDB SQL for op7_substring_dedup."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT k, i, array_to_string(w[i:i + {window - 1}], ' ') AS g FROM (SELECT k, w, unnest(range(1, greatest(len(w) - {window - 2}, 1))) AS i FROM d)),
c AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY g) AS n FROM x) WHERE n > 1),
p AS (SELECT DISTINCT k, unnest(range(i, i + {window})) AS p FROM c),
a AS (SELECT k, w[p] AS t, p FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN p USING (k, p)),
s AS (SELECT k, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS kept FROM a GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (k)
"""
