"""N-gram Jaccard join by T-occurrence search.

A document's set holds its distinct word 4-shingles.  Two sets A and B link
when |A & B| / |A | B| reaches the threshold; then B occurs in at least T of the
inverted lists of A's shingles, T = ceil(threshold * |A|).  DivideSkip calls L
of the longest lists long, L < T: the short ones are merged (by a heap, or by
sorting when they are long), who occurs in T - L of them is a candidate, and
candidates are probed in the long lists by binary search.

1. Documents with equal sets are one class.  Its 64-bit id is a sum over the
   set; a second such sum would show two sets with one id, and then another salt
   is taken.
2. Inverted lists are built in hash slots of shingles; copies count once.  A
   list of one class yields no partner and is dropped; the others go back to
   their classes with their lengths.
3. A class whose T - 1 long lists leave only dropped ones short has no partner.
   The rest are joined through their short lists into candidate groups, which
   no link leaves.
4. Inside a group each class searches the earlier ones, passing over those
   already connected to it.  The links found connect the classes.  A group of
   more than BLOCK elements is first compared with its most typical class,
   row by row and wherever the rows are: what links with that is connected.
   Only the rest still has to search, in pairs of blocks, itself and the others.

Slots and blocks grow in number with the input, not in size.  Shingles are told
apart by 48 bits and the number of their slot.

Defined cases: without words a document has an empty set and links with
nothing; with fewer than 4 words its set is the whole sequence; a null doc_id is
never the smallest of its component unless all are null; repeated rows share a
class; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.components import components
from folioscan.llm.shared import stored, text_of
from folioscan.llm.textnum import mix, slices, windows, word_hashes

SHINGLE = 4
#: Similarity in hundredths.
PERCENT = 85
#: Set elements of a block of a large group, and of a slot of inverted lists, about.
BLOCK = 1_000_000
SLOT = 2_000_000
#: Weight of a probe against a merged element, as DivideSkip's authors chose it.
MU = 0.01
CODE_BITS = 48
_CODE = np.uint64(2**CODE_BITS - 1)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each element of the rows' sets, by row."""
    words, offsets = word_hashes(column, lower=True)
    length = np.diff(offsets)
    row = np.repeat(np.arange(len(length)), length)
    n = max(len(words) - size + 1, 0)
    inside = np.flatnonzero(row[:n] == row[size - 1 :]) if n else np.zeros(0, np.int64)
    rows, hashes = [row[inside]], [windows(words, size, 4)[inside]]
    for k in range(1, size):
        short = np.flatnonzero(length == k)
        if len(short):
            rows.append(short)
            hashes.append(windows(words, k, 100 + k)[offsets[short]])
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (value[1:] != value[:-1])
    return row[new], value[new]


def class_ids(row: np.ndarray, value: np.ndarray, n_rows: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Class and size of each row's set."""
    count = np.bincount(row, minlength=n_rows)
    total = np.zeros(n_rows, np.uint64)
    np.add.at(total, row, mix(value ^ mix(np.array([salt + 1], np.uint64))))
    return mix(total + count.astype(np.uint64)).view(np.int64), count


def _classed(keep: tuple[str, ...], size: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                row, value = shingle_sets(batch.column("_text"), size)
                cid, count = class_ids(row, value, batch.num_rows, salt)
                check, _ = class_ids(row, value, batch.num_rows, ~salt & 0xFFFF)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(cid), pa.array(count.astype(np.int64)), pa.array(check)], [*keep, "cid", "n", "_check"])

    return run


def _six_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _posted(slots: int, size: int, salt: int):
    """For each slice of texts and slot: shingle codes by class, how many each class has, and the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                row, value = shingle_sets(batch.column("_text"), size)
                cid, _ = class_ids(row, value, batch.num_rows, salt)
                _, first = np.unique(cid, return_index=True)
                once = np.isin(row, first)
                row, value = row[once], value[once]
                slot = mix(value) % np.uint64(slots)
                order = np.argsort(slot, kind="stable")
                row, value, slot = row[order], value[order], slot[order]
                ends = np.searchsorted(slot, np.arange(slots + 1, dtype=np.uint64))
                out = []
                for s in np.flatnonzero(np.diff(ends)):
                    a, b = ends[s], ends[s + 1]
                    held, many = np.unique(row[a:b], return_counts=True)
                    out.append((int(s), _six_bytes(value[a:b] & _CODE), many.astype("<u4").tobytes(), cid[held].astype("<i8").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[i] for o in out], pa.binary()) for i in (1, 2, 3))], ["slot", "codes", "many", "cids"])

    return run


def _level(lengths: np.ndarray) -> np.ndarray:
    """Length of a list in one byte: exact below 128, then in eighths of a doubling."""
    return np.where(lengths < 128, lengths, np.minimum(128 + np.floor(8 * np.log2(np.maximum(lengths, 128) / 128)), 255)).astype(np.uint8)


def _listed(parts: int):
    """Of one slot: the lists of two classes or more, dealt back to the classes."""

    def run(table: pa.Table) -> pa.Table:
        codes, cids = [], []
        for code, many, held in zip(table.column("codes").to_pylist(), table.column("many").to_pylist(), table.column("cids").to_pylist(), strict=True):
            codes.append(_from_six(code))
            cids.append(np.repeat(np.frombuffer(held, "<i8"), np.frombuffer(many, "<u4")))
        code, cid = np.concatenate(codes), np.concatenate(cids)
        del codes, cids
        order = np.lexsort((cid, code))
        code, cid = code[order], cid[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (cid[1:] != cid[:-1])
        code, cid = code[new], cid[new]
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        length = np.diff(np.concatenate([start, [len(code)]]))
        every = np.repeat(length, length)
        shared = every > 1
        code, cid, level = code[shared], cid[shared], _level(every[shared])
        part = mix(cid.view(np.uint64)) % np.uint64(parts)
        order = np.lexsort((cid, part))
        code, cid, level, part = code[order], cid[order], level[order], part[order]
        first = np.flatnonzero(np.concatenate([[True], cid[1:] != cid[:-1]])) if len(cid) else np.zeros(0, np.int64)
        many = np.diff(np.concatenate([first, [len(cid)]])).astype("<u4")
        out = []
        for p in np.unique(part):
            a, b = np.searchsorted(part, [p, p + np.uint64(1)])
            i, j = np.searchsorted(first, [a, b])
            out.append((int(p), int(table.column("slot")[0].as_py()), cid[first[i:j]].astype("<i8").tobytes(), many[i:j].tobytes(), _six_bytes(code[a:b]), level[a:b].tobytes()))
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=["part", "slot", "cids", "many", "codes", "levels"])

    return run


LIVE = "cid long, n long, m long, core double, elements binary, short array<long>"


def _divided(percent: int):
    """Of one part of the classes: those with a short list that can yield a partner; their elements by list length, short ones first."""

    def run(lists: pa.Table, classes: pa.Table) -> pa.Table:
        size = dict(zip(classes.column("cid").to_pylist(), classes.column("n").to_pylist(), strict=True))
        cid, code, level = [], [], []
        for slot, held, many, codes, levels in zip(*(lists.column(c).to_pylist() for c in ("slot", "cids", "many", "codes", "levels")), strict=True):
            cid.append(np.repeat(np.frombuffer(held, "<i8"), np.frombuffer(many, "<u4")))
            code.append(mix(_from_six(codes) | np.uint64(slot) << np.uint64(CODE_BITS)))
            level.append(np.frombuffer(levels, np.uint8))
        out = []
        if cid:
            cid, code, level = np.concatenate(cid), np.concatenate(code), np.concatenate(level)
            order = np.lexsort((code, level, cid))
            cid, code, level = cid[order], code[order], level[order]
            first = np.flatnonzero(np.concatenate([[True], cid[1:] != cid[:-1]])) if len(cid) else np.zeros(0, np.int64)
            for a, b in zip(first, [*first[1:], len(cid)], strict=True):
                n = size[int(cid[a])]
                short = n - -(-percent * n // 100) + 1 - (n - (b - a))
                if short > 0:
                    out.append((int(cid[a]), n, int(b - a), float(level[a:b].sum() / n), code[a:b].astype("<u8").tobytes(), code[a : a + short].view(np.int64)))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=["cid", "n", "m", "core", "elements", "short"])

    return run


def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The members of sorted lists and how many lists hold each."""
    if sum(map(len, lists)) <= 64:
        counts = Counter(heapq.merge(*(x.tolist() for x in lists)))
        return np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)
    return np.unique(np.concatenate(lists), return_counts=True)


def needed(a: int, b: int, percent: int) -> int:
    """Elements that sets of two sizes must share to link; more than either holds if their sizes are too far apart."""
    small, large = sorted((a, b))
    return -(-percent * (small + large) // (100 + percent)) if 100 * small >= percent * large else large + 1


def linked(cids: list[int], sizes: list[int], sets: list[np.ndarray], side: list[int] | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect whatever links connect among the given classes (between sides 0 and 1, if sides are given).

    sets: elements by list length, shared ones only.
    """
    n = len(cids)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = sorted(range(n), key=lambda i: (side[i] if side else 0, sizes[i], cids[i]))
    targets = sum(1 for i in order if not side or side[i] == 0)
    element = np.concatenate([sets[i] for i in order]) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(sets[i]) for i in order])
    by = np.lexsort((owner, element))
    element, owner = element[by], owner[by]
    out = []
    for at, i in enumerate(order):
        if side and side[i] == 0:
            continue
        most = min(at, targets)
        begin, end = np.searchsorted(element, sets[i]), np.searchsorted(element, sets[i], side="right")
        by_length = np.argsort(end - begin, kind="stable")
        begin, end = begin[by_length], end[by_length]
        least = -(-percent * sizes[i] // 100)  # T
        longest = int(end[-1] - begin[-1]) if len(end) else 0
        n_long = min(least - 1, int(least / (MU * math.log2(longest + 1) + 1)))
        cut = max(len(begin) - n_long, 0)
        held = lambda k: (x := owner[begin[k] : end[k]])[: np.searchsorted(x, most)]  # noqa: B023, E731
        short = [x for x in map(held, range(cut)) if len(x)]
        if not short:
            continue
        found, times = merged(short)
        near = times >= least - (len(begin) - cut)
        found, times = found[near], times[near]
        long = [held(k) for k in range(cut, len(begin))] if len(found) else []
        need = np.array([needed(sizes[i], sizes[order[k]], percent) for k in found.tolist()], np.int64)
        likely = np.argsort(need - times, kind="stable")
        found, times, need = found[likely], times[likely], need[likely]
        while len(found):
            some, have, want = found[:8], times[:8].copy(), need[:8]
            for left, x in zip(range(len(long), 0, -1), long, strict=True):
                open_ = have + left >= want
                if not open_.any():
                    break
                place = np.searchsorted(x, some)
                place[place == len(x)] = 0
                have += (x[place] == some) if len(x) else 0
            for k in some[have >= want].tolist():
                if find(i) != find(order[k]):
                    root[find(i)] = find(order[k])
                    out.append((cids[i], cids[order[k]]))
            found, times, need = found[8:], times[8:], need[8:]
            apart = np.array([find(order[k]) != find(i) for k in found.tolist()], bool)
            found, times, need = found[apart], times[apart], need[apart]
    return out


def _searched(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        cid, n, elements, block = (table.column(c).to_pylist() for c in ("cid", "n", "elements", "block"))
        first, second = key[1].as_py(), key[2].as_py()
        side = None if first == second else [int(b == second) for b in block]
        found = linked(cid, n, [np.frombuffer(e, "<u8") for e in elements], side, percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _compared(percent: int):
    """Whether each class links with the typical one of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for n, mine, other in zip(*(batch.column(c).to_pylist() for c in ("n", "elements", "typical")), strict=True):
                a, b = np.frombuffer(mine, "<u8"), np.frombuffer(other["elements"], "<u8")
                near.append(len(np.intersect1d(a, b, assume_unique=True)) >= needed(n, other["n"], percent))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "cid", "n", "m", "elements")), batch.column("typical").field("cid"), pa.array(near, pa.bool_())], ["root", "cid", "n", "m", "elements", "typical", "near"])

    return run


def grouped_links(members: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b) links that connect what links connect in each group: of (root, cid, n, m, core, elements)."""
    totals = stored(members.groupBy("root").agg(F.sum("m").alias("_m")).where(F.col("_m") > block), "ngram-large")
    search = lambda rows: rows.groupBy("root", "first", "second").applyInArrow(_searched(percent), "a long, b long")
    zero = F.lit(0).cast("long")
    columns = ("root", "first", "second", "block", "cid", "n", "elements")
    if totals.isEmpty():
        return search(members.withColumns({"first": zero, "second": zero, "block": zero}).select(*columns))
    small = members.join(totals, "root", "left_anti").withColumns({"first": zero, "second": zero, "block": zero}).select(*columns)
    large = members.join(totals.select("root"), "root")
    typical = stored(large.groupBy("root").agg(F.max_by(F.struct("cid", "n", "elements"), F.struct("core", "cid")).alias("typical")), "ngram-typical")
    judged = large.join(typical, "root").mapInArrow(_compared(percent), "root long, cid long, n long, m long, elements binary, typical long, near boolean")
    judged = stored(judged, "ngram-judged")
    direct = judged.where("near and cid <> typical").select(F.col("cid").alias("a"), F.col("typical").alias("b"))
    # blocks of those that must still search come first, then blocks of those that are connected already
    blocks = lambda near: F.ceil(F.sum(F.when(F.col("near") == near, F.col("m")).otherwise(0)) / block)
    counts = stored(judged.groupBy("root").agg(blocks(False).alias("_open"), blocks(True).alias("_done")).where("_open > 0"), "ngram-blocks")
    rows = judged.join(counts, "root")
    own = F.when(F.col("near"), F.col("_open") + F.pmod(F.xxhash64("cid"), F.greatest("_done", F.lit(1)))).otherwise(F.pmod(F.xxhash64("cid"), "_open"))
    rows = rows.withColumn("block", own.cast("long"))
    others = F.when(F.col("near"), F.sequence(zero, F.col("_open") - 1)).otherwise(F.sequence(zero, F.col("_open") + F.col("_done") - 1))
    rows = rows.withColumn("other", F.explode(others)).withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    return search(small).union(search(rows.select(*columns))).union(direct)


def joined(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, block: int = BLOCK, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_shingles, component_id, cid (class; equal sets have equal ones), root (of what links connect, one cid).  keep must hold doc_id."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*keep, text_of().alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    for salt in range(100):
        known = stored(rows.mapInArrow(_classed(keep, size, salt), f"{fields}, cid long, n long, _check long"), "ngram-classes")
        classes = known.where("n > 0").groupBy("cid").agg(F.max("n").alias("n"), F.min("doc_id").alias("least"), (F.min("_check") != F.max("_check")).alias("mixed"))
        classes = stored(classes, "ngram-ids")
        mixed, total = classes.agg(F.count_if("mixed"), F.sum("n")).first()
        if not mixed:
            break
    slots = max(parts, -(-(total or 0) // SLOT))
    posted = rows.select("_text").mapInArrow(_posted(slots, size, salt), "slot int, codes binary, many binary, cids binary")
    lists = posted.groupBy("slot").applyInArrow(_listed(slots), "part int, slot int, cids binary, many binary, codes binary, levels binary")
    dealt = classes.select("cid", "n").mapInArrow(_dealt(slots), "part int, cid long, n long")
    live = stored(lists.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(_divided(percent), LIVE), "ngram-live")
    short = live.select("cid", F.explode("short").alias("element"))
    least = short.groupBy("element").agg(F.min("cid").alias("b"), F.count("*").alias("c")).where("c > 1").drop("c")
    least = stored(least, "ngram-least")  # a plain side of the join, so that Spark can split the hot elements of the other
    groups = components(short.join(least, "element").select(F.col("cid").alias("a"), "b"))
    members = live.drop("short").join(groups.select(F.col("node").alias("cid"), "root"), "cid")
    roots = components(grouped_links(members, percent, block))
    named = classes.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").select("cid", "least", F.coalesce("root", "cid").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("cid", "component_id", "root")
    out = known.join(named, "cid", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(*keep, F.col("n").alias("n_shingles"), component.alias("component_id"), "cid", "root")


def _dealt(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = mix(np.asarray(batch.column("cid")).view(np.uint64)) % np.uint64(parts)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch.column("cid"), batch.column("n")], ["part", "cid", "n"])

    return run


def oracle_sql(percent: int = PERCENT, size: int = SHINGLE) -> str:
    """DuckDB SQL for op8_ngram_join."""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT k, array_to_string(w[i:i + {size - 1}], ' ') AS g FROM (SELECT k, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
r AS (SELECT k, k AS to_k FROM d UNION SELECT r.k, e.b FROM r JOIN e ON r.to_k = e.a),
m AS (SELECT r.k, min(d.doc_id) AS component_id FROM r JOIN d ON d.k = r.to_k GROUP BY r.k)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (k) JOIN m USING (k)
"""
