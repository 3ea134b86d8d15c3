"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are grown on the driver from a bounded sample of distinct vectors
(SAMPLE of them, those with the smallest keys); each node splits at the plane
halfway between two of its vectors drawn at random.  Every vector of the table
is then sent to its leaf in each tree.  A query walks all trees through one
shared priority queue until the leaves it has reached hold a share of the
distinct vectors, and LEAST of them at least; those are ranked by their exact
cosine.  The queue is ordered by how unlikely it is that a near neighbour lies
beyond the planes between the query and a leaf: a plane at distance m is
crossed with the logistic probability 1 / (1 + exp(slope * m)), the slope
following from how far the neighbours in the sample lie from each other across
such planes.  The share, not a number, keeps the recall as a table grows.  It is
SHARE, or what TRIED vectors of the sample need to reach RECALL of their true
neighbours in it, found by brute force: vectors of many dimensions, or of few
components, need more than others.  Where all of the table is needed, a query asks
all leaves of one tree, which is exact.

Equal vectors are one class, of which the TOP + 1 smallest ids are kept: no
other member can be among the TOP nearest of any query.  Leaves next to each
other form blocks of about BLOCK classes; larger leaves are dealt over several
blocks.  A task holds the members of one block at a time while the queries that ask
it pass by, so no leaf, and no set of queries, has to fit anywhere, and no member is
copied for them.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those of another length than the most frequent
one (the smaller, if two are as frequent) or with a null id; very small and very
large finite components count like others; a repeated row counts once; a table
with fewer vectors gives fewer neighbours; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.llm.shared import stored

TOP = 5
TREES = 24
SAMPLE = 16_384
LEAF = 6
LEAST = 1000
SHARE = 0.25
RECALL = 0.97
TRIED = 96
BLOCK = 16_384
EVERY = 50


@dataclass
class Tree:
    """Node i splits at normal[i] . x > offset[i] into right[i], else left[i]; children below 0 are leaves -1 - child."""

    normal: np.ndarray
    offset: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.offset) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            n = at[inner]
            side = np.einsum("ij,ij->i", x[inner], self.normal[n]) > self.offset[n]
            at[inner] = np.where(side, self.right[n], self.left[n])
        return -1 - at


def grown(x: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> Tree:
    """A tree over unit vectors, all nodes of a level at once; leaves are numbered from left to right."""
    x = np.asarray(x, np.float32)
    normals, offsets, children = [], [], []
    rows, group, n_groups, made = np.arange(len(x)), np.zeros(len(x), np.int64), 1, 0
    while n_groups:
        order = np.argsort(group, kind="stable")
        rows, group = rows[order], group[order]
        start = np.searchsorted(group, np.arange(n_groups + 1))
        size = np.diff(start)
        normal, offset = np.zeros((n_groups, x.shape[1]), np.float32), np.zeros(n_groups, np.float32)
        side, split = np.zeros(len(rows), bool), np.zeros(n_groups, bool)
        todo = np.flatnonzero(size > leaf)
        for _ in range(5):
            if not len(todo):
                break
            i = (rng.random(len(todo)) * size[todo]).astype(np.int64)
            j = (i + 1 + (rng.random(len(todo)) * (size[todo] - 1)).astype(np.int64)) % size[todo]
            a, b = x[rows[start[todo] + i]], x[rows[start[todo] + j]]
            far = np.sqrt(((b - a) ** 2).sum(axis=1))[:, None]
            normal[todo] = (b - a) / np.where(far > 0, far, 1)
            offset[todo] = ((a + b) * normal[todo]).sum(axis=1) / 2
            mine = np.flatnonzero(np.isin(group, todo))
            side[mine] = np.einsum("ij,ij->i", x[rows[mine]], normal[group[mine]]) > offset[group[mine]]
            up = np.bincount(group[mine], side[mine], n_groups)[todo] / size[todo]
            good = (up > 0.02) & (up < 0.98)
            split[todo[good]] = True
            todo = todo[~good]
        inner = np.flatnonzero(split)
        number = np.full(n_groups, -1)
        number[inner] = made + np.arange(len(inner))
        children.append(number)
        normals.append(normal[inner])
        offsets.append(offset[inner])
        made += len(inner)
        deeper = split[group]
        place = np.zeros(n_groups, np.int64)
        place[inner] = 2 * np.arange(len(inner))
        rows, group, n_groups = rows[deeper], place[group[deeper]] + side[deeper], 2 * len(inner)
    below = np.concatenate(children[1:]).reshape(-1, 2) if len(children) > 1 else np.zeros((0, 2), np.int64)
    leaves, todo = 0, [(0, 1), (0, 0)] if made else []
    while todo:
        node, right = todo.pop()
        if (child := int(below[node, right])) >= 0:
            todo += [(child, 1), (child, 0)]
        else:
            leaves += 1
            below[node, right] = -leaves
    return Tree(np.concatenate(normals).reshape(-1, x.shape[1]), np.concatenate(offsets), below[:, 0], below[:, 1], max(leaves, 1))


def slope_of(x: np.ndarray, top: int = TOP) -> float:
    """Steepness of the chance that a plane parts a vector from its neighbours: from how far these lie apart across planes of pairs in the sample."""
    if len(x) <= top:
        return 1.0
    near = np.argpartition(-(x[:256] @ x.T), top, axis=1)[:, : top + 1]  # with the vector itself
    a, b = np.random.default_rng(3).integers(0, len(x), (2, 256))
    normal = x[a] - x[b]
    far = np.sqrt((normal**2).sum(axis=1))
    normal = normal[far > 0] / far[far > 0][:, None]
    if not len(normal):
        return 1.0
    total = sum(float((((x[n] - q) @ normal.T) ** 2).sum()) for q, n in zip(x[:256], near, strict=True))
    return 1.702 / max(math.sqrt(total / (near.shape[0] * top * len(normal))), 1e-9)


class Walks:
    """The trees laid end to end for walks of one queue over all of them."""

    def __init__(self, forest: list[Tree], sizes: list[np.ndarray], slope: float = 1.0):
        first = np.cumsum([0] + [len(t.offset) for t in forest])
        leaf = np.cumsum([0] + [t.leaves for t in forest])
        below = lambda child, k: np.where(child >= 0, child + first[k], child - leaf[k]).tolist()
        self.left, self.right = ([c for k, t in enumerate(forest) for c in below(getattr(t, side), k)] for side in ("left", "right"))
        self.roots = [int(first[k]) if len(t.offset) else int(-1 - leaf[k]) for k, t in enumerate(forest)]
        self.tree, self.leaf = np.repeat(np.arange(len(forest)), [t.leaves for t in forest]), np.concatenate([np.arange(t.leaves) for t in forest])
        self.sizes = np.concatenate(sizes).tolist()
        self.normal, self.offset = np.concatenate([t.normal for t in forest]) * slope, np.concatenate([t.offset for t in forest]) * slope

    def leaves_near(self, queries: np.ndarray, search: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, trees and leaves in the order of the queue, until their vectors number ``search``."""
        left, right, sizes, push = self.left, self.right, self.sizes, heapq.heappush
        for margins in queries @ self.normal.T - self.offset:
            margin = margins.tolist()
            queue = [(0.0, root) for root in self.roots]
            heapq.heapify(queue)
            out, held = [], 0
            while queue and held < search:
                cost, node = heapq.heappop(queue)
                while node >= 0:
                    m = margin[node]
                    near, far, m = (right[node], left[node], m) if m > 0 else (left[node], right[node], -m)
                    cost += math.log1p(math.exp(-m)) if m < 30 else 0.0
                    push(queue, (cost + m, far))
                    cost, node = heapq.heappushpop(queue, (cost, near))
                out.append(-1 - node)
                held += sizes[-1 - node]
            yield self.tree[out], self.leaf[out]


def budget(vectors: int, share: float = SHARE) -> int:
    """Members of leaves that a query searches, of so many distinct vectors."""
    return max(LEAST, math.ceil(share * vectors))


def needed_share(x: np.ndarray, forest: list[Tree], slope: float, top: int = TOP) -> float:
    """The share of members after which walks from TRIED vectors of the sample have met RECALL of their true neighbours; 1 if they do not."""
    if len(x) <= top:
        return 1.0
    leaf = np.stack([t.leaf_of(x.astype(np.float32)) for t in forest])
    sizes = [np.bincount(n, minlength=t.leaves) for n, t in zip(leaf, forest, strict=True)]
    needed = []
    tried = x[:TRIED]
    for i, (tree, n) in enumerate(Walks(forest, sizes, slope).leaves_near(tried.astype(np.float32), len(x))):
        score = x @ tried[i]
        score[i] = -2
        held = np.cumsum([sizes[k][m] for k, m in zip(tree, n, strict=True)])
        for near in np.argpartition(-score, top - 1)[:top]:
            met = np.flatnonzero(leaf[tree, near] == n)
            needed.append(held[met[0]] / len(x) if len(met) else 1.0)
    return min(1.0, float(np.quantile(needed, RECALL)))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their squares neither vanish nor overflow; cosines are the same to the bit."""
    x = np.asarray(x, float)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def exact_cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of rows of q with rows of x; each value depends on its two vectors alone."""
    q, x = scaled(q), scaled(x)
    norm = lambda a: np.sqrt((a * a).sum(axis=1))
    return (q * x).sum(axis=1) / (norm(q) * norm(x))


def _matrix(values: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return np.asarray(values.flatten(), dtype=float).reshape(len(values), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _searched(top: int):
    """Streams of the members of a block and then its probes, one block after another: the top + 1 classes in the asked leaves for each probe, by cosine, then smallest id.

    A probe that names no leaves asks all of the block.  Only a block's members are held; probes pass by, however many there are.
    """

    def answers(members: tuple, probes: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        leaf, cid, least, x, ux = members
        found = []
        q = _matrix(probes.column("vector"))
        uq = _unit(q)
        for i, (name, wanted) in enumerate(zip(probes.column("cid").to_pylist(), probes.column("leaves").to_pylist(), strict=True)):
            if wanted:
                begin, end = np.searchsorted(leaf, wanted), np.searchsorted(leaf, wanted, side="right")
                some = np.concatenate([np.arange(a, b) for a, b in zip(begin, end, strict=True)])
                near = ux[some] @ uq[i]
            else:
                some, near = np.arange(len(leaf)), ux @ uq[i]
            if not len(some):
                continue
            k = min(top + 1, len(some))
            some = some[near >= -np.partition(-near, k - 1)[k - 1] - 1e-9]
            score = exact_cosine(q[i][None, :], x[some])
            best = np.lexsort((least[some], -score))[:k]
            found.append((np.full(k, name), cid[some[best]], score[best], least[some[best]]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*found, strict=True)], ["qid", "cid", "score", "least"])

    def opened(rows: list[pa.RecordBatch]) -> tuple:
        table = pa.Table.from_batches(rows).sort_by("leaf")
        x = _matrix(table.column("vector"))
        return *(table.column(c).to_numpy() for c in ("leaf", "cid", "least")), x, _unit(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, members = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (*KEYS, "asks")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if (key := tuple(keys[i, :-1])) != now:
                    now, waiting, members = key, [], None
                if not keys[i, -1]:
                    waiting.append(batch.slice(i, j - i))
                    continue
                if members is None and waiting:
                    members, waiting = opened(waiting), []
                if members is not None:
                    yield from answers(members, batch.slice(i, j - i))

    return run


def nearest(table: DataFrame, every: int = EVERY, top: int = TOP, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, search: int | None = None, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``.

    Each query searches leaves of ``search`` members, or if that is None the budget of the counted vectors
    at the share that the sample needs; ``search`` of all vectors or more is one whole tree.
    """
    spark = table.sparkSession
    kind = table.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.coalesce(~odd, F.lit(False))).where(F.exists("vector", lambda v: v != 0))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vector") == (length[0] if length else 0))
    rows = rows.withColumn("key", F.concat_ws(":", F.xxhash64("vector"), F.xxhash64(F.lit(seed), "vector")))  # 128 bits
    few = rows.dropDuplicates(["key", "vec_id"]).withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("vec_id"))).where(F.col("r") <= top + 1)
    grouped = few.groupBy("key").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = stored(grouped.select(F.monotonically_increasing_id().alias("cid"), "key", "vector", "ids"), "ann-classes")
    drawn = classes.orderBy("key").limit(sample).select("vector").toArrow().column("vector")
    x = _unit(_matrix(drawn)) if len(drawn) else np.zeros((0, length[0] if length else 1))
    rng = np.random.default_rng(seed)
    slope = slope_of(x, top)
    grove = [grown(x, rng, leaf) for _ in range(trees)]  # at most sample nodes a tree
    share = max(SHARE, needed_share(x, grove, slope, top)) if search is None else 0.0
    vectors = classes.count()
    search = budget(vectors, share) if search is None else search
    whole = search >= vectors
    grove = grove[:1] if whole else grove
    forest, trees = spark.sparkContext.broadcast(grove), len(grove)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column("vector"))).astype(np.float32)
                leaves = np.stack([t.leaf_of(unit) for t in forest.value], axis=1).astype(np.int32)
                leaves = pa.FixedSizeListArray.from_arrays(pa.array(leaves.ravel()), trees).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("cid"), leaves], ["cid", "leaves"])

    places = stored(classes.select("cid", "vector").mapInArrow(placed, "cid long, leaves array<int>"), "ann-places")
    dealt = places.select("cid", F.posexplode("leaves").alias("tree", "leaf"))
    counts = dealt.groupBy("tree", "leaf").count().collect()  # at most trees * sample rows
    sizes = [np.zeros(t.leaves, np.int64) for t in forest.value]
    for k, n, count in counts:
        sizes[k][n] = count
    # leaves next to each other share a block; of a larger leaf each part is a block
    blocks = [np.cumsum(n) // block for n in sizes]
    parts = [np.maximum(-(-n // block), 1) for n in sizes]
    shared = spark.sparkContext.broadcast((sizes, blocks, parts))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "key").distinct().join(classes.select("key", F.col("cid").alias("qid")), "key").select("query_id", "qid")
    asked = stored(classes.join(queries.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi").select("cid", "vector"), "ann-asked")

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, blocks, parts = shared.value
        walks = None if whole else Walks(forest.value, sizes, slope)
        every_block = sorted({(0, int(b), part) for b, n in zip(blocks[0], parts[0], strict=True) for part in range(int(n))}) if whole else []
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, who = _unit(_matrix(batch.column("vector"))).astype(np.float32), batch.column("cid").to_pylist()
            for at in range(0, len(unit), 64):
                out = [(*key, who[i], [], i) for i in range(at, min(at + 64, len(unit))) for key in every_block]
                for i, (tree, leaf) in enumerate(walks.leaves_near(unit[at : at + 64], search) if walks else (), at):
                    asks: dict[tuple[int, int, int], list[int]] = {}
                    for k, n in zip(tree.tolist(), leaf.tolist(), strict=True):
                        for part in range(int(parts[k][n])):
                            asks.setdefault((k, int(blocks[k][n]), part), []).append(n)
                    out += [(*key, who[i], sorted(leaves), i) for key, leaves in asks.items()]
                types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
                columns = [pa.array([o[c] for o in out], t) for c, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*columns, batch.column("vector").take(pa.array([o[5] for o in out], pa.int32()))], [*KEYS, "cid", "leaves", "vector"])

    probes = asked.mapInArrow(probing, f"tree int, block long, part int, cid long, leaves array<int>, vector {kind}")
    layout = spark.createDataFrame([(k, n, int(blocks[k][n]), int(parts[k][n])) for k, n, _ in counts], "tree int, leaf int, block long, parts int")
    members = dealt.join(F.broadcast(layout), ["tree", "leaf"]).join(classes.select("cid", "vector", F.col("ids")[0].alias("least")), "cid")
    members = members.withColumn("part", F.pmod(F.xxhash64("cid"), "parts").cast("int"))
    members = members.select(*KEYS, F.lit(False).alias("asks"), "leaf", "cid", "vector", "least", F.lit(None).cast("array<int>").alias("leaves"))
    probes = probes.select(*KEYS, F.lit(True).alias("asks"), F.lit(None).cast("int").alias("leaf"), "cid", "vector", F.lit(None).cast("long").alias("least"), "leaves")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = members.union(probes).repartition(tasks, *KEYS).sortWithinPartitions(*KEYS, "asks")
    found = both.mapInArrow(_searched(top), "qid long, cid long, score double, least long")
    best = found.dropDuplicates(["qid", "cid"]).withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "least"))).where(F.col("r") <= top + 1)
    ids = best.join(classes.select("cid", "ids"), "cid").select("qid", F.explode("ids").alias("vec_id"), "score")
    order = lambda key: W.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("r", F.row_number().over(order("qid"))).where(F.col("r") <= top + 1).drop("r")
    out = queries.join(ids, "qid").where(F.col("vec_id") != F.col("query_id"))
    out = out.withColumn("rank", F.row_number().over(order("query_id"))).where(F.col("rank") <= top)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


KEYS = ("tree", "block", "part")
