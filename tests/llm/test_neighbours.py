import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folioscan.llm.neighbours import LEAST, TREES, Walks, budget, grown, nearest, slope_of


def brute(rows, every=50, top=5):
    dims = len(next(v for _, v in rows if v is not None and None not in v))
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == dims and None not in v and np.isfinite(v).all() and any(v)})
    x = np.array([v for _, v in ok])
    ids = np.array([i for i, _ in ok])
    out = {}
    for q, i in zip(x, ids, strict=True):
        if i % every == 0:
            score = (q * x).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1)))
            near = [k for k in np.lexsort((ids, -score)) if ids[k] != i][:top]
            out[int(i)] = [(int(ids[k]), float(score[k])) for k in near]
    return out


def test_recall_on_the_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in e.collect()])
    for search, least in ((44_000, 0.99), (3_000, 0.5)):
        got = {}
        for r in nearest(e, search=search).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        assert set(got) == set(want)
        hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q].values()}) for q in want)
        assert hits / sum(map(len, want.values())) >= least


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [2.0, 0.0])] + [(i, [1.0, 0.0]) for i in range(1, 12)] + [(20, [0.0, 0.0]), (21, None), (22, [nan, 1.0]), (23, [inf, 1.0]), (24, [None, 1.0]), (25, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (30, [0.5, 0.5]), (30, [0.5, 0.5]), (31, [-1.0, 0.0]), (150, []), (200, None)]
    table = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<double>, cid int, tree int")
    got = {}
    for r in nearest(table, leaf=3, block=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows)
    assert set(got) == set(want) == {0, 50, 100}
    for q, near in got.items():
        assert [v for _, v, _ in sorted(near)] == [v for v, _ in want[q]]
        assert [s for *_, s in sorted(near)] == pytest.approx([s for _, s in want[q]], abs=1e-15)


def test_few_and_none(spark):
    assert nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).count() == 1
    assert nearest(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_one_queue_reaches_the_own_leaf_first():
    x = np.random.default_rng(1).normal(size=(500, 8))
    forest = [grown(x, np.random.default_rng(k), 20) for k in range(3)]
    sizes = [np.bincount(t.leaf_of(x), minlength=t.leaves) for t in forest]
    walks = Walks(forest, sizes, 1000.0)
    near = lambda search: [set(zip(t.tolist(), n.tolist(), strict=True)) for t, n in walks.leaves_near(x[:20], search)]
    own = [{(k, int(t.leaf_of(q[None])[0])) for k, t in enumerate(forest)} for q in x[:20]]
    assert all(first <= o for o, first in zip(own, near(1), strict=True))
    assert all(o <= found for o, found in zip(own, near(900), strict=True))
    assert all(len(found) == sum(t.leaves for t in forest) for found in near(10**9))


def test_leaves_are_numbered_from_left_to_right_and_hold_all():
    x = np.random.default_rng(2).normal(size=(300, 5)).astype(np.float32)
    x[:40] = x[0]  # nothing can part these
    tree = grown(x, np.random.default_rng(0), 6)
    assert sorted(c for c in (*tree.left, *tree.right) if c < 0) == list(range(-tree.leaves, 0))
    assert np.bincount(tree.leaf_of(x), minlength=tree.leaves).max() >= 40
    walk, todo = [], [0]
    while todo:
        if (node := int(todo.pop())) < 0:
            walk.append(-1 - node)
        else:
            todo += [tree.right[node], tree.left[node]]
    assert walk == list(range(tree.leaves))
    assert grown(x[:1], np.random.default_rng(0)).leaves == 1


@pytest.mark.parametrize(("n", "most"), [(10_256, 0.21), (51_282, 0.21)])
def test_a_fifth_of_the_vectors_is_scored(n, most):
    """Dense noise in 64 dimensions, the hardest case."""
    x = np.random.default_rng(4).normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    sample = x[:16_384]
    forest = [grown(sample, np.random.default_rng(k)) for k in range(TREES)]
    at = [t.leaf_of(x) for t in forest]
    by = [(np.argsort(a, kind="stable"), np.searchsorted(np.sort(a), np.arange(t.leaves + 1))) for a, t in zip(at, forest, strict=True)]
    walks = Walks(forest, [np.diff(start) for _, start in by], slope_of(sample))
    hits = scored = 0
    for q, (tree, leaf) in zip(x[:60], walks.leaves_near(x[:60], budget(n)), strict=True):
        found = np.unique(np.concatenate([by[k][0][by[k][1][i] : by[k][1][i + 1]] for k, i in zip(tree, leaf, strict=True)]))
        scored += len(found) / n
        hits += len(np.intersect1d(found, np.argpartition(-(x @ q), 6)[:6])) - 1
    assert scored / 60 <= most
    assert hits / 300 >= 0.9


def test_tiny_and_huge_vectors(spark):
    rows = [(i, [s * a, s * b]) for i, (s, a, b) in enumerate([(1e200, 1.0, 0.5), (1e-200, 1.0, 0.51), (1.0, 1.0, 0.52), (1e-310, 1.0, -3.0), (1e300, -1.0, 2.0)] * 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in nearest(table, every=50).orderBy("rank").collect()]
    unit = [np.array(v) / max(abs(x) for x in v) for _, v in rows]
    cos = [float((unit[0] * u).sum() / (np.sqrt((unit[0] ** 2).sum()) * np.sqrt((u**2).sum()))) for u in unit]
    want = sorted(range(1, len(rows)), key=lambda i: (-cos[i], i))[:5]
    assert [v for v, _ in got] == want
    assert [s for _, s in got] == pytest.approx([cos[i] for i in want], abs=1e-12)


def test_recall_holds_as_the_table_grows(spark, tmp_path):
    n, every = 102_564, 1000
    x = np.random.default_rng(3).normal(size=(n, 64))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float64()))}), tmp_path / "e.parquet")
    table = spark.read.parquet(str(tmp_path / "e.parquet"))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = {}
    for r in nearest(table, every=every).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, n, every):
        near = unit @ unit[q]
        near[q] = -2
        hits += len(set(np.argpartition(-near, 5)[:5].tolist()) & got[q])
    assert hits / (5 * len(range(0, n, every))) >= 0.94
    assert budget(1000) == LEAST and budget(10 * n) > 2 * budget(n)


@pytest.mark.parametrize("kind", ["far from the origin", "many dimensions", "few components", "half in one spot"])
def test_recall_on_other_rows(kind, spark, tmp_path):
    rng, n = np.random.default_rng(6), 3000
    x = rng.normal(size=(n, 256 if kind == "many dimensions" else 64))
    if kind == "far from the origin":
        x += 30
    elif kind == "few components":
        x *= rng.random(x.shape) < 0.05
        x[:, 0] += np.where(np.any(x, axis=1), 0, 1)
    elif kind == "half in one spot":
        x[::2] = 5 * rng.normal(size=64) + 0.3 * x[::2]
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))}), tmp_path / "e.parquet")
    want = brute(list(enumerate(x.tolist())))
    got = {}
    for r in nearest(spark.read.parquet(str(tmp_path / "e.parquet"))).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len({v for v, _ in near} & got[q]) for q, near in want.items()) >= 0.93 * sum(map(len, want.values()))
