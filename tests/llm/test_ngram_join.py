import random

import pytest
from pyspark.sql import functions as F

from folioscan.llm.components import components
from folioscan.llm.ngram_join import joined, linked
from tests.llm.conftest import awkward_rows, long_text

TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def sets(rows, size=4):
    out = []
    for k, t in rows:
        w = (t or "").encode().translate(TABLE).split()
        out.append((k, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    return out


def brute(rows, percent=85, size=4):
    known = sets(rows, size)
    root = list(range(len(known)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(known):
        for j in range(i):
            b = known[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(known):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i)) if s else k) for i, (k, s) in enumerate(known)), key=str)


def rows_of(frame):
    return sorted(map(tuple, frame.drop("cid", "root").collect()), key=str)


def test_awkward(awkward, nothing):
    assert rows_of(joined(awkward)) == brute([r[:2] for r in awkward_rows()])
    assert joined(nothing).count() == 0


def test_table(some):
    rows = [(r["doc_id"], r["text"]) for r in some.collect()]
    assert rows_of(joined(some)) == brute(rows)
    assert rows_of(joined(some, percent=80, size=5)) == brute(rows, 80, 5)


def near_copies(seed, n=120):
    rng = random.Random(seed)
    bases = [long_text(rng.randrange(12, 90), 10 * seed + i).split() for i in range(4)]
    rows = []
    for k in range(n):
        words = list(bases[rng.randrange(4)])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        if rng.random() < 0.2:
            words = words[: rng.randrange(3, len(words))]
        rows.append((rng.randrange(10**6), (" " if rng.random() < 0.8 else "\n").join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 1_000_000), (2, 300), (3, 900), (4, 60)])
def test_near_copies(spark, seed, block):
    """In one block, and compared with the typical class and in pairs of few and of many blocks."""
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(joined(docs, block=block)) == brute(rows)


def test_long_lists_are_probed():
    """Many sets with a common core: merged by sorting, not by the heap."""
    import numpy as np

    core = np.arange(1000, 1085, dtype=np.uint64)
    each = [np.concatenate([np.arange(15, dtype=np.uint64) + 15 * i, core]) for i in range(40)]
    same = [np.concatenate([np.arange(5, dtype=np.uint64) + 10**6, core]) for _ in range(2)]
    got = linked(list(range(42)), [100] * 40 + [90, 90], each + same)
    assert sorted(sorted(x) for x in got) == [[40, 41]]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 7)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    want = {i: find(i) for i in list(root)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0
