import math
import random

import pytest

from folioscan.llm import hard_negatives
from folioscan.llm.hard_negatives import mined, relabelled

TABLE = "vec_id long, embedding array<double>, label int, score long, positive boolean, _block int"


def whole(v):
    return max(min(math.floor(v * 256), hard_negatives.MOST), -hard_negatives.MOST) if abs(v) < 1e300 else int(math.copysign(hard_negatives.MOST, v))


def brute(rows, every=100):
    seen = set()
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        seen.add((i, label, tuple(whole(x) for x in v)))
    order = lambda s, i: (-s, i is None, i or 0)
    out = []
    for anchor in seen:
        if anchor[0] is None or anchor[0] % every:
            continue
        scored = [(max(min(sum(a * b for a, b in zip(anchor[2], r[2], strict=False)), hard_negatives.MOST), -hard_negatives.MOST), r) for r in seen if r != anchor]
        positives = sorted(((s, r) for s, r in scored if r[1] == anchor[1]), key=lambda x: order(x[0], x[1][0]))[:5]
        for p, row in positives:
            fits = sorted(((s, r) for s, r in scored if r[1] != anchor[1] and 30 * p <= 100 * s <= 90 * p), key=lambda x: order(x[0], x[1][0]))[:10]
            out += [(anchor[0], row[0], k + 1, r[0], p, s) for k, (s, r) in enumerate(fits)]
    return sorted(out, key=str)


def found(table, **more):
    return sorted((tuple(r) for r in mined(relabelled(table), **more).collect()), key=str)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 7, True, 7) for r in rows], TABLE)


@pytest.mark.parametrize(("slice_size", "block", "least"), [(65_536, 1_048_576, 2048), (3, 40, 40)])
def test_many_ties(spark, monkeypatch, slice_size, block, least):
    """Few different vectors, so that scores tie; slices and blocks of a few rows give the same."""
    monkeypatch.setattr(hard_negatives, "LEAST_BLOCK", least)
    rng = random.Random(4)
    rows = [(i, [rng.choice((-0.5, 0.0, 0.25, 0.5, 1.0)) for _ in range(3)], rng.randrange(3)) for i in range(700)]
    got = found(table_of(spark, rows), slice_size=slice_size, block=block)
    assert got == brute(rows)
    assert len(got) > 200


def test_the_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert found(e) == brute([(r["vec_id"], r["embedding"], r["label"]) for r in e.collect()])


def test_awkward(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5], 1), (100, [0.0, 0.0], 1), (200, [-1.0, 1.0], 2), (300, [], 1), (400, None, 1), (500, [1.0, None], 1), (600, [nan, 1.0], 1), (800, [1.0, inf], 1), (900, [1.0, 1.0], None)]
    rows += [(1, [0.9, 0.5], 1), (2, [0.8, 0.1], 1), (2, [0.8, 0.1], 1), (None, [0.7, 0.2], 1), (None, [0.3, 0.2], 3), (3, [0.4, 0.3], 2), (4, [0.4, 0.3], 2), (5, [0.5], 2), (6, [0.5, 0.1, 9.0], 3), (8, [-1.0, 0.0], 1), (9, [-0.2, 0.3], 2)]
    rows += [(10, [0.41, 0.3], 4), (10, [0.41, 0.2], 4), (0, [0.6, 0.6], 1)]
    assert found(table_of(spark, rows)) == brute(rows)
    assert found(table_of(spark, rows[2:9])) == []
    assert found(table_of(spark, [])) == []


def test_large_components(spark):
    """Products beyond what doubles hold exactly, and beyond a long."""
    rng = random.Random(5)
    rows = [(i, [rng.choice((1.0, -1.0)) * 10 ** rng.uniform(0, 5) for _ in range(4)], rng.randrange(2)) for i in range(150)]
    rows += [(1000 + i, [10.0 ** rng.uniform(8, 30), 1.0, 3.0, 5.0], rng.randrange(2)) for i in range(0, 150, 50)] + [(5, [1e308, 1.0, 0.0, 0.0], 1)]
    assert found(table_of(spark, rows)) == brute(rows)


def test_repeated_rows_count_once(spark):
    rng = random.Random(6)
    rows = [(i, [rng.random(), rng.random()], rng.randrange(2)) for i in range(120)]
    assert found(table_of(spark, rows + rows[:1] * 300 + rows[5:6] * 300)) == brute(rows)
