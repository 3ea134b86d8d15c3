from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioscan.llm.mixing import mixed, source_targets
from tests.llm.conftest import awkward_rows


def targets(sizes):
    """By the rule's own rounds: share by weight, clamp, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    out, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total >= 3 * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in free}
        for s in above:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in above)
        free -= above
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 500, None: 3}, {"a": 1, "b": 1, "c": 1}, {"a": 0, "b": 7}, {None: 5}, {"a": 1000, "b": 1, "c": 2, "d": 3, "é": 4, "Z": 5}, {"a": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(rows).collect()}
    assert got == pytest.approx(targets(sizes))


def test_taken(awkward, some):
    for docs in (awkward, some):
        rows = mixed(docs).collect()
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixed(docs.repartition(5)).collect()), key=str)
        by = defaultdict(list)
        for r in rows:
            assert 0 <= r["taken"] <= 3 * r["size"]
            by[r["source"]].append(r)
        want = targets({s: sum(r["size"] for r in v) for s, v in by.items()})
        for s, v in by.items():
            assert v[0]["target"] == pytest.approx(want[s]) and abs(sum(r["taken"] for r in v) - want[s]) <= 1
            assert {r["source_size"] for r in v} == {sum(r["size"] for r in v)}
    assert sorted((r["doc_id"], r["size"]) for r in mixed(awkward).collect() if r["doc_id"]) == sorted((k, len((t or "").encode().split())) for k, t, *_ in awkward_rows() if k)


def test_empty_and_seed(nothing, some):
    assert mixed(nothing).count() == 0
    assert mixed(some, seed="other").exceptAll(mixed(some)).count() > 0
    assert mixed(some).agg(F.sum("taken")).first()[0] > 0
