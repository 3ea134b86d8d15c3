"""Walks without a bound, and places in large levels."""

from folioscan.operators import graph


def test_a_chain_longer_than_any_bound(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)], "src string, dst string")
    roots = spark.createDataFrame([("n0",)], "node string")
    assert sorted((r["level"], r["node"]) for r in graph.reached(edges, roots).collect()) == [(i, f"n{i}") for i in range(41)]
    assert graph.reached(edges, roots, 8).count() == 8


def test_places_in_ranges(spark):
    found = spark.createDataFrame([(f"n{i:04d}", i % 3) for i in range(1000)], "node string, level int")
    out = graph.renumbered(found)
    assert sorted((r["level"], r["place"], r["node"]) for r in out.collect()) == [(k, p + 1, f"n{3 * p + k:04d}") for k in range(3) for p in range(len(range(k, 1000, 3)))]
    assert "specifiedwindowframe" in out._jdf.queryExecution().toString().lower()
    assert any("_p" in line and "row_number" in line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines())
