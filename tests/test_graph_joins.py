"""Levels of many rows are joined by shuffles, however small their files are: nothing that grows with the tables goes through the driver."""

from pyspark.sql import functions as F

from folioscan.operators import graph, report


def test_levels_of_many_rows_are_not_broadcast(spark, monkeypatch):
    plans, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, label))
    n = 150_000
    nodes = spark.range(3 * n).select((F.col("id") % n).alias("doc_id"), F.floor(F.col("id") / n).alias("node"), F.lit("URI").alias("kind"))
    edges = nodes.where("node < 2").select("doc_id", F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    roots = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("node"), F.when(F.col("id") % 3 > 0, F.col("id") % 3 == 1).alias("open"))
    facts = graph.action_facts(nodes, edges, roots, ["doc_id"])
    plans.append(facts._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "BroadcastExchange" in p]
    assert facts.count() == 3 * n and facts.where("open").count() == n and facts.where("open and doc_id % 3 != 1").isEmpty()
    plans.clear()
    found = graph.discovered(edges, roots, ["doc_id"], nodes)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "BroadcastExchange" in p]
    assert found.where("number = node + 1 and level = node").count() == 3 * n


def test_open_roots_and_others_meet(spark):
    nodes = spark.createDataFrame([(i, "JavaScript") for i in range(6)], "node long, kind string")
    edges = spark.createDataFrame([(0, 2), (1, 2), (2, 3), (3, 2), (4, 5)], "src long, dst long")
    roots = spark.createDataFrame([(0, False), (1, True), (4, None)], "node long, open boolean")
    found = {r["node"]: r["open"] for r in graph.action_facts(nodes, edges, roots).collect()}
    assert found == {0: False, 1: True, 2: True, 3: True, 4: False, 5: False}


def test_features_of_many_documents_are_not_broadcast(spark):
    n = 150_000
    nodes = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("node"), F.lit("Launch").alias("kind"))
    edges = nodes.select("doc_id", F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    facts = graph.action_facts(nodes, edges, nodes.select("doc_id", "node", F.lit(True).alias("open")), ["doc_id"])
    documents = spark.range(n + 5).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).alias("locked"))
    rows = report.features(facts.select("doc_id", F.lit("action").alias("place"), F.col("kind").alias("what"), "open"), documents)
    assert "BroadcastExchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.where("launch_actions").count() == n * 4 // 5 and rows.where("not launch_actions").count() == 4
