"""What there is is read a fixed number of times, however many levels are walked."""

from pyspark.sql import functions as F

from folioscan.operators import graph


def test_nodes_are_not_read_for_each_level(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def kind(n):
        read.add(1)
        return "URI" if n % 2 else "JavaScript"

    nodes = spark.range(4).select(F.col("id").alias("node"), kind.asNondeterministic()("id").alias("kind")).where("kind <> ''")
    edges = spark.range(3).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    roots = spark.createDataFrame([(0, True)], "node long, open boolean")
    found = graph.action_facts(nodes, edges, roots).collect()
    assert sorted((r["node"], r["open"]) for r in found) == [(i, True) for i in range(4)]
    assert read.value == 4
