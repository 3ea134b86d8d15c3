"""Reports as JSON whose lists are both longer than what can stay of them."""

import json

from pyspark.sql import functions as F

from folioscan.sources.files import capped_json


def test_two_lists_of_more_items_than_fit(spark):
    rows = [(1, 300, 400), (2, 400, 300), (3, 300, 300), (4, 234, 1000), (5, 3, 1000)]
    made = spark.createDataFrame(rows, "doc_id long, a int, b int").select("doc_id", *(F.array_repeat(F.lit("xy"), F.col(c)).alias(c) for c in "ab"))
    got = {r["doc_id"]: json.loads(r["j"]) for r in made.select("doc_id", capped_json(["doc_id"], {"a": F.col("a"), "b": F.col("b")}, 700).alias("j")).collect()}
    for k, n_a, n_b in rows:
        x, y = n_a, n_b
        whole = lambda: len(json.dumps({"doc_id": k, "a": {"items": ["xy"] * x, "total": n_a, "truncated": x < n_a}, "b": {"items": ["xy"] * y, "total": n_b, "truncated": y < n_b}}, separators=(",", ":")))  # noqa: B023, E731
        while whole() > 700:
            x, y = (x - 1, y) if x >= y else (x, y - 1)
        assert (len(got[k]["a"]["items"]), len(got[k]["b"]["items"])) == (x, y)
        assert (got[k]["a"]["total"], got[k]["b"]["total"]) == (n_a, n_b)
