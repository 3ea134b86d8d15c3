"""Queries without an inner word."""

from folioscan.operators import search


def test_needles_without_an_inner_word(spark):
    texts = ["one two three four", "中文文本没有空格", "a -> b; --", "𝄞x", "", None, "two"]
    needles = ["two", "two three", "文本没有", "->", "-", "x", "𝄞", "", None, "four ", "e two three f", "wo"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame(list(enumerate(needles)), "query_id long, text string")
    got = sorted((r["query_id"], r["doc_id"]) for r in search.containing(docs, queries).collect())
    assert got == [(i, k) for i, n in enumerate(needles) for k, t in enumerate(texts) if n is not None and t is not None and n in t]
