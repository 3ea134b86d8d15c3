"""Many queries of one pattern, and more patterns than one pass takes."""

from folioscan.operators import search


def test_equal_patterns_and_many_passes(spark, monkeypatch):
    monkeypatch.setattr(search, "MANY_PATTERNS", 3)
    pages = spark.createDataFrame([(1, 0, "one two one"), (2, 0, "three"), (3, 0, None)], "doc_id long, page int, text string")
    rows = [(i, w, False, False, False) for i, w in enumerate(["one", "one", "two", "three", "four", "e", "t", "one", "w", "(", ""])]
    queries = spark.createDataFrame(rows, "query_id long, text string, regex boolean, case_sensitive boolean, whole_word boolean")
    want = sorted((q, d, 0, i, len(w), w) for q, w, *_ in rows if w for d, text in ((1, "one two one"), (2, "three")) for i in range(len(text)) if text.startswith(w, i))
    found = search.many_hits(pages, queries)
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort [_n" not in plan
    assert search.many_hits(pages, queries.where("text = ''")).count() == 0
