"""Search without a bound on a page."""

from folioscan.operators import search


def test_all_hits_of_one_long_line(spark):
    n = 25_000
    pages = spark.createDataFrame([(1, 0, "the ab " * n), (2, 0, "x the"), (3, 0, "none")], "doc_id long, page int, text string")
    got = sorted((r["doc_id"], r["first"], r["count"], r["match"]) for r in search.hits(pages, search.pattern("the")).drop("hay").collect())
    assert got == [(1, 7 * i, 3, "the") for i in range(n)] + [(2, 2, 3, "the")]
    outcomes = {r["doc_id"]: (r["hits"], r["outcome"]) for r in search.search_outcomes(search.hits(pages, search.pattern("the")), pages).collect()}
    assert outcomes == {1: (10_000, "TooManyHits"), 2: (1, "Finished"), 3: (0, "Finished")}
