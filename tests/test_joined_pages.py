"""Patterns that Python reads alike go through many pages at once, and find what Java finds."""

import random
import string

from folioscan.operators import grammar, search

SCHEMA = "query_id long, text string, regex boolean, case_sensitive boolean, whole_word boolean"


def one_by_one(pages, asked):
    whole = None
    for i, text, is_regex, case, word in asked:
        one = search.hits(pages, search.pattern(text, case, word, is_regex)).selectExpr(f"{i}L AS query_id", "doc_id", "page", "first", "count", "match")
        whole = one if whole is None else whole.union(one)
    return sorted(map(tuple, whole.collect()))


def test_all_letters(spark, monkeypatch):
    monkeypatch.setattr(search, "JOINED", 30_000)
    monkeypatch.setattr(search, "LEAVING", 50)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    pages = [(i, 0, "".join(f"{c}x" for c in letters[i : i + 2000])) for i in range(0, len(letters), 2000)] + [(-1, 0, None), (-2, 0, ""), (-3, 0, "k\n x￿K"), (-4, 0, "KX")]
    pages = spark.createDataFrame(pages, "doc_id long, page int, text string")
    texts = [f"{c}x" for c in string.ascii_lowercase + "AKSI90"]
    asked = [(i, t, False, False, False) for i, t in enumerate(texts)] + [(90, "kx", False, True, False), (91, "[a-z]x", True, False, False), (92, "[a-z]x", True, True, False)]
    asked += [(93, f"[{string.ascii_lowercase}0-9]x", True, False, False), (94, "é\U0001d11e?x", True, True, False), (95, "�", False, True, False), (96, "x\n", False, True, False)]
    found = search.many_hits(pages, spark.createDataFrame(asked, SCHEMA))
    assert sorted(map(tuple, found.collect())) == one_by_one(pages, asked)


def test_simple_patterns(spark, monkeypatch):
    monkeypatch.setattr(search, "JOINED", 60)
    monkeypatch.setattr(search, "LEAVING", 3)
    rng = random.Random(4)
    made = lambda: "".join(rng.choice(["a", "b", "ab ", "Ba", r"\s+", "[a-b]", "b?", "a*?", "c{1,2}", "(?:a|bb)", "(c|)", "é", "-"]) for _ in range(rng.randrange(1, 4)))
    asked = [(i, made(), True, rng.random() < 0.4, False) for i in range(40)]
    asked = [a for a in asked if not grammar.compiled(*a[1:]).problem]
    texts = ["".join(rng.choice("abcABC  \n\té-") for _ in range(rng.randrange(40))) for _ in range(60)]
    pages = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts)], "doc_id long, page int, text string")
    want = one_by_one(pages, asked)
    plain = [a for a in asked if (c := grammar.compiled(*a[1:])).needs and grammar.alike(c.java)]
    assert len(want) > 300 and 15 < len(plain) < len(asked)
    assert sorted(map(tuple, search.many_hits(pages, spark.createDataFrame(asked, SCHEMA)).collect())) == want
    found = search.many_hits(pages, spark.createDataFrame(plain, SCHEMA))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # before, a page was copied for each pattern that it may hold


def test_what_reads_alike():
    alike = lambda *a: grammar.alike(grammar.compiled(*a).java)
    assert alike(r"(It|a)[a-z]{2}\s+b") == (True, r"(?:(?:it|a)[a-z]{2} +b)") and alike("It", True, True) == (False, "(?:It)")
    for text in ("é", "[A-Z]a", "(a|b)+c", "a$", "a.", "[^a]b", r"\w+a", "(?-i:a)b"):
        assert alike(text) is None, text
    assert grammar.alike(grammar.compiled("a", False, False, True).java) is None
