import re
from collections import Counter

from pyspark.sql import functions as F

from folioscan.llm import quality_rules
from folioscan.llm.quality_rules import judged
from tests.llm.conftest import awkward_rows, long_text


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def check(docs, rows):
    got = sorted((tuple(r) for r in judged(docs).select(*COLUMNS).collect()), key=str)
    assert got == sorted(((k, *brute(t)) for k, t in rows), key=str)


def test_awkward(awkward, nothing):
    check(awkward, [r[:2] for r in awkward_rows()])
    assert judged(nothing).count() == 0


def test_both_ways_of_comparing_windows(spark):
    rows = [(1, "a b c d " * 4000), (2, "a b c d " * 5000), (3, long_text(16384) + " a b c x a b c"), (4, long_text(16390) + " a b c x a b c"), (5, "a a a"), (6, "a a a a"), (7, "a b a b a b c")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_colliding_hashes_are_told_apart_by_words(spark, monkeypatch):
    """With a hash that takes few values, counts stay exact, in short and in long texts."""
    rows = [(1, "a b c d e f g a b c"), (2, long_text(300) + " a b c x a b c"), (3, "w " * 60), (4, None), (5, "a b"), (6, long_text(16390) + " a b c x a b c")]
    monkeypatch.setattr(quality_rules, "_joined", lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(3)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_labelled_documents(spark):
    """Documents labelled good that pass the base rule stay; those labelled bad go."""
    sf = "/root/testdata/sf0.1"
    rows = judged(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    found = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert found.get((1, False), 0) <= 0.01 * found[(1, True)]
    assert found.get((0, True), 0) <= 0.05 * found[(0, False)]
