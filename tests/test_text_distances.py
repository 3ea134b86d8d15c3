"""Distances of whole texts in all languages against brute force."""

import random

from folioscan.functions import text as T
from folioscan.operators import report


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_whole_texts_of_all_languages(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdéßж中𝄞") for _ in range(rng.choice((10, 60, 400)))) for _ in range(60)]
    texts += ["x" * 350 + "y" * 50, "x" * 400, None, "é" * 40, "e" * 40]
    rows = [(i, t, ("en", "de", None)[i % 3 if i < 30 else 0], "one") for i, t in enumerate(texts)]
    want, last = {}, {}
    for i, t, lang, source in rows:
        b = last.get((lang, source))
        if t is not None and b is not None:
            n = max(len(t), len(b))
            want[i] = levenshtein(t, b) / n if n >= 30 else None
        last[lang, source] = t
    got = report.text_distances(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r["doc_id"]: r["distance"] for r in got.collect()} == want
    assert want[61] == 50 / 400
    assert report.text_report(got).first()["failures"] == sum(d is not None and d > 0.02 for d in want.values())


def test_the_published_bound(spark):
    docs = spark.createDataFrame([(1, "a" * 7000, "en", "s"), (2, "a" * 5999 + "b" * 900, "en", "s")], "doc_id long, text string, lang string, source string")
    assert report.text_distances(docs).first()["distance"] == 1 / 6000
    assert len(docs.select(T.comparable(docs["text"])).first()[0]) == 6000
