import random
import re
import zlib
from collections import Counter

import pytest

from folioscan.llm import spelling
from tests.llm.conftest import awkward_rows


def counts(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            n[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def rows_of(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("group", "asked"), [(1024, 16_384), (4, 7)])
def test_random_words(spark, monkeypatch, group, asked):
    """Few letters and short words, so that halves are shared by many and keys are dealt over a grid."""
    monkeypatch.setattr(spelling, "ASKED", asked)
    rng = random.Random(3)
    n = {}
    while len(n) < 700:
        word = "".join(rng.choice("abcdé" if rng.random() < 0.7 else "ab") for _ in range(rng.choice((5, 5, 6, 7, 8))))
        n[word] = rng.choice((3, 4, 6, 8, 12, 16, 24, 32, 64))
    frame = spark.createDataFrame(list(n.items()), "word string, n long")
    got = rows_of(spelling.grouped(frame, group=group))
    assert got == brute(n)
    assert any(r[1] and r[1] != r[2] for r in got)  # chains of forms


def test_chain_of_forms(spark):
    n = {"a" * 20 + "b" * i: 3 * 2**i for i in range(12)} | {"lonelyword": 7, "lonelywards": 7, "×××÷÷": 9}
    assert rows_of(spelling.grouped(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n)


def test_documents(spark, some):
    assert rows_of(spelling.grouped(spelling.vocabulary(some))) == brute(counts((r["doc_id"], r["text"]) for r in some.collect()))


def test_awkward(awkward, nothing, spark):
    got = rows_of(spelling.grouped(spelling.vocabulary(awkward)))
    assert got == brute(counts((k, t) for k, t, *_ in awkward_rows()))
    assert spelling.grouped(spelling.vocabulary(nothing)).count() == 0
    long = "xyz" * 3000
    rows = [(1, f"{long} {long} {long} {long[:-1]}! {long[:-1]}! {long[:-1]}! {long[:-1]}! {long[:-1]}! {long[:-1]}! {long[:-1]}!")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(spelling.grouped(spelling.vocabulary(table, planted=None))) == {(long, long[:-1], long[:-1], 3, 1, 7), (long[:-1], None, long[:-1], 7, 1, None)}


def test_without_planted_errors(some):
    got = {r["word"]: r["n"] for r in spelling.vocabulary(some, planted=None).collect()}
    n = Counter(w.translate({i: i + 32 for i in range(65, 91)}) for r in some.collect() for w in re.findall("[A-Za-zÀ-ÿ]+", r["text"]))
    assert got == {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
