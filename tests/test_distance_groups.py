"""Distances of many pairs at once: the same as one by one, and pairs of a batch are no longer walked one by one."""

import random

import pyarrow as pa

from folioscan.operators import report
from tests.test_text_distances import levenshtein


def changed(rng, text, letters):
    out = list(text)
    for _ in range(rng.randrange(1, 9)):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(3)] = rng.choice(letters) * rng.randrange(3)
    return "".join(out)


def pairs_of(rng, number):
    for _ in range(number):
        letters = "abcdéß日\U0001f642"[: rng.randrange(1, 9)]
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(rng.choice((5, 70, 330))))) for _ in range(2))
        yield rng.choice([(a, b), (b, a + b), (a, changed(rng, a, letters)), (a[: len(a) // 2] + b, a), (a, a), (b[:3], a)])


def distances(pairs):
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(pairs))), "a": [a for a, _ in pairs], "b": [b for _, b in pairs]})
    return next(report._distances(30)(iter([batch]))).column("distance").to_pylist()


def share(a, b, distance):
    longer = max(len(a), len(b))
    return distance(a, b) / longer if longer >= 30 else None


def test_groups_against_brute_force(monkeypatch):
    pairs = list(pairs_of(random.Random(8), 400))
    singly = []
    monkeypatch.setattr(report, "edit_distance", lambda a, b: singly.append(a) or levenshtein(a, b))
    assert distances(pairs) == [share(a, b, levenshtein) for a, b in pairs]
    assert len(singly) < 16  # 400 before


def test_long_texts_and_many_letters():
    rng = random.Random(9)
    many = [chr(0x4E00 + i) for i in range(3000)]
    pairs = [("".join(rng.choices(letters, k=rng.randrange(2000, 6000))), "".join(rng.choices(letters, k=rng.randrange(20, 6000)))) for letters in ("abcdefgh", many) for _ in range(40)]
    rng.shuffle(pairs)
    assert distances(pairs) == [share(a, b, report.edit_distance) for a, b in pairs]
    assert distances([]) == []
