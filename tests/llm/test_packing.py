import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioscan.llm.packing import BUDGET, MAX_LENGTH, best_boundaries, packed
from tests.llm.conftest import awkward_rows


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(np.arange(1, 60), 9, replace=False))
    counts = rng.integers(1, 50, 9)
    for k in (1, 2, 3, 5, 20):
        got = best_boundaries(lengths, counts, k)
        best = min(padding(lengths, counts, (*c, lengths[-1])) for c in itertools.combinations(lengths[:-1].tolist(), min(k, 9) - 1))
        assert len(got) <= k and got[-1] == lengths[-1] and padding(lengths, counts, got) == best


def test_no_lengths():
    assert best_boundaries(np.array([]), np.array([])) == []


def test_pieces_and_batches(awkward):
    rows = packed(awkward).collect()
    pieces = Counter()
    for k, text, *_ in awkward_rows():
        for a in range(0, len((text or "").encode().split()), MAX_LENGTH):
            pieces[(k, a // MAX_LENGTH, min(MAX_LENGTH, len(text.encode().split()) - a))] += 1
    assert Counter((r["doc_id"], r["piece"], r["n_tokens"]) for r in rows) == pieces
    places = defaultdict(list)
    for r in rows:
        assert r["n_tokens"] <= r["bucket_length"] and r["first_token"] == r["piece"] * MAX_LENGTH
        places[(r["bucket"], r["batch"], r["bucket_length"])].append(r["place"])
    for (_, _, length), at in places.items():
        assert sorted(at) == list(range(len(at))) and len(at) * length <= max(BUDGET, length)
    for bucket in {k[0] for k in places}:
        full = [len(v) == max(BUDGET // k[2], 1) for k, v in places.items() if k[0] == bucket]
        assert full.count(False) <= 1  # one open batch a bucket


def test_empty_table(nothing):
    assert packed(nothing).count() == 0
