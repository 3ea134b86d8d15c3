"""The texts of a batch are not all held as strings at once, and distances stay those of brute force."""

import random
import tracemalloc

import pyarrow as pa

from folioscan.operators import report
from tests.test_text_distances import levenshtein


def test_a_batch_of_long_texts():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "a": ["x" * 6000] * 3000, "b": ["x" * 6000] * 3000})
    tracemalloc.start()
    out = list(report._distances(30)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[0].column("distance").to_pylist() == [0.0] * 3000
    assert peak < 4_000_000


def test_distances_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(70))) for _ in range(2))
        assert report.edit_distance(a, b) == levenshtein(a, b)
