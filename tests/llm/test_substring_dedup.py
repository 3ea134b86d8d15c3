import hashlib
import random
from collections import Counter

import pytest

from folioscan.llm.substring_dedup import FingerprintIndex, deduplicated
from tests.llm.conftest import awkward_rows


def brute(rows, window=35):
    words = [(k, (t or "").encode().split()) for k, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for k, w in words:
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = b"\1" * window
        out.append((k, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_awkward(awkward, nothing):
    assert rows_of(deduplicated(awkward)) == brute([r[:2] for r in awkward_rows()])
    assert deduplicated(nothing).count() == 0


def test_table(some):
    assert rows_of(deduplicated(some)) == brute([(r["doc_id"], r["text"]) for r in some.collect()])


@pytest.mark.parametrize("seed", range(2))
def test_random_overlaps(spark, seed):
    """Few words, so that windows repeat at all distances, inside documents too; edges of passages fall anywhere."""
    rng = random.Random(seed)
    passage = [f"w{rng.randrange(40)}" for _ in range(200)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(rng.randrange(4)):
            a = rng.randrange(150)
            text += passage[a : a + rng.randrange(8, 60)] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3))]
        rows.append((k, rng.choice([" ", "\n", "\t  "]).join(text)))
    rows += [(100, "a " * 80), (101, "a " * 36), (102, "a " * 35)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(deduplicated(docs)) == brute(rows)
    assert rows_of(deduplicated(docs, window=12, anchor=5, batches=3)) == brute(rows, 12)


def test_index_merges_and_compacts(spark):
    index = FingerprintIndex(spark, fan_in=2, buckets=3)
    batches = [[1, 2, 3], [3, 4, 4], [5, 1], [6, 2, 7], [7, 8]]
    shared = [{r[0] for r in index.add(spark.createDataFrame([(x,) for x in b], "fp long")).collect()} for b in batches]
    assert shared == [set(), {3, 4}, {1}, {2}, {7}]
    assert len(index.runs) <= 2
    kept = Counter({r["fp"]: 0 for name in index.runs for r in spark.table(name).collect()})
    for name in index.runs:
        for r in spark.table(name).collect():
            kept[r["fp"]] += r["n"]
    assert kept == Counter(x for b in batches for x in b)
    plan = spark.table(index.runs[0]).hint("merge").join(spark.table(index.runs[-1]), "fp")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    index.close()


def test_an_index_remembers_earlier_calls(spark):
    """A later call loses what one call over both would take from it; fan_in 2 compacts on the way."""
    rng = random.Random(4)
    passage = [f"w{rng.randrange(60)}" for _ in range(300)]

    def text():
        out = []
        for _ in range(3):
            a = rng.randrange(240)
            out += passage[a : a + rng.randrange(20, 60)] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]
        return " ".join(out)

    rows = [(k, text()) for k in range(40)]
    rows += [(40 + k, rows[k][1]) for k in (0, 21)] + [(60, None), (61, ""), (62, " ".join(f"once{i}" for i in range(90)))]
    calls = [rows[:15], rows[15:30], rows[30:]]
    index = FingerprintIndex(spark, fan_in=2)
    so_far = []
    for call in calls:
        so_far += call
        want = [r for r in brute(so_far) if r[0] in {k for k, _ in call}]
        got = rows_of(deduplicated(spark.createDataFrame(call, "doc_id long, text string"), batches=2, index=index))
        assert got == want
        assert len(index.runs) <= 2
    assert sum(r[2] for r in want) > 0 and index.texts
    index.close()
    assert index.runs == index.texts == index.blocks == []


def test_an_index_is_opened_again(spark, tmp_path):
    """Two sessions over an index in a folder equal one call over all; a call that failed leaves the index as it was."""
    rng = random.Random(5)
    passage = [f"w{rng.randrange(60)}" for _ in range(200)]
    rows = [(k, " ".join(passage[(a := rng.randrange(140)) : a + 50] + [f"u{rng.randrange(10**6)}" for _ in range(9)])) for k in range(24)]
    path, so_far = str(tmp_path / "index"), []
    for n, call in enumerate((rows[:9], rows[9:10], rows[10:14], rows[14:])):
        session = spark.newSession()
        for name in session.catalog.listTables():
            if name.name.startswith("fingerprint_"):
                session.sql(f"DROP TABLE {name.name}")  # another session's catalog knows none of them
        index = FingerprintIndex.open(session, path, fan_in=2) if n else FingerprintIndex(session, fan_in=2, path=path)
        so_far += call
        got = rows_of(deduplicated(session.createDataFrame(call, "doc_id long, text string"), batches=2, index=index))
        assert got == [r for r in brute(so_far) if r[0] in {k for k, _ in call}]
        assert max(map(len, (index.runs, index.blocks, index.texts))) <= 2 and index.version == n + 1
        index.add(session.createDataFrame([(1,)], "fp long"))  # not committed
    index = FingerprintIndex.open(spark, path)
    assert index.version == 4 and sum(t.count() for t in index.rows("texts")) == len({t for _, t in rows})
    plan = index.rows("blocks")[0].hint("merge").join(index.rows("runs")[0], "fp")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    index.close()


def test_window_must_fit(awkward):
    with pytest.raises(ValueError):
        deduplicated(awkward, window=100, anchor=8)
