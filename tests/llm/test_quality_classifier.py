import zlib

import numpy as np
import pyarrow as pa
import pytest

from folioscan.llm import quality_classifier as qc
from folioscan.llm import queries, textnum
from tests.llm.conftest import awkward_rows, long_text

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return qc.train_on(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_labels(spark):
    """Documents that were not learned from are told apart."""
    got = queries.op12_quality_classifier(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1
    labels = [(rows[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["doc_id"] in rows]
    held = [(r["score"], y) for r, y in labels if r["held_out"]]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([s > t for s in good for t in bad]) >= 0.98
    assert np.mean([(s >= 0.3) == y for s, y in held]) >= 0.95
    assert np.mean([s >= 0.3 for s in good]) >= 0.98


def test_gradients():
    """Each gradient against the change of the loss."""
    rng = np.random.default_rng(1)
    shapes = {"E": (qc.FEATURES, 3), "e": (3,), "V": (3, 2), "U": (3, 2), "w": (2,), "c": (3,), "d": (1,)}
    model = qc.Model(np.zeros(qc.FEATURES), np.ones(qc.FEATURES), {k: rng.normal(size=s) for k, s in shapes.items()})
    x, bags, y, weight = rng.normal(size=(7, qc.FEATURES)) / 8, np.array([0, 3, 4, 7]), np.array([1.0, 0, 1]), np.array([0.5, 1, 2])

    def loss():
        s = model.forward(x, bags)["score"]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum()

    for name, grad in model.step(x, bags, y, weight).items():
        w = model.weights[name]
        for at in list(np.ndindex(w.shape))[:12]:
            was, around = w[at], []
            for d in (1e-5, -1e-5):
                w[at] = was + d
                around.append(loss())
            w[at] = was
            assert grad[at] == pytest.approx((around[0] - around[1]) / 2e-5, rel=1e-3, abs=1e-6)


def plain_passages(text, size=qc.WORDS):
    """The features of a text's passages, word by word."""
    spaces = b" \t\n\x0b\x0c\r"
    words, now = [], bytearray()
    for c in text.encode() + b" ":
        if c in spaces:
            if now:
                words.append(bytes(now))
            now = bytearray()
        else:
            now.append(c)
    out = []
    for i in range(0, max(len(words), 1), size):
        some = words[i : i + size]
        pairs, kinds = np.zeros(qc.PAIRS), np.zeros(5)
        for w in some:
            for a, b in zip(w, w[1:] + b" ", strict=True):
                pairs[(a * 97 + b * 31) % qc.PAIRS] += 1
                kinds[0 if 97 <= a <= 122 else 1 if 65 <= a <= 90 else 2 if 48 <= a <= 57 else 4 if a >= 128 else 3] += 1
        n, m = sum(map(len, some)), len(some)
        back = [sum(j >= k and w == some[j - k] for j, w in enumerate(some)) / max(m, 1) for k in qc.BACK]
        out.append([*np.sqrt(pairs / max(n, 1)), *(kinds / max(n, 1)), *back, (m - len(set(some))) / max(m, 1), np.log1p(n / max(m, 1)), np.log1p(m)])
    return out


def test_features(monkeypatch):
    texts = [t for _, t, *_ in awkward_rows() if t is None or len(t) < 5000] + [long_text(700), "same " * 130, "no-space-at-end", "x" * 3000]
    for most in (textnum.SLICE_BYTES, 512):
        monkeypatch.setattr(textnum, "SLICE_BYTES", most)
        x, bags = qc.passages(pa.array(["skipped", *texts], pa.string())[1:])
        want = [plain_passages(t or "") for t in texts]
        assert np.diff(bags).tolist() == list(map(len, want))
        assert np.allclose(x, np.array([p for w in want for p in w]), atol=1e-5)


def test_scores_and_attention(spark, model, awkward, nothing):
    got = qc.scored(awkward, model, keep=("doc_id", "n_chars")).collect()
    assert len(got) == len(awkward_rows())
    for r in got:
        text = next(t for k, t, *_ in awkward_rows() if k == r["doc_id"] and (None if t is None else len(t)) == r["n_chars"])
        x = np.array(plain_passages(text or ""))
        f = model.forward(x, np.array([0, len(x)]))
        assert r["score"] == pytest.approx(float(f["score"][0]), abs=1e-3)
        assert r["n_passages"] == len(x) and f["a"][r["passage"]] >= f["a"].max() - 1e-3
    assert qc.scored(nothing, model).count() == 0


def test_labels(spark, nothing):
    rows = [(i, "good words here " * 9 if i % 2 else "@@@ ### !!! " * 9) for i in range(40)]
    docs = spark.createDataFrame([*rows, (None, "x"), (3, "another text of this id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 0), (1, None), (7, 0), (7, 1), (999, 1)], "doc_id long, quality int")
    found = {(r["doc_id"], r["predicted"], r["held_out"]) for r in qc.judged(qc.scored(docs.where("doc_id <> 3"), qc.train_on(docs, labels))).collect()}
    assert found == {(i, i % 2, zlib.crc32(str(i).encode()) % 5 == 0) for i in range(40) if i != 3}
    assert {r["held_out"] for r in qc.judged(qc.scored(docs.where("doc_id is null"), qc.train_on(docs, labels))).collect()} == {True}
    for some, share in ((labels.where("quality = 1"), 1.0), (labels.where("quality > 1"), 0.5)):
        assert {r["score"] for r in qc.scored(docs, qc.train_on(docs, some)).collect()} == {share}
    assert {r["score"] for r in qc.scored(docs, qc.train_on(nothing, labels)).collect()} == {0.5}
