"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of WORDS words.  A passage is encoded from hashed
byte pairs, shares of kinds of bytes, and how often words come back in it: x, then
h = tanh(x E).  A gated attention network weighs the passages of a document,
a = softmax(w . (tanh(h V) * sigmoid(h U))), and the score is that of the weighted
passage, sigmoid(c . sum(a h) + d).  Only documents have labels; what the attention
looks at is learned from them.

The model is fitted on the driver with Adam, on SAMPLE documents of each label at
most, those with the smallest hashes of their ids, of at most SAMPLE_BYTES; they are
weighed by how frequent their label is among all that may be learned from.  Every
row is then scored over its whole text, in runs of passages, so that a long text does
not need more memory than its encoded passages.

Defined cases: null and empty texts, and those of white space, are one passage
without words; of several labels of an id the mean counts, from 0.5 as 1, null labels
do not; of texts with one id the first in order is learned from; without labels of
both kinds the score is the share of label 1, 0.5 without any; a null doc_id is held
out as an empty one is; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm import textnum
from folioscan.llm.shared import text_of

#: Fixed values of the contract: a fifth of the ids is held out; from this score on a document is taken as good.
FOLDS, LEAST_SCORE = 5, 0.3

#: Words of a passage.
WORDS = 64
#: Documents of each label that are learned from at most, and bytes of each.
SAMPLE, SAMPLE_BYTES = 1500, 16_384

PAIRS = 256
WIDTH, GATES = 24, 16
#: Places before a word at which it may stand already.
BACK = (1, 2, 3, 4, 6)
FEATURES = PAIRS + 5 + len(BACK) + 3

_KIND = np.full(256, 3, np.int64)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 0, 1, 2, 4
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def passages(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of all rows, and the n + 1 offsets of rows in them; each row has one at least."""
    data, offsets = textnum.buffers(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts] = inside[starts]
    begin = np.flatnonzero(first)
    del inside, first
    of_row = np.searchsorted(begin, offsets)
    n_words = np.diff(of_row)
    bags = np.concatenate([[0], np.cumsum(np.maximum(-(-n_words // size), 1))])
    number = np.arange(len(begin)) - np.repeat(of_row[:-1], n_words)
    owner = np.repeat(bags[:-1], n_words) + number // size
    out = np.zeros((bags[-1], FEATURES), np.float32)
    if not len(begin):
        return out, bags
    count = np.bincount(owner, minlength=len(out))
    some = np.maximum(count, 1)
    end = np.append(begin[1:], len(data))
    cuts = np.flatnonzero(number % size == 0)
    cuts = cuts[np.concatenate([[True], np.diff(begin[cuts] // textnum.SLICE_BYTES) > 0])]
    n_bytes = np.zeros(len(out))
    for a, b in zip(cuts, [*cuts[1:], len(begin)], strict=True):
        low, n = owner[a], owner[b - 1] - owner[a] + 1
        piece = data[begin[a] : end[b - 1]]
        after = np.append(piece[1:], np.uint8(0x20))
        after[_SPACE[after]] = after[begin[a + 1 : b] - begin[a] - 1] = 0x20  # a word ends with one sign, at the end of a text too
        keep = ~_SPACE[piece]
        mine = np.repeat(owner[a:b] - low, end[a:b] - begin[a:b])[keep]
        pair = (piece[keep].astype(np.int64) * 97 + after[keep].astype(np.int64) * 31) % PAIRS
        rows = slice(low, low + n)
        out[rows, :PAIRS] = np.bincount(mine * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS)
        out[rows, PAIRS : PAIRS + 5] = np.bincount(mine * 5 + _KIND[piece[keep]], minlength=n * 5).reshape(n, 5)
        n_bytes[rows] = np.bincount(mine, minlength=n)
    out[:, : PAIRS + 5] /= np.maximum(n_bytes, 1)[:, None]
    out[:, :PAIRS] = np.sqrt(out[:, :PAIRS])
    words, _ = textnum.word_hashes(column)
    at = PAIRS + 5
    for k in BACK:
        again = (words[k:] == words[:-k]) & (owner[k:] == owner[:-k]) if len(words) > k else np.zeros(0, bool)
        out[:, at] = np.bincount(owner[k:][again], minlength=len(out)) / some
        at += 1
    order = np.sort((owner.astype(np.uint64) << np.uint64(32)) ^ (words >> np.uint64(32)))
    new = np.concatenate([[True], order[1:] != order[:-1]])
    out[:, at] = (count - np.bincount((order[new] >> np.uint64(32)).astype(np.int64), minlength=len(out))) / some
    out[:, at + 1] = np.log1p(n_bytes / some)
    out[:, at + 2] = np.log1p(count)
    return out, bags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Centre and scale of the features, the weights by name, and the score where nothing could be learned."""

    centre: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    share: float | None = None

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        """All that a step needs: encodings, gates, attention and scores."""
        w, starts = self.weights, bags[:-1]
        x = (x - self.centre) / self.scale
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        said = (t * g) @ w["w"]
        bag = np.repeat(np.arange(len(starts)), np.diff(bags))
        a = np.exp(said - np.maximum.reduceat(said, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "bag": bag, "z": z, "score": _sigmoid(z @ w["c"] + w["d"][0])}

    def step(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss."""
        w, f = self.weights, self.forward(x, bags)
        error = (f["score"] - y) * weight
        by = error[f["bag"]]
        toward = f["h"] @ w["c"]
        d_said = by * f["a"] * (toward - (f["z"] @ w["c"])[f["bag"]])
        gate = d_said[:, None] * w["w"]
        d_t, d_g = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
        d_h = (by * f["a"])[:, None] * w["c"] + d_t @ w["V"].T + d_g @ w["U"].T
        d_x = d_h * (1 - f["h"] ** 2)
        return {"E": f["x"].T @ d_x, "e": d_x.sum(axis=0), "V": f["h"].T @ d_t, "U": f["h"].T @ d_g, "w": (f["t"] * f["g"]).T @ d_said, "c": f["z"].T @ error, "d": np.array([error.sum()])}

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text, its number of passages and the one with most weight."""
        x, bags = passages(column)
        if self.share is not None:
            return np.full(len(column), self.share), np.diff(bags), np.zeros(len(column), np.int64)
        f = self.forward(x, bags)
        most = np.lexsort((np.arange(len(f["a"])), -f["a"], f["bag"]))[bags[:-1]]
        return f["score"].astype(np.float64), np.diff(bags), most - bags[:-1]


def fitted(texts: list[str], labels: list[int], share: float | None = None, epochs: int = 12, batch: int = 64, rate: float = 0.003, ridge: float = 1e-4, seed: int = 12) -> Model:
    """A model of labelled texts; share: that of label 1 among all, as the sample may hold another."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1), np.ones(1), {}, float(y.mean()) if len(y) else 0.5)
    x, bags = passages(pa.array(texts, pa.string()))
    rng = np.random.default_rng(seed)
    draw = lambda n, m: rng.normal(size=(n, m)) / np.sqrt(n)
    weights = {"E": draw(FEATURES, WIDTH), "e": np.zeros(WIDTH), "V": draw(WIDTH, GATES), "U": draw(WIDTH, GATES), "w": draw(GATES, 1)[:, 0], "c": draw(WIDTH, 1)[:, 0], "d": np.zeros(1)}
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, {k: v.astype(np.float32) for k, v in weights.items()})
    share = y.mean() if share is None else share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    mean, square = ({n: np.zeros_like(v) for n, v in model.weights.items()} for _ in range(2))
    k = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        slow = rate * (1 - epoch / epochs)
        for i in range(0, len(y), batch):
            some = order[i : i + batch]
            sizes = bags[some + 1] - bags[some]
            cut = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.arange(cut[-1]) - np.repeat(cut[:-1], sizes) + np.repeat(bags[some], sizes)
            k += 1
            for n, g in model.step(x[rows], cut, y[some], weight[some] / len(some)).items():
                w = model.weights[n]
                g = g + ridge * w
                mean[n] = 0.9 * mean[n] + 0.1 * g
                square[n] = 0.999 * square[n] + 0.001 * g * g
                w -= (slow * (mean[n] / (1 - 0.9**k)) / (np.sqrt(square[n] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    return model


def train_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from documents with labels (doc_id, quality) that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    fits = docs.where(F.octet_length(text_of()) <= most_bytes)
    present = known.join(fits.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    n_all, n_good = known.agg(F.count("*"), F.sum("y")).first()
    chosen = [present.where(F.col("y") == y).orderBy("h", "doc_id").limit(sample) for y in (0, 1)]
    few = F.broadcast(chosen[0].union(chosen[1]).select("doc_id", "y", "h"))  # 2 * sample ids at most
    rows = fits.select("doc_id", text_of().alias("text")).join(few, "doc_id").groupBy("doc_id", "y", "h").agg(F.min("text").alias("text"))
    rows = sorted((r["h"], r["doc_id"], r["y"], r["text"]) for r in rows.collect())
    return fitted([r[3] for r in rows], [r[2] for r in rows], n_good / n_all if n_all else None)


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score, n_passages, passage (from 0, the one with most weight) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some ten thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.slices(batch, "_text"):
                columns = [pa.array(c) for c in shared.value.scores(part.column("_text"))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], [*keep, "score", "n_passages", "passage"])

    rows = docs.select(*keep, text_of().alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{fields}, score double, n_passages long, passage long")


def judged(scores: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
