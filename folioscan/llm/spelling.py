"""Spelling variants: words that differ by one letter, grouped under their most frequent form, through a bit-sliced position index.

A word of length L is cut after half = L // 2 letters.  Of two words one letter
apart, one has the other's first half, or its last L - half letters, at the same
end; so each word stands in the index under two keys, and asks under two keys for
each of the three lengths its near words can have.  Words and questions meet by
key; keys are put together into groups of one length and about GROUP words.  In
a group, a bitset per (position, letter) tells which of its words have that
letter there.  All questions of one length run through these bitsets at once,
letter by letter: ``exact`` holds the words without an error so far, ``one``
those with one, which stand at the same, the next or the last position when a
letter was replaced, is missing or is too many.  A pair with equal first halves
counts under the first key only, so each pair is found once.

A key of more than GROUP words is dealt over a grid of words and questions; all
questions meet all its words, in blocks.  What leaves a group is one row for each
question: the number of near words and the best of them.

Defined cases: null texts have no words, a null doc_id counts as an empty one when
typing errors are planted; repeated rows count each; words of any length are
compared whole; an empty table gives no words; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.shared import lower_ascii, stored, text_of

#: Fixed values of the contract: least length and number of occurrences of a word, every how many-th occurrence is misspelt, and how much more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, PLANTED, TIMES = 5, 3, 97, 2

#: Words of a group, and questions that meet them in one block of a hot key.
GROUP = 1024
ASKED = 16_384
#: Questions worked on at once.
CHUNK = 4096

FOUND = "word string, n_near long, best_n long, best string"


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, planted: int | None = PLANTED) -> DataFrame:
    """word, n: runs of letters of least_length or more and how often they occur, least_count times at least.

    planted: of each occurrence whose crc32 of ``doc_id:word`` it divides, a letter is left out.
    """
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if planted else F.lit("")
    runs = F.regexp_extract_all(text_of(), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_length},}}"), 0)
    words = docs.select(doc.alias("_d"), F.explode(runs).alias("word")).select("_d", lower_ascii(F.col("word")).alias("word"))
    if planted:
        crc = F.crc32(F.concat("_d", F.lit(":"), "word").cast("binary"))
        words = words.select("word", crc.alias("_h"))
        at = (F.col("_h") % F.length("word")).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        words = words.select(F.when(F.col("_h") % planted == 0, cut).otherwise(F.col("word")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def _keys(length: Column) -> list[Column]:
    """The two keys under which a word meets words of a length: that of the first half, that of the rest; structs of kind and key."""
    half = (length / 2).cast("int")
    pieces = (F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), F.length("word") - length + half + 1, length))
    return [F.struct(F.lit(bool(k)).alias("tail"), F.xxhash64(F.lit(k), length, piece).alias("key")) for k, piece in enumerate(pieces)]


def _near_in_group(table: pa.Table) -> pa.Table:
    """Of each question of a group: how many near words, and the most frequent of them."""
    asks = np.asarray(table["asks"])
    empty = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})
    held, asked = table.filter(~asks), table.filter(asks)
    if not held.num_rows or not asked.num_rows:
        return empty
    held = held.sort_by([("n", "descending"), ("word", "ascending")])  # so the first bit of a set is its best word
    words, n_of = held["word"].to_pylist(), held["n"].to_numpy()
    length, n = len(words[0]), len(words)
    letters = _letters(words, length)
    alphabet = np.unique(letters)
    code = np.searchsorted(alphabet, letters)
    # the bitsets: row 0 is empty, then one for each position and letter that occurs there
    place = code + np.arange(length) * len(alphabet)
    used, row = np.unique(place, return_inverse=True)
    width = -(-n // 64)
    bits = np.zeros((len(used) + 1, width * 64), bool)
    bits[row.reshape(n, length) + 1, np.arange(n)[:, None]] = True
    packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    del bits
    rows = np.zeros((length, len(alphabet) + 1), np.int64)  # the last column is for letters that no word has
    rows[used // len(alphabet), used % len(alphabet)] = np.arange(1, len(used) + 1)
    pad = np.zeros(width * 64, bool)
    tails = held["tail"].to_numpy()
    kinds = []
    for tail in (False, True):
        pad[:n] = tails == tail
        kinds.append(np.packbits(pad, bitorder="little").view(np.uint64))
    kinds = np.array(kinds)
    said = asked["word"].to_pylist()
    sizes = np.array([len(w) for w in said])
    tail_of = asked["tail"].to_numpy().astype(np.int64)
    out_word, out_n, out_best = [], [], []
    for m in np.unique(sizes):
        mine = np.flatnonzero(sizes == m)
        for i in range(0, len(mine), CHUNK):
            some = mine[i : i + CHUNK]
            letters = _letters([said[k] for k in some], int(m))
            at = np.minimum(np.searchsorted(alphabet, letters), len(alphabet) - 1)
            code = np.where(alphabet[at] == letters, at, len(alphabet))
            near, first_half = _one_error(packed, rows, code, length)
            tail = tail_of[some]
            near &= np.where(tail[:, None] == 1, ~first_half, first_half) & kinds[tail]
            count = np.bitwise_count(near).sum(axis=1)
            hit = np.flatnonzero(count)
            if len(hit):
                best = np.unpackbits(near[hit].view(np.uint8), axis=1, bitorder="little").argmax(axis=1)
                out_word.append(some[hit])
                out_n.append(count[hit])
                out_best.append(best)
    if not out_word:
        return empty
    best = np.concatenate(out_best)
    return pa.table({"word": asked["word"].combine_chunks().take(pa.array(np.concatenate(out_word))), "n_near": pa.array(np.concatenate(out_n).astype(np.int64)), "best_n": pa.array(n_of[best]), "best": held["word"].combine_chunks().take(pa.array(best))})


def _letters(words: list[str], length: int) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _one_error(packed: np.ndarray, rows: np.ndarray, code: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For questions of one length (a row of letter codes each), the words of ``length`` letters one error away, and those with the same first half."""
    m, half = code.shape[1], length // 2
    exact = np.full((len(code), packed.shape[1]), ~np.uint64(0))
    one = np.zeros_like(exact)
    first_half = exact.copy()
    for i in range(m):
        same = packed[rows[i, code[:, i]]] if i < length else np.zeros_like(one)
        if m == length:  # a letter was replaced
            one &= same
            one |= exact & ~same
        elif m > length:  # the question has a letter too many
            if i:
                one &= packed[rows[i - 1, code[:, i]]]
            one |= exact
        else:  # the question lacks a letter
            one |= exact
            one &= packed[rows[i + 1, code[:, i]]]
        exact &= same
        if i + 1 == half:
            first_half = exact.copy()
    if m < length:
        one |= exact
    return one, first_half


def near_words(vocab: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n_near, best_n, best in parts: a row for each key under which a word has near words; counts are to be summed."""
    length = F.length("word")
    index = vocab.select("word", "n", length.alias("length"), F.explode(F.array(*_keys(length))).alias("k")).select("word", "n", "length", "k.tail", "k.key")
    counts = index.groupBy("length", "key").agg(F.count("*").alias("c"))
    counts = stored(counts, "spelling-keys")
    lengths = stored(counts.groupBy("length").agg(F.sum("c").alias("total")), "spelling-lengths")  # a row for each length
    hot = F.col("c") > group
    shelf = F.when(hot, F.col("key")).otherwise(F.pmod("key", F.ceil(F.col("total") / group)))
    counts = counts.join(lengths, "length").select("key", "length", hot.alias("hot"), shelf.alias("shelf"), F.ceil(F.col("c") / group).alias("parts"), F.ceil(F.col("c") / ASKED).alias("asked"))
    counts = stored(counts, "spelling-shelves")
    asks = F.array(*(F.struct((length + d).alias("length"), k.alias("k")) for d in (-1, 0, 1) for k in _keys(length + d)))
    asks = vocab.select("word", F.explode(asks).alias("a")).select("word", F.col("a.length").alias("length"), "a.k.tail", "a.k.key")
    deal = lambda n: F.pmod(F.xxhash64("word"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    columns = ("length", "hot", "shelf", "_p", "_q", "asks", "tail", "word", "n")
    index = index.join(counts, ["length", "key"]).withColumn("_p", deal(F.col("parts"))).withColumn("_q", every(F.col("asked"))).withColumn("asks", F.lit(False))
    asks = asks.join(counts, ["length", "key"]).withColumn("_q", deal(F.col("asked"))).withColumn("_p", every(F.col("parts"))).withColumn("asks", F.lit(True)).withColumn("n", F.lit(0).cast("long"))
    return index.select(*columns).union(asks.select(*columns)).groupBy("length", "hot", "shelf", "_p", "_q").applyInArrow(_near_in_group, FOUND)


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of forms (word, form), which never comes back; pointers double each round."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_root"))
        step = now.join(ahead, "root", "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved"))
        step = stored(step, "spelling-roots")
        now = step.drop("_moved")
        if step.where("_moved").isEmpty():
            return now


def grouped(vocab: DataFrame, times: int = TIMES, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of words and their counts (word, n).

    n_near: how many words are one letter away.  form: the most frequent of them, if
    at least ``times`` as frequent as the word (ties: the first in code-point order).
    """
    vocab = stored(vocab.select("word", "n"), "spelling-words")
    found = near_words(vocab, group).select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")).alias("best"))
    none = F.lit(None).cast("struct<m:bigint,w:string>")
    rows = vocab.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.alias("best")).union(found)
    rows = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.m") >= times * F.col("n")
    rows = stored(rows.select("word", "n", "n_near", F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")), "spelling-forms")
    roots = roots_of(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql() -> str:
    """DuckDB SQL for op11_spelling_variants: crc32 from its table, and words that share what is left when a letter is taken out."""
    return """
WITH RECURSIVE
step AS (SELECT 0 AS k, list_transform(range(256), lambda i: i::BIGINT) AS t UNION ALL SELECT k + 1, list_transform(t, lambda v: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) FROM step WHERE k < 8),
crc AS (SELECT t AS tab FROM step WHERE k = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{5,}')) AS w FROM documents),
lower AS (SELECT d, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c FROM runs GROUP BY ALL),
bytes AS (SELECT w, c, hex(encode(d || ':' || w)) AS x FROM lower),
hashed AS (SELECT w, c, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda h, b: xor(h >> 8, tab[xor(h & 255, b) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
kept AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM hashed),
vocab AS (SELECT word, sum(c)::BIGINT AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS hole FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (
  SELECT a.word, b.word AS near, b.n AS m FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN vocab b ON a.hole = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN vocab b ON a.hole = b.word),
best AS (SELECT word, count(*) AS n_near, min({'m': -m, 'w': near}) AS best FROM near GROUP BY word),
forms AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.w END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM vocab v LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT forms.word, form, coalesce(root, forms.word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
"""
