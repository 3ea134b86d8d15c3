"""Token counts through a digest cache.

The cache is a Parquet table of (digest, version, n_tokens) in a folder of the
caller's choice.  A text's digest is the SHA-256 of its normalised content
(the text itself, empty where it is null: any other change could change the
count); the version is the SHA-256 of the tokenizer's file.  A call joins the
texts' digests to the cache, encodes each distinct digest it lacks once, and
appends those counts.

Counting splits a text before each single blank that stands between two characters
that are no white space, and looks the pieces up in a bounded dictionary; only pieces
not seen before go to the tokenizer, which never joins text across such a blank.
Longer white space stays inside a piece.  Texts with a special string are encoded whole.

Defined cases: null and empty texts have 0 bytes and 0 tokens; copies are
encoded once; special strings inside texts count as the tokenizer counts them
by default; repeated rows give repeated results; an empty table gives no rows
and appends nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.shared import fresh_path, stored, text_of

LIMIT = 512
TOKENIZER = "byte_bpe_50k.json"
#: Pieces that a Python worker remembers; then it forgets all and starts anew.
REMEMBERED = 400_000

#: Texts cut at once.
TEXTS = 256

SCHEMA = "digest binary, version string, n_tokens long"
#: A blank beside other white space, or at an end; and the places where a text may be cut then.
_BESIDE = re.compile(r"\s | \s|\A | \Z")
_CUT = re.compile(r"(?<=\S)(?= \S)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def version_of(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


class Counter:
    """Counts tokens with a tokenizers file, remembering pieces."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._remembered = remembered
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._known: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        cut: list[list[str] | None] = []
        for text in texts:
            if "\0" in text or any(s in text for s in self._special):
                cut.append(None)
            else:
                cut.append(_CUT.split(text) if _BESIDE.search(text) else text.replace(" ", "\0 ").split("\0"))
        self._learn(set().union(*(p for p in cut if p is not None)))
        known = self._known
        for text, pieces in zip(texts, cut, strict=True):
            if pieces is None:
                out += self._encode([text])
                continue
            out.append(sum(map(known.__getitem__, pieces)))
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Counts for pieces not seen before; words that begin with a blank are encoded in long lines and told apart by offsets."""
        new = [p for p in pieces if p not in self._known]
        if len(self._known) + len(new) > self._remembered:
            self._known.clear()
            new = list(pieces)
        words = [p for p in new if len(p) > 1 and p[0] == " " and not p[-1].isspace()]
        rest = [p for p in new if not (len(p) > 1 and p[0] == " " and not p[-1].isspace())]
        self._known.update(zip(rest, self._encode(rest), strict=True))
        lines = [words[i : i + 500] for i in range(0, len(words), 500)]
        for line, found in zip(lines, self._tokenizer.encode_batch(["".join(x) for x in lines], add_special_tokens=False), strict=True):
            ends = np.cumsum([len(p) for p in line])
            at = np.searchsorted(ends, np.array([a for a, _ in found.offsets]), side="right")
            self._known.update(zip(line, np.bincount(at, minlength=len(line)).tolist(), strict=True))


def _encoded(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [n for i in range(0, len(texts), TEXTS) for n in counter.counts(texts[i : i + TEXTS])]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * batch.num_rows, pa.string()), pa.array(counts, pa.int64())], ["digest", "version", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(cache)


def counted(docs: DataFrame, cache: str | None = None, tokenizer: str | None = None, limit: int = LIMIT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_bytes, n_tokens, over_limit.  cache: folder of the stored counts; a new one in the shared folder if None."""
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    version = version_of(path)
    cache = cache or fresh_path(spark, "token-cache")
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(cache)
    held = read_cache(spark, cache).where(F.col("version") == version).select("digest", "n_tokens")
    texts = docs.select(text_of().alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.sha2(F.col("text"), 256))).dropDuplicates(["digest"])  # copies meet before the shuffle
    misses = texts.join(held.select("digest"), "digest", "left_anti")
    misses.mapInArrow(_encoded(path, version), SCHEMA).write.mode("append").parquet(cache)
    rows = docs.select(*keep, text_of().alias("_t"))
    rows = rows.select(*keep, F.octet_length("_t").cast("long").alias("n_bytes"), F.unhex(F.sha2(F.col("_t"), 256)).alias("digest"))
    held = read_cache(spark, cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    known = stored(held, "token-counts")  # a plain side of the join, so that Spark can split a hot digest of the other
    return rows.join(known, "digest", "left").select(*keep, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
