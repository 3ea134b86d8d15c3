"""Search over page text: hits with offsets, snippets, caps and navigation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions.text import haystack
from folioscan.limits import LIMITS
from folioscan.operators import grammar
from folioscan.storage import stored

def pattern(text: str, case_sensitive: bool = False, whole_word: bool = False, regex: bool = False) -> str:
    """The Java pattern of a query; case is folded by Unicode, accents stay distinct.  Raises ValueError for a query that is refused."""
    found = grammar.compiled(text, regex, case_sensitive, whole_word)
    if found.problem:
        raise ValueError(f"{found.problem}: {text[:60]!r} at {found.at}")
    return found.java


_COMPILED = T.StructType([T.StructField("problem", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("java", T.StringType()), T.StructField("needs", T.ArrayType(T.StringType()))])


@F.pandas_udf(_COMPILED)
def _compiled(text: pd.Series, regex: pd.Series, case_sensitive: pd.Series, whole_word: pd.Series) -> pd.DataFrame:
    rows = [grammar.compiled(*row) for row in zip(text, regex, case_sensitive, whole_word, strict=True)]
    return pd.DataFrame({k: pd.Series([getattr(r, k) for r in rows], dtype="Int32" if k == "at" else object) for k in ("problem", "at", "java", "needs")})


def compiled(queries: DataFrame) -> DataFrame:
    """query_id, problem, at, java, needs of queries (query_id, text, regex, case_sensitive, whole_word): the Java pattern, or why there is none and at which character."""
    return queries.select("query_id", _compiled("text", "regex", "case_sensitive", "whole_word").alias("c")).select("query_id", "c.*")


def query_problem(text: Column, regex: Column) -> Column:
    """Why a query is refused, or null: too long, empty, refused construct, does not compile, too large, or nested too deep.

    Patterns that may match the empty text are not refused; their empty matches are no hits.
    """
    return _compiled(text, regex, F.lit(False), F.lit(False))["problem"]


#: Marks around matches: no characters, so what holds them is not text.
_BEGIN, _END = "\uffff", "\ufffe"
#: Bytes of marked text worked on at once.
PIECE = 4 << 20


def matches(pages: DataFrame, text: Column, search: str | Column, keys: tuple[str, ...]) -> DataFrame:
    """keys, hay (the text), at (number of the match from 0), first, match: non-overlapping matches of a pattern but for empty ones.

    Java marks the matches in one pass; where the marks stand is counted for whole
    batches in an Arrow stage, a list of places for each page, so pages stay where they
    are: no shuffle, and the same on a stream.
    """
    wanted = F.lit(search) if isinstance(search, str) else search
    rows = pages.select(*keys, text.alias("hay"), wanted.alias("_search"))
    rows = rows.select(*keys, "hay", _marked("hay", search if isinstance(search, str) else "_search", isinstance(search, str)).alias("_marked"))
    return _listed(rows).select(*keys, "hay", F.explode("h").alias("h")).select(*keys, "hay", "h.at", "h.first", "h.match")


def _marked(hay: str, search: str, literal: bool = True) -> Column:
    """The text with marks around the matches."""
    clean = F.translate(hay, _BEGIN + _END, "\ufffd\ufffd")
    whole = F.lit(f"({search})") if literal else F.concat(F.lit("("), search, F.lit(")"))
    return F.regexp_replace(clean, whole, F.lit(f"{_BEGIN}$1{_END}"))


def _listed(rows: DataFrame) -> DataFrame:
    """The rows with marks, their last column _marked replaced by h, the list of matches (at, first, match)."""
    rows = rows.where(F.contains("_marked", F.lit(_BEGIN)))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("h", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("match", T.StringType())])))])
    return rows.mapInArrow(_located, schema)


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("_marked").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
            to = min(to, len(column))
            places = _places(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            kept = batch.slice(at, to - at)
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], places], [*kept.schema.names[:-1], "h"])
            at = to


def _places(data: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """Of marked texts, UTF-8 one after the other: number, first character and text of the matches of each, without the empty ones."""
    near = np.flatnonzero(data[:-2] == 0xEF)
    near = near[(data[near + 1] == 0xBF) & (data[near + 2] >= 0xBE)]
    begins, ends = near[data[near + 2] == 0xBF], near[data[near + 2] == 0xBE]
    row = np.searchsorted(offsets, begins, side="right") - 1
    chars = np.cumsum((data & 0xC0) != 0x80)
    before = np.concatenate([[0], chars])[offsets[:-1]]  # characters before each text
    number = np.arange(len(begins)) - np.searchsorted(row, row)
    first = chars[begins] - 1 - before[row] - 2 * number  # two marks for each match before
    size = ends - begins - 3
    kept = np.flatnonzero(size)
    row, first, size, begins = row[kept], first[kept], size[kept], begins[kept]
    to = np.cumsum(size)
    total = int(to[-1]) if len(to) else 0
    taken = data[np.repeat(begins + 3 - (to - size), size) + np.arange(total)]
    text = pa.LargeStringArray.from_buffers(len(kept), pa.py_buffer(np.concatenate([[0], to]).astype(np.int64).tobytes()), pa.py_buffer(taken.tobytes())).cast(pa.string())
    numbers = np.arange(len(kept)) - np.searchsorted(row, row)
    items = pa.StructArray.from_arrays([pa.array(numbers.astype(np.int32)), pa.array(first.astype(np.int32)), text], ["at", "first", "match"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(offsets))).astype(np.int32)), items)


def hits(pages: DataFrame, search: str, keys: tuple[str, ...] = ("doc_id", "page"), at: bool = False) -> DataFrame:
    """keys, hay, first, count, match, and at (the number of the hit on its page) if asked for: all non-overlapping matches of a pattern; empty ones are none."""
    found = matches(pages, haystack(F.col("text")), search, keys)
    return found.select(*keys, "hay", *(["at"] if at else []), "first", F.length("match").alias("count"), "match")


def snippets(found: DataFrame) -> DataFrame:
    """Adds snippet, match_start and match_len (bytes inside the snippet); the context after the match gives way to the byte bound."""
    c = LIMITS.snippet_context
    before = F.substring("hay", F.greatest(F.col("first") - c, F.lit(0)) + 1, F.least(F.col("first"), F.lit(c)))
    match = F.substring("hay", F.col("first") + 1, F.least(F.col("count"), F.lit(LIMITS.snippet_match)))
    after = F.substring("hay", F.col("first") + F.least(F.col("count"), F.lit(LIMITS.snippet_match)) + 1, F.lit(c))
    out = found.withColumns({"_b": before, "_m": match, "_a": after})
    room = LIMITS.snippet_bytes - F.octet_length("_b") - F.octet_length("_m")
    fits = F.filter(F.sequence(F.lit(0), F.length("_a")), lambda k: F.octet_length(F.substring(F.col("_a"), F.lit(1), k)) <= room)
    shorter = F.substring(F.col("_a"), F.lit(1), F.coalesce(F.array_max(fits), F.lit(0)))
    out = out.withColumn("_a", F.when(F.octet_length("_a") <= room, F.col("_a")).otherwise(shorter))
    return out.withColumns({"snippet": F.concat("_b", "_m", "_a"), "match_start": F.octet_length("_b"), "match_len": F.octet_length("_m")}).drop("_b", "_m", "_a")


def capped(found: DataFrame, limit: int = LIMITS.hits, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The first hits of each document search, in page and offset order, numbered by rn."""
    order = W.partitionBy(*by).orderBy("page", "first")
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit)


def search_outcomes(found: DataFrame, pages: DataFrame, limit: int = LIMITS.hits) -> DataFrame:
    """doc_id, hits, pages_done, outcome; reaching the limit counts as too many."""
    per = capped(found, limit).groupBy("doc_id").agg(F.count("*").alias("hits"), F.max("page").alias("last"))
    total = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    out = total.join(per, "doc_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    full = F.col("hits") >= limit
    return out.select("doc_id", "hits", F.when(full, F.col("last").cast("long") + 1).otherwise(F.col("pages")).alias("pages_done"), F.when(full, "TooManyHits").otherwise("Finished").alias("outcome"))


def hits_per_page(numbered: DataFrame) -> DataFrame:
    """doc_id, page, first_hit, end_hit, hits: contiguous ranges of hit numbers, from 0."""
    return numbered.groupBy("doc_id", "page").agg((F.min("rn") - 1).alias("first_hit"), F.max("rn").alias("end_hit"), F.count("*").alias("hits"))


def navigation(numbered: DataFrame, start_page: Column) -> DataFrame:
    """doc_id, rn, next_rn, prev_rn (both wrap round) and current: the first hit on or after the start page, else the first."""
    w = W.partitionBy("doc_id").orderBy("rn")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    current = F.coalesce(F.min(F.when(F.col("page") >= start_page, F.col("rn"))).over(whole), F.first("rn").over(whole))
    return numbered.select("doc_id", "rn", F.coalesce(F.lead("rn").over(w), F.first("rn").over(whole)).alias("next_rn"), F.coalesce(F.lag("rn").over(w), F.last("rn").over(whole)).alias("prev_rn"), (F.col("rn") == current).alias("current"))


#: Anchors up to which a text is looked through in its row, and bytes of all their queries.
FEW, FEW_BYTES = 2_000, 4_000_000


def containing(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id of the texts that contain a query's text literally.

    A word that both hold whole anchors the join; the longest inner word of the
    query is taken, so only texts with that word are compared.  Up to FEW anchors
    are looked for in the row of the text, which then stays where it is; more are
    joined.  Queries without an inner word are anchored by three characters in a
    row, or by all of fewer.
    """
    inner = lambda c: F.filter(F.split(c, "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    q = queries.select("query_id", F.col("text").alias("needle"))
    whole = F.filter(F.slice(inner("needle"), 2, F.greatest(F.size(inner("needle")) - 2, F.lit(0))), lambda w: w != "")
    anchor = F.element_at(F.array_sort(F.transform(whole, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), 1)["w"]
    weak = q.where(F.col("needle").isNotNull() & (F.size(whole) <= 0))
    q = q.where(F.size(whole) > 0).withColumn("anchor", anchor)
    n_anchors, n_bytes = q.agg(F.count_distinct("anchor"), F.coalesce(F.sum(F.octet_length("needle")), F.lit(0))).first()
    if n_anchors <= FEW and n_bytes <= FEW_BYTES:
        anchors = F.array(*(F.lit(r[0]) for r in q.select("anchor").distinct().orderBy("anchor").collect())).cast("array<string>")
        near = texts.select("doc_id", "text", F.explode(F.array_intersect(inner("text"), anchors)).alias("anchor"))
        found = near.join(F.broadcast(q), "anchor").where(F.contains("text", F.col("needle"))).select("query_id", "doc_id")
    else:
        found = texts.select("doc_id", F.explode(F.array_distinct(inner("text"))).alias("anchor")).join(q, "anchor").select("doc_id", "query_id", "needle")
        found = found.join(texts.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("needle"))).select("query_id", "doc_id")
    sizes = [r[0] for r in weak.select(F.least(F.length("needle"), F.lit(3))).distinct().collect()]  # at most 0 to 3
    chars = texts.select("doc_id", F.split("text", "").alias("c")) if sizes else None
    for n in sizes:
        some = weak.where(F.least(F.length("needle"), F.lit(3)) == n)
        if n == 0:
            found = found.union(some.select("query_id").crossJoin(texts.where("text is not null").select("doc_id")))
            continue
        grams = F.transform(F.sequence(F.lit(1), F.size("c") - n + 1), lambda i: F.concat(*(F.element_at("c", i + k) for k in range(n))))  # noqa: B023
        held = chars.where(F.size("c") >= n).select("doc_id", F.explode(F.array_distinct(grams)).alias("anchor"))
        near = held.join(some.withColumn("anchor", F.substring("needle", 1, n)), "anchor").select("doc_id", "query_id", "needle")
        found = found.union(near.join(texts.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("needle"))).select("query_id", "doc_id"))
    return found.distinct()


#: Bytes of patterns and of the texts they need that are looked for in one pass; more queries take more passes.
MANY_BYTES = 16 << 20
#: Patterns written into one expression each, so that Java compiles them once; more take more passes.
MANY_PATTERNS = 400


def many_hits(pages: DataFrame, queries: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """query_id, keys, first, count, match of all hits of many queries: hits() of each of them.

    queries: query_id, text, regex, case_sensitive, whole_word, as in compiled(); those
    refused have no hits.  An Aho-Corasick automaton over the texts that the patterns
    need goes once through each page; the patterns it names are then matched there by
    Java.  A pattern that needs no text, such as [0-9]{3}, is matched on every page.
    Patterns that Python reads alike (grammar.alike) go through many pages at once instead.
    Pages stay where they are, and equal patterns are searched once.  Patterns of more than
    MANY_BYTES, or more than MANY_PATTERNS, are dealt over passes.
    """
    spark = pages.sparkSession
    asked = stored(compiled(queries).where("problem is null").select("query_id", "java", "needs"), "search-many")
    searched = stored(asked.groupBy("java").agg(F.first("needs").alias("needs")), "search-patterns")
    size = F.octet_length("java") + F.coalesce(F.aggregate("needs", F.lit(0), lambda n, w: n + F.octet_length(w)), F.lit(0))
    n_bytes, n_patterns = searched.agg(F.coalesce(F.sum(size.cast("long")), F.lit(1)), F.count("*")).first()
    slices = max(1, -(-n_bytes // MANY_BYTES), -(-n_patterns // MANY_PATTERNS))
    hay = pages.select(*keys, haystack(F.col("text")).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hay.schema.fields)
    found = None
    for k in range(slices):
        rows = searched.where(F.pmod(F.xxhash64("java"), F.lit(slices)) == k).orderBy("java").collect()  # about MANY_PATTERNS, and MANY_BYTES, of a slice
        if not rows:
            continue
        table = spark.createDataFrame([(i, r["java"]) for i, r in enumerate(rows)], "_n int, java string")
        table = table.join(asked.select("query_id", "java").distinct(), "java").select("_n", "query_id")
        plain = [(i, *alike, r["needs"]) for i, r in enumerate(rows) if r["needs"] and (alike := grammar.alike(r["java"]))]
        if plain:
            scanned = hay.mapInArrow(_scanned(spark.sparkContext.broadcast(plain), keys), _scanned_schema(hay, keys)).join(F.broadcast(table), "_n")
            scanned = scanned.select("query_id", *keys, "first", "count", "match")
            found = scanned if found is None else found.union(scanned)
        known = {i for i, *_ in plain}
        rows = [(i, r) for i, r in enumerate(rows) if i not in known]
        if not rows:
            continue
        held = spark.sparkContext.broadcast([(i, r["needs"]) for i, r in rows])
        near = hay.mapInArrow(_named(held, keys), f"{fields}, _n array<int>").select(*keys, "text", F.explode("_n").alias("_n"))
        marked = F.lit(None).cast("string")
        cases = [(F.col("_n") == i, _marked("text", r["java"])) for i, r in rows]
        for k, (case, value) in enumerate(cases):
            marked = F.when(case, value) if k == 0 else marked.when(case, value)
        part = _listed(near.select(*keys, "_n", marked.alias("_marked"))).join(F.broadcast(table), "_n")
        part = part.select("query_id", *keys, F.explode("h").alias("h")).select("query_id", *keys, "h.first", F.length("h.match").alias("count"), "h.match")
        found = part if found is None else found.union(part)
    if found is None:
        return matches(hay.limit(0).crossJoin(asked.select("query_id").limit(0)), F.col("text"), "x", (*keys, "query_id")).select("query_id", *keys, "first", F.length("match").alias("count"), "match")
    return found


def _clean(text: str) -> str:
    """The text as patterns see it in _marked()."""
    return text.replace(_BEGIN, "\ufffd").replace(_END, "\ufffd")


def _named(held, keys: tuple[str, ...]):
    """Adds to each page the numbers of the patterns of which it holds a needed text, or which need none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        always, owners = [], {}
        for i, needs in held.value:
            for need in needs or ():
                owners.setdefault(need, []).append(i)
            if not needs:
                always.append(i)
        automaton = ahocorasick.Automaton()
        for need, numbers in owners.items():
            automaton.add_word(need, tuple(numbers))
        automaton.make_automaton()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                names = set(always) if text is not None else set()
                if owners and text:
                    for _, numbers in automaton.iter(grammar.folded(_clean(text))):
                        names.update(numbers)
                out.append(sorted(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "_n"])

    return run


def _scanned_schema(hay: DataFrame, keys: tuple[str, ...]) -> T.StructType:
    found = [T.StructField("_n", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("count", T.IntegerType()), T.StructField("match", T.StringType())]
    return T.StructType([*(hay.schema[k] for k in keys), *found])


#: Bytes of pages that patterns go through together, matches that leave a task at once, and the length from which a text tells whether a pattern is tried.
JOINED, LEAVING, TELLING = 1 << 20, 1 << 16, 4


def _scanned(held, keys: tuple[str, ...]):
    """keys, _n, first, count, match: each pattern goes through many pages at once, joined by line feeds, which no page and no match holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        patterns, always, owners = {}, [], {}
        for n, fold, python, needs in held.value:
            patterns[n] = fold, re.compile(python)
            if min(map(len, needs)) < TELLING:
                always.append(n)
                continue
            for need in needs:
                owners.setdefault(need, []).append(n)
        automaton = ahocorasick.Automaton()
        for need, numbers in owners.items():
            automaton.add_word(need, tuple(numbers))
        automaton.make_automaton()
        for batch in batches:
            owned = batch.select(list(keys))
            names = [*keys, "_n", "first", "count", "match"]
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + JOINED, side="right")))
                pages = [t or "" for t in batch.column("text").slice(at, to - at).to_pylist()]
                text = _clean("\n".join(pages))
                starts = np.cumsum([0, *(len(p) + 1 for p in pages[:-1])])
                small = grammar.folded(text)
                tried = set(always)
                if owners:
                    for _, numbers in automaton.iter(small):
                        tried.update(numbers)
                part, size = [], 0
                for n in sorted(tried):
                    fold, pattern = patterns[n]
                    spans = [m.span() for m in pattern.finditer(small if fold else text)]
                    if spans:
                        part.append((n, spans))
                        size += len(spans)
                    if size >= LEAVING:
                        yield pa.RecordBatch.from_arrays(_rows(owned, part, text, starts, at), names)
                        part, size = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays(_rows(owned, part, text, starts, at), names)
                at = to

    return run


def _rows(owned: pa.RecordBatch, part: list[tuple[int, list[tuple[int, int]]]], text: str, starts: np.ndarray, at: int) -> list[pa.Array]:
    """Columns of the matches (n, places in the text) in pages that start at ``starts``, the first of which is number ``at``."""
    spans = np.array([s for _, found in part for s in found], np.int64)
    page = np.searchsorted(starts, spans[:, 0], side="right") - 1
    numbers = np.repeat([n for n, _ in part], [len(found) for _, found in part]).astype(np.int32)
    first, count = (spans[:, 0] - starts[page]).astype(np.int32), (spans[:, 1] - spans[:, 0]).astype(np.int32)
    match = pa.array([text[i:j] for _, found in part for i, j in found], pa.string())
    return [*owned.take(pa.array(page + at)).columns, pa.array(numbers), pa.array(first), pa.array(count), match]
