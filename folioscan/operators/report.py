"""Reports: bounded lists, histograms, verdicts, totals, gates and comparisons."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions.text import comparable, truncated
from folioscan.limits import LIMITS
from folioscan.operators.distance import LEAST, edit_distance, groups, together, trimmed
from folioscan.storage import ranged


def bounded_list(rows: DataFrame, by: str, order: list[str], value: str, most: int = LIMITS.list_items, chars: int = LIMITS.item_chars) -> DataFrame:
    """by, items (the first ``most`` in order, each cut), total, truncated; rows beyond the bound are dropped before they are collected."""
    total = rows.groupBy(by).agg(F.count("*").alias("total"))
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_r") <= most)
    items = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_r", truncated(F.col(value), chars).alias("v")))).alias("_i"))
    return total.join(items, by).select(by, F.col("_i.v").alias("items"), "total", (F.col("total") > most).alias("truncated"))


def with_overflow(rows: DataFrame, by: str, order: list[str], value: str, most: int) -> DataFrame:
    """by, ord, message: the first ``most`` messages, and one that tells how many are left out."""
    first = rows.withColumn("ord", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("ord") <= most).select(by, "ord", F.col(value).alias("message"))
    over = rows.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    return first.union(over.select(by, F.lit(most + 1).alias("ord"), F.concat((F.col("_n") - most).cast("string"), F.lit(" more are not listed")).alias("message")))


def page_sizes(pages: DataFrame, most: int = LIMITS.page_sizes) -> DataFrame:
    """doc_id, width, height, pages, rank, truncated of (doc_id, page, width, height): the sizes met first, most frequent first."""
    g = pages.groupBy("doc_id", "width", "height").agg(F.count("*").alias("pages"), F.min("page").alias("_first"))
    met = W.partitionBy("doc_id").orderBy("_first", "width", "height")
    g = g.withColumns({"_r": F.row_number().over(met), "_n": F.count("*").over(W.partitionBy("doc_id"))}).where(F.col("_r") <= most)
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("pages"), "width", "height"))
    return g.select("doc_id", "width", "height", "pages", rank.alias("rank"), (F.col("_n") > most).alias("truncated"))


#: Flags that make a document risky, with titles; fixed values.
RISKS = {
    "open_action_javascript": "Runs a script when the file is opened",
    "javascript_actions": "Contains JavaScript actions",
    "names_javascript": "Has document-level scripts",
    "additional_actions": "Reacts to events (open, close, print, focus)",
    "launch_actions": "Can start a program or open a file",
    "submit_form_actions": "Sends form data to an address",
    "goto_remote_actions": "Opens other PDF files",
    "embedded_files": "Has embedded files",
    "xfa": "Has an XFA form",
}
#: Flags that are only noted, with titles; fixed values.
NOTES = {
    "uri_actions": "Links to addresses",
    "acroform": "Has an interactive form",
    "optional_content": "Has layers",
    "signature_fields": "Has signature fields (not verified)",
}
#: All flags of a document's features, in the order of a report; fixed values.
FEATURES = (
    "complete", "open_action_javascript", "javascript_actions", "names_javascript", "additional_actions", "launch_actions", "uri_actions",
    "submit_form_actions", "goto_remote_actions", "embedded_files", "acroform", "xfa", "optional_content", "signature_fields",
)


def features(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id and FEATURES of documents (doc_id, locked) from what was met in them: facts (doc_id, place, what, open).

    place is action, catalog, names, form, annotation or scan; a locked document's flags are null.
    """
    met = lambda place, *what: F.coalesce(F.bool_or((F.col("place") == place) & F.col("what").isin(*what)), F.lit(False))
    opened = F.coalesce(F.bool_or((F.col("place") == "action") & (F.col("what") == "JavaScript") & F.col("open")), F.lit(False))
    flags = {
        "complete": ~met("scan", "exhausted", "unreadable"), "open_action_javascript": opened, "javascript_actions": met("action", "JavaScript"), "names_javascript": met("names", "JavaScript"),
        "additional_actions": met("catalog", "AA") | met("annotation", "AA") | met("form", "AA"), "launch_actions": met("action", "Launch"), "uri_actions": met("action", "URI"), "submit_form_actions": met("action", "SubmitForm"),
        "goto_remote_actions": met("action", "GoToR"), "embedded_files": met("names", "EmbeddedFiles") | met("annotation", "FileAttachment"), "acroform": met("catalog", "AcroForm"), "xfa": met("form", "XFA"),
        "optional_content": met("catalog", "OCProperties"), "signature_fields": met("form", "Sig") | met("annotation", "Sig"),
    }
    found = facts.groupBy("doc_id").agg(*(flags[f].alias(f) for f in FEATURES))
    rows = documents.select("doc_id", "locked").join(found.hint("merge"), "doc_id", "left")  # a row for each document, of which stored facts tell too little
    return rows.select("doc_id", "locked", *(F.when(~F.col("locked"), F.coalesce(F.col(f), F.lit(f == "complete"))).alias(f) for f in FEATURES))


def document_reports(documents: DataFrame, flags: DataFrame, pages: DataFrame, sizes: DataFrame, revisions: DataFrame, uris: DataFrame, files: DataFrame, problems: DataFrame, repairs: DataFrame) -> DataFrame:
    """One row for each document; what a locked one cannot tell is null, not 0.

    documents: doc_id, locked, file_size, version, objects, tagged, linearized, title.
    flags: of ``features``.  pages: doc_id, page.  sizes: of ``page_sizes``.  revisions: doc_id, rev, start, end.
    uris, files (attached in a row): of ``bounded_list``.  problems, repairs: doc_id, ord, message or code.
    """
    ordered = lambda rows, by, value, name, most: rows.withColumn("_r", F.row_number().over(W.partitionBy("doc_id").orderBy(by))).where(F.col("_r") <= most).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_r"), value.alias("v")))), lambda x: x["v"]).alias(name))
    size = F.concat_ws("x", F.col("width"), F.col("height"), F.col("pages"))
    revised = revisions.groupBy("doc_id").agg(F.count("*").alias("revisions"))
    parts = [
        flags.drop("locked"), pages.groupBy("doc_id").agg(F.count("*").alias("pages")), ordered(sizes, "rank", size, "page_sizes", LIMITS.page_sizes), sizes.groupBy("doc_id").agg(F.bool_or("truncated").alias("page_sizes_truncated")), revised,
        ordered(revisions, "rev", F.concat_ws("-", F.col("start"), F.col("end")), "revision_ranges", LIMITS.revision_ranges), uris.select("doc_id", F.struct("items", "total", "truncated").alias("uris")), files.select("doc_id", F.struct("items", "total", "truncated").alias("files")),
        ordered(problems, "ord", F.col("message"), "problems", LIMITS.problems), ordered(repairs, "ord", F.col("code"), "repair_reasons", LIMITS.list_items),
    ]
    rows = reduce(lambda left, right: left.join(right, "doc_id", "left"), parts, documents)
    none = F.expr("cast(array() as array<string>)")
    empty = F.struct(none.alias("items"), F.lit(0).cast("long").alias("total"), F.lit(False).alias("truncated"))
    told = lambda c, missing, name: F.when(~F.col("locked"), F.coalesce(F.col(c), missing)).alias(name)
    zero, no = F.lit(0).cast("long"), F.lit(False)
    return rows.select(
        "doc_id", "file_size", "version", "objects", F.coalesce("revisions", zero).alias("revisions"), (F.size(F.coalesce("repair_reasons", none)) > 0).alias("repaired"), F.coalesce("repair_reasons", none).alias("repair_reasons"), "locked",
        told("pages", zero, "pages"), *FEATURES, F.coalesce("problems", none).alias("problems"), F.when(~F.col("locked"), F.col("title")).alias("title"), F.when(~F.col("locked"), F.col("tagged")).alias("tagged"), "linearized",
        told("page_sizes", none, "page_sizes"), F.coalesce("page_sizes_truncated", no).alias("page_sizes_truncated"), F.coalesce("revision_ranges", none).alias("revision_ranges"), told("uris", empty, "uris"), told("files", empty, "attached"),
    )


def verdicts(summaries: DataFrame) -> DataFrame:
    """doc_id, findings, notes, code: 3 for a risk, 1 for an unfinished or locked report without one, else 0."""
    held = lambda names: F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in names)))
    rows = summaries.select("doc_id", held(RISKS).alias("findings"), held(NOTES).alias("notes"), "locked", "complete")
    code = F.when(F.size("findings") > 0, 3).when(F.col("locked") | ~F.coalesce("complete", F.lit(False)), 1).otherwise(0)
    return rows.select("doc_id", F.array_join("findings", ",").alias("findings"), F.array_join("notes", ",").alias("notes"), code.alias("code"))


def verdict_lines(summaries: DataFrame) -> DataFrame:
    """doc_id, risky, id, title: each finding and note of a document as a line to print."""
    line = lambda risky, flag, title: F.when(F.col(flag), F.struct(F.lit(risky).alias("risky"), F.lit(flag).alias("id"), F.lit(title).alias("title")))
    lines = [line(risky, flag, title) for risky, rules in ((True, RISKS), (False, NOTES)) for flag, title in rules.items()]
    return summaries.select("doc_id", F.explode(F.array_compact(F.array(*lines))).alias("l")).select("doc_id", "l.*")


def flag_totals(summaries: DataFrame, flags: list[str]) -> DataFrame:
    """feature, documents: how many have each flag, in one pass."""
    counts = summaries.agg(*(F.count_if(F.col(f)).alias(f) for f in flags))
    return counts.unpivot([], flags, "feature", "documents")


def corpus_totals(summaries: DataFrame) -> DataFrame:
    """documents, reported (not locked), repaired, locked, incomplete, in one pass."""
    return summaries.agg(
        F.count("*").alias("documents"), F.count_if(~F.col("locked")).alias("reported"), F.count_if("repaired").alias("repaired"), F.count_if("locked").alias("locked"), F.count_if(~F.col("complete")).alias("incomplete")
    )


def corpus_gate(outcomes: DataFrame, manifest: DataFrame, share: float = 0.95) -> DataFrame:
    """documents, opened, rendered, protected, malformed, malformed_bad, problems, opened_share, passed: of outcomes and the manifest's rows of their ids.

    A crash or a hang is a problem, and so is a sound document that asks for a password.
    """
    told = manifest.groupBy("id").agg(F.bool_or(F.array_contains("categories", "malformed")).alias("_bad"), F.max("password").alias("_password"))
    rows = outcomes.join(told, "id", "left")
    bad, outcome = F.coalesce("_bad", F.lit(False)), F.col("outcome")
    failed = outcome.isin("Crashed", "Hung")
    opened = outcome.isin("Rendered", "RenderFailed")
    out = rows.agg(
        F.count("*").alias("documents"), F.count_if(opened).alias("opened"), F.count_if(outcome == "Rendered").alias("rendered"), F.count_if(opened & F.col("_password").isNotNull()).alias("protected"),
        F.count_if(bad).alias("malformed"), F.count_if(bad & failed).alias("malformed_bad"), F.count_if(failed | ((outcome == "PasswordRequired") & ~bad)).alias("problems"),
    )
    out = out.withColumn("opened_share", F.col("opened") / F.greatest(F.col("documents"), F.lit(1).cast("long")))
    return out.withColumn("passed", (F.col("opened_share") >= share) & (F.col("problems") == 0))


def navigation_totals(runs: DataFrame) -> DataFrame:
    """items, labelled, sectioned, links, inert_links, unreadable over all documents: of one row a document."""
    sums = ("items", "links", "inert_links", "unreadable")
    return runs.agg(*(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in sums), F.count_if("labelled").alias("labelled"), F.count_if("sectioned").alias("sectioned"))


def manifest_targets(manifest: DataFrame, least: int = 200, least_malformed: int = 30, category: str = "malformed") -> DataFrame:
    """documents, malformed, passed: whether a corpus holds as many documents as it should."""
    out = manifest.agg(F.count("*").alias("documents"), F.count_if(F.array_contains("categories", category)).alias("malformed"))
    return out.withColumn("passed", (F.col("documents") >= least) & (F.col("malformed") >= least_malformed))


def counted(rows: DataFrame, column: str, name: str) -> DataFrame:
    """name and documents: how many rows have each value; of an array, each of its values."""
    listed = rows.schema[column].dataType.typeName() == "array"
    return rows.select((F.explode(column) if listed else F.col(column)).alias(name)).groupBy(name).agg(F.count("*").alias("documents"))


def tolerances(rows: DataFrame, defaults: DataFrame, allowances: DataFrame) -> DataFrame:
    """Adds most: the default (os, most) of a row's system, or the allowance (os, id, most) of its id where that is larger."""
    base = defaults.select("os", F.col("most").alias("_base"))
    allowed = allowances.select("os", "id", F.col("most").alias("_allowed"))
    out = rows.join(F.broadcast(base), "os", "left").join(allowed, ["os", "id"], "left")  # a default for each system, of which there are few
    return out.withColumn("most", F.greatest(F.coalesce("_allowed", "_base"), "_base")).drop("_base", "_allowed")


def throughput(runs: DataFrame, by: str, work: Column, elapsed: Column) -> DataFrame:
    """by, work, best_ms, per_second of runs."""
    return runs.groupBy(by).agg(F.sum(work).alias("work"), F.min(elapsed).alias("best_ms"), F.round(F.sum(work) / F.sum(elapsed), 6).alias("per_second"))


def best_of(metrics: DataFrame) -> DataFrame:
    """side, name, value and the metric's settings: the best value of all reports; refuses to mix machines."""
    mixed = F.size(F.collect_set(F.struct("os", "arch")))
    out = metrics.groupBy("side", "name").agg(
        F.max("value").alias("_max"), F.min("value").alias("_min"), F.bool_and("higher_is_better").alias("higher_is_better"), F.bool_and("tracked").alias("tracked"), F.max("floor").alias("floor"), mixed.alias("_m"),
    )
    value = F.when(F.col("_m") > 1, F.raise_error(F.lit("reports of different machines")).cast("double")).when(F.col("higher_is_better"), F.col("_max")).otherwise(F.col("_min"))
    return out.select("side", "name", value.alias("value"), "higher_is_better", "tracked", "floor")


def regressions(best: DataFrame, limit: float = 0.1) -> DataFrame:
    """name, previous, current, worse_by, failed: worse by more than the limit and by more than the floor, strictly."""
    a = best.where("side = 'previous'").select("name", F.col("value").alias("previous"), "tracked")
    b = best.where("side = 'current'").select("name", F.col("value").alias("current"), "higher_is_better", "floor", F.col("tracked").alias("_t"))
    rows = a.join(b, "name").where(F.col("tracked") & F.col("_t") & (F.col("previous") > 0))
    delta = F.when(F.col("higher_is_better"), F.col("previous") - F.col("current")).otherwise(F.col("current") - F.col("previous"))
    rows = rows.withColumn("worse_by", delta / F.col("previous"))
    return rows.select("name", "previous", "current", "worse_by", ((F.col("worse_by") > limit) & (delta > F.col("floor"))).alias("failed"))


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, median: the element number n div 2 (from 0) of the sorted values, nulls first.

    Equal values are counted before anything is sorted.  Ranges of values are summed
    up, and only the one range of a key that holds the element is looked into.
    """
    counts = ranged(rows.groupBy(by, value).agg(F.count("*").alias("_n")), [by, value], "median")
    totals = counts.groupBy(by, "_p").agg(F.sum("_n").alias("_total"))  # one row for each key in a range
    w = W.partitionBy(by)
    totals = totals.select(F.col(by).alias("_by"), F.col("_p").alias("_q"), F.coalesce(F.sum("_total").over(w.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"), "_total", F.floor(F.sum("_total").over(w) / 2).alias("_at"))
    holding = totals.where((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + F.col("_total")))
    inside = counts.join(holding, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_q")))
    upto = F.sum("_n").over(W.partitionBy(by, "_p").orderBy(value)) + F.col("_start")
    return inside.withColumn("_upto", upto).where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_n"))).select(by, F.col(value).alias("median"))


def array_difference(a: Column, b: Column, delta: float) -> dict[str, Column]:
    """same_size, differing, ratio, worst of two arrays of numbers; arrays of different sizes differ wholly."""
    same = F.size(a) == F.size(b)
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    differing = F.when(same, F.size(F.filter(d, lambda x: x > delta))).otherwise(F.greatest(F.size(a), F.size(b)))
    return {"same_size": same, "differing": differing, "ratio": F.when(same, differing / F.greatest(F.size(a), F.lit(1))).otherwise(F.lit(1.0)), "worst": F.when(same, F.array_max(d)).otherwise(F.lit(255.0))}


def text_distance(a: Column, b: Column, least: int = 30) -> Column:
    """Edit distance of two comparable texts over the longer one's length; null if that is short."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer >= least, F.levenshtein(a, b) / longer)


#: Pairs whose texts are held as Python strings at once, and their bytes if they are several, besides those of a group of distance.WORDS.
SOME, SOME_BYTES = 64, 1 << 20


def _texts(batch: pa.RecordBatch) -> list[tuple[str, str]]:
    return list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    ends = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b")))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SOME_BYTES, side="right"))
        to = max(at + 1, min(to, at + SOME))
        yield batch.slice(at, to - at)
        at = to


def _distances(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = map(_texts, _slices(batch))
            known = np.array([(max(len(a), len(b)), *trimmed(a, b)) for pairs in some for a, b in pairs], np.int64).reshape(-1, 6)
            longer, _, out, n, _, letters = known.T.copy()
            left = np.flatnonzero(n)
            for group in groups(out[left], n[left], letters[left]):
                group = left[group]
                pairs = _texts(batch.take(pa.array(group)))
                out[group] = together(pairs, *known[group, 1:].T) if len(group) >= LEAST else [edit_distance(*p) for p in pairs]
            shares = pa.array(out / np.maximum(longer, 1), pa.float64(), mask=longer < least)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), shares], ["doc_id", "distance"])

    return run


def neighbours(rows: DataFrame, by: list[str], order: str, value: str, then: dict[str, Column] | None = None) -> DataFrame:
    """Adds previous: the value of the row before in its group, after the columns in ``then``.  A large group is paired range by range, and the first row of a range with the last one before."""
    rows = ranged(rows, [*by, order], "neighbours", then)
    inside = W.partitionBy(*by, "_p").orderBy(order, value)
    rows = rows.withColumns({"previous": F.lag(value).over(inside), "_r": F.row_number().over(inside)})
    last = rows.groupBy(*by, "_p").agg(F.max_by(value, F.struct(order, value)).alias("_v"))
    edge = last.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_p").alias("_q"), F.lag("_v").over(W.partitionBy(*by).orderBy("_p")).alias("_edge"))
    match = (F.col("_r") == 1) & (F.col("_p") == F.col("_q"))
    for c in by:
        match &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = rows.join(edge, match, "left").withColumn("previous", F.when(F.col("_r") == 1, F.col("_edge")).otherwise(F.col("previous")))
    return out.drop("_p", "_r", "_q", "_edge", *(f"_{c}" for c in by))


def text_distances(docs: DataFrame, least: int = 30, whole: bool = False) -> DataFrame:
    """doc_id, distance: each document and the one before it in its language and source, by all comparable characters up to the published bound, or by all of them.

    One task takes a pair, in memory of the order of its texts; its time grows with the product of their lengths.
    """
    bare = comparable(F.col("a"), None) if whole else comparable(F.col("a"))
    pairs = neighbours(docs.select("doc_id", "lang", "source", F.col("text").alias("a")), ["lang", "source"], "doc_id", "a", {"a": bare})
    pairs = pairs.where("a is not null and previous is not null").select("doc_id", "a", F.col("previous").alias("b"))
    return pairs.mapInArrow(_distances(least), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, distance double")


def text_report(distances: DataFrame, limit: float = 0.02, least: int = 30) -> DataFrame:
    """measured, too_short, worst, worst_id (of equal ones the smallest), failures, passed."""
    d = F.col("distance")
    failures = F.count_if(d > limit)
    worst_id = F.max_by("doc_id", F.when(d.isNotNull(), F.struct("distance", -F.col("doc_id")))).alias("worst_id")
    return distances.agg(F.count("distance").alias("measured"), F.count_if(d.isNull()).alias("too_short"), F.max("distance").alias("worst"), worst_id, failures.alias("failures"), ((F.count("distance") >= least) & (failures == 0)).alias("passed"))


def manifest_problems(manifest: DataFrame) -> DataFrame:
    """id, problem for each rule that a row breaks; a missing value breaks the rule of its column, except for the password, which a document may lack."""
    c = F.col
    blank = lambda x: F.coalesce(F.regexp_replace(x, r"[\s\x{85}\p{Z}]", "") == "", F.lit(True))
    no_category = F.coalesce(F.size("categories") <= 0, F.lit(True)) | F.coalesce(F.exists("categories", blank), F.lit(True))
    rules = {
        "id": ~c("id").rlike(r"\A[A-Za-z0-9_\-][A-Za-z0-9._\-]{0,99}\z"), "url": ~F.startswith("url", F.lit("https://")), "sha256": ~c("sha256").rlike(r"\A[0-9a-f]{64}\z"), "license": blank(c("license")),
        "notes": blank(c("notes")), "categories": no_category,
    }
    rules = {k: F.coalesce(v, F.lit(True)) for k, v in rules.items()} | {"password": F.coalesce((F.octet_length("password") > 256) | F.contains("password", F.lit("\0")), F.lit(False))}
    return manifest.select("id", F.explode(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items())))).alias("problem"))


def merged_inventory(lists: list[DataFrame]) -> DataFrame:
    """name, version, source of components from several lists; the first list wins by purl, else by name and version."""
    rows = reduce(DataFrame.union, [d.select("purl", "name", "version", F.lit(i).alias("source"), "pos") for i, d in enumerate(lists)])
    key = F.coalesce("purl", F.concat_ws("@", "name", "version"))
    w = W.partitionBy("_k").orderBy("source", "pos")
    return rows.withColumn("_k", key).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("name", "version", "source")


def kept_groups(rows: DataFrame, owner: str, key: str, at: str, most: int) -> DataFrame:
    """owner, key, latest, kept: the newest ``most`` groups of an owner stay."""
    g = rows.groupBy(owner, key).agg(F.max(at).alias("latest"))
    return g.withColumn("kept", F.row_number().over(W.partitionBy(owner).orderBy(F.desc("latest"), F.desc(key))) <= most)


def ratios_at(pairs: DataFrame, key: str, a: str, b: str, deltas: list[float]) -> DataFrame:
    """key, delta, ratio of array pairs at several deltas."""
    each = F.array(*(F.struct(F.lit(d).alias("delta"), array_difference(F.col(a), F.col(b), d)["ratio"].alias("ratio")) for d in deltas))
    return pairs.select(key, F.explode(each).alias("r")).select(key, "r.*")


def recent_items(rows: DataFrame, owner: str, item: str, at: str, most: int) -> DataFrame:
    """owner, item, latest, rank: distinct items of an owner, most recent first, at most so many."""
    g = rows.groupBy(owner, item).agg(F.max(at).alias("latest"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy(owner).orderBy(F.desc("latest"), item))).where(F.col("rank") <= most)
