"""Lookups: labels of pages, sections, destinations, and comparisons of two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions.text import label_number, truncated
from folioscan.limits import LIMITS
from folioscan.storage import ranged


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, take: list[str], ties: list[str] | None = None, spread: bool = False) -> DataFrame:
    """Each left row with the last right row of its key at or before it; of equal places the last by ``ties``.

    A window over the union of both sides: one shuffle on the key, and no pairs.
    spread: for keys of many rows, or none at all (by empty).  The union is cut into
    ranges of key and place, windows stay inside a range, and the last value of the
    ranges before is carried into it.
    """
    value = F.struct(*take)
    a = left.withColumns({"_at": F.col(left_at), "_side": F.lit(1), "_v": F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)})
    tie = F.struct(*ties) if ties else F.lit(0)
    b = right.select(*by, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), value.alias("_v"), tie.alias("_tie"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = ["_at", "_side", "_tie"]
    inside = [*by, "_p"] if spread else by
    both = ranged(both, [*by, *order], "as-of") if spread else both
    w = W.partitionBy(*inside).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    if spread:
        last = both.where("_side = 0").groupBy(*inside).agg(F.max_by("_v", F.struct(*order)).alias("_last"))  # one row for each key in a range
        each = both.select(*inside).distinct().withColumnRenamed("_p", "_q").select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_q")
        same = F.col("_q") == F.col("_p")
        for i, c in enumerate(by):
            same &= F.col(f"_k{i}").eqNullSafe(F.col(c))
        before = W.partitionBy(*(f"_k{i}" for i in range(len(by)))).orderBy("_q").rowsBetween(W.unboundedPreceding, -1)
        carried = each.join(last, same, "left").select(*(f"_k{i}" for i in range(len(by))), "_q", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
        rows = rows.join(carried, same, "left").withColumn("_v", F.coalesce("_v", "_carried"))
    return rows.select(*left.columns, *(F.col(f"_v.{c}").alias(c) for c in take))


def clean_ranges(ranges: DataFrame, order: str | None = None) -> DataFrame:
    """One range for each start page, the first by ``order`` (where there is none, by value); start at least 1, prefix cut, unknown styles null."""
    w = W.partitionBy("doc_id", "first_page").orderBy(*([order] if order else []), "start", "prefix", "style")
    rows = ranges.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    style = F.when(F.col("style").isin("D", "R", "r", "A", "a"), F.col("style"))
    return rows.select("doc_id", "first_page", style.alias("style"), truncated(F.col("prefix"), LIMITS.prefix_chars).alias("prefix"), F.greatest("start", F.lit(1).cast("long")).alias("start"))


def page_labels(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, page, label; before the first range a page has its number."""
    rows = as_of(pages.select("doc_id", "page"), ranges.withColumn("range_page", F.col("first_page")), ["doc_id"], "page", "first_page", ["style", "prefix", "start", "range_page"])
    n = F.col("start") + F.col("page") - F.col("range_page")
    label = F.when(F.col("range_page").isNull(), (F.col("page") + 1).cast("string")).otherwise(F.concat("prefix", label_number(F.col("style"), n)))
    return rows.select("doc_id", "page", label.alias("label"))


def find_labels(labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, label, page: the first page with exactly that label, else with one that differs in ASCII case only."""
    exact = labels.groupBy("doc_id", "label").agg(F.min("page").alias("_exact"))
    fold = F.translate("label", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    folded = labels.groupBy("doc_id", fold.alias("_l")).agg(F.min("page").alias("_folded"))
    rows = wanted.withColumn("_l", fold).join(exact, ["doc_id", "label"], "left").join(folded, ["doc_id", "_l"], "left")
    return rows.select("doc_id", "label", F.coalesce("_exact", "_folded").alias("page"))


def sections(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """doc_id, page, section: the outline item with the latest page at or before this one; of equal ones the last in order."""
    items = outline.select("doc_id", F.col("page").alias("item_page"), F.col("id").alias("section"), "ord")
    return as_of(pages.select("doc_id", "page"), items, ["doc_id"], "page", "item_page", ["section"], ["ord"])


def named_destinations(wanted: DataFrame, dests: DataFrame, name_tree: DataFrame) -> DataFrame:
    """key, is_name, value: names look into dests first, strings into the name tree; a value that is a name again is dropped."""
    rows = wanted.join(dests.select("key", F.col("value").alias("_d"), F.col("value_kind").alias("_dk")), "key", "left").join(name_tree.select("key", F.col("value").alias("_t"), F.col("value_kind").alias("_tk")), "key", "left")
    one = F.when(F.col("_dk").isNotNull(), F.struct(F.col("_dk").alias("k"), F.col("_d").alias("v")))
    two = F.when(F.col("_tk").isNotNull(), F.struct(F.col("_tk").alias("k"), F.col("_t").alias("v")))
    rows = rows.withColumn("_v", F.when(F.col("is_name"), F.coalesce(one, two)).otherwise(F.coalesce(two, one)))
    return rows.select("key", "is_name", F.when(F.col("_v.k") != "name", F.col("_v.v")).alias("value"), F.when(F.col("_v.k") != "name", F.col("_v.k")).alias("value_kind"))


def destination_pages(found: DataFrame, page_objects: DataFrame) -> DataFrame:
    """key, page: by object, or by an index that exists; else null (unresolved)."""
    pages = page_objects.agg(F.count("*").alias("_pages"))  # one row
    by_object = page_objects.select(F.col("num").alias("value"), F.lit("ref").alias("value_kind"), F.col("page").alias("_p"))
    rows = found.join(by_object, ["value", "value_kind"], "left").join(F.broadcast(pages))
    index = F.when((F.col("value_kind") == "index") & F.col("value").between(0, F.col("_pages") - 1), F.col("value"))
    return rows.select("key", "is_name", F.coalesce("_p", index).alias("page"))


def mismatches(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that only one side has, or whose columns differ (null equals null)."""
    left = a.select(key, F.struct(*columns).alias("_a"))
    right = b.select(key, F.struct(*columns).alias("_b"))
    rows = left.join(right, key, "full_outer")
    kind = F.when(F.col("_a").isNull(), "right only").when(F.col("_b").isNull(), "left only").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return rows.select(key, kind.alias("problem")).where("problem is not null")


def subset_problems(subset: DataFrame, main: DataFrame) -> DataFrame:
    """id, problem of a manifest's subset: stray, changed, share-alike license, or password needed."""
    m = main.select("id", F.struct("url", "sha256", "license").alias("_m"))
    rows = subset.join(m, "id", "left")
    checks = F.array_compact(
        F.array(
            F.when(F.col("_m").isNull(), F.lit("stray")), F.when(F.col("_m").isNotNull() & ~F.col("_m").eqNullSafe(F.struct("url", "sha256", "license")), F.lit("changed")),
            F.when(F.contains("license", F.lit("-SA")), F.lit("share-alike")), F.when(F.col("password").isNotNull(), F.lit("password")),
        )
    )
    return rows.select("id", F.explode(checks).alias("problem"))


def lost_requests(sent: DataFrame, answered: DataFrame, keys: list[str]) -> DataFrame:
    return sent.join(answered.select(*keys).distinct(), keys, "left_anti")


def findings(rows: DataFrame, checks: dict[str, Column], key: str = "id") -> DataFrame:
    """key, code for each check that holds."""
    return rows.select(key, F.explode(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())))).alias("code"))


#: What a comparison of two readers of a document may find, in the order in which it looks; fixed values.
CROSS_CHECKS = ("cos-unreadable", "cos-unsettled", "cos-locked", "cos-page-unreadable", "page-count-mismatch")


def cross_check(documents: DataFrame, states: DataFrame, pages: DataFrame, repairs: DataFrame) -> DataFrame:
    """id, code, times of what a second reader finds in documents (id, pages: how many the first one counts).

    states: id, state (unreadable, unsettled, locked or null), unlocked (whether a
    password opened it): the first of these that holds ends the check.  pages (id, page,
    ok): the second reader's walk in order, which stops once it has met one page more
    than there should be; unreadable pages that it meets are told, and another number
    of readable ones.  repairs: id, code.
    """
    rows = documents.select("id", "pages").join(states.select("id", "state", "unlocked"), "id", "left")
    ended = F.when(F.col("state") == "unreadable", CROSS_CHECKS[0]).when(F.col("state") == "unsettled", CROSS_CHECKS[1]).when((F.col("state") == "locked") & ~F.coalesce("unlocked", F.lit(False)), CROSS_CHECKS[2])
    rows = rows.select("id", "pages", ended.alias("ended"))
    w = W.partitionBy("id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    met = pages.select("id", "page", "ok", F.coalesce(F.sum(F.col("ok").cast("long")).over(w), F.lit(0)).alias("_before"))
    going = rows.where("ended is null")
    met = met.join(going.select("id", "pages"), "id").where(F.col("_before") <= F.col("pages"))
    walked = met.groupBy("id").agg(F.count_if("ok").alias("_walked"), F.count_if(~F.col("ok")).alias("_bad"))
    told = going.join(walked, "id", "left").select("id", F.coalesce("_bad", F.lit(0)).alias("_bad"), (F.coalesce("_walked", F.lit(0)) != F.col("pages")).alias("_other"))
    code = lambda k, times: F.struct(F.lit(CROSS_CHECKS[k]).alias("code"), times.cast("long").alias("times"))
    found = told.select("id", F.explode(F.array_compact(F.array(F.when(F.col("_bad") > 0, code(3, F.col("_bad"))), F.when(F.col("_other"), code(4, F.lit(1)))))).alias("c")).select("id", "c.code", "c.times")
    first = rows.where("ended is not null").select("id", F.col("ended").alias("code"), F.lit(1).cast("long").alias("times"))
    repaired = repairs.join(going.select("id"), "id", "left_semi").groupBy("id", "code").agg(F.count("*").alias("times"))
    return first.union(found).union(repaired.select("id", "code", "times"))
