"""Characters, words and lines of pages, and the regions they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions.text import text_only
from folioscan.limits import LIMITS
from folioscan.operators import layout
from folioscan.operators.lookup import as_of
from folioscan.operators.search import matches

#: White space of words, and the characters that end lines; fixed values.
_BLANK = r"\s\x{200B}"
_BREAK = r"\n\r\x{2028}\x{2029}\x{85}"
KEYS = ("doc_id", "page")


def words(pages: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, word (from 0), first, last, word_text: words without blanks, cut inside the row."""
    found = matches(pages, F.col("text"), f"(?U)[^{_BLANK}]+", keys)
    return found.select(*keys, F.col("at").alias("word"), "first", (F.col("first") + F.length("match") - 1).alias("last"), F.col("match").alias("word_text"))


def characters(pages: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, pos, ch, word, line, x0, y0, x1, y1 of the characters of pages; all is counted where the page is.

    A word begins at the first letter after white space, which belongs to the word
    before it, a line at the first letter after a line break.  Ligatures become
    letters that share their width; other controls are dropped.  The boxes are those of
    plain text, one unit a character and ten a line; white space has none.
    """
    return layout.laid_out(_clean(pages, keys), keys, "pos int, ch string, word int, line int, x0 double, y0 double, x1 double, y1 double", layout.characters)


def _clean(pages: DataFrame, keys: tuple[str, ...], *asked: str) -> DataFrame:
    return pages.select(*keys, text_only(F.col("text")).alias("text"), *asked)


def page_line_boxes(pages: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """line_boxes() of the characters() of pages, without a row for each of them."""
    return layout.laid_out(_clean(pages, keys), keys, "line int, x0 double, y0 double, x1 double, y1 double, vertical boolean, reversed boolean", layout.lines)


def page_hit_boxes(pages: DataFrame, most: int = LIMITS.hit_boxes, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """hit_boxes() of the characters() of pages, whose column hits lists first and count of each hit."""
    return layout.laid_out(_clean(pages, keys, "hits"), keys, "first int, box int, x0 double, y0 double, x1 double, y1 double", layout.hit_boxes(most))


def page_word_boxes(pages: DataFrame, size: int, most: int = LIMITS.hit_boxes, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """page_hit_boxes() of each ``size`` words in a row."""
    return layout.laid_out(_clean(pages, keys), keys, "first int, box int, x0 double, y0 double, x1 double, y1 double", layout.hit_boxes(most, size))


def page_totals(pages: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, words, lines, chars, x, y, w: counts, and sums of x0, y1 and pos * word, over the characters() of each page."""
    return layout.laid_out(_clean(pages, keys), keys, "words int, lines int, chars long, x double, y double, w long", layout.totals)


def page_nearest_lines(pages: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """nearest_lines() of the characters() of pages, whose column points lists point, x and y; pages without a line have none."""
    return layout.laid_out(_clean(pages, keys, "points"), keys, "point int, line int, across double, along double", layout.nearest_lines)


def page_carets(pages: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """carets() of the characters() of pages, whose column points lists point, x and y."""
    return layout.laid_out(_clean(pages, keys, "points"), keys, "point int, caret int", layout.carets)


def page_around(pages: DataFrame, number: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """around() of the words or lines of pages, whose column positions lists the positions."""
    return layout.laid_out(pages.select(*keys, "text", "positions"), keys, f"pos int, {number} int, `from` int, `to` int", layout.around(number))


def lines(pages: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, line (from 0), first, last: lines that hold a letter, from the first to the last of them."""
    found = matches(pages, F.col("text"), f"(?U)[^{_BLANK}{_BREAK}](?:[^{_BREAK}]*[^{_BLANK}{_BREAK}])?", keys)
    return found.select(*keys, F.col("at").alias("line"), "first", (F.col("first") + F.length("match") - 1).alias("last"))


def around(found: DataFrame, pages: DataFrame, positions: DataFrame, number: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, pos, number, from, to (exclusive) of the words or lines around positions (keys, pos).

    A span goes on to the next one.  Of words the white space after them is left out, or is
    the span where the position lies in it.
    """
    after = W.partitionBy(*keys).orderBy("first")
    spans = found.withColumn("_next", F.lead("first").over(after)).withColumn("_begin", F.when(F.col(number) == 0, 0).otherwise(F.col("first")))
    rows = as_of(positions.select(*keys, "pos"), spans, list(keys), "pos", "_begin", [number, "_begin", "last", "_next"])
    rows = rows.join(pages.select(*keys, F.length("text").alias("_length")), list(keys)).where(F.col("pos").between(0, F.col("_length") - 1))
    end = F.coalesce("_next", "_length")
    if number == "line":
        begin, to = F.coalesce("_begin", F.lit(0)), end
    else:
        blank = F.col("pos") > F.col("last")
        begin, to = F.coalesce(F.when(blank, F.col("last") + 1).otherwise(F.col("_begin")), F.lit(0)), F.when(blank | F.col("last").isNull(), end).otherwise(F.col("last") + 1)
    return rows.select(*keys, "pos", F.coalesce(number, F.lit(0)).alias(number), begin.alias("from"), to.alias("to"))


def line_boxes(chars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, line, box edges, vertical and reversed: from the first and the last boxed character's places."""
    boxed = F.when(F.col("x0").isNotNull(), F.col("pos"))
    g = chars.groupBy(*keys, "line").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        (F.max_by("x0", boxed) - F.min_by("x0", boxed)).alias("dx"), (F.max_by("y0", boxed) - F.min_by("y0", boxed)).alias("dy"),
    ).where("x0 is not null")
    vertical = F.abs("dy") > F.abs("dx")
    return g.select(*keys, "line", "x0", "y0", "x1", "y1", vertical.alias("vertical"), (F.when(vertical, F.col("dy")).otherwise(F.col("dx")) < 0).alias("reversed"))


def hit_boxes(found: DataFrame, chars: DataFrame, most: int = LIMITS.hit_boxes, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, first, box, edges: one box for each line of a hit; lines beyond ``most`` join the last box, characters without a box are passed over."""
    inside = found.select(*keys, "first", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("pos"))
    rows = inside.join(chars.where("x0 is not null"), [*keys, "pos"])
    rank = F.dense_rank().over(W.partitionBy(*keys, "first").orderBy("line"))
    rows = rows.withColumn("box", F.least(rank, F.lit(most)))
    return rows.groupBy(*keys, "first", "box").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


#: Pages of a bin in which ranges and pages meet.
BIN = 256


def range_text(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, range_id, text of ranges (doc_id, range_id, from_page, from_pos, to_page, to_pos): pages joined by a line end.

    A range meets the pages of its own bins of pages only, up to the last page of its document.
    """
    last = pages.groupBy("doc_id").agg(F.max("page").alias("_last"))
    wanted = ranges.join(last, "doc_id").where(F.col("from_page") <= F.least("to_page", "_last"))
    wanted = wanted.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("from_page") / BIN), F.floor(F.least("to_page", "_last") / BIN)))).drop("_last")
    rows = pages.withColumn("_bin", F.floor(F.col("page") / BIN)).join(wanted, ["doc_id", "_bin"]).where(F.col("page").between(F.col("from_page"), F.col("to_page")))
    begin = F.when(F.col("page") == F.col("from_page"), F.col("from_pos")).otherwise(F.lit(0))
    end = F.when(F.col("page") == F.col("to_page"), F.col("to_pos")).otherwise(F.length("text"))
    cut = F.replace(F.substring(F.col("text"), begin + 1, F.greatest(end - begin, F.lit(0))), F.lit("\r\n"), F.lit("\n"))
    rows = rows.select("doc_id", "range_id", "page", cut.alias("t")).groupBy("doc_id", "range_id").agg(F.array_sort(F.collect_list(F.struct("page", "t"))).alias("p"))
    return rows.select("doc_id", "range_id", F.array_join(F.col("p.t"), "\n").alias("text"))


def _gap(v: str, a: str, b: str) -> Column:
    return F.greatest(F.col(a) - F.col(v), F.col(v) - F.col(b), F.lit(0.0))


def nearest_lines(points: DataFrame, boxes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, point, line: the line with the smallest gap across its direction, then along, then first."""
    dx, dy = _gap("x", "x0", "x1"), _gap("y", "y0", "y1")
    vertical = F.col("vertical") if "vertical" in boxes.columns else F.lit(False)
    rows = points.join(boxes, list(keys)).withColumns({"across": F.when(vertical, dx).otherwise(dy), "along": F.when(vertical, dy).otherwise(dx)})
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy(*keys, "point").orderBy("across", "along", "line")))
    return rows.where("r = 1").select(*keys, "point", "line", "across", "along")


def carets(points: DataFrame, boxes: DataFrame, chars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, point, caret: before the first boxed character of the nearest line whose middle is ahead of the point, else after the last one."""
    near = nearest_lines(points, boxes, keys).select(*keys, "point", "line").join(points, [*keys, "point"]).join(boxes.select(*keys, "line", "vertical", "reversed"), [*keys, "line"])
    rows = near.join(chars.where("x0 is not null"), [*keys, "line"])
    at = F.when(F.col("vertical"), F.col("y")).otherwise(F.col("x"))
    middle = F.when(F.col("vertical"), (F.col("y0") + F.col("y1")) / 2).otherwise((F.col("x0") + F.col("x1")) / 2)
    ahead = F.when(F.col("reversed"), at > middle).otherwise(at < middle)
    return rows.groupBy(*keys, "point").agg(F.coalesce(F.min(F.when(ahead, F.col("pos"))), F.max("pos") + 1).alias("caret"))
