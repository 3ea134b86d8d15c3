"""Selecting pages, paging through levels, and rules of a single row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.limits import LIMITS


#: White space as Unicode has it.
_BLANK = r"[\s\x{85}\p{Z}]"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{_BLANK}+|{_BLANK}+\z", "")


def spec_pieces(specs: DataFrame) -> DataFrame:
    """spec_id, pages, at, first, last, problem of each comma-separated piece of a page spec (N, N-M, N-, -M).

    White space around a piece and around the numbers of a range is allowed, inside a
    number it is not.  A document without pages is the first of problems; then those of
    the piece, from left to right.  A null spec is an empty one.
    """
    rows = specs.select("spec_id", "pages", F.coalesce("spec", F.lit("")).alias("_s"))
    rows = rows.select("spec_id", "pages", _trimmed(F.col("_s")).alias("_s"), F.posexplode(F.split("_s", ",")).alias("at", "piece")).withColumn("piece", _trimmed(F.col("piece")))
    dash = F.instr("piece", "-")
    rows = rows.withColumns({"_range": dash > 0, "_a": _trimmed(F.substring_index("piece", "-", 1)), "_b": _trimmed(F.substring(F.col("piece"), dash + 1, F.length("piece")))})
    # a number too long for a bigint is as far beyond the last page as one can be
    value = lambda c: F.when(F.col(c).rlike(r"\A[0-9]+\z"), F.coalesce(F.expr(f"try_cast(regexp_replace({c}, '^0+(?=.)', '') as bigint)"), F.lit(2**63 - 1)))
    wrong = lambda c: F.when(value(c).isNull(), "Invalid").when(value(c) == 0, "Zero").when(value(c) > F.col("pages"), "OutOfRange")
    first = F.when(F.col("_range") & (F.col("_a") == ""), F.lit(1).cast("long")).otherwise(value("_a"))
    last = F.when(~F.col("_range"), first).when(F.col("_b") == "", F.col("pages")).otherwise(value("_b"))
    rows = rows.withColumns({"first": first, "last": last})
    problem = (
        F.when(F.col("pages") == 0, "NoPages").when(F.col("_s") == "", "Empty").when(F.col("piece") == "", "Invalid").when(~F.col("_range"), wrong("piece")).when(F.contains("_b", F.lit("-")), "Invalid")
        .when((F.col("_a") != "") & wrong("_a").isNotNull(), wrong("_a")).when((F.col("_b") != "") & wrong("_b").isNotNull(), wrong("_b")).when((F.col("_a") == "") & (F.col("_b") == ""), "Invalid").when(F.col("first") > F.col("last"), "Backwards")
    )
    return rows.select("spec_id", "pages", "at", "first", "last", problem.alias("problem"))


def spec_problems(pieces: DataFrame) -> DataFrame:
    """spec_id, problem: that of the first bad piece, null for a good spec."""
    return pieces.groupBy("spec_id").agg(F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("at"))).alias("problem"))


def spec_pages(pieces: DataFrame) -> DataFrame:
    """spec_id, page (from 0), ord: pages of good specs in spec order, the first mention wins."""
    good = pieces.join(spec_problems(pieces).where("problem is null").select("spec_id"), "spec_id")
    rows = good.select("spec_id", "at", F.explode(F.sequence("first", "last")).alias("n"))
    rows = rows.groupBy("spec_id", "n").agg(F.min("at").alias("at"))
    order = W.partitionBy("spec_id").orderBy("at", "n")
    return rows.select("spec_id", (F.col("n") - 1).cast("int").alias("page"), (F.row_number().over(order) - 1).alias("ord"))


def selected_text(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text: chosen pages (doc_id, page, ord) in their order, joined by form feeds."""
    rows = pages.join(chosen, ["doc_id", "page"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("p"))
    return rows.select("doc_id", F.array_join("p.text", "\f").alias("text"))


def label_ranges_of(specs: DataFrame, labels: DataFrame) -> DataFrame:
    """spec_id, at, from_page, to_page, problem of pieces in labels (spec_id, doc_id, spec; doc_id, label, page).

    A whole piece is tried as one label, then each hyphen or dash as a split; the first valid split wins.
    """
    rows = specs.select("spec_id", "doc_id", F.posexplode(F.split("spec", "[,;]")).alias("at", "piece")).withColumn("piece", F.trim("piece"))
    cut = F.filter(F.sequence(F.lit(1), F.greatest(F.length("piece"), F.lit(1))), lambda i: F.substring(F.col("piece"), i, F.lit(1)).isin("-", "–"))
    whole = rows.select("spec_id", "doc_id", "at", F.lit(0).alias("cut"), F.col("piece").alias("a"), F.col("piece").alias("b"))
    parts = rows.select("spec_id", "doc_id", "at", "piece", F.explode(cut).alias("cut"))
    parts = parts.select("spec_id", "doc_id", "at", "cut", F.trim(F.substring(F.col("piece"), F.lit(1), F.col("cut") - 1)).alias("a"), F.trim(F.substring(F.col("piece"), F.col("cut") + 1, F.length("piece"))).alias("b"))
    first = labels.groupBy("doc_id", "label").agg(F.min("page").alias("page"))
    tried = whole.union(parts)
    tried = tried.join(first.select("doc_id", F.col("label").alias("a"), F.col("page").alias("from_page")), ["doc_id", "a"], "left")
    tried = tried.join(first.select("doc_id", F.col("label").alias("b"), F.col("page").alias("to_page")), ["doc_id", "b"], "left")
    valid = F.when(F.col("from_page").isNotNull() & F.col("to_page").isNotNull(), F.struct("cut", "from_page", "to_page"))
    best = tried.groupBy("spec_id", "at").agg(F.min(valid).alias("v"))
    problem = F.when(F.col("v").isNull(), "Unknown").when(F.col("v.from_page") > F.col("v.to_page"), "Backwards")
    return best.select("spec_id", "at", "v.from_page", "v.to_page", problem.alias("problem"))


def parity(pages: DataFrame, odd: bool) -> DataFrame:
    """Pages with an odd or even number; index 0 is page 1."""
    return pages.where(F.col("page") % 2 == (0 if odd else 1))


def level(rows: DataFrame, by: list[str], order: list[str], skip: int, limit: int) -> DataFrame:
    """The rows of each level after ``skip``, at most ``limit``, and whether more follow."""
    rows = rows.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rn").between(skip + 1, skip + limit + 1))
    rows = rows.withColumn("more", F.max("rn").over(W.partitionBy(*by)) > skip + limit)
    return rows.where(F.col("rn") <= skip + limit)


def visible_links(links: DataFrame) -> DataFrame:
    """Link annotations that are neither hidden (bit 2) nor kept from view (bit 6)."""
    return links.where((F.col("subtype") == "Link") & (F.col("flags").bitwiseAND(34) == 0))


def page_size(media: Column, crop: Column, rotate: Column) -> tuple[Column, Column]:
    """Width and height as displayed, in hundredths of a point."""
    box = F.coalesce(crop, media)
    w, h = F.abs(F.get(box, F.lit(2)) - F.get(box, F.lit(0))), F.abs(F.get(box, F.lit(3)) - F.get(box, F.lit(1)))
    turned = F.pmod(rotate, F.lit(180)) == 90
    cents = lambda v: F.round(v * 100).cast("long")
    return cents(F.when(turned, h).otherwise(w)), cents(F.when(turned, w).otherwise(h))


def rect_on_page(rect: list[Column], box: Column, rotate: Column) -> list[Column]:
    """A rectangle of user space on the page as shown, from the top left corner; a rotation that is no multiple of 90 counts as 0."""
    b = F.coalesce(box, F.array(*map(F.lit, (0.0, 0.0, 612.0, 792.0))))
    e = lambda i: F.get(b, F.lit(i))
    left, bottom, right, top = F.least(e(0), e(2)), F.least(e(1), e(3)), F.greatest(e(0), e(2)), F.greatest(e(1), e(3))
    turns = F.when(rotate % 90 == 0, F.pmod((rotate / 90).cast("int"), F.lit(4))).otherwise(0)

    def shown(x: Column, y: Column) -> tuple[Column, Column]:
        return (
            F.when(turns == 0, x - left).when(turns == 1, y - bottom).when(turns == 2, right - x).otherwise(top - y),
            F.when(turns == 0, top - y).when(turns == 1, x - left).when(turns == 2, y - bottom).otherwise(right - x),
        )

    (ax, ay), (bx, by) = shown(rect[0], rect[1]), shown(rect[2], rect[3])
    return [F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)]


#: Bits (from 1) of the permission mask; fixed values.
PERMISSIONS = {"print": 3, "modify": 4, "copy": 5, "annotate": 6, "fill_forms": 9, "extract": 10, "assemble": 11, "print_high": 12}


def permissions(mask: Column, revision: Column, owner: Column) -> dict[str, Column]:
    """What a mask allows; the owner is not restricted, and before revision 3 printing is high quality."""
    bit = {k: F.shiftright(mask, n - 1).bitwiseAND(1) == 1 for k, n in PERMISSIONS.items()}
    bit["print_high"] = bit["print"] & ((revision < 3) | bit["print_high"])
    return {k: owner | v for k, v in bit.items()}


def uri_problem(uri: Column) -> Column:
    """Why a URI is not opened, or null."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_extract(uri, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:(.*)$", 1)
    host = F.regexp_extract(rest, r"^//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return (
        F.when(uri == "", "empty").when(uri.rlike(r"[\x00-\x20\x7f]"), "control or space").when(scheme == "", "invalid").when(~scheme.isin("http", "https", "mailto"), "scheme")
        .when((scheme == "mailto") & (rest == ""), "no address").when((scheme != "mailto") & (host == ""), "no host")
    )


NAMED = ("NextPage", "PrevPage", "FirstPage", "LastPage")


def _cut(name: Column) -> Column:
    """The first bytes of a name; a character cut in two becomes U+FFFD."""
    return F.make_valid_utf8(F.substring(name.cast("binary"), 1, LIMITS.path).cast("string"))


def action_of(kind: Column, target: Column) -> Column:
    """GoTo, Uri, Named, or inert with the reason, cut by bytes."""
    return (
        F.when(kind == "URI", F.when(F.octet_length(target) > LIMITS.uri_bytes, "Inert:URI").otherwise("Uri")).when(kind == "GoTo", "GoTo")
        .when(kind == "Named", F.when(target.isin(*NAMED), "Named").otherwise(F.concat(F.lit("Inert:Named:"), _cut(target)))).otherwise(F.concat(F.lit("Inert:"), _cut(kind)))
    )


def refusal_of(message: Column) -> Column:
    return F.when(message == "", "unexplained").when(F.contains(message, F.lit("password")), "password").otherwise("malformed")


def outcome_problem(outcome: Column, malformed: Column) -> Column:
    """What is wrong with how a document ended, or null: a sound one that needs a password, or one that ended a process; only sound ones must open."""
    return F.when((outcome == "PasswordRequired") & ~malformed, "needs a password").when(outcome.isin("Crashed", "Hung"), outcome)
