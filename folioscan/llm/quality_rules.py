"""Quality rules: a table of thresholds compiled into one Spark projection.

The measures are array and string expressions; no user function runs.  3-word
windows are sorted by their hashes, and those that stand together are compared word by
word; if ever two of them differ, the windows of that text are sorted by their words.
So the count is exact.  (In texts of up to 16,384 words, hash and position are packed
into one long, which sorts faster.)

Defined cases: a null text counts as empty, has no words and fails the base
rule; ratios over zero words or lines are 0; repeated rows are judged alike;
other columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.shared import SPACES, text_of

#: Fixed values of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"

#: Words that tell running text in four languages; fixed values.
STOP_WORDS = (
    "the of and to in is that for it with as was on are be by at from this or "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es "
    "le la les et des du est que dans qui une pour par sur pas au ne se plus "
    "el los las que y del en un por con no una su para se lo como al"
).split()


@dataclass(frozen=True)
class Rule:
    """Rejects a text whose measure leaves [least, most]; None leaves that side open."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The production table.  Ratios are exact quotients of counts.
RULES = (
    Rule("n_words", least=50, most=1_000_000),
    Rule("mean_word_chars", least=2, most=40),
    Rule("symbols_per_word", most=0.3),
    Rule("stop_word_ratio", most=0.95),
    Rule("dup_line_ratio", most=0.7),
    Rule("bullet_line_ratio", most=0.95),
    Rule("repeat_word_ratio", most=0.5),
)

_PACKED_WORDS = 16_384


def _joined(a: Column, b: Column) -> Column:
    """Hash of a window from that of its beginning and that of its last word."""
    return F.xxhash64(a, b)


def _neighbours(keys: Column) -> Column:
    """Array of (key, next key) of a sorted array; the last next key is null."""
    return F.zip_with(keys, F.slice(keys, 2, F.greatest(F.size(keys), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _covered(positions: Column) -> Column:
    """Words inside the 3-word windows that start at the given sorted positions."""
    return F.coalesce(F.aggregate(_neighbours(positions), F.lit(0).cast("long"), lambda n, p: n + F.least(F.lit(3), F.coalesce(p["b"] - p["a"], F.lit(3)))), F.lit(0).cast("long"))


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and counts of each text from which every rule is computed."""
    out = docs.select(*keep, text_of(text).alias("_t"))
    out = out.select(*keep, "_t", F.filter(F.split("_t", f"[{SPACES}]+"), lambda w: w != "").alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda line: line.rlike(f"[^{SPACES}]"))
    out = out.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        lines.alias("_l"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"), "_w",
    )
    n = F.size("_h")
    tail = lambda k: F.slice("_h", F.lit(k), F.greatest(n - 2, F.lit(0)))
    triple = F.zip_with(F.zip_with(tail(1), tail(2), _joined), tail(3), _joined)
    out = out.select(
        *keep, "n_words", "n_symbols", "word_chars", "n_stop_words",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_l", lambda line: line.rlike("^[ \\t]*([-*\u2022]|[0-9]+[.)])[ \\t]"))).cast("long").alias("n_bullet_lines"),
        triple.alias("_g"), "_w",
    )
    long_text = F.col("n_words") > _PACKED_WORDS
    # Up to 2**14 words: (hash bits above, 14 position bits below) in one long, sorted as primitives.
    packed = F.when(~long_text, F.sort_array(F.transform("_g", lambda g, i: F.shiftleft(g, 14).bitwiseOR(i.cast("long")))))
    wide = F.when(long_text, F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.cast("long").alias("i")))))
    out = out.withColumns({"_p": packed, "_s": wide}).drop("_g")
    same = lambda a, b: F.shiftright(a, 14) == F.shiftright(b, 14)
    pairs = F.filter(_neighbours(F.col("_p")), lambda p: same(p["a"], p["b"]))
    wide_pairs = F.filter(_neighbours(F.col("_s")), lambda p: p["a"]["g"] == p["b"]["g"])
    place = lambda x: x.bitwiseAND(F.lit(2**14 - 1).cast("long"))
    both = F.when(long_text, F.transform(wide_pairs, lambda p: F.struct(p["a"]["i"].alias("a"), p["b"]["i"].alias("b")))).otherwise(F.transform(pairs, lambda p: F.struct(place(p["a"]).alias("a"), place(p["b"]).alias("b"))))
    out = out.withColumn("_b", both).drop("_p", "_s")
    word = lambda i, k: F.get("_w", (i + k).cast("int"))
    apart = F.exists("_b", lambda p: (word(p["a"], 0) != word(p["b"], 0)) | (word(p["a"], 1) != word(p["b"], 1)) | (word(p["a"], 2) != word(p["b"], 2)))
    spelled = F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - 3, F.lit(0))), lambda i: F.struct(word(i, 0).alias("x"), word(i, 1).alias("y"), word(i, 2).alias("z"), i.cast("long").alias("i"))))
    equal = F.filter(_neighbours(spelled), lambda p: (p["a"]["x"] == p["b"]["x"]) & (p["a"]["y"] == p["b"]["y"]) & (p["a"]["z"] == p["b"]["z"]))
    exact = F.when(apart, F.transform(equal, lambda p: F.struct(p["a"]["i"].alias("a"), p["b"]["i"].alias("b")))).otherwise(F.col("_b"))
    out = out.withColumn("_r", F.sort_array(F.array_distinct(F.flatten(F.transform(exact, lambda p: F.array(p["a"], p["b"])))))).drop("_b", "_w")
    # Row numbers are not deterministic for the optimizer, so a filter on the verdict is not moved below this point, where it would repeat all expressions above.
    return out.withColumns({"n_repeat_words": _covered(F.col("_r")), "_row": F.monotonically_increasing_id()}).drop("_r")


def _measures() -> dict[str, Column]:
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "bullet_line_ratio": ratio("n_bullet_lines", "n_lines"),
        "repeat_word_ratio": ratio("n_repeat_words", "n_words"),
    }


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """One condition for all rules of the table."""
    measures, out = _measures(), F.lit(True)
    for rule in rules:
        if rule.least is not None:
            out = out & (measures[rule.measure] >= F.lit(float(rule.least)))
        if rule.most is not None:
            out = out & (measures[rule.measure] <= F.lit(float(rule.most)))
    return out


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """measured(), with base_failed and kept."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured(docs, text, keep).withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & passes(rules) & (F.col("_row") >= 0)).drop("_row")


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for op9_quality_rules."""
    ratio = lambda a, b: f"(CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0 END)"
    measures = {
        "n_words": "n_words", "mean_word_chars": ratio("word_chars", "n_words"), "symbols_per_word": ratio("n_symbols", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "bullet_line_ratio": ratio("n_bullet_lines", "n_lines"), "repeat_word_ratio": ratio("n_repeat_words", "n_words"),
    }
    tests = " AND ".join([f"{measures[r.measure]} >= {float(r.least)}" for r in rules if r.least is not None] + [f"{measures[r.measure]} <= {float(r.most)}" for r in rules if r.most is not None])
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
c AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t]*([-*\u2022]|[0-9]+[.)])[ \\t]')))::BIGINT AS n_bullet_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (k)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {tests}) AS kept FROM b
"""
