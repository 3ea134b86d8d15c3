"""Cases with known answers."""

import pytest
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import graph, lookup, report, revisions, search, select
from folioscan.sources import files
from folioscan.streaming import logs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_text(spark):
    assert one(spark, T.comparable(F.lit("  eﬃcient­ \r\n\t coﬀee �"))) == "efficientcoffee"
    assert one(spark, T.printable(F.lit("a\x1b[2Jb\r\nc\rd"))) == "a [2Jb\nc\nd"
    assert one(spark, T.one_line(F.lit("a‮b\nc"))) == "a b c"
    assert one(spark, T.haystack(F.lit("  a  b\n"))) == "a b "
    assert one(spark, T.truncated(F.lit("abcd"), 3)) == "abc…"
    assert one(spark, T.decoded(F.unhex(F.lit("FEFF00410042")))) == "AB"
    assert one(spark, T.decoded(F.unhex(F.lit("41A0938042")))) == "A€ﬁ•B"
    assert one(spark, T.level_of(F.lit("x WARN y ERROR"))) == "WARN"
    assert one(spark, T.cleaned_line(F.lit("a\x07b\tc"))) == "a?b\tc"


@pytest.mark.parametrize("n,want", [(1, "i"), (4, "iv"), (1994, "mcmxciv"), (3999, "mmmcmxcix"), (4000, "4000"), (0, "0")])
def test_roman(spark, n, want):
    assert one(spark, T.roman(F.lit(n))) == want


def test_roman_value_is_canonical(spark):
    assert one(spark, T.roman_value(F.lit("XIV"))) == 14
    assert one(spark, T.roman_value(F.lit("iiii"))) is None
    assert one(spark, T.roman_value(F.lit(""))) is None


def pages(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, page int, text string")


def test_hits_do_not_overlap_and_keep_offsets(spark):
    found = search.hits(pages(spark, "aaaa É a.c abc", "none"), search.pattern("aa")).collect()
    assert [(r["page"], r["first"], r["count"]) for r in found] == [(0, 0, 2), (0, 2, 2)]
    assert search.hits(pages(spark, "x É"), search.pattern("é")).count() == 1
    assert search.hits(pages(spark, "a.c abc"), search.pattern("a.c")).count() == 1
    assert search.hits(pages(spark, "a.c abc"), search.pattern("a.c", regex=True)).count() == 2
    assert search.hits(pages(spark, "élan le élans"), search.pattern("élan", whole_word=True)).count() == 1
    assert search.hits(pages(spark, "q\\E q"), search.pattern("q\\E")).count() == 1


def test_snippet_bytes(spark):
    row = search.snippets(search.hits(pages(spark, "ééé " + "x" * 200 + " tail"), search.pattern("x+", regex=True))).first()
    assert (row["match_start"], row["match_len"]) == (7, 96)


def test_query_problems(spark):
    ask = lambda q, regex=True: one(spark, search.query_problem(F.lit(q), F.lit(regex)))
    assert ask("") == "empty"
    assert ask("x" * 1025) == "too long"
    assert ask("(?<=a)b") == "look-around or back-reference"
    assert ask("(?<n>a)") is None
    assert ask("(a") == "does not compile"
    assert ask("(a", False) is None


def test_specs(spark):
    specs = spark.createDataFrame([(i, 12, s) for i, s in enumerate(["1-3,2,11-", "0", "5-3", "1,,2", "99", "", "-2"])], "spec_id long, pages long, spec string")
    pieces = select.spec_pieces(specs)
    assert dict(map(tuple, select.spec_problems(pieces).collect())) == {0: None, 1: "Zero", 2: "Backwards", 3: "Invalid", 4: "OutOfRange", 5: "Empty", 6: None}
    got = select.spec_pages(pieces).where("spec_id = 0").orderBy("ord").collect()
    assert [r["page"] for r in got] == [0, 1, 2, 10, 11]


def test_permissions(spark):
    p = select.permissions(F.lit(2052), F.lit(3), F.lit(False))
    got = {k: one(spark, c) for k, c in p.items()}
    assert got == {"print": True, "modify": False, "copy": False, "annotate": False, "fill_forms": False, "extract": False, "assemble": False, "print_high": True}
    assert one(spark, select.permissions(F.lit(-3904), F.lit(3), F.lit(True))["modify"])


def test_uris(spark):
    ask = lambda u: one(spark, select.uri_problem(F.lit(u)))
    assert [ask(u) for u in ("", "a b", "no-scheme", "ftp://x", "mailto:", "http:///x", "HTTPS://x/y", "mailto:a@b")] == ["empty", "control or space", "invalid", "scheme", "no address", "no host", None, None]


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, 0), (1, 5), (2, 5)], "k long, t int")
    right = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (1, 6, "c")], "k long, t int, v string")
    got = lookup.as_of(left, right.withColumnRenamed("t", "s"), ["k"], "t", "s", ["v"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 0, None), (1, 5, "b"), (2, 5, None)]


def test_gate_is_strict(spark):
    rows = [("previous", "a", 100.0), ("current", "a", 110.0), ("previous", "b", 100.0), ("current", "b", 111.0), ("previous", "c", 10.0), ("current", "c", 14.0)]
    m = spark.createDataFrame([("r", s, "l", "x", n, v, False, True, 5.0) for s, n, v in rows], "report string, side string, os string, arch string, name string, value double, higher_is_better boolean, tracked boolean, floor double")
    assert {r["name"]: r["failed"] for r in report.regressions(report.best_of(m)).collect()} == {"a": False, "b": True, "c": False}


def test_mixed_machines_are_refused(spark):
    m = spark.createDataFrame([("r", "current", os, "x", "a", 1.0, False, True, 5.0) for os in ("l", "m")], "report string, side string, os string, arch string, name string, value double, higher_is_better boolean, tracked boolean, floor double")
    with pytest.raises(Exception, match="different machines"):
        report.best_of(m).collect()


def test_upper_median(spark):
    rows = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0)], "k string, v double")
    assert report.upper_median(rows, "k", "v").first()["median"] == 3.0


def test_changes(spark):
    base = spark.createDataFrame([(1, 1, "inuse", 0), (1, 2, "compressed", 0), (1, 3, "free", 4)], "doc_id long, num int, kind string, generation int")
    changes = spark.createDataFrame([(1, 1, 1, "set", "x"), (1, 2, 1, "free", None), (1, 3, 2, "free", None), (1, 4, 3, "free", None), (1, 5, 9, "free", None), (1, 6, 3, "set", "y")], "doc_id long, seq int, num int, op string, value string")
    got = sorted(map(tuple, revisions.applied(base, changes).collect()))
    assert got == [(1, 1, "free", 1, None), (1, 2, "free", 1, None), (1, 3, "inuse", 4, "y")]


def test_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert sorted(map(tuple, graph.reached(edges, roots).collect())) == [("a", 0), ("b", 1), ("c", 2)]
    refs = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, None)], "src long, dst long")
    assert sorted(map(tuple, graph.dereferenced(refs).collect())) == [(1, None), (2, None), (3, 4)]


def test_chain_of_chains(spark):
    rows = spark.createDataFrame([(1, i, i + 1 if i < 40 else None) for i in range(41)] + [(2, 7, None)], "k long, n long, nxt long")
    assert {(r["k"], r["n"]): r["rank"] for r in graph.chain_ranks(rows, "k", "n", "nxt").collect()} == {**{(1, i): i for i in range(41)}, (2, 7): 0}


def test_headers_and_json(spark):
    raw = spark.createDataFrame([("a", bytearray(b"%PDF-1.7\n1 0 obj << /Linearized 1 >> endobj")), ("b", bytearray(b"%PDF-1.4\n1 0 obj << >> endobj /Linearized"))], "id string, content binary")
    assert sorted(map(tuple, files.headers(raw).collect())) == [("a", "1.7", True), ("b", "1.4", False)]
    row = spark.range(1).select("id", F.array(*(F.lit("x" * 50) for _ in range(20))).alias("v"))
    import json

    got = json.loads(row.select(files.capped_json(["id"], {"v": F.col("v")}, 300).alias("j")).first()[0])
    assert got["v"]["total"] == 20 and got["v"]["truncated"] and 0 < len(got["v"]["items"]) < 7


def test_metric_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schema": 1, "os": "l", "arch": "x", "runs": 3, "cold": {}, "metrics": {"m": {"value": 2.0, "unit": "ms", "higher_is_better": false, "tracked": true, "floor": 5.0}}}')
    assert files.read_metrics(spark, str(tmp_path)).first()["value"] == 2.0
    (tmp_path / "b.json").write_text('{"schema": 2, "os": "l", "arch": "x", "runs": 3, "cold": {}, "metrics": {}}')
    with pytest.raises(Exception, match="another schema"):
        files.read_metrics(spark, str(tmp_path)).collect()
    assert files.binary_files(spark, str(tmp_path), "*.json").count() == 2


def test_streaks(spark):
    kinds = ["error", "error", "purchase", "error", "error", "error", "error"]
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "pid long, seq long, kind string")
    assert [(r["streak"], r["restart"]) for r in logs.crash_streaks(rows).orderBy("seq").collect()] == [(1, True), (2, True), (1, True), (2, True), (3, True), (4, False)]
