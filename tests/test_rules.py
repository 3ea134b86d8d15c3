"""Rules with known answers: text, selection, search, spans, chains, trees, reports and files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import graph, lookup, report, search, select, spans
from folioscan.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_text_never_fails(spark):
    raw = lambda h: F.unhex(F.lit(h))
    assert one(spark, T.decoded(raw("FEFF0041D83D0042DC00D83DDE00FF"))) == "A�B�\U0001f600"
    assert one(spark, T.decoded(raw("FFFE410000D8"))) == "A�"
    assert one(spark, T.decoded(raw("EFBBBF41FF42E282"))) == "A�B�"
    assert one(spark, T.decoded(raw("FEFF"))) == "" and one(spark, T.decoded(raw(""))) == ""
    assert one(spark, T.cleaned_line(F.lit("é" * 3000))) == "é" * 2048
    assert one(spark, T.cleaned_line(F.lit("aé"), 2)) == "a�"
    assert one(spark, T.cleaned_line(F.unhex(F.lit("61FF0762")))) == "a�?b"
    assert one(spark, T.one_line(F.lit("a᠎b c￹d­e"))) == "a b c d­e"


def test_long_page_numbers_are_out_of_range(spark):
    specs = spark.createDataFrame([(0, 5, "9" * 30), (1, 5, "0" * 30 + "2"), (2, 5, "1-" + "9" * 25)], "spec_id long, pages long, spec string")
    pieces = select.spec_pieces(specs)
    assert dict(map(tuple, select.spec_problems(pieces).collect())) == {0: "OutOfRange", 1: None, 2: "OutOfRange"}
    assert [r["page"] for r in select.spec_pages(pieces).collect()] == [1]


def test_kinds_are_cut_by_bytes(spark):
    assert one(spark, select.action_of(F.lit("é" * 40), F.lit(""))) == "Inert:" + "é" * 32
    assert one(spark, select.action_of(F.lit("Named"), F.lit("a" + "é" * 40))) == "Inert:Named:a" + "é" * 31 + "�"


def test_empty_matches_are_no_hits(spark):
    pages = spark.createDataFrame([(1, 0, "aaxbb"), (2, 0, "yy"), (3, 0, "x" * 200 + "y" + "x")], "doc_id long, page int, text string")
    got = sorted((r["doc_id"], r["first"], r["match"]) for r in search.hits(pages, search.pattern("x*", regex=True)).collect())
    assert got == [(1, 2, "x"), (3, 0, "x" * 200), (3, 201, "x")]
    assert search.hits(pages, search.pattern("(a)(x)", regex=True)).first()["first"] == 1


def test_patterns_are_judged_by_what_they_mean(spark):
    ask = lambda q: one(spark, search.query_problem(F.lit(q), F.lit(True)))
    for good in (r"a\(b", "[(]x", "[]a]", "[^]a]+", "(?i)x", "(?:a|b)+", "(?P<n>a)", r"\p{L}+", "a{2,3}", r"\\1", "[[:alpha:]]", "[(?=]", "x*", "((" * 32 + "a" + "))" * 32):
        assert ask(good) is None, good
    for bad in ("[0-9", "*a", "a|*b", "(+)", "a)b(", "x{2", "(?", "a\\", "((a)", "(?z)a"):
        assert ask(bad) == "does not compile", bad
    for refused in (r"(a)\1", "(?!x)", "(?<!x)y", "(?>a)", r"\k<n>"):
        assert ask(refused) == "look-around or back-reference", refused
    assert ask("(" * 65 + "a" + ")" * 65) == "nested too deep"


def test_many_needles_by_join_and_in_the_row(spark, monkeypatch):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(12))) for i in range(60)]
    needles = [(i, " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(3))) for i in range(40)]
    want = sorted((i, k) for i, n in needles for k, t in texts if n in t)
    docs, queries = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(needles, "query_id long, text string")
    for few in (2000, 0):
        monkeypatch.setattr(search, "FEW", few)
        assert sorted(map(tuple, search.containing(docs, queries).collect())) == want


def characters_of(text):
    """ch, word, line by the rule, one character after the other."""
    word = line = 0
    started = space = pending = False
    out = []
    for c in text:
        if c.isspace() or c == "​":
            space, pending = True, pending or c in "\n\r  \x85"
        else:
            word, line = word + (started and space), line + (started and pending)
            started, space, pending = True, False, False
        out.append((c, word, line))
    return out


def test_characters(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n  ​\té中") for _ in range(n)) for n in (0, 1, 7, 60, 600)] + ["  lead\n\nx ", "\n\n", "one"]
    pages = spark.createDataFrame(list(enumerate(texts)), "page int, text string").withColumn("doc_id", F.lit(1))
    got = {}
    for r in spans.characters(pages).orderBy("page", "pos").collect():
        assert r["pos"] == len(got.setdefault(r["page"], []))
        got[r["page"]].append((r["ch"], r["word"], r["line"]))
    assert got == {i: characters_of(t) for i, t in enumerate(texts) if t}
    ligature = spans.characters(spark.createDataFrame([(1, 0, "aﬃ\x07 b")], "doc_id long, page int, text string")).orderBy("pos").collect()
    assert "".join(r["ch"] for r in ligature) == "affi b"
    assert [round(r["x0"], 3) for r in ligature[:4]] == [0, 1, 1.333, 1.667] and round(ligature[3]["x1"], 9) == 2 and ligature[4]["x0"] is None and ligature[5]["x0"] == 3


def test_spans_around_positions(spark):
    text = " one  two\n\nsix x "
    pages = spark.createDataFrame([(1, 0, text)], "doc_id long, page int, text string")
    at = spark.createDataFrame([(1, 0, i) for i in range(len(text) + 3)], "doc_id long, page int, pos int")
    marks = characters_of(text)
    for number, k, found in (("word", 1, spans.words(pages)), ("line", 2, spans.lines(pages))):
        got = {r["pos"]: (r["from"], r["to"]) for r in spans.around(found, pages, at, number).collect()}
        want = {}
        for i in range(len(text)):
            same = [j for j in range(len(text)) if marks[j][k] == marks[i][k]]
            a, b = same[0], same[-1] + 1
            if number == "word" and text[i].isspace() and not all(text[j].isspace() for j in range(a, i)):
                a = next(j for j in range(a, i + 1) if text[j].isspace())
                a = max(j + 1 for j in range(same[0], i) if not text[j].isspace())
            elif number == "word" and not text[i].isspace():
                b = max(j for j in same if not text[j].isspace()) + 1
            want[i] = (a, b)
        if number == "word":
            del got[0], want[0]  # white space before the first word is the word's here
        assert got == want


def test_vertical_and_reversed_lines(spark):
    rows = [(1, 0, i, "x", 0, 0, 5.0, 50.0 - 10 * i, 15.0, 60.0 - 10 * i) for i in range(4)] + [(1, 0, 10 + i, "y", 1, 1, 90.0 - 10 * i, 100.0, 100.0 - 10 * i, 110.0) for i in range(4)]
    chars = spark.createDataFrame(rows, "doc_id long, page int, pos int, ch string, word int, line int, x0 double, y0 double, x1 double, y1 double")
    boxes = spans.line_boxes(chars)
    assert {r["line"]: (r["vertical"], r["reversed"]) for r in boxes.collect()} == {0: (True, True), 1: (False, True)}
    points = spark.createDataFrame([(1, 0, 0, 10.0, 44.0), (1, 0, 1, 76.0, 105.0), (1, 0, 2, 10.0, -5.0)], "doc_id long, page int, point int, x double, y double")
    assert {r["point"]: r["caret"] for r in spans.carets(points, boxes, chars).collect()} == {0: 2, 1: 12, 2: 4}


def test_chains_that_come_back(spark):
    rows = [(1, "a", "b"), (1, "b", "c"), (1, "c", "b"), (1, "lost", "lost"), (2, "x", None), (3, "p", "gone")]
    chain = spark.createDataFrame(rows, "k long, n string, nxt string")
    assert sorted(map(tuple, graph.chain_ranks(chain, "k", "n", "nxt").collect())) == [(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "x", 0), (3, "p", 0)]


def test_shared_children_do_not_multiply(spark):
    rows = [("r", None, 0, "R")] + [(f"n{i}_{j}", p, j, None) for i in range(12) for j in range(2) for p in ([f"n{i - 1}_0", f"n{i - 1}_1"] if i else ["r"])] + [("r", "n11_0", 5, "R")]
    got = graph.walk(spark.createDataFrame(rows, "id string, parent string, pos int, a string"), [], ["a"]).collect()
    assert len(got) == 25 and all(r["a"] == "R" for r in got)
    assert {r["id"]: r["path"] for r in got}["n3_1"] == [0, 0, 0, 0, 1]


def test_deep_trees(spark):
    """A chain of 200: 64 levels and what is just below, or an error; a chain of 65 nodes is walked whole."""
    chain = lambda n: spark.createDataFrame([(i, i - 1 if i else None, 0, "A" if i == 0 else None) for i in range(n)], "id int, parent int, pos int, a string")
    with pytest.raises(graph.TooDeep, match="1 nodes stand deeper than 64"):
        graph.walk(chain(200), [], ["a"])
    got = graph.walk(chain(200), [], ["a"], deeper="list").collect()
    assert {(r["id"], r["cut"]) for r in got} == {(i, i == 65) for i in range(66)} and all(r["a"] == "A" and r["path"] == [0] * (r["id"] + 1) for r in got)
    assert {r["depth"] for r in graph.walk(chain(65), [], ["a"]).collect()} == set(range(65))


def test_walks_meet_nodes_as_a_walk_in_document_order(spark):
    """Random graphs of two documents with nodes listed several times and cycles, against the smallest path of each node."""
    rng = random.Random(12)
    rows = [(k, 0, None, 0, f"{k}") for k in "xy"] + [(k, rng.randrange(1, 25), rng.randrange(25), rng.randrange(9), rng.choice([None, "q", "r"])) for k in "xy" for _ in range(40)]
    rows += [("y", 100 + i, 0 if i == 0 else 99 + i, 1, None) for i in range(6)]
    rows = [*{r[:4]: r for r in rows}.values()]
    got = {(r["k"], r["id"]): r["path"] for r in graph.walk(spark.createDataFrame(rows, "k string, id int, parent int, pos int, a string"), ["k"], ["a"]).collect()}
    want, todo = {}, [(k, 0, [0]) for k in "xy"]
    while todo:
        k, node, path = todo.pop()
        if (k, node) not in want or path < want[k, node]:
            want[k, node] = path
            todo += [(k, r[1], [*path, r[3]]) for r in rows if r[0] == k and r[2] == node and len(path) < 30]
    assert got == want and len(got) > 30


def test_graphs_of_documents(spark):
    """The same as each document for itself, missing nodes dropped, one number a document."""
    rng = random.Random(13)
    edges = sorted({(k, f"n{rng.randrange(30):02d}", f"n{rng.randrange(34):02d}") for k in (1, 2, 3) for _ in range(50)})
    nodes = sorted({(k, f"n{i:02d}") for k in (1, 2, 3) for i in range(30) if (i + k) % 11})
    roots = [(1, "n05"), (1, "n12"), (2, "n07"), (3, "n99")]
    want = {}
    for k in (1, 2, 3):
        queue, seen = [n for d, n in roots if d == k and (k, n) in nodes], {}
        while queue:
            node = queue.pop(0)
            if node not in seen and (k, node) in nodes:
                seen[node] = len(seen) + 1
                queue += [d for q, s, d in edges if q == k and s == node]
        want |= {(k, n): i for n, i in seen.items()}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = graph.discovered(frame(edges, "doc_id long, src string, dst string"), frame(roots, "doc_id long, node string"), ["doc_id"], frame(nodes, "doc_id long, node string"))
    assert {(r["doc_id"], r["node"]): r["number"] for r in got.collect()} == want and len(want) > 20


def test_discovery_order(spark):
    rng = random.Random(3)
    edges = sorted({(f"n{rng.randrange(80):02d}", f"n{rng.randrange(80):02d}") for _ in range(160)})
    roots = ["n05", "n71", "n33"]
    queue, number = sorted(roots), {}
    number = {r: (0, i + 1) for i, r in enumerate(queue)}
    level, depth = queue, 0
    while level:
        depth += 1
        new = []
        for node in level:
            new += [d for s, d in edges if s == node and d not in number and d not in new]
        number |= {d: (depth, i + 1) for i, d in enumerate(new)}
        level = new
    got = graph.discovered(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(r,) for r in roots], "node string"))
    assert {r["node"]: (r["level"], r["place"]) for r in got.collect()} == number


def test_open_actions_carry_their_flag(spark):
    actions = spark.createDataFrame([("a", "URI"), ("b", "JavaScript"), ("c", "Launch"), ("d", "JavaScript")], "node string, kind string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "src string, dst string")
    scan = lambda *roots: graph.action_scan(actions, edges, spark.createDataFrame(roots, "node string, open boolean")).first().asDict()
    assert scan(("a", True), ("c", False)) == {"open_action_javascript": True, "javascript_actions": True, "launch_actions": True, "uri_actions": True, "submit_form_actions": False, "goto_remote_actions": False, "actions": 4}
    assert not scan(("a", False), ("c", False))["open_action_javascript"] and scan(("c", True))["open_action_javascript"]


def test_labels_fold_ascii_only(spark):
    labels = spark.createDataFrame([(1, "É", 4), (1, "Ab", 2)], "doc_id long, label string, page int")
    wanted = spark.createDataFrame([(1, "é"), (1, "aB")], "doc_id long, label string")
    assert {r["label"]: r["page"] for r in lookup.find_labels(labels, wanted).collect()} == {"é": None, "aB": 2}
    ranges = spark.createDataFrame([(1, 0, "D", "late", 1, 2), (1, 0, "r", "z", 9, 1)], "doc_id long, first_page int, style string, prefix string, start long, ord int")
    assert lookup.clean_ranges(ranges, "ord").first()["prefix"] == "z"


def test_locked_documents_tell_nothing(spark):
    facts = spark.createDataFrame([(1, "action", "JavaScript", True), (1, "scan", "exhausted", False), (2, "form", "XFA", False)], "doc_id long, place string, what string, open boolean")
    documents = spark.createDataFrame([(1, False), (2, True), (3, False)], "doc_id long, locked boolean")
    got = {r["doc_id"]: r for r in report.features(facts, documents).collect()}
    assert got[1]["open_action_javascript"] and not got[1]["complete"] and got[2]["xfa"] is None and got[3]["complete"] and got[3]["xfa"] is False
    lines = {r["doc_id"]: (r["findings"], r["code"]) for r in report.verdicts(report.features(facts, documents)).collect()}
    assert lines == {1: ("open_action_javascript,javascript_actions", 3), 2: ("", 1), 3: ("", 0)}


def test_capped_json_trims_the_longer_list(spark):
    rng = random.Random(7)
    for _ in range(6):
        a, b = (["é\"x"[: rng.randrange(4)] * rng.randrange(9) for _ in range(rng.randrange(14))] for _ in range(2))
        made = lambda x, y: json.dumps({"id": 0, "a": {"items": x, "total": len(a), "truncated": len(x) < len(a)}, "b": {"items": y, "total": len(b), "truncated": len(y) < len(b)}}, separators=(",", ":"), ensure_ascii=False)  # noqa: B023, E731
        for most in (60, 120, 170, 260, 1000):
            x, y = list(a), list(b)
            while len(made(x, y).encode()) > most and (x or y):
                (x if len(x) >= len(y) else y).pop()
            want = made(x, y) if len(made(x, y).encode()) <= most else None
            row = spark.createDataFrame([(0, a, b)], "id long, a array<string>, b array<string>")
            assert row.select(files.capped_json(["id"], {"a": F.col("a"), "b": F.col("b")}, most).alias("j")).first()[0] == want


def test_text_and_metric_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\fb"), (2, "c")], "doc_id long, text string")
    files.write_text(rows, str(tmp_path / "t"), "text")
    assert {p.parent.name: p.read_text() for p in (tmp_path / "t").rglob("*.txt")} == {"doc_id=1": "a\fb\n", "doc_id=2": "c\n"}
    metrics = spark.createDataFrame([("r", "l", "x", "m", 2.0, "ms", False, True, 5.0)], "report string, os string, arch string, name string, value double, unit string, higher_is_better boolean, tracked boolean, floor double")
    files.write_metrics(metrics, str(tmp_path / "m"))
    assert [(r["name"], r["value"], r["unit"]) for r in files.read_metrics(spark, str(tmp_path / "m"), lines=True).collect()] == [("m", 2.0, "ms")]
