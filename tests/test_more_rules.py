"""Page specs, manifests, metric files, numbers, cross checks, distances, medians and as-of joins against plain versions."""

import random
import time

from pyspark.sql import functions as F

from folioscan.operators import lookup, report, revisions, select, spans
from folioscan.sources import files


def plain_spec(spec, pages):
    """Problem or pages (from 0) of a spec, piece by piece."""
    if pages == 0:
        return "NoPages", None
    spec = spec or ""
    if not spec.strip():
        return "Empty", None
    out = []
    for piece in map(str.strip, spec.split(",")):
        if not piece:
            return "Invalid", None
        start, dash, end = (x.strip() for x in piece.partition("-"))
        if "-" in end:
            return "Invalid", None
        bounds = []
        for text, open_end in ((start, 1), (end, pages)) if dash else ((piece, 0),):
            if dash and not text:
                bounds.append(open_end)
                continue
            if not (text.isascii() and text.isdigit()):
                return "Invalid", None
            if int(text) == 0:
                return "Zero", None
            if int(text) > pages:
                return "OutOfRange", None
            bounds.append(int(text))
        if dash and not start and not end:
            return "Invalid", None
        if bounds[0] > bounds[-1]:
            return "Backwards", None
        out += [n - 1 for n in range(bounds[0], bounds[-1] + 1) if n - 1 not in out]
    return None, out


def test_specs(spark):
    rng = random.Random(4)
    specs = ["1 2", "25-0", "0-x", "1 - 3", " 4 ,\t5 ", "x-0", "21-x", "x-21", "3-2", "1-2-3", "--", " - ", ",", "1,", " 2 ", "+1", "１", None, "00003", "5-", "-5", " "]
    specs += ["".join(rng.choice("0123 -,,x") for _ in range(rng.randrange(7))) for _ in range(300)]
    rows = [(i, 0 if i % 41 == 40 else 20, s) for i, s in enumerate(specs)]
    pieces = select.spec_pieces(spark.createDataFrame(rows, "spec_id long, pages long, spec string"))
    want = {i: plain_spec(s, n) for i, n, s in rows}
    assert dict(map(tuple, select.spec_problems(pieces).collect())) == {i: p for i, (p, _) in want.items()}
    got = {}
    for r in select.spec_pages(pieces).orderBy("spec_id", "ord").collect():
        got.setdefault(r["spec_id"], []).append(r["page"])
    assert got == {i: p for i, (_, p) in want.items() if p}


def test_manifest_rows_lack_nothing(spark):
    good = ("d-1", "https://x/1", "a" * 64, "MIT", ["a"], "from x", None)
    rows = [good, ("d-2\n", *good[1:]), (*good[:2], "a" * 64 + "\n", *good[3:]), ("d-4", None, None, None, None, None, None), (None, *good[1:]), ("d-6", *good[1:3], " ", [], "\t", "\0"), ("d-7", *good[1:4], ["a", None], "x", "y" * 257)]
    table = spark.createDataFrame(rows, "id string, url string, sha256 string, license string, categories array<string>, notes string, password string")
    got = sorted(map(tuple, report.manifest_problems(table).collect()), key=str)
    want = [("d-2\n", "id"), ("d-1", "sha256"), *(("d-4", c) for c in ("url", "sha256", "license", "notes", "categories")), (None, "id"), *(("d-6", c) for c in ("license", "categories", "notes", "password")), ("d-7", "categories"), ("d-7", "password")]
    assert got == sorted(want, key=str)


def test_metric_files_round_trip(spark, tmp_path):
    rows = [("r1", "l", "x", "m", 2.0, "ms", False, True, 5.0, 7), ("r1", "l", "x", "k", 3.0, "ms", True, False, 1.0, 7), ("r2", "w", "y", "m", 4.0, "s", False, True, 5.0, 3)]
    metrics = spark.createDataFrame(rows, "report string, os string, arch string, name string, value double, unit string, higher_is_better boolean, tracked boolean, floor double, runs int")
    cold = spark.createDataFrame([("r1", "l", "x", "open", 9.0), ("r1", "l", "x", "first page", 11.0)], "report string, os string, arch string, name string, value double")
    path = str(tmp_path / "m")
    files.write_metrics(metrics, path, cold)
    got = files.read_metrics(spark, path, lines=True)
    assert sorted(map(tuple, got.collect())) == sorted((os, arch, runs, *rest) for _, os, arch, *rest, runs in rows)
    assert sorted(map(tuple, files.read_cold(spark, path, lines=True).collect())) == [("l", "x", 7, "first page", 11.0), ("l", "x", 7, "open", 9.0)]
    again = str(tmp_path / "n")
    named = F.concat_ws("/", "os", "arch")
    files.write_metrics(got.withColumn("report", named), again, files.read_cold(spark, path, lines=True).withColumn("report", named))
    assert sorted(map(tuple, files.read_metrics(spark, again, lines=True).collect())) == sorted(map(tuple, got.collect()))
    assert files.read_cold(spark, again, lines=True).count() == 2


def test_numbers_start_at_the_declared_size(spark):
    frame = spark.createDataFrame
    base, added = frame([(1, 4), (2, 9)], "doc_id long, num long"), frame([(1, 1), (1, 2), (2, 1), (3, 1), (4, 5)], "doc_id long, seq long")
    sizes = frame([(1, 8), (2, 3), (3, 0), (5, 7)], "doc_id long, size long")
    got = sorted(map(tuple, revisions.allocated(base, added, frame([(2, 12)], "doc_id long, num long"), sizes).collect()))
    assert got == [(1, 1, 8), (1, 2, 9), (2, 1, 13), (3, 1, 1), (4, 5, 1)]


def test_cross_checks(spark):
    rng = random.Random(9)
    documents, states, pages, repairs, want = [], [], [], [], set()
    for i in range(60):
        n, state, unlocked = rng.randrange(6), rng.choice([None, None, None, "unreadable", "unsettled", "locked"]), rng.choice([True, False, None])
        walk, fixed = [rng.random() < 0.8 for _ in range(rng.randrange(9))], rng.sample(["xref-rebuilt", "length-fixed"], rng.randrange(3))
        documents.append((i, n))
        states.append((i, state, unlocked))
        pages += [(i, k, ok) for k, ok in enumerate(walk)]
        repairs += [(i, c) for c in fixed]
        if state in ("unreadable", "unsettled") or (state == "locked" and not unlocked):
            want.add((i, f"cos-{state}", 1))
            continue
        walked = bad = 0
        for ok in walk:
            walked, bad = walked + ok, bad + (not ok)
            if walked > n:
                break
        want |= {(i, "cos-page-unreadable", bad)} if bad else set()
        want |= {(i, "page-count-mismatch", 1)} if walked != n else set()
        want |= {(i, c, 1) for c in fixed}
    frame = spark.createDataFrame
    got = lookup.cross_check(frame(documents, "id long, pages long"), frame(states, "id long, state string, unlocked boolean"), frame(pages, "id long, page int, ok boolean"), frame(repairs, "id long, code string"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and {c for _, c, _ in want} >= set(lookup.CROSS_CHECKS)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_edit_distance(spark):
    rng = random.Random(6)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abé日\U0001f642"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(40))) for _ in range(2))
        b = rng.choice([b, a[: len(a) // 2] + b, a, a[1:], b + a])
        assert report.edit_distance(a, b) == plain_distance(a, b), (a, b)
    pairs = [("".join(rng.choice("abcdefgh") for _ in range(6000)), "".join(rng.choice("abcdefgh") for _ in range(5500))) for _ in range(8)]
    began = time.time()
    got = [report.edit_distance(a, b) for a, b in pairs]
    bits = time.time() - began
    table = spark.createDataFrame(pairs, "a string, b string").coalesce(1).cache()
    table.count()
    began = time.time()
    assert [r[0] for r in table.select(F.levenshtein("a", "b")).collect()] == got
    assert bits < (time.time() - began) / 3


def test_median_of_a_hot_key(spark):
    rng = random.Random(7)
    rows = [("hot", float(rng.randrange(40))) for _ in range(3000)] + [(f"k{i % 50}", rng.choice([None, rng.random()])) for i in range(600)] + [(None, 2.0), (None, 1.0), ("one", None)]
    values = {}
    for k, v in rows:
        values.setdefault(k, []).append(v)
    want = {k: sorted(v, key=lambda x: (x is not None, x or 0))[len(v) // 2] for k, v in values.items()}
    got = report.upper_median(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()
    assert {r["k"]: r["median"] for r in got} == want and len(got) == len(want)


def test_as_of_over_ranges_equals_the_window(spark):
    rng = random.Random(8)
    left = spark.createDataFrame([(rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(400), i) for i in range(900)], "k string, t int, n int")
    right = spark.createDataFrame([(rng.choice(["hot", "a", None]), rng.randrange(400), i % 7, i) for i in range(120)], "k string, s int, o int, v int")
    both = [sorted(map(tuple, lookup.as_of(left, right, ["k"], "t", "s", ["v"], ["o", "v"], spread=spread).collect()), key=str) for spread in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 900 and len({r[3] for r in both[0]}) > 20
    flat = [sorted(map(tuple, lookup.as_of(left.drop("k"), right.drop("k"), [], "t", "s", ["v"], ["o", "v"], spread=spread).collect()), key=str) for spread in (False, True)]
    assert flat[0] == flat[1] and len(flat[0]) == 900


def test_range_text_over_many_pages(spark):
    """Ranges of one page, of several bins, beyond the last page and turned round, in a document of many pages."""
    pages = {(1, i): f"page {i} of one\r\nend" for i in range(1500)} | {(2, i): f"p{i}" for i in range(3)}
    ranges = [(1, 1, 0, 2, 0, 6), (1, 2, 250, 3, 260, 4), (1, 3, 5, 0, 1400, 2), (1, 4, 1490, 1, 10**9, 5), (1, 5, 9, 0, 8, 1), (2, 6, 1, 1, 2, 1), (2, 7, 3, 0, 9, 1), (3, 8, 0, 0, 1, 1)]
    want = {}
    for doc, k, a, x, b, y in ranges:
        found = [(i, pages[doc, i][x if i == a else 0 : y if i == b else None].replace("\r\n", "\n")) for i in range(a, min(b, 1500) + 1) if (doc, i) in pages]
        if found:
            want[doc, k] = "\n".join(t for _, t in found)
    got = spans.range_text(spark.createDataFrame([(d, i, t) for (d, i), t in pages.items()], "doc_id long, page int, text string"), spark.createDataFrame(ranges, "doc_id long, range_id int, from_page int, from_pos int, to_page int, to_pos int"))
    assert {(r["doc_id"], r["range_id"]): r["text"] for r in got.collect()} == want and len(want) == 5
