import re

import pytest

from folioscan.llm.license_scans import PHRASES, Scanner, compiled, limits_of, scanned, template_pattern, with_char_spans, words_of
from tests.llm.conftest import awkward_rows


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_against_brute_force(awkward, some):
    for docs, rows in ((awkward, awkward_rows()), (some, [tuple(r) for r in some.collect()])):
        got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in scanned(docs).collect()), key=str)
        assert got == sorted(((r[0], *base(r[1])) for r in rows), key=str)


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Released under the MIT License.", {"mit"}), ("released under the terms of the MIT license", {"mit"}), ("Licensed under the Apache License, Version 2.0.", {"apache"}), ("licensed under the apache license 2.0", {"apache"}),
        ("licensed under the apache license version 3.0", set()), ("This work is licensed under the GNU General Public License, version 3.", {"gpl"}), ("this work is licensed under the GNU Lesser General Public License", {"gpl"}),
        ("licensed under the GNU General Public License", set()), ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}), ("Licensed under a Creative Commons CC BY 4.0", {"cc-by"}), ("licensed under permit", set()), ("released under a mit license", set()),
    ],
)
def test_templates(text, labels):
    assert {x for _, _, x in Scanner().scan(text)[2]} == labels


def language(template):
    """All texts of a template whose gaps take the word w, by expanding it."""
    parts = re.split(r"(<<.*?>>)", template)

    def expand(i, stop=None):
        out = [((), i)]
        while i < len(parts) and parts[i] != stop:
            mark = parts[i].strip("<>")
            if mark.startswith("beginOptional"):
                inner, end = expand(i + 1, "<<endOptional>>")
                choice, i = [(), *inner], end + 1
            elif mark.startswith("var"):
                o = dict(x.split("=") for x in mark.split(";")[1:])
                choice, i = [("w",) * n for n in range(int(o.get("min", 0)), int(o["max"]) + 1)], i + 1
            else:
                choice, i = [tuple(parts[i].split())], i + 1
            out = [(a + c, i) for a, _ in out for c in choice]
        return [a for a, _ in out], i

    return set(expand(0)[0])


@pytest.mark.parametrize("template", ["a b <<var;max=2>> c", "a <<beginOptional>>b <<var;min=1;max=2>><<endOptional>> c", "a <<beginOptional>>b<<beginOptional>>c<<endOptional>><<endOptional>><<var;max=1>> d"])
def test_automata_accept_the_expanded_language(template):
    import itertools

    wanted, automaton = language(template), compiled("x", template)
    for n in range(1, 6):
        for words in itertools.product("abcdw", repeat=n):
            states = automaton.closure({0})
            for w in words:
                states = automaton.step(states, w.encode())
            generic = {tuple("w" if g == "w" else x for g, x in zip(w, words, strict=True)) for w in wanted if len(w) == n}
            fits = any(all(g in ("w", x) for g, x in zip(w, words, strict=True)) for w in wanted if len(w) == n)
            assert (automaton.final in states) == fits, (words, generic)


def test_spans_of_characters():
    text = "É x. MIT  License!"
    assert [text[a:b] for a, b in with_char_spans(text, [(2, 4)])] == ["MIT  License"]
    assert words_of("A1-b É") == [b"a1", b"b", "É".encode()]


def test_scores_and_empty(awkward, nothing):
    assert {r["score"] for r in scanned(awkward).collect()} <= {0.0, 0.5, 1.0}
    assert scanned(nothing).count() == 0


def test_bad_templates():
    for bad in ("<<var;max=2>> a", "<<beginOptional>>a<<endOptional>>", "a <<beginOptional>> b"):
        with pytest.raises(ValueError):
            compiled("x", bad)


def test_published_markup():
    """Replaceable regions with quoted options and match patterns, on whole license texts."""
    template = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted<<beginOptional>>, provided that the above copyright notice and this permission notice appear in all copies<<endOptional>>.
    THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="copyrightHolderAsIs";original="THE AUTHOR";match=".+">> DISCLAIMS ALL WARRANTIES <<var;name="x";original="";match=".{0,20}">> INCLUDING ALL IMPLIED WARRANTIES"""
    auto = compiled("isc", template)
    text = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
    the software is provided as is and {} disclaims all warranties {} including all implied warranties more"""
    for holder, between, fits in (("the author", "", True), ("Internet Systems Consortium " * 40, "of any kind", True), ("", "", False), ("x", "w " * 12, False)):
        words = words_of(text.format(holder, between))
        assert (auto.longest(words, 0) == len(words) - 1) is fits, (holder, between)
    assert auto.longest(words_of(text.format("x", "").replace("all copies", "most copies")), 0) is None
    assert limits_of(";max=4") == (0, 4) and limits_of(';name="a;b";match=".{1,9}"') == (1, 5) and limits_of("") == (0, None)


def test_regions_of_any_length_take_one_walk():
    """The same runs as from each start, and work that grows with the text."""
    import random
    import time

    rng = random.Random(11)
    for template in ('a <<var;match=".+">> b', "a <<beginOptional>>b <<var>> a<<endOptional>> b <<var;min=2>> c", 'a b <<var;match=".*">> <<beginOptional>>c<<endOptional>> a'):
        auto = compiled("x", template)
        assert auto.unbounded
        for _ in range(150):
            words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(14))]
            firsts = auto.first_words
            assert auto.all_longest(words) == [(i, e) for i, w in enumerate(words) if w in firsts and (e := auto.longest(words, i)) is not None]
    scanner = Scanner([("x", 'licensed under <<var;match=".+">> terms end')])
    seconds = []
    for n in (4000, 16_000):
        text = "licensed under the words of terms " * (n // 6) + "end"
        began = time.time()
        _, _, found = scanner.scan(text)
        seconds.append(time.time() - began)
        assert len(found) == n // 6
    assert seconds[1] < 12 * seconds[0] and seconds[1] < 5


def test_sql_reads_options_as_the_automaton_does():
    import re

    for template in ('hold <<var;match=".+">> fast', 'hold <<var;match=".{0,20}">> fast', "hold <<var;min=1;max=2>> fast <<beginOptional>>now<<endOptional>> then", 'hold <<var;match=".*">> fast'):
        auto, pattern = compiled("x", template), re.compile(template_pattern(template))
        for k in range(16):
            for tail in ("", " now", " then", " now then"):
                text = "we hold" + " w" * k + " fast" + tail
                words = words_of(text)
                assert bool(pattern.search(" " + " ".join(w.decode() for w in words))) == any(auto.longest(words, i) is not None for i in range(len(words))), (template, text)


def test_wording_of_published_licenses(spark):
    """Notices of common licenses, as they stand in files."""
    notices = {
        "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "bsd": "Neither the name of the Example Institute of Technology nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "unlicense": "This is free and unencumbered software released into the public domain.",
    }
    docs = spark.createDataFrame([(k, t) for k, t in notices.items()], "doc_id string, text string")
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in scanned(docs).collect()} == {k: (k, 1.0) for k in notices}
