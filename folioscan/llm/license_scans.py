"""License scans by template markup.

A template is a wording with marked regions, in the notation of public license
lists: ``<<beginOptional>> ... <<endOptional>>`` may be absent, and
``<<var;max=N>>`` stands for 0 to N words of any kind (``min=M`` asks for M).
A template is compiled into an automaton over words; a text holds it where the
automaton accepts consecutive words, so all mandatory wording must match
exactly.  Words are lower-cased runs of digits, letters and non-ASCII
characters.

An automaton is only started at words that can begin it, and only in texts
that hold all words without which it does not match.  One with a region of any number of
words goes once over the text, from its end, so that the work grows with the text.

Defined cases: null and empty texts have no words, labels or places and score
0; repeated rows are judged alike; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from folioscan.llm.shared import text_of

#: Fixed values of the base: phrase, label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, template.
TEMPLATES = (
    ("mit", "released under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<var;max=4>> to deal in the <<var;max=2>> without restriction"),
    ("apache", "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 0"),
    ("gpl", "this <<var;min=1;max=4>> is <<beginOptional>>free software and is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public license <<beginOptional>>version <<var;max=3>><<endOptional>>"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu <<beginOptional>>lesser<<endOptional>> general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by nc <<beginOptional>><<var;min=1;max=1>> 0<<endOptional>>"),
    ("cc-by", "licensed under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by <<var;min=1;max=1>> 0"),
    ("mpl", "subject to the terms of the mozilla public license <<beginOptional>>v<<endOptional>> 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of <<var;min=1;max=12>> the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use <<var;min=1;max=4>> except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public license for more details"),
    ("bsd", "neither the name of <<var;min=1;max=12>> nor the names of <<var;min=1;max=3>> contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose"),
    ("proprietary", "all rights reserved <<var;max=6>> may not be <<beginOptional>>copied or<<endOptional>> redistributed"),
)

#: A-Z to a-z; ASCII that is neither digit nor letter to blank.
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Automaton:
    """States 0..n; from a state: words to states, states reached without a word, and the state reached by any word."""

    label: str
    words: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    empty: list[list[int]] = field(default_factory=lambda: [[]])
    any_word: list[int | None] = field(default_factory=lambda: [None])
    final: int = 0
    mandatory: set[bytes] = field(default_factory=set)

    def _state(self) -> int:
        self.words.append({})
        self.empty.append([])
        self.any_word.append(None)
        return len(self.words) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.empty[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def step(self, states: set[int], word: bytes) -> set[int]:
        out = {to for s in states if (to := self.words[s].get(word)) is not None}
        out |= {to for s in states if (to := self.any_word[s]) is not None}
        return self.closure(out)

    def longest(self, words: Sequence[bytes], start: int) -> int | None:
        """End of the longest accepted run that starts at word start."""
        states, at, end = self.closure({0}), start, None
        while states:
            if self.final in states:
                end = at
            if at == len(words):
                break
            states = self.step(states, words[at])
            at += 1
        return end

    @property
    def unbounded(self) -> bool:
        """Whether a region takes any number of words."""
        return any(to == s for s, to in enumerate(self.any_word))

    def all_longest(self, words: Sequence[bytes]) -> list[tuple[int, int]]:
        """Start and end of the longest accepted run of each start, from one walk over the text from its end, however long the runs are."""
        out, firsts = [], self.first_words
        after = [-1] * len(self.words)  # the furthest end from each state before the words seen so far
        for at in range(len(words), -1, -1):
            word = words[at] if at < len(words) else None
            now = [-1] * len(after)
            for s in range(len(now) - 1, -1, -1):  # moves without a word lead to later states
                far = at if s == self.final else -1
                for to in self.empty[s]:
                    far = max(far, now[to])
                if word is not None:
                    if (to := self.words[s].get(word)) is not None:
                        far = max(far, after[to])
                    if (to := self.any_word[s]) is not None:
                        far = max(far, after[to])
                now[s] = far
            if word in firsts and now[0] >= 0:
                out.append((at, now[0]))
            after = now
        return out[::-1]

    @property
    def first_words(self) -> set[bytes]:
        return {w for s in self.closure({0}) for w in self.words[s]}


#: Characters of a ``match`` pattern from which a replaceable region takes any number of words.
LONG_MATCH = 100


def limits_of(options: str) -> tuple[int, int | None]:
    """Least and most words of a replaceable region: of min and max, or of a match pattern as in published license lists.

    A pattern that may match nothing asks for no word, another for one; ``.{a,b}`` of under
    LONG_MATCH characters holds b // 2 + 1 words at most, all others any number.
    """
    given = {k: v.strip('"') for k, v in re.findall(r'(\w+)=("[^"]*"|[^;]*)', options)}
    if "match" not in given:
        return int(given.get("min", 0)), int(given["max"]) if "max" in given else None
    bounds = re.fullmatch(r"\.\{(\d+),(\d+)\}", given["match"])
    most = int(bounds[2]) // 2 + 1 if bounds and int(bounds[2]) < LONG_MATCH else None
    return 0 if re.fullmatch(given["match"], "") else 1, most


def compiled(label: str, template: str) -> Automaton:
    out, at, opened = Automaton(label), 0, []
    for mark, plain in re.findall(r"<<(.*?)>>|((?:(?!<<).)+)", template, re.S):
        kind, _, options = mark.partition(";")
        if kind == "beginOptional":
            opened.append(at)
        elif kind == "endOptional":
            new = out._state()
            out.empty[at].append(new)
            out.empty[opened.pop()].append(new)
            at = new
        elif kind == "var":
            least, most = limits_of(options)
            states = [at] + [out._state() for _ in range(least if most is None else most)]
            for a, b in zip(states, states[1:], strict=False):
                out.any_word[a] = b
            if most is None:  # a state of its own, which takes any number of words
                states.append(out._state())
                out.empty[states[-2]].append(states[-1])
                out.any_word[states[-1]] = states[-1]
            at = out._state()
            for s in states[least:]:
                out.empty[s].append(at)
        elif not mark:
            for word in words_of(plain):
                new = out._state()
                out.words[at][word] = new
                if not opened:
                    out.mandatory.add(word)
                at = new
    if opened:
        raise ValueError(f"<<beginOptional>> without <<endOptional>>: {template}")
    out.final = at
    if out.final in out.closure({0}) or any(out.any_word[s] is not None for s in out.closure({0})):
        raise ValueError(f"a template must begin with a word of its own: {template}")
    return out


class Scanner:
    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES):
        self._phrases = [(tuple(words_of(p)), label) for p, label in phrases]
        self._automata = [compiled(label, t) for label, t in templates]
        #: One word that each template cannot match without: its longest mandatory one.
        self._needed = [max(a.mandatory, key=lambda w: (len(w), w)) for a in self._automata]

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
        """Number of words; places (start, label) of base phrases; (start, end, label) of template matches."""
        words = words_of(text)
        held = set(words)
        base = []
        for phrase, label in self._phrases:
            if held.issuperset(phrase):
                k, at = len(phrase), -1
                while True:
                    try:
                        at = words.index(phrase[0], at + 1)
                    except ValueError:
                        break
                    if tuple(words[at : at + k]) == phrase:
                        base.append((at, label))
        found = []
        for automaton, needed in zip(self._automata, self._needed, strict=True):
            if needed in held and held.issuperset(automaton.mandatory):
                if automaton.unbounded:
                    found += [(a, b, automaton.label) for a, b in automaton.all_longest(words)]
                    continue
                firsts = automaton.first_words
                for at, word in enumerate(words):
                    if word in firsts and (end := automaton.longest(words, at)) is not None:
                        found.append((at, end, automaton.label))
        return len(words), sorted(base), sorted(found)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<start:long,end:long,label:string>>"


def score_of(base: Sequence, matches: Sequence) -> float:
    """1 for a whole template, 0.5 for a phrase alone, else 0."""
    return 1.0 if matches else 0.5 if base else 0.0


def scanned(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, then SCHEMA: starts and ends count words from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        matched = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
        for batch in batches:
            out = []
            for text in batch.column("_text").to_pylist():
                n, base, found = scanner.scan(text)
                starts = [s for s, _ in base]
                base_labels = sorted({x for _, x in base})
                labels = sorted({*base_labels, *(x for _, _, x in found)})
                out.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels), score_of(base, found), [{"start": a, "end": b, "label": x} for a, b, x in found]))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), matched]
            columns = [pa.array([row[i] for row in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + columns, [*keep, *(f.name for f in schema.fields[len(keep) :])])

    from pyspark.sql.types import StructType, _parse_datatype_string

    rows = docs.select(*keep, text_of().alias("_text"))
    schema = StructType([*rows.schema.fields[: len(keep)], *_parse_datatype_string(SCHEMA).fields])
    return rows.mapInArrow(run, schema)


def with_char_spans(text: str, spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans of a text as spans of code points."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans if b > a]


def template_pattern(template: str) -> str:
    """A template as a pattern over words that each follow one blank."""
    out = ""
    for mark, plain in re.findall(r"<<(.*?)>>|((?:(?!<<).)+)", template, re.S):
        kind, _, options = mark.partition(";")
        least, most = limits_of(options) if kind == "var" else (0, 0)
        out += {"beginOptional": "(?:", "endOptional": ")?", "var": f"(?: [^ ]+){{{least},{'' if most is None else most}}}"}.get(kind, "") if mark else "".join(f" {w.decode()}" for w in words_of(plain))
    return out + "(?: |$)"


def oracle_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> str:
    """DuckDB SQL for op3_license_scans."""
    places = " UNION ALL ".join(f"SELECT k, i - 1 AS pos, '{label}' AS label FROM p WHERE " + " AND ".join(f"w[i + {j}] = '{word}'" for j, word in enumerate(phrase.split())) for phrase, label in phrases)
    tests = ", ".join(f"CASE WHEN regexp_matches(j, '{template_pattern(t)}') THEN '{label}' END" for label, t in templates)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d),
b AS (SELECT k, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS l FROM ({places}) GROUP BY k),
t AS (SELECT k, doc_id, len(w)::BIGINT AS n_words, list_filter([{tests}], lambda x: x IS NOT NULL) AS m FROM (SELECT *, ' ' || array_to_string(w, ' ') AS j FROM d))
SELECT doc_id, n_words, coalesce(n, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(l, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(l, []), m))), ','), '') AS labels,
CASE WHEN len(m) > 0 THEN 1.0 WHEN n > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM t LEFT JOIN b USING (k)
"""
