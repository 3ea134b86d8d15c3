"""Secret scans: three fixed patterns, and a linear-chain conditional random field (CRF).

The CRF tags every token of a text as B (a secret begins), I (it goes on) or O.
Tokens are runs of secret-like characters.  Features: shape, length, character
mix and rarity of the token, the cue words and signs around it, and the share
of such tokens in the file.  A token's features are looked up by a key of its
own and a key of its surroundings, so a known word costs one lookup.

Decoding is exact.  A token away from cue words is O on the best path if its
margin for O, at its least over all surroundings, exceeds what any change of
the labels beside it could win (``Crf.slack``); the runs of other tokens between
such tokens are decoded by Viterbi with the moves from and to O at their ends,
which gives the best labelling of the whole text.

The model is trained on the driver by gradient ascent on the likelihood of generated
lines, so a row's result does not depend on the table it stands in.  ``train_on`` fits
one to a table's kind of text: to a bounded sample of it too (SAMPLE distinct texts of
at most SAMPLE_BYTES, those with the smallest hash, labelled by the fixed patterns).

Addresses and paths are cut into their parts, which are judged as such; of an address
with a login, the password is a token.

Defined cases: null and empty texts have no spans; the texts of repeated rows
get the same spans; an empty table has none; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.shared import text_of

KINDS = ("assign", "access", "hex", "crf")
#: Fixed values of the base.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A run of hexadecimal digits, and capitals after AKIA, of the least length; a shorter run holds no match.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
#: What every assignment holds one of, in small letters.
NAMES = ("passw", "secret", "token", "apikey", "api_key")

#: Texts in the training sample at most, and bytes of each.
SAMPLE = 600
SAMPLE_BYTES = 8_192
#: Tokens of a piece of a text in training, and pieces without a cue or a secret at most.
PIECE = 12
PLAIN = 2500

#: Prefixes of published token formats; fixed values.
FORMAT = re.compile(r"(?:xox[abeoprs]-|gh[opusr]_|github_pat_|glpat-|[spr]k_(?:live|test)_|AIza|npm_|SG\.|ya29\.|eyJ[A-Za-z0-9_\-]{8,}\.eyJ)[A-Za-z0-9_.\-]{8,}", re.A)
#: Addresses and paths, the password that an address may hold, and the parts of the rest.
LINK = re.compile(r"""(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^\s"'<>()\[\]{}|\\^`]+|(?<![A-Za-z0-9+/_.=\-])(?:(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}|~|\.{0,2})/[^\s"'<>()\[\]{}|\\^`]+""", re.A)
_LOGIN = re.compile(r"//[^\s/?#@:]*:([^\s/?#@]+)@", re.A)
_PART = re.compile(r"[A-Za-z0-9_](?:[A-Za-z0-9_\-.%+]*[A-Za-z0-9_])?", re.A)
#: Where a token stands: in running text, in an address or path, or as the password of an address.
PLACES = ("", "link", "login")

TOKEN = re.compile(r"[A-Za-z0-9_+/](?:[A-Za-z0-9_+/.\-]*[A-Za-z0-9_+/])?", re.A)
#: Tokens before and after a cue word that are near it.
NEAR = 4
CUES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "private", "access")
_CUE = re.compile(rf"(?<![A-Za-z])({'|'.join(CUES)})s?(?![A-Za-z])", re.I | re.A)
SIGNS = ("", "=", ":", '"', "'", "(", "@", "#", "other")
NEXT = ("@", ".", ":", "/", '"', "other")
FILES = ("few", "some", "many")
LABELS = 3
_O, _B, _I = range(3)
_NEVER = -1e4
#: Words remembered by a task.
_REMEMBERED = 400_000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns: whole matches, in code points."""
    small = text.lower()
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST] if any(w in small for w in NAMES) else []
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def secret_places(text: str) -> list[tuple[int, int]]:
    """Where the secrets themselves stand, for training."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    return out + [m.span() for m in ACCESS.finditer(text)] + [m.span() for m in HEX.finditer(text)]


def tokens_of(text: str) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Spans of the tokens of a text, and the PLACES of those that are not in running text, by number; addresses and paths are cut into their parts."""
    if "/" not in text:
        return [m.span() for m in TOKEN.finditer(text)], {}
    spans: list[tuple[int, int]] = []
    places: dict[int, int] = {}
    at = 0
    for link in LINK.finditer(text):
        spans += [m.span() for m in TOKEN.finditer(text, at, link.start())]
        a, at = link.span()
        login = _LOGIN.search(text, a, at)
        edges = [(a, at, 1)] if not login else [(a, login.start(1), 1), (*login.span(1), 2), (login.end(1), at, 1)]
        for b, c, place in edges:
            parts = [(b, c)] if place == 2 else [m.span() for m in _PART.finditer(text, b, c)]
            places |= {len(spans) + i: place for i in range(len(parts))}
            spans += parts
    spans += [m.span() for m in TOKEN.finditer(text, at)]
    return spans, places


def _unusual(token: str) -> int:
    """Of four letter pairs of a token, so many do not occur in common words."""
    small = token.lower()
    pairs = list(zip(small, small[1:], strict=False))
    return int(4 * sum(p not in _PAIRS for p in pairs) / max(len(pairs), 1) + 0.5)


def _shape(token: str) -> str:
    if FORMAT.match(token):
        return "format"
    if re.fullmatch(r"[+-]?[0-9]+", token):
        return "number"
    if re.fullmatch(r"[0-9.\-+/]+", token):
        return "numeric"
    if re.fullmatch(r"[0-9a-f]+", token):
        return "hex"
    if re.fullmatch(r"[A-Z0-9]+", token):
        return "capitals"
    if re.fullmatch(r"[a-z0-9]+", token):
        return "small"
    if re.fullmatch(r"[A-Za-z0-9]+", token):
        return "mixed"
    if re.fullmatch(r"[A-Za-z.\-]+", token):
        return "letters"
    return "path" if "/" in token and not re.search("[0-9]", token) else "signs"


def _bits(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def token_key(token: str, common: frozenset[str] = frozenset()) -> tuple:
    """shape, length, case, oddity, parts, commonness, digits, changes and bits of a token, all in a few steps."""
    size = len(token)
    length = "1-7" if size < 8 else "8-15" if size < 16 else "16-31" if size < 32 else "32+"
    plain = token.isascii() and token.isalpha()
    kind = "letters" if plain else _shape(token)
    if kind == "letters":
        case = "small" if token.islower() else "capitals" if token.isupper() else "title" if token[1:].islower() else "mixed"
        parts = 1 if plain else min(len(re.findall("[A-Za-z]+", token)), 4)
        odd = _unusual(token) if size > 3 else 0
        return kind, length, case, odd, parts, plain and token.lower() in common, 0, 0, 0
    digits = sum("0" <= c <= "9" for c in token) / size
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False)) / size
    return kind, length, "", False, 0, False, int(digits * 4), int(changes * 4), int(_bits(token) * 2)


def cue_of(token: str) -> str:
    """The cue word in a token, or an empty string."""
    m = _CUE.search(token)
    return m[1].lower() if m else ""


def key_features(key: tuple) -> list[str]:
    kind, length, case, odd, parts, common, digits, changes, bits = key
    out = ["bias", f"shape={kind}", f"length={length}", f"shape,length={kind},{length}"]
    if kind != "letters":
        return [*out, f"bits={bits}", f"digits={digits}", f"changes={changes}"]
    return [*out, f"odd,length={odd},{length}", f"parts={parts}", f"case,length={case},{length}", f"common={common}"]


def around_features(key: tuple, around: tuple) -> list[str]:
    """Features of a token's surroundings: cue before it, last sign before, assigned or not, sign after, joined to a foreign letter, nearness of a cue, file."""
    kind, length, case, odd, parts = key[:5]
    cue, sign, assigned, after, attached, near, file, place = around
    if place:
        return [f"place={place}", f"place,shape={place},{kind}", f"place,length={place},{length}", f"place,shape,assigned={place},{kind},{assigned}"]
    out = [f"sign={sign}", f"assigned={assigned}", f"next={after}", f"attached={attached}", f"file={file}", f"cue={cue != ''}", f"near={near}"]
    if kind == "letters":
        out.append(f"assigned,odd,parts={assigned},{odd},{parts}")
    if cue:
        out += [f"cue={cue}", f"cue,length={length}", f"cue,assigned={assigned}"]
    if near:
        out += [f"near,shape={kind}", f"near,length={length}"]
        if kind == "letters":
            out += [f"near,odd,length={odd},{length}", f"near,parts={near},{parts}", f"near,case,length={case},{length}"]
    return out


@dataclass
class Crf:
    """Weights of features for each label, and of label pairs; words that are common in the sample."""

    names: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    common: frozenset[str] = frozenset()
    known: dict[str, tuple] = field(default_factory=dict, repr=False)
    margins: dict[tuple, tuple] = field(default_factory=dict, repr=False)
    scores: dict[tuple, tuple] = field(default_factory=dict, repr=False)
    room: float | None = None

    @property
    def digest(self) -> str:
        """SHA-256 of the names, weights and words."""
        parts = (repr(sorted(self.names.items())), *(np.round(x, 9).tolist() for x in (self.weights, self.moves, self.first)), sorted(self.common))
        return hashlib.sha256(repr(parts).encode()).hexdigest()

    def emissions(self, tokens: Sequence[Sequence[str]]) -> np.ndarray:
        out = np.zeros((len(tokens), LABELS))
        for i, features in enumerate(tokens):
            out[i] = self.weights[[self.names[f] for f in features if f in self.names]].sum(axis=0)
        return out

    def viterbi(self, tokens: Sequence[Sequence[str]]) -> list[int]:
        return self.best(self.emissions(tokens).tolist())

    def best(self, emitted: Sequence[Sequence[float]], after: bool = False, before: bool = False) -> list[int]:
        """The best labels of tokens; after, before: a token labelled O stands before, after them."""
        moves = self.moves.tolist()
        start = moves[_O] if after else self.first.tolist()
        score, back = [s + e for s, e in zip(start, emitted[0], strict=True)], []
        for e in emitted[1:]:
            ways = [[score[a] + moves[a][b] for a in range(LABELS)] for b in range(LABELS)]
            back.append([max(range(LABELS), key=w.__getitem__) for w in ways])
            score = [max(w) + x for w, x in zip(ways, e, strict=True)]
        if before:
            score = [s + moves[a][_O] for a, s in enumerate(score)]
        path = [max(range(LABELS), key=score.__getitem__)]
        for b in reversed(back):
            path.append(b[path[-1]])
        return path[::-1]

    def slack(self) -> float:
        """The most that the moves of a path can win by labelling one token B or I instead of O.

        Beside that, an I after the token becomes a B, which costs that token's I minus B.
        """
        if self.room is None:
            m, most = self.moves, 0.0
            starts = [self.first, *m]
            for start, y in product(starts, (_B, _I)):
                most = max(most, start[y] - start[_O], *(start[y] + m[y, n] - start[_O] - m[_O, n] for n in (_O, _B)))
                most = max(most, start[y] + m[y, _I] - start[_O] - m[_O, _B], *(start[y] + m[y, _I] + m[_I, n] - start[_O] - m[_O, _B] - m[_B, n] for n in range(LABELS)))
            self.room = float(most)
        return self.room

    def looked_up(self, token: str, place: int = 0) -> tuple[float, float, tuple, str, bool]:
        """Margin for O beyond the slack away from cues, what an I instead of B here can win there, key, cue, and whether it is no plain word."""
        name = (token, place) if place else token
        out = self.known.get(name)
        if out is None:
            if len(self.known) > _REMEMBERED:
                self.known.clear()
            key = token_key(token, self.common)
            if (key, place) not in self.margins:
                every = np.array([self.score(key, ("", *a, "", f, PLACES[place])) for a in product(SIGNS, (False, True), NEXT, (False, True)) for f in FILES])
                self.margins[key, place] = (float((every[:, _O] - every[:, 1:].max(axis=1)).min()) - self.slack(), max(0.0, float((every[:, _I] - every[:, _B]).max())))
            out = self.known[name] = (*self.margins[key, place], key, cue_of(token), key[0] != "letters" and not place)
        return out

    def score(self, key: tuple, around: tuple) -> tuple[float, ...]:
        out = self.scores.get((key, around))
        if out is None:
            out = self.scores[key, around] = tuple(self.emissions([key_features(key) + around_features(key, around)])[0].tolist())
        return out


def surroundings(text: str, spans: Sequence[tuple[int, int]], cues: Sequence[str], at: int, file: str, place: int = 0) -> tuple:
    start, end = spans[at]
    gap = text[spans[at - 1][1] : start] if at else text[:start]
    joined = not gap.isascii() and any(map(str.isalnum, gap))
    cue = cues[at - 1] if at and not joined else ""
    signs = gap.strip()
    sign = signs[-1:] if not signs[-1:].isalnum() else ""
    after = text[end : end + 1]
    near = next((f"after{k}" for k in range(NEAR) if at - 1 - k >= 0 and cues[at - 1 - k]), "") or ("before" if any(cues[at + 1 : at + 1 + NEAR]) else "")
    attached = text[start - 1 : start].isalnum() or after.isalnum() if start else after.isalnum()
    return cue, sign if sign in SIGNS else "other", "=" in gap or ":" in gap, after if after in NEXT[:-1] and after else "other", attached, near, file, PLACES[place]


def file_kind(n_odd: int, n_tokens: int) -> str:
    share = n_odd / max(n_tokens, 1)
    return "many" if share > 0.2 else "some" if share > 0.02 else "few"


def trained(examples: Sequence[tuple[list[list[str]], list[int]]], steps: int = 120, rate: float = 0.4, ridge: float = 2e-5) -> Crf:
    """Maximum likelihood with a ridge penalty, by Adagrad on all examples at once; sums run in log space."""
    names = {f: i for i, f in enumerate(sorted({f for tokens, _ in examples for t in tokens for f in t}))}
    kinds: dict[tuple, int] = {}
    n, by_length = len(examples), {}
    for (tokens, labels), times in Counter((tuple(kinds.setdefault(tuple(t), len(kinds)) for t in tokens), tuple(y)) for tokens, y in examples).items():
        by_length.setdefault(len(tokens), []).append((tokens, labels, times))
    groups = [(np.array([t for t, _, _ in same]), np.array([y for _, y, _ in same]), np.array([c for *_, c in same]) / n) for same in by_length.values()]
    width = max(map(len, kinds))
    held = np.full((len(kinds), width), len(names))  # features of each kind of token
    for features, i in kinds.items():
        held[i, : len(features)] = [names[f] for f in features]
    weights, moves, first = np.zeros((len(names) + 1, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS)
    moves[_O, _I] = first[_I] = _NEVER
    free = moves > _NEVER
    sums = [np.full_like(x, 1e-8) for x in (weights, moves, first)]
    eye = np.eye(LABELS)

    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(steps):
        up = [np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(first)]
        each, missed = weights[held].sum(axis=1), np.zeros((len(kinds), LABELS))
        for at, gold, share in groups:
            longest = at.shape[1]
            emitted = each[at]
            ahead, behind = np.zeros_like(emitted), np.zeros_like(emitted)
            ahead[:, 0] = first + emitted[:, 0]
            for j in range(1, longest):
                ahead[:, j] = lse(ahead[:, j - 1, :, None] + moves, 1) + emitted[:, j]
            for j in range(longest - 2, -1, -1):
                behind[:, j] = lse(moves + (emitted[:, j + 1] + behind[:, j + 1])[:, None, :], 2)
            whole = lse(ahead[:, -1], 1)
            marginal = np.exp(np.minimum(ahead + behind - whole[:, None, None], 0))
            error = (eye[gold] - marginal) * share[:, None, None]
            up[2] += error[:, 0].sum(axis=0)
            for k in range(LABELS):
                missed[:, k] += np.bincount(at.ravel(), error[:, :, k].ravel(), len(kinds))
            for j in range(1, longest):
                pair = np.exp(np.minimum(ahead[:, j - 1, :, None] + moves + (emitted[:, j] + behind[:, j])[:, None, :] - whole[:, None, None], 0))
                seen = eye[gold[:, j - 1]][:, :, None] * eye[gold[:, j]][:, None, :]
                up[1] += ((seen - pair) * share[:, None, None]).sum(axis=0)
        for k in range(LABELS):
            up[0][:, k] = np.bincount(held.ravel(), np.repeat(missed[:, k], width), len(weights))
        for x, g, s in zip((weights, moves, first), up, sums, strict=True):
            g -= ridge * np.where(x > _NEVER, x, 0)
            s += g * g
            x += rate * g / np.sqrt(s)
        moves[~free], first[_I], weights[-1] = _NEVER, _NEVER, 0
    return Crf(names, weights[:-1], moves, first)


def examples_of(text: str, places: Sequence[tuple[int, int]], common: frozenset[str] = frozenset(), least: int = 8) -> list[tuple[list[list[str]], list[int]]]:
    """Labelled pieces of a text, of PIECE tokens at most; a secret that goes on into another piece begins there again, in training only."""
    spans, places_of = tokens_of(text)
    keys, cues = [token_key(text[a:b], common) for a, b in spans], [cue_of(text[a:b]) for a, b in spans]
    file = file_kind(sum(k[0] != "letters" and i not in places_of for i, k in enumerate(keys)), len(keys))
    tokens, labels, last = [], [], None
    for i, (a, b) in enumerate(spans):
        hit = next((p for p in places if a < p[1] and b > p[0] and min(b, p[1]) - max(a, p[0]) >= least), None)
        labels.append(_O if hit is None else _I if hit == last else _B)
        last = hit
        tokens.append(key_features(keys[i]) + around_features(keys[i], surroundings(text, spans, cues, i, file, places_of.get(i, 0))))
    cut = range(0, len(tokens), PIECE)
    return [(tokens[i : i + PIECE], [_B if y == _I and j == 0 else y for j, y in enumerate(labels[i : i + PIECE])]) for i in cut]


def generated() -> list[tuple[list[list[str]], list[int]]]:
    """Lines with made secrets, and lines with other numbers, the same each time."""
    out = []
    digest = lambda i, k: hashlib.sha256(f"{k}/{i}".encode()).digest()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for i in range(120):
        raw = digest(i, "secret")
        code = "".join(letters[b % 62] for b in raw)
        secrets = (code[:24], raw.hex()[:40], code[:12] + "_" + code[12:24], "AKIA" + code[:16].upper(), code[:20].lower())
        secret = secrets[i % 5]
        cue = CUES[i % len(CUES)]
        line = (f"the {cue} is {secret} for now", f'{cue} = "{secret}" here', f"{cue}: {secret}", f"use {cue} {secret} to log in")[i // 5 % 4]
        at = line.index(secret)
        out += examples_of(line, [(at, at + len(secret))])
        n = int.from_bytes(digest(i, "number")[:8], "big")
        plain = (f"call +1 ({n % 900 + 100}) 555-{n % 9000 + 1000} today", f"from 10.{n % 250}.{n // 7 % 250}.{n // 11 % 250} again", f"on 20{n % 30:02d}-0{n % 9 + 1}-1{n % 9} at 1{n % 9}:0{n % 9}", f"order {n % 10**10} of {n % 97} parts", f"see src/part{n % 40}/file_{n % 9}.py and x{n % 9}", f"card {n % 10**16:016d} was used", f"mail name.{n % 99}@mail{n % 9}.example.com", f"version {n % 9}.{n % 7}.{n % 31} of model-{n % 50} isoMorph", f"id 00{n % 10**6} in the list, token {n % 99} of the text")
        out += examples_of(plain[i % len(plain)], [])
        secret = (code[:28], raw.hex()[:31], code[:10] + "-" + code[10:20] + "-" + code[20:30], code[:16] + "/" + code[16:30])[i % 4]
        line = (f"Authorization: Bearer {secret}", f"bearer {secret} was sent", f"his key is {secret} and", f"the private key is {secret}.", f"with auth {secret}, then", f"export {cue.upper()}={secret}")[i // 4 % 6]
        at = line.index(secret)
        out += examples_of(line, [(at, at + len(secret))])
        small = "".join("abcdefghijklmnopqrstuvwxyz"[b % 26] for b in raw)
        words = [WORDS[b % len(WORDS)] for b in raw]
        secret = (small[: 12 + i % 9], small[: 12 + i % 9].upper(), "-".join(words[: 3 + i % 2]), ".".join(words[: 3 + i % 2]))[i % 4]
        line = (f"the {cue} is {secret} for now", f"{cue}: {secret}", f"{cue} {secret}", f"the {cue} was {secret}", f'{cue} = "{secret}"', f"use {secret} as {cue}")[i // 4 % 6]
        at = line.index(secret)
        out += examples_of(line, [(at, at + len(secret))])
        a, b, c = (LONG_WORDS[x % len(LONG_WORDS)] for x in raw[:3])
        plain = (f"the {cue} to {a} is {b} and {c}", f"{cue} {a} for the {b}", f"a {cue} is needed for {a}", f"{a.upper()} AND {b.upper()}", f"the well-known {a} of {b}, a {words[0]}-{words[1]} {c}", f"{cue}: please see {a}", f"{a} {b} {cue}", f"state-of-the-art {a} at www.{words[0]}{words[1]}.com", f"{a.title()} {b.title()}: {c}", f"the {small[:10]} of {a}", f"a {words[0]} {cue} of {a}", f"{words[0]}.{n % 99}@mail{n % 9}.example.com of. {cue}", f"{words[0]}.{n % 99}@mail{n % 9}.example.com {cue} = \"{code[:20]}\"", f"{words[0].upper()}!! {words[1].upper()}!! {small[:5].upper()}!! {small[5:12].upper()}!! {a.upper()}!!", f"{cue} = \"{raw.hex()[:40]}\" {small[:9]}, {words[2]} {small[9:14]}", f"{cue} = \"{code[:22]}\"\n{words[0].title()} was {a} {small[:13]}. {words[1].title()}")
        line = plain[i % len(plain)]
        out += examples_of(line, [(m.start(1), m.end(1)) for m in re.finditer('= "([^"]+)"', line)])
        out += _links(i, raw, code, cue, words, small)
    return out


def _links(i: int, raw: bytes, code: str, cue: str, words: Sequence[str], small: str) -> list[tuple[list[list[str]], list[int]]]:
    """Lines with addresses, paths, published token formats, and long and joined words near cues."""
    out = []
    n = int.from_bytes(raw[8:16], "big")
    a, b = words[4], words[5]
    far = [FOREIGN[x % len(FOREIGN)] for x in raw[:4]]
    host = (f"www.{a}.com", f"{a}-{b}.example.org", f"m.{a}{b}.net", f"{small[:6]}.io", f"10.{n % 250}.0.{n % 99}:8080")[i % 5]
    path = (f"/wiki/{a.title()}_of_{b.title()}s_by_{far[0]}", f"/{'en de fr es'.split()[n % 4]}/{n % 10**6}/", f"/{n % 40 + 1990}/{n % 12 + 1:02d}/{a}-{b}-{far[1]}.html", f"/{a}/{b}.php?id={n % 10**7}&page={n % 9}#{far[2]}", f"/docs/v{n % 9}.{n % 7}/{a}_{b}", "", f"/d/{raw.hex()[:12]}/{a}", f"/watch?v={code[:11]}", f"/{far[3]}/%C3%A9{a}%20{b}")[i % 9]
    link = f"{'https http ftp'.split()[i % 3]}://{host}{path}"
    file = (f"/usr/lib/{a}{n % 9}.{n % 20}/{b}-packages/{words[6]}_{n % 99}.py", f"./{a}/{b}/{words[6]}{n % 9}.tar.gz", f"~/{a}/.{b}/{far[0]}.conf", f"{host.split(':')[0]}/{a}/{b}", f"//{host}/{a}/{far[1]}")[i % 5]
    lines = (f"see {link} for more", f"{link}", f"the {cue} is described at {link}.", f"({link}), {cue} and {file}", f"open {file} with the {cue}", f"from {link}\n{a} {b}", f"{cue}: {link}")
    out += examples_of(lines[i % len(lines)], [])
    out += examples_of(lines[(i + 3) % len(lines)], [])
    secret = (code[:14], small[:11], code[:8] + "!" + code[8:12], f"{a}{n % 999}")[i % 4]
    line = f"{('connect to', 'see', '', cue)[i // 4 % 4]} {('postgres', 'https', 'mysql', 'redis', 'amqp')[i % 5]}://{(a, 'user', 'admin')[i % 3]}:{secret}@{host}{('/' + b, '', path)[i % 3]}"
    at = line.index(f":{secret}@") + 1
    out += examples_of(line, [(at, at + len(secret))], least=4)
    digits = str(n % 10**11).zfill(11)
    made = (f"xoxb-{digits}-{digits[::-1]}-{code[:24]}", f"ghp_{code}{code[:4]}", f"sk_live_{code[:24]}", f"eyJ{code[:17]}.eyJ{code[3:29]}.{code[::-1]}", f"AIza{code}{code[:3]}", f"glpat-{code[:20]}", f"npm_{code}{code[5:9]}", f"xoxp-{digits}-{code[:12]}")[i % 8]
    line = (f"{a} {made} {b}", f"use {made} for it", f"{cue} {made}", f"{made}", f'"{made}",')[i % 5]
    at = line.index(made)
    out += examples_of(line, [(at, at + len(made))])
    joined = (f"{a.title()}-{b.title()}", f"{a}-{words[6]}ly", f"{far[0].title()}", f"{far[1]}-{far[2]}", f"{a}.{b}", f"{far[3].upper()}")[i % 6]
    near = (f"the {cue} of {joined} and {far[2]}", f"{joined} {cue} for {a}", f"a {cue} is {joined} here", f"{cue} {joined}", f"{far[1]} {joined} with a {cue}", f"{cue}: {joined}, {far[0]}")
    return out + examples_of(near[i % 6], []) + examples_of(near[(i + 2) % 6], [])


WORDS = "apple river stone horse paper cloud green table light ocean tiger music chair brave quiet lemon eagle frost amber north candle garden silver winter".split()
LONG_WORDS = "information government understanding patience important international development technology agreement administrator performance community production traditional environment successful university management strengths rhythmically".split()
#: Long words of several languages, and inflected ones.
FOREIGN = "verwaltungsvorschriften wissenschaftlichen geschwindigkeit entschuldigung krankenversicherung bundesgerichtshof zusammenarbeit grundstuecksverkehr donaudampfschifffahrt rechtsschutzversicherung anticonstitutionnellement developpement gouvernementale malheureusement renseignements extraordinairement desarrollo investigaciones caracteristicas responsabilidades desafortunadamente internacionalmente ontwikkelingssamenwerking verantwoordelijkheid gemeenschappelijke arbeidsongeschiktheid valtioneuvoston lentokonesuihkuturbiini ihmisoikeudet yhteiskunta szczebrzeszyn przedsiebiorstwo bezpieczenstwo nejneobhospodarovavatelnejsi prvorozenstvi strzykawka counterrevolutionaries incomprehensibilities wheelchair friendly hutchison whampoa knightsbridge worcestershire thousandths lengthwise sightseeing backslash throughput birthplace heartthrob catchphrase latchstring borschts goldschmidt tchaikovsky schwarzenegger nietzsche".split()
_PAIRS = frozenset(p for w in (*WORDS, *LONG_WORDS, *FOREIGN, *CUES) for p in zip(w, w[1:], strict=False))


def common_words(texts: Sequence[str]) -> frozenset[str]:
    """Words of two texts or more."""
    seen = Counter(w for t in texts for w in {m.lower() for m in TOKEN.findall(t) if m.isalpha()})
    return frozenset(w for w, n in seen.items() if n > 1)


@cache
def model_of_lines() -> Crf:
    """The model of the generated lines alone, the same for every table; its digest tells which it is."""
    return fitted([])


def train_on(docs: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Crf:
    """A model from the distinct texts of at most ``most_bytes`` with the smallest hashes, at most ``sample``, and from generated lines."""
    rows = docs.select(text_of().alias("text")).where(F.octet_length("text") <= most_bytes).withColumn("h", F.xxhash64("text"))
    least = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    texts = [] if least is None else [r[0] for r in rows.where(F.col("h") <= least).dropDuplicates(["h"]).orderBy("h").select("text").collect()]
    return fitted(texts)


def fitted(texts: Sequence[str], plain: int = PLAIN) -> Crf:
    """A model from texts labelled by the fixed patterns and from generated lines; of pieces without a cue or a secret the first ``plain`` count."""
    examples, common, left = generated(), common_words(texts), plain
    for text in texts:
        places = secret_places(text)
        if left <= 0 and not places and not _CUE.search(text):
            continue
        for tokens, labels in examples_of(text, places, common):
            told = any(labels) or any("near=" not in t for t in tokens)
            if told or left > 0:
                left -= not told
                examples.append((tokens, labels))
    model = trained(examples)
    model.common = common
    return model


_END = (0.0, 0.0)


def crf_spans(text: str, model: Crf) -> list[tuple[int, int]]:
    """Where the best labelling of all tokens has secrets."""
    spans, places = tokens_of(text)
    known, look = model.known, model.looked_up
    tokens = [known.get(w := text[a:b]) or look(w) for a, b in spans]
    for i, place in places.items():
        tokens[i] = look(text[spans[i][0] : spans[i][1]], place)
    free = {i for i, (t, n) in enumerate(zip(tokens, [*tokens[1:], _END], strict=False)) if t[0] <= n[1]}
    cues = [t[3] for t in tokens]
    for i, cue in enumerate(cues):
        if cue:
            free.update(range(max(i - NEAR - 1, 0), min(i + NEAR + 1, len(tokens))))
    out: list[tuple[int, int]] = []
    if not free:
        return out
    file = file_kind(sum(t[4] for t in tokens), len(tokens))
    score = lambda i: model.score(tokens[i][2], surroundings(text, spans, cues, i, file, places.get(i, 0)))
    todo = sorted(free)
    at = 0
    while at < len(todo):
        to = at + 1
        while to < len(todo) and todo[to] == todo[to - 1] + 1:
            to += 1
        run = todo[at:to]
        at = to
        open_at = None
        for i, label in zip(run, model.best([score(i) for i in run], run[0] > 0, run[-1] < len(tokens) - 1), strict=True):
            if label == _B:
                open_at = len(out)
                out.append(spans[i])
            elif label == _I and open_at is not None:
                out[open_at] = (out[open_at][0], spans[i][1])
    return out


def all_spans(text: str, model: Crf) -> list[tuple[int, int, str]]:
    """The base's spans, and those of the CRF that do not meet one of them."""
    base = base_spans(text)
    added = [(a, b, "crf") for a, b in crf_spans(text, model) if not any(a < y and b > x for x, y, _ in base)]
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: Sequence[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def masked(text: str, spans: Sequence[tuple[int, int, str]], mask: str = "[SECRET]") -> str:
    """The text with each region that spans cover replaced by the mask."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])


def scanned(docs: DataFrame, model: Crf | None = None, keep: tuple[str, ...] = ("doc_id",), mask: bool = False) -> DataFrame:
    """keep, found: array of (start, end, kind), ordered by start and kind; if mask, also masked: the text without them."""
    shared = docs.sparkSession.sparkContext.broadcast(model or model_of_lines())  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            spans = [all_spans(t, shared.value) for t in texts]
            found = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in spans], pa.list_(SPAN))
            clean = [pa.array([masked(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())] if mask else []
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), found, *clean], [*keep, "found", "masked"][: len(keep) + 1 + mask])

    rows = docs.select(*keep, text_of().alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{fields}, found array<struct<start:bigint,end:bigint,kind:string>>" + ", masked string" * mask)


def digested(scan: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of base spans, the digest of the base's spans, and all spans as one string."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] != "crf")
    return scan.select(*keep, of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))
