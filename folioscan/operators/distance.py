"""Edit distances of pairs of texts: one pair with Python's long numbers, or many pairs at once in numpy."""

from __future__ import annotations

import numpy as np

#: Words of 64 bits that a group of pairs has side by side, words of the tables of its letters, and pairs from which a group pays.
WORDS, TABLE, LEAST = 8192, 1 << 21, 16


def edit_distance(a: str, b: str) -> int:
    """Edit distance of two texts, a whole column of the table at once: the bits of two numbers tell where it rises and falls."""
    if len(a) < len(b):
        a, b = b, a
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    a, b = a[start:], b[start:]
    end = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), len(b))
    a, b = a[: len(a) - end], b[: len(b) - end]
    places: dict[str, list[int]] = {}
    for i, c in enumerate(a):
        places.setdefault(c, []).append(i)
    rows = {}
    for c in set(b) & places.keys():
        bits = bytearray(len(a) // 8 + 1)
        for i in places[c]:
            bits[i >> 3] |= 1 << (i & 7)
        rows[c] = int.from_bytes(bits, "little")
    whole = (1 << len(a)) - 1
    up, down = whole, 0
    for at in range(0, len(b), 64):
        for c in b[at : at + 64]:
            same = rows.get(c, 0)
            level = (((same & up) + up) ^ up) | same | down
            fall, flat = (up & level) << 1, ((up | level) ^ down) << 1
            both = level & flat
            up, down = (flat ^ both) | fall, level ^ both
        up, down = up & whole, down & whole  # what has grown beyond the text touches nothing below it
    return len(b) + up.bit_count() - down.bit_count()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _common(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int]:
    """The letters that both have, and a number above all letters."""
    top = int(max(x.max(), y.max())) + 1
    seen = np.zeros((2, top), bool)
    seen[0, x] = seen[1, y] = True
    return np.flatnonzero(seen[0] & seen[1]), top


def _first(differ: np.ndarray) -> int:
    at = int(differ.argmax()) if len(differ) else 0
    return at if len(differ) and differ[at] else len(differ)


def trimmed(a: str, b: str) -> tuple[int, int, int, int, int]:
    """Of two texts without their common start and end: where they start, the lengths of the longer and the shorter, a bound of their
    distance, and how many letters they share.  The bound keeps to the start up to the best place, then to the end."""
    x, y = _codes(a), _codes(b)
    if len(x) < len(y):
        x, y = y, x
    start = _first(x[: len(y)] != y)
    x, y = x[start:], y[start:]
    end = _first(x[len(x) - len(y) :][::-1] != y[::-1])
    x, y = x[: len(x) - end], y[: len(y) - end]
    m, n = len(x), len(y)
    if not n:
        return start, m, n, m, 0
    gain = np.cumsum((x[:n] != y).astype(np.int64) - (x[m - n :] != y))
    return start, m, n, int(np.count_nonzero(x[m - n :] != y) + min(0, gain.min())) + m - n, len(_common(x, y)[0])


def groups(m: np.ndarray, n: np.ndarray, letters: np.ndarray) -> list[np.ndarray]:
    """Pairs of like lengths, as many as WORDS and TABLE allow."""
    words = -(-m // 64)
    steps = np.floor(np.log(m) / np.log(1.5))
    out, of, widest, known = [], [], 0, 0
    for i in np.lexsort((-n, -steps)).tolist():
        wide, more = max(widest, int(words[i])), known + int(letters[i])
        if of and ((len(of) + 1) * wide > WORDS or (more + 1) * wide > TABLE):
            out.append(np.array(of))
            of, wide, more = [], int(words[i]), int(letters[i])
        of.append(i)
        widest, known = wide, more
    return [*out, np.array(of)] if of else out


def together(pairs: list[tuple[str, str]], start: np.ndarray, m: np.ndarray, n: np.ndarray, bound: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Distances of a group of pairs, all of which have letters left; the other arguments are those of ``trimmed``.

    The table of each pair has the longer text downwards in blocks of 64 rows, of which the next starts a column after the one above
    it, so a step takes one column of each block of all pairs.  All pairs end in the same column; before its first one nothing
    rises from the top, which leaves a pair as it is.  Blocks that lie wholly where paths exceed the bound are left out.
    Bits: ``up`` and ``down``, where the table rises and falls downwards; ``fall`` and ``flat``, where it falls and where it does not
    rise from column to column, of which ``edge`` holds the last row of each block for the next one.
    """
    wide, long, late, p = int(-(-m.max() // 64)), int(n.max()), n.max() - n, len(pairs)
    table = np.zeros(long + wide * (1 + int(letters.sum())), np.uint64)  # at the front what the first steps leave out, then a row without matches
    at = np.zeros((long, p), np.int64)  # last columns first: where the row of the column's letter is
    base = wide
    for k, (a, b) in enumerate(pairs):
        x, y = (a, b) if len(a) >= len(b) else (b, a)
        s = int(start[k])
        x, y = _codes(x[s : s + int(m[k])]), _codes(y[s : s + int(n[k])])
        both, top = _common(x, y)
        row = np.full(top, -1, np.int64)
        row[both] = base + wide * np.arange(len(both))
        here = row[x]
        i = np.flatnonzero(here >= 0)
        np.bitwise_or.at(table, long + here[i] + (i >> 6), np.uint64(1) << (i & 63).astype(np.uint64))
        at[: len(y), k] = np.maximum(row[y[::-1]], 0)
        base += wide * len(both)
    at += np.arange(1, long + 1)[:, None]
    low, high = int(((m - n - bound) // 2 - late).min()), int((-((n - m - bound) // 2) - late).max())
    size, starts = wide * p, int(late.max()) + 1  # columns in which the top may have to change
    down, up, (level, flat, fall, same) = np.zeros(size, np.uint64), np.full(size, ~np.uint64(0)), np.empty((4, size), np.uint64)
    edges = np.zeros((2, 2, size + p), np.uint64)  # of this column and of the next: flat, fall
    edges[0, 0, :p] = late > 0
    at, last, first, end = at.reshape(-1), np.array(63, np.uint64), -1, -1
    and_, or_, xor, add, shift = np.bitwise_and, np.bitwise_or, np.bitwise_xor, np.add, np.right_shift
    for t in range(long + wide - 1):
        now = max(0, t - long + 1, -((63 - t - low) // 65)), min(wide, t + 1, (high + t) // 65 + 1)
        if now != (first, end):
            first, end = now
            i, j = first * p, end * p
            v, n_, h, d, u, e = (x[i:j] for x in (level, flat, fall, down, up, same))
            reads, writes = [(x[0, i:j], x[1, i:j]) for x in edges], [(x[0, i + p : j + p], x[1, i + p : j + p]) for x in edges]
        (flat_in, fall_in), (flat_out, fall_out) = reads[t & 1], writes[1 - (t & 1)]
        k = (long - 1 - t) * p
        table[t:].take(at[k + i : k + j], mode="wrap", out=e)
        or_(e, fall_in, e)
        and_(e, u, v)
        add(v, u, v)
        xor(v, u, v)
        or_(v, e, v)
        or_(v, d, v)
        and_(u, v, h)
        or_(u, v, n_)
        xor(n_, d, n_)
        shift(n_, last, flat_out)
        shift(h, last, fall_out)
        add(n_, n_, n_)
        or_(n_, flat_in, n_)
        add(h, h, h)
        or_(h, fall_in, h)
        and_(v, n_, e)
        xor(v, e, d)
        xor(n_, e, u)
        or_(u, h, u)
        if first:
            edges[1 - (t & 1), :, i : i + p] = 0
        elif t < starts:
            edges[1 - (t & 1), 0, :p] = late > t + 1
    inside = np.clip(m - 64 * np.arange(wide)[:, None], 0, 64).astype(np.uint64)
    mask = np.where(inside == 64, ~np.uint64(0), (np.uint64(1) << (inside & last)) - np.uint64(1)).reshape(-1)
    steps = np.bitwise_count(up & mask).astype(np.int64) - np.bitwise_count(down & mask)
    return n + steps.reshape(wide, p).sum(0)
