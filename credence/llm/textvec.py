"""Vectorised text scanning: code points, character classes, segments and segment hashes as NumPy arrays.

Python loops run over distinct words only; everything per character is an array operation.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd

PUNCT, LETTER, NUMBER, SPACE, MARK, BREAK, UNKNOWN = range(7)

#: The code points of Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point."""
    by = {"L": LETTER, "N": NUMBER, "M": MARK}
    cat = unicodedata.category
    table = np.fromiter((by.get(k[0], UNKNOWN if k == "Cn" else PUNCT) for k in map(cat, map(chr, range(0x110000)))), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for positions below n."""
    if "p" not in _powers or len(_powers["p"]) < n:
        m = max(n, 1 << 18)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("p", _BASE), ("i", inverse)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["p"][:n], _powers["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Scan:
    """Texts laid end to end with one break after each: ``cp`` code points, ``cls`` classes, ``first`` and ``last``
    (exclusive) position of each text."""

    def __init__(self, texts: list[str]):
        self.joined = "\0".join(texts) + "\0"
        self.cp = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.last = np.cumsum(sizes + 1) - 1
        self.first = self.last - sizes
        self.cls = class_table()[self.cp]
        self.cls[self.last] = BREAK

    def hashes(self, starts: np.ndarray, ends: np.ndarray, cp: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each segment's code points."""
        cp = self.cp if cp is None else cp
        p, inv = _power_tables(len(cp))
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * p, out=total[1:])
        return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of letters, marks and numbers."""
        inside = np.zeros(len(self.cls) + 2, bool)
        c = self.cls
        inside[1:-1] = (c == LETTER) | (c == NUMBER) | (c == MARK)
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        return edge[::2], edge[1::2]

    def of_text(self, starts: np.ndarray) -> np.ndarray:
        """For each text, the index of its first segment; one more entry closes the last."""
        return np.append(np.searchsorted(starts, self.first), len(starts))


def _contractions(cp: np.ndarray, c: np.ndarray, start: np.ndarray) -> None:
    """Move segment starts so that 's 't 're 've 'm 'll 'd stand alone where an apostrophe begins a segment."""
    n = len(cp)
    at = np.flatnonzero((cp[:-1] == 39) & start[:-1] & (c[1:] == LETTER))
    if not len(at):
        return
    one = cp[at + 1]
    two = cp[np.minimum(at + 2, n - 1)]
    size = np.where(np.isin(one, [115, 116, 109, 100]), 1, np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 2, 0))
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    after = at + 1 + size
    start[after] |= c[after] == LETTER


def split_words(s: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Segments of the pattern: contractions, letter runs, single numbers, runs of other marks; white space is dropped."""
    c = s.cls.copy()
    c[(c == MARK) | (c == UNKNOWN)] = PUNCT
    start = np.ones(len(c), bool)
    start[1:] = (c[1:] != c[:-1]) | (c[1:] == NUMBER)
    _contractions(s.cp, c, start)
    at = np.flatnonzero(start)
    ends = np.append(at[1:], len(c))
    keep = (c[at] != SPACE) & (c[at] != BREAK)
    return at[keep], ends[keep]


def split_bytes(s: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Segments of the byte-level pattern: contractions, runs of letters, numbers or other marks, each with at most one
    leading blank, and white space, whose last character is left to what follows."""
    c = s.cls.copy()
    c[(c == MARK) | (c == UNKNOWN)] = PUNCT
    start = np.ones(len(c), bool)
    start[1:] = c[1:] != c[:-1]
    tail = np.flatnonzero((c[:-1] == SPACE) & (c[1:] != SPACE) & (c[1:] != BREAK))  # last of a run, with text after it
    start[tail] = True
    blank = tail[s.cp[tail] == 32]
    start[blank + 1] = False
    _contractions(s.cp, c, start)
    at = np.flatnonzero(start)
    ends = np.append(at[1:], len(c))
    keep = c[at] != BREAK
    return at[keep], ends[keep]


class WordIds:
    """Ids of segments through a cache of distinct segments, keyed by hash.

    ``encode`` maps a list of distinct strings to lists of ids. At most ``limit`` distinct segments are held; beyond it
    the cache starts again, which costs time but never changes a result.
    """

    def __init__(self, encode, limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.off = np.zeros(0, np.int64)
        self.cnt = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def slots(self, s: Scan, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The cache slot of each segment."""
        h = s.hashes(starts, ends)
        codes, distinct = pd.factorize(h)
        if len(self.keys) + len(distinct) > self.limit and len(self.keys):
            self._reset()
        where = np.searchsorted(self.keys, distinct)
        near = np.minimum(where, max(len(self.keys) - 1, 0))
        known = (self.keys[near] == distinct) if len(self.keys) else np.zeros(len(distinct), bool)
        slot = np.empty(len(distinct), np.int64)
        if len(self.keys):
            slot[known] = self.slot[near[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            seen = np.empty(len(distinct), np.int64)
            seen[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            a, b = starts[seen[fresh]].tolist(), ends[seen[fresh]].tolist()
            ids = self.encode([s.joined[i:j] for i, j in zip(a, b)])
            cnt = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for y in ids for x in y), np.uint32, int(cnt.sum()))
            slot[fresh] = len(self.cnt) + np.arange(len(fresh))
            self.off = np.concatenate([self.off, len(self.flat) + np.cumsum(cnt) - cnt])
            self.cnt = np.concatenate([self.cnt, cnt])
            self.flat = np.concatenate([self.flat, flat])
            order = fresh[np.argsort(distinct[fresh])]
            at = np.searchsorted(self.keys, distinct[order])
            self.keys, self.slot = np.insert(self.keys, at, distinct[order]), np.insert(self.slot, at, slot[order])
        return slot[codes]

    def ids(self, s: Scan, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and for each text (one more closes the last) where its ids begin."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(s.first) + 1, np.int64)
        slot = self.slots(s, starts, ends)
        cnt = self.cnt[slot]
        before = np.concatenate([[0], np.cumsum(cnt)])
        ids = self.flat[np.repeat(self.off[slot] - before[:-1], cnt) + np.arange(before[-1])]
        return ids, before[s.of_text(starts)]
