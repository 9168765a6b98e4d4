"""Periodic runs of words: stretches that repeat themselves with a smallest period q and are at least twice as long.

A run of length L >= max(LEAST, 2q) agrees with itself, q words on, over L - q >= LEAST / 2 words. So each of its words lies in
a k-gram, k = LEAST / 2, that occurs twice in the document. Repeated k-grams are found first, by hashes of the whole text
(a collision can only keep a word too many); words outside them cannot join a run, and only the stretches that survive
are searched. Most documents end here.

The search is Main and Lorentz's: a stretch is halved; a run across the middle m of period p holds a whole period on one
side, so it follows from how far the text agrees with itself, p words on, forwards and backwards from m. The halves are
searched alike. All middles and all periods of a level are handled as arrays, for the stretches of many documents at a
time. Agreement is measured with names of all 2^j-grams (equal names, equal words), so results are exact. One interval may
be found with multiples of its period: the least is its smallest period.

Spark deals documents out; a task handles whole texts. Memory in a task: the names, 4 * log2(n) bytes for each surviving word
of a chunk of about ``CHUNK`` words or one longer text.

Edge cases: words are split at the six ASCII blanks only, bytes of words are kept as they are; null and empty texts have no
words and no runs; a null doc_id stands for itself; repeated rows give equal rows; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, runs_of, short_batches

LEAST = 12
CHUNK = 1 << 19  # surviving words that are searched together
PAIRS = 1 << 20  # (middle, period) pairs in an array
CHARS = 4 << 20  # bytes of text that are split at a time

RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def survivors(words: list[bytes], least: int = LEAST) -> np.ndarray | None:
    """Whether each word lies in a k-gram that occurs twice; None if no word does."""
    k, n = least // 2, len(words)
    if n < least:
        return None
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    gram = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        gram *= np.uint64(0x9E3779B97F4A7C15)
        gram += h[j : n - k + 1 + j]
    gram ^= gram >> np.uint64(29)
    ordered = np.sort(gram)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return None
    at = np.minimum(np.searchsorted(twice, gram), len(twice) - 1)
    hit = (twice[at] == gram).astype(np.int32)
    edge = np.zeros(n + 1, np.int32)
    edge[: n - k + 1] += hit
    edge[k:] -= hit
    return np.cumsum(edge)[:n] > 0


def stretches(mask: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Maximal (begin, end) of True, of at least ``least`` words."""
    step = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(a, b) for a, b in zip(step[::2].tolist(), step[1::2].tolist()) if b - a >= least]


class Names:
    """Names of the 2^j-grams of an array of word numbers; windows that leave the array have names of their own."""

    def __init__(self, words: np.ndarray, longest: int):
        n = len(words)
        outside = lambda a: -1 - np.arange(a, n + 1, dtype=np.int32)
        self.level = [np.concatenate([words.astype(np.int32), outside(n)])]
        while (1 << len(self.level)) <= longest:
            half = 1 << (len(self.level) - 1)
            last = self.level[-1]
            m = n - 2 * half + 1
            if m <= 0:
                break
            pair = last[:m].astype(np.int64) * (1 << 31) + last[half : half + m]
            self.level.append(np.concatenate([np.unique(pair, return_inverse=True)[1].astype(np.int32), outside(m)]))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j)."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            got += (self.level[k][i + got] == self.level[k][j + got]).astype(np.int64) << k
        return got

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i backwards equal those from j backwards (i < j; i may be -1)."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            a, b = i - got - (1 << k) + 1, j - got - (1 << k) + 1
            got += ((a >= 0) & (self.level[k][np.maximum(a, 0)] == self.level[k][np.maximum(b, 0)])).astype(np.int64) << k
        return got


def _ragged(sizes: np.ndarray):
    """(owner, 1..size) for each owner, at most PAIRS at a time or one longer owner."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        own = np.repeat(np.arange(i, j), sizes[i:j])
        yield own, np.arange(len(own)) - np.repeat(ends[i:j] - sizes[i:j] - before, sizes[i:j]) + 1
        i = j


def main_lorentz(words: np.ndarray, spans: list[tuple[int, int]], least: int = LEAST) -> np.ndarray:
    """Runs (start, end, smallest period) of at least ``least`` words within the spans of the array, which are set apart by words
    that occur once. Sorted by start, then end."""
    names = Names(words, max(b - a for a, b in spans))
    two = names.level[min(1, len(names.level) - 1)]
    nodes = np.array(spans, np.int64)
    found = [np.zeros((0, 3), np.int64)]
    while len(nodes := nodes[nodes[:, 1] - nodes[:, 0] >= least]):
        lo, hi = nodes[:, 0], nodes[:, 1]
        mid = (lo + hi) // 2
        for right in (False, True):  # the side that holds a whole period
            for own, p in _ragged(hi - mid if right else mid - lo):
                m = mid[own]
                i, j = (m, m + p) if right else (m - p, m)
                # one of both agreements has at least 3 words, or the run were shorter
                keep = (two[i] == two[j]) | (i >= 2) & (two[np.maximum(i - 2, 0)] == two[np.maximum(j - 2, 0)])
                i, j, p = i[keep], j[keep], p[keep]
                a, b = i - names.backward(i - 1, j - 1), j + names.forward(i, j)
                run = (b - a >= 2 * p) & (b - a >= least)
                found.append(np.stack([a[run], b[run], p[run]], 1))
        nodes = np.concatenate([np.stack([lo, mid], 1), np.stack([mid, hi], 1)])
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    return every[first]


def _search(pending: list[tuple[int, list[bytes], list[tuple[int, int]]]], least: int) -> dict[int, np.ndarray]:
    """Runs by document, of (document, words, stretches)."""
    number: dict[bytes, int] = {}
    parts, spans, at, back = [], [], 0, []
    for doc, words, own in pending:
        for a, b in own:
            parts.append([number.setdefault(w, len(number)) for w in words[a:b]])
            spans.append((at, at + b - a))
            back.append((doc, a - at))
            at += b - a + 1
    flat = np.zeros(at, np.int64)
    for k, ((a, b), ids) in enumerate(zip(spans, parts)):
        flat[a:b] = ids
        flat[b] = len(number) + k  # occurs once
    runs = main_lorentz(flat, spans, least)
    owner = np.searchsorted(np.array([a for a, _ in spans]), runs[:, 0], "right") - 1
    out: dict[int, list[np.ndarray]] = {}
    for k in np.unique(owner).tolist():
        doc, shift = back[k]
        out.setdefault(doc, []).append(runs[owner == k] + np.array([shift, shift, 0]))
    return {doc: np.concatenate(x) for doc, x in out.items()}


def find_runs(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """For each list of words its runs: (start, end, smallest period), sorted by start, then period."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    pending, held = [], 0

    def flush():
        for doc, runs in _search(pending, least).items():
            out[doc] = runs[np.lexsort((runs[:, 2], runs[:, 0]))]

    for i, words in enumerate(texts):
        mask = survivors(words, least)
        own = stretches(mask, least) if mask is not None else []
        if not own:
            continue
        size = sum(b - a for a, b in own)
        if pending and held + size > CHUNK:
            flush()
            pending, held = [], 0
        pending.append((i, words, own))
        held += size
    if pending:
        flush()
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[: len(words)] == 0).tolist()]


def periodic_runs(docs: DataFrame, schema: str, prepare, describe, least: int = LEAST) -> DataFrame:
    """Rows of ``schema`` from ``describe(doc_id, words, runs)`` for each row of ``docs`` (doc_id, text). ``prepare(doc_id, words)``
    gives the words that are searched."""
    short_batches(docs.sparkSession)
    plain = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def scan(batches):
        names = kinds = None
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in runs_of(texts, CHARS):
                words = [prepare(d, t.split()) for d, t in zip(ids[i:j], texts[i:j])]
                rows = [describe(d, w, r) for d, w, r in zip(ids[i:j], words, find_runs(words, least))]
                if names is None:
                    names, kinds = zip(*[(x.split()[0], {"long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in schema.split(", ")])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)

    return plain.mapInArrow(scan, schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the repetition that the contract plants in one of ten documents."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def summary(doc_id: int | None, words: list[bytes], runs: np.ndarray) -> tuple:
    kept = b" ".join(collapsed(words, runs))
    rows = [(int(a), int(b - a), int(p)) for a, b, p in runs]
    listed = "".join(f"{a},{length},{p}\n" for a, length, p in rows)
    a, length, p = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * length // p if rows else None
    return doc_id, len(rows), a, length, p, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text, and the text without their repetitions."""
    return periodic_runs(documents(spark, sf_dir), RESULT, planted, summary)
