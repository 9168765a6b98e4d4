"""Language identification with spans: script ranges, per-word scores, Viterbi with a switching penalty.

Every word is scored for every language by hashed character 3- and 5-grams around each of its letters (smoothed log
probabilities). The word's script leaves only the languages that were seen in that script. A Viterbi pass over the words
of a text finds the labels that maximise the scores less a penalty for each change of language; runs of one label are the
spans. The language with most letters is the document's, and its share of the letters the score.

Training counts n-grams over labelled rows; beyond ``TRAIN_ROWS`` labelled rows it takes those with the smallest hash, in
that expected number. The model has 2 * 2**BITS counters a language, whatever the corpus.

Edge cases: null, empty and letterless texts (combining marks are no letters) are ``und`` with score 0; equal totals go to the language first in order;
without any labelled row every text is ``und``; very long texts are scored in blocks; other columns pass untouched.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, runs_of, short_batches
from .textvec import LETTER, MARK, Scan

BITS = 16
TRAIN_ROWS = 50_000
SWITCH_PENALTY = 14.0
RUN_CHARS = 2_000_000
MIN_SCRIPT_SHARE = 0.01
UND = "und"

#: The first code point of each range, and the script it belongs to (0: Latin and all others).
SCRIPT_FROM = [0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xB80, 0xC00, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3130, 0x3190, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000, 0x30000]
SCRIPT_NAME = ["latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "bengali", "other", "tamil", "other", "thai", "other", "georgian", "hangul", "other", "latin", "greek", "latin", "kana", "other", "hangul", "other", "han", "other", "hangul", "other", "han", "other", "han", "other"]
SCRIPTS = sorted(set(SCRIPT_NAME))
_SCRIPT_OF = np.array([SCRIPTS.index(x) for x in SCRIPT_NAME])


@functools.cache
def lower_table() -> np.ndarray:
    """Lower case of each code point where that is one code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x20000):
        x = chr(cp).lower()
        if len(x) == 1:
            out[cp] = ord(x)
    return out


def scan_words(s: Scan):
    """Positions of letters, their two n-gram buckets, and the start of each word among those positions."""
    inside = (s.cls == LETTER) | (s.cls == MARK)
    pad = np.zeros(len(s.cp) + 4, np.uint32)
    pad[2:-2] = np.where(inside, lower_table()[s.cp], 0)
    mid, l1, r1 = pad[2:-2], pad[1:-3], pad[3:-1]
    l2 = np.where(l1 == 0, 0, pad[:-4]).astype(np.uint32)
    r2 = np.where(r1 == 0, 0, pad[4:]).astype(np.uint32)
    at = np.flatnonzero(inside)
    k = [np.uint32(x) for x in (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0x9E3779B1)]
    core = mid * k[0] + l1 * k[1] + r1 * k[2]
    three = ((core ^ (core >> np.uint32(15))) * k[4])[at] >> np.uint32(32 - BITS)
    wide = core + l2 * k[3] + r2 * np.uint32(0xD3A2646D)
    five = ((wide ^ (wide >> np.uint32(13))) * k[4])[at] >> np.uint32(32 - BITS)
    first = np.flatnonzero(l1[at] == 0)
    script = _SCRIPT_OF[np.searchsorted(SCRIPT_FROM, s.cp[at[first]], "right") - 1] if len(at) else np.zeros(0, int)
    return at, three.astype(np.int64), five.astype(np.int64) + (1 << BITS), first, script


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, allowed: np.ndarray, penalty: float = SWITCH_PENALTY):
        self.langs, self.table, self.allowed, self.penalty = langs, table, allowed, penalty

    @classmethod
    def of_counts(cls, counts: pd.DataFrame) -> Model:
        """counts: lang, feature (below 0: a script), n."""
        langs = sorted(counts["lang"].unique())
        code = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
        feature, n = counts["feature"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
        table = np.full((2 << BITS, len(langs)), 0.1)
        grams = feature >= 0
        np.add.at(table, (feature[grams], code[grams]), n[grams])
        for a in (0, 1 << BITS):
            part = table[a : a + (1 << BITS)]
            part /= part.sum(0)
        scripts = np.zeros((len(SCRIPTS), len(langs)))
        np.add.at(scripts, (-1 - feature[~grams], code[~grams]), n[~grams])
        allowed = scripts >= MIN_SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
        allowed[~allowed.any(1)] = True
        return cls(langs, np.log(table).astype(np.float32), allowed)

    def labels(self, texts: list[str]):
        """Yield for each text (first letter of each word, letters of each word, label of each word)."""
        for i, j in runs_of(texts, RUN_CHARS):
            s = Scan(texts[i:j])
            at, three, five, first, script = scan_words(s)
            of = np.append(np.searchsorted(at[first], s.first), len(first)) if len(first) else np.zeros(j - i + 1, int)
            if not len(first):
                yield from ((np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)) for _ in range(j - i))
                continue
            before = np.concatenate([[0], np.cumsum(s.cls == LETTER)])
            lettered = before[s.last] > before[s.first]
            size = np.diff(np.append(first, len(at)))
            score = np.empty((len(first), len(self.langs)), np.float32)
            step = 1 << 16  # words at a time
            for a in range(0, len(first), step):
                b = min(a + step, len(first))
                p, q = first[a], first[b] if b < len(first) else len(at)
                per = self.table[three[p:q]] + self.table[five[p:q]]
                score[a:b] = np.add.reduceat(per, first[a:b] - p, axis=0)
            score[~self.allowed[script]] -= 1e4
            path = viterbi(score, of, self.penalty)
            for k in range(j - i):
                a, b = of[k], of[k + 1] if lettered[k] else of[k]
                yield at[first[a:b]] - s.first[k], size[a:b], path[a:b]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for _, size, path in self.labels(texts):
            if not len(path):
                langs.append(UND)
                scores.append(0.0)
                continue
            share = np.bincount(path, size, len(self.langs)) / size.sum()
            k = int(share.argmax())
            langs.append(self.langs[k])
            scores.append(float(share[k]))
        return langs, scores

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of each run of words of one language, by the positions of letters."""
        ((at, size, path),) = list(self.labels([text]))
        if not len(path):
            return []
        cut = np.flatnonzero(np.diff(path)) + 1
        first, last = np.append(0, cut), np.append(cut, len(path)) - 1
        return [(int(at[a]), int(at[b] + size[b]), self.langs[path[a]]) for a, b in zip(first, last)]


def viterbi(score: np.ndarray, of: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of all sequences at once: ``of`` has where each begins; the longest come first, so those still running
    are always a prefix."""
    n, k = score.shape
    size = np.diff(of)
    order = np.argsort(-size, kind="stable")
    begin, size = of[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    running = np.searchsorted(-size, -np.arange(longest), "left")  # sequences longer than t
    back = np.empty((n, k), np.uint16)
    own = np.arange(k, dtype=np.uint16)
    held = np.zeros((len(size), k), np.float32)
    for t in range(longest):
        m = running[t]
        at = begin[:m] + t
        if t:
            prev = held[:m]
            arg = prev.argmax(1)
            jump = prev[np.arange(m), arg][:, None] - penalty
            moved = jump > prev
            back[at] = np.where(moved, arg[:, None], own)
            held[:m] = np.where(moved, jump, prev) + score[at]
        else:
            held[:m] = score[at]
    path = np.empty(n, np.int64)
    now = held.argmax(1)
    for t in range(longest - 1, -1, -1):
        m = running[t]
        at = begin[:m] + t
        path[at] = now[:m]
        if t:
            now[:m] = back[at, now[:m]]
    return path


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts


def hash_sample(df: DataFrame, keys: list[str], total: int, rows: int, seed: int) -> DataFrame:
    """Rows with the smallest hash of their keys, ``rows`` of ``total`` in expectation; all, if there are no more."""
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * rows / total))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """labelled: doc_id, text, lang without nulls in text and lang."""
    short_batches(labelled.sparkSession)
    total = labelled.select("doc_id").count()
    sample = hash_sample(labelled, ["doc_id", "text"], total, rows, 8)

    def count(batches):
        grams: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                held = grams.setdefault(lang, np.zeros((2 << BITS) + len(SCRIPTS), np.int64))
                for i, j in runs_of(texts, RUN_CHARS):
                    at, three, five, first, script = scan_words(Scan(texts[i:j]))
                    held[: 2 << BITS] += np.bincount(three, minlength=2 << BITS) + np.bincount(five, minlength=2 << BITS)
                    if len(first):
                        held[2 << BITS :] += np.bincount(script, np.diff(np.append(first, len(at))), len(SCRIPTS)).astype(np.int64)
        for lang, held in grams.items():
            k = np.flatnonzero(held)
            feature = np.where(k < 2 << BITS, k, -1 - (k - (2 << BITS)))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k), pa.string()), "feature": pa.array(feature, pa.int64()), "n": pa.array(held[k], pa.int64())})

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    return Model.of_counts(counts) if len(counts) else None


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of docs (which must hold text), with lang_pred and score."""
    spark = docs.sparkSession
    short_batches(spark)
    if model is None:
        return docs.select(*[c for c in keep if c != "text"], F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score")) if "text" not in keep else docs.select(*keep, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            langs, scores = held.value.predict([x or "" for x in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    picked = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = StructType([picked.schema[c] for c in keep]).add("lang_pred", StringType()).add("score", DoubleType())
    return picked.mapInArrow(run, schema)


def train_outside_fold(docs: DataFrame) -> Model | None:
    """Learn from text and lang of documents outside the held-out fold only."""
    return train(docs.where((fold(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text."""
    docs = documents(spark, sf_dir)
    out = predict(docs, train_outside_fold(docs), ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
