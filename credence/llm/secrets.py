"""Secret scanning: fixed rules for known shapes, and a battery of randomness tests for the rest.

Rules (``assign``, ``access``, ``hex``) find spans by pattern alone. The battery looks at every token of 16 or more
characters of a key-like alphabet that no rule covers, infers its encoding (decimal, hex, one-case letters, letters, base32,
base36, base62 or base64: the smallest alphabet that holds it) and tests three properties that random keys have and prose or
identifiers lack: uniform use of the alphabet (chi-squared), no trend or alternation around the middle of the alphabet (runs
test, with the split between its halves), no correlation of neighbours (serial correlation). The smallest of the three
p-values, corrected for three tests, is the token's randomness.

False discoveries are controlled by encoding and length: the controls of an encoding are the texts themselves without their
long tokens and rule spans, stripped to the encoding's alphabet and cut into consecutive pieces of the lengths of all
classes in turn, scored like tokens of that encoding. Their distribution gives each randomness level a p-value, and the
Benjamini-Hochberg rule over all candidates of an encoding and length class, corpus-wide, sets the level from which tokens
count as secrets (kind ``random``). No token is kept from the tests or let through beside them. Counts per class and level
are all that leaves the executors; where a class has too few controls to tell, none of its tokens is accepted.

Edge cases: null and empty texts have no spans; spans of one text are sorted by start, then by kind in the order of
``KINDS``; a random token that overlaps a rule's span is not reported again; very long texts and tokens are scanned whole,
in proportion to their length; equal rows get equal results; other columns pass untouched, whatever their names.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, runs_of, short_batches, staged

KINDS = ["assign", "access", "hex", "random"]
_FOLDED = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
#: The shapes of the rules.
ASSIGN = re.compile("(" + "|".join([*map(_FOLDED, ("password", "passwd", "secret", "token")), _FOLDED("api") + "_?" + _FOLDED("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

_UP, _LOW, _TEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets in order, by encoding. Those of one case are written in lower case.
ALPHABETS = {
    "decimal": _TEN,
    "hex": _TEN + "abcdef",
    "letter": _LOW,
    "base32": _LOW + "234567",
    "base36": _TEN + _LOW,
    "letters": _UP + _LOW,
    "base62": _TEN + _UP + _LOW,
    "base64": _UP + _LOW + _TEN + "+/",
}
ENCODINGS = list(ALPHABETS)
TWO_CASES = ("letters", "base62", "base64")
LENGTH_FROM = [16, 20, 24, 32, 40, 64, 128]
LEVELS = 24  # randomness level k holds p-values from 10**(-k/4)
FDR = 0.05
RUN_CHARS = 1_000_000
PIECES = 4_000  # scored at a time


def infer_encoding(token: str) -> tuple[str, str]:
    """The smallest alphabet that holds the token, and the token as that alphabet writes it."""
    body = token.rstrip("=")
    one_case = body == body.lower() or body == body.upper()
    for name, pattern in (("decimal", "[0-9]+"), ("hex", "[0-9a-f]+"), ("letter", "[a-z]+"), ("base32", "[a-z2-7]+"), ("base36", "[0-9a-z]+")):
        if one_case and re.fullmatch(pattern, body.lower()) and (name != "base32" or body == body.upper()):
            return name, body.lower()
    if re.fullmatch("[A-Za-z]+", body):
        return "letters", body
    if re.fullmatch("[0-9A-Za-z]+", body):
        return "base62", body
    return "base64", body.replace("-", "+").replace("_", "/").replace("=", "/")


@functools.cache
def _values(encoding: str) -> np.ndarray:
    """The place in the alphabet of each code point below 128, -1 where it is not in it."""
    out = np.full(129, -1, np.int32)
    for i, c in enumerate(ALPHABETS[encoding]):
        out[ord(c)] = i
        if encoding not in TWO_CASES:
            out[ord(c.upper())] = i
    return out


@functools.cache
def _tail_table() -> np.ndarray:
    return np.array([0.5 * math.erfc(z / 4096 / math.sqrt(2)) for z in range(-8 * 4096, 8 * 4096 + 1)])


def _normal_tail(z: np.ndarray) -> np.ndarray:
    return _tail_table()[np.clip(np.rint((np.nan_to_num(z) + 8) * 4096), 0, 16 * 4096).astype(np.int64)]


def battery(v: np.ndarray, k: int) -> np.ndarray:
    """p-values (uniformity, runs, serial correlation) of pieces of one length, if they were random. v: a row of places in an
    alphabet of k for each piece."""
    m, n = v.shape
    counts = np.bincount((v + (np.arange(m) * k)[:, None]).reshape(-1), minlength=m * k).reshape(m, k)
    chi = np.einsum("ij,ij->i", counts, counts) * (k / n) - n
    df = k - 1
    p_chi = _normal_tail((np.cbrt(chi / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    above = 2 * v >= k
    up = above.sum(1)
    runs = 1 + (above[:, 1:] != above[:, :-1]).sum(1)
    mean = 2 * up * (n - up) / n + 1
    share = (k // 2) / k  # of the places that lie above
    with np.errstate(divide="ignore", invalid="ignore"):
        var = (mean - 1) * (mean - 2) / max(n - 1, 1)
        p_runs = np.where(var > 0, 2 * _normal_tail(np.abs(runs - mean) / np.sqrt(var)), 1.0)
        p_split = 2 * _normal_tail(np.abs(up - n * share) / math.sqrt(n * share * (1 - share)))
        p_runs = np.where((up == 0) | (up == n), 2.0 ** max(1 - n, -1000), np.minimum(p_runs, p_split))
        dev = v - v.mean(1, keepdims=True)
        total = np.einsum("ij,ij->i", dev, dev)
        r = np.einsum("ij,ij->i", dev[:, 1:], dev[:, :-1]) / total
        p_serial = np.where(total > 0, 2 * _normal_tail(np.abs(r + 1 / n) * math.sqrt(n)), 0.0)
    return np.minimum(np.stack([p_chi, p_runs, p_serial], 1), 1.0)


def levels_of(v: np.ndarray, k: int) -> np.ndarray:
    """Randomness of pieces of one length on a scale where 0 is most random."""
    out = np.empty(len(v), np.int64)
    for a in range(0, len(v), PIECES):
        p = np.minimum(1.0, 3 * battery(v[a : a + PIECES], k).min(1))
        out[a : a + PIECES] = np.minimum(LEVELS - 1, -4 * np.log10(np.maximum(p, 1e-30)) + 1e-9).astype(np.int64)
    return out


def level_of(token: str) -> int:
    encoding, body = infer_encoding(token)
    v = _values(encoding)[np.frombuffer(body.encode("ascii"), np.uint8)]
    return int(levels_of(v[None, :], len(ALPHABETS[encoding]))[0]) if len(v) else LEVELS - 1


def length_class(n: int) -> int:
    return int(np.searchsorted(LENGTH_FROM, n, "right")) - 1


def test_class(encoding: str, n: int) -> int:
    """Encoding and length class in one number."""
    return ENCODINGS.index(encoding) * len(LENGTH_FROM) + length_class(n)


test_class.__test__ = False  # not a test


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the rules, by start, then by kind as listed."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def candidates(text: str, base: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, int, int]], str]:
    """(start, end, class, level) of each long token that no rule covers, and the text without long tokens and rule spans."""
    out, rest, at, k = [], [], 0, 0
    ends = [0]
    for _, y, _ in base:
        ends.append(max(ends[-1], y))  # as far as the spans up to each one reach
    cuts = [(x, y) for x, y, _ in base]
    for m in TOKEN.finditer(text):
        a, b = m.span()
        cuts.append((a, b))
        while k < len(base) and base[k][0] < b:
            k += 1
        if ends[k] > a:
            continue
        body = infer_encoding(m[0])
        out.append((a, b, test_class(body[0], b - a), level_of(m[0])))
    for x, y in sorted(cuts):
        if x > at:
            rest.append(text[at:x])
        at = max(at, y)
    rest.append(text[at:])
    return out, " ".join(rest) if cuts else text


_CYCLE = sum(LENGTH_FROM)
_TURN = np.array([LENGTH_FROM[i:] + LENGTH_FROM[:i] for i in range(len(LENGTH_FROM))])  # the lengths in turn, from each class on
_TURN_END = np.cumsum(_TURN, 1)


def control_counts(texts: list[str]) -> np.ndarray:
    """Controls of all texts by class and level. Each text starts its turn of lengths at the class of its own length."""
    out = np.zeros((len(ENCODINGS) * len(LENGTH_FROM), LEVELS), np.int64)
    n_len = len(LENGTH_FROM)
    for i, j in runs_of(texts, RUN_CHARS):
        cp = np.minimum(np.frombuffer("".join(texts[i:j]).encode("utf-32-le"), np.uint32), 128)
        sizes = np.fromiter(map(len, texts[i:j]), np.int64, j - i)
        turn = sizes % n_len
        ends = np.cumsum(sizes)
        for e, name in enumerate(ENCODINGS):
            place = _values(name)[cp]
            keep = place >= 0
            v = place[keep]
            held = np.diff(np.append(0, np.append(0, np.cumsum(keep))[ends]))  # characters of the alphabet in each text
            rest = held % _CYCLE
            pieces = held // _CYCLE * n_len + (_TURN_END[turn] <= rest[:, None]).sum(1)
            total = int(pieces.sum())
            if not total:
                continue
            of = np.repeat(np.arange(j - i), pieces)
            q, r = np.divmod(np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces), n_len)
            own = (turn[of] + r) % n_len
            start = (np.cumsum(held) - held)[of] + q * _CYCLE + np.where(r > 0, _TURN_END[turn[of], r - 1], 0)
            for c, n in enumerate(LENGTH_FROM):
                for a in range(0, len(first := start[own == c]), PIECES):
                    level = levels_of(v[first[a : a + PIECES, None] + np.arange(n)], len(ALPHABETS[name]))
                    out[e * n_len + c] += np.bincount(level, minlength=LEVELS)
    return out


def accepted_levels(counts: dict[tuple[int, int, bool], int], fdr: float = FDR) -> dict[int, int]:
    """For each class, the last level that is accepted (-1: none). counts: by (class, level, control)."""
    out = {}
    for c in {c for c, _, _ in counts}:
        controls = [counts.get((c, k, True), 0) for k in range(LEVELS)]
        found = [counts.get((c, k, False), 0) for k in range(LEVELS)]
        m, total = sum(found), sum(controls)
        out[c] = -1
        for k in range(LEVELS):
            p = (1 + sum(controls[: k + 1])) / (1 + total)
            below = sum(found[: k + 1])
            if below and p <= fdr * below / max(m, 1):
                out[c] = k
    return out


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(c, t) for c, t in kinds.items()])


_INT, _LONG = T.IntegerType(), T.LongType()
_EXTRA = _fields(
    n_assign=_LONG, n_access=_LONG, n_hex=_LONG, base_spans=T.StringType(),
    found=T.ArrayType(_fields(a=_INT, b=_INT, cls=_INT, level=_INT)), controls=T.ArrayType(_fields(cls=_INT, level=_INT, n=_LONG)),
)
_FOUND = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cls", pa.int32()), ("level", pa.int32())]))
_CONTROLS = pa.list_(pa.struct([("cls", pa.int32()), ("level", pa.int32()), ("n", pa.int64())]))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, rule counts, rule spans and candidates of every text; and for each task a row of nothing but the
    counts of its controls (``controls``, null for texts)."""
    short_batches(docs.sparkSession)
    picked = docs.select(*dict.fromkeys([*keep, "text"]))
    names = [*keep, *(f.name for f in _EXTRA.fields)]

    def run(batches):
        counts, kinds = np.zeros((len(ENCODINGS) * len(LENGTH_FROM), LEVELS), np.int64), None
        for b in batches:
            kinds = [b.schema.field(c).type for c in keep]
            n, spans, found, rest = [[], [], []], [], [], []
            for t in b.column("text").to_pylist():
                base = base_spans(t or "")
                for k in range(3):
                    n[k].append(sum(x[2] == KINDS[k] for x in base))
                spans.append(",".join(f"{k}:{x}:{y}" for x, y, k in base))
                own, plain = candidates(t or "", base)
                found.append([dict(zip(("a", "b", "cls", "level"), x)) for x in own])
                rest.append(plain)
            counts += control_counts(rest)
            cols = [*(b.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in n), pa.array(spans, pa.string()), pa.array(found, _FOUND), pa.nulls(len(spans), _CONTROLS)]
            yield pa.RecordBatch.from_arrays(cols, names)
        if counts.any():
            own = [{"cls": c, "level": k, "n": int(counts[c, k])} for c, k in np.argwhere(counts).tolist()]
            cols = [*(pa.nulls(1, t) for t in kinds), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.string()), pa.nulls(1, _FOUND), pa.array([own], _CONTROLS)]
            yield pa.RecordBatch.from_arrays(cols, names)

    return picked.mapInArrow(run, T.StructType([T.StructField(c, picked.schema[c].dataType) for c in keep] + _EXTRA.fields))


def fit_levels(scanned: DataFrame) -> dict[int, int]:
    """Accepted levels by class, from counts over all texts."""
    found = scanned.select(F.explode("found").alias("x")).groupBy("x.cls", "x.level").agg(F.count(F.lit(1)).alias("n")).collect()
    controls = scanned.select(F.explode("controls").alias("x")).groupBy("x.cls", "x.level").agg(F.sum("x.n").alias("n")).collect()
    return accepted_levels({(r["cls"], r["level"], False): r["n"] for r in found} | {(r["cls"], r["level"], True): r["n"] for r in controls})


def spans_column(levels: dict[int, int]) -> Column:
    """All spans of a scanned row as array<struct<a,b,k>>, sorted."""
    table = F.array(*[F.lit(levels.get(c, -1)) for c in range(len(ENCODINGS) * len(LENGTH_FROM))])
    random = F.transform(F.filter("found", lambda x: x["level"] <= F.element_at(table, x["cls"] + 1)), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.lit(KINDS.index("random")).alias("k")))
    part = lambda x: F.split(x, ":")
    code = F.create_map(*[y for i, k in enumerate(KINDS) for y in (F.lit(k), F.lit(i))])
    base = F.when(F.col("base_spans") == "", F.array().cast("array<struct<a:int,b:int,k:int>>")).otherwise(F.transform(F.split("base_spans", ","), lambda x: F.struct(part(x)[1].cast("int").alias("a"), part(x)[2].cast("int").alias("b"), code[part(x)[0]].alias("k"))))
    both = F.array_sort(F.concat(base, random), lambda x, y: F.when(x["a"] != y["a"], x["a"] - y["a"]).otherwise(x["k"] - y["k"]))
    return both


def find_secrets(docs: DataFrame, keep: list[str], report: dict | None = None) -> DataFrame:
    """``keep`` columns, rule counts and ``found_spans`` (array of start, end, kind code) of every text. ``report`` receives
    the accepted levels by class."""
    scanned = staged(scan(docs, keep), "secrets")
    levels = fit_levels(scanned)
    if report is not None:
        report.update(levels)
    return scanned.where(F.col("controls").isNull()).withColumn("found_spans", spans_column(levels)).drop("controls")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of ``text`` replaced; ``n_chars``, if there, follows. Texts are scanned once."""
    plain = docs.toDF(*["text" if c == "text" else f"_x{i}" for i, c in enumerate(docs.columns)])
    found = find_secrets(plain, plain.columns).select(*plain.columns, F.transform("found_spans", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("_spans"))
    size = f"_x{docs.columns.index('n_chars')}" if "n_chars" in docs.columns else None
    names = plain.columns
    short_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, spans in enumerate(b.column("_spans").to_pylist()):
                if not spans:
                    continue
                out, at, t = [], 0, texts[i]
                for s in spans:
                    if s["a"] >= at:
                        out += [t[at : s["a"]], mark]
                    at = max(at, s["b"])
                texts[i] = "".join([*out, t[at:]])
            cols = [pa.array(texts, pa.string()) if c == "text" else pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.schema.field(c).type) if c == size else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = T.StructType([found.schema[c] for c in names])
    return found.mapInArrow(run, schema).toDF(*docs.columns)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text."""
    found = find_secrets(documents(spark, sf_dir), ["doc_id"])
    kinds = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform("found_spans", lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["a"].cast("string"), x["b"].cast("string"))), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), spans.alias("spans"))
