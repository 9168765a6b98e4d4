"""Text quality by positive-unlabelled learning.

Trusted positives are documents labelled 1; the unlabelled set is every document outside the held-out fold. A small network
minimises the non-negative unbiased risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

where the class prior is estimated from the scores of a plain positives-against-unlabelled model: the smallest ratio of the
two sets' upper tails. Labelled rows outside the held-out fold then calibrate the output (two parameters), so that 0.7 means
what it says. Inputs are ~60 statistics of the text itself: character classes, signs, repetition of words, word triples and
lines, line shape.

The statistics of all documents are computed once and kept in the shared folder. Training goes over all unlabelled ones in
rounds: every task starts from the same network, descends on batches of its own rows and of the positives, and the
networks are averaged by rows. About ``POSITIVES`` labelled rows (never more than twice as many) are used, those with the
smallest hashes; they are the only ones of which the driver sees statistics. Every document is scored.

Edge cases: null and empty texts get the score of empty features; several labels of one document are averaged (ties: 1), and
of several texts under one labelled doc_id one counts; without positives every score is 0.5; very long texts are scanned
whole; equal texts get equal scores; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import copy
import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, runs_of, short_batches, staged
from .langid import fold, lower_table
from .textvec import BREAK, LETTER, NUMBER, PUNCT, SPACE, Scan, mix

POSITIVES = 12_000
PLAIN_ROUNDS, ROUNDS = 4, 10
STEPS, BATCH = 40, 512  # of a task in a round: at least so many steps, at most so many rows in one
THRESHOLD = 0.7
RUN_CHARS = 1_000_000
SIGNS = "!?.,;:|#*&%$@/\\_-=+<>{}[]()'\"~^`"


@functools.cache
def upper_case() -> np.ndarray:
    """Whether each code point is an upper-case one."""
    out = np.zeros(0x110000, bool)
    for cp in range(0x20000):
        x = chr(cp)
        out[cp] = x.upper() == x != x.lower()
    return out


def _per(of: np.ndarray, weights, n: int) -> np.ndarray:
    return np.bincount(of, weights, n).astype(np.float64) if len(of) else np.zeros(n)


def _distinct(of: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: distinct values among its hashes, and the count of the commonest."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    codes, _ = pd.factorize(mix(h ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
    count = np.bincount(codes)
    owner = np.empty(len(count), np.int64)
    owner[codes] = of
    top = np.zeros(n)
    np.maximum.at(top, owner, count)
    return np.bincount(owner, minlength=n).astype(float), top


def features(texts: list[str]) -> np.ndarray:
    """One row of statistics for each text."""
    out = [_features(texts[i:j]) for i, j in runs_of(texts, RUN_CHARS)]
    return np.concatenate(out) if out else np.zeros((0, N_FEATURES), np.float32)


def _features(texts: list[str]) -> np.ndarray:
    s = Scan(texts)
    n = len(texts)
    c, cp = s.cls, s.cp
    doc = np.repeat(np.arange(n), s.last - s.first + 1)
    chars = (s.last - s.first).astype(float)
    some = np.maximum(chars, 1)
    lower, is_upper = lower_table()[cp], upper_case()[cp]
    cols = [np.log1p(chars)]
    by_class = np.bincount(doc * 8 + c, minlength=8 * n).reshape(n, 8)
    cols += [by_class[:, k] / some for k in (PUNCT, LETTER, NUMBER, SPACE)]
    cols.append(_per(doc, is_upper, n) / some)
    cols.append(_per(doc, (cp == 10) & (c != BREAK), n) / some)
    small = np.where(cp < 128, cp, 0)
    by_sign = np.bincount(doc * 128 + small, minlength=128 * n).reshape(n, 128)
    cols += [np.log1p(100 * by_sign[:, ord(x)] / some) for x in SIGNS]
    same = np.zeros(len(cp), bool)
    same[1:] = (cp[1:] == cp[:-1]) & (c[1:] != BREAK)
    cols.append(_per(doc, same, n) / some)
    a, b = s.words()
    of = doc[a]
    words = np.bincount(of, minlength=n).astype(float)
    some_words = np.maximum(words, 1)
    size = (b - a).astype(float)
    mean = _per(of, size, n) / some_words
    cols += [np.log1p(words), mean, np.sqrt(np.maximum(0, _per(of, size * size, n) / some_words - mean * mean)), _per(of, size <= 3, n) / some_words, _per(of, size >= 12, n) / some_words]
    ups = np.concatenate([[0], np.cumsum(is_upper)])
    caps = (ups[b] - ups[a] == b - a) & (b - a > 1)
    cols += [_per(of, caps, n) / some_words, _per(of, is_upper[a], n) / some_words]
    h = s.hashes(a, b, lower)
    distinct, top = _distinct(of, h, n)
    cols += [distinct / some_words, distinct / np.sqrt(some_words), top / some_words]
    if len(h) > 2:
        one = of[1:] == of[:-1]
        cols.append(_per(of[1:], one & (h[1:] == h[:-1]), n) / some_words)
        three = of[2:] == of[:-2]
        g = mix(h[2:] + mix(h[1:-1] + mix(h[:-2])))[three]
        of3 = of[2:][three]
        d3, t3 = _distinct(of3, g, n)
        total = np.maximum(np.bincount(of3, minlength=n), 1)
        cols += [1 - d3 / total, t3 / total]
    else:
        cols += [np.zeros(n)] * 3
    follow = cp[np.minimum(b, len(cp) - 1)]
    fc = c[np.minimum(b, len(cp) - 1)]
    cols += [_per(of, fc == PUNCT, n) / some_words, _per(of, np.isin(follow, [46, 33, 63]), n) / some_words]
    end = np.flatnonzero(((cp == 10) | (c == BREAK)))
    start = np.append(0, end[:-1] + 1)
    line_of = doc[end]
    lines = np.bincount(line_of, minlength=n).astype(float)
    length = (end - start).astype(float)
    mean_line = _per(line_of, length, n) / np.maximum(lines, 1)
    dl, tl = _distinct(line_of, s.hashes(start, end), n)
    last = cp[np.maximum(end - 1, 0)]
    cols += [np.log1p(lines), np.log1p(mean_line), 1 - dl / np.maximum(lines, 1), tl / np.maximum(lines, 1), _per(line_of, np.isin(last, [46, 33, 63, 34, 58]), n) / np.maximum(lines, 1), _per(line_of, length == 0, n) / np.maximum(lines, 1)]
    return np.stack(cols, 1).astype(np.float32)


N_FEATURES = _features([""]).shape[1]


class Network:
    """One hidden layer; scores are logits."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, std
        d = len(mean)
        self.p = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, 1 / np.sqrt(hidden), hidden).astype(np.float32), np.zeros(1, np.float32)]
        self.slope, self.shift = 1.0, 0.0

    def copy(self, p: list[np.ndarray] | None = None) -> Network:
        out = copy.copy(self)
        out.p = [x.copy() for x in (p or self.p)]
        return out

    def norm(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -6, 6).astype(np.float32)

    def logits(self, z: np.ndarray) -> np.ndarray:
        w, b, v, c = self.p
        return np.tanh(z @ w + b) @ v + c[0]

    def gradients(self, z: np.ndarray, dlogit: np.ndarray) -> list[np.ndarray]:
        w, b, v, c = self.p
        h = np.tanh(z @ w + b)
        dh = np.outer(dlogit, v) * (1 - h * h)
        return [z.T @ dh, dh.sum(0), h.T @ dlogit, dlogit.sum(keepdims=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for a in range(0, len(x), 8192):
            out[a : a + 8192] = self.logits(self.norm(x[a : a + 8192]))
        return sigmoid(self.slope * out + self.shift)


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def risk_gradient(fp: np.ndarray, fu: np.ndarray, prior: float | None) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient of the risk at the logits of positives and unlabelled rows, and the risk. Loss: sigmoid(-y f).

    Without a prior: positives against unlabelled rows, both classes alike."""
    sp, su = sigmoid(fp), sigmoid(fu)
    dp, du = sp * (1 - sp) / len(fp), su * (1 - su) / len(fu)
    if prior is None:
        return -dp, du, float((1 - sp).mean() + su.mean())
    negative = su.mean() - prior * sp.mean()
    if negative >= 0:
        return -2 * prior * dp, du, float(prior * (1 - sp).mean() + negative)
    return prior * dp, -du, float(prior * (1 - sp).mean())  # below zero: climb back instead of fitting it further


def descend(net: Network, xp: np.ndarray, xu: np.ndarray, prior: float | None, rate: float, seed: int) -> None:
    """One round of a task: steps over all rows of ``xu``, at least ``STEPS`` of them, each with a batch of positives."""
    zp, zu = net.norm(xp), net.norm(xu)
    rng = np.random.default_rng(seed)
    m, v = [np.zeros_like(x) for x in net.p], [np.zeros_like(x) for x in net.p]
    each = max(1, -(-len(zu) // BATCH))
    order, op, t = [], rng.permutation(len(zp)), 0
    while t < max(STEPS, each):
        if not order:
            ou = rng.permutation(len(zu))
            order = [ou[k::each] for k in range(each)]
        take = np.arange(t * BATCH, (t + 1) * BATCH) % len(op) if len(op) > BATCH else np.arange(len(op))
        a, b = zp[op[take]], zu[order.pop()]
        dp, du, _ = risk_gradient(net.logits(a), net.logits(b), prior)
        g = [x + y + 1e-4 * w for x, y, w in zip(net.gradients(a, dp.astype(np.float32)), net.gradients(b, du.astype(np.float32)), net.p)]
        t += 1
        for i, x in enumerate(g):
            m[i] = 0.9 * m[i] + 0.1 * x
            v[i] = 0.999 * v[i] + 0.001 * x * x
            net.p[i] = net.p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def _summed(rows: DataFrame, work, width: int) -> np.ndarray:
    """Sum over tasks of the vector that ``work`` makes of a task's statistics (null if it has none), in steps."""

    def run(batches):
        x = [_matrix(b.column("x")) for b in batches if b.num_rows]
        if x:
            yield pa.RecordBatch.from_pydict({"s": pa.array([np.asarray(work(np.concatenate(x)), np.float64)], pa.list_(pa.float64()))})

    cells = rows.select("x").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"))
    out = np.zeros(width)
    for r in cells.collect():  # width rows
        out[r["i"]] = r["s"]
    return out


def average(net: Network, unlabelled: DataFrame, xp: np.ndarray, prior: float | None, rounds: int, seed: int) -> Network:
    """Rounds over all unlabelled rows: from the same start everywhere, then the mean of the tasks' networks by rows."""
    spark = unlabelled.sparkSession
    sizes = [x.size for x in net.p]
    for number in range(rounds):
        held = spark.sparkContext.broadcast((net, xp))
        rate = 0.01 * (1 - number / rounds) + 0.001

        def work(xu, held=held, rate=rate, number=number):
            own, positives = held.value
            own = own.copy()
            descend(own, positives, xu, prior, rate, seed + number)
            return np.append(np.concatenate([x.reshape(-1) for x in own.p]) * len(xu), len(xu))

        total = _summed(unlabelled, work, sum(sizes) + 1)
        flat = np.round(total[:-1] / max(total[-1], 1), 9).astype(np.float32)  # sums come in any order
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        net = net.copy([p.reshape(x.shape) for p, x in zip(parts, net.p)])
    return net


def prior_cuts(sp: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(sp, np.linspace(0.02, 0.8, 60)))


def estimate_prior(sp: np.ndarray, above: np.ndarray, rows: float) -> float:
    """Share of positives among unlabelled rows: the least ratio of upper tails, with a confidence term. above: number of the
    unlabelled ``rows`` at or above each of ``prior_cuts``."""
    qp = np.array([(sp >= c).mean() for c in prior_cuts(sp)])
    qu = above / max(rows, 1)
    slack = 1.0 / np.sqrt(len(sp)) + 1.0 / np.sqrt(max(rows, 1))
    k = int(np.argmin((qu + slack) / np.maximum(qp, 1e-9)))
    return float(np.clip(qu[k] / max(qp[k], 1e-9), 0.05, 0.95))


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> None:
    """Fit slope and shift of the logit to labels, by Newton steps."""
    if len(np.unique(y)) < 2:
        return
    f = net.logits(net.norm(x)).astype(float)
    f_std = max(f.std(), 1e-6)
    a = np.stack([f / f_std, np.ones_like(f)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = sigmoid(a @ w)
        g = a.T @ (p - y) + 1e-2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(h, g)
    if w[0] > 0:
        net.slope, net.shift = w[0] / f_std, w[1]


def featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of docs, with their statistics ``x``."""
    short_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = features([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([r.tobytes() for r in x], pa.binary())], [*keep, "x"])

    picked = docs.select(*dict.fromkeys([*keep, "text"]))
    return picked.mapInArrow(run, T.StructType([picked.schema[c] for c in keep]).add("x", T.BinaryType()))


def fit(rows: DataFrame, labels: DataFrame, positives: int = POSITIVES) -> Network | None:
    """rows: doc_id, x of all documents (read in every round: staged); labels: doc_id, quality. Rows of the held-out fold take
    no part."""
    learn = fold(F.col("doc_id"), 4) != 2
    marked = labels.where(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    total = marked.count()
    some = marked
    if total > positives:
        some = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(61)), F.lit(1 << 30)) < int((1 << 30) * positives / total)).limit(2 * positives)
    # the labels have a bounded number of rows, so they may be broadcast, and so have the texts under them
    known = rows.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("m")).select("m.x", "m.quality").toPandas()
    if not (known["quality"] == 1).any():
        return None
    x = np.frombuffer(b"".join(known["x"]), np.float32).reshape(len(known), -1)
    order = np.lexsort(x.T[::-1])  # rows arrive in any order
    x, y = x[order], known["quality"].to_numpy()[order]
    xp = x[y == 1]
    unlabelled = rows.where(learn)
    sums = _summed(unlabelled, lambda u: np.concatenate([[len(u)], u.sum(0, dtype=np.float64), (u.astype(np.float64) ** 2).sum(0)]), 1 + 2 * N_FEATURES)
    if not sums[0]:
        return None
    mean = sums[1 : 1 + N_FEATURES] / sums[0]
    std = np.sqrt(np.maximum(sums[1 + N_FEATURES :] / sums[0] - mean * mean, 0))
    scale = np.round(mean, 6).astype(np.float32), np.maximum(np.round(std, 6), 1e-3).astype(np.float32)
    plain = average(Network(*scale, 12, 6), unlabelled, xp, None, PLAIN_ROUNDS, 6)
    sp = plain.score(xp)
    cuts, held = prior_cuts(sp), rows.sparkSession.sparkContext.broadcast(plain)
    above = _summed(unlabelled, lambda u: (held.value.score(u)[:, None] >= cuts[None, :]).sum(0), len(cuts))
    prior = estimate_prior(sp, above, sums[0])
    net = average(Network(*scale, 24, 7), unlabelled, xp, prior, ROUNDS, 70)
    net.prior = prior
    calibrate(net, x, y.astype(float))
    return net


def scored(rows: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of rows, which hold ``x``, with score."""
    held = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            if b.num_rows:
                p = held.value.score(_matrix(b.column("x"))) if held.value is not None else np.full(b.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p, pa.float64())], [*keep, "score"])

    return rows.select(*keep, "x").mapInArrow(run, T.StructType([rows.schema[c] for c in keep]).add("score", T.DoubleType()))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES) -> Network | None:
    """docs: doc_id, text; labels: doc_id, quality."""
    return fit(staged(featured(docs, ["doc_id"]), "quality"), labels, positives)


def score(docs: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of docs, with score."""
    return scored(featured(docs, keep), net, keep)


def train_and_score(docs: DataFrame, labels: DataFrame, keep: list[str]) -> tuple[Network | None, DataFrame]:
    """The network and ``keep`` columns with score, from statistics that are computed once."""
    rows = staged(featured(docs, keep), "quality")
    net = fit(rows, labels)
    return net, scored(rows, net, keep)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text."""
    _, out = train_and_score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
