"""Neural screening: a shared network with one head for each column, trained once for each bootstrap round.

Every head sees all columns but its own. The influence of a source on a target is how much the target's loss grows, in
proportion, when the source's inputs are blanked; a pair's synergy is what blanking both adds to blanking either.

A round is one network trained on all rows of the table, whatever their number. Equal rows are counted first. What is random
about a row hangs on a hash of its values alone, never on where it lies: its bootstrap weight (a Poisson draw for training and
an independent one for checking, as drawing rows with replacement gives), the batches of an epoch that its copies are dealt to
in turn, and which hidden units are dropped for it. A step adds up the gradients of its batch, divides by the weight and moves
the parameters. An epoch has ``STEPS`` steps, or one for every ``batch`` rows if that is fewer.

So it makes no difference to the model, but for rounding, who adds up. Tables of at most ``max_rows`` distinct rows are trained in
one task a round, unless their copies make steps too large for it. Others are packed into blocks that Spark keeps, every step is
a job over these that returns one sum of gradients for each round, added up in two levels, and influences are sums of losses over
all check rows in the same way. What is random in an epoch is drawn once for all its steps.
"""

from __future__ import annotations

import math
import pickle
from copy import copy
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 64  # of an epoch, at most: beyond it batches grow with the table
PIECE = 512  # rows whose activations a task holds together
STEP_ROWS = 30_000  # distinct rows of a step from which on a job a step is faster than one task a round
BLOCK_ROWS = 8_192  # packed together
KEPT_BYTES = 64_000_000  # of a network's dropped units that are remembered for an epoch, at most
ROUNDS = "boot int, target string, s1 string, s2 string, score double"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # fixed value


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(h: np.ndarray, *keys: int) -> np.ndarray:
    """The hashes under some keys."""
    for k in keys:
        h = mixed(h + np.uint64(int(_GOLDEN) * (k + 1) % 2**64))
    return h


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson quantiles; of large means by the normal approximation with a correction for skewness."""
    out = np.zeros(len(u), np.int64)
    small = mean <= 30
    m, left = mean[small], u[small]
    p = np.exp(-m)
    below, k, got = p.copy(), 0, np.zeros(len(m), np.int64)
    while (over := left > below).any() and k < 200:
        k += 1
        p = p * m / k
        below = below + p
        got[over] = k
    out[small] = got
    if not small.all():
        grid = np.linspace(-8, 8, 4001)
        cdf = np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in grid])
        z, m = np.interp(u[~small], cdf, grid), mean[~small]
        out[~small] = np.maximum(0, np.floor(m + np.sqrt(m) * z + (z * z - 1) / 6 + 0.5)).astype(np.int64)
    return out


class MultiHead:
    """Linear-ReLU-dropout layers, then a linear head for each column: squared error for numbers, cross entropy else.

    The first layer's sum over all inputs is made once, and each head takes its own column's share away from it. Dropped units
    are the same for all heads."""

    def __init__(self, blocks: list[slice], sizes: list[int], hidden: int, layers: int, dropout: float, seed: int):
        rng = np.random.default_rng(seed)
        self.blocks, self.sizes, self.dropout, self.seed = blocks, sizes, dropout, seed
        d = blocks[-1].stop
        self.p: dict[str, np.ndarray] = {}
        for k in range(layers):
            n_in = d if k == 0 else hidden
            self.p[f"w{k}"] = rng.uniform(-1, 1, (n_in, hidden)) / np.sqrt(n_in)
            self.p[f"b{k}"] = rng.uniform(-1, 1, hidden) / np.sqrt(n_in)
        self.layers, self.hidden = layers, hidden
        for j, s in enumerate(sizes):
            out = max(s, 1)
            self.p[f"v{j}"] = rng.uniform(-1, 1, (hidden, out)) / np.sqrt(hidden)
            self.p[f"c{j}"] = rng.uniform(-1, 1, out) / np.sqrt(hidden)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def light(self) -> MultiHead:
        """As it is, without what only steps need."""
        out = copy(self)
        out.m = out.v = None
        return out

    def share(self, x: np.ndarray, j: int) -> np.ndarray:
        """What column j adds to the first layer."""
        return x[:, self.blocks[j]] @ self.p["w0"][self.blocks[j]]

    def kept(self, h: np.ndarray | None, epoch: int) -> list:
        """By layer which hidden units of each row are not dropped; None: all."""
        if h is None or not self.dropout:
            return [None] * self.layers
        out = [np.empty((len(h), self.hidden), bool) for _ in range(self.layers)]
        unit, least = _GOLDEN * np.arange(1, self.hidden + 1, dtype=np.uint64), np.uint64(int(self.dropout * 2**64))
        for a in range(0, len(h), PIECE):
            for k in range(self.layers):
                own = keyed(h[a : a + PIECE], self.seed, epoch, k)
                out[k][a : a + PIECE] = mixed(own[:, None] + unit) >= least
        return out

    def gates(self, h: np.ndarray | None, epoch: int) -> list:
        """By layer the factor of each row's hidden units: 0 where dropped."""
        return self.factors(self.kept(h, epoch))

    def factors(self, kept: list) -> list:
        return [None if k is None else k / (1 - self.dropout) for k in kept]

    def upper(self, z: np.ndarray, gates: list):
        """Activations of first-layer sums (..., rows, hidden) through all layers: the last ones, and the trace."""
        trace = []
        for k in range(self.layers):
            if k:
                z = z @ self.p[f"w{k}"] + self.p[f"b{k}"]
            gate = (z > 0).astype(z.dtype)
            if gates[k] is not None:
                gate = gate * gates[k]
            z = z * gate
            trace.append((gate, z))
        return z, trace

    def head(self, h: np.ndarray, y: np.ndarray, j: int):
        """Loss of each row, and its derivative by the head's outputs."""
        out = h @ self.p[f"v{j}"] + self.p[f"c{j}"]
        if self.sizes[j] == 0:
            e = out[..., 0] - y
            return e * e, (2 * e)[..., None]
        out = out - out.max(-1, keepdims=True)
        p = np.exp(out)
        p /= p.sum(-1, keepdims=True)
        one = np.eye(self.sizes[j])[y.astype(int)]
        return -np.log(np.maximum((p * one).sum(-1), 1e-12)), p - one

    def gradient_sums(self, x: np.ndarray, ys: list[np.ndarray], w: np.ndarray, h: np.ndarray | None = None, epoch: int = 0, kept: list | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Sums over rows, by weight, of the mean loss over the heads, and of its gradient. ``kept``: the rows' units, if known."""
        kept = self.kept(h, epoch) if kept is None else kept
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        total, heads = 0.0, len(ys)
        for a in range(0, len(x), PIECE):
            xs, ws, gates = x[a : a + PIECE], w[a : a + PIECE] / heads, self.factors([k if k is None else k[a : a + PIECE] for k in kept])
            whole = xs @ self.p["w0"] + self.p["b0"]
            every = np.zeros_like(whole)  # the gradient by first-layer sums, of all heads
            for j, y in enumerate(ys):  # one by one: a head's arrays stay in the processor's cache
                top, trace = self.upper(whole - self.share(xs, j), gates)
                loss, d = self.head(top, y[a : a + PIECE], j)
                total += float((ws * loss).sum())
                d = d * ws[:, None]
                g[f"v{j}"] += top.T @ d
                g[f"c{j}"] += d.sum(0)
                back = d @ self.p[f"v{j}"].T
                for k in range(self.layers - 1, 0, -1):
                    back *= trace[k][0]
                    g[f"w{k}"] += trace[k - 1][1].T @ back
                    g[f"b{k}"] += back.sum(0)
                    back = back @ self.p[f"w{k}"].T
                back *= trace[0][0]
                every += back
                g["w0"][self.blocks[j]] -= xs[:, self.blocks[j]].T @ back
            g["w0"] += xs.T @ every
            g["b0"] += every.sum(0)
        return total, g

    def gradients(self, x: np.ndarray, ys: list[np.ndarray], train: bool = True) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over rows and heads, and its gradient, without dropout."""
        total, g = self.gradient_sums(x, ys, np.ones(len(x)))
        return total / len(x), {k: v / len(x) for k, v in g.items()}

    def step(self, g: dict[str, np.ndarray], weight: float, rate: float) -> None:
        """Move the parameters by the sums of a batch of that weight."""
        if weight <= 0:
            return
        self.t += 1
        for k in self.p:
            d = g[k] / weight
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.v[k] = 0.999 * self.v[k] + 0.001 * d * d
            self.p[k] = self.p[k] - rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)

    def fit(self, x: np.ndarray, ys: list[np.ndarray], epochs: int, batch: int, rate: float) -> None:
        """Train on rows of weight 1 that are in memory, dealt by their place."""
        h = keyed(np.arange(len(x), dtype=np.uint64), self.seed)
        local = LocalRows(x, ys, h, np.ones(len(x), np.int64))
        train([self], local.gradients(np.ones(len(x), np.int64)), steps_of(len(x), batch), epochs, rate)

    def loss_sums(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, j: int, variants: list[tuple[int, ...]], chunk: int) -> np.ndarray:
        """Sums of head j's loss, by weight, with the columns of each variant blanked, ``chunk`` variants at a time."""
        out = np.zeros(len(variants))
        piece = max(1, PIECE // max(1, min(chunk, len(variants))))  # all variants of a piece together are as large as one
        for a in range(0, len(x), piece):
            xs, ws, own = x[a : a + piece], w[a : a + piece], y[a : a + piece]
            base = xs @ self.p["w0"] + self.p["b0"] - self.share(xs, j)
            gone = {s: self.share(xs, s) for v in variants for s in v if s != j}
            for c in range(0, len(variants), chunk):
                part = variants[c : c + chunk]
                z = np.stack([base - sum((gone[s] for s in dict.fromkeys(v) if s != j), np.zeros(1)) for v in part])
                top, _ = self.upper(z, [None] * self.layers)
                out[c : c + chunk] += (self.head(top, own, j)[0] * ws).sum(1)
        return out

    def keep_mask(self, j: int) -> np.ndarray:
        """The inputs that head j sees: 1, its own column's: 0."""
        m = np.ones(self.blocks[-1].stop)
        m[self.blocks[j]] = 0
        return m

    def loss(self, x: np.ndarray, y: np.ndarray, j: int) -> float:
        """Mean loss of head j on already masked inputs."""
        top, _ = self.upper(x @ self.p["w0"] + self.p["b0"], [None] * self.layers)
        return float(self.head(top, y, j)[0].mean())

    def masked_losses(self, x: np.ndarray, y: np.ndarray, j: int, variants: list[tuple[int, ...]], chunk: int) -> list[float]:
        """Mean losses of head j with the columns of each variant blanked."""
        return (self.loss_sums(x, y, np.ones(len(x)), j, variants, chunk) / len(x)).tolist()


def influence(masked: float, base: float) -> float:
    return max(0.0, (masked - base) / max(abs(base), 1e-6))


def steps_of(rows: float, batch: int) -> int:
    return int(min(STEPS, max(1, -(-rows // batch))))


def train(nets: list[MultiHead], gradients, steps: int, epochs: int, rate: float) -> None:
    """``gradients(nets, epoch, step, steps)`` gives (weight, sums) for each network."""
    for epoch in range(epochs):
        for s in range(steps):
            for net, (weight, g) in zip(nets, gradients(nets, epoch, s, steps)):
                net.step(g, weight, rate)


def turns(h: np.ndarray, seed: int, epoch: int, steps: int) -> np.ndarray:
    """The batch of an epoch that a row's copies are dealt from."""
    return (keyed(h, seed, 1_000 + epoch) % np.uint64(steps)).astype(np.int64)


def dealt(h: np.ndarray, copies: np.ndarray, seed: int, epoch: int, step: int, steps: int, turn: np.ndarray | None = None) -> np.ndarray:
    """How many of a row's copies are in the batch: they are dealt to an epoch's batches in turn, from a random one on."""
    turn = turns(h, seed, epoch, steps) if turn is None else turn
    return (copies + (steps - 1 - (step - turn) % steps)) // steps


class LocalRows:
    """Rows in memory: features, codes, hashes and how often each occurs. What is random about them is drawn once an epoch."""

    def __init__(self, x: np.ndarray, ys: list[np.ndarray], h: np.ndarray, n: np.ndarray):
        self.x, self.ys, self.h, self.n, self.drawn = x, ys, h, n, {}

    def draw(self, net: MultiHead, epoch: int, steps: int) -> tuple:
        """Turns and kept units of all rows; None: too large to hold."""
        small = len(self.h) * net.hidden * net.layers <= KEPT_BYTES
        return epoch, steps, turns(self.h, net.seed, epoch, steps), net.kept(self.h, epoch) if small else None

    def sums(self, net: MultiHead, copies: np.ndarray, epoch: int, step: int, steps: int):
        if (now := self.drawn.get(net.seed)) is None or now[:2] != (epoch, steps):
            now = self.drawn[net.seed] = self.draw(net, epoch, steps)
        _, _, turn, kept = now
        w = dealt(self.h, copies, net.seed, epoch, step, steps, turn)
        at = np.flatnonzero(w)
        own = None if kept is None else [k if k is None else k[at] for k in kept]
        return float(w.sum()), net.gradient_sums(self.x[at], [y[at] for y in self.ys], w[at].astype(float), self.h[at], epoch, own)[1]

    def gradients(self, copies: np.ndarray):
        return lambda nets, epoch, step, steps: [self.sums(net, copies, epoch, step, steps) for net in nets]

    def losses(self, net: MultiHead, copies: np.ndarray, plan: dict[int, list[tuple[int, ...]]], chunk: int) -> dict[int, np.ndarray]:
        at = np.flatnonzero(copies)
        return {j: net.loss_sums(self.x[at], self.ys[j][at], copies[at].astype(float), j, variants, chunk) for j, variants in plan.items()}


def copies_of(h: np.ndarray, n: np.ndarray, seed: int, fraction: float) -> tuple[np.ndarray, np.ndarray]:
    """Training and check copies of rows that occur n times: independent Poisson draws, since a bootstrap draw goes to either."""
    return poisson(uniform(keyed(h, seed, 1)), n * (1 - fraction)), np.minimum(n, poisson(uniform(keyed(h, seed, 2)), n * fraction))


class Screener:
    """What is common to all ways of adding up."""

    def __init__(self, names: list[str], blocks: list[slice], sizes: list[int], config, allowed: dict[str, list[str]] | None):
        self.names, self.blocks, self.sizes, self.config, self.allowed = names, blocks, sizes, config, allowed

    def network(self, number: int) -> MultiHead:
        c = self.config
        return MultiHead(self.blocks, self.sizes, c.hidden, c.layers, c.dropout, c.seed + number)

    def sources(self, j: int) -> list[int]:
        names = self.names
        return [s for s in range(len(names)) if s != j and (self.allowed is None or names[s] in self.allowed.get(names[j], ()))]

    def singles(self) -> dict[int, list[tuple[int, ...]]]:
        return {j: [(), *((s,) for s in self.sources(j))] for j in range(len(self.names))}

    def pairs(self, single: dict[int, dict[int, float]]) -> dict[int, list[tuple[int, ...]]]:
        c = self.config
        if not (c.use_bundles and c.interaction_top_pairs > 0):
            return {}
        best = {j: sorted(own, key=lambda s: -own[s])[: c.pairwise_top_m] for j, own in single.items()}
        return {j: v for j, b in best.items() if (v := [tuple(sorted(p)) for p in combinations(b, 2)])}

    def rows(self, number: int, base: dict[int, float], single: dict[int, dict[int, float]], pair_losses: dict[int, dict[tuple, float]]) -> list[tuple]:
        names, out = self.names, []
        for j, target in enumerate(names):
            own = single[j]
            out += [(number, target, names[s], None, own.get(s, 0.0)) for s in range(len(names)) if s != j]
            out += [(number, target, names[a], names[b], max(0.0, influence(v, base[j]) - own[a] - own[b])) for (a, b), v in pair_losses.get(j, {}).items()]
        return out

    def scored(self, number: int, losses) -> list[tuple]:
        """Rows of a round; ``losses(plan)`` gives mean losses by head and variant."""
        plan = self.singles()
        got = losses(plan)
        base = {j: float(v[0]) for j, v in got.items()}
        single = {j: {s: influence(float(x), base[j]) for (s,), x in zip(plan[j][1:], v[1:])} for j, v in got.items()}
        pairs = self.pairs(single)
        both = losses(pairs) if pairs else {}
        return self.rows(number, base, single, {j: dict(zip(pairs[j], map(float, v))) for j, v in both.items()})

    def matrix(self, features, codes: dict[str, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        x = np.asarray(features, float).reshape(-1, self.blocks[-1].stop)
        return x, [x[:, b.start] if s == 0 else codes[n] for n, b, s in zip(self.names, self.blocks, self.sizes)]

    def seed(self, number: int) -> int:
        return self.config.seed + number

    def run_local(self, number: int, local: LocalRows, total: int) -> list[tuple]:
        """A round on rows in memory, ``total`` with their copies."""
        c, net = self.config, self.network(number)
        learn, check = copies_of(local.h, local.n, self.seed(number), c.validation_fraction)
        train([net], local.gradients(learn), steps_of(total * (1 - c.validation_fraction), c.batch), c.epochs, c.learning_rate)
        if not check.any():
            check = local.n
        weight = float(check.sum())
        return self.scored(number, lambda plan: {j: v / weight for j, v in local.losses(net, check, plan, c.mask_chunk).items()})


class Block:
    """Rows packed for Spark to keep: features and codes as they came, hashes, how often each occurs, and by round the copies to learn
    and to check."""

    def __init__(self, features: np.ndarray, codes: dict[str, np.ndarray], h: np.ndarray, n: np.ndarray, copies: list):
        self.features, self.codes, self.h, self.n, self.copies = features, codes, h, n, copies

    def rows(self, screener: Screener) -> LocalRows:
        return LocalRows(*screener.matrix(self.features, self.codes), self.h, self.n)

    def drawn(self, nets: list[MultiHead], epoch: int, steps: int) -> EpochBlock:
        kept = [[k if k is None else np.packbits(k, axis=1) for k in net.kept(self.h, epoch)] for net in nets]
        return EpochBlock(self.features, self.codes, [learn for learn, _ in self.copies], [turns(self.h, net.seed, epoch, steps).astype(np.int16) for net in nets], kept)


class EpochBlock:
    """What the steps of an epoch need of a block: by round the copies to learn, the turns and the kept units as bits."""

    def __init__(self, features: np.ndarray, codes: dict[str, np.ndarray], copies: list, turn: list, kept: list):
        self.features, self.codes, self.copies, self.turn, self.kept = features, codes, copies, turn, kept

    def sums(self, screener: Screener, nets: list[MultiHead], epoch: int, step: int, steps: int):
        """By round the weight and the gradient, in one vector."""
        features = self.features.reshape(-1, screener.blocks[-1].stop)
        for net, learn, turn, kept in zip(nets, self.copies, self.turn, self.kept):
            w = dealt(None, learn, net.seed, epoch, step, steps, turn)
            at = np.flatnonzero(w)
            x, ys = screener.matrix(features[at], {k: v[at] for k, v in self.codes.items()})
            own = [k if k is None else np.unpackbits(k[at], axis=1, count=net.hidden).view(bool) for k in kept]
            g = net.gradient_sums(x, ys, w[at].astype(float), None, epoch, own)[1]
            yield np.concatenate([[float(w.sum())], *(g[k].reshape(-1) for k in net.p)])


def packed(screener: Screener, seeds: list[int]):
    """Batches of rows to blocks."""
    fraction = screener.config.validation_fraction

    def part(batches):
        for b in batches:
            for a in range(0, b.num_rows, BLOCK_ROWS):
                own = b.slice(a, BLOCK_ROWS)
                col = lambda c: own.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                h, n = col("_h").view(np.uint64), col("_n")
                block = Block(own.column("features").flatten().to_numpy(zero_copy_only=False), {name: col(f"_c{i}") for i, name in enumerate(screener.names)}, h, n, [copies_of(h, n, s, fraction) for s in seeds])
                yield pa.RecordBatch.from_pydict({"block": [pickle.dumps(block)]}, pa.schema([("block", pa.binary())]))

    return part


def added(vectors) -> list[list[np.ndarray]]:
    """One list of vectors, the sums of all that came, or none."""
    out = None
    for own in vectors:
        own = list(own)
        out = own if out is None else [a + v for a, v in zip(out, own)]
    return [] if out is None else [out]


class FarRows:
    """Rows that stay in Spark: every sum is a job that all rounds share."""

    def __init__(self, screener: Screener, rows: DataFrame, rounds: int):
        self.screener, self.rounds = screener, rounds
        cores = rows.sparkSession.sparkContext.defaultParallelism
        if rows.rdd.getNumPartitions() < cores:
            rows = rows.repartition(cores)
        found = rows.mapInArrow(packed(screener, [screener.seed(k) for k in range(rounds)]), "block binary")
        self.blocks = found.rdd.map(lambda r: pickle.loads(bytes(r[0]))).persist(StorageLevel.MEMORY_AND_DISK)
        self.now, self.epoch = None, None  # the blocks with an epoch's draws

    def summed(self, blocks: RDD, part) -> list[np.ndarray]:
        """``part(block)`` gives a vector for each round; their sums over all blocks, added up in tasks first, then by about the
        square root of these, then here."""
        some, tasks = blocks.mapPartitions(lambda own: added(map(part, own))), blocks.getNumPartitions()
        if tasks > 16:
            some = some.coalesce(math.isqrt(tasks), shuffle=True).mapPartitions(added)
        return added(some.collect())[0]  # a vector for each round and task of the last level

    def gradients(self, nets: list[MultiHead], epoch: int, step: int, steps: int):
        screener, light = self.screener, [net.light() for net in nets]
        if self.epoch != epoch:
            if self.now is not None:
                self.now.unpersist()
            self.now, self.epoch = self.blocks.map(lambda b: b.drawn(light, epoch, steps)).persist(StorageLevel.MEMORY_AND_DISK), epoch
        for net, v in zip(nets, self.summed(self.now, lambda b: b.sums(screener, light, epoch, step, steps))):
            cuts = np.cumsum([1, *(a.size for a in net.p.values())])
            yield float(v[0]), {k: v[i:j].reshape(a.shape) for (k, a), i, j in zip(net.p.items(), cuts, cuts[1:])}

    def losses(self, nets: list[MultiHead], plans: list[dict[int, list[tuple[int, ...]]]], everything: bool = False) -> tuple[list[float], list[dict[int, np.ndarray]]]:
        """Weights of the check rows (of all, if so told), and sums of losses, by round."""
        screener, light = self.screener, [net.light() for net in nets]

        def part(b):
            local = b.rows(screener)
            for net, plan, (_, check) in zip(light, plans, b.copies):
                check = b.n if everything else check
                yield np.concatenate([[float(check.sum())], *local.losses(net, check, plan, screener.config.mask_chunk).values()])

        out, got = [], self.summed(self.blocks, part)
        for plan, v in zip(plans, got):
            cuts = np.cumsum([1, *(len(x) for x in plan.values())])
            out.append({j: v[i:k] for j, i, k in zip(plan, cuts, cuts[1:])})
        return [float(v[0]) for v in got], out

    def run(self, total: int) -> list[tuple]:
        screener, c = self.screener, self.screener.config
        nets = [screener.network(k) for k in range(self.rounds)]
        train(nets, self.gradients, steps_of(total * (1 - c.validation_fraction), c.batch), c.epochs, c.learning_rate)
        if self.now is not None:
            self.now.unpersist()
        plan = screener.singles()
        weights, first = self.losses(nets, [plan] * self.rounds)
        if not all(weights):
            weights, first = self.losses(nets, [plan] * self.rounds, True)
        mean = [{j: v / w for j, v in own.items()} for own, w in zip(first, weights)]
        base = [{j: float(v[0]) for j, v in own.items()} for own in mean]
        single = [{j: {s: influence(float(x), b[j]) for (s,), x in zip(plan[j][1:], v[1:])} for j, v in own.items()} for own, b in zip(mean, base)]
        pairs = [screener.pairs(own) for own in single]
        both = self.losses(nets, pairs)[1] if any(pairs) else [{}] * self.rounds
        out = []
        for k in range(self.rounds):
            out += screener.rows(k, base[k], single[k], {j: dict(zip(pairs[k][j], map(float, v / weights[k]))) for j, v in both[k].items()})
        self.blocks.unpersist()
        return out


def step_rows(distinct: int, total: int, config) -> float:
    """Distinct rows that a step takes in, in the mean."""
    learn = total * (1 - config.validation_fraction)
    return min(distinct, learn / steps_of(learn, config.batch))


def kept_by_size(df: DataFrame) -> DataFrame:
    """df, persisted in as many partitions as its size asks for, not in as many as shuffles have at most."""
    conf, name = df.sparkSession.conf, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    old = conf.get(name)
    conf.set(name, "true")
    try:
        return df.persist()
    finally:
        conf.set(name, old)


def neural_edges(encoder, table: DataFrame, config, allowed: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(target, source, score) and (target, s1, s2, score), a row for each round."""
    profiles = encoder.profiles
    names = [p.name for p in profiles]
    blocks, at = [], 0
    for p in profiles:
        width = len(p.categories) if p.kind == "categorical" else 1
        blocks.append(slice(at, at + width))
        at += width
    sizes = [len(p.categories) if p.kind == "categorical" else 0 for p in profiles]
    screener, rounds = Screener(names, blocks, sizes, config, allowed), max(config.bootstraps, 1)
    keys = [F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)]
    there, types = [F.col(f"`{n}`") for n in names if n in table.columns], dict(table.dtypes)
    if any(p.kind == "categorical" and types.get(p.name) in ("float", "double") for p in profiles):  # -0.0 and 0.0 are one group, but two texts
        equal = table.select(*there, F.lit(1).cast("long").alias("_n"))
    else:
        equal = table.groupBy(*there).agg(F.count(F.lit(1)).alias("_n"))  # before texts become arrays
    plain = encoder.encoded(equal, keep=("_n",)).select(*keys, "features", "_n")
    own = [c for c in plain.columns if c != "_n"]
    rows = kept_by_size(plain.groupBy(*own).agg(F.sum("_n").alias("_n")).withColumn("_h", F.xxhash64(*own)))
    size = rows.agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("_n"), F.lit(0)).alias("all")).first()
    if size["distinct"] <= config.max_rows and step_rows(size["distinct"], size["all"], config) < STEP_ROWS:
        few = rows.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))

        def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_h", kind="stable")  # rows come in any order
            x, ys = screener.matrix(np.stack(pdf["features"].to_list()), {n: pdf[f"_c{i}"].to_numpy() for i, n in enumerate(names)})
            local = LocalRows(x, ys, pdf["_h"].to_numpy().view(np.uint64), pdf["_n"].to_numpy())
            return pd.DataFrame(screener.run_local(int(key[0]), local, size["all"]), columns=["boot", "target", "s1", "s2", "score"])

        out = few.groupBy("boot").applyInPandas(one, ROUNDS).persist()
    else:
        out = table.sparkSession.createDataFrame(FarRows(screener, rows, rounds).run(size["all"]), ROUNDS)
        rows.unpersist()
    return out.where(F.col("s2").isNull()).select("target", F.col("s1").alias("source"), "score"), out.where(F.col("s2").isNotNull()).select("target", "s1", "s2", "score")
