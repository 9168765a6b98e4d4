"""Family and graph scores: BIC, BDeu, smoothed tables, Markov-blanket likelihood, prior, hub penalty.

The DataFrame forms take counts of many families at once (f, q, v, n); the driver forms take one dense array, or the observed
cells of a family that is too large to be one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EPS, lgamma, log_sum_exp
from .counts import CountStore, Family, family_scores
from .gather import class_terms
from .graph import Dag


def bic(counts: np.ndarray) -> float:
    """Log likelihood less half ln N for each free parameter, of all configurations, seen or not."""
    row = counts.sum(1, keepdims=True)
    n = counts[counts > 0]
    like = float((n * np.log((counts / np.maximum(row, 1))[counts > 0])).sum())
    q, r = counts.shape
    return like - 0.5 * q * (r - 1) * math.log(max(counts.sum(), 1.0))


def bdeu(counts: np.ndarray, ess: float) -> float:
    q, r = counts.shape
    lg = np.vectorize(math.lgamma, otypes=[float])
    a_row, a = ess / q, ess / (q * r)
    seen = counts[counts.sum(1) > 0]
    if not len(seen):
        return 0.0
    return float((math.lgamma(a_row) - lg(a_row + seen.sum(1))).sum() + (lg(a + seen) - math.lgamma(a)).sum())


def cells_score(n: np.ndarray, row_of: np.ndarray, shape: tuple[int, int], kind: str, ess: float) -> float:
    """``bic`` or ``bdeu`` from observed cells and the configuration of each."""
    q, r = shape
    row = np.bincount(row_of, n)
    if kind != "bdeu":
        return float((n * np.log(n / row[row_of])).sum()) - 0.5 * q * (r - 1) * math.log(max(n.sum(), 1.0))
    lg = np.vectorize(math.lgamma, otypes=[float])
    a_row, a = ess / q, ess / (q * r)
    return float((lg(a + n) - math.lgamma(a)).sum() + (math.lgamma(a_row) - lg(a_row + row[row > 0])).sum()) if len(n) else 0.0


def smoothed(counts: np.ndarray, laplace: float) -> np.ndarray:
    return (counts + laplace) / (counts.sum(1, keepdims=True) + laplace * counts.shape[1])


def family_bic(counts: DataFrame) -> DataFrame:
    """f, bic from complete counts."""
    row = F.sum("n").over(Window.partitionBy("f", "q"))
    c = counts.withColumn("row", row)
    like = F.sum(F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / F.col("row"))).otherwise(0.0))
    g = c.groupBy("f").agg(like.alias("like"), F.max("q").alias("q"), F.max("v").alias("v"), F.sum("n").alias("total"))
    return g.select("f", (F.col("like") - 0.5 * (F.col("q") + 1) * F.col("v") * F.log("total")).alias("bic"))


def family_bdeu(counts: DataFrame, ess: float) -> DataFrame:
    """f, bdeu from complete counts."""
    size = counts.groupBy("f").agg((F.max("q") + 1).alias("nq"), (F.max("v") + 1).alias("nr"))
    c = counts.where(F.col("n") > 0).join(F.broadcast(size), "f")  # one row a family
    a, a_row = F.lit(ess) / (F.col("nq") * F.col("nr")), F.lit(ess) / F.col("nq")
    cells = c.groupBy("f", "q", "nq", "nr").agg(F.sum("n").alias("row"), F.sum(lgamma(a + F.col("n")) - lgamma(a)).alias("cells"))
    return cells.groupBy("f").agg(F.sum(F.col("cells") + lgamma(a_row) - lgamma(a_row + F.col("row"))).alias("bdeu"))


def cpd(counts: DataFrame, laplace: float = 1.0) -> DataFrame:
    """f, q, v, n, p from complete counts."""
    w = Window.partitionBy("f", "q")
    return counts.select("*", ((F.col("n") + laplace) / (F.sum("n").over(w) + laplace * F.count(F.lit(1)).over(w))).alias("p"))


#: Blankets of one job; more would widen the plan beyond use.
BLANKETS = 24


class GraphScorer:
    """Scores graphs over one table. Families are scored once; proposals are scored by what changed."""

    def __init__(self, store: CountStore, target: str, config, support: dict[tuple[str, str], float] | None = None):
        self.store, self.target, self.config, self.support = store, target, config, support or {}
        self.local: dict[Family, float] = {}
        self.blankets: dict[tuple, float] = {}

    def family(self, node: str, parents: tuple[str, ...]) -> float:
        f = (node, parents)
        if f not in self.local:
            self.score_families([f])
        return self.local[f]

    def score_families(self, families: list[Family]) -> None:
        """Scores of those not known yet. Arrays are scored on the driver, as many at a time as the store holds; large families
        from their cells, where these are."""
        c = self.config
        new = [f for f in dict.fromkeys(families) if f not in self.local]
        large = [f for f in new if not self.store.dense(f)]
        if large and self.store.local is None:
            self.local |= dict(zip(large, family_scores(self.store.collapsed, large, self.store.cards, c.score, c.equivalent_sample_size)))
        elif large:
            self.local |= {f: cells_score(*self.store.local_cells(f), self.store.shape(f), c.score, c.equivalent_sample_size) for f in large}
        for part in self.store.parts([f for f in new if f not in self.local]):
            self.store.ensure(part)
            for f in part:
                n = self.store.get(*f)
                self.local[f] = bdeu(n, c.equivalent_sample_size) if c.score == "bdeu" else bic(n)

    def edge_support(self, parent: str, child: str) -> float:
        return self.support.get((child, parent), 0.0)

    def blanket_key(self, g: Dag) -> tuple:
        return g.parents(self.target), tuple(sorted((c, g.parents(c)) for c in g.children(self.target)))

    def blanket_families(self, key: tuple) -> list[Family]:
        return [(self.target, key[0]), *key[1]]

    def blanket_log_likelihood(self, key: tuple) -> float:
        """Sum over rows of ln p(target | its Markov blanket)."""
        if key in self.blankets:
            return self.blankets[key]
        value = self._blanket_local(key) if self.store.local is not None else self._blanket_far([key])[0]
        self.blankets[key] = value
        return value

    def _blanket_local(self, key: tuple) -> float:
        store, classes = self.store, self.store.cards[self.target]
        held = [{self.target: k} for k in range(classes)]
        s = np.zeros((len(store.weight), classes))
        for node, parents in self.blanket_families(key):
            if store.dense((node, parents)):
                t = np.log(smoothed(store.get(node, parents), self.config.laplace) + EPS)
                for k in range(classes):
                    s[:, k] += t[store.index(parents, held[k]), k if node == self.target else store.local[node]]
            else:
                n, row = store.looked_up((*parents, node), held), store.looked_up(parents, held)
                s += np.log((n + self.config.laplace) / (row + self.config.laplace * store.cards[node]) + EPS).T
        top = s.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(s - top).sum(1))
        return float((store.weight * (s[np.arange(len(s)), store.local[self.target]] - total)).sum())

    def _blanket_far(self, keys: list[tuple]) -> list[float]:
        """Sums of several blankets, in one job."""
        classes = self.store.cards[self.target]
        groups = [[(f, self._log_table(f)) for f in self.blanket_families(key)] for key in keys]
        rows, terms = class_terms(self.store.collapsed, groups, self.store.cards, self.target, self.config.laplace)
        sums = []
        for i, t in enumerate(terms):
            scores = F.array(*t)
            own = F.element_at(scores, F.col(f"`{self.target}`") + 1)
            sums.append(F.sum(F.col("w") * (own - log_sum_exp(scores))).alias(str(i)))
        assert all(len(t) == classes for t in terms)
        return [float(x) for x in rows.agg(*sums).first()]

    def _log_table(self, f: Family):
        if not self.store.dense(f):
            return self.store.cells(f)
        return np.log(smoothed(self.store.get(*f), self.config.laplace) + EPS)

    def prior(self, g: Dag) -> float:
        e = g.edges()
        return sum(2 * self.edge_support(p, c) - 1 for p, c in e) / len(e) if e else 0.0

    @staticmethod
    def hub_penalty(g: Dag) -> float:
        n = max(len(g.nodes), 1)
        return sum(max(g.out_degree(x) - 2, 0) for x in g.nodes) / n / n

    def contribution(self, g: Dag, parent: str, child: str) -> float:
        """What the edge adds to its child's family score."""
        parents = g.parents(child)
        return self.family(child, parents) - self.family(child, tuple(p for p in parents if p != parent)) if parent in parents else 0.0

    def prepare(self, graphs: list[Dag]) -> None:
        """Count what the graphs need in one job, and sum up all their blankets in another (or a few, if they are many)."""
        self.score_families([f for g in graphs for f in g.families()])
        if self.store.local is not None or not self.config.discriminative_weight:
            return
        new = [k for k in dict.fromkeys(map(self.blanket_key, graphs)) if k not in self.blankets]
        self.store.ensure([f for k in new for f in self.blanket_families(k)])
        for a in range(0, len(new), BLANKETS):
            part = new[a : a + BLANKETS]
            self.blankets |= dict(zip(part, self._blanket_far(part)))

    def score(self, g: Dag) -> dict[str, float]:
        unit = max(self.store.rows, 1.0) if self.config.normalize_by_samples else 1.0
        gen = sum(self.family(n, p) for n, p in g.families()) / unit
        disc = self.blanket_log_likelihood(self.blanket_key(g)) / unit if self.config.discriminative_weight else 0.0
        prior, hub = self.prior(g), self.hub_penalty(g)
        c = self.config
        total = c.generative_weight * gen + c.discriminative_weight * disc + c.edge_prior_weight * prior - c.hub_penalty_weight * hub
        return {"total": total, "generative": gen, "discriminative": disc, "prior": prior, "hub": hub}
