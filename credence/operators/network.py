"""Discrete Bayesian networks: fitting from family counts and class posteriors as one projection.

A table of probabilities becomes a literal array indexed by the flat parent index, so scoring needs no join and fuses with
the scan. Tables above ``LITERAL_CELLS`` cells are read by batch or joined (see ``gather``); families that are too large for an
array are kept as the cells that were observed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EPS, arg_max
from .counts import Cells, CountStore, Family
from .gather import class_terms, helper_columns, literal_term
from .graph import Dag
from .scores import smoothed

LITERAL_CELLS = 5_000


def softmax(df: DataFrame, components: list[list[Column]], textbook: bool = False) -> DataFrame:
    """``probabilities`` and ``prediction`` from log scores by class: each component is exponentiated after a shift by its
    own maximum (none, if ``textbook``) and the components are added.

    Scores are columns of their own and each step is a projection of its own, so nothing is computed twice and all of it is
    generated code."""
    classes = len(components[0])
    kept = df.columns
    name = lambda i, k: f"_z{i}_{k}"
    out = df.select("*", *[c.alias(name(i, k)) for i, part in enumerate(components) for k, c in enumerate(part)])
    top = lambda i: F.lit(0.0) if textbook else F.greatest(*[F.col(name(i, k)) for k in range(classes)]) if classes > 1 else F.col(name(i, 0))
    out = out.select("*", *[top(i).alias(f"_t{i}") for i in range(len(components))])
    out = out.select(*[F.col(f"`{c}`") for c in kept], *[reduce(lambda a, b: a + b, [F.exp(F.col(name(i, k)) - F.col(f"_t{i}")) for i in range(len(components))]).alias(f"_e{k}") for k in range(classes)])
    out = out.select("*", reduce(lambda a, b: a + b, [F.col(f"_e{k}") for k in range(classes)]).alias("_sum"))
    out = out.select(*[F.col(f"`{c}`") for c in kept], F.array(*[F.col(f"_e{k}") / F.col("_sum") for k in range(classes)]).alias("probabilities"))
    return out.select("*", arg_max(F.col("probabilities")).alias("prediction"))


class BayesNet:
    def __init__(self, target: str, graph: Dag, cards: dict[str, int], tables: dict[Family, np.ndarray | Cells], laplace: float = 1.0):
        self.target, self.graph, self.cards, self.tables, self.laplace = target, graph, cards, tables, laplace

    @classmethod
    def fit(cls, store: CountStore, graph: Dag, target: str, laplace: float = 1.0) -> BayesNet:
        families = graph.families()
        store.ensure(families)
        return cls(target, graph, store.cards, {f: cls._table(store, f, laplace) for f in families}, laplace)

    @staticmethod
    def _table(store: CountStore, family: Family, laplace: float) -> np.ndarray | Cells:
        return smoothed(store.get(*family), laplace) if store.dense(family) else store.cells(family)

    def with_graph(self, store: CountStore, graph: Dag) -> BayesNet:
        """The network of another graph: tables of unchanged families are kept."""
        new = [f for f in graph.families() if f not in self.tables]
        store.ensure(new)
        tables = {f: self.tables[f] if f in self.tables else self._table(store, f, self.laplace) for f in graph.families()}
        return BayesNet(self.target, graph, self.cards, tables, self.laplace)

    def relevant(self) -> list[Family]:
        """Families whose factor depends on the class; the others cancel."""
        return [f for f in self.graph.families() if f[0] == self.target or self.target in f[1]]

    def node_probability(self, values: dict[str, int], node: str) -> float:
        parents, table = self.graph.parents(node), self.tables[node, self.graph.parents(node)]
        if isinstance(table, Cells):
            there = reduce(lambda a, b: a & b, [F.col(f"`{c}`") == values[c] for c in parents])
            row = table.table.where(there).agg(F.sum("n").alias("all"), F.sum(F.when(F.col(f"`{node}`") == values[node], F.col("n"))).alias("own")).first()
            return ((row["own"] or 0) + self.laplace) / ((row["all"] or 0) + self.laplace * self.cards[node])
        at = 0
        for p in parents:
            at = at * self.cards[p] + values[p]
        return float(table[at, values[node]])

    def factors(self) -> list[tuple[Family, np.ndarray | Cells]]:
        """The relevant families with the logarithms of their tables."""
        return [(f, self.tables[f] if isinstance(self.tables[f], Cells) else np.log(self.tables[f] + EPS)) for f in self.relevant()]

    @property
    def is_small(self) -> bool:
        """Whether all tables that the class depends on are arrays."""
        return not any(isinstance(self.tables[f], Cells) for f in self.relevant())

    def class_scores(self, prefix: str = "") -> list[Column]:
        """A log score for each class, as literals."""
        column = lambda c: F.col(f"`{prefix}{c}`")
        return [reduce(lambda a, b: a + b, [literal_term(f, t, k, self.cards, self.target, column) for f, t in self.factors()]) for k in range(self.cards[self.target])]

    def posterior(self, codes: DataFrame, prefix: str = "") -> DataFrame:
        """All columns, ``probabilities`` and ``prediction``."""
        rows, scores = class_terms(codes, [self.factors()], self.cards, self.target, self.laplace, prefix, LITERAL_CELLS)
        helpers = [c for c in helper_columns(rows) if c not in codes.columns]
        return softmax(rows, scores).drop(*helpers)

    def posterior_local(self, codes: dict[str, np.ndarray]) -> np.ndarray:
        """Class probabilities of rows on the driver; codes below 0 or beyond the cardinality count as unknown."""
        out = sum((self.term_local(f, codes) for f in self.relevant()), np.zeros((len(next(iter(codes.values()))), self.cards[self.target])))
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    def term_local(self, family: Family, codes: dict[str, np.ndarray]) -> np.ndarray:
        """What a family adds to the log score of each row and class."""
        node, parents = family
        n = len(next(iter(codes.values())))
        table, out = np.log(self.tables[family] + EPS), np.zeros((n, self.cards[self.target]))
        for k in range(out.shape[1]):
            at, inside = np.zeros(n, np.int64), np.ones(n, bool)
            for c in (*parents, node):
                v = np.full(n, k) if c == self.target else codes[c]
                inside &= (v >= 0) & (v < self.cards[c])
                at = at * self.cards[c] + v
            out[:, k] = np.where(inside, table.reshape(-1)[np.where(inside, at, 0)], np.log(1 / self.cards[node] + EPS))
        return out
