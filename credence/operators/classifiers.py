"""Classifiers of fixed shape: naive Bayes, tree-augmented, k-dependence, averaged one-dependence."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame

from ..functions.columns import EPS
from .counts import CountStore
from .gather import class_terms, helper_columns
from .graph import Dag, maximum_spanning_tree, orient_from
from .information import collected, mi_matrix
from .network import softmax


def naive_bayes_graph(columns: list[str], target: str) -> Dag:
    return Dag(columns, [(target, c) for c in columns if c != target])


def tan_graph(store: CountStore, target: str) -> Dag:
    """Features form the maximum spanning tree of their information given the class, away from the first feature."""
    features = [c for c in store.columns if c != target]
    g = naive_bayes_graph(store.columns, target)
    if len(features) < 2:
        return g
    m = collected(mi_matrix(store.collapsed, features, target))
    weights = {(a, b): m[a, b] for i, a in enumerate(features) for b in features[i + 1 :]}
    for p, c in orient_from(features, maximum_spanning_tree(features, weights)):
        g = g.plus(p, c)
    return g


def kdb_graph(store: CountStore, target: str, k: int = 2) -> Dag:
    """Features by information with the class; each takes the k earlier ones that tell most about it given the class."""
    features = [c for c in store.columns if c != target]
    with_class = collected(mi_matrix(store.collapsed, store.columns))
    between = collected(mi_matrix(store.collapsed, features, target)) if len(features) > 1 else {}
    ranking = sorted(features, key=lambda f: -with_class[f, target])
    g = naive_bayes_graph(store.columns, target)
    for i, f in enumerate(ranking):
        for p in sorted(ranking[:i], key=lambda p, f=f: -between[f, p])[:k]:
            g = g.plus(p, f)
    return g


class Aode:
    """One component for each super-parent; each is shifted by its own maximum before they are added (set ``textbook`` to
    add the plain joint probabilities instead)."""

    def __init__(self, store: CountStore, target: str, laplace: float = 1.0, textbook: bool = False):
        self.target, self.cards, self.textbook = target, store.cards, textbook
        self.features = [c for c in store.columns if c != target]
        self.laplace = laplace
        child = {(p, c): (c, (target, p)) for p in self.features for c in self.features if c != p}
        store.ensure([*((p, (target,)) for p in self.features), *child.values()])
        self.joint, self.child = {}, {}
        for p in self.features:
            if store.dense((p, (target,))):
                n = store.get(p, (target,))  # class by value
                self.joint[p] = np.log((n + laplace) / (n.sum() + laplace * n.size) + EPS)
            else:
                self.joint[p] = replace(store.cells((p, (target,))), total=store.rows)
        for key, family in child.items():
            if not store.dense(family):
                self.child[key] = store.cells(family)
                continue
            m = store.get(*family)
            self.child[key] = np.log((m + laplace) / (m.sum(1, keepdims=True) + laplace * m.shape[1]) + EPS)

    def groups(self) -> list[list]:
        """Factors of each super-parent's component."""
        out = []
        for p in self.features:
            own = [((p, (self.target,)), self.joint[p])]
            out.append(own + [((c, (self.target, p)), self.child[p, c]) for c in self.features if c != p])
        return out

    def posterior(self, codes: DataFrame, prefix: str = "") -> DataFrame:
        rows, scores = class_terms(codes, self.groups(), self.cards, self.target, self.laplace, prefix)
        helpers = [c for c in helper_columns(rows) if c not in codes.columns]
        return softmax(rows, scores, self.textbook).drop(*helpers)
