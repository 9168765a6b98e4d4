"""Small directed graphs on the driver (nodes are columns), and the same questions asked of an edge table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Dag:
    """Nodes and parent -> child edges, both in the order in which they came. A graph is not changed once it is made.

    Parents and children are looked up, and ``closed`` keeps what each node reaches as a set of bits, which an added edge
    extends; a graph that differs by an edge shares all else."""

    def __init__(self, nodes: Iterable[str], edges: Iterable[tuple[str, str]] = ()):
        self.nodes = list(dict.fromkeys(nodes))
        self._edges = dict.fromkeys(edges)
        self._place = {n: i for i, n in enumerate(self.nodes)}
        self._children: dict[str, tuple[str, ...]] = {}
        self._parents: dict[str, tuple[str, ...]] = {}
        self._below: list[int] | None = None  # by node, the nodes that it reaches
        for p, c in self._edges:
            self._children[p] = (*self._children.get(p, ()), c)
            self._parents[c] = (*self._parents.get(c, ()), p)
        self._parents = {c: tuple(sorted(p)) for c, p in self._parents.items()}

    def _like(self, edges: dict, parent: str, child: str) -> Dag:
        """A graph of other edges, between these two nodes only."""
        g = object.__new__(Dag)
        g.nodes, g._place, g._edges, g._below = self.nodes, self._place, edges, None
        g._children, g._parents = dict(self._children), dict(self._parents)
        there = (parent, child) in edges
        g._children[parent] = (*(c for c in self.children(parent) if c != child), *([child] if there else []))
        g._parents[child] = tuple(sorted([*(p for p in self.parents(child) if p != parent), *([parent] if there else [])]))
        return g

    def edges(self) -> list[tuple[str, str]]:
        """In node order of the parent, then as added."""
        return [(p, c) for p in self.nodes for c in self._children.get(p, ())]

    def has(self, parent: str, child: str) -> bool:
        return (parent, child) in self._edges

    def parents(self, child: str) -> tuple[str, ...]:
        return self._parents.get(child, ())

    def children(self, parent: str) -> list[str]:
        return list(self._children.get(parent, ()))

    def in_degree(self, node: str) -> int:
        return len(self._parents.get(node, ()))

    def out_degree(self, node: str) -> int:
        return len(self._children.get(node, ()))

    def __len__(self) -> int:
        return len(self._edges)

    def plus(self, parent: str, child: str) -> Dag:
        if (parent, child) in self._edges:
            return self
        g = self._like({**self._edges, (parent, child): None}, parent, child)
        if self._below is not None:
            own, at, more = 1 << self._place[parent], self._place[parent], self._below[self._place[child]] | 1 << self._place[child]
            g._below = [b | more if i == at or b & own else b for i, b in enumerate(self._below)]
        return g

    def minus(self, parent: str, child: str) -> Dag:
        return self._like({e: None for e in self._edges if e != (parent, child)}, parent, child)

    def closed(self) -> Dag:
        """This graph, with what each node reaches at hand (if it has no cycle)."""
        if self._below is None and len(order := self.order()) == len(self.nodes):
            below = [0] * len(self.nodes)
            for n in reversed(order):
                for c in self._children.get(n, ()):
                    below[self._place[n]] |= below[self._place[c]] | 1 << self._place[c]
            self._below = below
        return self

    def reaches(self, start: str, goal: str) -> bool:
        if start == goal:
            return True
        if self._below is not None:
            return bool(self._below[self._place[start]] >> self._place[goal] & 1)
        seen, todo = set(), [start]
        while todo:
            n = todo.pop()
            if n == goal:
                return True
            if n not in seen:
                seen.add(n)
                todo += self.children(n)
        return False

    def acyclic(self) -> bool:
        return len(self.order()) == len(self.nodes)

    def order(self) -> list[str]:
        """Parents before children; short, if there is a cycle."""
        left = {n: self.in_degree(n) for n in self.nodes}
        out, ready = [], [n for n in self.nodes if not left[n]]
        while ready:
            n = ready.pop(0)
            out.append(n)
            for c in self.children(n):
                left[c] -= 1
                if not left[c]:
                    ready.append(c)
        return out

    def families(self) -> list[tuple[str, tuple[str, ...]]]:
        return [(n, self.parents(n)) for n in self.nodes]

    def blanket(self, node: str) -> set[str]:
        children = self.children(node)
        return (set(self.parents(node)) | set(children) | {p for c in children for p in self.parents(c)}) - {node}


def maximum_spanning_tree(nodes: list[str], weights: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """Kruskal: heaviest first, ties in the order given."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    out = []
    for (a, b), _ in sorted(weights.items(), key=lambda x: -x[1]):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[rb] = ra
            out.append((a, b))
    return out


def orient_from(nodes: list[str], tree: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The tree's edges away from the first node, breadth first."""
    near: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in tree:
        near[a].append(b)
        near[b].append(a)
    out, seen, todo = [], {nodes[0]}, [nodes[0]]
    while todo:
        n = todo.pop(0)
        for m in near[n]:
            if m not in seen:
                seen.add(m)
                out.append((n, m))
                todo.append(m)
    return out


# --- edge tables ---------------------------------------------------------------------------------------------------------


def reachability(edges: DataFrame, max_depth: int) -> DataFrame:
    """Distinct (source, target, ) pairs joined by a path of at most ``max_depth`` edges: repeated joins with the edges."""
    e = edges.select("source", "target").distinct()
    out, step = e, e
    for _ in range(max_depth - 1):
        step = step.alias("a").join(e.alias("b"), F.col("a.target") == F.col("b.source")).select(F.col("a.source").alias("source"), F.col("b.target").alias("target")).distinct()
        out = out.union(step).distinct()
    return out


def markov_blanket(edges: DataFrame, node: str) -> DataFrame:
    """member, role: parent, child or spouse (the first that applies)."""
    parents = edges.where(F.col("target") == node).select(F.col("source").alias("member"), F.lit(1).alias("r"))
    children = edges.where(F.col("source") == node).select(F.col("target").alias("member"), F.lit(2).alias("r"))
    spouses = edges.join(children.select(F.col("member").alias("target")), "target", "left_semi").where(F.col("source") != node).select(F.col("source").alias("member"), F.lit(3).alias("r"))
    role = F.element_at(F.array(F.lit("parent"), F.lit("child"), F.lit("spouse")), F.min("r"))
    return parents.union(children).union(spouses).groupBy("member").agg(role.alias("role"))
