"""Generated tables: a random mixed graph, and forward samples of a discrete network.

Rows are made by column expressions over ``spark.range`` in topological order, so any number of rows can be made where
they are needed; the graph itself is drawn on the driver.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Dag
from . import files

#: Target column and seed of the three expert networks, each sampled with 2,500 rows.
EXPERT_TARGETS = {"alarm": ("PRESS", 1701), "child": ("LowerBodyO2", 1703), "insurance": ("CarValue", 1705)}
EXPERT_ROWS = 2_500


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mixed_dataset(spark: SparkSession, rows: int = 500, features: int = 6, seed: int = 7) -> tuple[DataFrame, Dag]:
    """x0 … (even: 0/1, odd: real) and ``label`` (yes/no). Each earlier feature is a parent with probability 0.25 and enters
    as 0.7 tanh; the label depends on its parents by a logistic."""
    rng = np.random.default_rng(seed)
    names = [f"x{i}" for i in range(features)]
    edges = [(a, b) for j, b in enumerate(names) for a in names[:j] if rng.random() < 0.25]
    causes = [n for n in names if rng.random() < 0.5] or [names[int(rng.integers(features))]]
    df = spark.range(rows)
    pull = lambda ps, w, f=lambda c: c: sum((F.lit(w) * f(F.col(p).cast("double")) for p in ps), F.lit(0.0))
    for j, n in enumerate(names):
        drive = pull([a for a, b in edges if b == n], 0.7, F.tanh)
        if j % 2 == 0:
            value = (F.rand(seed * 1000 + j) < _sigmoid(drive)).cast("int")
        else:
            value = drive + 0.5 * F.randn(seed * 1000 + j)
        df = df.withColumn(n, value)
    score = pull(causes, 0.8) + 0.6 * F.randn(seed * 1000 + 997)
    df = df.withColumn("label", F.when(F.rand(seed * 1000 + 998) < _sigmoid(score), "yes").otherwise("no"))
    return df.drop("id"), Dag([*names, "label"], [*edges, *((c, "label") for c in causes)])


def random_tables(graph: Dag, cards: dict[str, int], seed: int, concentration: float = 0.5) -> dict[str, np.ndarray]:
    """Random conditional tables for a graph, parents in name order by values."""
    rng = np.random.default_rng(seed)
    return {n: rng.dirichlet([concentration] * cards[n], int(np.prod([cards[p] for p in graph.parents(n)], dtype=int))) for n in graph.nodes}


def forward_sample(spark: SparkSession, graph: Dag, tables: dict[str, np.ndarray], cards: dict[str, int], rows: int, seed: int) -> DataFrame:
    """Ancestral sampling: each node by the inverse of its cumulative table at a uniform draw."""
    df = spark.range(rows)
    for k, n in enumerate(graph.order()):
        parents = graph.parents(n)
        index = F.lit(0)
        for p in parents:
            index = index * cards[p] + F.col(f"`{p}`")
        cumulative = F.lit(np.cumsum(tables[n], 1)[:, :-1].tolist())
        df = df.withColumn("_u", F.rand(seed * 1000 + k)).withColumn(n, F.size(F.filter(F.element_at(cumulative, index.cast("int") + 1), lambda c: c <= F.col("_u"))) if cards[n] > 1 else F.lit(0))
    return df.select(*[F.col(f"`{n}`") for n in graph.nodes])


def read_bif(text: str) -> tuple[Dag, dict[str, int], dict[str, np.ndarray], dict[str, list[str]]]:
    """A network in the Bayesian interchange format: graph, cardinalities, tables (parents in name order) and state names."""
    states: dict[str, list[str]] = {}
    for m in re.finditer(r"variable\s+(\S+)\s*\{[^{}]*\{([^{}]*)\}", text):
        states[m[1]] = [x.strip() for x in m[2].split(",")]
    edges, given = [], {}
    for m in re.finditer(r"probability\s*\(\s*([^)|]+?)\s*(?:\|\s*([^)]*?))?\s*\)\s*\{([^{}]*)\}", text):
        node, parents = m[1].strip(), [x.strip() for x in (m[2] or "").split(",") if x.strip()]
        given[node] = parents, m[3]
        edges += [(p, node) for p in parents]
    graph, cards = Dag(states, edges), {n: len(v) for n, v in states.items()}
    tables = {}
    for node, (parents, body) in given.items():
        shape = [cards[p] for p in parents]
        table = np.zeros([*shape, cards[node]])
        plain = re.search(r"table\s+([^;]*);", body)
        if plain:
            table[...] = np.array([float(x) for x in plain[1].split(",")]).reshape([cards[node], *shape] if parents else [cards[node]]).transpose([*range(1, len(parents) + 1), 0])
        for row in re.finditer(r"\(([^)]*)\)\s*([^;]*);", body):
            at = tuple(states[p].index(x.strip()) for p, x in zip(parents, row[1].split(",")))
            table[at] = [float(x) for x in row[2].split(",")]
        order = [parents.index(p) for p in graph.parents(node)]
        tables[node] = table.transpose([*order, len(parents)]).reshape(-1, cards[node])
        tables[node] = tables[node] / tables[node].sum(1, keepdims=True)
    return graph, cards, tables, states


def read_edges(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    lines = files.read_text(spark, path).split()
    return [tuple(x.split(",")[:2]) for x in lines[1:]]


def materialize_expert_networks(spark: SparkSession, root: str, names: list[str] | None = None, overwrite: bool = True, edges_from: str | None = None, card: int = 3) -> dict:
    """Write frame.csv, edges.csv and metadata.json for each expert network that is known (in ``edges_from``, or in the folder
    itself): from ``network.bif`` with its tables and states, or from ``edges.csv`` with tables drawn at random."""
    out = {}
    for name in names or list(EXPERT_TARGETS):
        target, seed = EXPERT_TARGETS[name]
        at = lambda file, folder=files.join(root, name): files.join(folder, file)
        if not overwrite and files.exists(spark, at("frame.csv")):
            out[name] = {"status": "exists"}
            continue
        source, bif = (files.join(edges_from or root, name, x) for x in ("edges.csv", "network.bif"))
        if files.exists(spark, bif):
            graph, cards, tables, states = read_bif(files.read_text(spark, bif))
            edges, note = graph.edges(), "forward sample, published tables"
        elif files.exists(spark, source):
            edges, note = read_edges(spark, source), "forward sample, random tables"
            graph = Dag([n for e in edges for n in e], edges)
            cards = dict.fromkeys(graph.nodes, card)
            tables, states = random_tables(graph, cards, seed), {n: [f"s{k}" for k in range(card)] for n in graph.nodes}
        else:
            out[name] = {"status": "skipped", "reason": f"no edges at {source}"}
            continue
        frame = forward_sample(spark, graph, tables, cards, EXPERT_ROWS, seed)
        named = frame.select(*[F.element_at(F.lit(states[c]), F.col(f"`{c}`").cast("int") + 1).alias(c) for c in frame.columns])
        files.write_text(spark, at("frame.csv"), named.toPandas().to_csv(index=False))  # EXPERT_ROWS rows
        files.write_text(spark, at("edges.csv"), "source,target\n" + "".join(f"{a},{b}\n" for a, b in edges))
        files.write_text(spark, at("metadata.json"), json.dumps({"target_column": target, "source": note, "notes": [f"seed {seed}", f"{EXPERT_ROWS} rows"]}, indent=2))
        out[name] = {"status": "written", "rows": EXPERT_ROWS, "edges": len(edges), "target": target}
    return out
