"""Log scores of rows by class from probability tables of any size: one stage that all classifiers share.

A factor is a family and its table: an array of log probabilities (parent configurations by values), or the ``Cells`` that a
family of more configurations was observed in. How a factor's numbers reach the rows depends on their size:

* an array of few cells is a literal, indexed in generated code (and no plan holds more than ``LITERALS`` numbers of them);
* larger arrays, up to ``BROADCAST`` numbers together, are broadcast once and read by Arrow batch, whatever their number;
* arrays beyond that, and ``Cells``, are joined on the codes they are indexed by. Smoothing happens after the join, so cells that
  do not occur take no room.

Codes that are null or outside of what training saw count as equally likely values. Helper columns begin with ``_g``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import EPS, flat_index
from .counts import Cells, Family

LITERAL_CELLS = 5_000
LITERALS = 100_000  # numbers of all literals, each counted once for each class
BROADCAST = 20_000_000

Factor = tuple[Family, "np.ndarray | Cells"]


def _inside(columns: list[tuple[str, Column]], cards: dict[str, int]) -> Column:
    return reduce(lambda a, b: a & b, [c.between(0, cards[n] - 1) for n, c in columns], F.lit(True))


def _uniform(family: Family, cards: dict[str, int]) -> float:
    return float(np.log(1 / cards[family[0]] + EPS))


def literal_term(family: Family, table: np.ndarray, k: int, cards: dict[str, int], target: str, column) -> Column:
    """The factor's log probability if the target has value k."""
    node, parents = family
    at = [F.lit(k) if p == target else column(p) for p in parents]
    value = F.lit(k) if node == target else column(node)
    index = flat_index([*at, value], [*(cards[p] for p in parents), cards[node]])
    inside = _inside([*zip(parents, at), (node, value)], cards)
    return F.when(inside, F.element_at(F.lit(table.reshape(-1).tolist()), index.cast("int") + 1)).otherwise(F.lit(_uniform(family, cards)))


def by_class(family: Family, table: np.ndarray, cards: dict[str, int], target: str) -> tuple[list[str], np.ndarray]:
    """The columns other than the target, and the table as their configurations by classes."""
    names = [*family[1], family[0]]
    full = table.reshape([cards[x] for x in names])
    return [x for x in names if x != target], np.ascontiguousarray(np.moveaxis(full, names.index(target), -1)).reshape(-1, cards[target])


def _read_by_batch(df: DataFrame, factors: list[tuple[int, Family, np.ndarray]], groups: int, cards: dict[str, int], target: str, name) -> DataFrame:
    """df with ``_gsum``: for each group and class the sum of the factors' terms."""
    classes = cards[target]
    kept = []
    for g, family, table in factors:
        others, moved = by_class(family, table, cards, target)
        kept.append((g, [name(x) for x in others], [cards[x] for x in others], moved, _uniform(family, cards)))
    held = df.sparkSession.sparkContext.broadcast(kept)
    schema = T.StructType([*df.schema.fields, T.StructField("_gsum", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            codes: dict[str, np.ndarray] = {}
            out = np.zeros((b.num_rows, groups, classes))
            for g, others, sizes, moved, unknown in held.value:
                at, inside = np.zeros(b.num_rows, np.int64), np.ones(b.num_rows, bool)
                for c, size in zip(others, sizes):
                    if c not in codes:
                        codes[c] = b.column(c).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
                    inside &= (codes[c] >= 0) & (codes[c] < size)
                    at = at * size + codes[c]
                out[:, g] += np.where(inside[:, None], moved[np.where(inside, at, 0)], unknown)
            each = groups * classes
            sums = pa.ListArray.from_arrays(pa.array(np.arange(0, (b.num_rows + 1) * each, each), pa.int32()), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, sums], names=schema.names)

    return df.mapInArrow(run, schema)


def _joined(df: DataFrame, n: int, keys: list[str], right: DataFrame, name) -> DataFrame:
    """df with the right side's columns where the codes are equal; right: a column k0.. for each key."""
    on = reduce(lambda a, b: a & b, [F.col(f"`{name(c)}`") == F.col(f"_gk{n}_{i}") for i, c in enumerate(keys)])
    return df.join(right.withColumnsRenamed({f"k{i}": f"_gk{n}_{i}" for i in range(len(keys))}), on, "left").drop(*[f"_gk{n}_{i}" for i in range(len(keys))])


def _array_joined(df: DataFrame, n: int, family: Family, table: np.ndarray, cards: dict[str, int], target: str, name) -> tuple[DataFrame, list[Column]]:
    others, moved = by_class(family, table, cards, target)
    flat = pa.array(moved.reshape(-1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, moved.size + 1, moved.shape[1]), pa.int32()), flat)
    right = df.sparkSession.createDataFrame(pa.table({"_gi": pa.array(np.arange(len(moved))), f"_gs{n}": lists}))
    at = F.when(_inside([(c, F.col(f"`{name(c)}`")) for c in others], cards), flat_index([F.col(f"`{name(c)}`").cast("long") for c in others], [cards[c] for c in others]))
    out = df.withColumn(f"_ga{n}", at.cast("long"))
    out = out.join(right, F.col(f"_ga{n}") == F.col("_gi"), "left").drop("_gi")
    return out, [F.coalesce(F.element_at(F.col(f"_gs{n}"), k + 1), F.lit(_uniform(family, cards))) for k in range(cards[target])]


def _cells_joined(df: DataFrame, n: int, cells: Cells, laplace: float, target: str, name) -> tuple[DataFrame, list[Column]]:
    node, parents = cells.family
    cards, classes = cells.cards, cells.cards[target]

    def with_counts(out: DataFrame, columns: list[str], label: str) -> tuple[DataFrame, list[Column]]:
        """The rows of the columns' configuration, by class."""
        own = F.array(*[F.sum(F.when(F.col(f"`{target}`") == k, F.col("n")).otherwise(0)).cast("double") for k in range(classes)])
        if not columns:
            return out, [F.lit(x) for x in cells.table.agg(own).first()[0]]
        right = cells.table.groupBy(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)]).agg(own.alias(label))
        return _joined(out, n, columns, right, name), [F.coalesce(F.element_at(F.col(label), k + 1), F.lit(0.0)) for k in range(classes)]

    others = [c for c in (*parents, node) if c != target]
    out, cell = with_counts(df, others, f"_gs{n}")
    values = cards[node]
    if cells.total is not None:
        row, values = [F.lit(cells.total)] * classes, cells.size
    elif node == target:
        row = [reduce(lambda a, b: a + b, cell)] * classes
    else:
        out, row = with_counts(out, [c for c in parents if c != target], f"_gt{n}")
    inside = _inside([(c, F.col(f"`{name(c)}`")) for c in others], cards)
    terms = [F.when(inside, F.log((c + laplace) / (r + laplace * values) + EPS)).otherwise(F.lit(_uniform(cells.family, cards))) for c, r in zip(cell, row)]
    return out, terms


def class_terms(df: DataFrame, groups: list[list[Factor]], cards: dict[str, int], target: str, laplace: float = 1.0, prefix: str = "", literal: int | None = None) -> tuple[DataFrame, list[list[Column]]]:
    """df with helper columns, and for each group of factors a log score for each class. ``prefix`` precedes the columns' names."""
    classes = cards[target]
    name = lambda c: prefix + c
    column = lambda c: F.col(f"`{prefix}{c}`")
    sums: list[list[Column | None]] = [[None] * classes for _ in groups]

    def add(g: int, terms: list[Column]) -> None:
        sums[g] = [t if s is None else s + t for s, t in zip(sums[g], terms)]

    limit = LITERAL_CELLS if literal is None else literal
    arrays = sorted(((table.size, g, i) for g, own in enumerate(groups) for i, (_, table) in enumerate(own) if isinstance(table, np.ndarray)), key=lambda x: x[0])
    used, batch, batch_size, far, near = 0, [], 0, [], set()
    for size, g, i in arrays:
        if size <= limit and used + size * classes <= LITERALS:
            used += size * classes
            near.add((g, i))
        elif batch_size + size <= BROADCAST:
            batch_size += size
            batch.append((g, *groups[g][i]))
        else:
            far.append((g, *groups[g][i]))
    for g, own in enumerate(groups):
        for i, (family, table) in enumerate(own):
            if (g, i) in near:
                add(g, [literal_term(family, table, k, cards, target, column) for k in range(classes)])
    out = df
    if batch:
        out = _read_by_batch(out, batch, len(groups), cards, target, name)
        for g in dict.fromkeys(g for g, _, _ in batch):
            add(g, [F.element_at(F.col("_gsum"), g * classes + k + 1) for k in range(classes)])
    n = 0
    for g, family, table in far:
        out, terms = _array_joined(out, n, family, table, cards, target, name)
        add(g, terms)
        n += 1
    for g, own in enumerate(groups):
        for _, table in own:
            if isinstance(table, Cells):
                out, terms = _cells_joined(out, n, table, laplace, target, name)
                add(g, terms)
                n += 1
    return out, [[F.lit(0.0) if t is None else t for t in own] for own in sums]


def helper_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_g") and c[2:3] in ("s", "t", "a", "k")]
