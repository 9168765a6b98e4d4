"""Mutual information of column pairs, plain and conditional, as windows over pair counts (natural logarithm).

Pair counts of a few columns are one exploded aggregation in generated code. Beyond ``EXPLODED`` pairs a row would become
too many structs, and tasks count by Gram matrices instead: the rows' codes as one-hot blocks (a tile of columns), multiplied
with each other by weight, so a task returns each cell once, whatever its rows. Pairs with a column of more than ``TILE_WIDTH``
values are exploded in portions. The counts are the same.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXPLODED = 200  # pairs of columns that a row is exploded into, at most
TILE_WIDTH = 1_024  # one-hot columns of a tile
TASK_CELLS = 4_000_000  # numbers that a task holds; tiles beyond it are counted by another pass over the rows
PIECE = 4_096  # rows that are multiplied at a time
PAIRS = "i int, j int, x int, y int, z int, n double"


def _exploded(collapsed: DataFrame, columns: list[str], pairs: list[tuple[int, int]], given: str | None) -> DataFrame:
    z = F.col(f"`{given}`") if given else F.lit(0)
    each = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"`{columns[i]}`").alias("x"), F.col(f"`{columns[j]}`").alias("y")) for i, j in pairs]
    return collapsed.select(F.explode(F.array(*each)).alias("p"), z.alias("z"), "w").groupBy("p.i", "p.j", "p.x", "p.y", "z").agg(F.sum("w").alias("n"))


def _sizes(collapsed: DataFrame, columns: list[str]) -> list[int]:
    row = collapsed.agg(*[F.max(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(columns)]).first()
    return [int(row[i]) + 1 if row[i] is not None else 0 for i in range(len(columns))]


def tiles(sizes: list[int]) -> list[list[int]]:
    """Columns dealt into tiles of at most TILE_WIDTH values, in order; wider columns are left out."""
    out, width = [], 0
    for i, s in enumerate(sizes):
        if s > TILE_WIDTH:
            continue
        if not out or width + s > TILE_WIDTH:
            out.append([])
            width = 0
        out[-1].append(i)
        width += s
    return out


def _by_tiles(collapsed: DataFrame, columns: list[str], sizes: list[int], given: str | None) -> DataFrame:
    """Counts of all pairs of columns of at most TILE_WIDTH values, from tasks' Gram matrices."""
    own = tiles(sizes)
    width = [sum(sizes[i] for i in t) for t in own]
    classes = _sizes(collapsed, [given])[0] if given else 1
    passes: list[list[tuple[int, int]]] = [[]]
    held = 0
    for a in range(len(own)):
        for b in range(a, len(own)):
            cells = width[a] * width[b]
            if passes[-1] and held + cells > TASK_CELLS:
                passes.append([])
                held = 0
            passes[-1].append((a, b))
            held += cells
    names = [f"c{i}" for i in range(len(columns))]
    rows = collapsed.select(*[F.col(f"`{c}`").cast("int").alias(n) for c, n in zip(columns, names)], (F.col(f"`{given}`").cast("int") if given else F.lit(0)).alias("z"), F.col("w").cast("double").alias("w"))

    def counted(tile_pairs: list[tuple[int, int]], k: int) -> DataFrame:
        needed = sorted({t for p in tile_pairs for t in p})

        def run(batches):
            gram = {p: np.zeros((width[p[0]], width[p[1]])) for p in tile_pairs}
            for batch in batches:
                for lo in range(0, batch.num_rows, PIECE):
                    part = batch.slice(lo, PIECE)
                    w = part.column("w").to_numpy(zero_copy_only=False)
                    hot = {}
                    for t in needed:
                        m = np.zeros((part.num_rows, width[t]), np.float64)
                        at = 0
                        for i in own[t]:
                            v = part.column(names[i]).fill_null(-1).to_numpy(zero_copy_only=False)
                            there = np.flatnonzero(v >= 0)
                            m[there, at + v[there]] = 1
                            at += sizes[i]
                        hot[t] = m
                    for a, b in tile_pairs:
                        gram[a, b] += (hot[a] * w[:, None]).T @ hot[b]
            for (a, b), g in gram.items():
                starts = [np.cumsum([0, *(sizes[i] for i in own[t])]) for t in (a, b)]
                r, c = np.nonzero(g)
                u, v = np.searchsorted(starts[0], r, "right") - 1, np.searchsorted(starts[1], c, "right") - 1
                i, j = np.array(own[a])[u], np.array(own[b])[v]
                keep = i < j
                cols = [i, j, r - starts[0][u], c - starts[1][v], np.full(len(r), k)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[keep].astype(np.int32)) for x in cols), pa.array(g[r, c][keep])], names=["i", "j", "x", "y", "z", "n"])

        some = rows.where(F.col("z") == k) if given else rows
        return some.drop("z").mapInArrow(run, PAIRS)

    parts = [counted(p, k) for p in passes for k in range(classes)]
    return reduce(DataFrame.union, parts).groupBy("i", "j", "x", "y", "z").agg(F.sum("n").alias("n"))


def pair_counts(collapsed: DataFrame, columns: list[str], given: str | None = None) -> DataFrame:
    """i, j (positions, i < j), x, y, z, n: counts of value pairs, by the value of the given column (0 without one)."""
    every = list(combinations(range(len(columns)), 2))
    if len(every) <= EXPLODED:
        return _exploded(collapsed, columns, every, given)
    sizes = _sizes(collapsed, columns)
    wide = [p for p in every if max(sizes[p[0]], sizes[p[1]]) > TILE_WIDTH]
    parts = [_exploded(collapsed, columns, wide[a : a + EXPLODED], given).select("i", "j", "x", "y", "z", F.col("n").cast("double").alias("n")) for a in range(0, len(wide), EXPLODED)]
    return reduce(DataFrame.union, [_by_tiles(collapsed, columns, sizes, given), *parts])


def information(counts: DataFrame) -> DataFrame:
    """i, j, mi from pair counts: conditional on z, if z varies (sum over z of p(z) times the information within z)."""
    over = lambda *k: F.sum("n").over(Window.partitionBy("i", "j", *k))
    c = counts.select("*", over("z", "x").alias("nx"), over("z", "y").alias("ny"), over("z").alias("nz"), over().alias("t"))
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("nz") / (F.col("nx") * F.col("ny")))
    return c.groupBy("i", "j").agg(F.sum(term).alias("mi"))


def mi_matrix(collapsed: DataFrame, columns: list[str], given: str | None = None) -> DataFrame:
    """target, source, mi, both ways round; negative rounding errors are 0."""
    names = F.lit(columns)
    m = information(pair_counts(collapsed, columns, given)).select(F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), F.greatest("mi", F.lit(0.0)).alias("mi"))
    return m.select(F.col("a").alias("target"), F.col("b").alias("source"), "mi").union(m.select("b", "a", "mi"))


def collected(matrix: DataFrame) -> dict[tuple[str, str], float]:
    """(target, source) -> value; a matrix has at most columns squared rows."""
    return {(r["target"], r["source"]): r[2] for r in matrix.collect()}


def prefilter(matrix: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """target, source, rank: the ``limit`` best sources of each target; ties in column order."""
    place = F.array_position(F.lit(columns), F.col("source"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("mi"), place))
    return matrix.withColumn("rank", rank).where(F.col("rank") <= limit).select("target", "source", "rank")
