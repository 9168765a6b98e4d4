"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of several hash tables cuts a few Gaussian projections into cells of one width; a row's bucket in a table is its tuple of
cells. A query visits buckets in the order of their estimated success: its own bucket first, then perturbed ones, where each
projection may step into the cell below or above. A step costs the squared distance to the cell's border, so the cheapest sets
of steps are the likeliest ones; they come from a heap that starts with the cheapest step and goes on by replacing the last
step of a set with the next one, or adding that. A query looks up its first ``probes`` buckets in every table.

Buckets are keys of a table: rows are dealt by bucket, queries by the buckets they visit, and only rows of visited buckets are
compared. Buckets are dealt to groups of about ``GROUP_ROWS`` rows, a task's unit of work, which returns at most ``k + 1`` rows a
query; the candidates of all groups are merged and ranked by exact distance. Buckets of more than ``INDEX_BLOCK`` rows are cut
into blocks by hash, and more than ``QUERY_BLOCK`` queries of one bucket too.

Cell width, hashes and probes are fitted on at most about ``SAMPLE_ROWS`` rows: of the settings in ``WIDTHS`` and ``SIZES`` that
find ``TARGET`` of the sample's true neighbours within ``MOST_PROBES`` buckets a table, the one that compares fewest rows, a bucket
visited counted as ``VISIT`` rows. Every row is indexed. Queries that found fewer than ``k`` rows, and dimensions other than the
commonest, are searched exactly, block by block. ``report`` receives the share of rows compared, summed over tables.

On vectors with structure a query compares less than a hundredth of the table. Neighbours of isotropic vectors of 64 dimensions
are hardly nearer than other rows: no few projections tell them apart, and a query compares about as many rows as there are.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with null
vec_id; candidates have the query's dimension; the query's own row is one row of its vec_id at distance 0; rows that repeat a
vec_id are separate candidates and separate queries, each with a ranking of its own; equal distances go to smaller ids;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import short_batches, staged
from .vecs import sample, usable

K = 10
TABLES = 8
SAMPLE_ROWS, SAMPLE_QUERIES = 4_096, 64
TARGET = 0.97
WIDTHS = (1.4, 2.5, 4.0)  # of cells, in distances between neighbours
SIZES = (4, 6, 8, 10, 12, 16)  # hashes of a table
MOST_PROBES, VISIT = 1_024, 32  # a bucket visited is a row in two shuffles, a row compared a step of an array
GROUP_ROWS = 8_192
INDEX_BLOCK, QUERY_BLOCK = 4_096, 2_048


def perturbations(hashes: int, most: int) -> list[tuple[int, ...]]:
    """Sets of ranks of steps, of 2 * hashes steps in order of cost, by the expected sum of their costs; none first. A rank and its
    mirror are the two steps of one projection, so a set holds one of them only."""
    n = 2 * hashes
    # expected squared distances to the nearer and farther borders of uniform places, in cells
    cost = [j * (j + 1) / (4 * (hashes + 1) * (hashes + 2)) for j in range(1, hashes + 1)]
    cost += [1 - (n + 1 - j) / (hashes + 1) + (n + 1 - j) * (n + 2 - j) / (4 * (hashes + 1) * (hashes + 2)) for j in range(hashes + 1, n + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))] if n else []
    while heap and len(out) < most:
        total, own = heapq.heappop(heap)
        if len({min(r, n - 1 - r) for r in own}) == len(own):
            out.append(own)
        last = own[-1] + 1
        if last < n:
            heapq.heappush(heap, (total - cost[last - 1] + cost[last], (*own[:-1], last)))
            heapq.heappush(heap, (total + cost[last], (*own, last)))
    return out


class Hashing:
    """Projections, cell width and the order of probes."""

    def __init__(self, dim: int, width: float, hashes: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.dim, self.width, self.hashes = dim, width, hashes
        self.a = rng.normal(size=(dim, TABLES * hashes))
        self.b = rng.uniform(0, width, TABLES * hashes)
        self.key = rng.integers(1 << 62, size=(TABLES, hashes), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.with_probes(1)

    def with_probes(self, probes: int) -> Hashing:
        chosen = perturbations(self.hashes, probes)
        self.probes = len(chosen)
        self.sets = np.zeros((2 * self.hashes, self.probes), np.uint64)
        for i, ranks in enumerate(chosen):
            self.sets[list(ranks), i] = 1
        return self

    def project(self, x: np.ndarray) -> np.ndarray:
        """Places of the rows, in cells, by table: rows x TABLES x hashes."""
        return ((x @ self.a + self.b) / self.width).reshape(len(x), TABLES, self.hashes)

    def _sums(self, cells: np.ndarray) -> np.ndarray:
        return (cells.astype(np.int64).view(np.uint64) * self.key).sum(2)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """A number for each row's bucket: rows x TABLES. Different buckets that share one are compared together."""
        return self._sums(np.floor(self.project(x))).view(np.int64)

    def visits(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the buckets that each query visits, in order: rows x TABLES x probes."""
        at = self.project(x)
        own = np.floor(at)
        steps = np.concatenate([at - own, 1 - (at - own)], 2)  # to the border below, then above
        order = np.argsort(steps, 2, kind="stable")
        change = np.concatenate([np.zeros_like(self.key) - self.key, self.key], 1)  # of the number, by step
        change = np.take_along_axis(np.broadcast_to(change, order.shape), order, 2)
        return (self._sums(own)[:, :, None] + change @ self.sets).view(np.int64)


def _measured(model: Hashing, x: np.ndarray, queries: np.ndarray, near: np.ndarray, target: float) -> tuple[float, int, float]:
    """(share of neighbours found, probes that find the target, share of rows compared with these, over all tables)."""
    own, keys = model.buckets(x), model.visits(queries)
    first = np.full((TABLES, *near.shape), keys.shape[2])
    for t in range(TABLES):
        for i in range(len(queries)):
            same = keys[i, t][None, :] == own[near[i], t][:, None]
            first[t, i] = np.where(same.any(1), same.argmax(1), keys.shape[2])
    needed = np.sort(first.min(0).reshape(-1))
    probes = int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) + 1
    found = float((needed < keys.shape[2]).mean())
    probes, held = min(probes, keys.shape[2]), 0
    for t in range(TABLES):
        number, n = np.unique(own[:, t], return_counts=True)
        at = np.minimum(np.searchsorted(number, keys[:, t, :probes]), len(number) - 1)
        held += int(np.where(number[at] == keys[:, t, :probes], n[at], 0).sum())
    return found, probes, held / len(queries) / len(x)


def fit(x: np.ndarray, rows: int, k: int = K, target: float = TARGET) -> Hashing | None:
    """Fit width, hashes and probes on a sample of a table of so many rows."""
    if len(x) < 2:
        return None
    x = x[np.random.default_rng(3).permutation(len(x))]
    queries = x[: min(SAMPLE_QUERIES, len(x))]
    d = np.sqrt(np.maximum(0, (queries**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * queries @ x.T))
    d[np.arange(len(queries)), np.arange(len(queries))] = np.inf
    k = min(k, len(x) - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    apart = np.take_along_axis(d, near, 1)
    apart = apart[apart > 1e-6 * np.sqrt((x**2).sum(1).mean())]  # not copies
    if not len(apart):
        apart = d[np.isfinite(d) & (d > 0)]
    radius = float(np.median(apart)) if len(apart) else 1.0
    best = None
    for factor in WIDTHS:
        for hashes in SIZES:
            model = Hashing(x.shape[1], factor * radius, hashes).with_probes(MOST_PROBES)
            found, probes, share = _measured(model, x, queries, near, target)
            work = share * rows + VISIT * TABLES * probes
            rank = (found < target, work if found >= target else -found)
            if best is None or rank < best[0]:
                best = (rank, model, probes)
    return best[1].with_probes(best[2])


FOUND = "qn long, rn long, vec_id long, score double"


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def _best(qn: np.ndarray, rn: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k nearest rows, a row once, ties to smaller ids."""
    order = np.lexsort((rn, ids, d, qn))
    once = np.unique(np.stack([qn[order], rn[order]], 1), axis=0, return_index=True)[1]
    order = order[np.sort(once)]
    first = np.r_[True, qn[order][1:] != qn[order][:-1]]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[place < k]


def _compare(k: int):
    """Cogrouped queries and rows of a group, which meet where ``key`` is the same -> FOUND; rn -1 counts the rows compared."""

    def run(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qn": np.zeros(0, np.int64), "rn": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(q) or not len(rows):
            return empty
        q, rows = q.sort_values("key", kind="stable"), rows.sort_values("key", kind="stable")
        x, rn, ids, qx, qn = _matrix(rows["x"]), rows["rn"].to_numpy(), rows["vec_id"].to_numpy(), _matrix(q["x"]), q["qn"].to_numpy()
        kx, kq = rows["key"].to_numpy(), q["key"].to_numpy()
        out, held, compared = [], 0, 0

        def cut():
            all_ = [np.concatenate(v) for v in zip(*out)]
            at = _best(*all_, k)
            return [tuple(v[at] for v in all_)]

        for key in np.intersect1d(kx, kq):
            a, b = np.searchsorted(kx, key), np.searchsorted(kx, key, "right")
            c, e = np.searchsorted(kq, key), np.searchsorted(kq, key, "right")
            compared += (b - a) * (e - c)
            for lo in range(c, e, 64):
                hi = min(lo + 64, e)
                d = np.stack([np.sqrt(((x[a:b] - v) ** 2).sum(1)) for v in qx[lo:hi]])
                if b - a > k:
                    i, j = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
                else:
                    i, j = (v.reshape(-1) for v in np.indices(d.shape))
                out.append((qn[lo + i], rn[a + j], ids[a + j], d[i, j]))
                held += len(i)
                if held > 1_000_000:
                    out = cut()
                    held = len(out[0][0])
        if not out:
            return empty
        qn_, rn_, ids_, d_ = cut()[0]
        return pd.DataFrame({"qn": np.append(qn_, -1), "rn": np.append(rn_, -1), "vec_id": np.append(ids_, compared), "score": np.append(d_, np.nan)})

    return run


def _keys(rows: DataFrame, model, number: str, visits: bool) -> DataFrame:
    """(number, t, g): the buckets each row lies in, or each query visits."""

    def run(batches):
        m = model.value
        for b in batches:
            x = np.stack(b.column("x").to_numpy(zero_copy_only=False)).astype(np.float64) if b.num_rows else np.zeros((0, m.dim))
            n = b.column(number).to_numpy(zero_copy_only=False)
            for lo in range(0, len(x), 256):
                g = m.visits(x[lo : lo + 256]) if visits else m.buckets(x[lo : lo + 256])[:, :, None]
                each = g.shape[1] * g.shape[2]
                t = np.broadcast_to(np.arange(g.shape[1], dtype=np.int32)[None, :, None], g.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(n[lo : lo + 256], each)), pa.array(t.reshape(-1)), pa.array(g.reshape(-1))], [number, "t", "g"])

    return rows.select(number, "x").mapInArrow(run, f"{number} long, t int, g long")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, report: dict | None = None, target: float = TARGET) -> DataFrame:
    """vectors, queries: vec_id, embedding -> query_id, rank, vec_id, score. ``target``: share of the sample's neighbours to find."""
    spark = vectors.sparkSession
    short_batches(spark, 4096)
    index = staged(usable(vectors).select(F.monotonically_increasing_id().alias("rn"), "*"), "index")
    asked = staged(usable(queries).select(F.monotonically_increasing_id().alias("qn"), "*"), "queries")
    n, dim, x = sample(index, "rn", 11, SAMPLE_ROWS)
    fitted = fit(x, n, k, target)
    found = None
    if fitted is not None:
        model = spark.sparkContext.broadcast(fitted)
        rows, asks = index.where(F.col("dim") == dim), asked.where(F.col("dim") == dim)
        visits = staged(_keys(asks, model, "qn", True), "visits")
        visited = visits.groupBy("t", "g").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("n_qb"))
        held = staged(_keys(rows, model, "rn", False).join(visited, ["t", "g"]), "buckets")  # rows of visited buckets, as numbers
        sizes = held.groupBy("t", "g").agg(F.ceil(F.count(F.lit(1)) / INDEX_BLOCK).cast("int").alias("n_ib"))
        groups = max(1, -(-held.count() // GROUP_ROWS))
        block = lambda number, parts: F.pmod(F.xxhash64(number, "t"), F.col(parts)).cast("int")
        every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
        grouped = lambda df: df.select("*", F.xxhash64("t", "g", "ib", "qb").alias("key")).select("*", F.pmod("key", F.lit(groups)).cast("int").alias("group"))
        right = grouped(held.join(sizes, ["t", "g"]).withColumn("ib", block("rn", "n_ib")).withColumn("qb", every("n_qb"))).select("key", "group", "rn").join(rows.select("rn", "vec_id", "x"), "rn")
        left = grouped(visits.join(sizes, ["t", "g"]).join(visited, ["t", "g"]).withColumn("qb", block("qn", "n_qb")).withColumn("ib", every("n_ib"))).select("key", "group", "qn").join(asks.select("qn", "x"), "qn")
        found = staged(left.groupBy("group").cogroup(right.groupBy("group")).applyInPandas(_compare(k + 1), FOUND), "found")
        if report is not None:
            compared = found.where("rn < 0").agg(F.sum("vec_id")).first()[0] or 0
            report["compared_share"] = compared / max(1, n * asks.count())  # a row counts once a table
            report["probes"], report["hashes"], report["buckets_visited"] = fitted.probes, fitted.hashes, visits.count()
        found = found.where("rn >= 0")
    few = asked.select("qn")
    if found is not None:
        few = few.join(found.groupBy("qn").agg(F.countDistinct("rn").alias("n")).where(F.col("n") > k).select("qn"), "qn", "left_anti")
    rest = staged(few.join(asked, "qn"), "rest")
    if report is not None:
        report["searched_exactly"] = rest.count()
    if not rest.isEmpty():
        exact = _exactly(index, rest, k + 1)
        found = exact if found is None else found.unionByName(exact)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = found.groupBy("qn", "rn").agg(F.first("vec_id").alias("vec_id"), F.first("score").alias("score"))
    named = once.join(asked.select("qn", F.col("vec_id").alias("query_id")), "qn")
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0), F.col("rn"))).over(Window.partitionBy("qn"))
    others = named.withColumn("_own", own).where(F.col("_own").isNull() | (F.col("rn") != F.col("_own")))
    rank = F.row_number().over(Window.partitionBy("qn").orderBy("score", "vec_id", "rn"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exactly(index: DataFrame, rest: DataFrame, k: int) -> DataFrame:
    """The k nearest of all rows of each query's dimension, in blocks. ``rest`` is few."""
    n_index = max(1, -(-index.count() // INDEX_BLOCK))
    n_query = max(1, -(-rest.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda number, n: F.pmod(F.xxhash64(number), F.lit(n)).cast("int")
    keyed = lambda df: df.withColumn("key", F.xxhash64("dim", "ib", "qb"))
    left = keyed(rest.withColumn("qb", block("qn", n_query)).withColumn("ib", every(n_index)))
    right = keyed(index.join(rest.select("dim").distinct(), "dim").withColumn("ib", block("rn", n_index)).withColumn("qb", every(n_query)))
    keys = ("dim", "ib", "qb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compare(k), FOUND).where("rn >= 0")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector, among all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
