"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative a group.

Cells. Centroids are fitted on about ``SAMPLE_ROWS`` rows, one for about ``ROWS_PER_CELL`` rows of the table; of centroids
closer than 1.5 times the distance r of a pair at the threshold, the one of the larger cell stays, so a crowd of near copies
is one cell. Cells of more than ``SPLIT_ROWS`` rows are fitted and cut again, each for itself, as long as that makes them
smaller; so the number of cells grows with the table while every fit is bounded.

Pairs across cells. If x lies in cell i and y in cell j, their distances to the plane between the two centroids add up to at
most |x - y|. A vector is also shown, as a guest, to each cell whose plane it is nearer to than a margin. With a margin of r / 2
(``exact``) no pair can be lost. By default the margin is that at which a pair at the threshold whose difference points in a
random direction is lost once in some millions: ``DEVIATIONS`` times r / 2 times the share of a difference that falls on a
plane's normal, measured on neighbours in the sample; never above r / 2. A check then compares ``CHECKED`` rows with all
rows: if any of their links would be lost, the margin becomes r / 2. ``report`` receives margin and check.

Equal vectors are one row with a number. A cell's own rows and its guests are cut into blocks by hash, and each pair of an own
block with an own or guest block is a task's group, so a cell with a third of all rows is spread; a pair that meets in
several cells counts in the least of them. Groups return link counts and one edge a member to its local group. On vectors
without any structure guests are many (some for each vector in a hundred cells) and the work grows faster than the table.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
component; rows with null vec_id have null component and no links; vectors of different dimension never link; rows that
repeat a vec_id are copies if equal; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, staged
from .components import connected_components
from .jaccard import Lists, join_labels
from .vecs import sample, takes_part, usable

COSINE = 0.95
SAMPLE_ROWS = 32_768
ROWS_PER_CELL, SPLIT_ROWS = 4_000, 32_000
BLOCK = 6_144  # own rows; guests come in blocks twice as large
DEVIATIONS = 5.0
CHECKED = 256
STRIP = 256  # rows of a block that are compared at a time


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def spherical_kmeans(u: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; an empty cell takes the row worst served."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(np.unique(u, axis=0)))) if len(u) else 1
    c = u[rng.choice(len(u), k, replace=False)]
    for _ in range(rounds):
        s = u @ c.T
        home = s.argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, home, u)
        size = np.linalg.norm(total, axis=1)
        empty = np.flatnonzero(size < 1e-12)
        c = total / np.maximum(size, 1e-12)[:, None]
        if len(empty):
            c[empty] = u[np.argsort(s.max(1))[: len(empty)]]
    return np.unique(c, axis=0)  # no two centroids alike


def spread_out(c: np.ndarray, u: np.ndarray, least: float) -> np.ndarray:
    """The centroids without those that are nearer than ``least`` to one of a larger cell of the sample."""
    size = np.bincount((u @ c.T).argmax(1), minlength=len(c))
    kept: list[int] = []
    for i in np.argsort(-size, kind="stable").tolist():
        if not kept or (2 - 2 * c[kept] @ c[i]).min() >= least * least:
            kept.append(i)
    return c[sorted(kept)]


def _gaps(c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-18))


def cells_of(u: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit row, and (rows by cells) the cells it is shown to."""
    s = u @ c.T
    home = s.argmax(1)
    near = (s[np.arange(len(u)), home][:, None] - s) / _gaps(c)[home] <= margin
    near[np.arange(len(u)), home] = False
    return home, near


def fit_cells(x: np.ndarray, rows: int, radius: float, per_cell: int = ROWS_PER_CELL) -> np.ndarray:
    u = units(x)
    return spread_out(spherical_kmeans(u, max(1, min(rows // per_cell, len(u) // 8))), u, 1.5 * radius)


def likely_margin(x: np.ndarray, c: np.ndarray, radius: float) -> float:
    """The margin for differences like those between neighbours of the sample."""
    if len(c) < 2 or len(x) < 3:
        return radius / 2
    u = units(x)
    some = u[: min(len(u), 1024)]
    nearest = []
    for a in range(0, len(some), 64):
        s = some[a : a + 64] @ u.T
        s[s > 1 - 1e-9] = -2  # itself and its copies
        nearest.append(s.argmax(1))
    v = u[np.concatenate(nearest)] - some
    v /= np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
    two = np.argsort(-(some @ c.T), axis=1)[:, :2]
    normal = c[two[:, 1]] - c[two[:, 0]]
    normal /= np.linalg.norm(normal, axis=1)[:, None]
    return min(radius / 2, DEVIATIONS * radius / 2 * float(np.sqrt(((v * normal).sum(1) ** 2).mean())))


def lost_links(u: np.ndarray, q: np.ndarray, c: np.ndarray, margin: float, cosine: float) -> tuple[int, int]:
    """(links between the rows of u and of q, those that meet in no cell)."""
    a, b = np.nonzero(u @ q.T >= cosine)
    if not len(a):
        return 0, 0
    cells = []
    for rows in (u, q):
        home, near = cells_of(rows, c, margin)
        near[np.arange(len(rows)), home] = True
        cells.append(near)
    return len(a), int((~(cells[0][a] & cells[1][b]).any(1)).sum())


def _vectors(b: pa.RecordBatch, d: int) -> np.ndarray:
    return b.column("x").flatten().to_numpy().reshape(b.num_rows, d)


def _shown(node: np.ndarray, home: np.ndarray, near: np.ndarray, first: int) -> dict[str, np.ndarray]:
    """Rows (node, cell, home) of all cells that each vector is in; the cells' numbers begin with ``first``."""
    near[np.arange(len(home)), home] = True
    r, k = np.nonzero(near)
    return {"node": node[r], "cell": first + k.astype(np.int64), "home": k == home[r]}


PLACES = "node long, cell long, home boolean"
#: Numbers of cells below one cell: the path is a number in this base.
BRANCH = 1 << 14


def _split(rows: DataFrame, places: DataFrame, sizes: DataFrame, radius: float, margin: float, per_cell: int) -> tuple[DataFrame, DataFrame]:
    """Places of the members of large cells in the cells below. rows: node, dim, x; places: node, cell; sizes: cell, n."""
    members = places.join(sizes, "cell").join(rows.select("node", "x"), "node")
    share = F.pmod(F.xxhash64("node", "cell", F.lit(9)), F.lit(1 << 30)) < ((1 << 30) * F.lit(float(SAMPLE_ROWS // 2)) / F.col("n"))

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["x"].to_list())
        c = fit_cells(x[:SAMPLE_ROWS], int(pdf["n"].iloc[0]), radius, per_cell)
        return pd.DataFrame({"cell": [int(key[0])], "c": [c.reshape(-1)], "k": [len(c)]})

    # about SAMPLE_ROWS / 2 rows of a cell
    fits = staged(members.where(share).select("cell", "n", "x").groupBy("cell").applyInPandas(fit, "cell long, c array<double>, k int").where("k > 1"), "subcells")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SPLIT_ROWS)).cast("int").alias("part")
    left = members.join(fits.select("cell"), "cell", "left_semi").select("cell", part, "node", "x")
    right = fits.join(sizes, "cell").select("cell", "c", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SPLIT_ROWS).cast("int") - 1)).alias("part"))

    def assign(key, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(own):
            return pd.DataFrame({"node": np.zeros(0, np.int64), "cell": np.zeros(0, np.int64), "home": np.zeros(0, bool)})
        u = units(np.stack(pdf["x"].to_list()))
        c = np.array(own["c"].iloc[0]).reshape(-1, u.shape[1])
        return pd.DataFrame(_shown(pdf["node"].to_numpy(), *cells_of(u, c, margin), int(key[0]) * BRANCH + 1))

    return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInPandas(assign, PLACES), fits.select("cell")


LINKS = "doc long, links long, root long"


def _flat(lists: pd.Series) -> Lists:
    return Lists(np.concatenate([np.asarray(x, np.int64) for x in lists]), lists.map(len).to_numpy(), alone=False)


def compare(key, pdf: pd.DataFrame, cosine: float = COSINE) -> pd.DataFrame:
    """Links of own block i with block j of a cell (key: cell, i, j) that have not met in an earlier cell. Two rows meet where
    both are and one is at home."""
    cell, i, j = (int(x) for x in key)
    pdf = pdf.sort_values("node", kind="stable")
    block, node = pdf["block"].to_numpy(), pdf["node"].to_numpy(np.int64)
    weight = pdf["n_copies"].to_numpy(np.int64)
    u = units(np.stack(pdf["x"].to_list()))
    homes, cells = _flat(pdf["homes"]), _flat(pdf["cells"])
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    label, links = np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
    for lo in range(0, len(left), STRIP):
        rows = left[lo : lo + STRIP]
        a, b = np.nonzero(u[rows] @ u[right].T >= cosine)
        a, b = rows[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        now = np.full(len(a), cell)
        fine = ~(homes.met_before(a, b, now, cells) | homes.met_before(b, a, now, cells))
        a, b = a[fine], b[fine]
        links += np.bincount(a, weight[b], len(pdf)).astype(np.int64) + np.bincount(b, weight[a], len(pdf)).astype(np.int64)
        join_labels(label, a, b)
    some = np.flatnonzero(links)
    return pd.DataFrame({"doc": node[some], "links": links[some], "root": node[label[some]]})


def places_of(rows: DataFrame, cosine: float, exact: bool, split_rows: int, per_cell: int, report: dict) -> DataFrame:
    """node, cell of all rows (node, key1, x, dim), each in its cell and in those that it is a guest of."""
    spark = rows.sparkSession
    radius = float(np.sqrt(2 - 2 * cosine))
    n, dim, x = sample(rows, "key1", 7, SAMPLE_ROWS)
    centroids = fit_cells(x, n, radius, per_cell) if len(x) else np.zeros((0, 0))
    margin = radius / 2 if exact else likely_margin(x, centroids, radius)
    own = rows.where(F.col("dim") == dim)
    if len(centroids) > 1 and margin < radius / 2:
        checked = units(x[np.random.default_rng(5).permutation(len(x))[:CHECKED]])
        held = spark.sparkContext.broadcast((checked, centroids, margin))

        def check(batches):
            total = lost = 0
            for b in batches:
                if b.num_rows:
                    got = lost_links(units(_vectors(b, dim)), held.value[0], held.value[1], held.value[2], cosine)
                    total, lost = total + got[0], lost + got[1]
            yield pa.RecordBatch.from_pydict({"total": pa.array([total], pa.int64()), "lost": pa.array([lost], pa.int64())})

        row = own.select("x").mapInArrow(check, "total long, lost long").agg(F.sum("total").alias("total"), F.sum("lost").alias("lost")).first()
        report.update(checked_links=row["total"], lost_links=row["lost"])
        if row["lost"]:
            margin = radius / 2
    margin += 1e-9
    report.update(cells=len(centroids), margin=margin, radius=radius)
    held_cells = spark.sparkContext.broadcast((centroids, margin))

    def show(batches):
        c, m = held_cells.value
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == d)))
                if d == dim and len(c) > 1:
                    home, near = cells_of(units(_vectors(part, d)), c, m)
                else:  # one cell
                    home, near = np.zeros(part.num_rows, int), np.zeros((part.num_rows, 1), bool)
                yield pa.RecordBatch.from_pydict(_shown(part.column("node").to_numpy(), home, near, int(d) * BRANCH + 1))

    short_batches(spark, 4096)
    places = staged(rows.select("node", "dim", "x").mapInArrow(show, PLACES), "cells")
    done = None
    while True:
        sizes = places.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_rows)
        if sizes.isEmpty():
            break
        sizes = staged(sizes, "large")
        below, cut = _split(rows, places, sizes, radius, margin, per_cell)
        below = staged(below, "cells")
        rest = places.join(cut, "cell", "left_anti")
        done = rest if done is None else done.union(rest)
        report["split"] = report.get("split", 0) + cut.count()
        if below.isEmpty():
            return done
        # a cell below that holds most of its parent is not cut again
        parent = F.shiftright(F.col("cell") - 1, BRANCH.bit_length() - 1)
        now = below.groupBy("cell").agg(F.count(F.lit(1)).alias("k")).withColumn("parent", parent)
        dense = now.join(sizes.withColumnRenamed("cell", "parent"), "parent").where(2 * F.col("k") > F.col("n")).select("cell")
        dense = staged(dense, "dense")
        done = done.union(below.join(dense, "cell", "left_semi"))
        places = staged(below.join(dense, "cell", "left_anti"), "cells")
    return places if done is None else done.union(places)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, exact: bool = False, split_rows: int = SPLIT_ROWS, per_cell: int = ROWS_PER_CELL, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark, report = vectors.sparkSession, {} if report is None else report
    short_batches(spark, 4096)
    key = [F.xxhash64("x").alias("key1"), F.xxhash64("x", F.lit(1)).alias("key2")]
    rows = usable(vectors).select("vec_id", "x", "dim", *key)
    distinct = rows.groupBy("key1", "key2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("x").alias("x"), F.first("dim").alias("dim"))
    distinct = staged(distinct.select(F.monotonically_increasing_id().alias("node"), "*"), "vectors")
    places = staged(places_of(distinct, cosine, exact, split_rows, per_cell, report), "places")
    loads = places.groupBy("cell").agg(F.ceil(F.count_if("home") / block).cast("int").alias("n_own"), F.ceil(F.count_if(~F.col("home")) / (2 * block)).cast("int").alias("n_guest"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("n_own") > 0))
    lists = places.groupBy("node").agg(F.collect_list("cell").alias("cells"), F.collect_list(F.when(F.col("home"), F.col("cell"))).alias("homes"))
    named = lists.join(distinct.select("node", "n_copies", "x"), "node")
    part = lambda n: F.pmod(F.xxhash64("node", "cell"), F.col(n)).cast("int")
    at = F.when(F.col("home"), part("n_own")).otherwise(F.col("n_own") + part("n_guest"))
    others = F.when(F.col("home"), F.col("n_own") + F.col("n_guest")).otherwise(F.col("n_own"))
    sides = places.join(loads, "cell").withColumn("block", at).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    members = sides.join(named, "node").select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n_copies", "cells", "homes", "x")
    found = staged(members.groupBy("cell", "i", "j").applyInPandas(lambda key, pdf: compare(key, pdf, cosine), LINKS), "links")
    links = found.groupBy("doc").agg(F.sum("links").alias("links")).withColumnRenamed("doc", "node")
    component = connected_components(found.select(F.col("doc").alias("u"), F.col("root").alias("v")))
    classes = distinct.select("key1", "key2", "node", "rep", "n_copies").join(links, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("rep").alias("least"))
    classes = classes.join(least, "component").select("key1", "key2", "n_copies", "links", "least")
    number = distinct.schema["x"].dataType.simpleString()
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(number).alias("embedding"))
    fine = F.col("vec_id").isNotNull() & takes_part()
    keyed = plain.select("vec_id", F.when(fine, F.xxhash64("embedding")).alias("key1"), F.when(fine, F.xxhash64("embedding", F.lit(1))).alias("key2"))
    out = keyed.join(classes, ["key1", "key2"], "left")
    component_id = F.coalesce("least", "vec_id")
    return out.select("vec_id", (F.coalesce("n_copies", F.lit(1)).cast("long") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
