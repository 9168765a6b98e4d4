"""Predictive, calibration and structural metrics."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Edge = tuple[str, str]
#: Distance of a probability from 0 and 1 below which it is clipped for the logarithm.
CLIP = 2.220446049250313e-16


# --- structure -------------------------------------------------------------------------------------------------------------


def shd(predicted: Iterable[Edge], truth: Iterable[Edge]) -> int:
    """Half the number of ordered pairs on which the graphs differ, rounded down."""
    return len(set(predicted) ^ set(truth)) // 2


def shd_textbook(predicted: Iterable[Edge], truth: Iterable[Edge]) -> int:
    """Unordered pairs on which the graphs differ: a missing, extra or reversed edge counts 1."""
    return len({frozenset(e) for e in set(predicted) ^ set(truth)})


def edge_prf(predicted: Iterable[Edge], truth: Iterable[Edge]) -> tuple[float, float, float]:
    p, t = set(predicted), set(truth)
    hit = len(p & t)
    precision, recall = hit / len(p) if p else 0.0, hit / len(t) if t else 0.0
    return precision, recall, 2 * precision * recall / (precision + recall) if hit else 0.0


def pool_reduction(pools: dict[str, list[str]]) -> float:
    n = len(pools)
    return 1 - sum(map(len, pools.values())) / (n * (n - 1)) if n > 1 else 0.0


def parent_recall(pools: dict[str, list[str]], truth: Iterable[Edge]) -> float:
    t = list(truth)
    return sum(p in pools.get(c, ()) for p, c in t) / len(t) if t else 0.0


def shd_frame(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """shd, shd_textbook, precision, recall, f1 of edge tables (source, target)."""
    p = predicted.select("source", "target").distinct().withColumn("p", F.lit(1))
    t = truth.select("source", "target").distinct().withColumn("t", F.lit(1))
    j = p.join(t, ["source", "target"], "full")
    both, only = F.col("p").isNotNull() & F.col("t").isNotNull(), F.col("p").isNull() | F.col("t").isNull()
    pair = F.when(only, F.concat_ws("\u0001", F.least("source", "target"), F.greatest("source", "target")))
    r = j.agg(F.count_if(only).alias("d"), F.count_distinct(pair).alias("u"), F.count_if(both).alias("h"), F.count("p").alias("np"), F.count("t").alias("nt"))
    precision = F.when(F.col("np") > 0, F.col("h") / F.col("np")).otherwise(0.0)
    recall = F.when(F.col("nt") > 0, F.col("h") / F.col("nt")).otherwise(0.0)
    return r.select(F.floor(F.col("d") / 2).alias("shd"), F.col("u").alias("shd_textbook"), precision.alias("precision"), recall.alias("recall"), F.when(F.col("h") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))


# --- calibration and prediction --------------------------------------------------------------------------------------------


def ece_edges(n_bins: int = 10) -> list[float]:
    """Bin edges as linspace gives them: k times the step."""
    step = 1.0 / n_bins
    return [k * step for k in range(n_bins)] + [1.0]


def _weight(w: str | None) -> Column:
    return F.col(w) if w else F.lit(1)


def _mean(x: Column, w: str | None) -> Column:
    return F.sum(_weight(w) * x) / F.sum(_weight(w)) if w else F.avg(x)


def ece(rows: DataFrame, y: str = "y", p: str = "probabilities", n_bins: int = 10, w: str | None = None) -> DataFrame:
    """One value ``ece``; rows: class index and probability array, and a weight column, if named."""
    confidence = F.array_max(p)
    right = (F.array_position(F.col(p), confidence) - 1 == F.col(y)).cast("double")
    inner = ece_edges(n_bins)[1:-1]
    bin_ = F.size(F.filter(F.lit(inner), lambda e: e <= F.col("c")))
    b = rows.select(confidence.alias("c"), right.alias("r"), _weight(w).alias("w")).groupBy(bin_.alias("b")).agg(F.sum("w").alias("n"), _mean(F.col("c"), "w").alias("c"), _mean(F.col("r"), "w").alias("r"))
    return b.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("c") - F.col("r"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def clipped(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))


def log_loss(rows: DataFrame, y: str = "y", p: str = "probabilities", w: str | None = None) -> DataFrame:
    return rows.agg(_mean(-F.log(clipped(F.element_at(F.col(p), F.col(y) + 1))), w).alias("log_loss"))


def brier(rows: DataFrame, classes: int, y: str = "y", p: str = "probabilities", w: str | None = None) -> DataFrame:
    """Two classes: squared error of the second; more: squared error summed over classes. Mean over rows."""
    if classes == 2:
        return rows.agg(_mean(F.pow(F.element_at(F.col(p), 2) - F.col(y), F.lit(2)), w).alias("brier"))
    each = F.aggregate(F.transform(F.col(p), lambda v, i: F.pow(v - (i == F.col(y)).cast("double"), F.lit(2))), F.lit(0.0), lambda a, v: a + v)
    return rows.agg(_mean(each, w).alias("brier"))


BANDS = 4096  # bands of scores between 0 and 1


def auc_by_class(rows: DataFrame, classes: int, y: str = "y", p: str = "probabilities", w: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """k, auc (null if a side is missing): class k against the rest, by mid-ranks of distinct scores; for each group of ``by``.

    Equal scores are grouped first. The rows below a score are those of the bands of scores below its own, of which a class
    has ``BANDS`` at most, and those below it in its band, so no task sorts more than a band."""
    key = (*by, "k")
    pairs = rows.select(*by, F.posexplode(F.slice(F.col(p), 1, classes)).alias("k", "s"), F.col(y).alias("y"), _weight(w).alias("w"))
    g = pairs.groupBy(*key, "s").agg(F.sum("w").alias("n"), F.sum(F.when(F.col("y") == F.col("k"), F.col("w")).otherwise(0)).alias("pos"))
    g = g.withColumn("band", F.floor(F.col("s") * BANDS))
    earlier = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    bands = g.groupBy(*key, "band").agg(F.sum("n").alias("in_band"))
    bands = bands.select(*key, "band", F.coalesce(F.sum("in_band").over(earlier(*key, by="band")), F.lit(0)).alias("before"))
    below = F.col("before") + F.coalesce(F.sum("n").over(earlier(*key, "band", by="s")), F.lit(0))
    r = g.join(bands, [*key, "band"]).withColumn("rank", below + (F.col("n") + 1) / 2)
    a = r.groupBy(*key).agg(F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum("pos").alias("np"), F.sum(F.col("n") - F.col("pos")).alias("nn"))
    return a.select(*key, F.when((F.col("np") > 0) & (F.col("nn") > 0), (F.col("ranks") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))).alias("auc"))


def auc(rows: DataFrame, classes: int, y: str = "y", p: str = "probabilities", w: str | None = None) -> DataFrame:
    """Binary: class 1; more: mean over classes. 0.5 where it is not defined, for any class."""
    by = auc_by_class(rows, classes, y, p, w)
    if classes == 2:
        by = by.where(F.col("k") == 1)
    return by.agg(F.when((F.count("auc") == F.lit(1 if classes == 2 else classes)), F.avg("auc")).otherwise(0.5).alias("roc_auc"))


def auc_by_group(rows: DataFrame, classes: int, by: str, y: str = "y", p: str = "probabilities", w: str | None = None) -> dict:
    """``auc`` of each group of rows, in one job."""
    each = auc_by_class(rows, classes, y, p, w, (by,))
    if classes == 2:
        each = each.where(F.col("k") == 1)
    got = each.groupBy(by).agg(F.when(F.count("auc") == F.lit(1 if classes == 2 else classes), F.avg("auc")).otherwise(0.5).alias("auc"))
    return {r[by]: float(r["auc"]) for r in got.collect()}  # one row a group


def predictive(rows: DataFrame, classes: int, y: str = "y", p: str = "probabilities", w: str | None = None) -> dict[str, float]:
    """log_loss, roc_auc, brier and ece of rows (which may stand for ``w`` equal ones each); they are scored once."""
    rows = rows.select(F.col(y).cast("int").alias("y"), F.col(p).alias("probabilities"), _weight(w).alias("w")).persist()
    try:
        out = {}
        for f in (log_loss(rows, w="w"), auc(rows, classes, w="w"), brier(rows, classes, w="w"), ece(rows, w="w")):
            row = f.first()
            out[f.columns[0]] = float(row[0]) if row[0] is not None else math.nan
        return out
    finally:
        rows.unpersist()


def predictive_local(y: np.ndarray, p: np.ndarray, w: np.ndarray) -> dict[str, float]:
    """log_loss and roc_auc of weighted rows on the driver, as ``predictive`` defines them."""
    own = np.clip(p[np.arange(len(y)), y], CLIP, 1 - CLIP)
    areas = []
    for k in [1] if p.shape[1] == 2 else range(p.shape[1]):
        values, at = np.unique(p[:, k], return_inverse=True)
        n = np.bincount(at, w, len(values))
        pos = np.bincount(at, w * (y == k), len(values))
        rank = np.cumsum(n) - n + (n + 1) / 2
        np_, nn = pos.sum(), (n - pos).sum()
        areas.append(((rank * pos).sum() - np_ * (np_ + 1) / 2) / (np_ * nn) if np_ and nn else math.nan)
    area = float(np.mean(areas))
    return {"log_loss": float((w * -np.log(own)).sum() / w.sum()) if len(y) else math.nan, "roc_auc": 0.5 if math.isnan(area) else area}
