"""Mixed-type tables to integer codes: typing, imputation, categories, supervised bins.

Fitting takes some aggregations over the table whatever its width: medians, then moments and distinct categories, then the
histogram of values by class. The bins are grown on the driver from that histogram. Where a column has more than about
``MAX_VALUES`` distinct values its histogram stays in Spark, dealt by range to cells whose number grows with the values: class
counts up to every value are running sums in a cell, a round of splits is an aggregate over all values, and the best split of
each leaf comes back. Thresholds are the same either way. Texts of which all columns together have at most ``MAX_CATEGORIES``
are literals; columns beyond that have their texts in a dictionary table (``operators/dictionary.py``), with the same codes.
Transforming is a projection, after a join for each dictionary.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.base import Estimator, Model
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_category, digitize
from ..operators.dictionary import Dictionary, dictionaries
from ..sources import files

MAX_VALUES = 10_000
#: Distinct values that a cell of a histogram is meant to hold, and the most cells there are; a window in a cell spills beyond.
CELL_VALUES = 20_000
MOST_CELLS = 20_000
#: Texts of all columns together that may be literals of the plan.
MAX_CATEGORIES = 100_000


@dataclass
class ColumnProfile:
    name: str
    kind: str  # categorical or continuous
    categories: list[str] = field(default_factory=list)
    median: float = 0.0
    mean: float = 0.0
    std: float = 1.0
    thresholds: list[float] = field(default_factory=list)
    dictionary: Dictionary | None = None  # of a column with too many texts for ``categories``

    @property
    def size(self) -> int:
        if self.dictionary is not None:
            return self.dictionary.size
        return len(self.categories) if self.kind == "categorical" else len(self.thresholds) + 1


def column_kind(f: T.StructField, target: str, categorical: tuple[str, ...] = ()) -> str:
    """The target is categorical always; text and booleans are; numbers are continuous."""
    if f.name == target or f.name in categorical or isinstance(f.dataType, (T.StringType, T.BooleanType)):
        return "categorical"
    if isinstance(f.dataType, T.NumericType):
        return "continuous"
    raise TypeError(f"column {f.name} of type {f.dataType.simpleString()}: derive a number or a text from it first")


def midpoints(values: np.ndarray) -> list[float]:
    return [(a + b) / 2 for a, b in zip(values[:-1], values[1:])]


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Entropy in bits of each row of class counts."""
    n = counts.sum(-1, keepdims=True)
    p = counts / np.maximum(n, 1)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1)


def split_gain(left: np.ndarray, whole: np.ndarray, total: float, min_leaf: int) -> np.ndarray:
    """What splits lower the entropy by, -1 where a side is too small. left: classes left of each split; whole: of the leaf."""
    right = whole - left
    nl, nr = left.sum(1), right.sum(1)
    gain = (whole.sum() * _entropy(whole) - nl * _entropy(left) - nr * _entropy(right)) / total
    gain[(nl < min_leaf) | (nr < min_leaf)] = -1
    return gain


def entropy_bins(values: np.ndarray, counts: np.ndarray, n_bins: int, min_leaf: int, compat_drop_low: bool = False) -> list[float]:
    """Thresholds of the tree that always splits the leaf whose split lowers the entropy most, until it has ``n_bins``
    leaves. values: sorted; counts: values by classes."""
    total = counts.sum()

    def best(lo: int, hi: int):
        c = counts[lo:hi]
        if len(c) < 2:
            return None
        gain = split_gain(np.cumsum(c, 0)[:-1], c.sum(0), total, min_leaf)
        k = int(gain.argmax())
        return (float(gain[k]), lo + k) if gain[k] > 1e-12 else None

    leaves = {(0, len(values)): best(0, len(values))}
    cuts: list[float] = []
    while len(leaves) < n_bins:
        open_ = [(s[0], -lo, lo, hi, s[1]) for (lo, hi), s in leaves.items() if s]
        if not open_:
            break
        _, _, lo, hi, k = max(open_)
        del leaves[(lo, hi)]
        leaves[(lo, k + 1)], leaves[(k + 1, hi)] = best(lo, k + 1), best(k + 1, hi)
        cuts.append(float((values[k] + values[k + 1]) / 2))
    cuts.sort()
    if compat_drop_low:
        cuts = [c for c in cuts if c > -2.0]
    return [c for i, c in enumerate(cuts) if i == 0 or c - cuts[i - 1] > 1e-9]


def least_leaf(n: int, n_bins: int, min_samples: int) -> int:
    return max(2, min(min_samples, max(2, n // max(n_bins, 2))))


def running_counts(hist: DataFrame, classes: list[str], values: int) -> DataFrame:
    """i, cell, x, follow, l0, l1, …: each value of each column, the next one, and the rows of each class up to it, from rows
    (i, x, y, n) of about so many ``values``. Cells are ranges of (i, x), numbered in order; the driver sees their sums only.
    Rows are added up by value on both sides of one shuffle, however often a value occurs."""
    spark, k = hist.sparkSession, range(len(classes))
    one = hist.groupBy("i", "x").agg(*[F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias(f"n{j}") for j, c in enumerate(classes)])
    at = files.scratch(spark, "cells")
    cells = min(MOST_CELLS, max(1, -(-values // CELL_VALUES)))
    one.repartitionByRange(cells, "i", "x").withColumn("cell", F.spark_partition_id()).write.parquet(at)
    dealt = spark.read.parquet(at)
    tasks = min(2 * cells, int(spark.conf.get("spark.sql.shuffle.partitions")))  # not a task for every few hundred values, in each of many rounds
    sums = dealt.groupBy("i", "cell").agg(F.min("x").alias("first"), *[F.sum(f"n{j}").alias(f"n{j}") for j in k]).toPandas().sort_values(["i", "cell"])
    own = sums[[f"n{j}" for j in k]]
    before = own.groupby(sums["i"]).cumsum() - own
    rows = [(int(i), int(c), [float(v) for v in b], None if pd.isna(f) else float(f)) for i, c, b, f in zip(sums["i"], sums["cell"], before.to_numpy(), sums.groupby("i")["first"].shift(-1))]
    starts = spark.createDataFrame(rows, "i int, cell int, before array<double>, beyond double")
    w = Window.partitionBy("i", "cell").orderBy("x")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.repartition(tasks, "i", "cell").select("i", "cell", "x", F.lead("x").over(w).alias("follow"), *[F.sum(f"n{j}").over(upto).alias(f"n{j}") for j in k])
    return inside.join(F.broadcast(starts), ["i", "cell"]).select("i", "cell", "x", F.coalesce("follow", "beyond").alias("follow"), *[(F.col("before")[j] + F.col(f"n{j}")).alias(f"l{j}") for j in k])


def entropy_bins_in_cells(hist: DataFrame, n_bins: int, min_samples: int, values: int = MAX_VALUES) -> dict[int, list[float]]:
    """``entropy_bins`` of each column i, on rows (i, x, y, n) that stay in Spark; a value may come in many rows. Gains are
    compared to twelve places; ties go to the smaller value.

    A round is one aggregate over all values, the best gain of each leaf in each cell, and a look at the rows of the first cell
    that holds a leaf's best."""
    spark = hist.sparkSession
    classes = sorted(r["y"] for r in hist.select("y").distinct().collect())
    counts = running_counts(hist, classes, values).persist()
    k, upto = range(len(classes)), F.array(*[f"l{j}" for j in range(len(classes))]).alias("left")
    whole = {r["i"]: np.array(r["left"]) for r in counts.where(F.col("follow").isNull()).select("i", upto).collect()}  # at the last value of each column
    least = {i: least_leaf(int(v.sum()), n_bins, min_samples) for i, v in whole.items()}
    new = {i: [(-math.inf, math.inf, np.zeros(len(classes)), v)] for i, v in whole.items()}  # from, to (inclusive), classes before, classes inside

    def bits(counts: list[str], total: str) -> str:
        """total times the entropy of class counts that sum up to it."""
        part = lambda v: f"CASE WHEN {v} > 0 THEN {v} * log2({v}) ELSE 0D END"
        return f"({part(total)} - ({' + '.join(map(part, counts))}))"

    def rows_of(values: list[tuple], names: list[str]) -> DataFrame:
        """A few rows that are part of the plan, so no job makes them."""
        lit = lambda v: str(v) if isinstance(v, int) else f"double('{v!r}')"
        return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in values)} AS t({', '.join(names)})")

    def gains(rows: DataFrame) -> DataFrame:
        leaves = [(i, m, float(lo), float(hi), least[i], float(whole[i].sum()), float(inside.sum() * _entropy(inside)), *map(float, base), *map(float, inside)) for i, leaves in new.items() for m, (lo, hi, base, inside) in enumerate(leaves)]
        names = ["i", "m", "lo", "hi", "least", "total", "bits", *[f"b{j}" for j in k], *[f"w{j}" for j in k]]
        both = rows.join(F.broadcast(rows_of(leaves, names)), "i").where("x > lo AND x <= hi")  # two leaves a column at most
        own = both.selectExpr("*", *[f"l{j} - b{j} AS u{j}" for j in k], *[f"w{j} - l{j} + b{j} AS v{j}" for j in k])
        own = own.selectExpr("*", " + ".join(f"u{j}" for j in k) + " AS nu", " + ".join(f"v{j}" for j in k) + " AS nv").where("nu >= least AND nv >= least")
        gain = f"(bits - {bits([f'u{j}' for j in k], 'nu')} - {bits([f'v{j}' for j in k], 'nv')}) / total"
        return own.selectExpr("i", "m", "cell", "x", "follow", *[f"l{j}" for j in k], f"floor(({gain}) * 1e12D + 0.5D) AS gain")  # whole numbers of 1e-12

    def search() -> dict[tuple[int, int], dict]:
        top: dict[tuple[int, int], tuple[int, int]] = {}
        for r in gains(counts).groupBy("i", "m", "cell").agg(F.max("gain").alias("gain")).collect():  # two rows a cell at most
            top[r["i"], r["m"]] = max(top.get((r["i"], r["m"]), (1, 0)), (r["gain"], -r["cell"]))
        at = {key: -cell for key, (gain, cell) in top.items() if gain > 1}
        if not at:
            return {}
        few = gains(counts.where(f"cell IN ({', '.join(map(str, sorted(set(at.values()))))})"))
        best = few.groupBy("i", "m", "cell").agg(F.expr(f"max(struct(gain, -x AS minus, x, follow, array({', '.join(f'l{j}' for j in k)}) AS left)) AS best"))
        return {(r["i"], r["m"]): r["best"].asDict() for r in best.collect() if at.get((r["i"], r["m"])) == r["cell"]}

    done, cuts = {i: [] for i in new}, {i: [] for i in new}
    while any(new.values()):
        best = search()
        for i, leaves in new.items():
            done[i] += [(best[i, k], leaf) for k, leaf in enumerate(leaves) if (i, k) in best]
            new[i] = []
            if not done[i] or len(cuts[i]) + 1 >= n_bins:
                continue
            r, (lo, hi, base, inside) = pick = max(done[i], key=lambda s: (s[0]["gain"], -s[1][0]))
            done[i] = [s for s in done[i] if s is not pick]
            left = np.array(r["left"]) - base
            cuts[i].append((r["x"] + r["follow"]) / 2)
            if len(cuts[i]) + 1 < n_bins:
                new[i] = [(lo, r["x"], base, left), (r["x"], hi, base + left, inside - left)]
    counts.unpersist()
    return {i: [c for k, c in enumerate(sorted(v)) if k == 0 or c - sorted(v)[k - 1] > 1e-9] for i, v in cuts.items()}


def supervised_bins(values: np.ndarray, counts: np.ndarray, n_bins: int, min_samples: int) -> list[float]:
    if len(values) <= 1:
        return []
    if len(values) <= n_bins:
        return midpoints(values)
    n = int(counts.sum())
    return entropy_bins(values, counts, n_bins, least_leaf(n, n_bins, min_samples))


def medians(df: DataFrame, columns: list[Column]) -> list[float | None]:
    """The exact median of each column. A column's range is narrowed around its middle until few distinct values are left in
    it (or one); these are counted, and the median is read off, so no task holds all values of a column."""
    rows = df.select(*[c.cast("double").alias(str(i)) for i, c in enumerate(columns)])
    n = rows.agg(*[F.count(str(i)).alias(str(i)) for i in range(len(columns))]).first()
    lo, hi = [-math.inf] * len(columns), [math.inf] * len(columns)
    inside = lambda i: F.when(F.col(str(i)).between(lo[i], hi[i]), F.col(str(i)))
    open_ = [i for i in range(len(columns)) if n[i]]
    out: list[float | None] = [None] * len(columns)
    while open_:
        stats = rows.agg(*[x for i in open_ for x in (F.approx_count_distinct(inside(i)).alias(f"d{i}"), F.count(F.when(F.col(str(i)) < lo[i], 1)).alias(f"b{i}"), F.count(inside(i)).alias(f"k{i}"))]).first()
        few = [i for i in open_ if stats[f"d{i}"] <= MAX_VALUES]
        if few:
            item = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), inside(i).alias("x")) for i in few]))
            counts = rows.select(item.alias("v")).where("v.x IS NOT NULL").groupBy("v.i", "v.x").agg(F.count(F.lit(1)).alias("n")).toPandas()
            for i in few:
                own = counts[counts["i"] == i].sort_values("x")
                upto = stats[f"b{i}"] + own["n"].cumsum().to_numpy()
                at = lambda r, own=own, upto=upto: float(own["x"].iloc[int(np.searchsorted(upto, r, "right"))])
                out[i] = (at((n[i] - 1) // 2) + at(n[i] // 2)) / 2
        open_ = [i for i in open_ if i not in few]
        if open_:  # the middle, as a share of what is left, with room for the error of the approximation
            share = {i: ((n[i] - 1) / 2 - stats[f"b{i}"]) / stats[f"k{i}"] for i in open_}
            cut = rows.agg(*[F.percentile_approx(inside(i), [max(0.0, share[i] - 0.01), min(1.0, share[i] + 0.01)], MAX_VALUES).alias(str(i)) for i in open_]).first()
            for i in open_:
                lo[i], hi[i] = cut[str(i)]
    return out


class TableEncoder(Estimator):
    """Learns a column profile for each column of a table."""

    def __init__(self, target: str, n_bins: int = 5, min_samples_per_bin: int = 20, categorical: tuple[str, ...] = (), unseen: str = "error"):
        super().__init__()
        self.target, self.n_bins, self.min_samples, self.categorical, self.unseen = target, n_bins, min_samples_per_bin, tuple(categorical), unseen

    def _fit(self, df: DataFrame) -> TableEncoderModel:
        profiles = [ColumnProfile(f.name, column_kind(f, self.target, self.categorical)) for f in df.schema.fields]
        types = dict(df.dtypes)
        numbers = [p for p in profiles if p.kind == "continuous"]
        texts = [p for p in profiles if p.kind == "categorical"]
        number = lambda p: F.col(f"`{p.name}`").cast("double")
        finite = lambda p: F.when(~F.isnan(number(p)), number(p))
        if numbers:
            for p, median in zip(numbers, medians(df, [finite(p) for p in numbers])):
                p.median = median if median is not None else 0.0
            filled = {p.name: F.coalesce(finite(p), F.lit(p.median)) for p in numbers}
            row = df.agg(*[x for i, p in enumerate(numbers) for x in (F.avg(filled[p.name]).alias(f"m{i}"), F.stddev_pop(filled[p.name]).alias(f"s{i}"))]).first()
            for i, p in enumerate(numbers):
                p.mean = float(row[2 * i] or 0.0)
                p.std = float(row[2 * i + 1] or 0.0)
                p.std = 1.0 if p.std < 1e-8 else p.std
        if texts:
            pair = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), as_category(F.col(f"`{p.name}`"), types[p.name]).alias("v")) for i, p in enumerate(texts)]))
            pairs = df.select(pair.alias("x")).select("x.i", "x.v").distinct()
            found = pairs.limit(MAX_CATEGORIES + 1).collect()
            if len(found) > MAX_CATEGORIES:  # the columns of most texts get dictionaries, until the others may be literals
                found = self._dictionaries(pairs, texts)
            for r in found:
                texts[r["i"]].categories.append(r["v"])
            for p in texts:
                p.categories.sort()
        if numbers:
            self._bins(df, numbers, filled, types)
        return TableEncoderModel(self.target, profiles, types, self.unseen)

    def _dictionaries(self, pairs: DataFrame, texts: list[ColumnProfile]) -> list:
        at = files.scratch(pairs.sparkSession, "texts")
        pairs.write.parquet(at)
        pairs = pairs.sparkSession.read.parquet(at)
        sizes = sorted((r["count"], r["i"]) for r in pairs.groupBy("i").count().collect())
        upto = np.cumsum([n for n, _ in sizes])
        large = [i for (_, i), n in zip(sizes, upto) if n > MAX_CATEGORIES]
        for i, d in dictionaries(pairs.where(F.col("i").isin(large))).items():
            texts[i].dictionary = d
        return pairs.where(~F.col("i").isin(large)).collect()

    def _bins(self, df: DataFrame, numbers: list[ColumnProfile], filled: dict[str, Column], types: dict[str, str]) -> None:
        label = as_category(F.col(f"`{self.target}`"), types[self.target])
        wide = df.agg(*[F.approx_count_distinct(filled[p.name]).alias(str(i)) for i, p in enumerate(numbers)]).first()
        over = [i for i in range(len(numbers)) if wide[i] > MAX_VALUES]

        def rows(which: list[int]) -> DataFrame:
            item = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), filled[numbers[i].name].alias("x")) for i in which]))
            return df.select(label.alias("y"), item.alias("v")).select("v.i", "v.x", "y", F.lit(1).cast("long").alias("n"))

        if over:
            for i, cuts in entropy_bins_in_cells(rows(over), self.n_bins, self.min_samples, sum(wide[i] for i in over)).items():
                numbers[i].thresholds = cuts
        under = [i for i in range(len(numbers)) if i not in over]
        few = rows(under).groupBy("i", "x", "y").agg(F.sum("n").alias("n")).toPandas() if under else None
        for i, p in enumerate(numbers):
            if i in over:
                continue
            own = few[few["i"] == i]
            table = own.pivot_table(index="x", columns="y", values="n", aggfunc="sum", fill_value=0).sort_index()
            p.thresholds = supervised_bins(table.index.to_numpy(float), table.to_numpy(float), self.n_bins, self.min_samples)


class TableEncoderModel(Model):
    """Frozen profiles; ``transform`` gives an INT column for each profile."""

    def __init__(self, target: str, profiles: list[ColumnProfile], types: dict[str, str], unseen: str = "error"):
        super().__init__()
        self.target, self.profiles, self.types, self.unseen = target, profiles, types, unseen

    @property
    def columns(self) -> list[str]:
        return [p.name for p in self.profiles]

    def profile(self, name: str) -> ColumnProfile:
        return next(p for p in self.profiles if p.name == name)

    def code(self, p: ColumnProfile, there: set[str]) -> Column:
        if p.name not in there:
            if p.name == self.target:  # prediction without labels
                return F.lit(0)
            raise ValueError(f"column {p.name} is missing")
        c = F.col(f"`{p.name}`")
        if p.kind == "continuous":
            x = c.try_cast("double")
            return digitize(F.coalesce(F.when(~F.isnan(x), x), F.lit(p.mean)), p.thresholds).cast("int")
        text = as_category(c, self.types[p.name])
        if p.dictionary is not None:
            code, has_missing = F.col(self._joined(p)).cast("int"), F.lit(p.dictionary.missing is not None)
        else:
            at = F.array_position(F.lit(p.categories), text)
            code, has_missing = F.when(at > 0, (at - 1).cast("int")), F.array_contains(F.lit(p.categories), "nan")
        known = F.coalesce(code, F.when(c.isNull() & ~has_missing, 0)) if p.name == self.target else code
        if self.unseen == "uniform":
            return known
        return F.when(known.isNull(), F.raise_error(F.concat(F.lit(f"unseen category in {p.name}: "), text)).cast("int")).otherwise(known)

    def _joined(self, p: ColumnProfile) -> str:
        return f"_code_of_{self.columns.index(p.name)}"

    def _with_dictionaries(self, df: DataFrame) -> DataFrame:
        """df, and a column of codes for each dictionary whose column is there."""
        there = set(df.columns)
        for p in self.profiles:
            if p.dictionary is not None and p.name in there:
                name = self._joined(p)
                keyed = df.withColumn(f"{name}_text", as_category(F.col(f"`{p.name}`"), self.types[p.name]))
                df = p.dictionary.encode(keyed, f"{name}_text", name).drop(f"{name}_text")
        return df

    def _transform(self, df: DataFrame) -> DataFrame:
        there = set(df.columns)
        return self._with_dictionaries(df).select(*[self.code(p, there).alias(p.name) for p in self.profiles])

    def with_codes(self, df: DataFrame, prefix: str = "code_") -> DataFrame:
        """All columns of df, and the codes next to them."""
        there = set(df.columns)
        codes = [self.code(p, there).alias(prefix + p.name) for p in self.profiles]
        if all(p.dictionary is None for p in self.profiles):
            return df.select("*", *codes)
        return self._with_dictionaries(df).select(*[F.col(f"`{c}`") for c in df.columns], *codes)

    def _standard(self, p: ColumnProfile) -> Column:
        x = F.col(f"`{p.name}`").try_cast("double")
        return ((F.coalesce(F.when(~F.isnan(x), x), F.lit(p.mean)) - p.mean) / p.std).cast("float")

    def _with_codes_and(self, df: DataFrame, **more: Column) -> DataFrame:
        there = set(df.columns)
        # under other names first: inside a lambda, a column's name would mean an alias of the same projection
        both = self._with_dictionaries(df).select(*[c.alias(f"_{n}") for n, c in more.items()], *[self.code(p, there).alias(f"_c{i}") for i, p in enumerate(self.profiles)])
        return both.select(*[F.col(f"_c{i}").alias(p.name) for i, p in enumerate(self.profiles)], *[F.col(f"_{n}").alias(n) for n in more])

    def encoded(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """The codes and ``features``: one-hot categories and standardised numbers as ARRAY<FLOAT>; and the columns of df to keep.
        That is as wide as all texts together: with dictionaries, ``encoded_sparse`` gives the same numbers without the zeros."""
        there = set(df.columns)
        wide = [p.name for p in self.profiles if p.dictionary is not None]
        if wide:
            raise ValueError(f"too many texts for dense features: {', '.join(wide)}; see encoded_sparse, or screen by mi_filter")
        parts = []
        for p in self.profiles:
            if p.kind == "continuous":
                parts.append(F.array(self._standard(p)))
            else:
                text = as_category(F.col(f"`{p.name}`"), self.types[p.name]) if p.name in there else F.lit(None)
                parts.append(_one_hot(p.categories, text))
        return self._with_codes_and(df, features=F.concat(*parts), **{c: F.col(f"`{c}`") for c in keep})

    def encoded_sparse(self, df: DataFrame) -> DataFrame:
        """The codes, and the features that may not be zero as ``places`` ARRAY<LONG> and ``numbers`` ARRAY<FLOAT>: one entry for a
        number, one for a known category, at any number of categories."""
        there = set(df.columns)
        places, numbers, start = [], [], 0
        for p in self.profiles:
            if p.kind == "continuous":
                places.append(F.lit(start).cast("long"))
                numbers.append(self._standard(p))
            elif p.name in there:
                if p.dictionary is not None:
                    code = F.col(self._joined(p))
                else:
                    at = F.array_position(F.lit(p.categories), as_category(F.col(f"`{p.name}`"), self.types[p.name]))
                    code = F.when(at > 0, at - 1)
                places.append((code + start).cast("long"))
                numbers.append(F.when(code.isNotNull(), 1.0).cast("float"))
            start += 1 if p.kind == "continuous" else p.size
        return self._with_codes_and(df, places=F.array_compact(F.array(*places)), numbers=F.array_compact(F.array(*numbers)))


def _one_hot(categories: list[str], text: Column) -> Column:
    return F.transform(F.lit(categories), lambda v: F.coalesce((v == text).cast("float"), F.lit(0.0).cast("float")))


def align_dummies(train: DataFrame, test: DataFrame, target: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Dummy columns of texts (with one for nulls), numbers as they are, both tables with the union of the columns, absent
    ones 0; labels are coded over both. Names are sanitised."""
    names = [c for c in train.columns if c != target]
    types = dict(train.dtypes)
    texts = [c for c in names if types[c] in ("string", "boolean")]
    both = train.select(*names).unionByName(test.select(*names))
    seen: dict[str, list] = {c: [] for c in texts}
    if texts:
        pair = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in texts]))
        found = both.select(pair.alias("x")).select("x.c", "x.v").distinct().limit(MAX_CATEGORIES + 1).collect()
        if len(found) > MAX_CATEGORIES:
            raise ValueError(f"more than {MAX_CATEGORIES} distinct texts: a column of them each would be no table; see sparse_dummies")
        for r in found:
            seen[r["c"]].append(r["v"])
    cols, raw = [], []
    for c in names:
        if c in texts:
            for v in sorted((x for x in seen[c] if x is not None)):
                cols.append((F.col(f"`{c}`").cast("string") == v))
                raw.append(f"{c}_{v}")
            cols.append(F.col(f"`{c}`").isNull())
            raw.append(f"{c}_nan")
        else:
            cols.append(F.col(f"`{c}`"))
            raw.append(c)
    clean = sanitize_names(raw)
    labels = sorted(r[0] for r in train.select(F.col(target).cast("string")).union(test.select(F.col(target).cast("string"))).distinct().collect() if r[0] is not None)
    code = (F.array_position(F.lit(labels), F.col(target).cast("string")) - 1).cast("int").alias("label_code")
    pick = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for c, n in zip(cols, clean)]
    return train.select(*pick, code), test.select(*pick, code), labels


def sparse_dummies(train: DataFrame, test: DataFrame, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``align_dummies`` at any number of texts: both tables as label_code, ``places`` and ``numbers`` of the features that are not
    zero, in the same order of features, and the features' (place, name), names as they are."""
    names = [c for c in train.columns if c != target]
    types = dict(train.dtypes)
    texts = [*(c for c in names if types[c] in ("string", "boolean")), target]
    both = train.select(*texts).unionByName(test.select(*texts))
    pair = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(texts)]))
    found = dictionaries(both.select(pair.alias("x")).select("x.i", "x.v"))
    start, at = {}, 0
    for c in names:
        start[c] = at
        at += 1 + (found[texts.index(c)].size if c in texts and texts.index(c) in found else 0)

    def coded(df: DataFrame) -> DataFrame:
        out = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
        col = {c: f"_{i}" for i, c in enumerate(df.columns)}
        for i, c in enumerate(texts):
            out = out.withColumn(f"t{i}", F.col(col[c]).cast("string"))
            out = found[i].encode(out, f"t{i}", f"k{i}") if i in found else out.withColumn(f"k{i}", F.lit(None).cast("long"))
        places, numbers = [], []
        for c in names:
            if c in texts:
                i = texts.index(c)
                places.append(F.coalesce(F.col(f"k{i}"), F.lit(found[i].size if i in found else 0)) + F.lit(start[c]))  # the last one is that of nulls
                numbers.append(F.lit(1.0))
            else:
                x = F.coalesce(F.col(col[c]).cast("double"), F.lit(0.0))
                places.append(F.when(x != 0, start[c]).cast("long"))
                numbers.append(F.when(x != 0, x))
        pick = lambda parts, kind: F.array_compact(F.array(*parts)).cast(kind)
        return out.select(pick(places, "array<bigint>").alias("places"), pick(numbers, "array<double>").alias("numbers"), F.col(f"k{len(texts) - 1}").cast("int").alias("label_code"))

    spark = train.sparkSession
    single = [(start[c] + (found[texts.index(c)].size if c in texts and texts.index(c) in found else 0), f"{c}_nan" if c in texts else c) for c in names]
    legend = spark.createDataFrame(single, "place long, name string")
    for c in names:
        if c in texts and texts.index(c) in found:
            legend = legend.union(found[texts.index(c)].frame(spark).select((F.col("code") + start[c]).alias("place"), F.concat(F.lit(f"{c}_"), "v").alias("name")))
    return coded(train), coded(test), legend


def sanitize_names(names: list[str]) -> list[str]:
    """Names without [ ] <; an empty one becomes feature_i, a repeated one gets a running number."""
    out, used = [], {}
    for i, name in enumerate(names):
        base = "".join("_" if c in "[]<" else c for c in name) or f"feature_{i}"
        k = used.get(base, 0)
        used[base] = k + 1
        out.append(base if not k else f"{base}__{k}")
    return out
