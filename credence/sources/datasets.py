"""Sources of tables with a target: CSV files, folders with a graph, frames at hand, generated data; and their splits."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Dag
from . import files
from .generators import EXPERT_TARGETS, mixed_dataset

#: Texts that CSV files use for missing values.
NULL_TEXTS = ["", "#N/A", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


@dataclass
class Dataset:
    name: str
    frame: DataFrame
    target: str
    regime: str = "real"  # or known_graph
    truth: Dag | None = None
    notes: dict = field(default_factory=dict)


@dataclass
class Split:
    id: str
    seed: int
    train: DataFrame
    valid: DataFrame
    test: DataFrame
    dataset: Dataset


class MissingDataset(FileNotFoundError):
    pass


#: How every text begins that a cast takes for a number, and what a whole number looks like.
NUMBER = r"^[\x00-\x20\x7f]*[-+]?(\.?[0-9]|(?i:inf|nan))"
WHOLE = r"^[\x00-\x20\x7f]*[-+]?[0-9]+[\x00-\x20\x7f]*$"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, inferred types, usual missing texts as null. A text that cannot be a number is not cast to one: a failed cast costs
    an exception."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    clean = raw.select(*[F.when(~F.col(f"`{c}`").isin(NULL_TEXTS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    tests = [x for i, c in enumerate(clean.columns) for x in (F.count(f"`{c}`").alias(f"n{i}"), F.count(F.when(F.col(f"`{c}`").rlike(WHOLE), F.col(f"`{c}`").try_cast("bigint"))).alias(f"i{i}"), F.count(F.when(F.col(f"`{c}`").rlike(NUMBER), F.col(f"`{c}`").try_cast("double"))).alias(f"d{i}"), F.count(F.when(F.lower(f"`{c}`").isin("true", "false"), 1)).alias(f"b{i}"))]
    row = clean.agg(*tests).first() if tests else None
    out = []
    for i, c in enumerate(clean.columns):
        n = row[f"n{i}"]
        kind = "string" if not n else "bigint" if row[f"i{i}"] == n else "double" if row[f"d{i}"] == n else "boolean" if row[f"b{i}"] == n else "string"
        out.append(F.col(f"`{c}`").cast(kind).alias(c))
    return clean.select(*out)


BUCKET_ROWS = 100_000
CHUNK = 1_000_000


def holdout(df: DataFrame, seed: int, test: float, valid: float, by: str | None = None) -> DataFrame:
    """df with ``split``: exact shares, test first, then validation of the rest; within each class of ``by``, if named.

    Rows are ranked by a hash of their content. Equal rows are one row with a number until the ranks are known, so a row
    that makes up much of the table is counted before it is shuffled. Distinct rows are ranked by hash bucket first, with
    the buckets' running totals, then within a bucket of about ``BUCKET_ROWS``; a number above ``CHUNK`` is cut into chunks
    before it is spread out into rows again."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    class_ = F.coalesce(F.col(f"`{by}`").cast("string"), F.lit("\0")) if by else F.lit("")
    equal = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_k"))
    buckets = max(1, equal.count() // BUCKET_ROWS)
    keyed = equal.withColumn("_c", class_).withColumn("_h", F.xxhash64(*columns, F.lit(seed))).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    w = Window.partitionBy("_c")
    sizes = keyed.groupBy("_c", "_b").agg(F.sum("_k").alias("_s"))
    sizes = sizes.select("_c", "_b", F.coalesce(F.sum("_s").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_s").over(w).alias("_n"))
    inner = Window.partitionBy("_c", "_b").orderBy("_h", *[c.cast("string") for c in columns]).rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumn("_in", F.coalesce(F.sum("_k").over(inner), F.lit(0))).join(sizes, ["_c", "_b"]).withColumn("_r", F.col("_before") + F.col("_in"))
    n_test = F.ceil(F.round(F.col("_n") * F.lit(test), 6))
    n_valid = F.ceil(F.round((F.col("_n") - n_test) * F.lit(valid), 6))
    # of the places _r + 1 to _r + _k, those up to n_test are test, and so on
    share = lambda lo, hi: F.greatest(F.least(F.col("_r") + F.col("_k"), hi) - F.greatest(F.col("_r"), lo), F.lit(0))
    parts = [("test", share(F.lit(0), n_test)), ("valid", share(n_test, n_test + n_valid)), ("train", share(n_test + n_valid, F.col("_n")))]
    part = F.explode(F.filter(F.array(*[F.struct(F.lit(name).alias("split"), n.cast("long").alias("n")) for name, n in parts]), lambda x: x["n"] > 0))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_p.n") - 1) / CHUNK)))
    chunks = ranked.withColumn("_p", part).withColumn("_q", chunk)
    many = F.least(F.lit(CHUNK).cast("long"), F.col("_p.n") - F.col("_q") * CHUNK)
    return chunks.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), many))).select(*columns, F.col("_p.split").alias("split"))


class Adapter:
    """A named source. Subclass and give ``load``."""

    def __init__(self, name: str, repeats: int = 1, test: float = 0.2, valid: float = 0.2):
        self.name, self.repeats, self.test, self.valid = name, repeats, test, valid

    def available(self, spark: SparkSession | None = None) -> bool:
        return True

    def load(self, spark: SparkSession, seed: int = 7) -> Dataset:
        raise NotImplementedError

    def stratified(self, data: Dataset) -> bool:
        return data.regime == "real"

    def splits(self, spark: SparkSession, seed: int) -> Iterator[Split]:
        for r in range(self.repeats):
            data = self.load(spark, seed + r)
            parts = holdout(data.frame, seed + r, self.test, self.valid, data.target if self.stratified(data) else None).persist()
            get = lambda s: parts.where(F.col("split") == s).drop("split")
            yield Split(f"{self.name}-{seed + r}", seed + r, get("train"), get("valid"), get("test"), data)


class InMemoryAdapter(Adapter):
    def __init__(self, data: Dataset, repeats: int = 1, test: float = 0.2, valid: float = 0.2):
        super().__init__(data.name, repeats, test, valid)
        self.data = data

    def load(self, spark, seed=7):
        return self.data


class CsvAdapter(Adapter):
    def __init__(self, path: str, target: str, name: str, repeats: int = 1):
        super().__init__(name, repeats)
        self.path, self.target = path, target

    def available(self, spark=None):
        return files.exists(spark or SparkSession.active(), self.path)

    def load(self, spark, seed=7):
        if not self.available(spark):
            raise MissingDataset(self.path)
        return Dataset(self.name, read_csv(spark, self.path), self.target)


class GraphFolderAdapter(Adapter):
    """frame.csv, edges.csv (source, target) and, if there, metadata.json. The target is named there, else ``label``, else
    the last column."""

    def __init__(self, root: str, name: str, repeats: int = 2):
        super().__init__(name, repeats)
        self.root = root

    def at(self, name: str) -> str:
        return files.join(self.root, name)

    def available(self, spark=None):
        spark = spark or SparkSession.active()
        return files.exists(spark, self.at("frame.csv")) and files.exists(spark, self.at("edges.csv"))

    def load(self, spark, seed=7):
        if not self.available(spark):
            raise MissingDataset(str(self.root))
        frame = read_csv(spark, self.at("frame.csv"))
        edges = [(r["source"], r["target"]) for r in spark.read.csv(self.at("edges.csv"), header=True).collect()]
        notes = json.loads(files.read_text(spark, self.at("metadata.json"))) if files.exists(spark, self.at("metadata.json")) else {}
        target = notes.get("target_column") or ("label" if "label" in frame.columns else frame.columns[-1])
        return Dataset(self.name, frame, target, "known_graph", Dag([*frame.columns, *(n for e in edges for n in e)], edges), notes)


class SyntheticAdapter(Adapter):
    def __init__(self, name: str, rows: int, features: int, repeats: int = 2, generator: Callable = mixed_dataset):
        super().__init__(name, repeats, test=0.25, valid=0.2)
        self.rows, self.features, self.generator = rows, features, generator

    def stratified(self, data):
        return False

    def load(self, spark, seed=7):
        frame, graph = self.generator(spark, self.rows, self.features, seed)
        return Dataset(self.name, frame, "label", "known_graph", graph)


class ParquetAdapter(Adapter):
    """A stored toy table (such as the three classic ones) with a named target, taken as text."""

    def __init__(self, path: str, target: str, name: str, repeats: int = 2):
        super().__init__(name, repeats)
        self.path, self.target = path, target

    def available(self, spark=None):
        return files.exists(spark or SparkSession.active(), self.path)

    def load(self, spark, seed=7):
        if not self.available(spark):
            raise MissingDataset(self.path)
        df = spark.read.parquet(self.path)
        return Dataset(self.name, df.withColumn(self.target, F.col(self.target).cast("string")), self.target)


def registry(base: str = ".") -> dict[str, Adapter]:
    #: Names, sizes and repeats of the nine datasets.
    out: dict[str, Adapter] = {
        "synthetic_tiny": SyntheticAdapter("synthetic_tiny", 180, 5, repeats=1),
        "synthetic_small": SyntheticAdapter("synthetic_small", 300, 6),
        "synthetic_medium": SyntheticAdapter("synthetic_medium", 500, 8),
    }
    for name in ("breast_cancer", "iris", "wine"):
        out[f"sklearn_{name}"] = ParquetAdapter(files.join(base, "datasets", "toy", f"{name}.parquet"), "target", f"sklearn_{name}")
    for name in EXPERT_TARGETS:
        out[name] = GraphFolderAdapter(files.join(base, "datasets", "expert_bn", name), name)
    return out


@dataclass(frozen=True)
class Suite:
    name: str
    datasets: tuple[str, ...]
    baselines: tuple[str, ...]
    seeds: tuple[int, ...]
    ablations: tuple[str, ...]


#: Names of the models and contents of the suites.
BASELINES = ("neural_screened_bn", "greedy_hc_bn", "naive_bayes", "tan", "kdb", "aode", "xgboost", "lightgbm", "catboost", "tabpfn")


def suites() -> dict[str, Suite]:
    return {
        "smoke": Suite("smoke", ("synthetic_tiny", "sklearn_breast_cancer"), ("neural_screened_bn", "greedy_hc_bn", "naive_bayes", "tan"), (7,), ("default", "no_screener")),
        "paper_minimum": Suite(
            "paper_minimum",
            ("synthetic_small", "synthetic_medium", "alarm", "child", "insurance", "sklearn_breast_cancer", "sklearn_wine"),
            BASELINES,
            (7, 13),
            ("default", "no_screener", "no_bundles", "no_bootstrap", "generative_only", "discriminative_only", "small_pool", "wide_parents"),
        ),
    }
