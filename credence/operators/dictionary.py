"""Dictionaries of any size: the distinct texts of columns, numbered from 0 in their order.

Distinct texts are dealt to tasks by range and sorted there, so no task holds a column. The number of a text is its place in its
task plus the number of texts of its column in the tasks before, of which the driver sees one row a task and column. The
dictionary is a Parquet table; rows get their codes by a join, which broadcasts the dictionary only if its measured size allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

#: Bytes of a dictionary up to which it is broadcast; a row counts as its text and ``ROW_BYTES``.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 64


@dataclass(frozen=True)
class Dictionary:
    """``path``: a table (v, code) of ``size`` texts, which hold so many ``text_bytes``; ``missing``: the code of ``nan``."""

    path: str
    size: int
    text_bytes: int
    missing: int | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def small(self) -> bool:
        return self.text_bytes + ROW_BYTES * self.size <= BROADCAST_BYTES

    def lookup(self, df: DataFrame, on: str, source: str, target: str, name: str) -> DataFrame:
        """df and a column ``name``: what the dictionary's ``target`` is for ``on``, null if that is not in it."""
        own = self.frame(df.sparkSession).select(F.col(source).alias(f"{name}_key"), F.col(target).alias(name))
        own = F.broadcast(own) if self.small() else own.hint("shuffle_merge")  # a hot text is split by the adaptive skew join
        return df.join(own, F.col(on) == F.col(f"{name}_key"), "left").drop(f"{name}_key")

    def encode(self, df: DataFrame, text: str, name: str) -> DataFrame:
        return self.lookup(df, text, "v", "code", name)

    def decode(self, df: DataFrame, code: str, name: str) -> DataFrame:
        return self.lookup(df, code, "code", "v", name)


def dictionaries(texts: DataFrame) -> dict[int, Dictionary]:
    """One for each column number i of the pairs (i, v); pairs may repeat, null texts are left out."""
    spark = texts.sparkSession
    at = files.scratch(spark, "dictionary")
    ranked = texts.where(F.col("v").isNotNull()).distinct().repartitionByRange("i", "v").sortWithinPartitions("i", "v")
    ranked.select("i", "v", F.monotonically_increasing_id().alias("at")).write.parquet(f"{at}/ranked")
    ranked = spark.read.parquet(f"{at}/ranked").withColumn("task", F.shiftright("at", 33))
    parts = ranked.groupBy("i", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("v")).alias("bytes")).toPandas().sort_values(["i", "task"])
    if parts.empty:
        return {}
    parts["shift"] = parts.groupby("i")["n"].cumsum() - parts["n"] - parts["first"]
    shifts = spark.createDataFrame(parts[["i", "task", "shift"]], "i int, task long, shift long")  # a row for each task and column
    coded = ranked.join(F.broadcast(shifts), ["i", "task"]).select("i", "v", (F.col("at") + F.col("shift")).alias("code"))
    coded.write.partitionBy("i").parquet(f"{at}/codes")
    missing = {r["i"]: r["code"] for r in spark.read.parquet(f"{at}/codes").where(F.col("v") == "nan").collect()}  # one a column at most
    total = parts.groupby("i")[["n", "bytes"]].sum()
    return {int(i): Dictionary(f"{at}/codes/i={i}", int(r["n"]), int(r["bytes"]), missing.get(int(i))) for i, r in total.iterrows()}
