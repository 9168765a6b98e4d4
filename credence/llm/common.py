"""Session plumbing shared by the text operators.

Intermediate tables are written as Parquet under the shared folder that the cluster names in ``spark.checkpoint.dir``
and read back, which cuts lineage in a form that survives the loss of an executor. Where that setting is absent (local
tests) a temporary folder is registered once as the checkpoint folder; on a cluster its absence is an error. The tables stay
there, since the returned frames read them: an expiry rule on the folder clears them away.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one Arrow batch carries to a Python worker. Texts may be long, so batches are kept short.
ARROW_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        named = sc.getCheckpointDir()
        if not named:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="credence-"))
            named = sc.getCheckpointDir()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/credence/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower (never raise) the session's Arrow batch length so that a batch of long texts fits in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def runs_of(texts: list[str], chars: int):
    """Slices (i, j) of ``texts`` with at most ``chars`` characters together, or a single longer text."""
    i, held = 0, 0
    for j, x in enumerate(texts):
        if j > i and held + len(x) > chars:
            yield i, j
            i, held = j, 0
        held += len(x)
    if i < len(texts):
        yield i, len(texts)
