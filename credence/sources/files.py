"""Small files (metadata, artifacts, reports) on the driver's disk or on whatever file system Spark reads.

A path with a scheme goes through Spark's readers and writers, so an object store or a cluster file system works alike; a
path without one is a file of the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def remote(path: str | Path) -> bool:
    return "://" in str(path)


def join(folder: str | Path, *names: str) -> str:
    return "/".join([str(folder).rstrip("/"), *names]) if remote(folder) else str(Path(folder, *names))


def exists(spark: SparkSession | None, path: str | Path) -> bool:
    if not remote(path):
        return Path(path).exists()
    try:
        (spark or SparkSession.active()).read.format("binaryFile").load(str(path))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_text(spark: SparkSession | None, path: str | Path) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"no file at {path}")
    if not remote(path):
        return Path(path).read_text()
    return "".join(r["value"] for r in (spark or SparkSession.active()).read.text(str(path), wholetext=True).collect())


def write_text(spark: SparkSession | None, path: str | Path, text: str) -> None:
    if remote(path):
        (spark or SparkSession.active()).createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(str(path))  # which ends with a line break
    else:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder in the place that driver and executors share; a temporary one only where the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="credence-")
    return f"{named.rstrip('/')}/credence/{label}-{uuid.uuid4().hex}"
