"""Finished runs of a suite, kept one document each, so that a suite that was broken off goes on where it was.

A record is added under a key of all that decides a run, and is never changed. A document that was not written to its end does
not count; a failed run is not a finished one.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

from ..sources import files


class RecordLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, key: dict) -> str:
        name = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()
        return files.join(self.folder, f"{name}.json")

    def find(self, key: dict) -> dict | None:
        path = self.path(key)
        if not files.exists(self.spark, path):
            return None
        try:
            got = json.loads(files.read_text(self.spark, path))
        except json.JSONDecodeError:  # broken off while it was written
            return None
        return got if got["status"] != "failed" else None

    def add(self, key: dict, record: dict) -> None:
        text, path = json.dumps(record, default=str), self.path(key)
        if files.remote(path):
            files.write_text(self.spark, path, text)  # appears when Spark commits the job
            return
        part = f"{path}.{uuid.uuid4().hex}.part"
        files.write_text(self.spark, part, text)
        os.replace(Path(part), Path(path))
