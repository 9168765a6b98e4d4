"""The neural screener on tables with many copies of their rows."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.config import ScreenerConfig
from credence.operators import neural
from credence.plans import encoding
from credence.plans.encoding import TableEncoder


def test_steps_that_copies_make_large_are_jobs(spark, monkeypatch):
    few = spark.range(400).select(F.when(F.hash("id") % 3 == 0, "a").otherwise("b").alias("y"), F.when(F.hash("id") % 5 < 2, "s").otherwise("t").alias("other"), (F.hash("id") % 90 / 10.0).alias("number"))
    df = few.crossJoin(spark.range(40)).drop("id")
    encoder, config = TableEncoder("y").fit(df), ScreenerConfig(epochs=2, bootstraps=2, hidden=8)
    assert neural.step_rows(150_000, 9_000_000, config) > neural.STEP_ROWS > neural.step_rows(150_000, 150_000, config)
    jobs, summed, out = [], neural.FarRows.summed, []
    monkeypatch.setattr(neural.FarRows, "summed", lambda self, blocks, part: jobs.append(blocks.getNumPartitions()) or summed(self, blocks, part))
    for least in (10**9, 1):
        monkeypatch.setattr(neural, "STEP_ROWS", least)
        edges, bundles = neural.neural_edges(encoder, df, replace(config))
        out.append([sorted(map(tuple, x.collect())) for x in (edges, bundles)])
        assert bool(jobs) == (least == 1)
    assert set(jobs) == {spark.sparkContext.defaultParallelism} and len(jobs) > 2 * 64
    for near, far in zip(*out):
        assert len(near) and [r[:-1] for r in near] == [r[:-1] for r in far]
        assert [r[-1] for r in near] == pytest.approx([r[-1] for r in far], abs=1e-6)


def test_what_is_dropped_is_drawn_once_an_epoch(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2, 700), rng.normal(size=700)
    net = neural.MultiHead([slice(0, 2), slice(2, 3)], [2, 0], 8, 2, 0.3, 3)
    drawn, kept = [], neural.MultiHead.kept
    monkeypatch.setattr(neural.MultiHead, "kept", lambda self, h, epoch: drawn.append((epoch, len(h))) or kept(self, h, epoch))
    net.fit(np.column_stack([np.eye(2)[a], b]), [a, b], 3, 70, 0.01)
    assert net.t == 3 * 10 and drawn == [(0, 700), (1, 700), (2, 700)]


def test_a_histogram_has_no_more_tasks_than_its_cells_ask_for(spark):
    hist = spark.range(3_000).select(F.lit(0).alias("i"), (F.col("id") % 500).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("y"), F.lit(1).cast("long").alias("n"))
    counts = encoding.running_counts(hist, ["a", "b"], 500).persist()
    assert counts.count() == 500 and counts.rdd.getNumPartitions() <= 2 < int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts.unpersist()
