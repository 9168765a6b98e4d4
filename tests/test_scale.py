"""Plans and results that have to hold on large or skewed tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.config import SearchConfig
from credence.operators import metrics
from credence.operators.counts import CountStore
from credence.operators.graph import Dag
from credence.operators.scores import GraphScorer
from credence.sources import files
from credence.sources.datasets import GraphFolderAdapter, MissingDataset, holdout


def test_splits_are_exact_with_a_row_that_is_most_of_the_table(spark, monkeypatch):
    from credence.sources import datasets

    monkeypatch.setattr(datasets, "CHUNK", 700)
    monkeypatch.setattr(datasets, "BUCKET_ROWS", 40)
    df = spark.range(6000).select(F.when(F.col("id") < 5000, 0).otherwise(F.col("id")).alias("x"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"))
    for by in (None, "y"):
        out = holdout(df, 3, 0.2, 0.2, by).groupBy("y", "split").count().collect()
        sizes = {}
        for r in out:
            key = (r["y"] if by else "", r["split"])
            sizes[key] = sizes.get(key, 0) + r["count"]
        for key, n in ((("a",), 2000), (("b",), 4000)) if by else ((("",), 6000),):
            test = -(-n // 5)
            valid = -(-(n - test) // 5)
            assert [sizes[(*key, s)] for s in ("test", "valid", "train")] == [test, valid, n - test - valid]
    rows = holdout(df, 3, 0.2, 0.2)
    assert rows.drop("split").exceptAll(df).isEmpty() and df.exceptAll(rows.drop("split")).isEmpty()
    again = holdout(df.repartition(7), 3, 0.2, 0.2)
    assert again.exceptAll(rows).isEmpty()


def test_area_under_the_curve_by_bands(spark):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.random(3000), np.full(500, 0.25), [0.0, 1.0, 1.0]])
    y = (rng.random(len(p)) < p).astype(int)
    rows = spark.createDataFrame([(int(a), [float(1 - b), float(b)]) for a, b in zip(y, p)], "y int, probabilities array<double>")
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean())
    assert metrics.auc(rows, 2).first()[0] == pytest.approx(want, abs=1e-9)


def test_a_search_step_takes_two_jobs_however_many_graphs_it_looks_at(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([tuple(map(int, r)) for r in rng.integers(0, 3, (400, 5))], ", ".join(f"{c} int" for c in "abcde"))
    store = CountStore(df, 0, dict.fromkeys("abcde", 3))
    scorer = GraphScorer(store, "a", SearchConfig())
    graphs = [Dag("abcde", [("a", c), (p, c)]) for c in "bcd" for p in "bcde" if p != c]
    sc = spark.sparkContext
    sc.setJobGroup("step", "one step")
    scorer.prepare(graphs)
    scores = [scorer.score(g)["total"] for g in graphs]
    sc.setJobGroup("other", "")
    tracker = sc.statusTracker()
    assert len(set(scores)) > 5 and len(tracker.getJobIdsForGroup("step")) <= 6  # adaptive plans run a job a stage
    near = GraphScorer(CountStore(df, 1000, dict.fromkeys("abcde", 3)), "a", SearchConfig())
    assert scores == pytest.approx([near.score(g)["total"] for g in graphs])


def test_files_behind_a_scheme(spark, tmp_path):
    at = f"file://{tmp_path}/x"
    assert not files.exists(spark, f"{at}/a.json")
    files.write_text(spark, f"{at}/a.json", '{"k": 1}\n2')
    assert files.exists(spark, f"{at}/a.json") and files.read_text(spark, f"{at}/a.json") == '{"k": 1}\n2\n'
    with pytest.raises(MissingDataset):
        GraphFolderAdapter(at, "none").load(spark)
