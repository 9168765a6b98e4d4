"""The neural screener trains the same network in one task and over many."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.config import ScreenerConfig
from credence.operators import neural
from credence.plans.encoding import TableEncoder


def test_copies_are_dealt_in_turn_and_none_is_lost():
    h = neural.keyed(np.arange(500, dtype=np.uint64), 9)
    copies = np.arange(500) % 40
    each = np.stack([neural.dealt(h, copies, 3, 2, s, 7) for s in range(7)])
    assert (each.sum(0) == copies).all() and (each.max(0) - each.min(0) <= 1).all()
    single = np.stack([neural.dealt(h, np.ones(500, int), 3, 2, s, 7) for s in range(7)]).sum(1)
    assert single.sum() == 500 and single.min() > 40  # batches of about the same size


@pytest.mark.parametrize("mean", [0.2, 1.0, 25.0, 31.0, 4000.0])
def test_weights_are_poisson(mean):
    h = neural.keyed(np.arange(40_000, dtype=np.uint64), 5)
    x = neural.poisson(neural.uniform(h), np.full(len(h), mean))
    assert abs(x.mean() - mean) < 4 * np.sqrt(mean / len(x)) and abs(x.var() / mean - 1) < 0.05


def test_all_heads_at_once_equal_each_head_on_its_own():
    rng = np.random.default_rng(0)
    net = neural.MultiHead([slice(0, 2), slice(2, 3), slice(3, 6)], [2, 0, 3], 9, 2, 0.3, 3)
    a, c = rng.integers(0, 2, 30), rng.integers(0, 3, 30)
    x = np.concatenate([np.eye(2)[a], rng.normal(size=(30, 1)), np.eye(3)[c]], 1)
    ys, w, h = [a, x[:, 2], c], rng.integers(1, 4, 30).astype(float), neural.keyed(np.arange(30, dtype=np.uint64), 1)
    gates, total = net.gates(h, 4), 0.0
    assert all(0.5 < (g > 0).mean() < 0.9 for g in gates)
    for j, y in enumerate(ys):
        z = x.copy()
        z[:, net.blocks[j]] = 0
        for k in range(2):
            z = z @ net.p[f"w{k}"] + net.p[f"b{k}"]
            z = np.maximum(z, 0) * gates[k]
        total += float((net.head(z, y, j)[0] * w).sum()) / 3
    got, g = net.gradient_sums(x, ys, w, h, 4)
    assert got == pytest.approx(total)
    for key, at in (("w0", (4, 2)), ("w1", (3, 5)), ("b0", (1,)), ("v2", (2, 1)), ("c1", (0,))):
        old, values = net.p[key][at], []
        for d in (1e-5, -1e-5):
            net.p[key][at] = old + d
            values.append(net.gradient_sums(x, ys, w, h, 4)[0])
        net.p[key][at] = old
        assert (values[0] - values[1]) / 2e-5 == pytest.approx(g[key][at], abs=1e-5)


def _frame(spark, n=1200):
    kind = F.when(F.col("id") < n // 3, 0).otherwise(F.col("id") % 7)  # one row is a third of the table
    return spark.range(n).select(F.when(kind % 3 == 0, "a").otherwise("b").alias("y"), F.when(kind % 3 == 0, "p").otherwise("q").alias("copy"), F.when(F.hash("id") % 5 < 2, "s").otherwise("t").alias("other"), (F.hash("id") % 50 / 10.0).alias("number"))


def test_one_model_on_either_side_of_the_limit(spark):
    df = _frame(spark)
    encoder = TableEncoder("y").fit(df)
    config = ScreenerConfig(epochs=2, bootstraps=2, batch=400, hidden=8)
    out = []
    for most in (10_000, 1):
        edges, bundles = neural.neural_edges(encoder, df.repartition(5), replace(config, max_rows=most))
        both = [sorted(map(tuple, x.collect())) for x in (edges, bundles)]
        out.append(both)
    for near, far in zip(*out):
        assert len(near) and [r[:-1] for r in near] == [r[:-1] for r in far]
        assert [r[-1] for r in near] == pytest.approx([r[-1] for r in far], abs=1e-6)


def test_scores_tell_a_copy_from_noise(spark):
    df = _frame(spark)
    encoder = TableEncoder("y").fit(df)
    rows = neural.neural_edges(encoder, df, ScreenerConfig(epochs=40, learning_rate=0.01, bootstraps=2, use_bundles=False))[0].groupBy("target", "source").agg(F.avg("score").alias("s")).collect()
    score = {(r["target"], r["source"]): r["s"] for r in rows}
    assert len(score) == 12 and score["y", "copy"] > 10 * score["y", "other"] >= 0
