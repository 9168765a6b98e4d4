"""All edges that may be pruned are judged in one pass, as each would be on its own."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.config import SearchConfig
from credence.operators import counts
from credence.operators.counts import CountStore, collapse
from credence.operators.graph import Dag
from credence.operators.search import HillClimb

NAMES = ["t", "a", "b", "c", "d"]
EDGES = [("t", "a"), ("t", "b"), ("a", "b"), ("c", "d"), ("d", "t"), ("t", "c")]


def table(spark, classes, n=500, seed=1):
    rng = np.random.default_rng(seed)
    t = rng.integers(0, classes, n)
    rows = [t, (t + (rng.random(n) < 0.4)) % 3, rng.integers(0, 3, n), np.where(rng.random(n) < 0.5, t, 0), rng.integers(0, 2, n)]
    return spark.createDataFrame([tuple(map(int, r)) for r in zip(*rows)], ", ".join(f"{x} int" for x in NAMES)), {"t": classes, "a": 3, "b": 3, "c": classes, "d": 2}


@pytest.mark.parametrize(("classes", "dense"), [(2, 200_000), (3, 200_000), (3, 8)])
def test_each_edge_is_judged_as_on_its_own(spark, monkeypatch, classes, dense):
    monkeypatch.setattr(counts, "DENSE_CELLS", dense)
    df, cards = table(spark, classes)
    train, valid = df.where(F.hash(*NAMES) % 3 != 0), df.where(F.hash(*NAMES) % 3 == 0)
    g = Dag(NAMES, EDGES)
    held = collapse(valid).persist()
    rows = held.toPandas()
    for near in (False, True):
        climb = HillClimb(CountStore(train, 10_000 if near else 0, cards), "t", SearchConfig(), {n: [] for n in NAMES})
        net = climb.fit_net(g)
        if near:
            climb.checked = {x: rows[x].to_numpy(np.int64) for x in NAMES}, rows["w"].to_numpy(float)
        nets, losses, areas = climb.without_each(g, net, held, EDGES)
        area = areas(EDGES)
        climb.checked = None
        for e in EDGES:
            x = g.minus(*e)
            alone = climb.validate(x, climb.fit_net(x), held, climb.scorer.score(x), 0, "alone")
            assert losses[e] == pytest.approx(alone["log_loss"], abs=1e-9) and area[e] == pytest.approx(alone["roc_auc"], abs=1e-6)
            assert nets[e].graph.edges() == x.edges()


def test_a_ranking_takes_few_jobs_however_many_edges(spark):
    df, cards = table(spark, 2)
    g, held = Dag(NAMES, EDGES), collapse(df).persist()
    held.count()
    sc, jobs = spark.sparkContext, []
    for edges in (EDGES[:2], EDGES):
        climb = HillClimb(CountStore(df, 0, cards), "t", SearchConfig(), {n: [] for n in NAMES})
        net = climb.fit_net(g)
        sc.setJobGroup(f"rank{len(edges)}", "")
        _, losses, areas = climb.without_each(g, net, held, edges)
        areas(edges)
        sc.setJobGroup("other", "")
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"rank{len(edges)}")))
    assert max(jobs) <= 16, jobs  # adaptive plans run a job a stage


def test_far_and_near_prune_alike(spark):
    df, cards = table(spark, 3, 900, 4)
    train, valid = df.where(F.hash(*NAMES) % 3 != 0), df.where(F.hash(*NAMES) % 3 == 0)
    config = SearchConfig(max_iters=0, warm_start="naive_bayes", prune_min_edges_real=1, prune_max_fraction_real=0.9, prune_log_loss_tol_real=0.01, prune_auc_tol_real=0.05, hub_penalty_weight=1.0)
    out = []
    for rows in (10_000, 0):
        climb = HillClimb(CountStore(train, rows, cards), "t", replace(config, local_rows=rows), {n: ["t"] for n in NAMES if n != "t"} | {"t": []}, {}, "real")
        r = climb.fit(valid)
        out.append((r.graph.edges(), r.pruned, round(r.validation["log_loss"], 9)))
    assert out[0] == out[1] and out[0][1]
