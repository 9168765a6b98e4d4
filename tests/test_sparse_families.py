"""Families of more possible cells than an array could hold: counted, scored and used as the cells that occur."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.config import SearchConfig
from credence.operators import counts, gather
from credence.operators.classifiers import Aode
from credence.operators.counts import Cells, CountStore
from credence.operators.graph import Dag
from credence.operators.network import BayesNet
from credence.operators.scores import GraphScorer, bdeu, bic

NAMES = "tabc"
GRAPH = Dag(NAMES, [("t", "a"), ("a", "b"), ("t", "b"), ("b", "c"), ("t", "c"), ("a", "t")][:5])


def rows(spark, n=400, seed=2, cards=(3, 5, 4, 6)):
    rng = np.random.default_rng(seed)
    t = rng.integers(0, cards[0], n)
    a = np.where(rng.random(n) < 0.7, t, rng.integers(0, cards[1], n))
    b = (a + rng.integers(0, 2, n)) % cards[2]
    c = rng.integers(0, cards[3], n)
    return spark.createDataFrame([tuple(map(int, r)) for r in zip(t, a, b, c)], ", ".join(f"{x} int" for x in NAMES)), dict(zip(NAMES, cards))


@pytest.mark.parametrize("kind", ["bic", "bdeu"])
@pytest.mark.parametrize("local_rows", [0, 10_000])
def test_scores_of_cells_equal_those_of_arrays(spark, monkeypatch, kind, local_rows):
    df, cards = rows(spark)
    families = GRAPH.families()
    dense = [(bdeu if kind == "bdeu" else lambda c, _: bic(c))(CountStore(df, 10_000, cards).get(*f), 10.0) for f in families]
    near = GraphScorer(CountStore(df, 10_000, cards), "t", SearchConfig(score=kind))
    monkeypatch.setattr(counts, "DENSE_CELLS", 2)
    scorer = GraphScorer(CountStore(df, local_rows, cards), "t", SearchConfig(score=kind))
    assert [scorer.family(*f) for f in families] == pytest.approx(dense, rel=1e-9)
    sparse = scorer.blanket_log_likelihood(scorer.blanket_key(GRAPH))
    monkeypatch.setattr(counts, "DENSE_CELLS", 200_000)
    assert sparse == pytest.approx(near.blanket_log_likelihood(near.blanket_key(GRAPH)), rel=1e-9)


def test_a_family_of_a_thousand_million_cells(spark):
    df, _ = rows(spark, 2000)
    cards = {"t": 3, "a": 4000, "b": 5000, "c": 50_000}  # codes that training could have seen
    for cards, family in ((cards, ("c", ("a", "b"))), ({**cards, "a": 1 << 40, "b": 1 << 40}, ("c", ("a", "b", "t")))):
        far, near = CountStore(df, 0, cards), CountStore(df, 10_000, cards)
        assert math.prod(far.shape(family)) >= 10**12 and not far.dense(family)
        got = counts.family_scores(far.collapsed, [family], cards)[0]
        scorer = GraphScorer(near, "t", SearchConfig())
        assert got == pytest.approx(scorer.family(*family), rel=1e-12)
        with pytest.raises(ValueError, match="cells"):
            near.get(*family)


@pytest.mark.parametrize("how", ["literal", "batch", "joined", "cells"])
def test_posteriors_by_any_route(spark, monkeypatch, how):
    df, cards = rows(spark)
    want = {(r["t"], r["a"], r["b"], r["c"]): r["probabilities"] for r in BayesNet.fit(CountStore(df, 0, cards), GRAPH, "t").posterior(df).collect()}
    odd = spark.createDataFrame([(0, 1, None, 2), (0, 99, 1, 2), (1, 0, 0, -1)], "t int, a int, b int, c int")
    rest = [r["probabilities"] for r in BayesNet.fit(CountStore(df, 0, cards), GRAPH, "t").posterior(odd).orderBy("t", "a").collect()]
    monkeypatch.setattr("credence.operators.network.LITERAL_CELLS", 10**6 if how == "literal" else 0)
    monkeypatch.setattr(gather, "BROADCAST", 0 if how == "joined" else 10**7)
    monkeypatch.setattr(counts, "DENSE_CELLS", 0 if how == "cells" else 10**6)
    net = BayesNet.fit(CountStore(df, 0, cards), GRAPH, "t")
    assert net.is_small == (how != "cells")
    out = net.posterior(df.withColumn("extra", F.lit("x")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("MapInArrow" in plan) == (how == "batch") and ("Join" in plan) == (how in ("joined", "cells"))
    got = out.collect()
    assert out.columns == [*NAMES, "extra", "probabilities", "prediction"] and len(got) == 400
    for r in got:
        assert r["probabilities"] == pytest.approx(want[r["t"], r["a"], r["b"], r["c"]], abs=1e-9)
    for r, p in zip(net.posterior(odd).orderBy("t", "a").collect(), rest):
        assert r["probabilities"] == pytest.approx(p, abs=1e-9)
    assert net.node_probability({"t": 1, "a": 1, "b": 2, "c": 0}, "b") == pytest.approx(0.0 + _by_hand(df, 1, 1, 2, cards))


def _by_hand(df, t, a, b, cards):
    own = [r for r in df.collect() if r["t"] == t and r["a"] == a]
    return (sum(r["b"] == b for r in own) + 1) / (len(own) + cards["b"])


@pytest.mark.parametrize("how", ["batch", "cells"])
def test_averaged_one_dependence_by_any_route(spark, monkeypatch, how):
    df, cards = rows(spark)
    key = lambda r: (r["t"], r["a"], r["b"], r["c"])
    want = {key(r): r["probabilities"] for r in Aode(CountStore(df, 0, cards), "t").posterior(df).collect()}
    monkeypatch.setattr(gather, "LITERAL_CELLS", 0)
    monkeypatch.setattr(counts, "DENSE_CELLS", 0 if how == "cells" else 10**6)
    for r in Aode(CountStore(df, 0, cards), "t").posterior(df).collect():
        assert r["probabilities"] == pytest.approx(want[key(r)], abs=1e-9)


def test_a_blanket_with_five_million_cells_makes_a_short_plan(spark):
    df, _ = rows(spark)
    cards = {"t": 3, "a": 40, "b": 40, "c": 1050}
    graph = Dag(NAMES, [("t", "c"), ("a", "c"), ("b", "c")])
    store = CountStore(df, 0, cards)
    assert math.prod(store.shape(("c", ("a", "b", "t")))) > 5_000_000
    net = BayesNet.fit(store, graph, "t")
    assert isinstance(net.tables["c", ("a", "b", "t")], Cells)
    out = net.posterior(df)
    assert len(out._jdf.queryExecution().executedPlan().toString()) < 20_000 and out.count() == 400
    scorer = GraphScorer(store, "t", SearchConfig())
    near = GraphScorer(CountStore(df, 10_000, cards), "t", SearchConfig())
    scorer.prepare([graph])
    assert scorer.score(graph) == pytest.approx(near.score(graph))


def test_a_store_forgets_the_oldest_arrays(spark, monkeypatch):
    df, cards = rows(spark)
    monkeypatch.setattr(counts, "HELD_NUMBERS", 60)
    store = CountStore(df, 10_000, cards)
    first = store.get("a", ("t",)).copy()
    for f in (("b", ("a",)), ("c", ("b",)), ("b", ("t",))):
        store.get(*f)
    assert sum(c.size for c in store.counts.values()) <= 60 and ("a", ("t",)) not in store.counts
    assert np.array_equal(store.get("a", ("t",)), first)
