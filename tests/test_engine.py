import math
import random
from itertools import combinations, product

import numpy as np
import pytest

from credence.config import Ablation, PipelineConfig, ScreenerConfig, SearchConfig, ablations
from credence.operators import metrics, screening
from credence.operators.classifiers import Aode, kdb_graph, naive_bayes_graph, tan_graph
from credence.operators.counts import CountStore, collapse, complete_counts
from credence.operators.graph import Dag, maximum_spanning_tree, orient_from
from credence.operators.information import collected, mi_matrix
from credence.operators.neural import MultiHead
from credence.operators.network import BayesNet
from credence.operators.scores import GraphScorer, bdeu, bic, family_bdeu, family_bic
from credence.operators.search import HillClimb, better


def rows(n=300, seed=1):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        t = r.randrange(2)
        a = t if r.random() < 0.8 else 1 - t
        b = (a + r.randrange(2)) % 3
        out.append((t, a, b, r.randrange(3)))
    return out


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame(rows(), "t int, a int, b int, c int").persist()


def brute_counts(family, cards):
    node, parents = family
    cols = ["t", "a", "b", "c"]
    shape = [cards[p] for p in parents] + [cards[node]]
    out = np.zeros(shape)
    for r in rows():
        v = dict(zip(cols, r))
        out[tuple(v[p] for p in parents) + (v[node],)] += 1
    return out.reshape(-1, cards[node])


def test_counts_local_and_distributed_agree_with_a_loop(codes):
    families = [("t", ()), ("a", ("t",)), ("c", ("a", "b")), ("b", ("a", "c", "t"))]
    local, far = CountStore(codes), CountStore(codes, local_rows=0)
    assert local.local is not None and far.local is None
    for f in families:
        want = brute_counts(f, local.cards)
        assert np.array_equal(local.get(*f), want) and np.array_equal(far.get(*f), want)


def test_scores_agree_between_driver_and_frame(codes):
    store = CountStore(codes)
    families = [("t", ()), ("a", ("t",)), ("c", ("a", "b"))]
    full = complete_counts(collapse(codes), families, store.cards)
    by_bic = {r["f"]: r["bic"] for r in family_bic(full).collect()}
    by_bdeu = {r["f"]: r["bdeu"] for r in family_bdeu(full, 10.0).collect()}
    for i, f in enumerate(families):
        assert by_bic[i] == pytest.approx(bic(store.get(*f)), rel=1e-9)
        assert by_bdeu[i] == pytest.approx(bdeu(store.get(*f), 10.0), rel=1e-9)


def test_information_by_brute_force(codes):
    m = collected(mi_matrix(collapse(codes), ["t", "a", "b", "c"]))
    for x, y in combinations("tabc", 2):
        i, j = "tabc".index(x), "tabc".index(y)
        n = len(rows())
        px, py, pxy = {}, {}, {}
        for r in rows():
            px[r[i]] = px.get(r[i], 0) + 1 / n
            py[r[j]] = py.get(r[j], 0) + 1 / n
            pxy[r[i], r[j]] = pxy.get((r[i], r[j]), 0) + 1 / n
        want = sum(p * math.log(p / (px[u] * py[v])) for (u, v), p in pxy.items())
        assert m[x, y] == pytest.approx(want, abs=1e-9) == m[y, x]


def joint(net, values):
    return math.prod(net.node_probability(values, n) for n in net.graph.nodes)


def test_posterior_is_the_normalised_joint(codes):
    store = CountStore(codes)
    g = Dag("tabc", [("t", "a"), ("a", "b"), ("t", "b"), ("c", "t")])
    net = BayesNet.fit(store, g, "t")
    for r in net.posterior(codes.distinct()).collect():
        v = {c: r[c] for c in "tabc"}
        w = [joint(net, v | {"t": k}) for k in (0, 1)]
        assert r["probabilities"] == pytest.approx([x / sum(w) for x in w], abs=1e-6)


def test_joined_posterior_equals_literal_one(codes, monkeypatch):
    net = BayesNet.fit(CountStore(codes), Dag("tabc", [("t", "a"), ("a", "b"), ("t", "b"), ("c", "t")]), "t")
    literal = {tuple(r[c] for c in "tabc"): r["probabilities"] for r in net.posterior(codes.distinct()).collect()}
    monkeypatch.setattr("credence.operators.network.LITERAL_CELLS", 3)
    for r in net.posterior(codes.distinct()).collect():
        assert r["probabilities"] == pytest.approx(literal[tuple(r[c] for c in "tabc")], abs=1e-9)


def test_blanket_likelihood_equals_the_networks_and_both_paths_agree(codes):
    g = Dag("tabc", [("t", "a"), ("a", "b"), ("t", "b"), ("c", "t")])
    near, far = (GraphScorer(CountStore(codes, n), "t", SearchConfig()) for n in (10**6, 0))
    value = near.blanket_log_likelihood(near.blanket_key(g))
    scored = BayesNet.fit(near.store, g, "t").posterior(codes).collect()
    assert value == pytest.approx(sum(math.log(r["probabilities"][r["t"]]) for r in scored), abs=1e-6)
    assert far.blanket_log_likelihood(far.blanket_key(g)) == pytest.approx(value, abs=1e-6)


def test_normalised_score_does_not_change_when_rows_repeat(spark):
    few = spark.createDataFrame(rows(60), "t int, a int, b int, c int")
    g = Dag("tabc", [("t", "a")])
    c = SearchConfig(discriminative_weight=1.0, edge_prior_weight=0.0)
    one = GraphScorer(CountStore(few), "t", c).score(g)["discriminative"]
    two = GraphScorer(CountStore(few.union(few)), "t", c).score(g)["discriminative"]
    assert one == pytest.approx(two, abs=0.02)


def test_aode_by_brute_force(codes):
    model = Aode(CountStore(codes), "t")
    data = rows()
    cards = [2, 2, 3, 3]
    for r in model.posterior(codes.distinct()).limit(12).collect():
        x = [r[c] for c in "tabc"]
        total = np.zeros(2)
        for p in (1, 2, 3):
            logs = []
            for y in (0, 1):
                njoint = sum(d[0] == y and d[p] == x[p] for d in data)
                s = math.log((njoint + 1) / (len(data) + 2 * cards[p]) + 1e-12)
                for c in (1, 2, 3):
                    if c != p:
                        n = sum(d[0] == y and d[p] == x[p] and d[c] == x[c] for d in data)
                        s += math.log((n + 1) / (njoint + cards[c]) + 1e-12)
                logs.append(s)
            total += np.exp(np.array(logs) - max(logs))
        assert r["probabilities"] == pytest.approx((total / total.sum()).tolist(), abs=1e-9)


def test_fixed_shapes(codes):
    store = CountStore(codes)
    assert naive_bayes_graph(list("tabc"), "t").edges() == [("t", "a"), ("t", "b"), ("t", "c")]
    tan = tan_graph(store, "t")
    assert len(tan) == 5 and tan.acyclic() and tan.in_degree("a") == 1
    kdb = kdb_graph(store, "t", 2)
    assert len(kdb) == 6 and kdb.acyclic()
    assert orient_from(list("abc"), maximum_spanning_tree(list("abc"), {("a", "b"): 1.0, ("a", "c"): 3.0, ("b", "c"): 2.0})) == [("a", "c"), ("c", "b")]


def test_unknown_codes_are_taken_as_uniform(spark, codes):
    net = BayesNet.fit(CountStore(codes), naive_bayes_graph(list("tabc"), "t"), "t")
    new = spark.createDataFrame([(0, None, 99, 1)], "t int, a int, b int, c int")
    p = net.posterior(new).first()["probabilities"]
    assert sum(p) == pytest.approx(1.0) and all(0 < x < 1 for x in p)


# --- pools -----------------------------------------------------------------------------------------------------------------


def pools(spark, edges, bundles, columns, **kw):
    e = spark.createDataFrame(edges, screening.EDGES)
    b = spark.createDataFrame(bundles, screening.BUNDLES).withColumn("rank", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)) if bundles else None
    s = screening.assemble(e, b, columns, ScreenerConfig(**kw))
    return s.pools


def test_bundle_sources_change_the_order(spark):
    edges = [("t", "a", 0.5, 1.0), ("t", "b", 0.3, 1.0), ("t", "c", 0.2, 0.1)]
    got = pools(spark, edges, [("t", "b", "c", 1.0, 1.0)], ["t", "a", "b", "c"], pool_size=1, pool_soft_cap=3, pool_score_ratio=0.9)
    assert got["t"] == ["b", "c"]


def test_soft_cap_can_cut_a_forced_source(spark):
    edges = [("t", "a", 0.9, 1.0), ("t", "b", 0.8, 1.0)]
    assert pools(spark, edges, [("t", "c", "d", 0.1, 1.0)], list("tabcd"), pool_size=2, pool_soft_cap=3)["t"] == ["a", "b", "c"]


def test_ratio_widens_the_pool_and_unstable_edges_stay_out(spark):
    edges = [("t", "a", 1.0, 1.0), ("t", "b", 0.9, 1.0), ("t", "c", 0.7, 1.0), ("t", "d", 0.95, 0.2)]
    assert pools(spark, edges, [], list("tabcd"), pool_size=1, pool_soft_cap=9)["t"] == ["a", "b"]


# --- search ----------------------------------------------------------------------------------------------------------------


def test_search_finds_an_acyclic_graph_and_improves(codes):
    store = CountStore(codes)
    r = HillClimb(store, "t", SearchConfig(), screening.full_pools(store.columns)).fit()
    assert r.graph.acyclic() and all(b > a for a, b in zip(r.history, r.history[1:]))
    assert any({"t", "a"} == set(e) for e in r.graph.edges())


def test_distributed_and_local_search_agree(codes):
    config = SearchConfig(max_iters=3)
    results = [HillClimb(CountStore(codes, n), "t", config, screening.full_pools(list("tabc"))).fit() for n in (10**6, 0)]
    assert results[0].operations == results[1].operations


def test_additions_are_cut_before_the_look_at_cycles(codes):
    h = HillClimb(CountStore(codes), "t", SearchConfig(max_additions_per_child=2), {"t": ["a", "b", "c"]}, {("t", "c"): 0.9})
    assert h.additions(Dag("tabc"), "t") == ["c", "a"]


def test_sparse_start_is_acyclic_with_one_parent(codes):
    support = {(c, p): 0.5 + 0.1 * i for i, (c, p) in enumerate(product("tabc", "tabc")) if c != p}
    g = HillClimb(CountStore(codes), "t", SearchConfig(), screening.full_pools(list("tabc")), support).initial("screener_sparse")
    assert g.acyclic() and max(g.in_degree(n) for n in g.nodes) <= 1 and len(g)


def test_order_of_results():
    a = {"log_loss": 0.5, "roc_auc": 0.8, "objective": 1.0, "edges": 3}
    assert better(a | {"log_loss": 0.4}, a) and not better(a | {"log_loss": 0.6, "roc_auc": 1.0}, a)
    assert better(a | {"roc_auc": 0.9}, a) and better(a | {"objective": 2.0}, a) and better(a | {"edges": 2}, a) and not better(a, a)
    assert better(a, None)


def test_prune_limits_and_order(codes):
    h = HillClimb(CountStore(codes), "t", SearchConfig(), {}, {("a", "t"): 0.9, ("b", "a"): 0.1}, "real")
    assert h.prune_limits(12) == {"profile": "real", "passes": 1, "log_loss_tol": 0.001, "auc_tol": 0.0005, "min_edges": 8, "most": 5}
    order = h.prune_order(Dag("tabc", [("t", "a"), ("a", "b"), ("c", "b")]))
    assert order[0] == ("c", "b") and ("t", "a") not in order
    limits = h.prune_limits(12)
    old = {"log_loss": 0.5, "roc_auc": 0.8, "objective": 1.0}
    assert h.accepts(old | {"log_loss": 0.49}, old, limits, True) and not h.accepts(old | {"objective": 2.0}, old, limits, True) and h.accepts(old | {"objective": 2.0}, old, limits, False)
    assert h.strict_edge("t", "a") and not h.strict_edge("a", "b")


def test_driver_validation_equals_spark(codes):
    store = CountStore(codes)
    net = BayesNet.fit(store, Dag("tabc", [("t", "a"), ("a", "b"), ("t", "b"), ("c", "t")]), "t")
    far = metrics.predictive(net.posterior(store.collapsed), 2, "t", w="w")
    near = metrics.predictive_local(store.local["t"], net.posterior_local(store.local), store.weight)
    assert near["log_loss"] == pytest.approx(far["log_loss"], abs=1e-9) and near["roc_auc"] == pytest.approx(far["roc_auc"], abs=1e-9)
    slow, fast = (HillClimb(store, "t", SearchConfig(max_iters=4, prune_min_edges_real=1, local_rows=n), screening.full_pools(list("tabc")), {}, "real").fit(codes) for n in (0, 1000))
    assert slow.operations == fast.operations and slow.pruned == fast.pruned


def test_validation_and_pruning_run(codes):
    store = CountStore(codes)
    h = HillClimb(store, "t", SearchConfig(max_iters=6, prune_min_edges_real=1, checkpoint_interval=2), screening.full_pools(list("tabc")), {}, "real")
    r = h.fit(codes)
    assert r.graph.acyclic() and r.validation["log_loss"] > 0 and len(r.starts) == 2 and r.validation_history[0]["reason"] == "initial"


# --- neural ----------------------------------------------------------------------------------------------------------------


def net_and_data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 5))
    x[:, :2] = np.eye(2)[rng.integers(0, 2, 20)]
    net = MultiHead([slice(0, 2), slice(2, 3), slice(3, 5)], [2, 0, 2], 7, 2, 0.0, 3)
    return net, x, [x[:, 0].astype(int), x[:, 2], rng.integers(0, 2, 20)]


def test_gradients_by_finite_differences():
    net, x, ys = net_and_data()
    _, g = net.gradients(x, ys, train=False)
    for k in net.p:
        at = tuple(0 for _ in net.p[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-6
        up = net.gradients(x, ys, train=False)[0]
        net.p[k][at] = old - 1e-6
        down = net.gradients(x, ys, train=False)[0]
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_batched_masks_equal_a_loop():
    net, x, ys = net_and_data()
    variants = [(), (0,), (1,), (0, 1)]
    got = net.masked_losses(x, ys[2], 2, variants, 3)
    for v, value in zip(variants, got):
        m = net.keep_mask(2)
        for s in v:
            m[net.blocks[s]] = 0
        assert value == pytest.approx(net.loss(x * m, ys[2], 2))


# --- metrics ---------------------------------------------------------------------------------------------------------------


def frame(spark, y, p):
    return spark.createDataFrame([(a, list(map(float, b))) for a, b in zip(y, p)], "y int, probabilities array<double>")


def test_ece_is_zero_when_perfect(spark):
    assert metrics.ece(frame(spark, [0, 1, 1], [[1, 0], [0, 1], [0, 1]])).first()[0] == 0


def test_auc_without_a_class_is_a_half(spark):
    assert metrics.auc(frame(spark, [1, 1], [[0.2, 0.8], [0.1, 0.9]]), 2).first()[0] == 0.5
    assert metrics.auc(frame(spark, [0, 1], [[0.6, 0.2, 0.2], [0.1, 0.8, 0.1]]), 3).first()[0] == 0.5


def test_auc_and_brier_by_brute_force(spark):
    rng = random.Random(4)
    y = [rng.randrange(2) for _ in range(60)]
    s = [round(rng.random(), 1) for _ in y]
    got = metrics.predictive(frame(spark, y, [[1 - v, v] for v in s]), 2)
    pairs = [(a, b) for a, ya in zip(s, y) if ya for b, yb in zip(s, y) if not yb]
    assert got["roc_auc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))
    assert got["brier"] == pytest.approx(sum((v - t) ** 2 for v, t in zip(s, y)) / 60)


def test_structure_metrics():
    p, t = [("a", "b"), ("b", "c")], [("a", "b"), ("c", "b")]
    assert metrics.shd(p, t) == 1 and metrics.shd([("a", "b")], []) == 0 and metrics.shd_textbook([("a", "b")], []) == 1
    assert metrics.edge_prf(p, t) == (0.5, 0.5, 0.5) and metrics.edge_prf([], t) == (0.0, 0.0, 0.0)
    assert metrics.pool_reduction({"a": ["b"], "b": [], "c": []}) == pytest.approx(1 - 1 / 6)
    assert metrics.parent_recall({"b": ["a"]}, t) == 0.5


# --- ablations -------------------------------------------------------------------------------------------------------------


def test_fast_ablations_act_on_known_graphs_only():
    a = ablations()["known_graph_fast"]
    base = PipelineConfig("t")
    assert a.apply(base, "real").screener.epochs == 25
    fast = a.apply(base, "known_graph", 21)
    assert fast.screener.pool_size == 3 and fast.search.max_iters == 20 and fast.search.prune_passes == 0
    assert a.apply(base, "known_graph", 20).search.max_iters == 12
    assert len(ablations()) == 17 and isinstance(a, Ablation)
