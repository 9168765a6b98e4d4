"""Vector operators against brute force, and on awkward tables."""

import numpy as np

from credence.llm import ann, vector_dedup


def frame(spark, rows):
    """embeddings with clashing extra columns."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2.0, 3) for i, v in rows], "vec_id long, embedding array<float>, label int, score double, rank int")


def data(n=900, d=16, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, d))
    x = centers[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, d))
    x[100:160] = x[7] + 0.01 * rng.normal(size=(60, d))  # a large group of near copies
    x[200:230] = x[9]  # exact copies
    return x.astype(np.float32).astype(np.float64)


AWKWARD = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0, None] * 8), (5005, [1.0, 2.0]), (None, [1.0] * 16), (5006, [float("inf")] + [1.0] * 15)]


def test_nearest_recall_order_and_scores(spark):
    x = data()
    df = frame(spark, [*enumerate(x), *AWKWARD])
    rows = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    hit = 0
    for q in range(0, 900, 20):
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [(s, v) for _, s, v in mine] == sorted((s, v) for _, s, v in mine)
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        for _, s, v in mine:
            assert v != q and s == d[v]
        d[q] = np.inf
        hit += len({v for _, _, v in mine} & set(np.lexsort((np.arange(900), d))[:10].tolist()))
    assert hit >= 0.9 * 450
    assert not {5000, 5001, 5002, 5003, 5004, 5006} & {r["vec_id"] for r in rows}
    assert 5000 not in got and all(v == 5005 or q != 5005 for q in got for _, _, v in got[q])


def test_few_rows_give_all_candidates(spark):
    df = frame(spark, [(i, [i, 1.0]) for i in range(4)])
    rows = ann.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in rows] == [1, 2, 3]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_ties_go_to_smaller_ids(spark):
    df = frame(spark, [(0, [1.0, 0.0]), *((i, [2.0, 0.0]) for i in range(40, 1, -1))])
    assert [r["vec_id"] for r in ann.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()] == list(range(2, 12))


def test_probes_are_the_cheapest_sets_of_steps():
    sets = ann.perturbations(3, 1000)
    assert sets[0] == () and len(sets) == 27 == len(set(sets))  # each of three projections stays or steps either way
    m = ann.Hashing(8, 1.0, 5).with_probes(40)
    x = np.random.default_rng(4).normal(size=(6, 8))
    at, visits = m.project(x), m.visits(x)
    assert (visits[:, :, 0] == m.buckets(x)).all() and all(len(set(v)) == 40 for q in visits for v in q)
    for q in range(6):
        for t in range(ann.TABLES):
            below = at[q, t] - np.floor(at[q, t])
            cost = {}
            for k in range(3**5):
                step = np.array([k // 3**h % 3 - 1 for h in range(5)])
                number = (np.floor(at[q, t]) + step).astype(np.int64).view(np.uint64) * m.key[t]
                cost[int(number.sum().view(np.int64))] = float(np.where(step < 0, below**2, np.where(step > 0, (1 - below) ** 2, 0)).sum())
            own = [cost[int(v)] for v in visits[q, t]]  # every number is that of a neighbouring bucket
            assert np.mean(own) < np.mean(sorted(cost.values())[:80]) and own[0] == 0


def recall(rows, x):
    hit = 0
    for q, own in rows.groupby("query_id"):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:10]) & set(own["vec_id"]))
    return hit / len(rows)


def test_isotropic_vectors_compare_no_more_than_a_scan(spark):
    x = np.random.default_rng(9).normal(size=(12_000, 32)).astype(np.float32).astype(float)
    df, report = frame(spark, list(enumerate(x))), {}
    rows = ann.nearest(df, df.where("vec_id % 200 = 0"), report=report).toPandas()
    assert recall(rows, x) >= 0.95 and report["compared_share"] < 2.0 and report["searched_exactly"] == 0, (recall(rows, x), report)


def test_clustered_vectors_are_found_among_few(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(60, 24))
    x = (centers[rng.integers(0, 60, 9000)] + 0.15 * rng.normal(size=(9000, 24))).astype(np.float32).astype(float)
    df, report = frame(spark, list(enumerate(x))), {}
    rows = ann.nearest(df, df.where("vec_id % 50 = 0"), report=report).toPandas()
    assert recall(rows, x) >= 0.95 and report["compared_share"] < 0.06, (recall(rows, x), report)
    assert report["buckets_visited"] <= ann.TABLES * ann.MOST_PROBES * 180  # whatever the table's size


def test_repeated_ids_are_queries_and_candidates_of_their_own(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4))
    rows = [(100 if i < 2 else i, v) for i, v in enumerate(x)] + [(7, x[7]), (100, x[0])]  # 100: two vectors, one of them twice
    df = frame(spark, rows)
    got = ann.nearest(df, df.where("vec_id = 100"), target=1.0).toPandas()
    assert got.groupby("rank").size().tolist() == [3] * 10
    x = np.float32([v for _, v in rows]).astype(float)
    want = []
    for i in (0, 1, 31):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = sorted((d[j], rows[j][0], j) for j in range(len(rows)) if j != i)[:10]
        want += [(r + 1, v, s) for r, (s, v, _) in enumerate(order)]
    assert sorted(zip(got["rank"].tolist(), got["vec_id"].tolist(), got["score"].tolist())) == sorted(want)


def test_no_row_is_lost_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "INDEX_BLOCK", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    monkeypatch.setattr(ann, "GROUP_ROWS", 40)
    test_nearest_recall_order_and_scores(spark)


def brute(x, cosine=0.95):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= cosine
    n, label = link.sum(1) - 1, np.arange(len(x))
    while True:
        low = np.minimum(label, np.where(link, label[None], len(x)).min(1))
        if (low == label).all():
            return n, label
        label = low


def test_vector_duplicates_equal_brute_force(spark):
    x = data(seed=3)
    df = frame(spark, [*enumerate(x), *AWKWARD])
    n, label = brute(x)
    for block, split_rows in ((2048, 16_000), (40, 16_000), (40, 100)):
        got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(df, block=block, split_rows=split_rows).collect()}
        assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(900)] == list(zip(n.tolist(), label.tolist()))
    for i in (5000, 5001, 5002, 5003, 5004, 5005, 5006):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["component_id"] is None and len(got) == 908


def test_cells_are_cut_again_and_lose_no_pair(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 32))
    x[3000:5000] = x[:2000] + 0.1 * rng.normal(size=(2000, 32)) * rng.uniform(0, 2.5, (2000, 1))  # pairs around the threshold
    x[5000:5600] = x[5] + 0.02 * rng.normal(size=(600, 32))  # a crowd
    x = x.astype(np.float32).astype(float)
    df = frame(spark, list(enumerate(x)))
    n, label = brute(x)
    for exact in (False, True):
        report = {}
        got = vector_dedup.near_duplicates(df, exact=exact, split_rows=700, per_cell=300, report=report).toPandas().set_index("vec_id").loc[range(6000)]
        assert got["n_links"].tolist() == n.tolist() and got["component_id"].tolist() == label.tolist()
        assert report["cells"] > 10 and report["split"] >= 1 and report["margin"] <= report["radius"] / 2 + 1e-6


def test_many_cells_lose_no_pair():
    rng = np.random.default_rng(5)
    u = rng.normal(size=(400, 6))
    u[200:] = u[:200] + 0.12 * rng.normal(size=(200, 6))
    u /= np.linalg.norm(u, axis=1)[:, None]
    c = vector_dedup.spherical_kmeans(u, 20)
    assert vector_dedup.lost_links(u, u, c, np.sqrt(0.1) / 2 + 1e-9, 0.95)[1] == 0
    total, lost = vector_dedup.lost_links(u, u, c, 0.0, 0.95)
    assert total > 400 and lost > 0  # without guests some would be


def test_empty_and_repeated_rows(spark):
    df = frame(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])])
    rows = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(df).collect())
    assert rows == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0
