"""Texts of any number, bins of any number of values: the same results on both sides of every limit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.operators import dictionary
from credence.plans import encoding
from credence.plans.encoding import TableEncoder, TableEncoderModel, align_dummies, entropy_bins, least_leaf, sparse_dummies


@pytest.fixture
def mixed(spark):
    rows = [(f"k{i * 37 % 23}" if i % 9 else None, "é"[: i % 2] + "zß𝄞"[i % 3], float(i % 11), "yes" if i * 7 % 5 < 2 else "no") for i in range(300)]
    return spark.createDataFrame(rows, "many string, few string, x double, label string")


def test_a_million_texts_are_numbered_in_order(spark):
    texts = spark.range(1_000_000).select(F.lit(0).alias("i"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    d = dictionary.dictionaries(texts.union(texts.limit(1000)))[0]
    assert (d.size, d.text_bytes, d.missing) == (1_000_000, 64_000_000, None) and not d.small()
    got = d.frame(spark).toPandas().sort_values("v")
    assert np.array_equal(got["code"].to_numpy(), np.arange(1_000_000))


def test_codes_are_the_same_with_a_dictionary(spark, mixed, monkeypatch):
    plain = TableEncoder("label").fit(mixed)
    want = plain.with_codes(mixed).collect()
    for limit, named in ((10, ["many"]), (0, ["many", "few", "label"])):
        monkeypatch.setattr(encoding, "MAX_CATEGORIES", limit)
        for most in (64 << 20, 0):  # broadcast and merged
            monkeypatch.setattr(dictionary, "BROADCAST_BYTES", most)
            m = TableEncoder("label").fit(mixed)
            assert [p.name for p in m.profiles if p.dictionary] == named
            assert [p.size for p in m.profiles] == [p.size for p in plain.profiles]
            got = m.with_codes(mixed)
            assert got.columns == plain.with_codes(mixed).columns and sorted(map(str, got.collect())) == sorted(map(str, want))
            assert ("BroadcastHashJoin" in got._jdf.queryExecution().toString()) == bool(most)


def test_unseen_and_missing_labels_with_a_dictionary(spark, mixed, monkeypatch):
    monkeypatch.setattr(encoding, "MAX_CATEGORIES", 0)
    m = TableEncoder("label").fit(mixed)
    new = spark.createDataFrame([("other", "z", 1.0, None)], mixed.schema)
    with pytest.raises(Exception, match="unseen category in many: other"):
        m.transform(new).collect()
    lenient = TableEncoderModel("label", m.profiles, m.types, "uniform")
    assert tuple(lenient.transform(new).first())[::3] == (None, 0)
    assert lenient.transform(new.drop("label")).first()["label"] == 0


def test_sparse_features_are_the_dense_ones(mixed, monkeypatch):
    plain = TableEncoder("label").fit(mixed)
    dense = sorted(tuple(np.float32(r["features"])) for r in plain.encoded(mixed).collect())
    for limit in (100, 10):
        monkeypatch.setattr(encoding, "MAX_CATEGORIES", limit)
        m, out = TableEncoder("label").fit(mixed), []
        for r in m.encoded_sparse(mixed).collect():
            row = np.zeros(len(dense[0]), np.float32)
            row[r["places"]] = r["numbers"]
            out.append(tuple(row))
        assert sorted(out) == dense
    with pytest.raises(ValueError, match="encoded_sparse"):
        m.encoded(mixed)


def test_sparse_dummies_are_the_dummies(mixed):
    train, test = mixed.where("x < 7"), mixed.where("x >= 5").withColumn("few", F.when(F.col("x") < 9, F.col("few")))
    a, b, labels = align_dummies(train, test, "label")
    sparse_a, sparse_b, legend = sparse_dummies(train, test, "label")
    names = [r["name"] for r in legend.orderBy("place").collect()]
    assert names == [c for c in a.columns if c != "label_code"]
    for want, got in ((a, sparse_a), (b, sparse_b)):
        rows = []
        for r in got.collect():
            row = np.zeros(len(names))
            row[r["places"]] = r["numbers"]
            rows.append((*row, r["label_code"]))
        assert sorted(rows) == sorted(tuple(r) for r in want.collect())


def test_empty_and_null_texts(spark):
    none = spark.createDataFrame([], "i int, v string")
    assert dictionary.dictionaries(none) == {}
    d = dictionary.dictionaries(spark.createDataFrame([(3, ""), (3, None), (5, "nan"), (5, "a")], "i int, v string"))
    assert {i: (x.size, x.missing) for i, x in d.items()} == {3: (1, None), 5: (2, 1)}
    train = spark.createDataFrame([(None, 1.0, "a")], "c string, x double, y string")
    got, _, legend = sparse_dummies(train, train, "y")
    assert tuple(got.first()) == ([0, 1], [1.0, 1.0], 0) and sorted(tuple(r) for r in legend.collect()) == [(0, "c_nan"), (1, "x")]


@pytest.mark.parametrize("per_cell", [7, 40, 10_000])
def test_bins_in_cells_are_those_of_the_driver(spark, monkeypatch, per_cell):
    monkeypatch.setattr(encoding, "CELL_VALUES", per_cell)
    rng = np.random.default_rng(per_cell)
    rows, want = [], {}
    for i in range(3):
        x = np.round(rng.normal(0, 30, 900), 1)
        y = np.where(rng.random(900) < 1 / (1 + np.exp(-x / (5 + 20 * i))), "a", np.where(rng.random(900) < 0.3, "b", "c"))
        values, at = np.unique(x, return_inverse=True)
        counts = np.zeros((len(values), 3))
        np.add.at(counts, (at, np.searchsorted(["a", "b", "c"], y)), 1)
        want[i] = entropy_bins(values, counts, 6, least_leaf(900, 6, 20))
        rows += [(i, float(v), c, int(n)) for v, row in zip(values, counts) for c, n in zip("abc", row) if n]
    hist = spark.createDataFrame(rows, "i int, x double, y string, n long").repartition(5)
    got = encoding.entropy_bins_in_cells(hist, 6, 20, len(rows))
    assert {i: np.round(v, 9).tolist() for i, v in got.items()} == {i: np.round(v, 9).tolist() for i, v in want.items()}


def test_wide_columns_need_no_python(spark, monkeypatch):
    hist = spark.range(500).selectExpr("0 as i", "cast(id as double) as x", "if(id % 7 < 3, 'a', 'b') as y", "1L as n")
    plan = encoding.running_counts(hist, ["a", "b"], 500)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_values_of_cells_may_come_in_many_rows(spark, monkeypatch):
    """Rows are added up by value in the operator, so callers need no shuffle of their own before it."""
    monkeypatch.setattr(encoding, "CELL_VALUES", 30)
    raw = spark.range(4000).selectExpr("0 as i", "cast(id * 37 % 200 as double) as x", "if(id * 37 % 200 < 61 or id % 11 = 0, 'a', 'b') as y", "1L as n")
    once = raw.groupBy("i", "x", "y").agg(F.sum("n").alias("n"))
    got = encoding.entropy_bins_in_cells(raw, 4, 20, 200)
    assert got == encoding.entropy_bins_in_cells(once, 4, 20, 200) and 60.5 in got[0]


def test_a_round_of_bins_has_one_pass_over_all_values(spark, monkeypatch):
    seen = []
    kind = type(spark.range(1))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: (seen.append(df._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation")), collect(df))[1])
    hist = spark.range(3000).selectExpr("0 as i", "cast(id % 500 as double) as x", "if(id % 7 < 3, 'a', 'b') as y", "1L as n")
    encoding.entropy_bins_in_cells(hist, 2, 20, 500)
    assert max(seen) == 1
