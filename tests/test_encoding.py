import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from credence.plans.encoding import TableEncoder, TableEncoderModel, align_dummies, entropy_bins, midpoints, sanitize_names, supervised_bins


def test_missing_values_become_a_category_and_the_mean(spark):
    df = spark.createDataFrame([("a", 1.0, "y"), (None, None, "n"), ("b", 3.0, "y"), ("a", 5.0, "n")], "c string, x double, t string")
    m = TableEncoder("t").fit(df)
    assert m.profile("c").categories == ["a", "b", "nan"]
    assert m.profile("x").median == 3.0 and m.profile("x").mean == 3.0
    rows = m.transform(df).collect()
    assert [r["c"] for r in rows] == [0, 2, 1, 0]
    assert m.profile("x").thresholds == [2.0, 4.0] and [r["x"] for r in rows] == [0, 1, 1, 2]


def test_numeric_target_is_categorical_and_booleans_are_texts(spark):
    df = spark.createDataFrame([(1, True), (0, False), (1, None)], "t int, b boolean")
    m = TableEncoder("t").fit(df)
    assert m.profile("t").kind == "categorical" and m.profile("t").categories == ["0", "1"]
    assert m.profile("b").categories == ["False", "True", "nan"]


def test_unseen_category(spark):
    m = TableEncoder("t").fit(spark.createDataFrame([("a", "x"), ("b", "y")], "c string, t string"))
    new = spark.createDataFrame([("z",)], "c string")
    with pytest.raises(Exception, match="unseen category"):
        m.transform(new).collect()
    lenient = TableEncoderModel("t", m.profiles, m.types, "uniform")
    assert lenient.transform(new).first()["c"] is None and lenient.transform(new).first()["t"] == 0


@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(0, 2)), min_size=1, max_size=80), st.integers(2, 6), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_bins_respect_leaf_sizes_and_number(pairs, n_bins, min_leaf):
    x, y = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs])
    values = np.unique(x)
    counts = np.array([[((x == v) & (y == k)).sum() for k in range(3)] for v in values], float)
    cuts = entropy_bins(values, counts, n_bins, min_leaf)
    assert cuts == sorted(cuts) and len(cuts) < n_bins
    sizes = np.bincount(np.digitize(x, cuts), minlength=len(cuts) + 1)
    assert not cuts or sizes.min() >= min_leaf


def test_first_split_is_the_best_one():
    values, counts = np.arange(6.0), np.array([[9, 1], [8, 2], [9, 1], [1, 9], [2, 8], [1, 9]], float)
    assert entropy_bins(values, counts, 2, 1) == [2.5]


def test_low_thresholds_are_kept_unless_asked():
    values, counts = np.array([-5.0, -3.0, 1.0, 2.0]), np.array([[9, 0], [0, 9], [9, 0], [0, 9]], float)
    assert entropy_bins(values, counts, 4, 1)[0] == -4.0
    assert all(t > -2 for t in entropy_bins(values, counts, 4, 1, compat_drop_low=True))


def test_few_values_give_midpoints():
    assert midpoints(np.array([0.0, 1.0, 3.0])) == [0.5, 2.0]
    assert supervised_bins(np.array([4.0]), np.ones((1, 2)), 5, 20) == []


def test_dummies_are_aligned_over_both_tables(spark):
    train = spark.createDataFrame([("red", 1.0, "a"), ("[blue]", 2.0, "b"), (None, 3.0, "a")], "color string, value double, label string")
    test = spark.createDataFrame([("<green>", 4.0, "b"), ("red", None, "c")], "color string, value double, label string")
    a, b, labels = align_dummies(train, test, "label")
    assert a.columns == b.columns == ["color__green>", "color__blue_", "color_red", "color_nan", "value", "label_code"]
    assert labels == ["a", "b", "c"] and [r["color_red"] for r in b.collect()] == [0.0, 1.0]
    assert [r["color_nan"] for r in a.collect()] == [0.0, 0.0, 1.0]


def test_names():
    assert sanitize_names(["a[1]", "a<1]", "", "x", "x"]) == ["a_1_", "a_1___1", "feature_2", "x", "x__1"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "c string, x double, t string")
    m = TableEncoder("t").fit(df)
    assert m.profile("x").thresholds == [] and m.transform(df).count() == 0


def test_features_are_one_hot_where_codes_have_the_same_names(spark):
    df = spark.createDataFrame([("a", "p", 1.0), ("b", "q", 3.0), ("a", None, None)], "y string, c string, x double")
    rows = [(r["y"], r["c"], list(r["features"])) for r in TableEncoder("y").fit(df).encoded(df).collect()]
    assert [(y, c, f[:4]) for y, c, f in rows] == [(0, 1, [1, 0, 0, 1]), (1, 2, [0, 1, 0, 0]), (0, 0, [1, 0, 1, 0])]
    assert rows[0][2][5] == -rows[1][2][5] != 0 and rows[2][2][5] == 0
