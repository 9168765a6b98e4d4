"""Bins of columns with many distinct values are those of the whole histogram."""

import numpy as np
import pandas as pd

from credence.plans.encoding import TableEncoder, supervised_bins


def test_many_values_give_the_thresholds_of_all_values(spark):
    rng = np.random.default_rng(2)
    x = rng.permutation(30_000) / 7
    pdf = pd.DataFrame({"kind": np.where(x < 1000.3, "a", np.where(x < 3000.1, "b", "c")), "x1": x, "x2": rng.normal(size=30_000), "x3": np.arange(30_000) % 4 * 1.0})
    pdf.loc[rng.random(30_000) < 0.1, "kind"] = "b"
    model = TableEncoder("kind").fit(spark.createDataFrame(pdf))
    for c in ("x1", "x2", "x3"):
        h = pdf.pivot_table(index=c, columns="kind", aggfunc="size", fill_value=0).sort_index()
        assert model.profile(c).thresholds == supervised_bins(h.index.to_numpy(float), h.to_numpy(float), 5, 20), c


def test_medians_are_exact_beyond_many_values(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from credence.plans import encoding

    monkeypatch.setattr(encoding, "MAX_VALUES", 200)
    df = spark.range(20_001).select(F.when(F.col("id") % 11 > 0, F.sin("id") * 1000).alias("a"), (F.col("id") % 5).alias("b"), F.when(F.col("id") < 9000, 3.0).otherwise(F.col("id")).alias("c"), F.lit(None).cast("double").alias("d"))
    pdf = df.toPandas()
    want = [float(np.nanmedian(pdf[c])) for c in "abc"] + [None]
    assert encoding.medians(df, [F.col(c) for c in "abcd"]) == want
