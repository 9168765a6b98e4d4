"""Types of CSV columns are inferred without casts that must fail."""

from pyspark.sql import functions as F

from credence.sources import datasets


def test_only_likely_numbers_are_cast_and_none_is_missed(spark):
    texts = ["1", " 1", "1\t", "-7", "+7", "1.0", ".5", "-.5", "5.", "1e3", "0x1p3", "1d", "1f", "NaN", "nan", "-inf", "+Infinity", "INFINITY", "\x7f3", "9223372036854775808", "N", "O", "x1", "", "-", "true", "١", "1 2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", F.col("t").try_cast("bigint").alias("i"), F.col("t").try_cast("double").alias("d"), F.col("t").rlike(datasets.WHOLE).alias("whole"), F.col("t").rlike(datasets.NUMBER).alias("number")).collect()
    for r in rows:
        assert (r["i"] is None or r["whole"]) and (r["d"] is None or r["number"]), r
        assert r["t"] not in ("N", "O", "x1", "", "true") or not (r["whole"] or r["number"]), r
    assert sum(r["i"] is not None for r in rows) >= 5 and sum(r["d"] is not None for r in rows) >= 12
