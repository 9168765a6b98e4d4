"""Information of wide tables by Gram tiles equals that of exploded pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.operators import information
from credence.operators.counts import collapse


def table(spark, columns, n=300, card=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, card, (n, columns))
    x[:, 1] = x[:, 0]
    return spark.createDataFrame(x.tolist(), ", ".join(f"`c.{i}` int" for i in range(columns)))


@pytest.mark.parametrize("given", [None, "c.2"])
def test_tiles_count_as_exploded_pairs_do(spark, monkeypatch, given):
    df = table(spark, 9).withColumn("c.5", F.when(F.col("`c.5`") > 0, F.col("`c.5`")))  # nulls in no cell
    own = collapse(df.where("`c.5` IS NOT NULL"))
    columns = [c for c in df.columns if c != given]
    want = {tuple(r[:5]): r["n"] for r in information.pair_counts(own, columns, given).collect()}
    monkeypatch.setattr(information, "EXPLODED", 5)
    for width, cells in ((1_024, 4_000_000), (9, 100), (3, 100)):  # one tile; several, in several passes; columns too wide for one
        monkeypatch.setattr(information, "TILE_WIDTH", width)
        monkeypatch.setattr(information, "TASK_CELLS", cells)
        got = {tuple(r[:5]): r["n"] for r in information.pair_counts(own, columns, given).collect()}
        assert got == pytest.approx(want)
    matrix = information.collected(information.mi_matrix(own, columns, given))
    assert matrix["c.0", "c.1"] == pytest.approx(matrix["c.1", "c.0"]) and matrix["c.0", "c.1"] > 1.2


def test_five_hundred_columns(spark):
    df = table(spark, 500, 200, 3)
    own = collapse(df)
    m = information.mi_matrix(own, df.columns)
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and len(plan) < 2_000_000
    rows = m.where("mi > 1.0").collect()
    assert sorted((r["target"], r["source"]) for r in rows) == [("c.0", "c.1"), ("c.1", "c.0")]
