"""Vector tables: which rows take part, and bounded samples of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers (rows times dimension) that a sample for fitting may bring to the driver, and rows.
SAMPLE_NUMBERS = 2_000_000
SAMPLE_ROWS = 8_192


def takes_part(column: str = "embedding") -> Column:
    """Not null or empty, every component there and finite, not all zero."""
    v = F.col(column)
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id (not null), x (as given, or array<double> if not of float), dim."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & takes_part()).select("vec_id", F.col("embedding").alias("x"), F.size("embedding").alias("dim"))


def sample(rows: DataFrame, by: str, seed: int, most: int = SAMPLE_ROWS) -> tuple[int, int, np.ndarray]:
    """(rows in all, commonest dimension, matrix of about ``most`` of its rows, never more than twice that), by a hash of
    ``by``, a column that no two rows share."""
    dims = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return 0, 0, np.zeros((0, 0))
    dim, n = dims[0]["dim"], dims[0]["n"]
    most = max(256, min(most, SAMPLE_NUMBERS // dim))
    got = rows.where(F.col("dim") == dim)
    if n > most:
        got = got.where(F.pmod(F.xxhash64(by, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * most / n)).limit(2 * most)
    got = got.select("x").toPandas()
    x = np.stack(got["x"].to_list()).astype(np.float64) if len(got) else np.zeros((0, dim))
    return n, dim, x[np.lexsort(x.T[::-1])] if len(x) else x
