"""Column functions that Spark does not bring: log-gamma, bin codes, flat indices of parent configurations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Lanczos approximation with g = 7 and nine terms.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]

EPS = 1e-12


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0; small arguments by ln Gamma(x) = ln Gamma(x + 1) - ln x."""
    y = F.when(x < 0.5, x + 1).otherwise(x)
    z = y - 1
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + k)
    t = z + 7.5
    value = F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)
    return F.when(x < 0.5, value - F.log(x)).otherwise(value)


def digitize(x: Column, thresholds: list[float]) -> Column:
    """Number of thresholds that are at most x."""
    if not thresholds:
        return F.lit(0)
    return F.size(F.filter(F.lit([float(t) for t in thresholds]), lambda t: t <= x))


def flat_index(columns: list[Column], cards: list[int]) -> Column:
    """Position of a configuration in row-major order; 0 without columns."""
    out = F.lit(0)
    for c, k in zip(columns, cards):
        out = out * k + c
    return out


def stable_log(p: Column) -> Column:
    return F.log(p + F.lit(EPS))


def log_sum_exp(logs: Column) -> Column:
    top = F.array_max(logs)
    return top + F.log(F.aggregate(F.transform(logs, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v))


def arg_max(values: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def as_category(c: Column, dtype: str) -> Column:
    """Text of a categorical value; missing values are the category nan."""
    text = F.when(c, "True").otherwise("False") if dtype == "boolean" else c.cast("string")
    return F.when(c.isNull(), "nan").otherwise(text)
