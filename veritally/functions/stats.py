"""Ratios, tests and ranks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def nearest_rank(n: Column, q: float) -> Column:
    """The rank of the q-th percentile among n sorted values: ceil(q n / 100), computed to 9 digits, 1 at least."""
    if not 0 <= q <= 100:
        raise ValueError("a percentile lies in 0 .. 100")
    return F.greatest(F.lit(1), F.ceil(F.round(F.lit(float(q)) * n / 100, 9))).cast("long")


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided p of McNemar's test from the discordant counts; 1 without any. In logarithms, so thousands don't underflow."""
    n = (only_a + only_b).cast("int")
    k = F.least(only_a, only_b).cast("int")
    tail = F.aggregate(F.sequence(F.lit(0), k), F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum")), lambda a, i: F.struct(
        F.when(i == 0, -n * F.log(F.lit(2.0))).otherwise(a["log"] + F.log((n - i + 1).cast("double") / F.greatest(i, F.lit(1)))).alias("log"),
        (a["sum"] + F.exp(F.when(i == 0, -n * F.log(F.lit(2.0))).otherwise(a["log"] + F.log((n - i + 1).cast("double") / F.greatest(i, F.lit(1)))))).alias("sum"),
    ))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail["sum"]))


def verdict(low: Column, high: Column) -> Column:
    """By the interval of a difference alone."""
    return F.when(low > 0, "better").when(high < 0, "worse").otherwise("no difference shown")


def disagreement(low: Column, high: Column, p: Column) -> Column:
    """True where the interval and the exact test don't say the same at 5 %."""
    return ((low > 0) | (high < 0)) != (p < 0.05)
