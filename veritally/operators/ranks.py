"""Exact ranks and percentiles without a single-task sort."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions.stats import nearest_rank
from veritally.storage import small, written


def with_rank(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "rank", weight: str | None = None) -> DataFrame:
    """``df`` with the 1-based rank in ``order`` within groups (or among all rows); with a ``weight`` column, with its running sum.

    Rows are range-partitioned by group, order and a hash of the row, so that a group with most rows, or one common value, is many tasks; the counts of the partitions before are
    added to the place within one.
    """
    by = by or []
    keys = [F.col(c) for c in by]
    plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    spread = [*keys, *order, F.xxhash64(*plain)]
    dealt = df.repartitionByRange(*spread).sortWithinPartitions(*spread).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranks")
    amount = F.sum(weight) if weight else F.count("*")
    sizes = dealt.groupBy("_part", *by).agg(amount.alias("_n"))
    before = Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    renamed = reduce(lambda d, c: d.withColumnRenamed(c, f"_k_{c}"), by, sizes.withColumnRenamed("_part", "_p"))
    match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by), F.col("_part") == F.col("_p"))
    within = Window.partitionBy("_part", *by).orderBy("_at")
    place = F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, 0)) if weight else F.row_number().over(within)
    ranked = dealt.withColumn("_place", place).join(small(renamed), match)
    return ranked.withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).select(*df.columns, name)


def percentiles(df: DataFrame, value: str, by: list[str], qs: list[float]) -> DataFrame:
    """One row per group with the nearest-rank percentiles p<q> of the non-null values. Equal values are counted before they are ranked."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_count"))
    ranked = with_rank(counted, [F.col(value)], by, "_upto", "_count")
    totals = counted.groupBy(*by).agg(F.sum("_count").alias("_total"))
    joined = ranked.join(small(totals), by)
    at = lambda q: F.min(F.when(F.col("_upto") >= nearest_rank(F.col("_total"), q), F.col(value))).alias(f"p{q:g}")
    return joined.groupBy(*by).agg(*map(at, qs))
