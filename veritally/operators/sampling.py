"""Stratified nested subsets, seeded samples, hashes of id sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions.text import order_hash
from veritally.operators.ranks import with_rank
from veritally.storage import small, written

# Fixed values.
SEED, FLOOR = 20261001, 5


def allocate(sizes: DataFrame, total: int, floor: Column) -> DataFrame:
    """(stratum, n) with ``picks`` added: ``total`` in all, in proportion to n, within the bounds min(floor, n) and n.

    A stratum's share is total * n / (all n), its whole part moved into the bounds. What is then missing from ``total`` (or too much) is a number of units, each one pick more (or less) of
    some stratum; a stratum's j-th unit is worth its share less the picks before it (or the other way round), and the units of highest worth are the ones that are made,
    by name among equals (or from the last name). Strata are a dimension table, and one window ranks the units.
    """
    least = F.least(floor, F.col("n"))
    low, everything = sizes.agg(F.sum(least), F.sum("n")).first()
    if not (low or 0) <= total <= (everything or 0):
        raise ValueError(f"{total} can't be picked from {everything or 0} with at least {low or 0}")
    based = sizes.withColumn("_share", total * F.col("n") / F.lit(float(everything or 1)))
    based = based.withColumn("_base", F.least("n", F.greatest(least, F.floor("_share"))))
    gap = total - (based.agg(F.sum("_base")).first()[0] or 0)
    room = F.least(F.lit(abs(gap)), F.col("n") - F.col("_base") if gap > 0 else F.col("_base") - least)
    step = 1 if gap > 0 else -1
    unit = based.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), room))) if gap else based.withColumn("_j", F.lit(0).cast("long"))
    unit = unit.where((F.col("_j") >= 1) & (F.col("_j") <= room))
    worth = (F.col("_share") - F.col("_base") - step * (F.col("_j") - 1)) * step
    order = Window.orderBy(worth.desc(), F.col("stratum").asc() if gap > 0 else F.col("stratum").desc(), "_j")
    made = unit.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= abs(gap)).groupBy("stratum").agg(F.count("*").alias("_made"))
    return based.join(made, "stratum", "left").select("stratum", "n", (F.col("_base") + step * F.coalesce("_made", F.lit(0))).cast("long").alias("picks"))


def nested_plan(sizes: DataFrame, plan: list[tuple[str, int]]) -> DataFrame:
    """(subset, stratum, picks) for each subset (name, size), from large to small; a child is allocated over its parent's picks, so children are prefixes.

    Each stratum of (stratum string, n long) gets `FLOOR` picks where that fits, else as many as all strata can have alike.
    """
    strata = sizes.count()
    out = sizes.sparkSession.createDataFrame([], "subset string, stratum string, picks long")
    for name, size in plan:
        sizes = written(allocate(sizes, size, F.lit(min(FLOOR, size // strata) if strata else 0)).select("stratum", F.col("picks").alias("n")), "allocation")
        out = out.union(sizes.select(F.lit(name), "stratum", "n"))
    return out


def shuffled(df: DataFrame, stratum: str, id_: str, seed: int = SEED) -> DataFrame:
    """``df`` with ``place``: the row's place in its stratum's seeded order."""
    order = Window.partitionBy(stratum).orderBy(order_hash(F.lit(seed), F.col(stratum), F.col(id_)), F.col(id_))
    return df.withColumn("place", F.row_number().over(order).cast("long"))


def nested_subsets(df: DataFrame, stratum: str, id_: str, picks: DataFrame, seed: int = SEED) -> DataFrame:
    """(subset, stratum, id): each subset of ``picks`` (subset, stratum, picks) is a prefix of every stratum's seeded order."""
    placed = shuffled(df.select(stratum, id_), stratum, id_, seed)
    most = picks.agg(F.max("picks")).first()[0] or 0
    return placed.where(F.col("place") <= most).join(small(picks.withColumnRenamed("stratum", stratum)), stratum).where("place <= picks").select("subset", stratum, id_)


def sample_per_stratum(df: DataFrame, strata: list[str], id_: str, n: int, seed: int = SEED) -> DataFrame:
    """All rows of a stratum if it has at most n, else n by a seeded order of its own. The rank filter is pushed below the shuffle by Spark's group limit."""
    order = Window.partitionBy(*strata).orderBy(order_hash(F.lit(seed), *map(F.col, strata), F.col(id_)), F.col(id_))
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def id_set_hash(ids: Column) -> Column:
    """Aggregate: SHA-256 of the sorted ids, one a line. The ids of a subset (hundreds to thousands) are gathered."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(ids.cast("string"))), "\n"), 256)


def cycle(items: DataFrame, order: Column, requests: int, name: str = "request") -> DataFrame:
    """Requests 0 .. requests - 1, each with the item at its number modulo the number of items, in seeded order; ranks are made over range partitions."""
    placed = with_rank(items.withColumn("_order", order), [F.col("_order")], name="_place").drop("_order").withColumn("_place", F.col("_place") - 1)
    n = items.count()
    asked = items.sparkSession.range(requests).select(F.col("id").alias(name), F.pmod("id", F.lit(n)).alias("_place"))
    return asked.join(placed.where(F.col("_place") < requests), "_place").drop("_place")
