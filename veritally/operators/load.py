"""Load levels: summaries, operating point, cost by load, break-even against capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.functions import cost
from veritally.operators.ranks import percentiles, with_rank
from veritally.storage import small

P95_LIMIT_S = 1.0


def levels(log: DataFrame, wall_s: float) -> DataFrame:
    """Per concurrency: ok, errors, error rate, throughput over the wall time, latency mean, max and exact percentiles (null when nothing was answered)."""
    ok = ~F.col("failed")
    agg = log.groupBy("concurrency").agg(
        F.count("*").alias("requests"), F.count_if(ok).alias("ok"), F.count_if(F.col("failed")).alias("errors"), (F.count_if(ok) / wall_s).alias("requests_per_s"), (F.coalesce(F.sum(F.when(ok, F.col("tokens"))), F.lit(0)) / wall_s).alias("tokens_per_s"),
        F.avg(F.when(ok, F.col("latency_s"))).alias("mean_s"), F.max(F.when(ok, F.col("latency_s"))).alias("max_s"),
    )
    ranks = percentiles(log.where(ok), "latency_s", ["concurrency"], [50, 95, 99])
    out = agg.withColumn("error_rate", F.col("errors") / F.col("requests")).join(ranks, "concurrency", "left")
    return out.withColumn("meets_limit", F.coalesce((F.col("p95") <= P95_LIMIT_S) & (F.col("errors") == 0), F.lit(False)))


def operating_point(levels_: DataFrame, limit_s: float = P95_LIMIT_S, max_errors: float = 0.0) -> DataFrame:
    """The highest concurrency within both limits (inclusive); null if there is none."""
    fits = F.when((F.col("error_rate") <= max_errors) & (F.col("p95") <= limit_s), F.col("concurrency"))
    return levels_.agg(F.max(fits).alias("concurrency"))


def operating_note(levels_: DataFrame) -> DataFrame:
    """Why there is or isn't an operating point: a level fits, all levels are too slow, or the fast ones had errors."""
    fits, fast = F.bool_or(F.col("meets_limit")), F.bool_or(F.coalesce(F.col("p95") <= P95_LIMIT_S, F.lit(False)))
    return levels_.agg(F.when(fits, "a level meets the limit").when(fast, "levels within the limit had errors").otherwise("no level is within the limit").alias("note"))


def cost_by_load(levels_: DataFrame, rentals: DataFrame) -> DataFrame:
    """Levels by price bases (both few): cost per thousand calls (null without throughput) and calls a month."""
    return levels_.crossJoin(small(rentals)).select("concurrency", "basis", cost.hosted_per_thousand(F.col("usd_per_hour"), F.col("requests_per_s")).alias("usd_per_1k"), cost.monthly_capacity(F.col("requests_per_s")).alias("capacity"), "p95")


def break_even(levels_: DataFrame, rentals: DataFrame, calls: DataFrame) -> DataFrame:
    """Per system, basis and level: the calls a month at which renting costs as much as calls at ``usd_per_call``, and whether the level's capacity holds them."""
    each = levels_.crossJoin(small(rentals)).crossJoin(small(calls))
    volume = cost.break_even_calls(F.col("usd_per_hour"), F.col("usd_per_call"))
    return each.select("model", "basis", "concurrency", volume.alias("calls"), (volume <= cost.monthly_capacity(F.col("requests_per_s"))).alias("within"))


def probe_summary(log: DataFrame, by: list[str]) -> DataFrame:
    """Round trips that worked: how many, least, upper median, most."""
    good = log.where(~F.col("failed"))
    counted = good.groupBy(*by).agg(F.count("*").alias("ok"), F.min("latency_s").alias("least_s"), F.max("latency_s").alias("most_s"))
    ranked = with_rank(good.where("latency_s IS NOT NULL").groupBy(*by, "latency_s").agg(F.count("*").alias("_n")), [F.col("latency_s")], by, "_upto", "_n")
    upper = ranked.join(counted.select(*by, "ok"), by).where(F.col("_upto") >= F.floor(F.col("ok") / 2) + 1).groupBy(*by).agg(F.min("latency_s").alias("median_s"))
    return counted.join(upper, by, "left").select(*by, "ok", "least_s", "median_s", "most_s")
