"""The comparison of systems: one row per system, joined from scores, pairs with a reference, prices, costs, latencies and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions import cost
from veritally.functions.stats import mcnemar
from veritally.functions.text import format_p, format_percent, format_usd, price_key
from veritally.operators.load import cost_by_load, levels
from veritally.operators.provenance import pair_scores, run_warnings
from veritally.operators.ranks import percentiles
from veritally.operators.resample import RESAMPLES, interval
from veritally.operators.runlog import models_returned
from veritally.operators.scoring import summarize
from veritally.storage import small, written


def resolved_prices(systems: DataFrame, prices: DataFrame) -> DataFrame:
    """``systems`` (system, name, billing) with the prices (key, price_in, price_cached, price_out) of the key that name and billing make; without a price they stay, with nulls."""
    return systems.withColumn("key", price_key(F.col("name"), F.col("billing"))).join(small(prices), "key", "left")


def call_costs(calls: DataFrame, priced: DataFrame, prefix: Column) -> DataFrame:
    """(system, calls, usd_per_call, upper_per_1k, lower_per_1k) of ``calls`` (system, prompt, completion); a system without a price has nulls."""
    each = calls.join(small(priced), "system")
    up, low = cost.cost_bounds(F.col("prompt"), F.col("completion"), prefix, F.col("price_in"), F.col("price_out"), F.col("price_cached"))
    n = F.count("*")
    return each.groupBy("system").agg(n.alias("calls"), (F.sum(up) / n).alias("usd_per_call"), cost.per_thousand(F.sum(up), n).alias("upper_per_1k"), cost.per_thousand(F.sum(low), n).alias("lower_per_1k"))


def paired_tests(scored: DataFrame, reference: str) -> DataFrame:
    """(system, n_pairs, points, only_system, only_reference, p) of each other system on the items that it and the reference have answered."""
    only = lambda a, b: F.count_if((F.col(a) == 1) & (F.col(b) == 0))
    by = pair_scores(scored, reference).groupBy("system").agg(F.count("*").alias("n_pairs"), ((F.avg("em") - F.avg("ref_em")) * 100).alias("points"), only("em", "ref_em").alias("only_system"), only("ref_em", "em").alias("only_reference"))
    return by.withColumn("p", mcnemar(F.col("only_system"), F.col("only_reference")))


def compare(scored: DataFrame, reference: str, calls: DataFrame, priced: DataFrame, prefix: Column, log: DataFrame, runs: DataFrame, rental_usd_per_hour: float) -> DataFrame:
    """One row per system of ``scored``: scores, the pairs with ``reference``, costs, latencies, the calls a month from which renting is cheaper, and warnings; nulls where a part is missing.

    Every part is one aggregation by system; only their rows, a few, are joined.
    """
    out = summarize(scored, ["system"])
    slow = percentiles(log.where(~F.col("failed")), "latency_s", ["system"], [50, 95])
    notes = run_warnings(runs).groupBy("system").agg(F.array_join(F.array_sort(F.collect_set("warning")), "; ").alias("warnings"))
    for part in (paired_tests(scored, reference), call_costs(calls, priced, prefix), slow, notes):
        out = out.join(part, "system", "left")
    out = out.withColumn("break_even", cost.break_even_calls(F.lit(rental_usd_per_hour), F.col("usd_per_call"))).withColumn("warnings", F.coalesce("warnings", F.lit("")))
    return out.withColumn("cells", F.concat_ws(" | ", format_percent(F.col("exact_match")), format_p(F.col("p")), format_usd(F.col("upper_per_1k"))))


def scenario_scores(scored: DataFrame) -> DataFrame:
    """(system, scenarios): each system's scores per scenario, in order, as array<struct<scenario, n, exact_match, slot_f1, weakest>>; the weakest has the least exact matches, the first of equals."""
    by = summarize(scored, ["system", "scenario"]).select("system", "scenario", "n", "exact_match", "slot_f1")
    listed = by.groupBy("system").agg(F.array_sort(F.collect_list(F.struct("scenario", "n", "exact_match", "slot_f1"))).alias("s"), F.min(F.struct("exact_match", "scenario")).alias("w"))
    marked = F.transform("s", lambda x: F.struct(*(x[c].alias(c) for c in ("scenario", "n", "exact_match", "slot_f1")), (x["scenario"] == F.col("w.scenario")).alias("weakest")))
    return listed.select("system", marked.alias("scenarios"))


def unseen_scores(scored: DataFrame, unseen: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """(system, unseen): struct<n, exact_match, low, high, excluded> of the items (``id`` of ``unseen``) whose text the training split doesn't have; systems without such items have none."""
    rows = written(scored.select("system", "id", "em").join(small(unseen.select("id").distinct()), "id", "left_semi"), "unseen-scores")
    if not rows.limit(1).count():
        return scored.sparkSession.createDataFrame([], "system string, unseen struct<n:bigint,exact_match:double,low:double,high:double,excluded:bigint>")
    block = interval(rows, [F.col("system"), F.col("id")], "mean", ["em"], resamples, by=["system"])
    both = block.join(scored.groupBy("system").agg(F.count("*").alias("_all")), "system")
    return both.select("system", F.struct("n", F.col("value").alias("exact_match"), "low", "high", (F.col("_all") - F.col("n")).alias("excluded")).alias("unseen"))


def hosted_costs(log: DataFrame, wall_s: float, rentals: DataFrame, hosted: str, calls: DataFrame) -> DataFrame:
    """(system, load): for the one system that is served on rented machines, per level and price basis array<struct<concurrency, basis, usd_per_1k, capacity, meets_limit, break_even>>.

    ``break_even`` is how many calls a month the cheapest other system of ``calls`` (system, usd_per_call) must cost before renting is cheaper.
    """
    by_level = written(levels(log, wall_s), "hosted-levels")
    costs = cost_by_load(by_level, rentals).join(small(by_level.select("concurrency", "meets_limit")), "concurrency").join(small(rentals), "basis")
    cheapest = calls.where(F.col("system") != hosted).agg(F.min("usd_per_call").alias("_call"))
    each = costs.crossJoin(F.broadcast(cheapest)).withColumn("break_even", cost.break_even_calls(F.col("usd_per_hour"), F.col("_call")))
    listed = F.array_sort(F.collect_list(F.struct("concurrency", "basis", "usd_per_1k", "capacity", "meets_limit", "break_even")))
    return each.agg(listed.alias("load")).select(F.lit(hosted).alias("system"), "load")


def run_provenance(runs: DataFrame, log: DataFrame, locks: DataFrame) -> DataFrame:
    """(system, provenance): struct<config_hash, subset_hash, locked, reason, models, changed>: what each run (system, config_hash, subset_hash) was made with, the latest lock of exactly that, and which models the log (key: the
    system) says have answered."""
    last = locks.groupBy("system", "config_hash", "subset_hash").agg(F.max_by("reason", "number").alias("reason"))
    models = models_returned(log).select(F.col("key").alias("system"), F.col("returned").alias("models"), "changed")
    both = runs.select("system", "config_hash", "subset_hash").join(small(last), ["system", "config_hash", "subset_hash"], "left").join(models, "system", "left")
    return both.select("system", F.struct("config_hash", "subset_hash", F.col("reason").isNotNull().alias("locked"), "reason", "models", "changed").alias("provenance"))


def full_report(main: DataFrame, sections: list[DataFrame]) -> DataFrame:
    """`compare`'s rows with the sections beside them: a row per system, a section null where it has none."""
    for part in sections:
        main = main.join(small(part), "system", "left")
    return main
