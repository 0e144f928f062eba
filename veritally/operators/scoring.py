"""Scores of structured answers: per item, per group, micro averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions import multiset
from veritally.functions.stats import f1, precision, ratio, recall
from veritally.storage import small

SCORES = ("em", "intent_ok", "valid", "tp", "fp", "fn", "n_pred", "n_unfound")


def item_scores(items: DataFrame) -> DataFrame:
    """Adds `SCORES` (bigint) to rows with text, intent, slots (gold), pred_intent, pred_slots, valid. Row-local.

    An invalid or missing answer scores 0 everywhere and misses all gold slots.
    """
    ok = F.coalesce(F.col("valid"), F.lit(False))
    pred, gold = multiset.pairs(F.col("pred_slots")), multiset.pairs(F.col("slots"))
    found = F.size(F.filter("pred_slots", lambda s: F.contains(F.lower(F.col("text")), F.lower(s["value"]))))
    n_pred = F.coalesce(F.size("pred_slots"), F.lit(0))
    long = lambda c, name: F.when(ok, c.cast("long")).otherwise(F.lit(0).cast("long")).alias(name)
    d = items.withColumn("_pred", pred).withColumn("_gold", gold).withColumn("_tp", multiset.common(F.col("_pred"), F.col("_gold")))
    same = F.coalesce(F.col("pred_intent") == F.col("intent"), F.lit(False))
    fn = F.when(ok, F.size("_gold") - F.col("_tp")).otherwise(F.size("_gold")).cast("long")
    return d.select(
        *items.columns[: items.columns.index("valid")], *items.columns[items.columns.index("valid") + 1 :],
        long((same & multiset.equal(F.col("_pred"), F.col("_gold"))).cast("int"), "em"), long(same.cast("int"), "intent_ok"), long(F.lit(1), "valid"),
        long(F.col("_tp"), "tp"), long(F.size("_pred") - F.col("_tp"), "fp"), fn.alias("fn"), long(n_pred, "n_pred"), long(n_pred - found, "n_unfound"),
    )


def summary_columns() -> list[Column]:
    """Aggregates over scored items."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    return [
        F.count("*").alias("n"), F.avg("em").alias("exact_match"), F.avg("intent_ok").alias("intent_accuracy"), F.avg("valid").alias("schema_valid"),
        precision(tp, fp).alias("slot_precision"), recall(tp, fn).alias("slot_recall"), f1(tp, fp, fn).alias("slot_f1"), ratio(F.sum("n_unfound"), F.sum("n_pred")).alias("unfound_rate"),
    ]


def summarize(scored: DataFrame, by: list[str]) -> DataFrame:
    return scored.groupBy(*by).agg(*summary_columns())


def best_epoch(scores: DataFrame, by: list[str]) -> DataFrame:
    """Per group the row (epoch, correct) with most correct answers, the earlier epoch among equals; rows without an epoch don't count."""
    best = scores.where("epoch IS NOT NULL").groupBy(*by).agg(F.max_by(F.struct("epoch", "correct"), F.struct("correct", -F.col("epoch"))).alias("_b"))
    return best.select(*by, "_b.*")


def strongest(scored: DataFrame, subset: DataFrame, systems: DataFrame, metric: str = "em") -> DataFrame:
    """One row (system, correct, n): of the ``systems`` (system, place, eligible boolean) that are eligible and have answered every id of ``subset``, the one with most correct answers; of equals the first by place.

    No row if there is none.
    """
    size = subset.count()
    by = scored.join(small(subset.select("id")), "id", "left_semi").groupBy("system").agg(F.sum(metric).alias("correct"), F.countDistinct("id").alias("n"))
    whole = by.where(F.col("n") == size).join(F.broadcast(systems.where("eligible")), "system")
    return whole.orderBy(F.col("correct").desc(), "place").limit(1).select("system", "correct", "n")


def spread(summary: DataFrame, reference: str, metrics: list[str]) -> DataFrame:
    """(metric, reference, low, high): the reference system's value, and the range of the other systems'. Without a reference row, or without others, there is none."""
    long = summary.select("system", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))))
    mine = F.col("system") == reference
    out = long.groupBy("metric").agg(F.max(F.when(mine, F.col("v"))).alias("reference"), F.min(F.when(~mine, F.col("v"))).alias("low"), F.max(F.when(~mine, F.col("v"))).alias("high"))
    return out.where("reference IS NOT NULL AND low IS NOT NULL")
