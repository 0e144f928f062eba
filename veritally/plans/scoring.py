"""Queries on scores of structured answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritally.functions.stats import ratio
from veritally.operators.scoring import SCORES, item_scores, spread, strongest, summarize
from veritally.plans.bindings import SLOTS_SQL, answered, table


def scored(spark, d):
    return item_scores(answered(spark, d)).select("id", "scenario", "intent", "system", *SCORES)


def _rounded(df, keep):
    return df.select(*keep, *(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keep))


def score_by_stratum(spark, d):
    return _rounded(summarize(scored(spark, d), ["system", "scenario"]), ["system", "scenario"])


def micro_prf(spark, d):
    return _rounded(scored(spark, d).groupBy("system").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), ratio(F.sum("tp"), F.sum("tp") + F.sum("fp")).alias("slot_precision"), ratio(F.sum("tp"), F.sum("tp") + F.sum("fn")).alias("slot_recall"), ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("slot_f1")), ["system"])


def slot_counts_multiset(spark, d):
    return scored(spark, d).select("system", "id", "tp", "fp", "fn")


def exact_match_items(spark, d):
    return scored(spark, d).select("system", "id", "em", "intent_ok", "valid")


def weakest_scenario(spark, d):
    by = summarize(scored(spark, d), ["system", "scenario"])
    worst = by.groupBy("system").agg(F.min(F.struct("exact_match", "scenario")).alias("w"))
    return worst.select("system", "w.scenario", F.round("w.exact_match", 9).alias("exact_match"))


def strongest_system(spark, d):
    """Of the systems that have answered all orders, in the order B, A."""
    systems = spark.createDataFrame([("B", 1, True), ("A", 2, True), ("C", 0, True)], "system string, place int, eligible boolean")
    return strongest(scored(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), systems)


def metric_spread(spark, d):
    """B against the range of the others."""
    return _rounded(spread(summarize(scored(spark, d), ["system"]), "B", ["exact_match", "intent_accuracy", "slot_f1"]), ["metric"])


def score_record(spark, d):
    """Correct answers as a rounded product, halves to even."""
    by = summarize(scored(spark, d), ["system"])
    return by.select("system", "n", F.bround(F.col("exact_match") * F.col("n")).cast("long").alias("correct"))


def unfound_value_rate(spark, d):
    """Predicted values that don't occur in the request: of each document its first characters, its source and its id."""
    doc = table(spark, d, "documents").select("lang", "text", F.explode(F.array(F.substring("text", 1, 12), F.col("source"), F.col("doc_id").cast("string"))).alias("value"))
    missing = F.when(F.contains("text", "value"), 0).otherwise(1)
    return doc.groupBy("lang").agg(F.count("*").alias("n_pred"), F.sum(missing).alias("n_unfound")).withColumn("rate", F.round(ratio(F.col("n_unfound"), F.col("n_pred")), 9))


QUERIES = {f.__name__: f for f in (score_by_stratum, micro_prf, slot_counts_multiset, exact_match_items, weakest_scenario, strongest_system, metric_spread, score_record, unfound_value_rate)}

_W = f"WITH {SLOTS_SQL}"
_SUMMARY = """count(*) AS n, round(avg(em), 9) AS exact_match, round(avg(intent_ok), 9) AS intent_accuracy, round(avg(valid), 9) AS schema_valid,
 round(coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0), 9) AS slot_precision, round(coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0), 9) AS slot_recall,
 round(coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 9) AS slot_f1"""

ORACLE_SQL = {
    "score_by_stratum": f"{_W} SELECT system, scenario, {_SUMMARY}, round(coalesce(sum(n_unfound) / nullif(sum(n_pred), 0), 0), 9) AS unfound_rate FROM scored GROUP BY ALL",
    "micro_prf": f"{_W} SELECT system, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, * EXCLUDE (system, n, exact_match, intent_accuracy, schema_valid) FROM (SELECT system, {_SUMMARY} FROM scored GROUP BY ALL) JOIN (SELECT system, tp, fp, fn FROM scored) USING (system) GROUP BY ALL".replace("* EXCLUDE (system, n, exact_match, intent_accuracy, schema_valid)", "slot_precision, slot_recall, slot_f1"),
    "slot_counts_multiset": f"{_W} SELECT system, id, tp, fp, fn FROM scored",
    "exact_match_items": f"{_W} SELECT system, id, em, intent_ok, valid FROM scored",
    "weakest_scenario": f"{_W} SELECT system, scenario, round(e, 9) AS exact_match FROM (SELECT system, scenario, avg(em) AS e, row_number() OVER (PARTITION BY system ORDER BY avg(em), scenario) AS r FROM scored GROUP BY system, scenario) WHERE r = 1",
    "strongest_system": f"{_W} SELECT system, CAST(sum(em) AS BIGINT) AS correct, count(*) AS n FROM scored GROUP BY system HAVING count(*) = (SELECT count(*) FROM orders) ORDER BY correct DESC, system DESC LIMIT 1",
    "metric_spread": f"{_W}, m AS (SELECT system, avg(em) AS exact_match, avg(intent_ok) AS intent_accuracy, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS slot_f1 FROM scored GROUP BY ALL), l AS (UNPIVOT m ON exact_match, intent_accuracy, slot_f1 INTO NAME metric VALUE v) SELECT metric, round(max(v) FILTER (system = 'B'), 9) AS reference, round(min(v) FILTER (system <> 'B'), 9) AS low, round(max(v) FILTER (system <> 'B'), 9) AS high FROM l GROUP BY metric",
    "score_record": f"{_W} SELECT system, count(*) AS n, CAST(sum(em) AS BIGINT) AS correct FROM scored GROUP BY ALL",
    "unfound_value_rate": "WITH v AS (SELECT lang, text, unnest([substring(text, 1, 12), source, CAST(doc_id AS VARCHAR)]) AS value FROM documents) SELECT lang, count(*) AS n_pred, CAST(sum(CASE WHEN contains(text, value) THEN 0 ELSE 1 END) AS BIGINT) AS n_unfound, round(sum(CASE WHEN contains(text, value) THEN 0 ELSE 1 END) / count(*), 9) AS rate FROM v GROUP BY ALL",
}
