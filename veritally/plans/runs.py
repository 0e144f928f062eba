"""Queries on run logs, load levels and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritally.functions import cost
from veritally.functions.text import prompt_token_estimate, token_estimate
from veritally.operators import load, runlog
from veritally.plans.bindings import LOG_SQL, PREFIX_TOKENS, PRICES_SQL, RENTALS, prices, run_log, table

WALL_S = 86_400.0 * 30


def latest_rows(spark, d):
    return runlog.latest(run_log(spark, d), ["key"]).select("key", "pos", "latency_s", "model", "failed", "retriable")


def pending_items(spark, d):
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return runlog.pending(items, run_log(spark, d), "key")


def stale_rows(spark, d):
    log = run_log(spark, d).withColumn("config_hash", F.when(F.col("pos") % 5 > 0, F.substring(F.md5((F.col("pos") % 2).cast("string")), 1, 8)))
    return runlog.stale(log, "cfcd2084").groupBy("config_hash").agg(F.count("*").alias("n"))


def model_segments(spark, d):
    return runlog.segments(run_log(spark, d)).select("key", "segment", "model", "rows", "first_row", "last_row")


def models_returned(spark, d):
    return runlog.models_returned(run_log(spark, d))


def rolling_budget_minute(spark, d):
    return runlog.budgets(run_log(spark, d), runlog.MINUTE_US).select("key", "pos", "requests", "window_tokens")


def rolling_budget_day(spark, d):
    return runlog.budgets(run_log(spark, d), runlog.DAY_US).select("key", "pos", "requests", "window_tokens")


def budget_frees_at(spark, d):
    return runlog.frees_at(run_log(spark, d), 500, runlog.DAY_US)


def failure_streaks(spark, d):
    return runlog.streaks(run_log(spark, d), 2)


def spend_projection(spark, d):
    usd = cost.call_cost(F.lit(1000), F.col("tokens"), F.lit(0), F.lit(1.0), F.lit(2.0), F.lit(None).cast("double"))
    s = runlog.spend(run_log(spark, d), usd, 0.06, 60)
    return s.groupBy("key").agg(F.min(F.when(F.col("stop"), F.col("calls"))).alias("stops_after"), F.round(F.max("total"), 9).alias("total"))


def token_average(spark, d):
    return runlog.output_average(run_log(spark, d), 512)


def call_reservations(spark, d):
    """What is reserved for the call after each row."""
    return runlog.reservations(run_log(spark, d), 512).select("key", "pos", F.round("average", 6).alias("average"), "reserve")


def run_counters(spark, d):
    return runlog.counters(run_log(spark, d), ["concurrency"])


def outcome_frequencies(spark, d):
    return runlog.frequencies(run_log(spark, d), ["concurrency"], "model")


def last_headers(spark, d):
    log = run_log(spark, d).withColumn("headers", F.when(F.col("pos") % 4 == 0, F.create_map(F.lit("x-ratelimit-remaining"), F.col("tokens").cast("string"))).otherwise(F.create_map().cast("map<string,string>")))
    return runlog.last_headers(log, ["key"]).select("key", F.element_at("headers", "x-ratelimit-remaining").alias("remaining"))


def latency_percentiles(spark, d):
    l = load.levels(run_log(spark, d), WALL_S)
    return l.select("concurrency", "requests", "ok", "errors", *(F.round(c, 9).alias(c) for c in ("error_rate", "requests_per_s", "tokens_per_s", "mean_s", "max_s", "p50", "p95", "p99")), "meets_limit")


def operating_point(spark, d):
    return load.operating_point(load.levels(run_log(spark, d), WALL_S), 200.0, 0.5)


def _rentals(spark):
    return spark.createDataFrame(list(RENTALS.items()), "basis string, usd_per_hour double")


def cost_by_load(spark, d):
    c = load.cost_by_load(load.levels(run_log(spark, d), WALL_S), _rentals(spark))
    return c.select("concurrency", "basis", F.round("usd_per_1k", 6).alias("usd_per_1k"), F.round("capacity", 3).alias("capacity"))


def _usage(spark, d):
    """Calls of the conversations: prompt tokens of all turns but the last, completion tokens of the last."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return turns.select("conv_id", prompt_token_estimate(F.slice("t", 1, F.size("t") - 1)).alias("prompt"), token_estimate(F.element_at("t", -1)).alias("completion"))


def call_cost(spark, d):
    u = _usage(spark, d).crossJoin(F.broadcast(prices(spark)))
    return u.select("conv_id", "model", F.round(cost.call_cost(F.col("prompt"), F.col("completion"), F.floor(F.col("prompt") / 2), F.col("price_in"), F.col("price_out"), F.col("price_cached")), 12).alias("usd"))


def cost_bounds_per_1k(spark, d):
    u = _usage(spark, d).crossJoin(F.broadcast(prices(spark)))
    up, low = cost.cost_bounds(F.col("prompt"), F.col("completion"), F.lit(PREFIX_TOKENS), F.col("price_in"), F.col("price_out"), F.col("price_cached"))
    return u.groupBy("model").agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.round(cost.per_thousand(F.sum(up), F.count("*")), 9).alias("upper_per_1k"), F.round(cost.per_thousand(F.sum(low), F.count("*")), 9).alias("lower_per_1k"))


def break_even_capacity(spark, d):
    u = _usage(spark, d).crossJoin(F.broadcast(prices(spark)))
    usd = cost.call_cost(F.col("prompt"), F.col("completion"), F.lit(0), F.col("price_in"), F.col("price_out"), F.col("price_cached"))
    calls = u.groupBy("model").agg(F.avg(usd).alias("usd_per_call"))
    b = load.break_even(load.levels(run_log(spark, d), WALL_S), _rentals(spark), calls)
    return b.select("model", "basis", "concurrency", F.round("calls", 3).alias("calls"), "within")


def batch_projection(spark, d):
    """The most that a batch can cost, against a cap, before it starts."""
    u = _usage(spark, d).crossJoin(F.broadcast(prices(spark)))
    up, _ = cost.cost_bounds(F.col("prompt"), F.lit(512), F.lit(0), F.col("price_in"), F.col("price_out"), F.col("price_cached"))
    return u.groupBy("model").agg(F.round(F.sum(up), 9).alias("most_usd")).withColumn("refused", F.col("most_usd") > 0.1)


def token_estimates(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", token_estimate(F.col("text")).alias("tokens"))


def probe_round_trips(spark, d):
    p = load.probe_summary(run_log(spark, d), ["key"])
    return p.select("key", "ok", *(F.round(c, 9).alias(c) for c in ("least_s", "median_s", "most_s")))


QUERIES = {
    f.__name__: f
    for f in (latest_rows, pending_items, stale_rows, model_segments, models_returned, rolling_budget_minute, rolling_budget_day, budget_frees_at, failure_streaks, spend_projection, token_average, call_reservations, run_counters, outcome_frequencies, last_headers, latency_percentiles, operating_point, cost_by_load, call_cost, cost_bounds_per_1k, break_even_capacity, batch_projection, token_estimates, probe_round_trips)
}

_L = f"WITH {LOG_SQL}"
_SEG = f"{_L}, a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS row FROM log WHERE NOT failed), n AS (SELECT *, CASE WHEN model IS DISTINCT FROM lag(model) OVER (PARTITION BY key ORDER BY pos) THEN 1 ELSE 0 END AS new FROM a WHERE model IS NOT NULL), s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY pos) AS segment FROM n), g AS (SELECT key, CAST(segment AS BIGINT) AS segment, model, count(*) AS rows, min(row) AS first_row, max(row) AS last_row FROM s GROUP BY ALL)"
_RANK = "max(latency_s) FILTER (NOT failed AND r = greatest(1, CAST(ceil(round({q} * n / 100.0, 9)) AS BIGINT)))"
_LEV = f"{_L}, r AS (SELECT *, row_number() OVER (PARTITION BY concurrency, failed ORDER BY latency_s) AS r, count(*) OVER (PARTITION BY concurrency, failed) AS n FROM log), lev AS (SELECT concurrency, count(*) AS requests, count(*) FILTER (NOT failed) AS ok, count(*) FILTER (failed) AS errors, count(*) FILTER (failed) / count(*) AS error_rate, count(*) FILTER (NOT failed) / {WALL_S} AS requests_per_s, sum(tokens) FILTER (NOT failed) / {WALL_S} AS tokens_per_s, avg(latency_s) FILTER (NOT failed) AS mean_s, max(latency_s) FILTER (NOT failed) AS max_s, {_RANK.format(q=50)} AS p50, {_RANK.format(q=95)} AS p95, {_RANK.format(q=99)} AS p99 FROM r GROUP BY concurrency)"
_EST = "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) END"
_USE = f"tok AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last, {_EST} AS t FROM conversations), u AS (SELECT conv_id, CAST(3 + coalesce(sum(t + 3) FILTER (turn < last), 0) AS BIGINT) AS prompt, CAST(sum(t) FILTER (turn = last) AS BIGINT) AS completion FROM tok GROUP BY conv_id), {PRICES_SQL}"
_BUD = "SELECT key, pos, count(*) OVER w AS requests, CAST(sum(tokens) OVER w AS BIGINT) AS window_tokens FROM log WINDOW w AS (PARTITION BY key ORDER BY at_us RANGE BETWEEN {us} PRECEDING AND CURRENT ROW)"
_RENT = "(VALUES ('on_demand', 0.5::DOUBLE), ('spot', 0.25)) b(basis, usd_per_hour)"
ORACLE_SQL = {
    "latest_rows": f"{_L} SELECT key, pos, latency_s, model, failed, retriable FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1",
    "pending_items": f"{_L}, l AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1) SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT key FROM l WHERE NOT failed OR NOT retriable)",
    "stale_rows": f"{_L}, h AS (SELECT CASE WHEN pos % 5 > 0 THEN substring(md5(CAST(pos % 2 AS VARCHAR)), 1, 8) END AS config_hash FROM log) SELECT config_hash, count(*) AS n FROM h WHERE config_hash <> 'cfcd2084' GROUP BY ALL",
    "model_segments": f"{_SEG} SELECT * FROM g",
    "models_returned": f"{_SEG}, f AS (SELECT key, model, min(first_row) AS seen FROM g GROUP BY ALL) SELECT key, string_agg(model, ',' ORDER BY seen) AS returned, count(*) > 1 AS changed FROM f GROUP BY key",
    "rolling_budget_minute": f"{_L} {_BUD.format(us=59_999_999)}",
    "rolling_budget_day": f"{_L} {_BUD.format(us=86_399_999_999)}",
    "budget_frees_at": f"{_L}, r AS (SELECT *, sum(tokens) OVER (PARTITION BY key ORDER BY at_us, pos ROWS UNBOUNDED PRECEDING) AS run FROM log) SELECT key, min(at_us) + 86400000000 AS frees_at_us FROM r WHERE run >= 500 GROUP BY key",
    "failure_streaks": f"{_L}, i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY pos) AS ok FROM log), n AS (SELECT key, pos, row_number() OVER (PARTITION BY key, ok ORDER BY pos) AS n FROM i WHERE failed) SELECT key, max(n) AS longest, min(pos) FILTER (n >= 2) AS stopped_at FROM n GROUP BY key",
    "spend_projection": f"{_L}, c AS (SELECT key, pos, (1000 + tokens * 2.0::DOUBLE) / 1e6 AS usd FROM log), r AS (SELECT key, count(*) OVER w AS calls, sum(usd) OVER w AS total FROM c WINDOW w AS (PARTITION BY key ORDER BY pos)), s AS (SELECT *, total >= 0.06 OR (calls >= 5 AND total + total / calls * greatest(0, 60 - calls) > 0.06) AS stop FROM r) SELECT key, min(calls) FILTER (stop) AS stops_after, round(max(total), 9) AS total FROM s GROUP BY key",
    "token_average": f"{_L}, t AS (SELECT key, list(CAST(tokens AS DOUBLE) ORDER BY pos) AS t FROM log GROUP BY key), e AS (SELECT key, list_reduce(t, lambda a, x: a * 0.8 + x * 0.2) AS e FROM t) SELECT key, round(e, 6) AS average, CAST(greatest(16, least(512, ceil(round(e * 1.5, 9)))) AS BIGINT) AS reserve FROM e",
    "call_reservations": f"{_L}, o AS (SELECT key, pos, CAST(tokens AS DOUBLE) AS x, row_number() OVER (PARTITION BY key ORDER BY pos) AS i FROM log), e AS (SELECT key, pos, i, x AS e FROM o WHERE i = 1 UNION ALL SELECT o.key, o.pos, o.i, e.e * 0.8 + o.x * 0.2 FROM e JOIN o ON o.key = e.key AND o.i = e.i + 1) SELECT key, pos, round(e, 6) AS average, CAST(greatest(16, least(512, ceil(round(e * 1.5, 9)))) AS BIGINT) AS reserve FROM e".replace("WITH", "WITH RECURSIVE", 1),
    "run_counters": f"{_L} SELECT concurrency, count(*) AS n, count(*) FILTER (NOT failed) AS scored, count(*) FILTER (failed AND NOT retriable) AS failed_for_good, count(*) FILTER (failed AND retriable) AS retries FROM log GROUP BY ALL",
    "outcome_frequencies": f"{_L} SELECT concurrency, model, count(*) AS n FROM log WHERE model IS NOT NULL GROUP BY ALL",
    "last_headers": f"{_L} SELECT key, CAST(arg_max(tokens, pos) AS VARCHAR) AS remaining FROM log WHERE pos % 4 = 0 GROUP BY key",
    "latency_percentiles": f"{_LEV} SELECT concurrency, requests, ok, errors, round(error_rate, 9) AS error_rate, round(requests_per_s, 9) AS requests_per_s, round(tokens_per_s, 9) AS tokens_per_s, round(mean_s, 9) AS mean_s, round(max_s, 9) AS max_s, round(p50, 9) AS p50, round(p95, 9) AS p95, round(p99, 9) AS p99, coalesce(p95 <= 1 AND errors = 0, false) AS meets_limit FROM lev",
    "operating_point": f"{_LEV} SELECT max(concurrency) FILTER (error_rate <= 0.5 AND p95 <= 200) AS concurrency FROM lev",
    "cost_by_load": f"{_LEV} SELECT concurrency, basis, round(usd_per_hour / (requests_per_s * 3600) * 1000, 6) AS usd_per_1k, round(requests_per_s * 3600 * 730, 3) AS capacity FROM lev, {_RENT}",
    "call_cost": f"WITH {_USE} SELECT conv_id, model, round(((prompt - prompt // 2) * price_in + (prompt // 2) * coalesce(price_cached, price_in) + completion * price_out) / 1e6, 12) AS usd FROM u, prices",
    "cost_bounds_per_1k": f"WITH {_USE} SELECT model, count(*) AS calls, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(completion) AS BIGINT) AS completion, round(sum((prompt * price_in + completion * price_out) / 1e6) / count(*) * 1000, 9) AS upper_per_1k, round(sum(((prompt - least({PREFIX_TOKENS}, prompt)) * price_in + least({PREFIX_TOKENS}, prompt) * coalesce(price_cached, price_in) + completion * price_out) / 1e6) / count(*) * 1000, 9) AS lower_per_1k FROM u, prices GROUP BY model",
    "break_even_capacity": f"{_LEV}, {_USE}, c AS (SELECT model, avg((prompt * price_in + completion * price_out) / 1e6) AS usd FROM u, prices GROUP BY model) SELECT model, basis, concurrency, round(usd_per_hour * 730 / usd, 3) AS calls, usd_per_hour * 730 / usd <= requests_per_s * 3600 * 730 AS within FROM lev, {_RENT}, c",
    "batch_projection": f"WITH {_USE} SELECT model, round(sum((prompt * price_in + 512 * price_out) / 1e6), 9) AS most_usd, round(sum((prompt * price_in + 512 * price_out) / 1e6), 9) > 0.1 AS refused FROM u, prices GROUP BY model",
    "token_estimates": f"SELECT conv_id, turn, CAST({_EST} AS BIGINT) AS tokens FROM conversations",
    "probe_round_trips": f"{_L}, r AS (SELECT key, latency_s, row_number() OVER (PARTITION BY key ORDER BY latency_s) AS r, count(*) OVER (PARTITION BY key) AS n FROM log WHERE NOT failed) SELECT key, any_value(n) AS ok, round(min(latency_s), 9) AS least_s, round(max(latency_s) FILTER (r = n // 2 + 1), 9) AS median_s, round(max(latency_s), 9) AS most_s FROM r GROUP BY key",
}
