"""How the test tables stand for the entities of an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Systems, their modulus multipliers, and prices in USD per million tokens (input, cached input, output).
SYSTEMS = {"A": (7, 3), "B": (5, 11)}
PRICES = {"cached": (1.0, 0.25, 2.0), "half": (0.5, 0.25, 1.0), "plain": (2.0, None, 4.0), "fast": (1.0, 0.5, 4.0)}
RENTALS = {"on_demand": 0.5, "spot": 0.25}
PREFIX_TOKENS = 40

#: The same in DuckDB: gold and predicted slots, one row each.
SLOTS_SQL = """
gold AS (SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag AS type, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS value FROM lineitem),
sys AS (SELECT * FROM (VALUES ('A', 7, 3), ('B', 5, 11)) t(system, a, b)),
k AS (SELECT system, id, line, type, value, id * a + line * b AS k FROM gold, sys),
pred AS (SELECT system, id, type, CASE WHEN k % 13 = 0 THEN CAST(CAST(value AS INT) + 1 AS VARCHAR) ELSE value END AS value FROM k, range(CASE WHEN k % 17 = 0 THEN 2 ELSE 1 END) WHERE k % 11 <> 0),
item AS (SELECT o_orderkey AS id, c_mktsegment AS scenario, o_orderpriority AS intent, system, CASE WHEN o_orderkey * a % 9 = 0 THEN 'other' ELSE o_orderpriority END AS pred_intent, o_orderkey * a % 19 <> 0 AS ok
         FROM orders JOIN customer ON c_custkey = o_custkey, sys),
gc AS (SELECT id, type, value, count(*) AS n FROM gold GROUP BY ALL),
pc AS (SELECT system, id, type, value, count(*) AS n FROM pred GROUP BY ALL),
both_ AS (SELECT pc.system, pc.id, sum(least(pc.n, gc.n)) AS tp FROM pc JOIN gc USING (id, type, value) GROUP BY ALL),
gn AS (SELECT id, count(*) AS n FROM gold GROUP BY ALL),
pn AS (SELECT system, id, count(*) AS n, sum(CASE WHEN contains(CAST(id AS VARCHAR), value) THEN 0 ELSE 1 END) AS unfound FROM pred GROUP BY ALL),
raw AS (SELECT item.*, coalesce(gn.n, 0) AS g, coalesce(pn.n, 0) AS p, coalesce(both_.tp, 0) AS t, coalesce(pn.unfound, 0) AS u
        FROM item LEFT JOIN gn USING (id) LEFT JOIN pn USING (system, id) LEFT JOIN both_ USING (system, id)),
scored AS (SELECT id, scenario, intent, system, CAST(CASE WHEN ok AND pred_intent = intent AND t = g AND t = p THEN 1 ELSE 0 END AS BIGINT) AS em,
                  CAST(CASE WHEN ok AND pred_intent = intent THEN 1 ELSE 0 END AS BIGINT) AS intent_ok, CAST(ok AS BIGINT) AS valid,
                  CAST(CASE WHEN ok THEN t ELSE 0 END AS BIGINT) AS tp, CAST(CASE WHEN ok THEN p - t ELSE 0 END AS BIGINT) AS fp, CAST(CASE WHEN ok THEN g - t ELSE g END AS BIGINT) AS fn,
                  CAST(CASE WHEN ok THEN p ELSE 0 END AS BIGINT) AS n_pred, CAST(CASE WHEN ok THEN u ELSE 0 END AS BIGINT) AS n_unfound FROM raw)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, scenario, intent, text, slots, A_slots, B_slots): orders with their lines as gold slots and those of two systems, in one shuffle of the lines.

    The systems drop, change and repeat lines by moduli of order and line.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("type"), F.col("l_quantity").cast("int").alias("q"))
    value = F.col("q").cast("string")
    slot = lambda v: F.struct(F.col("l_linenumber").alias("line"), F.col("type"), v.alias("value"))
    columns = [F.collect_list(slot(value)).alias("slots")]
    for name, (a, b) in SYSTEMS.items():
        k = F.col("l_orderkey") * a + F.col("l_linenumber") * b
        made = slot(F.when(k % 13 == 0, (F.col("q") + 1).cast("string")).otherwise(value))
        many = F.when(k % 11 == 0, F.array().cast("array<struct<line:int,type:string,value:string>>")).when(k % 17 == 0, F.array(made, made)).otherwise(F.array(made))
        columns.append(F.flatten(F.collect_list(many)).alias(f"{name}_slots"))
    lines = line.groupBy("l_orderkey").agg(*columns)
    plain = lambda c: F.coalesce(F.transform(F.array_sort(c), lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value"))), F.array().cast("array<struct<type:string,value:string>>")).alias(c)
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    all_ = order.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return all_.select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("scenario"), F.col("o_orderpriority").alias("intent"), F.col("o_orderkey").cast("string").alias("text"), plain("slots"), *(plain(f"{s}_slots") for s in SYSTEMS))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per example and system: the gold columns with system, pred_intent, pred_slots, valid."""
    ex = examples(spark, sf_dir)
    each = F.array(*(F.struct(F.lit(s).alias("system"), F.when(F.col("id") * a % 9 == 0, "other").otherwise(F.col("intent")).alias("pred_intent"), F.col(f"{s}_slots").alias("pred_slots"), (F.col("id") * a % 19 != 0).alias("valid")) for s, (a, _) in SYSTEMS.items()))
    return ex.select("id", "scenario", "intent", "text", "slots", F.inline(each))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as examples: split by doc_id, intent by source, scenario by language, one slot from the id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "dev").otherwise("train")
    return d.select(F.col("doc_id").cast("string").alias("id"), "doc_id", split.alias("split"), F.col("lang").alias("scenario"), F.col("source").alias("intent"), "text", (F.col("doc_id") % 7).cast("string").alias("label"))


CORPUS_SQL = """corpus AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'dev' ELSE 'train' END AS split,
  lang AS scenario, source AS intent, text, CAST(doc_id % 7 AS VARCHAR) AS label FROM documents)"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a run log: key (user), pos, ts in seconds, latency, model (null for errors), failed, retriable, concurrency level, tokens."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("pos"), F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")).alias("at_us"), F.col("value").alias("latency_s"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("model"),
        (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 3 == 0).alias("retriable"), F.element_at(F.array(*map(F.lit, (1, 8, 32, 64))), (F.col("event_id") % 4 + 1).cast("int")).alias("concurrency"),
        (F.col("event_id") % 97 + 16).alias("tokens"),
    )


LOG_SQL = """log AS (SELECT user_id AS key, event_id AS pos, epoch_us(ts) AS at_us, value AS latency_s, CASE WHEN event_type <> 'error' THEN event_type END AS model, event_type = 'error' AS failed,
  event_id % 3 = 0 AS retriable, CAST([1, 8, 32, 64][event_id % 4 + 1] AS INTEGER) AS concurrency, event_id % 97 + 16 AS tokens FROM events)"""


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, price_in double, price_cached double, price_out double")


PRICES_SQL = "prices AS (SELECT * FROM (VALUES ('cached', 1.0::DOUBLE, 0.25::DOUBLE, 2.0::DOUBLE), ('half', 0.5, 0.25, 1.0), ('plain', 2.0, NULL, 4.0), ('fast', 1.0, 0.5, 4.0)) t(model, price_in, price_cached, price_out))"
