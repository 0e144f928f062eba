"""Operators on append-only run logs. Running values are segmented scans, so a key may hold all rows; ``pos`` is the order of writing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.operators.scan import decaying, lay, running
from veritally.sources import jsonl
from veritally.storage import written

MINUTE_US, DAY_US = 60_000_000, 86_400_000_000


def is_final() -> Column:
    """Answered, or failed for good."""
    return ~F.col("failed") | ~F.col("retriable")


def latest(log: DataFrame, by: list[str]) -> DataFrame:
    """The last row of each id. An aggregate, so it combines before the shuffle."""
    rest = [c for c in log.columns if c not in by]
    return log.groupBy(*by).agg(F.max_by(F.struct(*rest), "pos").alias("_r")).select(*by, "_r.*")


def pending(items: DataFrame, log: DataFrame, id_: str) -> DataFrame:
    """Items whose last row isn't final."""
    return items.join(latest(log, [id_]).where(is_final()).select(id_), id_, "left_anti")


def stale(log: DataFrame, current: str) -> DataFrame:
    """Rows made with another configuration; they must not be mixed with new ones."""
    return log.where(F.col("config_hash").isNotNull() & (F.col("config_hash") != current))


def segments(log: DataFrame) -> DataFrame:
    """Runs of the same model name per key: positions count the key's answered rows from 1; rows without a name belong to none and break none."""
    answered = lay(log.where(~F.col("failed")).select("key", "pos", "model"), ["key"], [F.col("pos")], "segments")
    placed = running(answered, ["key"], {"row": ("sum", F.lit(1))})
    named = running(written(placed.where(F.col("model").isNotNull()), "segments-named"), ["key"], {"_before": ("last", F.col("model"))}, before=True)
    new = written(named.withColumn("_new", F.coalesce((F.col("model") != F.col("_before")).cast("int"), F.lit(1))), "segments-new")
    runs = running(new, ["key"], {"segment": ("sum", F.col("_new"))})
    return runs.groupBy("key", "segment", "model").agg(F.count("*").alias("rows"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


def models_returned(log: DataFrame) -> DataFrame:
    """Per key: distinct names by first appearance, whether the name changed, rows without one."""
    s = segments(log)
    first = s.groupBy("key", "model").agg(F.min("first_row").alias("at"))
    names = first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "model"))), lambda x: x["model"]).alias("names"))
    return names.select("key", F.array_join("names", ",").alias("returned"), (F.size("names") > 1).alias("changed"))


def budgets(log: DataFrame, span_us: int) -> DataFrame:
    """For each row the requests and tokens of its key in the window (t - span, t].

    What enters at t leaves at t + span; running sums of the changes at each time are the window's content, without a window's buffer, for a key of any size.
    """
    change = lambda at, sign: log.select("key", at.alias("at_us"), F.lit(sign).cast("long").alias("_n"), (F.col("tokens") * sign).alias("_t"))
    changes = change(F.col("at_us"), 1).union(change(F.col("at_us") + span_us, -1)).groupBy("key", "at_us").agg(F.sum("_n").alias("_n"), F.sum("_t").alias("_t"))
    sums = running(lay(changes, ["key"], [F.col("at_us")], "budgets"), ["key"], {"requests": ("sum", F.col("_n")), "window_tokens": ("sum", F.col("_t"))})
    return log.join(sums.select("key", "at_us", "requests", "window_tokens"), ["key", "at_us"]).select(*log.columns, "requests", "window_tokens")


def frees_at(log: DataFrame, need: int, span_us: int) -> DataFrame:
    """Per key: when so many tokens of the log have aged out, counted from the oldest."""
    laid = lay(log.select("key", "at_us", "pos", "tokens"), ["key"], [F.col("at_us"), F.col("pos")], "ageing")
    run = running(laid, ["key"], {"_run": ("sum", F.col("tokens"))})
    return run.where(F.col("_run") >= need).groupBy("key").agg((F.min("at_us") + span_us).alias("frees_at_us"))


def streaks(log: DataFrame, stop: int = 8) -> DataFrame:
    """Per key: the longest run of failures, and the position where it first reached ``stop``. A failure's place in its run is its distance from the last row that didn't fail."""
    laid = lay(log.select("key", "pos", "failed"), ["key"], [F.col("pos")], "streaks")
    placed = written(running(laid, ["key"], {"_row": ("sum", F.lit(1))}), "streaks-placed")
    run = running(placed, ["key"], {"_ok": ("max", F.when(~F.col("failed"), F.col("_row")))}).where("failed")
    run = run.withColumn("_n", F.col("_row") - F.coalesce("_ok", F.lit(0)))
    return run.groupBy("key").agg(F.max("_n").alias("longest"), F.min(F.when(F.col("_n") >= stop, F.col("pos"))).alias("stopped_at"))


def spend(log: DataFrame, cost: Column, cap: float, planned: int, least: int = 5) -> DataFrame:
    """Running cost per key, its projection to ``planned`` calls, and whether the run must stop there: total at the cap, or after ``least`` calls the projection above it."""
    laid = lay(log.withColumn("_cost", cost), ["key"], [F.col("pos")], "spend")
    run = running(laid, ["key"], {"calls": ("sum", F.lit(1)), "total": ("sum", F.col("_cost"))}).drop("_cost", "_part", "_at")
    run = run.withColumn("projected", F.col("total") + F.col("total") / F.col("calls") * F.greatest(F.lit(0), F.lit(planned) - F.col("calls")))
    return run.withColumn("stop", (F.col("total") >= cap) | ((F.col("calls") >= least) & (F.col("projected") > cap)))


def reservations(log: DataFrame, most: int) -> DataFrame:
    """``log`` with the exponential average (0.8 old, 0.2 new) of its key's tokens up to each row, and the reservation for the next call: 1.5 times the average, between 16 and ``most``."""
    run = decaying(lay(log, ["key"], [F.col("pos")], "averages"), ["key"], "tokens", 0.8, "average").drop("_part", "_at")
    return run.withColumn("reserve", F.greatest(F.lit(16), F.least(F.lit(most), F.ceil(F.round(F.col("average") * 1.5, 9)))).cast("long"))


def output_average(log: DataFrame, most: int) -> DataFrame:
    """Per key the last of `reservations`."""
    last = latest(reservations(log.select("key", "pos", "tokens"), most), ["key"])
    return last.select("key", F.round("average", 6).alias("average"), "reserve")


def counters(log: DataFrame, by: list[str]) -> DataFrame:
    """Rows, answers, failures for good, retries; and how often each model and outcome occurs, as maps."""
    return log.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col("failed")).alias("scored"), F.count_if(F.col("failed") & ~F.col("retriable")).alias("failed_for_good"), F.count_if(F.col("failed") & F.col("retriable")).alias("retries"))


def frequencies(log: DataFrame, by: list[str], col: str) -> DataFrame:
    """Counts of a column's values per group, long; `frequency_map` makes a map of few values."""
    return log.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("n"))


def frequency_map(log: DataFrame, by: list[str], col: str) -> DataFrame:
    return frequencies(log, by, col).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(col, "n")))).alias(col))


def last_headers(log: DataFrame, by: list[str]) -> DataFrame:
    """The last header map that isn't empty."""
    return log.where(F.size("headers") > 0).groupBy(*by).agg(F.max_by("headers", "pos").alias("headers"))


def run_pending(items: DataFrame, log: DataFrame, id_: str, answer, schema: str, path: str, commit: str | None = None) -> DataFrame:
    """Answers the items that have no final row and appends the answers to the JSONL log at ``path``, all or none; returns what this append has put there.

    ``answer`` maps Arrow batches of items to batches of ``schema`` on the executors. A lost executor leaves no half-written row, an append that is tried again under its ``commit`` name changes nothing, and what other
    writers append meanwhile isn't returned. `waves` has runs with limits.
    """
    spark, name = items.sparkSession, commit or uuid.uuid4().hex
    jsonl.append_rows(pending(items, log, id_).mapInArrow(answer, schema), path, name)
    files = jsonl.files_of(path, name)
    return jsonl.read_rows(spark, path, schema).where(F.col("file").isin(files)).drop("file", "line")
