"""Run logs as streams: an append-only file log, counts per key and window, and a live rate limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The files of a log as they appear."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(log: DataFrame, ts: str, key: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows and failures per key and event-time window; rows later than the watermark are dropped, which bounds the state."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))


def rate_limited(log: DataFrame, per_window: int, span_s: float) -> DataFrame:
    """(key, pos, allowed): a row is allowed if fewer than so many allowed rows of its key lie within the span before it. State per key: the allowed times of the last span.

    Rows are judged in the order of time within a micro-batch, and batches in the order in which they come: like a live limiter, it never takes back a verdict, so a row that comes late is judged
    against what has been allowed by then. There is no watermark, as no row is dropped.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at_s", "pos"])
        ok = []
        for t in rows["at_s"]:
            times = [x for x in times if x > t - span_s]
            ok.append(len(times) < per_window)
            if ok[-1]:
                times.append(float(t))
        state.update((times,))
        yield pd.DataFrame({"key": [key[0]] * len(rows), "pos": rows["pos"].to_numpy(), "allowed": ok})

    return log.groupBy("key").applyInPandasWithState(step, "key long, pos long, allowed boolean", "times array<double>", "append", "NoTimeout")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there into Parquet files under ``checkpoint`` and returns them as a table."""
    out = f"{checkpoint}/{name}-out"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}-checkpoint").trigger(availableNow=True)
    writer.format("parquet").option("path", out).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def run_complete(df: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and returns its complete result, which each batch writes anew under ``checkpoint``."""
    out = f"{checkpoint}/{name}-out"
    writer = df.writeStream.outputMode("complete").option("checkpointLocation", f"{checkpoint}/{name}-checkpoint").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)
