"""Gates on runs that can't be right: degenerate texts, truncation, failures."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Shares above which a run is implausible, and below which too little of it is valid.
DEGENERATE, TRUNCATED, FAILED, VALID = 0.05, 0.2, 0.05, 0.5
PROBE_DEGENERATE, PROBE_VALID = 0.25, 0.5


def plain_degenerate(text: Column) -> Column:
    """Null, blank, 8 or more characters of at most two kinds, or more than a quarter replacement characters."""
    n = F.length(text)
    kinds = F.length(F.regexp_replace(F.array_join(F.array_distinct(F.split(text, "")), "\x00"), "\x00", ""))
    bad = F.length(F.regexp_replace(text, "[^�]", ""))
    return F.coalesce((F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) == "") | ((n >= 8) & (kinds <= 2)) | (bad > F.floor(n / 4)), F.lit(True))


@F.pandas_udf(DoubleType())
def zlib_ratio(text: pd.Series) -> pd.Series:
    """Compressed by plain size of texts of 64 bytes or more."""
    raw = text.map(lambda t: t.encode("utf-8", "replace") if isinstance(t, str) else b"")
    return raw.map(lambda b: len(zlib.compress(b)) / len(b) if len(b) >= 64 else None).astype("float64")


def degenerate(text: Column) -> Column:
    """`plain_degenerate`, or compressible to below 8 %."""
    return plain_degenerate(text) | F.coalesce(zlib_ratio(text) < 0.08, F.lit(False))


def shares(rows: DataFrame, by: list[str], bad: Column) -> DataFrame:
    """Per group the shares of degenerate, truncated, failed and valid rows; 0 without rows."""
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share(bad).alias("degenerate"), share(F.col("finish_reason") == "length").alias("truncated"), share(F.col("failed")).alias("failed"), share(F.col("valid")).alias("valid"))


def implausible(s: DataFrame) -> DataFrame:
    """Adds ``reasons``, empty if the run is plausible."""
    why = F.concat_ws(
        "; ", F.when(F.col("degenerate") > DEGENERATE, "degenerate texts"), F.when(F.col("truncated") > TRUNCATED, "truncated texts"), F.when(F.col("failed") > FAILED, "failed calls"), F.when(F.col("valid") < VALID, "few valid answers")
    )
    return s.withColumn("reasons", why)


def probe_passes(s: DataFrame, error: Column) -> DataFrame:
    return s.withColumn("passes", error.isNull() & (F.col("degenerate") <= PROBE_DEGENERATE) & (F.col("valid") >= PROBE_VALID))
