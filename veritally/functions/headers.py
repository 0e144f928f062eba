"""Durations, retry hints and quota hints from response headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a unit.
UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}
# Fixed value: a number with its unit.
_PART = r"(\d+(?:\.\d+)?)(ms|s|m|h|d)"
#: Fixed value: what hints at a daily quota.
DAILY = r"(?i)per[\s_-]*day|daily|\bRPD\b|\bTPD\b"
# Fixed value: above it a number is a time, not a duration.
_EPOCH = 1e9


def _known(unit: Column) -> Column:
    return F.coalesce(*(F.when(unit == u, F.lit(s)) for u, s in UNITS.items()))


def duration_seconds(x: Column, now: Column) -> Column:
    """``1m30.5s``, ``250ms``, seconds, or an epoch above 1e9 as what is left until then; null if not understood as a whole."""
    t = F.lower(F.trim(x))
    number = t.try_cast("double")
    plain = F.greatest(F.lit(0.0), F.when(number > _EPOCH, number - now).otherwise(number))
    sizes = F.transform(F.regexp_extract_all(t, F.lit(_PART), F.lit(1)), lambda n: n.cast("double"))
    units = F.regexp_extract_all(t, F.lit(_PART), F.lit(2))
    total = F.aggregate(F.zip_with(sizes, units, lambda n, u: n * _known(u)), F.lit(0.0), lambda a, b: a + b)
    read = F.array_join(F.regexp_extract_all(t, F.lit(_PART), F.lit(0)), "")
    whole = (read != "") & (read == F.replace(t, F.lit(" "), F.lit("")))
    return F.when(number.isNotNull(), plain).when(whole, total)


def retry_after_seconds(x: Column, now: Column) -> Column:
    """Seconds, or an HTTP date, from now; never below 0; null if unreadable."""
    t = F.trim(x)
    date = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(t, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))).cast("double")
    wait = F.coalesce(t.try_cast("double"), date - now)
    return F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait))


def limit_headers(headers: Column) -> Column:
    """The rate limit and retry headers, with lower-case names."""
    lower = F.transform_keys(headers, lambda k, _: F.lower(k))
    return F.map_filter(lower, lambda k, _: k.startswith("x-ratelimit") | (k == "retry-after"))


def reset_seconds(headers: Column, now: Column) -> Column:
    """The retry header, else the longest reset among limits with nothing (or nothing said to be) left."""
    resets = F.map_filter(headers, lambda k, _: k.startswith("x-ratelimit-reset") & F.coalesce(headers[F.replace(k, F.lit("-reset"), F.lit("-remaining"))].isin("0", "0.0"), F.lit(True)))
    longest = F.array_max(F.transform(F.map_values(resets), lambda v: duration_seconds(v, now)))
    return F.coalesce(retry_after_seconds(headers["retry-after"], now), longest)


def daily_quota(body: Column) -> Column:
    return F.coalesce(body.rlike(DAILY), F.lit(False))


def backoff_seconds(attempt: Column, uniform: Column, hint: Column) -> Column:
    """Exponential up to a minute with jitter, and no less than the hint (two minutes at most)."""
    wait = F.least(F.lit(60.0), F.pow(F.lit(2.0), attempt - 1)) * (0.5 + uniform / 2)
    return F.greatest(wait, F.least(F.coalesce(hint, F.lit(0.0)), F.lit(120.0)))
