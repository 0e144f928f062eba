"""Prices of calls, of hours, and where they meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
HOURS_PER_MONTH = 730
TOKENS_PER_UNIT = 1_000_000.0


def call_cost(prompt: Column, completion: Column, cached: Column, price_in: Column, price_out: Column, price_cached: Column) -> Column:
    """USD of a call; cached tokens (0 if unknown) count at most as many as the prompt has; without a cached price the input price holds.

    Null where the usage is incomplete.
    """
    hit = F.greatest(F.lit(0), F.least(F.coalesce(cached, F.lit(0)), prompt))
    return ((prompt - hit) * price_in + hit * F.coalesce(price_cached, price_in) + completion * price_out) / TOKENS_PER_UNIT


def cost_bounds(prompt: Column, completion: Column, prefix: Column, price_in: Column, price_out: Column, price_cached: Column) -> tuple[Column, Column]:
    """(upper, lower): nothing cached, and the shared prefix always cached."""
    zero = F.lit(0)
    return call_cost(prompt, completion, zero, price_in, price_out, price_cached), call_cost(prompt, completion, prefix, price_in, price_out, price_cached)


def per_thousand(total: Column, n: Column) -> Column:
    return F.try_divide(total.cast("double"), n) * 1000


def hosted_per_thousand(usd_per_hour: Column, requests_per_s: Column) -> Column:
    """Null without throughput."""
    return F.when(requests_per_s > 0, usd_per_hour / (requests_per_s * 3600) * 1000)


def break_even_calls(usd_per_hour: Column, cost_per_call: Column) -> Column:
    """Calls a month at which renting costs as much; null for a free call."""
    return F.when(cost_per_call > 0, usd_per_hour * HOURS_PER_MONTH / cost_per_call)


def monthly_capacity(requests_per_s: Column) -> Column:
    return requests_per_s * 3600 * HOURS_PER_MONTH
