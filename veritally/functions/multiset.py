"""Multisets of slots, row-local: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritally.functions.text import normalize_value


def pairs(slots: Column) -> Column:
    """Slots as comparable pairs with normalised values; null is the empty multiset."""
    none = F.array().cast("array<struct<type:string,value:string>>")
    return F.coalesce(F.transform(slots, lambda s: F.struct(s["type"].alias("type"), normalize_value(s["value"]).alias("value"))), none)


def common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda xs, u: F.size(F.filter(xs, lambda z: z == u))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, u: n + F.least(count(a, u), count(b, u)))


def counts(pred: Column, gold: Column) -> Column:
    """struct<tp, fp, fn>."""
    tp = common(pred, gold)
    return F.struct(tp.cast("long").alias("tp"), (F.size(pred) - tp).cast("long").alias("fp"), (F.size(gold) - tp).cast("long").alias("fn"))


def equal(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)
