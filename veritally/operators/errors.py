"""What answers get wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions import multiset


def unmatched(pred: Column, gold: Column) -> Column:
    """struct<missing, extra>: sizes of the multiset differences."""
    both = multiset.common(pred, gold)
    return F.struct((F.size(gold) - both).cast("long").alias("missing"), (F.size(pred) - both).cast("long").alias("extra"))


def _place(x: Column, i: Column, xs: Column, like) -> Column:
    """How many elements before the i-th (from 0) of ``xs`` are like it."""
    return F.size(F.filter(xs, lambda y, j: (j < i) & like(y, x)))


def _surplus(xs: Column, ys: Column, like) -> Column:
    """The elements of ``xs`` that are left if each takes an element of ``ys`` that is like it, the first the first."""
    return F.filter(xs, lambda x, i: _place(x, i, xs, like) >= F.size(F.filter(ys, lambda y: like(y, x))))


def _taken(xs: Column, ys: Column, like, say) -> Column:
    """``say`` of each element of ``xs`` and of the one of ``ys`` that it takes."""
    pairs = F.transform(xs, lambda x, i: F.struct(x.alias("x"), F.get(F.filter(ys, lambda y: like(y, x)), _place(x, i, xs, like)).alias("y")))
    return F.transform(F.filter(pairs, lambda p: p["y"].isNotNull()), lambda p: say(p["x"], p["y"]))


def explain(pred: Column, gold: Column) -> Column:
    """Lines on what a prediction's slots lack and have too much: pairs of one type with another value, then pairs of one value with another type, then the rest; each in the order of type and value.

    Slots are array<struct<type, value>> (null: none). Within a type (or value) the first missing slot goes with the first extra one, so pairs follow from places alone.
    """
    slots = lambda s: F.array_sort(F.transform(F.coalesce(s, F.array().cast("array<struct<type:string,value:string>>")), lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"))))
    bound = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731 computed once
    same, by_type, by_value = (lambda a, b: a == b), (lambda a, b: a["type"] == b["type"]), (lambda a, b: a["value"] == b["value"])
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    # The forms of the lines.
    value_differs = lambda m, e: text(m["type"], " '", e["value"], "' (gold '", m["value"], "')")
    type_differs = lambda m, e: text("'", m["value"], "' as ", e["type"], " (gold ", m["type"], ")")
    left_out = lambda kind: lambda x: text(kind + " ", x["type"], "=", x["value"])

    both = lambda m, e: F.struct(m.alias("missing"), e.alias("extra"))
    first = bound(both(slots(gold), slots(pred)), lambda s: both(_surplus(s["missing"], s["extra"], same), _surplus(s["extra"], s["missing"], same)))

    def lines(d: Column) -> Column:
        rest = both(_surplus(d["missing"], d["extra"], by_type), _surplus(d["extra"], d["missing"], by_type))
        then = lambda r: F.concat(
            _taken(r["missing"], r["extra"], by_value, type_differs),
            F.transform(_surplus(r["missing"], r["extra"], by_value), left_out("missing")),
            F.transform(_surplus(r["extra"], r["missing"], by_value), left_out("extra")),
        )
        return F.concat(_taken(d["missing"], d["extra"], by_type, value_differs), bound(rest, then))

    return bound(first, lines)


def differences(pred_intent: Column, intent: Column, pred: Column, gold: Column, valid: Column) -> Column:
    """One line on what is wrong; ``none`` for an exact match."""
    wrong = F.when(~pred_intent.eqNullSafe(intent), F.concat(F.lit("intent "), F.coalesce(pred_intent, F.lit("none")), F.lit(" (gold "), intent, F.lit(")")))
    notes = F.concat_ws("; ", wrong, F.nullif(F.array_join(explain(pred, gold), "; "), F.lit("")))
    return F.when(~valid, "no valid answer").when(notes == "", "none").otherwise(notes)


def category_counts(rows: DataFrame, col: str) -> DataFrame:
    """Counts per category, blanks as ``(blank)``."""
    name = F.coalesce(F.nullif(F.trim(F.col(col)), F.lit("")), F.lit("(blank)"))
    return rows.groupBy(name.alias("category")).agg(F.count("*").alias("n"))


def answer_text(text: Column, valid: Column, failed: Column) -> Column:
    return F.when(valid, text).when(failed, "(no answer: the call failed)").otherwise("(invalid output)")
