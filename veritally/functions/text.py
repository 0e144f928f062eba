"""Text normalisation, markup, identifiers and token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: markup of a labelled span, ``[label : value]``; the first `` : `` ends the label.
MARKUP = r"\[([^\[\]]+?) : ([^\[\]]*)\]"


def normalize_value(x: Column) -> Column:
    """Lower case, every run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))


def loose(x: Column) -> Column:
    """Lower case without apostrophes; every run of anything but letters a-z and digits is one space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "['’`]", ""), "[^a-z0-9]+", " "))


def parse_markup(annotated: Column) -> Column:
    """struct<text, slots array<struct<type, value>>, empty_dropped, malformed>.

    Blank values are dropped from the slots and counted, though their text stays; a bracket left over makes the row malformed.
    """
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731 bound to a variable, so computed once

    def pair(span: Column) -> Column:
        cut = F.locate(" : ", span, 3)  # the label has a character at least
        return F.struct(F.trim(F.substring(span, F.lit(2), cut - 2)).alias("type"), F.trim(F.substring(span, cut + 3, F.length(span) - cut - 3)).alias("value"))

    def parsed(p: Column) -> Column:
        kept = F.filter(p["pairs"], lambda x: x["value"] != "")
        open_ = F.contains(p["text"], F.lit("[")) | F.contains(p["text"], F.lit("]"))
        return F.struct(p["text"].alias("text"), kept.alias("slots"), (F.size(p["pairs"]) - F.size(kept)).cast("long").alias("empty_dropped"), open_.alias("malformed"))

    pairs = F.transform(F.regexp_extract_all(annotated, F.lit(MARKUP), F.lit(0)), pair)
    return once(F.struct(F.regexp_replace(annotated, MARKUP, "$2").alias("text"), pairs.alias("pairs")), parsed)


def id_key(x: Column) -> tuple[Column, Column]:
    """Ids are strings that sort by length, then content."""
    return F.length(x), x


def token_estimate(x: Column) -> Column:
    """A quarter of the characters, rounded up, 1 at least; 0 for the empty text."""
    return F.when(F.length(x) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(x) / 4))).cast("long")


def prompt_token_estimate(contents: Column) -> Column:
    """Estimate for a list of message contents: 3 more for each message, and 3 to begin the answer."""
    return F.aggregate(contents, F.lit(3).cast("long"), lambda a, c: a + token_estimate(c) + 3)


def hash01(*parts: Column) -> Column:
    """A reproducible number in 0 .. 2^32-1 from the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def order_hash(*parts: Column) -> Column:
    """A reproducible sort key."""
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))


def run_name(*parts: Column) -> Column:
    return F.concat_ws("__", *parts)


def slug(x: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def price_key(name: Column, billing: Column) -> Column:
    """The key that a price is looked up by: the slug of the name with its billing."""
    return F.concat_ws("/", slug(name), F.lower(billing))


def format_percent(x: Column, digits: int = 1) -> Column:
    """A share as a percentage; never minus zero."""
    r = F.round(x * 100, digits)
    return F.concat(F.format_number(F.when(r == 0, F.lit(0.0)).otherwise(r), digits), F.lit(" %"))


def format_p(p: Column) -> Column:
    return F.when(p < 0.001, "<0.001").otherwise(F.format_number(p, 3))


def format_usd(x: Column) -> Column:
    """Cents from a dollar on, with thousands marked; three digits from ten cents on, four below."""
    return F.concat(F.lit("$"), F.when(x >= 1, F.format_number(x, 2)).when(x >= 0.1, F.format_number(x, 3)).otherwise(F.format_number(x, 4)))


def signed(x: Column, digits: int = 1) -> Column:
    """With its sign; what rounds to zero is plus zero."""
    r = F.bround(x, digits)
    return F.format_string(f"%+.{digits}f", F.when(r == 0, F.lit(0.0)).otherwise(r))


def format_difference(x: Column) -> Column:
    """A difference of shares in signed percentage points."""
    return F.concat(signed(x * 100), F.lit(" pp"))


def format_interval(value: Column, low: Column, high: Column) -> Column:
    """A share with its interval, in percent."""
    plain = lambda c: F.format_string("%.1f", c * 100)
    return F.concat(plain(value), F.lit("% ["), plain(low), F.lit(", "), plain(high), F.lit("]"))


def format_difference_interval(value: Column, low: Column, high: Column) -> Column:
    """A difference with its interval, in signed points."""
    return F.concat(format_difference(value), F.lit(" ["), signed(low * 100), F.lit(", "), signed(high * 100), F.lit("]"))


def format_points(half: Column) -> Column:
    """Half the width of an interval in percentage points."""
    return F.format_string("%.1f pp", half * 100)


def iso_time(epoch: Column) -> Column:
    """Seconds as a date and time in UTC; ``unknown`` for null. The session's time zone doesn't matter."""
    shown = F.date_format(F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=epoch.cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(F.concat(shown, F.lit(" UTC")), F.lit("unknown"))
