"""Hand-computed values of the column functions."""

import pytest
from pyspark.sql import functions as F

from veritally.functions import calls, cost, headers, multiset, stats, text


@pytest.fixture
def value(spark):
    def of(column, **given):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()] or [F.lit(1).alias("_")])
        return row.select(column.alias("x")).first()["x"]

    return of


SLOTS = "array<struct<type:string,value:string>>"


def slots(pairs):
    return F.array(*(F.struct(F.lit(t).alias("type"), F.lit(v).alias("value")) for t, v in pairs)).cast(SLOTS) if pairs is not None else F.lit(None).cast(SLOTS)


@pytest.mark.parametrize(
    ("pred", "gold", "want"),
    [([("size", "m")] * 3, [("size", "m")] * 2, (2, 1, 0)), ([("p", "u"), ("q", "v")], [("q", "v"), ("q", "w"), ("r", "u")], (1, 1, 2)), (None, None, (0, 0, 0)), ([], [("k", "v"), ("k", "v")], (0, 0, 2)), ([("k", "Two \t Words")], [("k", "two words")], (1, 0, 0)), ([("x", "x"), ("x", "x"), ("y", "y")], [("x", "x"), ("z", "z"), ("x", "x"), ("x", "x")], (2, 1, 2))],
)
def test_multiset_counts(value, pred, gold, want):
    r = value(multiset.counts(multiset.pairs(slots(pred)), multiset.pairs(slots(gold))))
    assert tuple(r) == want


def test_normal_forms(value):
    assert value(text.normalize_value(F.lit("  Six  \tAM\n"))) == "six am"
    assert value(text.loose(F.lit("What's-up, DOC?! `x’y"))) == "whats up doc xy"
    assert value(text.token_estimate(F.lit(""))) == 0 and value(text.token_estimate(F.lit("abcde"))) == 2 and value(text.token_estimate(F.lit("a"))) == 1
    assert value(text.slug(F.lit("  GPU T4 / (x2) "))) == "gpu-t4-x2" and value(text.price_key(F.lit("A b"), F.lit("Paid"))) == "a-b/paid"
    assert value(text.format_percent(F.lit(-0.0001))) == "0.0 %" and value(text.format_p(F.lit(0.0001))) == "<0.001" and [value(text.format_usd(F.lit(x))) for x in (98765.4, 51.37, 1.0, 0.875, 0.1, 0.0421, 0.0)] == ["$98,765.40", "$51.37", "$1.00", "$0.875", "$0.100", "$0.0421", "$0.0000"]
    assert [value(text.format_difference(F.lit(x))) for x in (0.1278, -0.0534, -0.0001, 0.0)] == ["+12.8 pp", "-5.3 pp", "+0.0 pp", "+0.0 pp"]
    assert value(text.format_difference_interval(F.lit(0.017), F.lit(-0.008), F.lit(0.041))) == "+1.7 pp [-0.8, +4.1]" and value(text.format_interval(F.lit(0.735), F.lit(0.701), F.lit(0.768))) == "73.5% [70.1, 76.8]"


@pytest.mark.parametrize(
    ("annotated", "plain", "found", "dropped", "malformed"),
    [
        ("send [count : two boxes] to [city : Old Town] now", "send two boxes to Old Town now", [("count", "two boxes"), ("city", "Old Town")], 0, False),
        ("mix [ratio : 3 : 1 : 2] well", "mix 3 : 1 : 2 well", [("ratio", "3 : 1 : 2")], 0, False),
        ("a [x : ] b [y :  ] c", "a  b   c", [], 2, False),
        ("[a : 1] [a : 1]", "1 1", [("a", "1"), ("a", "1")], 0, False),
        ("plain", "plain", [], 0, False),
        ("broken [a : b", "broken [a : b", [], 0, True),
    ],
)
def test_markup(value, annotated, plain, found, dropped, malformed):
    r = value(text.parse_markup(F.lit(annotated)))
    assert (r["text"], [tuple(s) for s in r["slots"]], r["empty_dropped"], r["malformed"]) == (plain, found, dropped, malformed)


def test_nearest_rank(spark):
    from veritally.operators.ranks import percentiles, with_rank

    df = spark.createDataFrame([("a", float(v)) for v in (3, 8, 21, 34, 89, 144, 233)] + [("b", float(v)) for v in range(1, 41)] + [("b", None)], "g string, v double")
    got = {r["g"]: r for r in percentiles(df, "v", ["g"], [0, 14, 15, 50, 85, 86, 95, 100]).collect()}
    assert [got["a"][f"p{q}"] for q in (0, 14, 15, 50, 85, 86, 100)] == [3, 3, 8, 34, 144, 233, 233] and got["b"]["p95"] == 38
    hundred = spark.range(1, 101).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("g"))
    assert percentiles(hundred, "v", ["g"], [7]).first()["p7"] == 7
    ranked = with_rank(spark.range(1000).repartition(7), [F.col("id").desc()])
    assert all(r["rank"] == 1000 - r["id"] for r in ranked.collect())
    with pytest.raises(ValueError, match="percentile"):
        stats.nearest_rank(F.lit(1), 101)


@pytest.mark.parametrize(("a", "b", "p"), [(10, 0, 2 / 1024), (8, 2, 0.109375), (6, 6, 1.0), (0, 0, 1.0), (1500, 1400, 0.0659873)])
def test_mcnemar(value, a, b, p):
    assert value(stats.mcnemar(F.lit(a), F.lit(b))) == pytest.approx(p, rel=1e-5)


def test_costs(value):
    n = F.lit(None).cast("double")
    usage = F.lit(1000), F.lit(100)
    up, low = cost.cost_bounds(*usage, F.lit(800), F.lit(1.0), F.lit(2.0), F.lit(0.25))
    assert value(up) == pytest.approx(0.0012) and value(low) == pytest.approx(0.0006)
    assert value(cost.call_cost(*usage, F.lit(5000), F.lit(2.0), F.lit(4.0), n)) == pytest.approx(0.0024)
    assert value(cost.hosted_per_thousand(F.lit(0.526), F.lit(0.7903))) == pytest.approx(0.18488, rel=1e-4)
    assert value(cost.hosted_per_thousand(F.lit(0.526), F.lit(0.0))) is None and value(cost.break_even_calls(F.lit(0.5), F.lit(0.0))) is None
    assert value(cost.monthly_capacity(F.lit(0.7903))) == pytest.approx(2_076_908, rel=1e-4)
    assert value(cost.per_thousand(F.lit(1.5), F.lit(0))) is None


GOOD = ['{"intent":"a","slots":[]}', ' {"intent":"a","slots":[{"type":"t","value":"v"}]} \n', '```json\n{"intent":"a","slots":[]}\n```', "```\n{\"intent\":\"a\",\"slots\":[]}```", '{"slots":[],"intent":"é"}', '{"intent":"x","intent":"a","slots":[]}']
NOT_OBJECTS = [None, "", "no", 'Sure: {"intent":"a","slots":[]}', '{"intent":"a","slots":[]} done', '{"intent":"a","slots":[]}{"intent":"a","slots":[]}', '[{"intent":"a","slots":[]}]', '"text"', '{"intent":"a",', '{"a":1},"#"] x']
NOT_CALLS = ['{"intent":5,"slots":[]}', '{"intent":"a"}', '{"slots":[]}', '{"intent":"a","slots":[],"x":1}', '{"intent":"a","slots":{}}', '{"intent":"a","slots":[1]}', '{"intent":"a","slots":[{"type":"t"}]}', '{"intent":"a","slots":[{"type":"t","value":1}]}', '{"intent":"a","slots":[{"type":"t","value":"v","z":0}]}', '{"intent":null,"slots":[]}', '{"intent":"a","slots":[{"type":"t","value":"v"},{"type":"t"}]}', '{"intent":"a","slots":null}']


def test_calls(spark):
    rows = [(t, True, True) for t in GOOD] + [(t, False, False) for t in NOT_OBJECTS] + [(t, True, False) for t in NOT_CALLS]
    df = spark.createDataFrame(rows, "t string, obj boolean, ok boolean")
    for r in df.select("*", calls.parse_object(F.col("t")).isNotNull().alias("got_obj"), calls.is_valid_call(F.col("t")).alias("got")).collect():
        assert (r["got_obj"], r["got"]) == (r["obj"], r["ok"]), r["t"]
    known = calls.is_valid_call(F.col("t"), F.array(F.lit("a")), F.array(F.lit("q")))
    assert [r[0] for r in spark.createDataFrame([(GOOD[0],), (GOOD[1],), (GOOD[4],)], "t string").select(known).collect()] == [True, False, False]


def test_target_round_trip(spark):
    df = spark.createDataFrame([("ï\"", [("t", "v\\é")])], f"intent string, slots {SLOTS}")
    j = df.select("*", calls.target_json(F.col("intent"), F.col("slots")).alias("t"))
    r = j.select("intent", "slots", calls.call_of(F.col("t")).alias("c"), "t").first()
    assert r["c"]["intent"] == r["intent"] and r["c"]["slots"] == r["slots"] and r["t"] == '{"intent":"ï\\"","slots":[{"type":"t","value":"v\\\\é"}]}'


def test_headers(value):
    assert value(headers.duration_seconds(F.lit("1m30.5s"), F.lit(0.0))) == 90.5
    assert value(headers.backoff_seconds(F.lit(10), F.lit(1.0), F.lit(None).cast("double"))) == 60.0
    assert value(headers.retry_after_seconds(F.lit(" "), F.lit(0.0))) is None


def test_usage_fields(value):
    from veritally.functions import calls

    def usage(json, **options):
        return tuple(value(calls.usage_of(F.try_parse_json(F.lit(json)), **options)))

    assert usage('{"usage":{"prompt_cache_hit_tokens":3,"cached_tokens":7}}') == (None, None, 3, None, True)
    assert usage('{"usage":{"cached_tokens":7,"prompt_cache_hit_tokens":true}}') == (None, None, 7, None, True)
    assert usage('{"usage":{"prompt_tokens":"10","completion_tokens":2.0,"prompt_tokens_details":{"cached_tokens":2.9}}}') == (10, 2, 2, None, True)
    assert usage('{"usage":{"prompt_tokens":"1.5","completion_tokens":false,"prompt_tokens_details":[1]}}') == (None, None, None, None, True)
    assert usage('{"usage":[1]}') == usage("{}") == usage('{"usage":null}') == (None, None, None, None, False)
    assert usage('{"usage":{"completion_tokens":4,"completion_tokens_details":{"reasoning_tokens":" 5 "}}}', reasoning_inside=False) == (None, 9, None, 5, True)
