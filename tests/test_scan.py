"""Segmented scans against plain loops: keys of all sizes, one key with all rows, many partitions."""

import random

import pytest
from pyspark.sql import functions as F

from veritally.operators import runlog, scan

SCHEMA = "key string, pos long, x double, m string, f boolean"


def rows_of(seed, n, keys):
    rng = random.Random(seed)
    return [(rng.choice(keys), i, float(rng.randint(0, 9)), rng.choice([None, None, "a", "b"]), rng.random() < 0.6) for i in range(n)]


@pytest.fixture
def many(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


@pytest.mark.parametrize("keys", [["one"], ["a", "b", None], [f"k{i}" for i in range(200)]])
def test_running(spark, many, keys):
    rows = rows_of(len(keys), 700, keys)
    laid = scan.lay(spark.createDataFrame(rows, SCHEMA), ["key"], [F.col("pos")])
    if keys == ["one"]:
        assert laid.select("_part").distinct().count() == 13
    got = scan.running(laid, ["key"], {"s": ("sum", F.col("x")), "n": ("sum", F.lit(1)), "top": ("max", F.when(~F.col("f"), F.col("x"))), "l": ("last", F.col("m"))})
    got = scan.running(got, ["key"], {"prev": ("last", F.col("m"))}, before=True)
    got = {r.pos: r for r in scan.decaying(got, ["key"], "x", 0.8, "ema").collect()}
    state = {}
    assert len(got) == len(rows)
    for key, pos, x, m, f in rows:
        s, n, top, last, ema = state.get(key, (0, 0, None, None, x))
        assert got[pos].prev == last
        top = x if not f and (top is None or x > top) else top
        state[key] = s, n, top, last, ema = s + x, n + 1, top, m or last, 0.8 * ema + 0.2 * x
        r = got[pos]
        assert (r.s, r.n, r.top, r.l) == (s, n, top, last) and r.ema == pytest.approx(ema)


def test_without_key_and_empty(spark, many):
    rows = rows_of(5, 300, ["z"])
    laid = scan.lay(spark.createDataFrame(rows, SCHEMA), [], [F.col("pos")])
    got = scan.decaying(scan.running(laid, [], {"s": ("sum", F.col("x"))}), [], "x", 0.5, "e").orderBy("pos").collect()
    total, e = 0, rows[0][2]
    for r, row in zip(got, rows, strict=True):
        total, e = total + row[2], 0.5 * e + 0.5 * row[2]
        assert r.s == total and r.e == pytest.approx(e)
    none = scan.lay(spark.createDataFrame([], SCHEMA), ["key"], [F.col("pos")])
    assert scan.decaying(scan.running(none, ["key"], {"s": ("sum", F.col("x"))}), ["key"], "x", 0.8, "e").count() == 0


def test_run_log_of_one_key(spark, many):
    """All rows under one key, over many partitions: segments, windows, streaks, spend, ageing and averages."""
    rng = random.Random(3)
    at, rows = 0, []
    for i in range(600):
        at += rng.choice([0, 0, 5_000_000, 40_000_000])
        rows.append((7, i, at, rng.choice(["a", "a", "b", None]), rng.random() < 0.7, i % 13 + 1))
    log = spark.createDataFrame(rows, "key long, pos long, at_us long, model string, failed boolean, tokens long")
    budget = {r.pos: (r.requests, r.window_tokens) for r in runlog.budgets(log, runlog.MINUTE_US).collect()}
    for r in rows:
        inside = [q for q in rows if r[2] - 60_000_000 < q[2] <= r[2]]
        assert budget[r[1]] == (len(inside), sum(q[5] for q in inside))
    best = run = 0
    stopped = None
    for r in rows:
        run = run + 1 if r[4] else 0
        best = max(best, run)
        stopped = r[1] if run >= 4 and stopped is None else stopped
    s = runlog.streaks(log, 4).first()
    assert (s.longest, s.stopped_at) == (best, stopped)
    want, place = [], 0
    for r in rows:
        if r[4]:
            continue
        place += 1
        if r[3] is None:
            continue
        if want and want[-1][0] == r[3]:
            want[-1][1:] = [want[-1][1] + 1, want[-1][2], place]
        else:
            want.append([r[3], 1, place, place])
    got = [[r.model, r.rows, r.first_row, r.last_row] for r in runlog.segments(log).orderBy("segment").collect()]
    assert got == want
    total = 0
    for r in runlog.spend(log, F.lit(0.5), 100.0, 250).orderBy("pos").collect():
        total += 0.5
        assert r.total == total and r.stop == (total >= 100 or r.calls >= 5 and total + 0.5 * max(0, 250 - r.calls) > 100)
    run = 0
    for r in rows:
        run += r[5]
        if run >= 500:
            break
    assert runlog.frees_at(log, 500, 1000).first().frees_at_us == r[2] + 1000
    e = float(rows[0][5])
    for r in rows[1:]:
        e = e * 0.8 + r[5] * 0.2
    assert runlog.output_average(log, 512).first().average == pytest.approx(e, abs=1e-6)
