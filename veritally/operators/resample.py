"""Bootstrap intervals and paired comparisons.

Design A gives each row its multiplicity in each resample by a hash, in one pass over the rows; any engine with MD5 and integers gives the same. Design B draws with numpy's PCG64 in blocks
of 250 resamples, for parity with figures that were published from it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions.stats import f1, mcnemar, precision, ratio, recall
from veritally.functions.text import hash01
from veritally.operators.ranks import with_rank
from veritally.storage import small

# Fixed values.
SEED, RESAMPLES, BLOCK = 20261001, 10_000, 250

#: Prime of the hash that draws multiplicities.
PRIME = (1 << 31) - 1
#: A row with a draw below PRIME * cdf(k) of the Poisson distribution of mean 1 is in a resample k times at most.
BOUNDS = tuple(math.floor(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10))
#: Rows of a task that meet all resamples at once.
ROWS = 64

#: Statistics of weighted sums: the sum of weights, and those of the columns.
STATISTICS: dict[str, Callable[..., Column]] = {
    "mean": lambda w, x: F.try_divide(x.cast("double"), w.cast("double")),
    "ratio": lambda w, a, b: F.when(w > 0, ratio(a, b)),
    "precision": lambda w, tp, fp: F.when(w > 0, precision(tp, fp)),
    "recall": lambda w, tp, fn: F.when(w > 0, recall(tp, fn)),
    "f1": lambda w, tp, fp, fn: F.when(w > 0, f1(tp, fp, fn)),
}


def _number(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def multiplicities(x: np.ndarray, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How often each row (``x``, hashed) is in each resample (``a``, ``c``): rows by resamples."""
    h = x[:, None] * a[None] + c[None]
    for _ in range(2):
        h = (h & PRIME) + (h >> 31)
    h[h == PRIME] = 0
    out = np.zeros(h.shape, np.uint8)
    for bound in BOUNDS:
        more = h >= bound
        if not more.any():
            break
        out += more
    return out


def resampled(rows: DataFrame, order: list[Column], cols: list[str], resamples: int, seed: int = SEED, by: list[str] | None = None) -> DataFrame:
    """(by, _b, _w, sums of ``cols``): each resample's number of rows and weighted sums.

    Every row is in every resample so often as a hash of its place in ``order`` and of the resample says (Poisson, mean 1). A task adds its rows to one vector per sum, and vectors merge by addition: what
    leaves a task is of the number of resamples, and neither rows times resamples nor draws are made into rows. ``by`` are few groups (systems, say).
    """
    by = by or []
    spark = rows.sparkSession
    plain = rows.select(*by, *(F.col(c).cast("double").alias(f"_s{i}") for i, c in enumerate(cols)), *(o.alias(f"_o{i}") for i, o in enumerate(order)))
    numbered = with_rank(plain, [F.col(f"_o{i}") for i in range(len(order))], name="_pos")
    hashed = numbered.select(F.to_json(F.struct(*by)).alias("_g") if by else F.lit("").alias("_g"), F.pmod(hash01(F.lit(seed), F.col("_pos") - 1), F.lit(PRIME)).alias("_x"), F.array(*(f"_s{i}" for i in range(len(cols)))).alias("_v"))
    draws = spark.sparkContext.broadcast((np.array([1 + _number(seed, "a", b) % (PRIME - 1) for b in range(resamples)]), np.array([_number(seed, "c", b) % PRIME for b in range(resamples)])))
    names = ["_g", "_b", "_w", *(f"_s{i}" for i in range(len(cols)))]

    def hand(group, sums):
        columns = [pa.array([group] * resamples), pa.array(np.arange(resamples)), *(pa.array(np.ascontiguousarray(sums[:, i])) for i in range(len(cols) + 1))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        a, c = draws.value
        held = {}
        for batch in batches:
            group, x = np.array(batch.column("_g").to_pylist()), batch.column("_x").to_numpy()
            v = np.array(batch.column("_v").to_pylist(), np.float64).reshape(len(x), len(cols))
            for g in np.unique(group) if len(x) else ():
                mine = np.flatnonzero(group == g)
                if g not in held and len(held) >= 64:
                    yield hand(*held.popitem())
                sums = held.setdefault(str(g), np.zeros((resamples, len(cols) + 1)))
                for k in range(0, len(mine), ROWS):
                    at = mine[k : k + ROWS]
                    sums += multiplicities(x[at], a, c).T.astype(np.float64) @ np.column_stack([np.ones(len(at)), v[at]])
        for g, sums in held.items():
            yield hand(g, sums)

    schema = ", ".join(f"{n} {t}" for n, t in zip(names, ["string", "long", *["double"] * (len(cols) + 1)], strict=True))
    sums = hashed.mapInArrow(run, schema).groupBy("_g", "_b").agg(*(F.sum(n).alias(n) for n in names[2:]))
    groups = [F.from_json("_g", rows.select(*by).schema)[c].alias(c) for c in by]
    return sums.select(*groups, "_b", "_w", *(F.col(f"_s{i}").alias(c) for i, c in enumerate(cols)))


def _checked(rows: DataFrame) -> DataFrame:
    if rows.limit(1).count() == 0:
        raise ValueError("no rows to resample")
    return rows


def interval(rows: DataFrame, order: list[Column], statistic: str, cols: list[str], resamples: int, seed: int = SEED, confidence: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """One row (per group): n, value, low, high of a statistic of ``cols``; linear quantiles of its resamples. A resample without rows has no value."""
    by = by or []
    stat = STATISTICS[statistic]
    per = resampled(_checked(rows), order, cols, resamples, seed, by).select(*by, stat(F.col("_w"), *map(F.col, cols)).alias("s"))
    tail = (1 - confidence) / 2
    ci = per.groupBy(*by).agg(F.percentile("s", F.lit(tail)).alias("low"), F.percentile("s", F.lit(1 - tail)).alias("high"))
    all_ = rows.groupBy(*by).agg(F.count("*").alias("n"), stat(F.count("*"), *(F.sum(c) for c in cols)).alias("value"))
    return all_.join(small(ci), by) if by else all_.crossJoin(F.broadcast(ci))


def paired(rows: DataFrame, order: list[Column], a: str, b: str, resamples: int, seed: int = SEED) -> DataFrame:
    """One row: the difference of means a - b on the same resamples, its interval, the bootstrap p, and McNemar's exact p of the two 0/1 columns."""
    per = resampled(_checked(rows), order, [a, b], resamples, seed).select(F.try_divide(F.col(a) - F.col(b), F.col("_w")).alias("s"))
    least = F.least(F.count_if(F.col("s") <= 0), F.count_if(F.col("s") >= 0))
    ci = per.agg(F.percentile("s", F.lit(0.025)).alias("low"), F.percentile("s", F.lit(0.975)).alias("high"), F.least(F.lit(1.0), 2.0 * (least + 1) / (resamples + 1)).alias("bootstrap_p"))
    only = lambda x, y: F.count_if((F.col(x) == 1) & (F.col(y) == 0))
    totals = rows.agg(F.count("*").alias("n"), (F.avg(a) - F.avg(b)).alias("difference"), only(a, b).alias("a_only"), only(b, a).alias("b_only"))
    return totals.withColumn("mcnemar_p", mcnemar(F.col("a_only"), F.col("b_only"))).crossJoin(F.broadcast(ci))


def resampled_sql(rows: str, cols: list[str], resamples: int, by: tuple[str, ...] = ()) -> str:
    """The same as common table expressions: ``s`` (by, _b, w, sums) of a relation ``rows`` with ``pos`` from 0."""
    number = lambda *parts: f"('0x' || substr(md5('{SEED}:' || {' || '.join(parts)}), 1, 8))::BIGINT"
    times = "CASE " + " ".join(f"WHEN h < {bound} THEN {k}" for k, bound in enumerate(BOUNDS)) + f" ELSE {len(BOUNDS)} END"
    return f"""_x AS (SELECT *, {number("pos")} % {PRIME} AS _x FROM {rows}),
_k AS (SELECT _b, 1 + {number("'a:'", "_b")} % {PRIME - 1} AS _a, {number("'c:'", "_b")} % {PRIME} AS _c FROM range({resamples}) r(_b)),
_h AS (SELECT _x.*, _b, (_x * _a + _c) % {PRIME} AS h FROM _x, _k), _m AS (SELECT *, {times} AS m FROM _h),
s AS (SELECT {"".join(f"{c}, " for c in by)}_b, sum(m) AS w, {", ".join(f"sum(m * {c}) AS {c}" for c in cols)} FROM _m GROUP BY ALL)"""


def numpy_interval(rows: DataFrame, order: list[Column], col: str, resamples: int = RESAMPLES, seed: int = SEED, confidence: float = 0.95) -> DataFrame:
    """Design B for a mean: (value, low, high). The evaluation set's column (one number a row) is one array in one task, as the draws need all of it."""
    seq = with_rank(rows.select(F.col(col).cast("double").alias("_x"), *(c.alias(f"_o{i}") for i, c in enumerate(order))), [F.col(f"_o{i}") for i in range(len(order))], name="_pos").select("_pos", "_x")

    def run(table: pa.Table) -> pa.Table:
        x = table.sort_by("_pos").column("_x").to_numpy()
        rng, parts = np.random.default_rng(seed), []
        for start in range(0, resamples, BLOCK):
            parts.append(x[rng.integers(0, len(x), size=(min(BLOCK, resamples - start), len(x)))].mean(axis=1))
        tail = (1 - confidence) / 2
        low, high = np.quantile(np.concatenate(parts), [tail, 1 - tail])
        return pa.table({"value": [float(x.mean())], "low": [float(low)], "high": [float(high)]})

    return seq.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(run, "value double, low double, high double")
