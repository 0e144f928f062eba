"""Segmented scans over range partitions: running values within keys of any size.

Rows are range-partitioned by (key, order, a hash of the row), so one key with all rows is many tasks. A scan runs within each piece (the rows of a key in one partition); the pieces' totals are combined
in their order, and what stands before a piece is carried into it. Only pieces that go on from another partition need a carry, so there are fewer carries than partitions (which
bounds their broadcast).

A scan is an associative combination: ``sum`` and ``max`` (nulls don't count), ``last`` (the last value that isn't null), and ``decay`` (y = keep * y + (1 - keep) * x from the key's first x on: affine
maps y -> a * y + b, which compose).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.storage import written

#: Rows whose decay is computed at once; keep ** -BLOCK must be a plain number.
BLOCK = 64


def lay(df: DataFrame, by: list[str], order: list[Column], name: str = "laid") -> DataFrame:
    """``df`` in order, as a table with ``_part``, the partition, and ``_at``, the place (ascending within a partition). Rows that are alike in everything may stand in any order among themselves."""
    plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    spread = [*map(F.col, by), *order, F.xxhash64(*plain)]
    dealt = df.repartitionByRange(*spread).sortWithinPartitions(*spread).withColumn("_part", F.spark_partition_id())
    return written(dealt.withColumn("_at", F.monotonically_increasing_id()), name)


def _same(by: list[str]) -> Column:
    """Rows and carries of one piece; null is a key like others."""
    return reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_k_{c}")), by, F.col("_part") == F.col("_p"))


def _carried(pieces: DataFrame, by: list[str], carries: dict[str, Column]) -> DataFrame:
    """Of the pieces that have another before them in their key: (_p, _k_.., and the carries)."""
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part")
    on = pieces.select("_part", *by, *(c.over(before.rowsBetween(Window.unboundedPreceding, -1)).alias(n) for n, c in carries.items()), F.row_number().over(before).alias("_n"))
    return F.broadcast(on.where("_n > 1").select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_k_{c}") for c in by), *carries))


def running(laid: DataFrame, by: list[str], scans: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """``laid`` (of `lay`) with a column per scan: name to (``sum``, ``max`` or ``last``, value), over the key's rows up to each row, or up to the one ``before`` it.

    The result is laid out alike, and so are some of its rows, so scans can follow on each other.
    """
    within = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    over = {"sum": F.sum, "max": F.max, "last": lambda x: F.last(x, ignorenulls=True)}
    total = {"sum": F.sum, "max": F.max, "last": lambda x: F.max_by(x, F.when(x.isNotNull(), F.col("_at")))}
    join = {"sum": lambda c, x: F.when(c.isNull(), x).otherwise(c + F.coalesce(x, F.lit(0))), "max": lambda c, x: F.greatest(c, x), "last": lambda c, x: F.coalesce(x, c)}
    pieces = laid.groupBy("_part", *by).agg(*(total[kind](x).alias(f"_c_{n}") for n, (kind, x) in scans.items()))
    carry = _carried(pieces, by, {f"_c_{n}": over[kind](F.col(f"_c_{n}")) for n, (kind, _) in scans.items()})
    local = laid.select("*", *(over[kind](x).over(within).alias(f"_l_{n}") for n, (kind, x) in scans.items()))
    both = local.join(carry, _same(by), "left")
    return both.select(*laid.columns, *(join[kind](F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (kind, _) in scans.items()))


def _decayed(x: np.ndarray, starts: np.ndarray, keep: float, y: float) -> np.ndarray:
    """y = keep * y + (1 - keep) * x, from 0 on at each of ``starts``; ``y`` goes on from the row before."""
    out = np.empty(len(x))
    cuts = np.unique([0, *starts, *range(0, len(x), BLOCK), len(x)])
    begins = set(starts.tolist())
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        y = 0.0 if a in begins else y
        power = keep ** np.arange(1, b - a + 1)
        out[a:b] = power * (y + np.cumsum(x[a:b] / power) * (1 - keep))
        y = out[b - 1]
    return out


def decaying(laid: DataFrame, by: list[str], value: str, keep: float, name: str) -> DataFrame:
    """``laid`` with ``name``: the decaying average of ``value`` (numbers, no nulls) over the key's rows up to each row. A key's first value stands for itself.

    Within a piece the average is taken from 0 on; the carry counts keep ** n at its n-th row. What a key's first piece carries is its first value.
    """

    kept = laid.columns

    def run(batches):
        last, y, length, first = None, 0.0, 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("_x").to_numpy(zero_copy_only=False)
            piece = list(zip(batch.column("_part").to_pylist(), batch.column("_key").to_pylist(), strict=True))
            starts = np.flatnonzero([p != q for p, q in zip(piece, [last, *piece], strict=False)])
            z = _decayed(x, starts, keep, y)
            begun = np.searchsorted(starts, np.arange(len(x)), "right") - 1
            at = np.concatenate([starts, [0]])[begun]  # rows before the first start (-1) go on from the last batch
            n = np.where(begun >= 0, np.arange(len(x)) - at + 1, np.arange(len(x)) + 1 + length)
            firsts = np.where(begun >= 0, x[at], first)
            last, y, length, first = piece[-1], z[-1], int(n[-1]), float(firsts[-1])
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(z), pa.array(n, pa.int64()), pa.array(firsts)], names=[*kept, "_z", "_n", "_first"])

    key = F.to_json(F.struct(*by)) if by else F.lit("")
    ordered = laid.select("*", key.alias("_key"), F.col(value).cast("double").alias("_x")).repartition("_part").sortWithinPartitions("_part", "_at")
    schema = ", ".join(f"`{c}` {t}" for c, t in [*laid.dtypes, ("_z", "double"), ("_n", "bigint"), ("_first", "double")])
    local = written(ordered.mapInArrow(run, schema), "decaying")
    pieces = local.groupBy("_part", *by).agg(F.struct(F.max("_n").alias("n"), F.max_by("_z", "_at").alias("z"), F.min_by("_first", "_at").alias("first")).alias("_map"))
    then = lambda y, m: F.pow(F.lit(keep), m["n"]) * y + m["z"]
    carry = _carried(pieces, by, {"_maps": F.collect_list("_map")})  # fewer maps than partitions
    both = local.join(carry, _same(by), "left").withColumn("_carry", F.coalesce(F.aggregate("_maps", F.element_at("_maps", 1)["first"], then), "_first"))
    return both.select(*laid.columns, (F.col("_z") + F.pow(F.lit(keep), "_n") * F.col("_carry")).alias(name))
