"""What the operators of this subpackage share: scratch tables, size-checked broadcasts, connected components."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.storage import scratch_path, small, written

__all__ = ["connected_components", "forest", "frugal", "lean", "scratch_path", "small", "strings", "written"]

#: Rows and bytes of the Arrow batches that go to Python workers.
BATCH_ROWS, BATCH_BYTES = 2000, "4m"


def frugal(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session, and so what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def release() -> None:
    """Gives freed memory back to the system; Spark keeps its Python workers, and they would keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """A function over Arrow batches, or over a group's table, that ends with `release`; the session it is planned in becomes `frugal`."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        frugal(spark)

    @functools.wraps(run)
    def over(batches):
        try:
            if isinstance(batches, pa.Table):
                return run(batches)
            return _each(run, batches)
        finally:
            if isinstance(batches, pa.Table):
                release()

    return over


def _each(run, batches):
    try:
        yield from run(batches)
    finally:
        release()


def strings(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    """A string column, invalid UTF-8 with replacement characters."""
    return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of the edges a-b that aren't the smallest of their component."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contract(batches):
    """Replaces a partition's edges by a spanning forest, batch by batch (memory: a batch)."""
    for batch in batches:
        u, v = forest(batch.column("u").to_numpy(zero_copy_only=False), batch.column("v").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Components of an undirected graph given as long columns u, v: a row (node, component) per node with an edge.

    ``component`` is the smallest node reachable. Alternating large-star and small-star steps (Kiveris et al., 2014) until
    nothing changes: O(log n) rounds of aggregations and equi-joins whose hot keys (hubs) Spark can split. Each round is a
    written table, so a lost executor costs one round at most. No edge reaches the driver. Loops and repeats are ignored.
    """
    cur = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(lean(_contract), "u long, v long").distinct(), name)
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        nxt = written(star.where("u <> v").distinct(), name)
        # done when each child has one parent, and no parent is a child
        open_ = nxt.groupBy("u").count().where("count > 1").select("u").union(nxt.select("u").join(nxt.select(F.col("v").alias("u")), "u", "left_semi"))
        if open_.limit(1).count() == 0:
            break
        cur = nxt
    roots = nxt.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nxt.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
