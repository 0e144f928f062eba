"""A metric index for nearest neighbours by cosine: cells around pivots, skipped by the triangle inequality of angles.

Vectors are assigned to the nearest of ``pivots`` index vectors (those with the smallest hashes) and laid out by (cell, angle to the pivot). For a query at angle a to a pivot, a vector at angle r to it is at an angle of at
least |a - r|. A first pass compares each query with the cells nearest to it that hold k vectors; its k-th score bounds the angle within which better ones lie, and a second pass compares only cells, and within them only
the range of r, that can hold one. The result is that of comparing all with all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.operators.retrieval import QUERY_BLOCK
from veritally.storage import written

#: Pivots at most; what is sent to the executors and what the driver holds of the index is in proportion to them.
PIVOTS = 2048
#: Angles are compared with this much to spare for rounding.
SPARE = 1e-7


def _unit(column) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    s = np.sqrt((x * x).sum(axis=1))
    return x / np.where(s == 0, 1, s)[:, None]


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


class Neighbours:
    """The index of ``vectors`` (id long, v array of numbers, all of one length). A zero vector has cosine 0 with all and is compared with every query."""

    def __init__(self, vectors: DataFrame, pivots: int | None = None):
        spark = vectors.sparkSession
        n = vectors.count()
        many = min(PIVOTS, pivots or max(1, int(n**0.5)))
        solid = vectors.where(F.exists("v", lambda x: x != 0))
        first = solid.select("id", "v").orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(many).toArrow()
        self.pivots = _unit(first.column("v").combine_chunks()) if first.num_rows else np.zeros((0, 1))
        sent = spark.sparkContext.broadcast(self.pivots)

        def assign(batches):
            p = sent.value
            for batch in batches:
                x = _unit(batch.column("v"))
                zero = ~x.any(axis=1)
                score = x @ p.T if len(p) else np.zeros((len(x), 1))
                cell = np.where(zero, -1, score.argmax(axis=1))
                angle = np.where(zero, 0.0, _angle(score.max(axis=1)))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(angle), batch.column("id"), batch.column("v")], names=["cell", "angle", "id", "v"])

        kind = vectors.schema["v"].dataType.simpleString()
        laid = vectors.select("id", "v").mapInArrow(assign, f"cell int, angle double, id long, v {kind}")
        order = ["cell", "angle", "id"]
        self.cells = written(laid.repartitionByRange(*order).sortWithinPartitions(*order), "neighbours")
        self.sizes = {r["cell"]: (r["n"], r["low"], r["high"]) for r in self.cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()}

    def topk(self, queries: DataFrame, k: int, digits: int = 9) -> tuple[DataFrame, DataFrame]:
        """((q, id, score, rank), (compared, all)): the k nearest for each of ``queries`` (q, v), ties to the smaller id; and how many scores were computed, of how many there are.

        Queries are a stated set, taken in blocks.
        """
        spark = queries.sparkSession
        n = queries.count()
        blocks = max(1, -(-n // QUERY_BLOCK))
        out, counted = None, None
        for b in range(blocks):
            part = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).orderBy("q").select("q", "v").toArrow()
            if not part.num_rows or not self.sizes:
                continue
            found, compared = self._block(spark, part.column("q").to_numpy(), _unit(part.column("v").combine_chunks()), k, digits)
            out, counted = (found, compared) if out is None else (out.union(found), counted.union(compared))
        if out is None:
            out, counted = spark.createDataFrame([], "q long, id long, score double, rank long"), spark.createDataFrame([], "compared long")
        every = n * sum(size for size, _, _ in self.sizes.values())
        return out, counted.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared")).withColumn("all", F.lit(every).cast("long"))

    def _block(self, spark, ids: np.ndarray, x: np.ndarray, k: int, digits: int) -> tuple[DataFrame, DataFrame]:
        cells = np.array(sorted(c for c in self.sizes if c >= 0), int)
        size, low, high = (np.array([self.sizes[c][i] for c in cells], float) for i in range(3))
        to = _angle(x @ self.pivots[cells].T) if len(cells) else np.zeros((len(x), 0))  # queries to pivots
        near = np.argsort(to, axis=1)
        # the first cells of each query that hold k vectors together
        take = np.cumsum(size[near], axis=1) - size[near] < k
        home = np.zeros(to.shape, bool)
        np.put_along_axis(home, near, take, axis=1)
        none = np.full(to.shape, -1.0)
        first = written(self._compare(spark, ids, x, cells, np.where(home, 0.0, none), np.where(home, 4.0, none), k, digits, zeros=True), "neighbours-first")
        worst = {r["q"]: r["s"] for r in _best(first, k).groupBy("q").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") == k).collect()}  # a row per query of the block
        reach = _angle(np.array([worst.get(int(q), -1.0) for q in ids]) - 10.0**-digits)[:, None] + SPARE
        reach = np.where(np.isin(ids, list(worst))[:, None], reach, 4.0)
        # of a cell: vectors whose angle to the pivot is within reach of the query's
        lo, hi = np.maximum(to - reach, 0.0), to + reach
        open_ = (lo <= high[None]) & (hi >= low[None]) & ~home
        rest = self._compare(spark, ids, x, cells, np.where(open_, lo, -1.0), np.where(open_, hi, -1.0), k, digits, zeros=False)
        both = written(first.union(rest), "neighbours-found")
        return _best(both, k), both.select(F.col("compared").cast("long").alias("compared"))

    def _compare(self, spark, ids, x, cells, lo, hi, k, digits, zeros: bool) -> DataFrame:
        """(q, id, score, compared): for each task's batch of a cell the k best per query among vectors at angles lo to hi; with what was compared on one row of each."""
        place = {int(c): i for i, c in enumerate(cells)}
        wanted = [int(c) for i, c in enumerate(cells) if (hi[:, i] >= 0).any()] + [-1] * zeros
        sent = spark.sparkContext.broadcast((ids, x, place, lo, hi))

        def run(batches):
            ids, x, place, lo, hi = sent.value
            for batch in batches:
                cell, angle = batch.column("cell").to_numpy(), batch.column("angle").to_numpy()
                y, names = _unit(batch.column("v")), batch.column("id").to_numpy()
                q, found, score, compared = [], [], [], 0
                for c in np.unique(cell).tolist():
                    mine = np.flatnonzero(cell == c)
                    if c < 0:
                        rows = np.arange(len(ids))
                        a, b = np.zeros(len(ids), int), np.full(len(ids), len(mine))
                    else:
                        i = place[c]
                        rows = np.flatnonzero(hi[:, i] >= 0)
                        a, b = np.searchsorted(angle[mine], lo[rows, i], "left"), np.searchsorted(angle[mine], hi[rows, i], "right")
                    some = b > a
                    rows, a, b = rows[some], a[some], b[some]
                    if not len(rows):
                        continue
                    s = np.round(x[rows] @ y[mine].T, digits)
                    at = np.arange(len(mine))[None]
                    inside = (at >= a[:, None]) & (at < b[:, None])
                    compared += int(inside.sum())
                    s = np.where(inside, s, -np.inf)
                    keep = inside & (s >= np.partition(s, -k, axis=1)[:, [-k]]) if len(mine) > k else inside
                    r, j = np.nonzero(keep)
                    q.append(ids[rows[r]])
                    found.append(names[mine[j]])
                    score.append(s[r, j])
                if q:
                    q, found, score = map(np.concatenate, (q, found, score))
                    done = np.zeros(len(q), np.int64)
                    done[0] = compared
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(found, pa.int64()), pa.array(score), pa.array(done)], names=["q", "id", "score", "compared"])

        return self.cells.where(F.col("cell").isin(wanted)).mapInArrow(run, "q long, id long, score double, compared long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    return found.select("q", "id", "score").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
