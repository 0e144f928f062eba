"""Nearest neighbours by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that a block holds; blocks bound what is sent to the executors.
QUERY_BLOCK = 4096


def norm(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    """In double precision, summed in order; a zero vector has cosine 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def guarded_index(vectors: DataFrame, split: Column, id_: str = "id") -> DataFrame:
    """The vectors, all of the train split and each with an id of its own; anything else is an error, so nothing leaks and no neighbour is counted twice."""
    if vectors.groupBy(id_).count().where("count > 1").limit(1).count():
        raise ValueError("an index holds each id once")
    return vectors.where(F.assert_true(split == "train", "an index holds the train split only").isNull())


def topk(queries: DataFrame, index: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(q, id, score, rank): the k nearest of ``index`` (id, v) for each of ``queries`` (q, v), ties to the smaller id.

    Queries are a stated set; each block of them is sent to all tasks, which reduce their rows to k candidates a query before anything is shuffled.
    """
    spark = queries.sparkSession
    n = queries.count()
    out = spark.createDataFrame([], "q long, id long, score double")
    blocks = max(1, -(-n // QUERY_BLOCK))
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).orderBy("q").select("q", "v").toArrow()
        if not part.num_rows:
            continue
        ids = part.column("q").to_numpy()
        x = np.array(part.column("v").to_pylist(), np.float64)
        sent = spark.sparkContext.broadcast((ids, x / np.where((s := np.sqrt((x * x).sum(axis=1))) == 0, 1, s)[:, None]))

        def run(batches, sent=sent):
            q, x = sent.value
            rows, cand, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for batch in batches:
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                if not len(ids):
                    continue
                y = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                s = np.sqrt((y * y).sum(axis=1))
                score = np.round(x @ (y / np.where(s == 0, 1, s)[:, None]).T, digits)
                i, j = np.nonzero(score >= np.partition(score, -k, axis=1)[:, [-k]]) if len(ids) > k else np.divmod(np.arange(score.size), len(ids))
                rows, cand, value = np.concatenate([rows, i]), np.concatenate([cand, ids[j]]), np.concatenate([value, score[i, j]])
                order = np.lexsort((cand, -value, rows))
                rows, cand, value = rows[order], cand[order], value[order]
                keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k  # the first k of each query
                rows, cand, value = rows[keep], cand[keep], value[keep]
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(q[rows]), pa.array(cand), pa.array(value)], names=["q", "id", "score"])

        out = out.union(index.select("id", "v").mapInArrow(run, "q long, id long, score double"))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def cache_key(ids: Column, content: Column, model: str) -> Column:
    """Aggregate: changes with any id, content or the model."""
    return F.sha2(F.concat_ws("\n", F.lit(model), F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", ids.cast("string"), F.md5(content)))), "\n")), 256)


def hashed_bag(text: Column, dims: int = 64) -> Column:
    """A test embedder: counts of words in ``dims`` cells by MD5, of unit length."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9']+)"), F.lit(1))
    cell = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int"))
    zeros = F.array_repeat(F.lit(0.0), dims)
    counts = F.aggregate(cell, zeros, lambda acc, c: F.transform(acc, lambda x, i: F.when(i == c, x + 1).otherwise(x)))
    # bound to a variable, so that it is computed once
    return F.element_at(F.transform(F.array(counts), lambda v: F.transform(v, lambda c: c / norm(v))), 1)
