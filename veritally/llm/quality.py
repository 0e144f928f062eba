"""Quality classifier: importance resampling with hashed n-gram models and Gumbel top-k.

Method
  1. *Models.* Two hashed n-gram models, for the raw corpus (counted over all documents) and for the target text (labelled
     documents of quality 1): 4-grams of character shapes of the text between blanks, hashed into ``BUCKETS`` cells, and for each word whether
     it repeats the word before it. Letters of any script, capitals and digits are three shapes, every other ASCII character its own; so what share a
     language has among the labelled documents doesn't pass for quality. Both models come from one pass; a task returns one histogram of fixed size. The target is
     smoothed towards the raw model.
  2. *Weights.* A document's log weight is the sum over its n-grams of log(target / raw).
  3. *How many.* k is the number of documents above a cutoff. The cutoff is the log weight that separates the labelled documents of quality 1 and 0
     with the best balanced accuracy (if one of the two kinds is missing, every text with words is above it).
  4. *Gumbel top-k.* The k documents with the largest log weight + Gumbel noise are kept: a sample without replacement by
     importance weight. The noise is a seeded hash of doc_id. The k-th key is found exactly by counting in ever finer bins of the keys.

The labelled rows are a bounded sample: the ``labelled`` rows with the smallest seeded hashes. Everything else covers all data.
Null texts count as empty. A text without words has no n-grams: its log weight is null and it isn't kept. Documents tied at the k-th key
are all kept. With no labelled document of quality 1 the target is the raw model, and every text with words has weight 0.
Extra columns are ignored; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm import words as W
from veritally.llm.common import lean, written

BUCKETS = 1 << 14
#: Labelled documents that the target model and the cutoff may be taken from.
LABELLED = 20_000
#: Weight of the raw model in the target's, as a share of the target's counts.
PRIOR = 0.002
_CELLS = BUCKETS + 2
_U = np.uint64


def _shapes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    out[ord("a") : ord("z") + 1] = out[128:] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


_SHAPE = _shapes()


def _grams(col: pa.Array):
    """Yields (first row, last row + 1, cell of each n-gram, offsets of the rows in them), chunk by chunk."""
    raw, off = W.text_buffers(col)
    for a, b in W._chunks(off):
        size = np.diff(off[a : b + 1])
        at = np.concatenate([[0], np.cumsum(size + 3)])  # blank, text, two blanks: as many 4-grams as bytes
        part = np.full(int(at[-1]), 32, np.uint8)
        inner = np.ones(len(part), np.bool_)
        inner[at[:-1]] = inner[at[1:] - 1] = inner[at[1:] - 2] = False
        part[inner] = raw[off[a] : off[b]]
        wide = np.concatenate([_SHAPE[part], np.full(3, 32, np.uint32)])
        h = wide[:-3]
        for j in (1, 2, 3):
            h = h * np.uint32(0x01000193) + wide[j : len(wide) - 3 + j]
        cell = ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(18)).astype(np.int64)
        row = np.repeat(np.arange(b - a), size + 3)
        real = np.arange(len(part)) < (at[1:] - 3)[row]
        s, e = W.word_spans(part)
        owner = row[s]
        hashes = W.hash_spans(part, s, e)
        again = np.zeros(len(s), np.bool_)
        again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        worded = np.bincount(owner, minlength=b - a) > 0
        real &= worded[row]
        rows = np.concatenate([row[real], owner])
        cells = np.concatenate([cell[real], BUCKETS + again])
        order = np.argsort(rows, kind="stable")
        yield a, b, cells[order], np.searchsorted(rows[order], np.arange(b - a + 1))


def _count(batches):
    """One row per task: histograms of all texts and of those whose ``target`` is true."""
    both = np.zeros((2, _CELLS), np.int64)
    mark = 0
    for batch in batches:
        target = batch.column("target").to_numpy(zero_copy_only=False)
        mark += len(batch) * 31 + int(np.sum(target))
        for a, b, cells, at in _grams(batch.column("text")):
            both[0] += np.bincount(cells, minlength=_CELLS)
            both[1] += np.bincount(cells[np.repeat(target[a:b], np.diff(at))], minlength=_CELLS)
    if mark:
        yield pa.RecordBatch.from_arrays([pa.array([mark % 64], pa.int32()), pa.array([both.tobytes()], pa.binary())], names=["slot", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(2 * _CELLS, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_py(), np.int64)
    return pa.table({"counts": pa.array([total.tobytes()], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(target / raw) per cell; only 64 histograms of fixed size reach the driver. ``labels`` is the bounded sample (doc_id, quality)."""
    good = labels.where("quality = 1").select("doc_id").distinct().withColumn("target", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    rows = marked.mapInArrow(lean(_count), "slot int, counts binary").groupBy("slot").applyInArrow(lean(_add), "counts binary").collect()
    raw, target = np.sum([np.frombuffer(r["counts"], np.int64) for r in rows], axis=0).reshape(2, _CELLS) if rows else np.zeros((2, _CELLS))
    if not target.sum():
        return np.zeros(_CELLS)
    out = []
    for part in (slice(0, BUCKETS), slice(BUCKETS, _CELLS)):  # the grams and the repeats are two distributions
        p = (raw[part] + 0.01) / (raw[part].sum() + 0.01 * len(raw[part]))
        prior = max(1.0, PRIOR * target[part].sum())
        out.append(np.log((target[part] + prior * p) / (target[part].sum() + prior) / p))
    return np.concatenate(out)


def _score(ratio: np.ndarray):
    def run(batches):
        for batch in batches:
            for a, b, cells, at in _grams(batch.column("text")):
                total = np.add.reduceat(np.append(ratio[cells], 0.0), at[:-1])
                none = at[1:] == at[:-1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(np.where(none, 0.0, total), mask=none)], names=["doc_id", "log_weight"])

    return run


def score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, log_weight)."""
    return docs.select("doc_id", "text").mapInArrow(lean(_score(ratio)), "doc_id long, log_weight double")


def cutoff(scores: DataFrame, labels: DataFrame) -> float:
    """The log weight with the best balanced accuracy on the labelled sample (bounded, so it is collected; of rows that repeat a doc_id the least weight counts)."""
    met = scores.join(F.broadcast(labels), "doc_id").where("log_weight IS NOT NULL")
    rows = met.groupBy("doc_id", "quality").agg(F.min("log_weight").alias("log_weight")).select("log_weight", "quality").collect()
    x = np.array([r[0] for r in rows])
    good = np.array([r[1] == 1 for r in rows], np.bool_)
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(x)
    x, good = x[order], good[order]
    balanced = np.cumsum(~good) / (~good).sum() - np.cumsum(good) / good.sum()  # with all up to i rejected
    i = int(np.argmax(balanced))
    return float((x[i] + x[i + 1]) / 2) if i + 1 < len(x) else float(x[i])


def kth_largest(keys: DataFrame, col: str, k: int, bins: int = 4096) -> float:
    """The exact k-th largest value of a column: counts per bin, then finer bins within the one that holds it."""
    lo, hi, n = keys.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k >= n:
        return -np.inf
    while lo < hi:
        step = (hi - lo) / bins
        if lo + step == lo:
            break
        place = F.least(F.lit(bins - 1), F.floor((F.col(col) - lo) / step))
        inside = keys.where((F.col(col) >= lo) & (F.col(col) <= hi))
        rows = inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        if r["n"] == 1 or (r["lo"], r["hi"]) == (lo, hi) and r["lo"] == r["hi"]:
            return r["lo"]
        lo, hi = r["lo"], r["hi"]
    return lo


def _noise(seed: int):
    """Gumbel noise, a function of seed and doc_id."""
    return -F.log(-F.log((F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))))


def _sampled(docs: DataFrame, labels: DataFrame, seed: int, labelled: int):
    """The fitted cells, the scored documents and the least key that is kept."""
    sample = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "quality").limit(labelled)
    sample = written(sample, "quality-labels")
    ratio = fit(docs, sample)
    scored = written(score(docs, ratio).withColumn("key", F.col("log_weight") + _noise(seed)), "quality-scores")
    k = scored.where(F.col("log_weight") > F.lit(cutoff(scored, sample))).count()
    return ratio, scored, float(kth_largest(scored, "key", k) if k else np.inf)


def quality_filter(docs: DataFrame, labels: DataFrame, seed: int = 23, labelled: int = LABELLED) -> DataFrame:
    """(doc_id, log_weight, key, kept): a row per row of ``docs`` (doc_id long, text string); ``labels`` has doc_id, quality (0 or 1)."""
    _, scored, least = _sampled(docs, labels, seed, labelled)
    return scored.select("doc_id", "log_weight", "key", F.coalesce(F.col("key") >= F.lit(least), F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, seed: int = 23, labelled: int = LABELLED) -> DataFrame:
    """The rows of ``docs`` that `quality_filter` keeps, with all columns. Texts are scored once more where they are, so none is shuffled.

    Null texts and texts without words go. Rows that repeat a doc_id are judged by their own texts with the same noise; so are rows without a doc_id. An empty table stays empty.
    """
    ratio, _, least = _sampled(docs, labels, seed, labelled)
    names = docs.columns
    noise = "_noise"
    while noise in names:
        noise += "_"

    def run(batches):
        for batch in batches:
            for a, b, cells, at in _grams(batch.column("text")):
                total = np.add.reduceat(np.append(ratio[cells], 0.0), at[:-1])
                kept = (at[1:] > at[:-1]) & (total + batch.column(noise).to_numpy()[a:b] >= least)
                if kept.any():
                    yield batch.slice(a, b - a).filter(pa.array(kept)).select(names)

    return docs.withColumn(noise, _noise(seed)).mapInArrow(lean(run), docs.schema)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The sample: a row per document that is kept."""
    return quality_filter(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept")
