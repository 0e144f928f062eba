"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle check.

Method
  1. *Windows.* An item of L words belongs to the largest window size W of a fixed ladder with W + stride - 1 <= L, where the stride is
     W // 8 (at least 1). Documents are read in windows of W words at multiples of the stride, items at every offset (long items in ``RUNS`` runs of a stride's offsets
     each, from the first to the last). So a copy of an item at any place of a text holds a window that is also a window of the item, word for word.
  2. *Fingerprints.* 64-bit SimHash of a window's word pairs. All windows of a batch come from one running sum of byte-wide counters.
  3. *Multi-index.* Fingerprints are cut into 4 blocks of 16 bits. Within ``RADIUS`` = 11 bits at least one block differs in at most 2 bits. For each block a table leads from a value
     to the items' fingerprints whose block is near it; a window looks up its 4 values and is compared with what it finds there, about 1 % of all fingerprints, and with nothing else.
     Where a size has few fingerprints they are entered under all values within 2 bits; where it has many, under those within 1, and a window looks up all values within 1 of its own.
  4. *Verification.* Each hit names an item and a place. There the item and the L words of the text are compared exactly, by the larger of two similarities of their
     shingles: the Jaccard similarity, and the sum of the weights of the shingles that they share by that of all they have. A shingle of k words weighs
     1 / (different items that have it), counted over all items, so what many items share counts less; shingles that the item doesn't have weigh 1. It must be at least ``num / den``.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Items are taken in blocks of about ``ITEMS_AT_ONCE`` items and ``ITEM_BYTES`` of text at most (one item if it is longer), so what is sent
to the executors is bounded, and every document meets every item; a pass over the documents takes a block. A block carries the weights of its own shingles; the counts of all are a table. Null or empty items and texts match nothing; items and documents without an id match with a null id. Items of fewer than k words count as one shingle. Equal items match each on
its own. Repeated documents give repeated rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm import words as W
from veritally.llm.common import lean, small, written

RADIUS = 11
#: Shifts of the 16-bit blocks of a fingerprint.
BLOCKS = (0, 16, 32, 48)
#: Items and bytes of items that a pass over the documents takes: some 7 fingerprints an item of 40 words, with up to 2,200 bytes of tables each, so about 150 MB in a worker.
ITEMS_AT_ONCE, ITEM_BYTES = 10_000, 16 << 20
#: Up to so many fingerprints of a size are entered under all values within 2 bits.
FEW = 16_384
#: Bytes of text that are searched at once: larger than elsewhere, as each chunk goes through the tables of all sizes.
CHUNK = 1 << 19
#: Runs of offsets of a long item, and pairs of windows and fingerprints that are compared at once.
RUNS, PAIRS_AT_ONCE = 8, 1 << 19
#: The longest window; counters are bytes. A longer item is met by the windows inside it.
_LONGEST = 256

_U = np.uint64
_SPREAD = np.array([sum(((b >> (7 - j)) & 1) << (8 * j) for j in range(8)) for b in range(256)], _U)
SCHEMA = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def window_sizes() -> list[int]:
    """1 to 8, then each a quarter longer."""
    out = list(range(1, 9))
    while out[-1] * 5 // 4 <= _LONGEST:
        out.append(out[-1] * 5 // 4)
    return out


def stride(w: int) -> int:
    return max(1, w // 8)


def _pairs(words: np.ndarray) -> np.ndarray:
    """Hash of each word with the next; the last stands alone."""
    nxt = np.append(words[1:], _U(0))
    return W._mix(words * _U(0x9E3779B97F4A7C15) + nxt * _U(0xC2B2AE3D27D4EB4F))


def _running(pairs: np.ndarray) -> np.ndarray:
    """Running sums of the pairs' bits, 64 counters in 8 words of 8 bytes; differences over up to 255 pairs are exact."""
    lanes = _SPREAD[pairs.view(np.uint8).reshape(-1, 8)]
    out = np.zeros((len(pairs) + 1, 8), _U)
    np.cumsum(lanes, axis=0, out=out[1:])
    return out


def _simhash(running: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    n = max(1, w - 1)
    counts = (running[starts + n] - running[starts]).view(np.uint8)
    return np.packbits(counts > n // 2, axis=1).view(_U).ravel()


def _weigh(hashes: np.ndarray, shared: np.ndarray, weight: np.ndarray) -> float:
    """Sum of the weights of ``hashes``; those not in ``shared`` (ascending) weigh 1."""
    if not len(shared):
        return float(len(hashes))
    at = np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)
    return float(np.where(shared[at] == hashes, weight[at], 1.0).sum())


def _item_shingles(k: int):
    def run(batches):
        for batch in batches:
            for _, _, h, off in W.hashed_words(batch.column("text")):
                s, at = W.sorted_sets(*W.shingles(h, off, k))
                item = pa.array([h[off[i] : off[i + 1]].tobytes() for i in range(len(off) - 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([item, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(s.view(np.int64)))], names=["words", "shingles"])

    return run


def shared_shingles(items: DataFrame, k: int) -> DataFrame:
    """(s, count): the shingles that several different items (other words) have, and how many, as a table."""
    each = items.select("text").mapInArrow(lean(_item_shingles(k)), "words binary, shingles array<long>").withColumn("item", F.sha2("words", 256)).drop("words")
    return each.dropDuplicates(["item"]).select(F.explode("shingles").alias("s")).groupBy("s").count().where("count > 1")


def weights_of(items: DataFrame, shared: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the shared shingles that these items have, ascending, and their weights: at most as many as the items have words."""
    mine = items.select("text").mapInArrow(lean(_item_shingles(k)), "words binary, shingles array<long>").select(F.explode("shingles").alias("s")).distinct()
    found = shared.join(mine, "s").toArrow()
    s = found.column("s").to_numpy().view(_U)
    order = np.argsort(s)
    return s[order], (1.0 / found.column("count").to_numpy())[order]


def _ball(radius: int) -> np.ndarray:
    """All 16-bit masks of at most so many bits."""
    return np.array([sum(1 << x for x in flip) for r in range(radius + 1) for flip in combinations(range(16), r)], np.uint16)


def offsets(n: int, w: int) -> np.ndarray:
    """Where the windows of an item of n words start: everywhere, or in a long item in ``RUNS`` runs of a stride each."""
    last, step = n - w, stride(w)
    if last + 1 <= RUNS * step:
        return np.arange(last + 1)
    return (np.linspace(0, last + 1 - step, RUNS).astype(np.int64)[:, None] + np.arange(step)).ravel()


class Table:
    """Fingerprints of one window size by the values near their blocks."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        mine = 2 if len(prints) <= FEW else 1
        near, self.probe = _ball(mine), _ball(RADIUS // len(BLOCKS) - mine)
        self.starts, self.entries = [], []
        for shift in BLOCKS:
            value = ((prints >> _U(shift)).astype(np.uint16)[:, None] ^ near[None, :]).ravel()
            self.entries.append((np.argsort(value, kind="stable") // len(near)).astype(np.int32))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << 16))]))

    def pairs(self, sim: np.ndarray):
        """Yields (window, fingerprint) arrays: all pairs within the radius, some more than once; and how many were compared."""
        for shift, start, entries in zip(BLOCKS, self.starts, self.entries, strict=True):
            value = (sim >> _U(shift)).astype(np.uint16)
            for mask in self.probe:
                v = value ^ mask
                lo = start[v]
                n = start[v.astype(np.int64) + 1] - lo
                total = np.concatenate([[0], np.cumsum(n)])
                a = 0
                while a < len(sim):
                    b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS_AT_ONCE, "right")) - 1)
                    window = np.repeat(np.arange(a, b), n[a:b])
                    found = entries[np.arange(total[b] - total[a]) + np.repeat(lo[a:b] - total[a:b] + total[a], n[a:b])]
                    hit = np.bitwise_count(sim[window] ^ self.prints[found]) <= RADIUS
                    yield window[hit], found[hit], len(found)
                    a = b


class Index:
    """Fingerprints and shingles of one block of items. What is sent is compact; a worker makes the tables when it first needs them."""

    def __init__(self, items: list[tuple[int, str]], k: int, shared: tuple[np.ndarray, np.ndarray] = (np.zeros(0, _U), np.zeros(0))):
        self.k, self.shared = k, shared
        self.ids = [i for i, _ in items]
        self.sets, self.length = [], []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        texts = pa.array([t for _, t in items], pa.large_string())
        for a, _, h, off in W.hashed_words(texts):
            for i in range(len(off) - 1):
                words = h[off[i] : off[i + 1]]
                n = len(words)
                self.length.append(n)
                self.sets.append(np.unique(W.shingles(words, np.array([0, n]), k)[0]))
                if n:
                    w = max(x for x in window_sizes() if x + stride(x) - 1 <= n)
                    at = offsets(n, w)
                    found.setdefault(w, []).append((_simhash(_running(_pairs(words)), at, w), np.full(len(at), a + i), at))
        self.by_size = {w: tuple(np.concatenate(x) for x in zip(*rows, strict=True)) for w, rows in found.items()}
        self.tables: dict[int, Table] = {}

    def table(self, w: int) -> Table:
        if w not in self.tables:
            self.tables[w] = Table(self.by_size[w][0])
        return self.tables[w]

    def similarity(self, item: int, words: np.ndarray) -> float:
        mine = self.sets[item]
        other = np.unique(W.shingles(words, np.array([0, len(words)]), self.k)[0])
        both = np.intersect1d(mine, other, assume_unique=True)
        plain = len(both) / (len(mine) + len(other) - len(both))
        common = _weigh(both, *self.shared)
        return max(plain, common / (_weigh(mine, *self.shared) + len(other) - len(both)))

    def search(self, words: np.ndarray, off: np.ndarray, least: float):
        """Yields (row, item position, similarity, start word)."""
        if not len(words):
            return
        running = _running(_pairs(words))
        size = np.diff(off)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        length = np.array(self.length, np.int64)
        for w, (_, item, offset) in self.by_size.items():
            step = stride(w)
            n = np.maximum(0, (size - w) // step + 1)
            if not n.any():
                continue
            row = np.repeat(np.arange(len(size)), n)
            start = off[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step
            places = []
            for x, y, _ in self.table(w).pairs(_simhash(running, start, w)):
                r = row[x]
                at = np.maximum(off[r], np.minimum(start[x] - offset[y], off[r + 1] - length[item[y]]))
                places.append(np.unique(np.stack([r, item[y], at], axis=1), axis=0))
            # by row, item and place, so that the first of equal places is met first
            for r, i, at in np.unique(np.concatenate(places), axis=0).tolist() if places else ():
                if best.get((r, i), (0.0,))[0] == 1.0:
                    continue
                s = self.similarity(i, words[at : min(at + self.length[i], int(off[r + 1]))])
                if s >= least and s > best.get((r, i), (0.0,))[0]:
                    best[r, i] = (s, at)
        for (r, i), (s, at) in sorted(best.items()):
            yield r, i, s, at - int(off[r])


def _leaks(index, least: float):
    def run(batches):
        found = index.value
        for batch in batches:
            ids = batch.column("doc_id")
            for a, _, h, off in W.hashed_words(batch.column("text"), CHUNK):
                rows = [(ids[a + r].as_py(), found.ids[i], s, at, found.length[i]) for r, i, s, at in found.search(h, off, least)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return run


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): a row per document row and item that it holds, at its most similar place (the first of equals).

    ``docs`` has doc_id long, text string; ``benchmark`` item_id long, text string.
    """
    spark = docs.sparkSession
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS_AT_ONCE), -(-size // ITEM_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    shared = written(shared_shingles(items, k), "leaks-shared")
    out = spark.createDataFrame([], SCHEMA)
    for b in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in items.where(F.col("block") == b).orderBy("item_id", "text").collect()]
        if rows:
            index = spark.sparkContext.broadcast(Index(rows, k, weights_of(items.where(F.col("block") == b), shared, k)))
            out = out.union(docs.select("doc_id", "text").mapInArrow(lean(_leaks(index, num / den)), SCHEMA))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.

    Null and empty texts hold none and stay. Rows that repeat a doc_id stay or go together; so do all rows without a doc_id. Without documents or items all stay.
    """
    leaks = written(benchmark_leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(small(leaks), F.col("doc_id").eqNullSafe(F.col("_leak")), "left_anti").select(*docs.columns)


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return benchmark_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
