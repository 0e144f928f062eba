"""Spelling variants: words that differ by one code point are grouped under their commonest form.

Method
  1. *Vocabulary.* Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased, counted over all texts; words have ``shortest`` code points and ``least`` occurrences at least.
  2. *Full neighbourhoods.* For each word all distinct deletions, replacements and insertions over the alphabet that the vocabulary uses (90 letters at most). They are distinct by construction: a
     letter of a run of equal ones is deleted at its first place alone, and none is inserted behind its like. A candidate is a sum of a prefix and a suffix hash, so none is spelt out yet.
  3. *Sieve.* A bit field of the vocabulary's hashes, of a fixed size whatever the table (``SIEVE_BITS``), drops candidates that can't be words; it never drops a word. It holds ``SIEVE_WORDS`` words;
     a larger vocabulary goes through several fields, one after the other, each with all candidates.
  4. *Hash join.* What passes is spelt out, aggregated by candidate (how many words have it in their neighbourhood, and the commonest of them) and joined to the vocabulary by equality. Distances
     needn't be verified: neighbourhoods are symmetric.
  5. *Forms and roots.* A word's form is its commonest near word (ties: the smallest in code-point order) if that occurs ``ratio`` times as often. Occurrences grow by this factor from a word to its
     form, so a chain is short and doubling its links a few times reaches its end.

A row takes part in at most as many pairs as a word has neighbours, so no key is hot. Null and empty texts have no words; repeated rows count each. A null doc_id is an empty string in the hash that
`misspelt` takes. Extra columns are ignored; an empty table has no words. Invalid UTF-8 is read with replacement characters, which end a run.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import lean, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a sieve (16 MB), and the words it holds; two bits a word.
SIEVE_BITS, SIEVE_WORDS = 1 << 27, 16_000_000
_SHIFT = np.uint64(64 - SIEVE_BITS.bit_length() + 1)
#: Candidates that are made at once.
_AT_ONCE = 1 << 17
_U = np.uint64
_LETTER = np.random.Generator(np.random.PCG64(23)).integers(0, 1 << 64, size=256, dtype=np.uint64) | _U(1)
_SECOND = _U(0xC4CEB9FE1A85EC53)


def runs(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, run): a row per maximal run of at least ``shortest`` letters, A-Z lower-cased."""
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ÿ]{%d,}+" % shortest), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run")).withColumn("run", F.translate("run", _UPPER, _LOWER))


def misspelt(run: Column, doc_id: Column, every: int = 31) -> Column:
    """The run without one code point where ``every`` divides the crc32 of ``<doc_id>:<run>``, else the run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, shortest: int, least: int) -> DataFrame:
    """(word, n) of a column ``word``."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n, _U(0x9E3779B97F4A7C15))]))


def _by_length(words: list[str]):
    """(places, matrix of Latin-1 codes) of the words of each length."""
    raw = [w.encode("latin-1") for w in words]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    for size in np.unique(lens).tolist():
        at = np.flatnonzero(lens == size)
        yield at, np.frombuffer(b"".join([raw[i] for i in at]), np.uint8).reshape(len(at), size)


def _hashes(codes: np.ndarray) -> np.ndarray:
    return (_LETTER[codes] * _powers(codes.shape[1])[: codes.shape[1]]).sum(axis=1, dtype=_U)


def _bits(words: DataFrame, block: int, blocks: int) -> DataFrame:
    """(bit): the bits of the words that are in this block."""

    def run(batches):
        for batch in batches:
            for _, codes in _by_length(batch.column("word").to_pylist()):
                h = _hashes(codes)
                h = h[h % _U(blocks) == block]
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h >> _SHIFT, (h * _SECOND) >> _SHIFT]).astype(np.int64))], names=["bit"])

    return words.select("word").mapInArrow(lean(run), "bit long").distinct()


def _sieve(words: DataFrame, block: int = 0, blocks: int = 1) -> bytes:
    """The bit field, packed by slices of 4,096 bytes on the executors: its size is fixed."""
    width = 4096 * 8

    def pack(table):
        field = np.zeros(width, np.uint8)
        field[table.column("bit").to_numpy() % width] = 1
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int64()), "field": pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary())})

    bits = _bits(words, block, blocks).withColumn("slice", F.expr(f"bit div {width}"))
    out = np.zeros((SIEVE_BITS // width, width // 8), np.uint8)
    packed = bits.groupBy("slice").applyInArrow(lean(pack), "slice long, field binary").toArrow()
    for k, field in zip(packed["slice"].to_pylist(), packed["field"].to_pylist(), strict=True):
        out[k] = np.frombuffer(field, np.uint8)
    return out.tobytes()


def _marked(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes, in the flattened array, whose two bits are set."""
    h = h.ravel()
    bit = h >> _SHIFT
    at = np.flatnonzero((sieve[bit >> _U(3)] >> (bit & _U(7)).astype(np.uint8)) & 1)
    bit = (h[at] * _SECOND) >> _SHIFT
    return at[((sieve[bit >> _U(3)] >> (bit & _U(7)).astype(np.uint8)) & 1).astype(bool)]


def neighbourhood(codes: np.ndarray, letters: np.ndarray, sieve: np.ndarray):
    """Yields (rows, matrix of codes): the distinct edits of words of one length that pass the sieve, and the words they belong to."""
    m, size = codes.shape
    power = _powers(size + 1)
    value = _LETTER[codes]
    zero = np.zeros((m, 1), _U)
    same = value * power[:size]
    before = np.concatenate([zero, np.cumsum(same, axis=1, dtype=_U)], axis=1)  # of the letters before each place
    tail = lambda x: np.concatenate([np.cumsum(x[:, ::-1], axis=1, dtype=_U)[:, ::-1], zero], axis=1)
    # moved one place forward by a deletion, one back by an insertion
    ahead = tail(value[:, 1:] * power[: size - 1]) if size > 1 else zero
    behind = tail(value * power[1 : size + 1])
    place = np.arange(size)

    gone = before[:, :size] + ahead
    first = np.concatenate([np.ones((m, 1), bool), codes[:, 1:] != codes[:, :-1]], axis=1)
    at = _marked(sieve, gone)
    at = at[first.ravel()[at]]
    row, i = np.divmod(at, size)
    keep = place[None, : size - 1]
    yield row, codes[row[:, None], keep + (keep >= i[:, None])]

    other = before[:, -1:] - same
    at = _marked(sieve, other[:, :, None] + (_LETTER[letters] * power[:size, None])[None])
    cell, c = np.divmod(at, len(letters))
    row, i = np.divmod(cell, size)
    new = codes[row]
    new[np.arange(len(row)), i] = letters[c]
    differs = codes[row, i] != letters[c]
    yield row[differs], new[differs]

    split = before + behind
    at = _marked(sieve, split[:, :, None] + (_LETTER[letters] * power[: size + 1, None])[None])
    cell, c = np.divmod(at, len(letters))
    row, i = np.divmod(cell, size + 1)
    new_letter = (i == 0) | (codes[row, np.maximum(i - 1, 0)] != letters[c])
    row, i, c = row[new_letter], i[new_letter], c[new_letter]
    new = np.empty((len(row), size + 1), np.uint8)
    keep = np.arange(size + 1)[None]
    new[:] = codes[row[:, None], np.clip(keep - (keep > i[:, None]), 0, size - 1)]
    new[np.arange(len(row)), i] = letters[c]
    yield row, new


def _candidates(words: DataFrame, letters: np.ndarray, block: int, blocks: int) -> DataFrame:
    """(near, word, n): edits of words that may be words."""
    sieve = words.sparkSession.sparkContext.broadcast(_sieve(words, block, blocks))

    def run(batches):
        field = np.frombuffer(sieve.value, np.uint8)
        for batch in batches:
            names, n = batch.column("word"), batch.column("n")
            for at, codes in _by_length(names.to_pylist()):
                step = max(1, _AT_ONCE // ((codes.shape[1] + 1) * max(1, len(letters))))
                row, new = [], []
                for a in range(0, len(at), step):
                    for r, x in neighbourhood(codes[a : a + step], letters, field):
                        row.append(at[a + r])
                        # b"..." of each row of the matrix, as text
                        flat, size = x.tobytes().decode("latin-1"), x.shape[1]
                        new += [flat[k : k + size] for k in range(0, len(flat), size)] if size else [""] * len(x)
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), names.take(take).cast(pa.string()), n.take(take)], names=["near", "word", "n"])

    return words.select("word", "n").mapInArrow(lean(run), "near string, word string, n long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n) for ``words`` (word string of code points below 256, n long; each word once): how many other words differ by one code point, and the commonest of them."""
    many = words.count()
    letters = [r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect() if r[0]]
    codes = np.array(sorted(ord(c) for c in letters), np.uint8)
    blocks = max(1, math.ceil(many / SIEVE_WORDS))
    near = None
    for block in range(blocks):
        part = _candidates(words, codes, block, blocks)
        near = part if near is None else near.union(part)
    near = near.groupBy("near").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "word")).alias("_best"))
    near = near.select(F.col("near").alias("word"), "n_near", F.col("_best.word").alias("best"), (-F.col("_best.n")).alias("best_n"))
    return words.select("word", "n").join(near, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))


def roots(forms: DataFrame, hops: int) -> DataFrame:
    """(word, root) of links (word, form): each word's last form, at most ``hops`` links away."""
    links = forms.select("word", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(max(1, hops)))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), f"spelling-roots-{k}")
    return links


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for ``words`` (word, n): one row per word."""
    words = written(words, "spelling-words")
    near = near_words(words).withColumn("_far", F.col("best_n") >= ratio * F.col("n"))
    near = written(near.select("word", "n", "n_near", F.when(F.col("_far"), F.col("best")).alias("form"), F.when(F.col("_far"), F.col("best_n")).alias("form_n")), "spelling-forms")
    low, high = near.agg(F.min("n"), F.max("n")).first()
    hops = int(math.log(high / low, ratio)) + 1 if high else 0
    return near.join(roots(near.where("form IS NOT NULL"), hops), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = runs(docs, 7).select(misspelt(F.col("run"), F.col("doc_id")).alias("word"))
    return group_variants(vocabulary(words, shortest=7, least=2))
