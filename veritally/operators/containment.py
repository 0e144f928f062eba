"""Which texts hold which patterns verbatim: one pass over the texts per block of patterns, with an automaton of the block."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.storage import written

#: Patterns and bytes of patterns of a block (one pattern if it is longer): a worker's automaton has as many nodes at most.
PATTERNS, PATTERN_BYTES = 100_000, 4 << 20

def _automaton(block: list[tuple[int, str]]):
    """The automaton over (id, pattern), and the ids by pattern."""
    import ahocorasick

    ids: dict[str, list[int]] = {}
    for i, pattern in block:
        ids.setdefault(pattern, []).append(i)
    tree = ahocorasick.Automaton()
    for pattern in ids:
        if pattern:
            tree.add_word(pattern, pattern)
    if len(tree):
        tree.make_automaton()
    return tree, ids


def contained(texts: DataFrame, text_id: str, patterns: DataFrame, pattern_id: str) -> DataFrame:
    """(pattern_id, text_id): a row per row of ``texts`` (text_id long, text string) and row of ``patterns`` (pattern_id long, pattern string) that it holds.

    Every text meets every pattern, whatever their lengths; no text is compared with a pattern that it doesn't hold, and rows appear only for pairs that are. The empty pattern is in every text; nulls hold and match
    nothing. Patterns are taken in blocks of bounded size, each of which is sent once.
    """
    spark = texts.sparkSession
    known = written(patterns.where("pattern IS NOT NULL").select(F.col(pattern_id).cast("long").alias("id"), "pattern"), "patterns")
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()
    blocks = max(1, -(-n // PATTERNS), -(-size // PATTERN_BYTES))
    schema = f"{pattern_id} long, {text_id} long"
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        rows = [(r["id"], r["pattern"]) for r in known.where(F.pmod(F.xxhash64("id", "pattern"), F.lit(blocks)) == b).collect()]
        if rows:
            out = out.union(texts.where("text IS NOT NULL").select(F.col(text_id).cast("long").alias("id"), "text").mapInArrow(_finder(spark.sparkContext.broadcast(rows), pattern_id, text_id), schema))
    return out


def _finder(block, pattern_id: str, text_id: str):
    def run(batches):
        tree, ids = _automaton(block.value)
        always = ids.get("", [])
        for batch in batches:
            found, holders = [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                text = text.decode("utf-8", "replace")
                hits = {p for _, p in tree.iter(text)} if len(tree) else ()
                mine = [k for p in hits for k in ids[p]] + always
                found += mine
                holders += [i] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(holders, pa.int64())], names=[pattern_id, text_id])

    return run
