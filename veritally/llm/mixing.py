"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks. DataFrame operations only.

Method
  1. *Sizes.* A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``; a source's is the sum over its documents.
  2. *Targets.* The sources, ordered by code point with null last, have the weights ``weights`` in turn. They share
     ``share`` of all sizes by weight; no target exceeds ``cap`` times its source's size, and what that frees is shared again
     by weight until no target is above. That ends at one level: target = min(cap * size, level * weight).
  3. *Quotas.* All words are given to the sources one by one by the highest quotient target / (2 * words + 1). Two divisors bound each source's words from below and above; only the
     quotients between them (about one per source) are ranked. A source's words are whole blocks of equal size: ``block_words`` words, or fewer where its target would have less than ``FEWEST`` blocks
     (one word at least), so the size follows from the source alone. Its blocks go to its shards by the highest quotients in the same way, by the shards' words.
  4. *Shards.* A source is dealt into shards by a seeded hash of doc_id, size and text, so a source with a third of all rows is many shards,
     each of bounded size, with or without different doc_ids. In a shard, documents stand in seeded order and are cut into equal blocks (the last may be shorter).
  5. *Blocks.* A shard with q seats and b blocks takes each block q div b times, and m = q mod b blocks once more: one of each of m equal runs of blocks, by a seeded
     hash of the run. So a document's ``taken``, the words of its blocks, repeats counted, follows from its first and last word alone, however long it is.

Sources may be as many as documents: they are ranked and summed like other rows, never in one task.

Determinism: everything follows from the seed, doc_id and text; rows equal in both are alike. Null or empty texts have size 0
and are taken with 0 words. A source without words has target 0. An empty table gives an empty mix. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.llm.common import small, written
from veritally.operators.ranks import with_rank

#: Words of a block, and the blocks that a target has at least while the source's blocks have more than one word.
BLOCK_WORDS, FEWEST = 16, 40
#: Words of a shard, and the most shards of a source.
SHARD_WORDS, MAX_SHARDS = 65_536, 65_536


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, digest, size): the number of words of each document, and a hash of its text."""
    return docs.select("doc_id", "source", F.xxhash64("text").alias("digest"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): one row per source.

    The level rises from one round to the next, as the sources that it fills leave theirs to the others; a round is one sum over the sources, and rounds are about as many as
    doublings between the smallest and the largest size at most.
    """
    total = with_rank(sized.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], name="turn")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("turn") - 1, F.lit(len(weights))).cast("int") + 1)
    by = written(total.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most")), "mix-weights")
    left = (by.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level = 0.0
    while True:
        full = F.col("most") < F.col("weight") * F.lit(level)
        filled, open_ = by.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        new = (left - (filled or 0.0)) / open_ if open_ else float("inf")
        if new <= level:
            break
        level = new
        if not open_:
            break
    target = F.least("most", F.col("weight") * F.lit(level)) if level < float("inf") else F.col("most")
    return by.select("source", "source_size", target.alias("target"))


def apportion(votes: DataFrame, group: list[str], seats: Column, vote: Column, tie: list[Column]) -> DataFrame:
    """``votes`` with ``quota``: within each group, ``seats`` given one by one by the highest vote / (2 * quota + 1).

    Exact, by ranking only quotients between two divisors; ties go to the first by ``tie``. Groups without votes get 0. Without a group all rows share ``seats`` (a constant), and sums and
    ranks are made over all machines; with one, a group is a window.
    """
    v = votes.withColumn("_v", vote.cast("double")).withColumn("_s", seats.cast("long"))
    if group:
        by = Window.partitionBy(*group)
        v = v.withColumn("_sum", F.sum("_v").over(by)).withColumn("_n", F.count("*").over(by))
    else:
        v = written(v, "mix-votes")
        total, n = v.agg(F.sum("_v"), F.count("*")).first()
        v = v.withColumn("_sum", F.lit(total or 0.0)).withColumn("_n", F.lit(n))
    at = lambda spread: F.floor(F.col("_v") * (F.col("_s") + spread) / F.col("_sum") + 0.5)
    some, zero = (F.col("_sum") > 0) & (F.col("_s") > 0), F.lit(0).cast("long")
    v = v.withColumn("_lo", F.when(some, F.greatest(zero, at(-F.col("_n") / 2.0))).otherwise(zero))
    v = v.withColumn("_hi", F.when(some, at(F.col("_n") / 2.0)).otherwise(zero))
    # _lo seats are sure; of the quotients for seats _lo .. _hi, the highest _open win
    sure = F.sum("_lo").over(by) if group else F.lit(v.agg(F.sum("_lo")).first()[0] or 0)
    v = v.withColumn("_open", F.when(some, F.col("_s") - sure).otherwise(zero))
    # a vote far above the others has a wide span, but of its quotients no more than there are open seats can win
    top = F.least("_hi", F.col("_lo") + F.greatest(zero, F.col("_open")))
    ranked = v.withColumn("_k", F.explode_outer(F.when(top >= F.col("_lo"), F.sequence("_lo", top))))
    ranked = ranked.withColumn("_q", F.col("_v") / (2 * F.col("_k") + 1))
    order = [F.col("_q").desc_nulls_last(), *tie, F.col("_k")]
    ranked = ranked.withColumn("_rank", F.row_number().over(by.orderBy(*order))) if group else with_rank(ranked, order, name="_rank")
    won = ranked.withColumn("_won", F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_open")), 1).otherwise(0))
    return won.groupBy(*votes.columns, "_lo").agg(F.sum("_won").alias("_won")).select(*votes.columns, (F.col("_lo") + F.col("_won")).alias("quota"))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): a row per row of ``docs`` (doc_id long, text string, source string).

    ``taken`` is at most ``cap`` times the size (rounded up to a whole number).
    """
    sized = written(sizes(docs), "mix-sizes")
    per = written(targets(sized, weights, share, cap), "mix-targets")
    all_ = per.agg(F.sum("target")).first()[0] or 0.0
    per = apportion(per, [], F.lit(round(all_)), F.col("target"), [F.col("source").asc_nulls_last()])
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("target") / FEWEST))).cast("long")
    shards = F.least(F.lit(MAX_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))).cast("long")
    per = per.select("source", "source_size", "target", "quota", block.alias("block"), shards.alias("shards"))
    per = written(per.select("source", "source_size", "target", F.round(F.col("quota") / F.col("block")).cast("long").alias("seats"), "block", "shards"), "mix-seats")

    # a key that is never null, so that windows, aggregates and joins by source and shard share one partitioning
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    keyed = sized.withColumn("_src", name).drop("source").withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "size", "digest"))
    dealt = keyed.join(small(per.withColumn("_src", name)), "_src")
    dealt = dealt.withColumn("shard", F.pmod(F.shiftrightunsigned("_hash", 17), F.col("shards")))
    key = ["_src", "shard"]
    words = dealt.groupBy(*key, "seats").agg(F.sum("size").alias("words"))
    quotas = apportion(words, ["_src"], F.col("seats"), F.col("words"), [F.col("shard")]).select(*key, "words", "quota")

    in_order = Window.partitionBy(*key).orderBy("_hash", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.withColumn("_end", F.sum("size").over(in_order)).withColumn("_begin", F.col("_end") - F.col("size"))
    laid = laid.join(quotas, key)
    div = lambda a, b: F.call_function("div", a, b)
    one = F.lit(1).cast("long")
    laid = laid.withColumn("_b", F.greatest(one, div(F.col("words") + F.col("block") - 1, F.col("block"))))
    laid = laid.withColumn("quota", F.least("quota", (F.col("_b") * F.lit(float(cap))).cast("long")))
    laid = laid.withColumn("_rounds", div(F.col("quota"), F.col("_b"))).withColumn("_m", F.pmod("quota", "_b"))
    # run r of the m runs has the blocks from r * b div m on; the last block alone may be short, and it is in the last run
    start = lambda r: div(r * F.col("_b"), F.col("_m"))
    run_of = lambda j: div((j + 1) * F.col("_m") - 1, F.col("_b"))
    chosen = lambda r: start(r) + F.pmod(F.xxhash64(F.lit(seed), "_src", "shard", r), start(r + 1) - start(r))

    def before(word):
        """Words of the chosen blocks before this one."""
        size = F.col("block")
        j = F.least(F.col("_b") - 1, div(word, size))
        r, c = run_of(j), chosen(run_of(j))
        return r * size + F.when(c < j, size).when(c == j, word - j * size).otherwise(F.lit(0))

    extra = F.when(F.col("_m") > 0, before(F.col("_end")) - before(F.col("_begin"))).otherwise(F.lit(0))
    taken = F.when(F.col("size") > 0, F.col("_rounds") * F.col("size") + extra).otherwise(F.lit(0)).cast("long")
    return laid.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def op1_mixing_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
