"""Fingerprints, locks, comparisons, merges."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.storage import small
from veritally.versions import Versions

KEY = ["system", "subset", "subset_hash", "config_hash"]


def canonical(value) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(components: dict) -> dict[str, str]:
    """SHA-256 per component, and under ``config`` of all of them. Operational limits don't belong in the components."""
    each = {k: hashlib.sha256(canonical(v).encode()).hexdigest() for k, v in components.items()}
    return each | {"config": hashlib.sha256(canonical(each).encode()).hexdigest()}


def fingerprint_columns(components: dict[str, Column]) -> Column:
    """struct of a SHA-256 per component and of ``config`` over all of them, for components that are columns of canonical JSON."""
    each = {k: F.sha2(components[k], 256) for k in sorted(components)}
    whole = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":"'), h, F.lit('"')) for k, h in each.items())), F.lit("}"))
    return F.struct(*(h.alias(k) for k, h in each.items()), F.sha2(whole, 256).alias("config"))


def prompt_fingerprint(messages: Column) -> Column:
    return F.sha2(F.to_json(messages), 256)


def new_locks(wanted: DataFrame, history: DataFrame) -> DataFrame:
    """The wanted entries that aren't locked yet; a reason is required."""
    reasoned = wanted.where(F.assert_true(F.length(F.trim("reason")) > 0, "a lock needs a reason").isNull())
    return reasoned.join(history.select(*KEY), KEY, "left_anti")


class LockRefused(RuntimeError):
    """A lock that may not be written."""


def lock_blockers(systems: DataFrame, prices: DataFrame) -> DataFrame:
    """(system, blocker) for ``systems`` (system, price_id string, checkpoint map<string,string>): what keeps a system from being locked. ``prices`` has a column price_id."""
    unpriced = systems.where("price_id IS NOT NULL").join(prices.select("price_id").distinct(), "price_id", "left_anti").select("system", F.concat(F.lit("no price for "), "price_id").alias("blocker"))
    field = F.explode(F.map_entries("checkpoint")).alias("f")
    unset = systems.select("system", field).where("coalesce(f.value, '') = ''").select("system", F.concat(F.lit("checkpoint."), "f.key", F.lit(" is not set")).alias("blocker"))
    return unpriced.union(unset)


def read_lock_documents(spark, path: str, upto: int | None = None) -> DataFrame:
    """(number, the fields of a lock): the history that `write_locks` has made; empty if there is none."""
    from veritally.sources.files import LOCK

    numbers = [n for n in Versions(spark, path).numbers() if upto is None or n <= upto]
    if not numbers:
        return spark.createDataFrame([], f"number long, {LOCK}")
    read = spark.read.schema(LOCK).json([f"{path}/{n:010d}.json" for n in numbers])
    return read.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long").alias("number"), "*")


def write_locks(wanted: DataFrame, blockers: DataFrame, path: str, most: int = 1000) -> int:
    """Appends the wanted locks (the fields of a lock; few) to the history at ``path``, all or none; returns the number of their document.

    Refused are locks without a reason, of a system with a blocker, and of a key that the history has. Of two writers of one key one is refused: the second finds its number taken, reads again and then meets the key.
    """
    spark = wanted.sparkSession
    entries = wanted.select(*KEY, "reason", F.to_json(F.struct(*wanted.columns)).alias("line")).limit(most + 1).collect()
    if not entries or len(entries) > most:
        raise LockRefused(f"between 1 and {most} locks can be written at once")
    if any(not (e["reason"] or "").strip() for e in entries):
        raise LockRefused("a lock needs a reason")
    stopped = [f"{r['system']}: {r['blocker']}" for r in blockers.join(F.broadcast(wanted.select("system").distinct()), "system", "left_semi").orderBy("system", "blocker").limit(20).collect()]
    if stopped:
        raise LockRefused("; ".join(stopped))
    keys = [tuple(e[k] for k in KEY) for e in entries]
    if len(set(keys)) < len(keys):
        raise LockRefused("a key is wanted twice")

    def document(last: int) -> str:
        taken = read_lock_documents(spark, path, last).join(F.broadcast(wanted.select(*KEY)), KEY, "left_semi").select("system", "subset").orderBy("system", "subset").limit(20).collect()
        if taken:
            raise LockRefused("already locked: " + ", ".join(f"{r['system']} on {r['subset']}" for r in taken))
        return "\n".join(e["line"] for e in entries) + "\n"

    return Versions(spark, path).append(document)


def lock_status(wanted: DataFrame, history: DataFrame) -> DataFrame:
    """Per wanted configuration: ``locked``, or which components differ from the latest lock of its system and subset (null if there is none)."""
    last = history.groupBy("system", "subset").agg(F.max_by(F.struct("components", "config_hash", "subset_hash"), "pos").alias("_l"))
    exact = history.select(*KEY).distinct().withColumn("_hit", F.lit(True))
    both = wanted.join(last, ["system", "subset"], "left").join(exact, KEY, "left")
    changed = F.array_sort(F.filter(F.map_keys("components"), lambda k: ~F.col("components")[k].eqNullSafe(F.col("_l.components")[k])))
    return both.select("system", "subset", F.coalesce("_hit", F.lit(False)).alias("locked"), F.when(F.col("_l").isNotNull(), F.array_join(changed, ",")).alias("changed"))


def merge_new_wins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones with their key; the others stay."""
    cols = [c for c in old.columns if c != key]
    o = old.select(key, F.struct(*cols).alias("_o"))
    n = new.select(key, F.struct(*cols).alias("_n"))
    return o.join(n, key, "full_outer").select(key, F.coalesce("_n", "_o").alias("_r")).select(key, "_r.*")


def first_per_key(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), pos).alias("_r")).select(*keys, "_r.*")


def pair_scores(scored: DataFrame, reference: str) -> DataFrame:
    """Each other system's items beside the reference's, where both have answered: (system, id, em, ref_em). One aggregation instead of a self-join."""
    by = scored.groupBy("id").agg(F.collect_list(F.struct("system", "em")).alias("all"), F.max(F.when(F.col("system") == reference, F.col("em"))).alias("ref_em"))
    each = by.where(F.col("ref_em").isNotNull()).select("id", "ref_em", F.inline("all"))
    return each.where(F.col("system") != reference).select("system", "id", "em", "ref_em")


def plain_number(x: Column) -> Column:
    """Infinite and undefined numbers as null, for JSON."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def run_warnings(runs: DataFrame) -> DataFrame:
    """(system, warning): runs without a summary, partial, unlocked, estimated or repriced ones, and those on another subset than the present one.

    ``runs`` may have has_summary boolean, ran_hash and subset_hash string; where a run has no summary nothing else is known of it.
    """
    there = F.col("has_summary") if "has_summary" in runs.columns else F.lit(True)
    moved = F.coalesce(F.col("ran_hash") != F.col("subset_hash"), F.lit(False)) if {"ran_hash", "subset_hash"} <= set(runs.columns) else F.lit(False)
    notes = F.when(~there, F.array(F.lit("no summary: cost, latency and provenance are unknown"))).otherwise(F.array(
        F.when(moved, F.lit("different subset: the ids have changed since the run")),
        F.when(F.col("n") < F.col("n_subset"), F.concat(F.lit("partial: "), F.col("n").cast("string"), F.lit(" of "), F.col("n_subset").cast("string"))),
        F.when(~F.col("locked"), F.lit("not locked")), F.when(F.col("n_estimated") > 0, F.lit("estimated tokens")), F.when(F.col("price_then") != F.col("price_now"), F.lit("price changed")),
    ))
    return runs.select("system", F.explode(F.filter(notes, lambda x: x.isNotNull())).alias("warning"))


def unknown_ids(predictions: DataFrame, examples: DataFrame) -> DataFrame:
    """(system, n): predictions (system, id) for ids that no example has, counted per system; systems without any aren't listed."""
    return predictions.join(examples.select("id"), "id", "left_anti").groupBy("system").agg(F.count("*").alias("n"))


def in_order(ids: DataFrame, examples: DataFrame) -> DataFrame:
    """Rows of ``examples`` for the ids of a subset (id, position), with the position, in its order over range partitions; an id that has no example is an error that names one."""
    rows = examples.join(small(ids).select("id"), "id", "left_semi").withColumn("_there", F.lit(True))
    found = ids.join(small(rows), "id", "left")
    known = F.assert_true(F.coalesce("_there", F.lit(False)), F.concat(F.lit("not in the split: "), F.col("id").cast("string")))
    return found.where(known.isNull()).drop("_there").repartitionByRange("position").sortWithinPartitions("position")


def half_width(low: Column, high: Column) -> Column:
    return (high - low) / 2


def with_widest(intervals: DataFrame, low: Column, high: Column) -> DataFrame:
    """``intervals`` (a report's pairs, few) with ``half``, the half-width of each, and ``widest``, the largest."""
    each = intervals.withColumn("half", half_width(low, high))
    return each.crossJoin(F.broadcast(each.agg(F.max("half").alias("widest"))))


def checked_subset(subset: DataFrame, examples: DataFrame, expected_hash: str) -> DataFrame:
    """The subset's ids, if their hash is the expected one and all are in the split; otherwise an error."""
    from veritally.operators.sampling import id_set_hash

    found = subset.agg(id_set_hash(F.col("id")).alias("h")).first()["h"]
    if found != expected_hash:
        raise ValueError(f"the subset's hash is {found}, not {expected_hash}")
    missing = subset.join(examples.select("id"), "id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} ids of the subset aren't in the split")
    return subset


def check_system(spec: dict, prompts, subsets, most_tokens: int) -> dict:
    """A system's configuration, if it has what a run needs; otherwise an error that names what is wrong."""
    wrong = [f"{k} is missing" for k in ("name", "endpoint", "model", "prompt", "subset", "max_output_tokens") if spec.get(k) is None]
    if not wrong:
        if spec["prompt"] not in prompts:
            wrong.append(f"prompt {spec['prompt']} is unknown")
        if spec["subset"] not in subsets:
            wrong.append(f"subset {spec['subset']} is not a test subset")
        if not 0 < spec["max_output_tokens"] <= most_tokens:
            wrong.append(f"max_output_tokens must be in 1 .. {most_tokens}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return spec


def request_body(model: str, messages: Column, params: dict[str, str], dropped=()) -> Column:
    """JSON of a request; parameters in ``dropped`` are left out last."""
    kept = {k: v for k, v in params.items() if k not in dropped}
    fields = [F.lit(model).alias("model"), messages.alias("messages"), *(F.lit(v).alias(k) for k, v in kept.items())]
    return F.to_json(F.struct(*fields))


def distinct_warnings(warnings: DataFrame) -> DataFrame:
    """One row for warnings that begin alike (up to the first colon), with how many there are."""
    start = F.substring_index("warning", ":", 1)
    return warnings.groupBy(start.alias("warning")).agg(F.count("*").alias("n"))
