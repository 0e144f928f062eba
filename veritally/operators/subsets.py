"""The subset document: which ids make up each evaluation subset, with hashes, as a versioned JSON document that later runs are checked against."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.functions.text import id_key
from veritally.operators.ranks import with_rank
from veritally.versions import Versions

#: Ids of a digest node.
LEAF = 4096


def tree_hash(ids: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, hash) of the sets of ``id`` strings: equal sets hash alike, however they are partitioned or repeated.

    The distinct ids in order are cut into leaves of ``LEAF``; a leaf's digest is that of its ids, one a line; a node's that of its leaves' digests, ``LEAF`` of them, and so on to one; a node over one digest is that digest. No row holds more than ``LEAF``
    ids or digests, whatever the set's size. A set of one leaf has the digest of its ids, one a line.
    """
    by = by or []
    level = with_rank(ids.select(*by, "id").distinct(), [F.col("id")], by, "place").select(*by, "place", F.col("id").alias("text"))
    sizes = ids.select(*by, "id").distinct().groupBy(*by).agg(F.count("*").alias("n"))
    most, higher = sizes.agg(F.max("n")).first()[0] or 0, False
    while True:
        node = F.floor((F.col("place") - 1) / LEAF)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n")
        alone = F.when(F.count("*") == 1, F.first("text")) if higher else F.when(F.lit(False), F.lit(""))
        level = level.groupBy(*by, (node + 1).alias("place")).agg(F.coalesce(alone, F.sha2(joined, 256)).alias("text"))
        most, higher = -(-most // LEAF), True
        if most <= 1:
            break
    out = level.select(*by, F.col("text").alias("hash"))
    return sizes.join(out, by) if by else sizes.crossJoin(F.broadcast(out))


def document(members: DataFrame, full: DataFrame, plan: list[dict], seed: int, min_per_stratum: int) -> dict:
    """The document of ``members`` (subset, stratum, id: all subsets, a few thousand ids) and ``full`` (split, stratum, id). ``plan`` has a dict per subset: name, split, parent, floor."""
    whole = {r["split"]: {"n": r["n"], "hash": r["hash"]} for r in tree_hash(full, ["split"]).collect()}
    hashes = {r["subset"]: r for r in tree_hash(members, ["subset"]).collect()}
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*id_key(F.col("id"))))), lambda x: x["id"])
    ids = {r["subset"]: r["ids"] for r in members.select("subset", "id").groupBy("subset").agg(ordered.alias("ids")).collect()}
    strata: dict[str, dict[str, int]] = {}
    for r in members.groupBy("subset", "stratum").count().orderBy("subset", "stratum").collect():
        strata.setdefault(r["subset"], {})[r["stratum"]] = r["count"]
    entry = lambda p: {"split": p["split"], "n": hashes[p["name"]]["n"], "hash": hashes[p["name"]]["hash"], "parent": p.get("parent"), "min_per_stratum_applied": p["floor"], "per_stratum": strata[p["name"]], "ids": ids[p["name"]]}
    return {"schema_version": 1, "seed": seed, "n_strata": full.select("stratum").distinct().count(), "min_per_stratum": min_per_stratum, "full": whole, "subsets": {p["name"]: entry(p) for p in plan}}


def write_subsets(spark: SparkSession, path: str, doc: dict) -> int:
    """The next version of the document; the number of the latest, if that says the same."""
    text = json.dumps(doc, sort_keys=True, ensure_ascii=False)
    versions = Versions(spark, path)
    last = versions.latest()
    if last and versions.read(last) == text:
        return last
    return versions.append(lambda _: text)


def read_subsets(spark: SparkSession, path: str) -> dict:
    """The latest version, if its subsets hash to what it says."""
    versions = Versions(spark, path)
    if not versions.latest():
        raise FileNotFoundError(f"{path} holds no subset document")
    doc = json.loads(versions.read(versions.latest()))
    for name, entry in doc["subsets"].items():
        if sequential_hash(entry["ids"]) != entry["hash"]:
            raise ValueError(f"subset {name} doesn't have the hash it names")
    return doc


def sequential_hash(ids: list[str]) -> str:
    """What `tree_hash` gives a document's ids."""
    digest = lambda part: hashlib.sha256("\n".join(part).encode()).hexdigest()
    parts = lambda level: [level[i : i + LEAF] for i in range(0, len(level), LEAF)]
    level = [digest(part) for part in parts(sorted(set(ids), key=str.encode))]
    while len(level) > 1:
        level = [part[0] if len(part) == 1 else digest(part) for part in parts(level)]
    return level[0] if level else digest([])


def drift(spark: SparkSession, doc: dict, full: DataFrame) -> DataFrame:
    """(what, note): where the document and the present rows ``full`` (split, id) differ: splits of another size or hash, ids of a subset that its split doesn't have, subsets outside their parents. Empty if nothing has moved."""
    schema = "split string, was_n long, was_hash string"
    was = spark.createDataFrame([(s, x["n"], x["hash"]) for s, x in doc["full"].items()], schema)
    both = was.join(tree_hash(full, ["split"]), "split", "full_outer")
    moved = both.where("NOT (was_hash <=> hash)").select(F.concat(F.lit("split "), "split").alias("what"), F.concat(F.lit("had "), F.coalesce(F.col("was_n").cast("string"), F.lit("no")), F.lit(" ids, has "), F.coalesce(F.col("n").cast("string"), F.lit("none"))).alias("note"))
    listed = spark.createDataFrame([(n, e["split"], i) for n, e in doc["subsets"].items() for i in e["ids"]] or [], "name string, split string, id string")
    gone = listed.join(full.select("split", "id").distinct(), ["split", "id"], "left_anti").groupBy("name").count()
    out = moved.union(gone.select(F.concat(F.lit("subset "), "name"), F.concat(F.col("count").cast("string"), F.lit(" ids aren't in the split"))))
    loose = [(f"subset {n}", f"isn't within {e['parent']}") for n, e in doc["subsets"].items() if e.get("parent") and not set(e["ids"]) <= set(doc["subsets"][e["parent"]]["ids"])]
    return out.union(spark.createDataFrame(loose, "what string, note string")) if loose else out
