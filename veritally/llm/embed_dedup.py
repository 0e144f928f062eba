"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one kept per group.

Method
  1. Vectors that are null, zero or hold null or non-finite components link with nothing. Equal vectors become one vertex with a count.
  2. *Cells.* Centres start from the vectors with the smallest hashes (about one per ``CELL`` vectors or per block, ``MAX_CELLS`` at most) and are moved by ``ROUNDS`` rounds of spherical k-means
     over all vectors; only sums of fixed size reach the driver.
  3. *Assignment.* Centres within ``NEAR`` degrees of a larger cell's are dropped, so a tight group is few cells. A vector is at home in its nearest centre's cell, and visits each cell that can
     be the home of a vector within the threshold's angle: one whose bisector with the home is no farther than that angle. Of two cells only one is visited from the other, so a pair
     shares the home of one of its vectors for certain, in any dimension and for any spread. Vectors that vary evenly in many directions visit most cells.
  4. *Products.* The vectors at home in a cell are compared with each other and with the visitors, in blocks of bounded size and twice as many visitors; a task holds two blocks, so a
     cell with a third of all vectors is many tasks. If no cell could be left out, all products would be T tasks of N / sqrt(2 T) by as many vectors, and each vector would be sent to
     about sqrt(2 T) of them: that size, for a few tasks T per core, is the blocks', within ``BLOCK`` vectors and ``BLOCK_BYTES``. So what is sent grows with the table, not with its square, until blocks
     are as large as memory allows. Cosines are matrix products in double precision. A pair is met in one task. A task returns link counts and a spanning forest, never pairs.
  5. Connected components over the forests.

The vec_id kept for a component is its smallest. Equal vec_ids are rows of their own that share a component if their vectors link. Vectors of other lengths are compared among
themselves. Rows with a null vec_id link with nothing and have a null component. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import connected_components, forest, lean, small, written

CELL, MAX_CELLS, ROUNDS = 2048, 4096, 3
#: The least vectors and the most bytes (in double precision) of a block, tasks per core, and products that a task holds at once.
BLOCK, BLOCK_BYTES, TASKS, PRODUCTS = 2048, 16 << 20, 4, 1 << 22
#: Degrees beyond the nearest centre up to which cells are visited; None: no such limit, so that no link is missed.
MARGIN = None
#: Degrees within which two centres become one.
NEAR = 30.0


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of unit length in double precision."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return _unit(col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _sums(centres: np.ndarray):
    def run(batches):
        total, mark = np.zeros_like(centres), 0
        for batch in batches:
            x = _matrix(batch.column("embedding"), centres.shape[1])
            np.add.at(total, (x @ centres.T).argmax(axis=1), x)
            mark += len(batch)
        if mark:
            yield pa.RecordBatch.from_arrays([pa.array([mark % 16], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])

    return run


def _add(table: pa.Table) -> pa.Table:
    return pa.table({"sums": pa.array([np.sum([np.frombuffer(x.as_py()) for x in table.column("sums")], axis=0).tobytes()], pa.binary())})


def centres(vectors: DataFrame, k: int, dim: int, rounds: int = ROUNDS) -> np.ndarray:
    seeds = vectors.orderBy(F.xxhash64("id"), "id").limit(k).select("embedding").toArrow()
    c = _matrix(seeds.column("embedding"), dim)
    weight = np.ones(len(c))
    for _ in range(rounds):
        rows = vectors.select("embedding").mapInArrow(lean(_sums(c)), "slot int, sums binary").groupBy("slot").applyInArrow(lean(_add), "sums binary").collect()
        s = np.sum([np.frombuffer(r["sums"]) for r in rows], axis=0).reshape(c.shape)
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(norm > 0, s / np.where(norm > 0, norm, 1), c)
        weight = norm[:, 0]
    kept: list[int] = []
    limit = math.cos(math.radians(NEAR))
    for i in np.argsort(-weight, kind="stable"):  # a sum's length is about its cell's size
        if not kept or (c[kept] @ c[i]).max() < limit:
            kept.append(int(i))
    return c[kept]


def _assign(c: np.ndarray, margin: float | None, least: float):
    reach = math.sqrt(1 - least * least) if least > 0 else 1.0  # the sine of the threshold's angle
    number = np.arange(len(c))

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.slice(a, 1024)
                raw = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1])
                cosine = _unit(raw) @ c.T
                home = cosine.argmax(axis=1)
                apart = np.sqrt(np.maximum(0.0, 2 - 2 * (c[home] @ c.T)))  # between the home's centre and the others
                near = cosine.max(axis=1, keepdims=True) - cosine <= reach * apart + 1e-9
                if margin is not None:
                    angle = np.arccos(np.clip(cosine, -1, 1))
                    near &= angle <= angle.min(axis=1, keepdims=True) + math.radians(margin)
                near &= (number[None, :] < home[:, None]) == ((number[None, :] + home[:, None]) % 2 == 0)  # of two cells one is visited
                cells = np.nonzero(near)[1]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], near.sum(axis=1).cumsum()]), pa.int32()), pa.array(cells, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copies"), pa.array([v.tobytes() for v in np.ascontiguousarray(raw)], pa.binary()), pa.array(home, pa.int32()), lists], names=["id", "copies", "vector", "home", "visits"])

    return run


def _compare(least: float, kind: str):
    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("id")
        ids, copies, side = (t.column(c).to_numpy() for c in ("id", "copies", "side"))
        x = _unit(np.frombuffer(b"".join(t.column("vector").to_pylist()), kind).reshape(len(ids), -1))
        two = t.column("x")[0].as_py() != t.column("y")[0].as_py()
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(ids)),) * 2
        y = x[right]
        links = np.zeros(len(ids), np.int64)
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, PRODUCTS // max(1, len(right)))
        for a in range(0, len(left), step):
            b = 0 if two else a
            hit = x[left[a : a + step]] @ y[b:].T >= least
            i, j = np.nonzero(hit if two else np.triu(hit, 1))
            i, j = left[i + a], right[j + b]
            for s in range(0, len(i), 100_000):
                p, q = i[s : s + 100_000], j[s : s + 100_000]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                e, r = forest(ids[p], ids[q])
                u.append(e)
                v.append(r)
        e, r = forest(np.concatenate(u), np.concatenate(v))
        some = links > 0
        return pa.table({"edge": pa.array(np.repeat([False, True], [some.sum(), len(e)])), "u": pa.array(np.concatenate([ids[some], e]), pa.int64()), "v": pa.array(np.concatenate([links[some], r]), pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.95, margin: float | None = MARGIN, cell: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row per row of ``vectors`` (vec_id long, embedding array of float or double).

    ``n_links`` counts the other rows whose cosine with this one is at least ``least``. With a ``margin`` links across cells may be missed. ``cell`` sets the vectors per cell.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"  # moved as they are, multiplied in double precision
    sound = F.col("vec_id").isNotNull() & F.coalesce((F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(e, lambda c: c != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(sound, F.col("embedding").cast(f"array<{kind}>")).alias("embedding"))
    reps = written(rows.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")), "embed-distinct")
    # equal vec_ids may hold different vectors, so vertices have ids of their own that ascend with vec_id only within equal vectors
    reps = written(reps.withColumn("id", F.xxhash64("embedding")), "embed-vertices")
    found = spark.createDataFrame([], "edge boolean, u long, v long")
    for size in sorted(reps.groupBy(F.size("embedding").alias("dim")).count().collect()):
        mine = reps.where(F.size("embedding") == size["dim"])
        side = min(max(BLOCK, math.ceil(size["count"] / math.sqrt(2 * TASKS * spark.sparkContext.defaultParallelism))), max(1, BLOCK_BYTES // (8 * size["dim"])))
        k = max(1, min(MAX_CELLS, -(-size["count"] // (cell or max(CELL, side)))))
        placed = mine.select("id", "copies", "embedding").mapInArrow(lean(_assign(centres(mine, k, size["dim"]), margin, least)), "id long, copies long, vector binary, home int, visits array<int>")
        placed = written(placed, "embed-cells")
        cells = F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(True).alias("lives"))), F.transform("visits", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("lives"))))
        each = placed.select("id", "copies", "vector", F.inline(cells))
        blocks = each.groupBy("cell").agg(*(F.ceil(F.count_if(who) / n).cast("int").alias(name) for name, who, n in (("homes", F.col("lives"), side), ("guests", ~F.col("lives"), 2 * side))))
        each = each.join(small(written(blocks, "embed-blocks")), "cell").withColumn("b", F.pmod("id", F.when(F.col("lives"), F.col("homes")).otherwise(F.col("guests"))).cast("int"))
        # blocks of guests are numbered after those at home
        task = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side.alias("side"))
        upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda o: o < n)
        home, b = F.col("homes"), F.col("b")
        among = F.transform(upto(home), lambda o: task(F.least(o, b), F.greatest(o, b), (o < b).cast("int")))
        with_guests = F.transform(upto(F.col("guests")), lambda o: task(b, home + o, F.lit(0)))
        guest = F.transform(upto(home), lambda o: task(o, home + b, F.lit(1)))
        each = each.select("cell", "id", "copies", "vector", F.inline(F.when(F.col("lives"), F.concat(among, with_guests)).otherwise(guest)))
        found = found.union(each.groupBy("cell", "x", "y").applyInArrow(lean(_compare(least, {"float": "f4", "double": "f8"}[kind])), "edge boolean, u long, v long"))
    found = written(found, "embed-links")
    comp = connected_components(found.where("edge").select("u", "v"), "embed-components").withColumnRenamed("node", "id")
    links = found.where("NOT edge").groupBy(F.col("u").alias("id")).agg(F.sum("v").alias("links"))
    linked = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    vertex = reps.join(links, "id", "left").join(comp, "id", "left").select("embedding", "first", linked, F.coalesce("component", "id").alias("component"))
    least_of = vertex.groupBy("component").agg(F.min("first").alias("component_id"))
    vertex = vertex.join(least_of, "component").select("embedding", "links", "component_id")
    out = rows.join(vertex, "embedding", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
