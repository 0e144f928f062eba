"""N-gram Jaccard join: a size-aware heavy-light similarity join on sets of word shingles.

Two documents link when their sets of k-word shingles have a Jaccard similarity of at least ``num / den``. The operator
returns each document's set size and the component of the graph of links; copies are never expanded into pairs.

Method
  1. *Sets.* Each text becomes the sorted set of its 64-bit shingle hashes (`words.py`), and a key of that set. Documents
     with equal keys are one vertex from here on, so exact copies cost nothing more.
  2. *Repeated shingles.* A partner needs ``num / den`` of a set's shingles, so a set of which fewer occur in another set
     has no link. Counting that moves each shingle once, packed: one row per batch of documents and slice of the hash space (as many slices as keep
     each below ``SLICE_BYTES``, counted first, and a task per few of them), within which a set's part is cut out only once, and one entry of what several sets of the batch share. Only the sets that remain (near copies, mostly) go on.
  3. *Heavy and light.* The shingles of these sets are ordered by how many of the sets have them, rare ones first. A set of n shingles that needs an overlap of a is compared by the first n - a + 1 (some
     shingle of them is shared) or by the pairs among the first n - a + 2 (some pair is shared). Small sets enumerate
     those fixed-size subsets; large sets, for which there are too many, use the inverted lists of single shingles. The
     boundary is the size with the least cost: subsets made, against list entries made and scanned, from a histogram over all sets.
  4. *Verification.* Sets that share a signature form clusters. A cluster is cut into blocks of bounded size by set size;
     pairs of blocks whose sizes can reach the threshold are compared in one task each by scanning an inverted list, and a
     set is skipped once all sets it could reach are in its component. Only a spanning forest leaves the task.
  5. Connected components over those forests.

Nulls, empty texts and texts without words have the empty set and link with nothing. Repeated doc_ids fall into the component
of any of their texts and keep their own rows. Rows without a doc_id link like others, and what they link is one component; they don't name it (null, if no row of it has an id). Extra columns are ignored. The similarity is exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm import words as W
from veritally.llm.common import connected_components, forest, lean, small, written

#: Shingles of a block: a task compares at most two blocks (one set if it is larger).
BLOCK_SHINGLES = 400_000
#: Bytes of shingles in a slice of the hash space, and slices per task of a shuffle.
SLICE_BYTES, SLICES_PER_TASK = 16 << 20, 2
#: Cost of scanning an entry of an inverted list in memory, where a shuffled row (subset or entry) costs 1.
SCAN_COST = 0.005

_U = np.uint64
#: Bytes of a hash that step 2 moves (with the slice, over 50 bits). A chance match there only lets a set through to verification.
_BYTES = 6


def _need(n, num: int, den: int):
    """Least overlap of a set of n with any set it links with."""
    return -(-n * num // den)


def _sets(col: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (first row, last row + 1, hashes, offsets, keys)."""
    for a, b, h, off in W.hashed_words(col):
        s, at = W.sorted_sets(*W.shingles(h, off, k))
        n = np.diff(at)
        key = np.zeros(b - a, _U)
        full = n > 0
        if full.any():
            key[full] = W._mix(np.add.reduceat(W._mix(s ^ _U(0x5851F42D4C957F2D)), at[:-1][full]) + n[full].astype(_U))
        yield a, b, s, at, key.view(np.int64)


def _keys(k: int):
    def run(batches):
        for batch in batches:
            for a, b, _, at, key in _sets(batch.column("text"), k):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(np.diff(at)), pa.array(key)], names=["doc_id", "n", "key"])

    return run


def _slices(k: int, parts: int):
    """Rows (part, keys, counts, local, hashes, shared): what the sets of a batch have in one slice of the hash space, each set once.

    Shingles that several sets of the batch have are repeated for certain: they are counted here (``local``), and only one hash of each goes on (``shared``), so a
    shingle of very many documents is as many entries as there are batches. The others go on with their set (``counts`` of ``hashes`` per key).
    """

    def run(batches):
        for batch in batches:
            held = list(_sets(batch.column("text"), k))
            if not held:
                continue
            key = np.concatenate([x[4] for x in held])
            size = np.concatenate([np.diff(x[3]) for x in held])
            mask = np.repeat(_first(key) & (size > 0), size)
            h, owner = np.concatenate([x[2] for x in held])[mask], np.repeat(key, size)[mask]
            if not len(h):
                continue
            part = ((h >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            h, owner, part = h[order], owner[order], part[order]
            order = np.argsort(h)
            equal = h[order][1:] == h[order][:-1]
            several = np.zeros(len(h), np.bool_)
            several[order[1:]] = equal
            later = several.copy()  # all but the first of equal ones
            several[order[:-1]] |= equal
            cut = np.searchsorted(part, np.arange(parts + 1))
            rows: dict[str, list] = {c: [] for c in ("part", "keys", "counts", "local", "hashes", "shared")}
            for p in np.flatnonzero(np.diff(cut)):
                at = slice(cut[p], cut[p + 1])
                o, many = owner[at], several[at]
                first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                local = np.add.reduceat(many, first, dtype=np.int32)
                rows["part"].append(int(p))
                rows["keys"].append(o[first].tobytes())
                rows["counts"].append(_narrow(np.diff(np.append(first, len(o))) - local))
                rows["local"].append(_narrow(local))
                rows["hashes"].append(_pack(h[at][~many]))
                rows["shared"].append(_pack(h[at][many & ~later[at]]))
            yield pa.RecordBatch.from_arrays([pa.array(rows["part"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in list(rows)[1:])], names=list(rows))

    return run


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _wide(counts: pa.ChunkedArray, n: list[int]) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), f"u{len(x.as_py()) // k}") for x, k in zip(counts, n, strict=True)]).astype(np.int64)


def _first(values: np.ndarray) -> np.ndarray:
    """Marks each value where it occurs for the first time."""
    out = np.zeros(len(values), np.bool_)
    out[np.unique(values, return_index=True)[1]] = True
    return out


def _pack(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :_BYTES]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, _BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :_BYTES] = raw
    return wide.view(_U).ravel()


def _repeated(parts: int):
    """For a slice of the hash space: how many shingles of each set occur in another set too; rows (part, keys, reps), dealt anew by key."""

    def run(table: pa.Table) -> pa.Table:
        each = [np.frombuffer(x.as_py(), np.int64) for x in table.column("keys")]
        key, size = np.concatenate(each), [len(x) for x in each]
        n, local = _wide(table.column("counts"), size), _wide(table.column("local"), size)
        new = _first(key)
        shared = _unpack(b"".join(table.column("shared").to_pylist()))  # twice, of no set: repeated for certain
        mine = np.repeat(new, n)
        hashes = [_unpack(b"".join(table.column("hashes").to_pylist()))[mine], shared, shared]
        owners = [np.repeat(key, n)[mine], np.zeros(2 * len(shared), np.int64)]
        keys, reps = [key[new]], [local[new]]
        h, owner = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h)
        h, owner = h[order], owner[order]
        same = np.concatenate([[False], h[1:] == h[:-1], [False]])
        hit = owner[same[1:] | same[:-1]]
        key, inv = np.unique(np.concatenate([*keys, hit]), return_inverse=True)
        rep = np.bincount(inv, np.concatenate([*reps, np.ones(len(hit))])).astype(np.int64)
        key, rep = key[(rep > 0) & (key != 0)], rep[(rep > 0) & (key != 0)]
        part = (key.view(_U) % _U(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        key, rep, part = key[order], rep[order], part[order]
        cut = np.searchsorted(part, np.arange(parts + 1))
        some = np.flatnonzero(np.diff(cut))
        pack = lambda x: pa.array([x[cut[p] : cut[p + 1]].tobytes() for p in some], pa.binary())
        return pa.table({"part": pa.array(some, pa.int32()), "keys": pack(key), "reps": pack(rep)})

    return run


def _slice_by_slice(run):
    """Applies ``run`` to the rows of each slice; a task's rows come slice by slice."""

    def over(batches):
        held, part = [], None
        for batch in batches:
            p = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    if held and p[a] != part:
                        yield from run(pa.Table.from_batches(held)).to_batches()
                        held = []
                    part = p[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    return over


def _summed(table: pa.Table) -> pa.Table:
    """(key, rep): the counts of all slices."""
    key, rep = (np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column(c)]) for c in ("keys", "reps"))
    key, inv = np.unique(key, return_inverse=True)
    return pa.table({"key": pa.array(key, pa.int64()), "rep": pa.array(np.bincount(inv, rep).astype(np.int64), pa.int64())})


def _binary_sets(k: int):
    def run(batches):
        for batch in batches:
            for _, _, s, at, key in _sets(batch.column("text"), k):
                data = [s[at[i] : at[i + 1]].tobytes() for i in range(len(key))]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.diff(at)), pa.array(data, pa.binary())], names=["key", "n", "shingles"])

    return run


def _cut(parts: int):
    """Rows (part, keys, counts, hashes): the sets' shingles by slice of the hash space."""

    def run(batches):
        for batch in batches:
            data, n = batch.column("shingles").to_pylist(), batch.column("n").to_numpy()
            if not data:
                continue
            h, owner = np.frombuffer(b"".join(data), _U), np.repeat(batch.column("key").to_numpy(), n)
            part = ((h >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            h, owner = h[order], owner[order]
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cut))
            rows = []
            for p in some:
                o = owner[cut[p] : cut[p + 1]]
                first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                rows.append((o[first].tobytes(), np.diff(np.append(first, len(o))).astype(np.int32).tobytes(), _pack(h[cut[p] : cut[p + 1]])))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*rows, strict=True))], names=["part", "keys", "counts", "hashes"])

    return run


def _frequency(parts: int):
    """For a slice: how common each shingle is among the sets, on a scale of 8 steps per doubling; rows (to, part, keys, counts, classes), dealt by key."""

    def run(table: pa.Table) -> pa.Table:
        key, n, h = [], [], []
        for k, c, x in zip(*(table.column(c) for c in ("keys", "counts", "hashes")), strict=True):
            key.append(np.frombuffer(k.as_py(), np.int64))
            n.append(np.frombuffer(c.as_py(), np.int32))
            h.append(_unpack(x.as_py()))
        key, n, h = map(np.concatenate, (key, n, h))
        order = np.argsort(h)
        start = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        df = np.diff(np.append(start, len(h)))
        level = np.empty(len(h), np.uint8)
        level[order] = np.repeat(np.minimum(255, 8 * np.log2(df)).astype(np.uint8), df)
        to = np.mod(key, parts)
        by = np.argsort(to, kind="stable")
        at = np.concatenate([[0], np.cumsum(n)])
        rows = []
        for p, group in zip(*_groups(to[by], by), strict=True):
            rows.append((int(p), key[group].tobytes(), n[group].tobytes(), np.concatenate([level[at[i] : at[i + 1]] for i in group]).tobytes()))
        cols = list(zip(*rows, strict=True))
        return pa.table({"to": pa.array(cols[0], pa.int32()), "part": pa.array([table.column("part")[0].as_py()] * len(rows), pa.int32()), "keys": pa.array(cols[1], pa.binary()), "counts": pa.array(cols[2], pa.binary()), "classes": pa.array(cols[3], pa.binary())})

    return run


def _groups(sorted_values: np.ndarray, items: np.ndarray):
    start = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return sorted_values[start], np.split(items, start[1:])


def _heads_first(num: int, den: int):
    """(key, n, shingles, head): ``head`` has the set's rarest shingles, by class and then hash, as many as signatures need."""

    def run(sets: pa.Table, classes: pa.Table) -> pa.Table:
        found: dict[int, list[bytes]] = {}
        for k, c, x in zip(*(classes.sort_by("part").column(c) for c in ("keys", "counts", "classes")), strict=True):  # slices ascend with the hash
            n, data = np.frombuffer(c.as_py(), np.int32), x.as_py()
            at = np.concatenate([[0], np.cumsum(n)])
            for i, key in enumerate(np.frombuffer(k.as_py(), np.int64).tolist()):
                found.setdefault(key, []).append(data[at[i] : at[i + 1]])
        heads = []
        for key, n, data in zip(*(sets.column(c).to_pylist() for c in ("key", "n", "shingles")), strict=True):
            level = np.frombuffer(b"".join(found[key]), np.uint8)
            heads.append(np.frombuffer(data, _U)[np.argsort(level, kind="stable")[: n - _need(n, num, den) + 2]].tobytes())
        return sets.select(["key", "n", "shingles"]).append_column("head", pa.array(heads, pa.binary()))

    return run


def _signatures(num: int, den: int, boundary: int):
    """Rows (sig, key). Light sets (n <= boundary): pairs of the first shingles; heavy ones, and those that can link with a heavy one: single hashes."""

    def run(batches):
        for batch in batches:
            sigs, keys = [], []
            for key, n, data in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "head")), strict=True):
                s, spare = np.frombuffer(data, _U), n - _need(n, num, den)
                if n <= boundary:
                    head = s[: spare + 2]
                    i, j = np.triu_indices(len(head), 1)
                    sigs.append(W._mix(head[i] * _U(0x9E3779B97F4A7C15) + head[j]))
                    keys.append(np.full(len(i), key))
                if n * den > boundary * num or n < 2:
                    head = s[: spare + 1]
                    sigs.append(W._mix(head))
                    keys.append(np.full(len(head), key))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys), pa.int64())], names=["sig", "key"])

    return run


def _heads(num: int, den: int):
    """Rows (hash, n): the inverted lists' entries, for the cost of the boundary."""

    def run(batches):
        for batch in batches:
            n = batch.column("n").to_numpy()
            spare = n - _need(n, num, den)
            heads = [np.frombuffer(d, _U)[: x + 1] for d, x in zip(batch.column("head").to_pylist(), spare, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.repeat(n, spare + 1), pa.int64())], names=["sig", "n"])

    return run


def boundary_by_cost(sets: DataFrame, num: int, den: int) -> int:
    """The size up to which sets enumerate subsets: least (subsets made + list entries made + their scans), over the sizes that occur.

    Reads one row per power-of-1.25 class of sizes, so a few dozen rows reach the driver.
    """
    heads = sets.mapInArrow(lean(_heads(num, den)), "sig long, n long")
    lists = heads.groupBy("sig").agg(F.count("*").alias("entries"))
    scans = heads.join(lists, "sig").groupBy(F.floor(F.log("n") / F.log(F.lit(1.25))).alias("c")).agg(F.sum(F.lit(1) + F.col("entries") * SCAN_COST).alias("scan"))
    spare = F.col("n") - F.ceil(F.col("n") * num / den) + 2
    made = sets.groupBy(F.floor(F.log("n") / F.log(F.lit(1.25))).alias("c")).agg(F.max("n").alias("top"), F.sum(spare * (spare - 1) / 2).alias("made"))
    rows = sorted(made.join(scans, "c").collect(), key=lambda r: r["c"])
    costs = {0: sum(r["scan"] for r in rows)}
    for i, r in enumerate(rows):
        costs[r["top"]] = sum(x["made"] for x in rows[: i + 1]) + sum(x["scan"] for x in rows[i:])
    return min(costs, key=lambda x: (costs[x], x))


def _linked(num: int, den: int):
    """Within a task: a spanning forest of the links between the sets (of two sides, if there are two; otherwise all)."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("n", "ascending"), ("key", "ascending")])
        key, n, side = (t.column(c).to_numpy() for c in ("key", "n", "side"))
        data = t.column("shingles").to_pylist()
        h = np.frombuffer(b"".join(data), _U)
        at = np.concatenate([[0], np.cumsum(n)])
        _, token = np.unique(h, return_inverse=True)
        order = np.argsort(token, kind="stable")
        row = np.repeat(np.arange(len(n)), n)[order]  # inverted lists, each ascending in n
        start = np.searchsorted(token[order], np.arange(token.max() + 2 if len(token) else 1))
        label = np.arange(len(n))
        two = len(np.unique(side)) > 1
        u, v = [], []
        for i in range(len(n)):
            hi = int(np.searchsorted(n * num, n[i] * den, "right"))  # the partners not smaller than i, within the threshold
            if not ((label[i + 1 : hi] != label[i]) & (not two or side[i + 1 : hi] != side[i])).any():
                continue
            mine = token[at[i] : at[i + 1]]
            lo, up = start[mine], start[mine + 1]
            size = up - lo
            scan = np.arange(size.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            found = np.bincount(row[scan], minlength=len(n))[i + 1 : hi]
            hit = np.flatnonzero(found * den >= num * (n[i] + n[i + 1 : hi] - found)) + i + 1
            others, first = np.unique(label[hit], return_index=True)
            new = others != label[i]
            if new.any():
                u += [key[i]] * int(new.sum())
                v += key[hit[first[new]]].tolist()
                label[np.isin(label, others[new])] = label[i]
        x, y = forest(np.array(u, np.int64), np.array(v, np.int64))
        return pa.table({"u": pa.array(x, pa.int64()), "v": pa.array(y, pa.int64())})

    return run


def ngram_jaccard_join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, parts: int | None = None) -> DataFrame:
    """Returns (doc_id, n_shingles, component_id): a row per row of ``docs`` (doc_id long, text string).

    ``component_id`` is the smallest doc_id that the document reaches by links of Jaccard similarity >= num / den.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    keys = written(docs.mapInArrow(lean(_keys(k)), "doc_id long, n long, key long"), "ngram-keys")
    size = (keys.agg(F.sum("n")).first()[0] or 0) * _BYTES
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SLICE_BYTES))
    sets = keys.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.count("*").alias("copies"))

    sliced = docs.mapInArrow(lean(_slices(k, parts)), "part int, keys binary, counts binary, local binary, hashes binary, shared binary")
    dealt = sliced.repartitionById(-(-parts // SLICES_PER_TASK), F.floor(F.col("part") / SLICES_PER_TASK).cast("int")).sortWithinPartitions("part")
    counted = dealt.mapInArrow(lean(_slice_by_slice(_repeated(parts))), "part int, keys binary, reps binary")
    rep = counted.groupBy("part").applyInArrow(lean(_summed), "key long, rep long")
    near = written(rep.join(sets, "key").where(F.col("rep") * den >= F.col("n") * num).select("key", "doc_id"), "ngram-near")
    texts = docs.join(small(near.select("doc_id").distinct()), "doc_id", "left_semi")
    if near.where("doc_id IS NULL").limit(1).count():  # sets that only rows without an id have: these are told apart by key, below
        texts = texts.union(docs.where("doc_id IS NULL"))
    full = texts.mapInArrow(lean(_binary_sets(k)), "key long, n long, shingles binary").join(near.select("key"), "key", "left_semi")
    full = written(full.dropDuplicates(["key"]), "ngram-sets")
    levels = full.mapInArrow(lean(_cut(parts)), "part int, keys binary, counts binary, hashes binary").groupBy("part").applyInArrow(lean(_frequency(parts)), "to int, part int, keys binary, counts binary, classes binary")
    ordered = full.withColumn("to", F.pmod("key", F.lit(parts)).cast("int")).groupBy("to").cogroup(levels.groupBy("to"))
    full = written(ordered.applyInArrow(_heads_first(num, den), "key long, n long, shingles binary, head binary"), "ngram-ordered")

    boundary = boundary_by_cost(full, num, den)
    sig = written(full.mapInArrow(lean(_signatures(num, den, boundary)), "sig long, key long"), "ngram-signatures")
    low = sig.groupBy("sig").agg(F.min("key").alias("v"), F.count("*").alias("c")).where("c > 1").select("sig", "v")
    shared = sig.join(low, "sig").where("key <> v").select(F.col("key").alias("u"), "v")
    cluster = connected_components(shared, "ngram-clusters")

    member = written(full.join(cluster.withColumnRenamed("node", "key"), "key").select("key", "n", "shingles", F.col("component").alias("cluster")), "ngram-members")
    sized = member.select("key", "n", "cluster", F.floor(F.log("n") / F.log(F.lit(den / num))).alias("c"))
    total = small(written(sized.groupBy("cluster").agg(F.sum("n").alias("all_n")), "ngram-cluster-sizes"))
    by_class = small(written(sized.groupBy("cluster", "c").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks")), "ngram-blocks"))
    pools = F.greatest(F.lit(1), F.ceil(sized.agg(F.sum("n")).collect()[0][0] / F.lit(BLOCK_SHINGLES))) if cluster.limit(1).count() else F.lit(1)
    tiny = total.where(F.col("all_n") <= BLOCK_SHINGLES).select("cluster", F.pmod(F.xxhash64("cluster"), pools).alias("pool"))
    light = member.join(tiny, "cluster").select(F.col("pool").alias("cluster"), F.lit(-1).alias("x"), F.lit(-1).alias("y"), F.lit(0).alias("side"), "key", "n", "shingles")

    # a large cluster: (class, block) against itself, the blocks after it in the class, and all blocks of the next class
    at = member.join(total.where(F.col("all_n") > BLOCK_SHINGLES).select("cluster"), "cluster").withColumn("c", F.floor(F.log("n") / F.log(F.lit(den / num))))
    at = at.join(by_class, ["cluster", "c"]).withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")))
    up = by_class.select("cluster", (F.col("c") - 1).alias("c"), F.col("blocks").alias("up"))
    down = by_class.select("cluster", (F.col("c") + 1).alias("c"), F.col("blocks").alias("down"))
    at = at.join(up, ["cluster", "c"], "left").join(down, ["cluster", "c"], "left")
    name = lambda c, b: F.struct(c.cast("long").alias("c"), b.cast("long").alias("b"))
    each = lambda count: F.sequence(F.lit(0), F.coalesce(count, F.lit(0)).cast("int") - 1)
    some = lambda count, f: F.when(F.coalesce(count, F.lit(0)) > 0, F.transform(each(count), f)).otherwise(F.array().cast("array<struct<x:struct<c:bigint,b:bigint>,y:struct<c:bigint,b:bigint>>>"))
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    own = name(F.col("c"), F.col("b"))
    tasks = F.concat(
        some(F.col("blocks"), lambda o: pair(name(F.col("c"), F.least(o, F.col("b"))), name(F.col("c"), F.greatest(o, F.col("b"))))),
        some(F.col("up"), lambda o: pair(own, name(F.col("c") + 1, o))),
        some(F.col("down"), lambda o: pair(name(F.col("c") - 1, o), own)),
    )
    heavy = at.withColumn("t", F.explode(tasks)).select("cluster", F.xxhash64("t.x").alias("x"), F.xxhash64("t.y").alias("y"), F.when(F.col("t.x") == own, 0).otherwise(1).alias("side"), "key", "n", "shingles")
    compare = _linked(num, den)
    cols = "u long, v long"
    links = light.groupBy("cluster", "x", "y").applyInArrow(lean(compare), cols).union(heavy.groupBy("cluster", "x", "y").applyInArrow(lean(compare), cols))
    comp = connected_components(links, "ngram-links")

    # only sets that are linked or have copies need a component other than the document itself
    least = sets.select("key", F.col("doc_id").alias("least"), "copies")
    linked = least.join(comp.withColumnRenamed("node", "key"), "key", "left").where("component IS NOT NULL OR copies > 1")
    linked = written(linked, "ngram-linked")
    first = linked.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("first"))
    of = linked.join(small(first), "component", "left").select("key", F.coalesce("first", "least").alias("component_id"))
    of = small(written(of, "ngram-components"))
    return keys.join(of, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the smallest doc_id of each component only.

    Null and empty texts link with nothing and stay, as do rows without a doc_id; rows that repeat a doc_id stay or go together. An empty table stays empty.
    """
    gone = written(ngram_jaccard_join(docs, **options).where("doc_id <> component_id").select("doc_id").distinct(), "ngram-gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
