"""WARC: deterministic sharded writer and reader.

Method
  1. *Records.* A page's payload is its html in UTF-8 (null: empty). Of pages with equal payloads (by SHA-1 and length) of at least ``REVISIT_BYTES``, that with the
     largest page_id is a response, the others are revisits of it; all smaller payloads are responses. Revisits carry no payload, and theirs isn't shuffled.
  2. *Range sort.* The records' ids, digests and bytes, without payloads, are put in order over all machines; the running sum of the bytes cuts that order into shards of equal
     size, whatever the spread of the ids. The shards' first (page_id, digest) go to every task, ``MAX_SHARDS`` of them at most. A record goes to its shard's task,
     which sorts by page_id: shards are ascending ranges, and the same input gives the same shards wherever it runs. One page_id with very many records is cut by digest; records
     equal in both, if there are more than a shard holds, are dealt over their shards by url and place in the input.
  3. *Files.* A shard's task writes gzip members, one per record, rolls to a new file when the compressed size reaches ``ROLL_BYTES``, and
     regenerates headers, lengths, block and payload digests. Record ids derive from page id and digest; dates are a parameter. So reruns write the same bytes.
  4. *Commit.* A file is written under a temporary name and moved to its final one when complete. Its row of the manifest (name, records, bytes, SHA-1, id range)
     becomes visible only when Spark commits the manifest as a whole; readers use only what the manifest names, and check it. A reader holds one compressed file and
     ``READ_BYTES`` of records (one record if it is larger).

Null page_ids stand first. Ids may be any long. Rows with the page_id of the response of their payload are all responses. A url is percent-encoded where it holds
control characters or blanks; a null url gives no target. Extra columns are ignored. Without rows there is an empty manifest.
The archive's folder may be on any store that both Spark and pyarrow know by URI.
A payload holds the bytes of the html as they are, valid UTF-8 or not; an url that isn't is written with replacement characters.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritally.llm.common import lean, scratch_path, small, strings, written

REVISIT_BYTES = 1000
ROLL_BYTES = 32 << 20
SHARD_BYTES = 64 << 20
#: The most shards, and so tasks of the writer, and the bytes that a record's headers count for.
MAX_SHARDS, HEAD_BYTES = 65_536, 500
READ_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"
# Fixed value: the profile of revisits with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6b0f6a5e-6a56-4f0e-9d3c-2f6f2f1c7a11")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
MANIFEST = "file string, shard int, records long, bytes long, sha1 string, first_id long, last_id long"
ARCHIVE = "page_id long, url string, record_type string, record_id string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _base32(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to, date: str = DATE) -> bytes:
    """A response, or with ``refers_to`` a revisit, as one gzip member."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"X-Payload-Length: {size}", f"WARC-Payload-Digest: {_base32(digest)}", f"WARC-Block-Digest: {_base32(hashlib.sha1(block).hexdigest())}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def _info(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, name)}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return _member(head.encode() + block + b"\r\n\r\n")


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _File:
    def __init__(self, root: str, name: str, shard: int, date: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.name, self.shard = name, shard
        self.tmp = f"{self.root}/_temporary-{uuid.uuid4().hex}"
        self.fs.create_dir(self.root, recursive=True)
        self.out = self.fs.open_output_stream(self.tmp)
        self.sha, self.bytes, self.ids = hashlib.sha1(), 0, []
        self.put(_info(name, date))

    def put(self, data: bytes):
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def add(self, page_id, data: bytes):
        self.put(data)
        self.ids = [*self.ids[:1], page_id] if self.ids else [page_id]

    def close(self, records: int) -> tuple:
        self.out.close()
        final = f"{self.root}/{self.name}"
        try:
            self.fs.move(self.tmp, final)
        except OSError:  # an earlier attempt has left the same bytes, on a store that doesn't replace
            self.fs.delete_file(final)
            self.fs.move(self.tmp, final)
        return self.name, self.shard, records, self.bytes, self.sha.hexdigest(), self.ids[0], self.ids[-1]

    def drop(self):
        self.out.close()
        self.fs.delete_file(self.tmp)


def _writer(root: str, roll: int, date: str):
    def run(batches):
        done, open_, n, part = [], None, 0, 0
        try:
            for batch in batches:
                for shard, page_id, url, html, size, digest, refers_to in zip(*(batch.column(c).to_pylist() if c != "url" else strings(batch.column(c)) for c in ("shard", "page_id", "url", "html", "size", "digest", "refers_to")), strict=True):
                    if open_ and (shard != open_.shard or open_.bytes >= roll):
                        part = part + 1 if shard == open_.shard else 0
                        done.append(open_.close(n))
                        open_ = None
                    if not open_:
                        open_, n = _File(root, f"shard-{shard:06d}-{part:04d}.warc.gz", shard, date), 0
                    open_.add(page_id, record(page_id, url, html or b"", size, digest, refers_to, date))
                    n += 1
            if open_:
                done.append(open_.close(n))
                open_ = None
        finally:
            if open_:
                open_.drop()
        if done:
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

    return run


def _places(batches):
    """The bytes before each record within its part of the order."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        weight = batch.column("weight").to_numpy()
        before = at + np.cumsum(weight) - weight
        at += int(weight.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), part), pa.int32()), batch.column("page_id"), batch.column("digest"), batch.column("weight"), pa.array(before)], names=["part", "page_id", "digest", "weight", "before"])


def _order(sound: np.ndarray, ids: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Bytes that sort like (page_id, digest); rows that aren't ``sound`` have no id and come first."""
    out = np.zeros(len(ids), np.dtype([("sound", "u1"), ("id", ">u8"), ("digest", "S16")]))
    out["sound"] = sound
    out["id"] = ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    out["digest"] = digest.astype("S16")
    return out.view("S25").ravel()


def _cuts(weighed: DataFrame, shard_bytes: int, parts: int) -> np.ndarray:
    """The first record's (page_id, digest) of each shard, in order."""
    spark = weighed.sparkSession
    order = [F.col("page_id").asc_nulls_first(), "digest"]
    laid = weighed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = written(laid.mapInArrow(lean(_places), "part int, page_id long, digest string, weight long, before long"), "warc-order")
    held = {r["part"]: r["n"] for r in laid.groupBy("part").agg(F.sum("weight").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(held):
        starts.append((p, total))
        total += held[p]
    if not starts:
        return _order(*(np.zeros(0, t) for t in ("?", "i8", "S16")))
    size = max(1, -(-total // MAX_SHARDS), min(shard_bytes, -(-total // parts)))
    at = laid.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part")  # as many rows as there are shuffle partitions
    key = F.struct(F.col("page_id").isNotNull().alias("sound"), "page_id", "digest")
    first = at.groupBy(F.floor((F.col("start") + F.col("before")) / F.lit(size)).alias("shard")).agg(F.min(key).alias("key"))
    cuts = first.select("shard", "key.sound", F.coalesce("key.page_id", F.lit(0)).alias("page_id"), F.left("key.digest", F.lit(16)).alias("digest")).toArrow().sort_by("shard")
    return _order(*(cuts.column(c).to_numpy() for c in ("sound", "page_id", "digest")))


def write_warc(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Writes an archive of ``pages`` (page_id long, url string, html string) under the URI ``root``; returns its manifest.

    ``root`` must not hold an archive.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.octet_length(html).cast("long").alias("size"), F.sha1(html).alias("digest"))
    keyed = written(rows.select("page_id", "size", "digest"), "warc-keys")
    first = keyed.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("digest", "size", "response")
    first = small(written(first, "warc-responses"))
    refers_to = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("response")), F.col("response"))
    weight = F.lit(HEAD_BYTES) + F.when(refers_to.isNull(), F.col("size")).otherwise(F.lit(0))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(keyed.join(first, ["digest", "size"], "left").select("page_id", "digest", weight.cast("long").alias("weight")), shard_bytes, parts)
    bounds = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def shard_of(sound: pd.Series, page_id: pd.Series, digest: pd.Series, salt: pd.Series) -> pd.Series:
        key = _order(sound.to_numpy(), page_id.to_numpy(), digest.to_numpy())
        low, high = (np.searchsorted(bounds.value, key, side) for side in ("left", "right"))
        return pd.Series(np.where(high - low > 1, low + salt.to_numpy() % np.maximum(1, high - low), np.maximum(high, 1) - 1))

    shard = shard_of(F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0)), F.left("digest", F.lit(16)), "salt")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("url", F.monotonically_increasing_id()), F.lit(1 << 30)))
    joined = salted.join(first, ["digest", "size"], "left")
    joined = joined.select("page_id", "url", F.when(refers_to.isNull(), F.col("html").cast("binary")).alias("html"), "size", "digest", refers_to.alias("refers_to"), shard.alias("shard"))
    dealt = joined.repartitionById(max(1, len(cuts)), "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "url")
    dealt.mapInArrow(lean(_writer(f"{root}/data", roll_bytes, date)), MANIFEST).write.json(f"{root}/manifest")
    return spark.read.schema(MANIFEST).json(f"{root}/manifest")


def members(data: bytes, step: int = 1 << 16):
    """The decompressed gzip members of ``data``, one by one."""
    view, at, z, out, rest = memoryview(data), 0, zlib.decompressobj(31), [], b""
    while rest or at < len(view):
        if not rest:
            rest, at = bytes(view[at : at + step]), at + step
        out.append(z.decompress(rest))
        rest = b""
        if z.eof:
            yield b"".join(out)
            rest, z, out = z.unused_data, zlib.decompressobj(31), []
    if out:
        raise ValueError("an archive ends within a record")


def parse(data: bytes):
    """Rows of ARCHIVE from one file; digests and lengths are checked."""
    for raw in members(data):
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        h = dict(x.split(": ", 1) for x in lines[1:])
        if h["WARC-Type"] not in ("response", "revisit"):
            continue
        block = rest[: int(h["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or _base32(hashlib.sha1(block).hexdigest()) != h["WARC-Block-Digest"]:
            raise ValueError(f"record {h['WARC-Record-ID']} is damaged")
        digest = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()
        payload = None
        if h["WARC-Type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(h["X-Payload-Length"]):
                raise ValueError(f"record {h['WARC-Record-ID']} has another payload than its digest")
        number = lambda k: int(h[k]) if k in h else None
        yield number("X-Page-Id"), h.get("WARC-Target-URI"), h["WARC-Type"], h["WARC-Record-ID"], payload, number("X-Payload-Length"), digest, number("X-Refers-To-Page")


def _reader(batches):
    names = [c.split()[0] for c in ARCHIVE.split(", ")]
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    for batch in batches:
        for content, sha1 in zip(batch.column("content"), batch.column("sha1").to_pylist(), strict=True):
            data = content.as_py()
            if hashlib.sha1(data).hexdigest() != sha1:
                raise ValueError("a file differs from the manifest")
            held, size = [], 0
            for row in parse(data):
                held.append(row)
                size += HEAD_BYTES + len(row[4] or b"")
                if size >= READ_BYTES:
                    yield table(held)
                    held, size = [], 0
            if held:
                yield table(held)


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """The records that the manifest of ``root`` names, with the columns of ARCHIVE; payload is null for revisits."""
    manifest = spark.read.schema(MANIFEST).json(f"{root}/manifest")
    if manifest.limit(1).count() == 0:
        return spark.createDataFrame([], ARCHIVE)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{root}/data").withColumn("file", F.element_at(F.split("path", "/"), -1))
    return files.join(small(manifest.select("file", "sha1")), "file").select("content", "sha1").mapInArrow(lean(_reader), ARCHIVE)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return read_warc(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
