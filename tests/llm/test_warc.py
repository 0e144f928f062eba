import gzip
import hashlib
import random

import pytest

from veritally.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, size int, shard int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2) for r in rows], SCHEMA)


def data():
    rng = random.Random(1)
    hot = "<p>" + "x" * 2000
    out = []
    for i in range(120):
        html = hot if i % 3 == 0 else "".join(rng.choices("abcé <>\r\n", k=rng.choice([0, 10, 999, 1000, 5000])))
        out.append((i * 7, f"http://h.example/{i}", html))
    rng.shuffle(out)
    return out + [(10_000, None, None), (10_001, "http://a b\r\nX: y", "short"), (10_002, "u", "short"), (None, "u", hot)]


def expected(rows):
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    last = {}
    for i, b in raw:
        if len(b) >= 1000 and i is not None:
            last[b] = max(last.get(b, i), i)
    out = []
    for i, b in raw:
        response = last.get(b)
        revisit = response is not None and i != response
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", response if revisit else None))
    return sorted(out, key=lambda t: (t[0] is None, t[0]))


def test_round_trip(spark, tmp_path, rows):
    d = data()
    root = f"file://{tmp_path}/w"
    manifest = warc.write_warc(pages(spark, d), root, shard_bytes=20_000, roll_bytes=4000)
    got = warc.read_warc(spark, root)
    assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected(d)
    html = {(i, h or "") for i, _, h in d}
    assert all((r["page_id"], bytes(r["payload"]).decode()) in html for r in got.where("record_type = 'response'").collect())
    files = manifest.orderBy("file").collect()
    assert len(files) > 4 and len({f["shard"] for f in files}) > 1
    ranges = [(f["first_id"], f["last_id"]) for f in files if f["first_id"] is not None]
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    assert all(f["bytes"] < 12_000 for f in files)
    first = sorted((tmp_path / "w/data").glob("*.gz"))[0]
    assert gzip.decompress(first.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert not list((tmp_path / "w/data").glob("_temporary*"))


def test_same_bytes_whatever_the_order(spark, tmp_path):
    d = data()
    a, b = ({(r["file"], r["sha1"]) for r in warc.write_warc(pages(spark, x), f"file://{tmp_path}/{n}", 20_000).collect()} for n, x in (("a", d), ("b", d[::-1])))
    assert a == b


def test_repeated_rows_and_empty(spark, tmp_path, rows):
    h = "y" * 1500
    warc.write_warc(pages(spark, [(5, "u", h), (5, "u", h), (3, "v", h)]), f"file://{tmp_path}/r")
    assert [t[:2] for t in rows(warc.read_warc(spark, f"file://{tmp_path}/r"), "page_id", "record_type")] == [(3, "revisit"), (5, "response"), (5, "response")]
    warc.write_warc(pages(spark, []), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_damage_is_noticed(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    warc.write_warc(pages(spark, [(1, "u", "abc" * 100)]), root)
    (path,) = (tmp_path / "w/data").glob("*.gz")
    path.write_bytes(path.read_bytes()[:-3] + b"abc")
    for crc in (tmp_path / "w/data").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="differs from the manifest"):
        warc.read_warc(spark, root).collect()


def test_members():
    parts = [b"a" * 10, b"", bytes(range(256)) * 1000]
    blob = b"".join(map(warc._member, parts))
    assert list(warc.members(blob, step=7)) == parts
    with pytest.raises(ValueError, match="ends within"):
        list(warc.members(blob[:-20]))


def shards(spark, tmp_path, rows, name, **options):
    manifest = warc.write_warc(pages(spark, rows), f"file://{tmp_path}/{name}", **options)
    out = {}
    for r in manifest.orderBy("file").collect():
        out.setdefault(r["shard"], []).append((r["records"], r["first_id"], r["last_id"]))
    return [(sum(n for n, _, _ in x), x[0][1], x[-1][2]) for _, x in sorted(out.items())]


def test_shards_are_even_however_the_ids_are_spread(spark, tmp_path, rows):
    html = "<p>" + "x" * 300
    ids = {"outlier": [*range(200), 1 << 40], "ends": [-(1 << 63), *range(-100, 100), (1 << 63) - 1], "dense": list(range(202))}
    for name, mine in ids.items():
        got = shards(spark, tmp_path, [(i, "u", html + str(i)) for i in mine], name, shard_bytes=8000)
        assert len(got) >= 15 and sum(n for n, _, _ in got) == len(mine) and max(n for n, _, _ in got) <= 12
        assert all(a[2] < b[1] for a, b in zip(got, got[1:]))
        back = warc.read_warc(spark, f"file://{tmp_path}/{name}")
        assert [i for (i,) in rows(back, "page_id")] == sorted(mine)


def test_one_id_with_very_many_records_is_many_shards(spark, tmp_path, rows):
    """By digest where they differ, by url and place where they don't; null ids alike."""
    for name, data in {
        "digest": [(7, "u", f"{i:05d}" + "x" * 300) for i in range(200)] + [(9, "u", "z")],
        "equal": [(7, f"u{i}", "y" * 300) for i in range(200)] + [(9, "u", "z")],
        "null": [(None, "u", f"{i:05d}" + "x" * 300) for i in range(200)] + [(-5, "u", "z"), (9, None, None)],
    }.items():
        got = shards(spark, tmp_path, data, name, shard_bytes=8000)
        assert len(got) >= 15 and max(n for n, _, _ in got) <= 40, name
        assert rows(warc.read_warc(spark, f"file://{tmp_path}/{name}"), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(expected(data), key=lambda t: tuple((x is None, x) for x in t))


def test_reader_yields_by_bytes(spark, tmp_path, monkeypatch):
    data = [(i, "u", "z" * 100_000 + str(i)) for i in range(40)]
    warc.write_warc(pages(spark, data), f"file://{tmp_path}/w")
    monkeypatch.setattr(warc, "READ_BYTES", 1 << 18)
    import pyarrow as pa

    for path in (tmp_path / "w/data").glob("*.gz"):
        raw = path.read_bytes()
        batch = pa.RecordBatch.from_arrays([pa.array([raw]), pa.array([hashlib.sha1(raw).hexdigest()])], names=["content", "sha1"])
        assert all(len(b) <= 3 for b in warc._reader([batch]))


def test_invalid_utf8_is_written_as_it_is(spark, tmp_path):
    import hashlib

    from pyspark.sql import functions as F

    raw = b"\xff<p>x\xc3(" * 200
    df = spark.range(2).select(F.col("id").alias("page_id"), F.expr("cast(unhex('687474703A2F2F78FF') as string)").alias("url"), F.expr(f"cast(unhex('{raw.hex()}') as string)").alias("html"))
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type) for r in warc.op5_warc(spark, str(tmp_path)).collect()}
    sha = hashlib.sha1(raw).hexdigest()
    assert got == {0: (len(raw), sha, "revisit"), 1: (len(raw), sha, "response")}
