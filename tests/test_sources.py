"""The JSONL log as a data source, and the subset document."""

import json
import os

import pytest
from pyspark.sql import functions as F

from veritally.operators import subsets
from veritally.sources import files, jsonl


def test_appends_and_numbered_lines(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    assert jsonl.read_lines(spark, path).count() == 0
    lines = [f"line {i} é" + "x" * (i % 50) for i in range(500)]
    jsonl.append_lines(spark.createDataFrame([(x,) for x in lines], "v string").repartition(3), path)
    jsonl.append_lines(spark.createDataFrame([("more",), ("",)], "v string").coalesce(1), path)
    got = jsonl.read_lines(spark, path).collect()
    assert sorted(r.value for r in got) == sorted([*lines, "more", ""])
    for name in {r.file for r in got}:
        with open(tmp_path / "log/data" / name, encoding="utf-8") as f:
            assert {r.line: r.value for r in got if r.file == name} == {i: x.rstrip("\n") for i, x in enumerate(f, 1)}


def test_a_file_is_many_tasks(tmp_path, monkeypatch):
    import pyarrow as pa

    for part, read in ((40, 7), (1, 3), (10_000, 4096)):
        monkeypatch.setattr(jsonl, "PART_BYTES", part)
        monkeypatch.setattr(jsonl, "READ_BYTES", read)
        root = str(tmp_path / f"l{part}")
        values = [f"{i} é{'y' * (i % 13)}" for i in range(100)]
        w = jsonl.JsonLinesWriter(root, "c")
        w.commit([w.write(iter([pa.RecordBatch.from_pydict({"value": values[a : a + 30]}) for a in range(0, 100, 30)])), None])
        r = jsonl.JsonLinesReader(root)
        parts = r.partitions()
        assert (len(parts) > 20) == (part <= 40)
        rows = [(n, v) for p in parts for b in r.read(p) for n, v in zip(b["line"].to_pylist(), b["value"].to_pylist(), strict=True)]
        assert sorted(rows) == list(enumerate(values, 1))


def test_appends_are_all_or_nothing_and_once(spark, tmp_path):
    path = str(tmp_path / "log")
    two = spark.createDataFrame([("a",), ("b",)], "v string").repartition(2)
    for _ in range(2):
        jsonl.append_lines(two, path, commit="first")
    assert sorted(r.value for r in jsonl.read_lines(spark, path).collect()) == ["a", "b"] and len(os.listdir(tmp_path / "log/data")) <= 2
    bad = spark.range(40).repartition(4).select(F.when(F.col("id") == 31, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        jsonl.append_lines(bad, path)
    assert jsonl.read_lines(spark, path).count() == 2
    with pytest.raises(Exception, match="line ends"):
        jsonl.append_lines(spark.createDataFrame([("a\nb",)], "v string"), path)
    with pytest.raises(Exception, match="only appended"):
        two.toDF("value").write.format(jsonl.FORMAT).mode("overwrite").save(path)
    jsonl.append_lines(spark.createDataFrame([("{",)], "v string"), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="not JSON: line 1"):
        jsonl.read_rows(spark, str(tmp_path / "bad"), "a int").collect()


def test_prediction_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert files.read_log(spark, path).count() == 0
    rows = spark.createDataFrame([("1", 0.5), ("2", None)], "id string, latency_s double")
    for _ in range(2):
        files.append_log(rows, path, commit="wave-1")
    files.append_log(rows, path)
    assert sorted((r.id, r.latency_s) for r in files.read_log(spark, path).collect()) == [("1", 0.5), ("1", 0.5), ("2", None), ("2", None)]


def test_tree_hash(spark, monkeypatch):
    monkeypatch.setattr(subsets, "LEAF", 8)
    sets = {"one": ["a"], "some": [str(i) for i in range(8)], "many": [f"é{i}" for i in range(600)]}
    rows = [(k, i) for k, ids in sets.items() for i in ids]
    df = spark.createDataFrame(rows + rows[:50], "name string, id string")
    for parts in (1, 5):
        got = {r.name: (r.n, r.hash) for r in subsets.tree_hash(df.repartition(parts), ["name"]).collect()}
        assert got == {k: (len(v), subsets.sequential_hash(v)) for k, v in sets.items()}
    assert subsets.tree_hash(df.where("name = 'many'").select("id")).first().hash == subsets.sequential_hash(sets["many"])
    import hashlib

    assert subsets.sequential_hash(["b", "a"]) == hashlib.sha256(b"a\nb").hexdigest() and len({subsets.sequential_hash(sets["many"][:k]) for k in range(590, 600)}) == 10


def test_subset_document(spark, tmp_path):
    path = str(tmp_path)
    full = spark.createDataFrame([("test" if i % 3 else "dev", "ab"[i % 2], str(i)) for i in range(60)], "split string, stratum string, id string")
    large = full.where("split = 'test'").select(F.lit("L").alias("subset"), "stratum", "id")
    small = large.where("cast(id as int) < 20").withColumn("subset", F.lit("S"))
    plan = [{"name": "L", "split": "test", "floor": 5}, {"name": "S", "split": "test", "parent": "L", "floor": 2}]
    doc = subsets.document(large.union(small), full, plan, 7, 5)
    assert doc["full"]["dev"]["n"] == 20 and doc["subsets"]["S"]["ids"][:3] == ["1", "2", "4"] and sum(doc["subsets"]["L"]["per_stratum"].values()) == 40
    with pytest.raises(FileNotFoundError):
        subsets.read_subsets(spark, path)
    assert subsets.write_subsets(spark, path, doc) == subsets.write_subsets(spark, path, doc) == 1
    assert subsets.read_subsets(spark, path) == json.loads(json.dumps(doc)) and subsets.drift(spark, doc, full).count() == 0
    moved = full.where("id <> '4'").union(spark.createDataFrame([("extra", "a", "99")], full.schema))
    assert sorted(map(tuple, subsets.drift(spark, doc, moved).collect())) == [("split extra", "had no ids, has 1"), ("split test", "had 40 ids, has 39"), ("subset L", "1 ids aren't in the split"), ("subset S", "1 ids aren't in the split")]
    doc["subsets"]["L"]["ids"].remove("1")
    assert ("subset S", "isn't within L") in set(map(tuple, subsets.drift(spark, doc, full).collect()))
    subsets.write_subsets(spark, path, doc)
    with pytest.raises(ValueError, match="subset L"):
        subsets.read_subsets(spark, path)


def test_members_of_archives(spark, tmp_path, monkeypatch):
    """Ranges of a plain tar give each line once, wherever they are cut; a compressed one is streamed."""
    import io
    import tarfile

    from veritally.sources import archive

    text = "\n".join(["é" * (i % 17) + str(i) for i in range(300)])
    for end in ("", "\n", "\n\n"):
        data = (text + end).encode()
        for mode, name in (("w", "a.tar"), ("w:gz", "a.tar.gz")):
            with tarfile.open(tmp_path / name, mode) as tar:
                for member, content in (("x/other/aa.jsonl", b"no\n"), ("x" * 120 + "/data/aa.jsonl", data), ("x/data/bb.jsonl", b"")):
                    info = tarfile.TarInfo(member)
                    info.size = len(content)
                    tar.addfile(info, io.BytesIO(content))
        want, at = [], 0
        for line in data.split(b"\n")[: None if not end else -1]:
            want.append((at, line.decode()))
            at += len(line) + 1
        for size, read in ((1 << 20, 1 << 20), (37, 5), (1, 1000)):
            monkeypatch.setattr(archive, "RANGE_BYTES", size)
            monkeypatch.setattr(archive, "READ_BYTES", read)
            for name in ("a.tar", "a.tar.gz"):
                r = archive.TarReader(str(tmp_path / name), "/data/aa.jsonl")
                parts = r.partitions()
                assert len(parts) == (1 if name.endswith("gz") else -(-len(data) // size))
                assert [(p, v) for part in parts for b in r.read(part) for p, v in zip(b["at"].to_pylist(), b["value"].to_pylist(), strict=True)] == want
    assert [b for part in archive.TarReader(str(tmp_path / "a.tar"), "bb.jsonl").partitions() for b in archive.TarReader(str(tmp_path / "a.tar"), "bb.jsonl").read(part)] == []
    with pytest.raises(FileNotFoundError):
        archive.TarReader(str(tmp_path / "a.tar"), "cc.jsonl").partitions()
    assert archive.read_member(spark, str(tmp_path / "a.tar"), "/data/aa.jsonl").count() == len(want)
