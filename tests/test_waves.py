"""Committed waves, versions and locks: limits, retries, second writers, failed writes."""

import json
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritally.operators import provenance
from veritally.operators.waves import Limits, Refused, Waves
from veritally.versions import VersionedTable, Versions

SCHEMA = "id string, error string, error_kind string, retriable boolean, status_code int, config_hash string, reset_at double, usd double"


def answering(fail=(), denied=(), quota=(), usd=0.5, config="c"):
    def answer(batches):
        for batch in batches:
            ids, pos = batch.column("id").to_pylist(), batch.column("pos").to_pylist()
            kind = ["quota_exhausted" if int(i) in quota else "http" if int(i) in denied else "boom" if int(i) in fail else None for i in ids]
            rows = {
                "pos": pa.array(pos, pa.int64()), "id": pa.array(ids), "error": pa.array([k and f"{k} {i}" for k, i in zip(kind, ids, strict=True)], pa.string()), "error_kind": pa.array(kind, pa.string()),
                "retriable": pa.array([None if k is None else k != "http" for k in kind], pa.bool_()), "status_code": pa.array([401 if k == "http" else 200 for k in kind], pa.int32()),
                "config_hash": pa.array([config] * len(ids)), "reset_at": pa.array([99.0 if k == "quota_exhausted" else None for k in kind], pa.float64()), "usd": pa.array([usd] * len(ids)),
            }
            yield pa.RecordBatch.from_pydict(rows)

    return answer


@pytest.fixture
def items(spark):
    return spark.range(100).select(F.col("id").cast("string").alias("id"))



@pytest.fixture(autouse=True)
def order(spark):
    global ORDER
    ORDER = [F.length("id"), F.col("id")]


def ids(waves):
    return sorted((r.id for r in waves.rows().collect()), key=int)


def test_a_run_to_its_end(spark, items, tmp_path):
    w = Waves(spark, str(tmp_path), SCHEMA)
    s = w.run(items, answering(fail={3, 50}), ORDER, Limits(wave=30), cost=F.col("usd"), config_hash="c")
    assert (s.status, s.wave, s.attempted, s.completed, s.errors, s.remaining, s.spent_usd) == ("complete", 4, 100, 98, 2, 0, 49.0)
    assert ids(w) == list(map(str, range(100))) and [r.id for r in w.rows().orderBy("pos").collect()] == list(map(str, range(100)))
    with pytest.raises(Refused, match="holds a run"):
        w.run(items, answering(), ORDER)
    with pytest.raises(Refused, match="configuration c"):
        w.run(items, answering(), ORDER, config_hash="other", resume=True)
    again = w.run(items, answering(), ORDER, Limits(wave=30), config_hash="c", resume=True)
    assert (again.attempted, again.wave) == (2, 5) and w.rows().count() == 102


def test_limits_stop_after_the_wave_that_meets_them(spark, items, tmp_path):
    run = lambda name, answer, **limits: Waves(spark, str(tmp_path / name), SCHEMA).run(items, answer, ORDER, Limits(wave=20, **limits), cost=F.col("usd"))
    s = run("streak", answering(fail=range(36, 44)), fail_streak=8)
    assert (s.status, s.wave, s.streak) == ("too_many_errors", 3, 0) and "last: boom 43" in s.message
    assert run("short", answering(fail=range(37, 44)), fail_streak=8).status == "complete"
    s = run("auth", answering(denied={25}))
    assert (s.status, s.attempted, s.remaining) == ("auth_error", 40, 60)
    s = run("quota", answering(quota={45, 47}))
    w = Waves(spark, str(tmp_path / "quota"), SCHEMA)
    assert (s.status, s.reset_at, s.attempted, s.remaining) == ("quota_exhausted", 99.0, 58, 42) and "45" not in ids(w)
    s = w.run(items, answering(), ORDER, Limits(wave=20), resume=True)
    assert s.status == "complete" and ids(w) == list(map(str, range(100)))
    assert run("budget", answering(), max_usd=30.0).wave == 1 and run("total", answering(usd=0.0), max_usd=1.0).status == "complete"
    with pytest.raises(Refused, match="exceeds"):
        Waves(spark, str(tmp_path / "e"), SCHEMA).run(items, answering(), ORDER, Limits(max_usd=3.0), cost=F.col("usd"), estimate=F.lit(1.0))
    with pytest.raises(Refused, match="needs a cost"):
        Waves(spark, str(tmp_path / "e"), SCHEMA).run(items, answering(), ORDER, Limits(max_usd=3.0))


def test_a_wave_that_comes_again_and_a_second_writer(spark, items, tmp_path):
    w = Waves(spark, str(tmp_path), SCHEMA)
    first = w.start(100, resume=False)
    part = items.where("id < 10").withColumn("pos", F.col("id").cast("long"))
    one = w.commit(part, answering(), 1, first, Limits())
    assert w.commit(part, answering(), 1, one, Limits()) == one and w.rows().count() == 10
    second = w.start(90, resume=True)  # another run goes on from here
    with pytest.raises(Refused, match="another writer"):
        w.commit(part, answering(), 2, one, Limits())
    assert w.commit(part, answering(), 2, second, Limits()).wave == 2 and w.rows().count() == 20


def test_a_wave_that_fails_is_not_there(spark, items, tmp_path):
    w = Waves(spark, str(tmp_path), SCHEMA)

    def broken(batches):
        for batch in batches:
            if "55" in batch.column("id").to_pylist():
                raise ValueError("lost")
            yield from answering()([batch])

    with pytest.raises(Exception, match="lost"):
        w.run(items, broken, ORDER, Limits(wave=20))
    assert w.state().wave == 2 and w.rows().count() == 40
    assert w.run(items, answering(), ORDER, Limits(wave=20), resume=True).status == "complete" and ids(w) == list(map(str, range(100)))


def test_a_stream_of_items(spark, items, tmp_path):
    items.repartition(5).write.parquet(str(tmp_path / "items"))
    stream = spark.readStream.schema("id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "items"))
    w = Waves(spark, str(tmp_path / "run"), SCHEMA)
    s = w.follow(stream, answering(), ORDER, str(tmp_path / "checkpoint"), Limits(max_usd=25.0), cost=F.col("usd"))
    assert s.status == "budget" and 0 < s.wave < 5 and w.rows().count() == s.attempted
    s = w.follow(stream, answering(), ORDER, str(tmp_path / "checkpoint"))
    assert s.status == "complete" and s.wave == 5 and ids(w) == list(map(str, range(100)))


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.latest() == 0 and v.put(1, "ä") and not v.put(1, "b") and v.read(1) == "ä" and v.numbers() == [1]
    done = []
    threads = [threading.Thread(target=lambda i=i: done.append(v.append(lambda last: f"{i} after {last}"))) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(done) == list(range(2, 10)) and all(v.read(n).endswith(f"after {n - 1}") for n in done)
    assert not [p for p in (tmp_path / "v").iterdir() if "tmp" in p.name and not p.name.endswith(".crc")]


def test_a_table_that_changes_as_a_whole(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path))
    rows = lambda: sorted((r.k, r.v) for r in t.read().collect())
    make = lambda *r: spark.createDataFrame(r, "k string, v int")
    assert t.read() is None
    t.merge(make(("a", 1), ("b", 1)), "k")
    old = t.read()
    assert t.merge(make(("b", 2), ("c", 2)), "k") == 2
    assert rows() == [("a", 1), ("b", 2), ("c", 2)] and old.count() == 2 and t.read(1).count() == 2
    with pytest.raises(Exception, match="lost"):
        t.merge(make(("a", 9)).withColumn("v", F.raise_error(F.lit("lost")).cast("int")), "k")
    assert rows() == [("a", 1), ("b", 2), ("c", 2)]

    def interrupted(before):
        if t.versions.latest() == 2:  # another writer, meanwhile
            VersionedTable(spark, str(tmp_path)).merge(make(("d", 4)), "k")
        return before.unionByName(make(("e", 5)))

    assert t.change(interrupted) == 4 and rows() == [("a", 1), ("b", 2), ("c", 2), ("d", 4), ("e", 5)]


def test_locks(spark, tmp_path):
    from veritally.sources.files import LOCK

    def lock(system, config, reason="why"):
        return spark.createDataFrame([(1, system, "S", "h", config, {"model": "m"}, reason, None, None, False)], LOCK)

    path = str(tmp_path / "locks")
    systems = spark.createDataFrame([("a", "p1", {"repo": "x"}), ("b", "p2", {"repo": "", "rev": None}), ("c", None, None)], "system string, price_id string, checkpoint map<string,string>")
    blockers = provenance.lock_blockers(systems, spark.createDataFrame([("p1",)], "price_id string"))
    assert sorted(map(tuple, blockers.collect())) == [("b", "checkpoint.repo is not set"), ("b", "checkpoint.rev is not set"), ("b", "no price for p2")]
    assert provenance.write_locks(lock("a", "c1"), blockers, path) == 1 and provenance.write_locks(lock("c", "c1"), blockers, path) == 2
    for bad, why in ((lock("a", "c1"), "already locked: a on S"), (lock("b", "c1"), "no price for p2"), (lock("a", "c2", " "), "reason"), (lock("a", "c2").union(lock("a", "c2")), "twice"), (lock("a", "c2").limit(0), "between")):
        with pytest.raises(provenance.LockRefused, match=why):
            provenance.write_locks(bad, blockers, path)
    out = []

    def attempt():
        try:
            out.append(provenance.write_locks(lock("a", "c3"), blockers, path))
        except provenance.LockRefused:
            out.append(None)

    threads = [threading.Thread(target=attempt) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(out, key=str) == [3, None, None, None]
    assert [(r.number, r.system, r.config_hash) for r in provenance.read_lock_documents(spark, path).orderBy("number").collect()] == [(1, "a", "c1"), (2, "c", "c1"), (3, "a", "c3")]
    assert json.loads(Versions(spark, path).read(3))["reason"] == "why"
