"""Operators on small tables with known answers."""

import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.operators import audit, chat, errors, load, probes, provenance, quality_gate, resample, retrieval, runlog, sampling
from veritally.sources import files

LOG = "key long, pos long, at_us long, latency_s double, model string, failed boolean, retriable boolean, concurrency int, tokens long"


def log(spark, rows):
    return spark.createDataFrame([(1, i, i * 1_000_000, float(i), m, f, r, 1, 10) for i, (m, f, r) in enumerate(rows)], LOG)


def test_segments_are_not_broken_by_missing_names(spark):
    d = log(spark, [(m, False, False) for m in ("a", "a", None, "a", "b", "a")])
    got = [tuple(r) for r in runlog.segments(d).orderBy("segment").select("model", "rows", "first_row", "last_row").collect()]
    assert got == [("a", 3, 1, 4), ("b", 1, 5, 5), ("a", 1, 6, 6)]
    assert runlog.models_returned(d).first()["returned"] == "a,b"


def test_windows_leave_out_their_lower_end(spark):
    d = spark.createDataFrame([(1, i, t * 1_000_000, 0.0, None, False, False, 1, 10) for i, t in enumerate((0, 30, 60, 61))], LOG)
    assert [r["requests"] for r in runlog.budgets(d, runlog.MINUTE_US).orderBy("pos").collect()] == [1, 2, 2, 3]


def test_log_operators(spark):
    d = log(spark, [("a", True, True), ("a", True, False), ("a", True, True), ("b", False, False)])
    assert runlog.streaks(d, 2).first()["longest"] == 3 and runlog.streaks(d, 2).first()["stopped_at"] == 1
    assert runlog.latest(d, ["key"]).first()["model"] == "b"
    items = spark.createDataFrame([(1,), (2,)], "key long")
    assert [r[0] for r in runlog.pending(items, d, "key").collect()] == [2]
    s = runlog.spend(d, F.lit(1.0), 2.5, 100).orderBy("pos").collect()
    assert [r["stop"] for r in s] == [False, False, True, True]
    assert runlog.frequency_map(d, ["key"], "model").first()["model"] == {"a": 3, "b": 1}
    assert runlog.output_average(d, 512).first()["reserve"] == 16
    assert load.probe_summary(d, ["key"]).first()["median_s"] == 3.0
    empty = d.limit(0)
    assert all(x.count() == 0 for x in (runlog.segments(empty), runlog.latest(empty, ["key"]), runlog.streaks(empty), runlog.output_average(empty, 1)))


def test_levels_without_answers(spark):
    d = log(spark, [("a", True, True)] * 3)
    r = load.levels(d, 10.0).first()
    assert (r["ok"], r["errors"], r["p95"], r["mean_s"], r["meets_limit"]) == (0, 3, None, None, False)
    assert load.operating_point(load.levels(d, 10.0)).first()["concurrency"] is None


def test_audit(spark):
    rows = [("1", "train", "a", "wake me", "x"), ("2", "train", "a", "Wake  me", "x"), ("3", "train", "b", "hi", "x"), ("4", "train", "c", "hi", "x"), ("5", "train", "d", "yo", "x"), ("6", "train", "d", "yo", "y"), ("30", "test", "a", "wake me", "x"), ("32", "test", "z", "hi", "x"), ("33", "test", "q", "new", "x")]
    d = spark.createDataFrame(rows, "id string, split string, intent string, text string, label string")
    from veritally.functions.text import normalize_value

    norm, label = normalize_value(F.col("text")), F.concat_ws("|", "intent", "label")
    assert sorted(r["kind"] for r in audit.duplicate_groups(d.where("split = 'train'"), norm, label).collect()) == ["identical", "intent conflict", "slot conflict"]
    o = audit.overlap(d, norm, label, "train", "test").first()
    assert (o["shared_texts"], o["rows_a"], o["rows_b"], o["identical_labels"]) == (2, 4, 2, 1)
    assert sorted(r["id"] for r in audit.shared_rows(d, norm, "train", "test").collect()) == ["30", "32"]
    assert [r["id"] for r in audit.unseen_rows(d, norm, "train", "test").collect()] == ["33"]
    c = {r["split"]: (r["n_labels"], r["n_missing"], r["n_not_in_train"]) for r in audit.coverage(d, "intent").collect()}
    assert c == {"train": (4, 2, 0), "dev": (0, 6, 0), "test": (3, 3, 2)}
    with pytest.raises(Exception, match="train split only"):
        audit.inventory(d, "intent").collect()
    assert audit.inventory(d.where("split = 'train'"), "intent").first()["labels"] == ["a", "b", "c", "d"]
    assert [r["id"] for r in audit.sorted_ids(d).collect()][-3:] == ["30", "32", "33"]


def strata(spark, sizes):
    return spark.createDataFrame(list(sizes.items()), "stratum string, n long")


def picked(spark, sizes, total, floor):
    return {r["stratum"]: r["picks"] for r in sampling.allocate(strata(spark, sizes), total, F.lit(floor)).collect()}


def planned(spark, sizes, plan):
    out = {name: {} for name, _ in plan}
    for r in sampling.nested_plan(strata(spark, sizes), plan).collect():
        out[r["subset"]][r["stratum"]] = r["picks"]
    return out


def test_allocation(spark):
    sizes = {"a": 100, "b": 50, "c": 2, "d": 1}
    picks = picked(spark, sizes, 20, 2)
    assert sum(picks.values()) == 20 and picks["c"] == 2 and picks["d"] == 1 and picks["a"] > picks["b"]
    assert picked(spark, sizes, 153, 5) == sizes
    for bad in (154, 1):
        with pytest.raises(ValueError, match="can't be picked"):
            picked(spark, sizes, bad, 2)
    plan = planned(spark, {f"s{i:02d}": 40 for i in range(18)}, [("L", 100), ("S", 50)])
    assert all(plan["S"][s] <= plan["L"][s] and plan["S"][s] >= 2 for s in plan["L"]) and min(plan["L"].values()) >= 5


def test_allocation_is_the_best_of_all(spark):
    """Among all picks within the bounds that make up the total, it has the least sum of squared distances from the shares."""
    from itertools import product

    for sizes, total, floor in (({"a": 7, "b": 5, "c": 1}, 6, 1), ({"a": 9, "b": 2, "c": 2, "d": 1}, 7, 2), ({"a": 3, "b": 3, "c": 3}, 4, 0), ({"a": 10, "b": 1}, 5, 1)):
        share = {s: total * n / sum(sizes.values()) for s, n in sizes.items()}
        cost = lambda p: sum((x - share[s]) ** 2 for s, x in zip(sizes, p, strict=True))  # noqa: E731, B023
        legal = [p for p in product(*(range(min(floor, n), n + 1) for n in sizes.values())) if sum(p) == total]
        got = picked(spark, sizes, total, floor)
        assert cost(tuple(got[s] for s in sizes)) == pytest.approx(min(map(cost, legal)))


def test_nested_subsets_are_prefixes(spark):
    d = spark.range(200).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("s"))
    plan = sampling.nested_plan(strata(spark, {f"s{i}": n for i, n in enumerate((67, 67, 66))}), [("L", 60), ("S", 20)])
    got = {n: {r["id"] for r in sampling.nested_subsets(d, "s", "id", plan).where(F.col("subset") == n).collect()} for n in ("L", "S")}
    assert len(got["L"]) == 60 and len(got["S"]) == 20 and got["S"] < got["L"]
    again = {r["id"] for r in sampling.nested_subsets(d.orderBy(F.rand()), "s", "id", plan).where("subset = 'S'").collect()}
    assert again == got["S"]


def test_bootstrap_design_b_is_numpys(spark):
    x = np.random.default_rng(1).integers(0, 2, 60)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x)], "i long, v int")
    rng, parts = np.random.default_rng(resample.SEED), []
    for start in range(0, 600, 250):
        parts.append(x[rng.integers(0, 60, size=(min(250, 600 - start), 60))].mean(axis=1))
    low, high = np.quantile(np.concatenate(parts), [0.025, 0.975])
    got = resample.numpy_interval(df, [F.col("i")], "v", 600).first()
    assert (got["value"], got["low"], got["high"]) == pytest.approx((x.mean(), low, high))
    with pytest.raises(ValueError, match="no rows"):
        resample.interval(df.limit(0), [F.col("i")], "mean", ["v"], 10)
    same = resample.paired(df.withColumn("w", F.col("v")), [F.col("i")], "v", "w", 50).first()
    assert (same["difference"], same["low"], same["high"], same["mcnemar_p"], same["bootstrap_p"]) == (0, 0, 0, 1, 1)


def test_topk_ties_and_zero_vectors(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, v array<double>")
    queries = spark.createDataFrame([(9, [3.0, 0.0]), (8, [0.0, 0.0])], "q long, v array<double>")
    got = {(r["q"], r["rank"]): r["id"] for r in retrieval.topk(queries, index, 2).collect()}
    assert got == {(9, 1): 1, (9, 2): 2, (8, 1): 1, (8, 2): 2}
    with pytest.raises(Exception, match="train split only"):
        retrieval.guarded_index(index, F.lit("test")).collect()
    with pytest.raises(ValueError, match="each id once"):
        retrieval.guarded_index(index.union(index.limit(1)), F.lit("train"))


def explained(spark, rows):
    slots = "array<struct<type:string,value:string>>"
    df = spark.createDataFrame(rows, f"i int, pred {slots}, gold {slots}")
    return [r["d"] for r in df.select("i", errors.explain(F.col("pred"), F.col("gold")).alias("d")).orderBy("i").collect()]


def test_differences(spark):
    pred = [("time", "five"), ("place", "rome"), ("x", "y")]
    gold = [("time", "five am"), ("city", "rome"), ("m", "n")]
    assert explained(spark, [(1, pred, gold), (2, gold, gold), (3, None, None), (4, [], gold), (5, [("a", "1"), ("a", "1"), ("b", "2")], [("a", "1"), ("c", "2"), ("d", "2")])]) == [
        ["time 'five' (gold 'five am')", "'rome' as place (gold city)", "missing m=n", "extra x=y"],
        [],
        [],
        ["missing city=rome", "missing m=n", "missing time=five am"],
        ["'2' as b (gold c)", "missing d=2", "extra a=1"],
    ]


def test_malformed_chat_records(spark):
    """Each defect on its own and together; (severity, rule, at)."""
    records = {
        '{"messages":[]}': [("error", "messages missing", -1)],
        "{broken": [("error", "invalid JSON", -1)],
        '["x"]': [("error", "record is not an object", -1)],
        '{"messages":[{"role":"tool","content":"x"},{"role":"user","content":" "},{"role":"assistant","content":null,"tool_calls":[]},7]}': [("unsupported", "tool role", 0), ("error", "empty content", 1), ("unsupported", "tool call", 2), ("error", "message is not an object", 3)],
        '{"messages":[{"role":"user","content":[{"text":"a"}]},{"role":"system","content":"s"},{"role":"assistant","content":"a","weight":1}]}': [("unsupported", "content parts", 0), ("error", "system is not first", -1), ("unsupported", "weight", 2)],
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"tools":[],"note":1}': [("unsupported", "tools", -1), ("warning", "extra keys", -1)],
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}': [],
        '{"messages":[{"role":"assistant","content":"a"}]}': [("error", "no user message", -1)],
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"},{"role":"user","content":"q"}]}': [("error", "last is not the assistant", -1), ("unsupported", "several turns", -1)],
        '{"messages":[{"role":"judge","content":"q"},{"role":"user","content":3},{"role":"assistant","content":"a"}]}': [("error", "invalid role", 0), ("error", "content is not text", 1)],
    }
    df = spark.createDataFrame([(t,) for t in records], "t string")
    for r in df.select("t", chat.issues(F.try_parse_json("t")).alias("i")).collect():
        assert sorted((x["severity"], x["rule"], x["at"]) for x in r["i"]) == sorted(records[r["t"]]), r["t"]


def test_gate(spark):
    texts = [None, "  ", "aaaaaaaa", "abababab", "fine text", "��ab", "word " * 200]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(quality_gate.plain_degenerate(F.col("t"))).collect()] == [True, True, True, True, False, True, False]
    assert [r[0] for r in df.select(quality_gate.degenerate(F.col("t"))).collect()][-1] is True


def test_chat(spark):
    good = '{"messages":[{"role":"system","content":"s"},{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}'
    df = spark.createDataFrame([(good,), ('{"messages":[{"role":"user","content":"q"}]}',), ("nope",)], "t string").select("t", chat.issues(F.try_parse_json("t")).alias("issues"))
    got = {r["t"]: [(i["severity"], i["rule"]) for i in r["issues"]] for r in df.collect()}
    assert got[good] == [] and got["nope"] == [("error", "invalid JSON")] and ("error", "last is not the assistant") in got['{"messages":[{"role":"user","content":"q"}]}']
    assert chat.report(df.limit(0)).first().asDict() == {"records": 0, "errors": 1, "unsupported": 0, "warnings": 0, "ok": False}
    p = spark.range(1).select(chat.prompt(F.lit("s"), F.array(F.struct(F.lit("near").alias("text"), F.lit("1").alias("answer")), F.struct(F.lit("far").alias("text"), F.lit("2").alias("answer"))), F.lit("q")).alias("m")).first()["m"]
    assert [x["content"] for x in p] == ["s", "far", "2", "near", "1", "q"]


def test_provenance(spark):
    a, b = provenance.fingerprint({"x": {"b": 1, "a": 2}}), provenance.fingerprint({"x": {"a": 2, "b": 1}})
    assert a == b and a != provenance.fingerprint({"x": {"a": 3, "b": 1}})
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "o"), (2, "o")], [(2, None), (3, "n")]))
    assert sorted(map(tuple, provenance.merge_new_wins(old, new, "k").collect())) == [(1, "o"), (2, None), (3, "n")]
    models = spark.range(1).select(F.explode(probes.catalogue(F.lit('{"models":[{"id":"a"}]}'))).alias("m")).select("m.id")
    assert [r["id"] for r in models.collect()] == ["a"]


def test_sources(spark, tmp_path):
    rows = [{"id": "1", "locale": "en-US", "partition": "train", "scenario": "s", "intent": "i", "utt": "at five", "annot_utt": "at [time : five]", "worker_id": "0"}]
    member = tmp_path / "en-US.jsonl"
    member.write_text(json.dumps(rows[0]) + "\n\n")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        tar.add(member, "1.0/data/en-US.jsonl")
        tar.add(member, "1.0/data/xen-US.jsonl")
    raw = files.archive_locale(spark, str(tmp_path / "a.tar.gz"), "en-US")
    ex = files.to_examples(raw)
    assert ex.count() == 1 and ex.first()["slots"][0]["value"] == "five"
    with pytest.raises(Exception, match="no member"):
        files.archive_locale(spark, str(tmp_path / "a.tar.gz"), "de-DE").count()
    files.write_examples(ex, str(tmp_path / "ex"))
    assert files.tables_equal(files.read_examples(spark, str(tmp_path / "ex")), ex) and not files.tables_equal(ex, ex.union(ex))
    log_path = str(tmp_path / "log")
    assert files.read_log(spark, log_path).count() == 0
    files.append_log(spark.createDataFrame([("1", "h")], "id string, config_hash string"), log_path)
    files.append_log(spark.createDataFrame([("2", "h")], "id string, config_hash string"), log_path)
    assert files.read_log(spark, log_path).count() == 2
    (tmp_path / "p.jsonl").write_text('{"text":"a"}\n\n{"messages":[{"role":"user","content":"b"}]}\n')
    assert [r["messages"][0]["content"] for r in files.read_prompts(spark, str(tmp_path / "p.jsonl")).orderBy("line").collect()] == ["a", "b"]
    (tmp_path / "q.jsonl").write_text('{"no":1}\n')
    with pytest.raises(Exception, match="in line 1"):
        files.read_prompts(spark, str(tmp_path / "q.jsonl")).collect()
    doc = json.dumps({"levels": [{"concurrency": 1, "req_per_s": "2.5", "latency_s": {"p50": 1.0, "p95": True}}]})
    (level,) = spark.range(1).select(files.levels_of(F.lit(doc)).alias("l")).first()["l"]
    assert tuple(level) == (1, 2.5, 1.0, None)
    assert files.choose_by_token(["t4.json", "a-T4-x.json", "st4r.json"], "T4") == (["t4.json", "a-T4-x.json"], ["st4r.json"])
    files.write_document({"a": float("nan"), "b": [float("inf"), 1]}, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"a": None, "b": [None, 1]}
    table = files.markdown_table(spark.createDataFrame([(1, "a|b")], "x int, y string"))
    assert table.splitlines()[-1] == "| 1 | a\\|b |" and files.splice("x\n<!-- begin t -->old<!-- end t -->y", "t", "new").endswith("new\n<!-- end t -->y")
    files.write_csv_once(spark.createDataFrame([(1,)], "x int"), str(tmp_path / "c"))
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_csv_once(spark.createDataFrame([(1,)], "x int"), str(tmp_path / "c"))
    import hashlib

    files.verify_sha256(str(member), hashlib.sha256(member.read_bytes()).hexdigest())
    with pytest.raises(ValueError, match="SHA-256"):
        files.verify_sha256(str(member), "0")


def test_stream_limits_like_a_plain_loop(spark, tmp_path):
    from veritally.streaming import runlog as s

    rows = [(k, i, float(t)) for k in (1, 2) for i, t in enumerate((0, 1, 2, 10, 11, 12, 30))]
    df = spark.createDataFrame(rows, "key long, pos long, at_s double")
    df.write.parquet(f"{tmp_path}/in")
    out = s.run_available(s.rate_limited(s.log_stream(spark, f"{tmp_path}/in", df.schema), 2, 10.0), "x", f"{tmp_path}/w", "append")
    got = {r["pos"]: r["allowed"] for r in out.where("key = 1").collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 6: True}


def test_run_pending_goes_on_where_it_stopped(spark, tmp_path):
    import pyarrow as pa

    schema = "key long, pos long, failed boolean, retriable boolean"

    def answer(batches):
        for b in batches:
            keys = b.column("key").to_pylist()
            yield pa.RecordBatch.from_pydict({"key": keys, "pos": keys, "failed": [k == 2 for k in keys], "retriable": [True] * len(keys)})

    items = spark.createDataFrame([(1,), (2,), (3,)], "key long")
    path = str(tmp_path / "log")
    first = runlog.run_pending(items, spark.createDataFrame([], schema), "key", answer, schema, path)
    assert sorted(r["key"] for r in first.collect()) == [1, 2, 3]
    from veritally.sources import jsonl

    log = jsonl.read_rows(spark, path, schema).drop("file", "line")
    for _ in range(2):
        again = runlog.run_pending(items, log, "key", answer, schema, path, commit="second")
        assert [r["key"] for r in again.collect()] == [2] and jsonl.read_lines(spark, path).count() == 4


def test_checks(spark):
    ids = spark.createDataFrame([("2",), ("10",)], "id string")
    good = ids.agg(sampling.id_set_hash(F.col("id")).alias("h")).first()["h"]
    assert provenance.checked_subset(ids, ids, good).count() == 2
    with pytest.raises(ValueError, match="hash"):
        provenance.checked_subset(ids, ids, "x")
    with pytest.raises(ValueError, match="1 ids"):
        provenance.checked_subset(ids, ids.limit(1), good)
    spec = {"name": "a", "endpoint": "e", "model": "m", "prompt": "p", "subset": "S", "max_output_tokens": 10}
    assert provenance.check_system(spec, {"p"}, {"S"}, 10) is spec
    with pytest.raises(ValueError, match="prompt x is unknown; max_output"):
        provenance.check_system(spec | {"prompt": "x", "max_output_tokens": 11}, {"p"}, {"S"}, 10)
    body = spark.range(1).select(provenance.request_body("m", F.array(chat.message("user", F.lit("q"))), {"top_p": "1", "seed": "2"}, ("seed",)).alias("b")).first()["b"]
    assert json.loads(body) == {"model": "m", "messages": [{"role": "user", "content": "q"}], "top_p": "1"}


def test_resamples_in_one_pass(spark):
    """The vectors of all tasks together are the weighted sums of the multiplicities, which have mean and variance 1 and don't depend on the partitioning; the interval is that of theory."""
    import hashlib

    n, resamples = 600, 400
    rows = [(f"g{i % 2}", i, float(i % 7), i % 3) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, x double, y int")
    number = lambda *p: int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[:8], 16)
    p = resample.PRIME
    want = {}
    for r in range(resamples):
        a, c = 1 + number(5, "a", r) % (p - 1), number(5, "c", r) % p
        for g, i, x, y in rows:
            m = sum((number(5, i) % p * a + c) % p >= bound for bound in resample.BOUNDS)
            w = want.setdefault((g, r), [0, 0, 0])
            want[g, r] = [w[0] + m, w[1] + m * x, w[2] + m * y]
    for parts in (1, 7):
        got = resample.resampled(df.repartition(parts), [F.col("i")], ["x", "y"], resamples, 5, ["g"]).collect()
        assert {(r.g, r._b): [r._w, r.x, r.y] for r in got} == want
    sizes = np.array([w[0] for w in want.values()])
    assert abs(sizes.mean() - 300) < 3 and abs(sizes.var() / 300 - 1) < 0.2
    ci = resample.interval(df, [F.col("i")], "mean", ["x"], 2000).first()
    half = 1.96 * np.std([r[2] for r in rows]) / n**0.5
    assert (ci.high - ci.low) / 2 == pytest.approx(half, rel=0.08) and ci.value == pytest.approx((ci.low + ci.high) / 2, abs=half / 4)
    one = resample.interval(df.where("i = 1").withColumn("z", F.col("y")).withColumn("w", F.col("y")), [F.col("i")], "f1", ["y", "z", "w"], 50).first()
    assert one.n == 1 and one.low is not None


def test_contained_patterns_of_all_lengths(spark, monkeypatch):
    """Against the definition: patterns within each other, within words, of one character, empty, repeated, null; in one block or several."""
    import random

    from veritally.operators import containment

    rng = random.Random(6)
    make = lambda k: "".join(rng.choices("ab é\n", k=k))
    texts = [(i, make(rng.randint(0, 40))) for i in range(60)] + [(60, None), (61, ""), (5, "again ab"), (None, "ab")]
    patterns = [(i, make(rng.randint(1, 5))) for i in range(40)] + [(40, ""), (41, None), (42, "ab"), (43, "ab"), (44, "a" * 200)]
    a, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(patterns, "item_id long, pattern string")
    want = sorted(((j, i) for i, t in texts if t is not None for j, p in patterns if p is not None and p in t), key=repr)
    for at_once in (100_000, 7):
        monkeypatch.setattr(containment, "PATTERNS", at_once)
        got = containment.contained(a, "doc_id", b, "item_id")
        assert sorted(map(tuple, got.collect()), key=repr) == want
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert containment.contained(a.limit(0), "doc_id", b, "item_id").count() == containment.contained(a, "doc_id", b.limit(0), "item_id").count() == 0


def test_strongest_and_spread(spark):
    from veritally.operators.scoring import spread, strongest

    scored = spark.createDataFrame([(s, i, e) for s, es in {"a": [1, 1, 0], "b": [1, 0, 1], "c": [1, 1], "d": [1, 1, 1]}.items() for i, e in enumerate(es)], "system string, id int, em int")
    subset = spark.range(3).select(F.col("id").cast("int").alias("id"))
    order = lambda *rows: spark.createDataFrame(rows, "system string, place int, eligible boolean")
    assert tuple(strongest(scored, subset, order(("a", 2, True), ("b", 1, True), ("c", 0, True), ("d", 3, False))).first()) == ("b", 2, 3)
    assert strongest(scored, subset, order(("c", 0, True))).count() == 0
    summary = spark.createDataFrame([("ref", 0.9, 0.5), ("x", 0.7, 0.6), ("y", 0.8, 0.4)], "system string, m double, k double")
    assert sorted(map(tuple, spread(summary, "ref", ["m", "k"]).collect())) == [("k", 0.5, 0.4, 0.6), ("m", 0.9, 0.7, 0.8)]
    assert spread(summary, "none", ["m"]).count() == spread(summary.limit(1), "ref", ["m"]).count() == 0


def test_trust_checks(spark):
    runs = spark.createDataFrame(
        [("a", 2, 2, True, 0, 1.0, 1.0, True, "h", "h"), ("b", 1, 2, False, 3, 1.0, 2.0, True, "g", "h"), ("c", None, None, None, None, None, None, False, None, None)],
        "system string, n int, n_subset int, locked boolean, n_estimated int, price_then double, price_now double, has_summary boolean, ran_hash string, subset_hash string",
    )
    got = {}
    for r in provenance.run_warnings(runs).collect():
        got.setdefault(r.system, []).append(r.warning.split(":")[0])
    assert got == {"b": ["different subset", "partial", "not locked", "estimated tokens", "price changed"], "c": ["no summary"]}
    examples = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    predictions = spark.createDataFrame([("a", "1"), ("a", "9"), ("b", "2"), ("a", "8")], "system string, id string")
    assert [tuple(r) for r in provenance.unknown_ids(predictions, examples).collect()] == [("a", 2)]
    ids = spark.createDataFrame([("3", 0), ("1", 1), ("3", 2)], "id string, position int")
    assert [r.id for r in provenance.in_order(ids, examples).collect()] == ["3", "1", "3"]
    with pytest.raises(Exception, match="not in the split: 7"):
        provenance.in_order(spark.createDataFrame([("7", 0)], "id string, position int"), examples).collect()


def test_small_helpers(spark):
    from veritally.functions import multiset, text

    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    assert one(provenance.plain_number(F.lit(float("nan")))) is None and one(provenance.plain_number(F.lit(float("-inf")))) is None and one(provenance.plain_number(F.lit(2.5))) == 2.5
    assert one(text.run_name(F.lit("a"), F.lit("b"))) == "a__b"
    f = one(provenance.fingerprint_columns({"b": F.lit('"x"'), "a": F.lit("1")}))
    assert f.asDict() == provenance.fingerprint({"a": 1, "b": "x"})
    said = [one(errors.answer_text(F.lit("x"), F.lit(v), F.lit(f))) for v, f in ((True, False), (False, True), (False, False))]
    assert said == ["x", "(no answer: the call failed)", "(invalid output)"]
    pairs = lambda *kv: multiset.pairs(F.array(*(F.struct(F.lit(k).alias("type"), F.lit(v).alias("value")) for k, v in kv)))
    assert tuple(one(errors.unmatched(pairs(("a", "1"), ("a", "1")), pairs(("a", "1"), ("b", "2"), ("b", "2"))))) == (2, 1)


def test_neighbours_by_cells(spark):
    """The same rows as comparing all with all; of vectors in tight groups few are compared."""
    from veritally.operators import neighbours

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 16)) * 0.05, rng.normal(size=(40, 16)), np.zeros((3, 16))])
    x[7] = x[8] = x[9] * 2
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    queries = vectors.where("id % 25 = 0 OR id > 1535 OR id = 8").select(F.col("id").alias("q"), "v")
    for pivots, k in ((None, 5), (1, 3), (200, 40)):
        got, count = neighbours.Neighbours(vectors, pivots).topk(queries, k, 6)
        want = retrieval.topk(queries, vectors, k, 6)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
        c = count.first()
        assert c["all"] == queries.count() * len(x) and c.compared <= c["all"]
        if pivots is None:
            assert c.compared < c["all"] / 5
    few = vectors.where("id < 3")
    assert neighbours.Neighbours(few).topk(queries.where("q = 0"), 10)[0].count() == 3
    assert neighbours.Neighbours(vectors.limit(0)).topk(queries, 2)[0].count() == 0
    assert neighbours.Neighbours(vectors.where("id > 1539")).topk(queries.where("q = 0"), 2, 6)[0].count() == 2
