"""Queries that write a format and read it back, and queries on labels, gates, epochs, intervals and warnings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from veritally.functions import calls, text
from veritally.operators import audit, load, provenance, quality_gate, scoring, subsets, waves
from veritally.plans.answers import run_warnings
from veritally.plans.bindings import CORPUS_SQL, LOG_SQL, corpus, run_log, table
from veritally.session import configure
from veritally.sources import files
from veritally.storage import scratch_path, written
from veritally.versions import VersionedTable


def examples_file(spark, d):
    """Examples written as JSONL and read back."""
    path = scratch_path(spark, "examples")
    slot = F.array(F.struct(F.lit("label").alias("type"), F.col("label").alias("value")))
    files.write_examples(corpus(spark, d).select("id", "split", "scenario", "intent", "text", slot.alias("slots")), path)
    return files.read_examples(spark, path).select("id", "split", "scenario", "intent", F.md5("text").alias("text_md5"), F.element_at("slots", 1)["value"].alias("label"))


def chat_file(spark, d):
    """Conversations written as chat records with their ids beside them, read back, each with its id."""
    path = scratch_path(configure(spark), "chat")
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    files.write_chat(c.select(F.col("conv_id").alias("id"), F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages")), path)
    messages = F.try_variant_get("record", "$.messages", "array<struct<role:string,content:string>>")
    shown = F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return files.read_chat_with_ids(spark, path).select(F.col("id").cast("long").alias("conv_id"), F.md5(shown).alias("messages_md5"))


def prediction_log_file(spark, d):
    """The run log appended in two parts and read as a prediction log; a missing log is empty."""
    path = scratch_path(spark, "log")
    before = files.read_log(spark, path).count()
    log = run_log(spark, d).select(F.concat_ws("-", F.col("key").cast("string"), F.col("pos").cast("string")).alias("id"), "latency_s", F.col("model").alias("model_returned"), (F.col("tokens") % 3).alias("retries"), F.when(F.col("failed"), "boom").alias("error"), "retriable", F.create_map(F.lit("date"), F.col("pos").cast("string")).alias("ratelimit_headers"))
    for part in (0, 1):
        files.append_log(log.where(F.pmod(F.xxhash64("id"), F.lit(2)) == part), path)
    return files.read_log(spark, path).select("id", "latency_s", "model_returned", (F.col("retries") + before).alias("retries"), "error", "retriable", F.col("ratelimit_headers")["date"].alias("date"))


def lock_history_file(spark, d):
    """A history of locks that grows by two appends."""
    path = scratch_path(spark, "locks")
    n = table(spark, d, "nation")
    rows = n.select(F.lit(1).alias("lock_version"), F.col("n_name").alias("system"), F.lit("S").alias("subset"), F.md5("n_name").alias("config_hash"), F.create_map(F.lit("model"), F.col("n_regionkey").cast("string")).alias("components"), F.lit("why").alias("reason"), (F.col("n_nationkey") % 2 == 0).alias("git_dirty"))
    for part in (0, 1):
        files.append_locks(rows.where(F.col("git_dirty") == (part == 0)), path)
    return files.read_locks(spark, path).select("lock_version", "system", "config_hash", F.col("components")["model"].alias("model"), "git_dirty", F.col("git_commit").isNull().alias("no_commit"))


def _prompt_file(spark, d, suffix, value):
    path = scratch_path(spark, "prompts") + suffix
    table(spark, d, "benchmark").select(value.alias("value"), "item_id").coalesce(1).sortWithinPartitions("item_id").select("value").write.text(path)
    return files.read_prompts(spark, path).select("line", F.element_at("messages", 1)["role"].alias("role"), F.md5(F.element_at("messages", 1)["content"]).alias("content_md5"))


def prompt_text_file(spark, d):
    """A line per prompt."""
    return _prompt_file(spark, d, ".txt", F.regexp_replace("text", r"[\r\n]", " "))


def prompt_json_file(spark, d):
    """Lines with ``messages`` or ``text``, in turn."""
    as_messages = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages")))
    return _prompt_file(spark, d, ".jsonl", F.when(F.col("item_id") % 2 == 0, as_messages).otherwise(F.to_json(F.struct("text"))))


def throughput_documents(spark, d):
    """Benchmark documents in three spellings (a list, an object of levels, a bare list), read alike."""
    s = run_log(spark, d).groupBy("concurrency").agg(F.count("*").alias("n"), F.max("latency_s").alias("most")).withColumn("c", F.col("concurrency").cast("string"))
    rate, most = F.col("n").cast("string"), F.col("most").cast("string")
    spelled = F.array(
        F.concat(F.lit('{"levels":[{"concurrency":'), "c", F.lit(',"requests_per_s":'), rate, F.lit(',"latency_s":{"p50":0.5,"p95":'), most, F.lit("}}]}")),
        F.concat(F.lit('{"levels":{"a":{"clients":'), "c", F.lit(',"req_per_s":'), rate, F.lit(',"p50_s":0.5,"p95_s":'), most, F.lit("}}}")),
        F.concat(F.lit('[{"users":'), "c", F.lit(',"throughput":'), rate, F.lit(',"p50":0.5,"p95":true}]')),
    )
    each = s.select(F.posexplode(spelled).alias("spelling", "doc")).select("spelling", F.explode(files.levels_of(F.col("doc"))).alias("l"))
    return each.select("spelling", "l.concurrency", "l.requests_per_s", "l.p50", F.round("l.p95", 9).alias("p95"))


def category_file(spark, d):
    """Categories written as CSV once, read back and counted, blanks too."""
    from veritally.operators.errors import category_counts

    path = scratch_path(spark, "categories")
    files.write_csv_once(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("category")), path)
    return category_counts(files.read_categories(spark, path), "category")


def label_inventory(spark, d):
    return audit.inventory(corpus(spark, d).where("split = 'train'"), "intent").select(F.array_join("labels", ",").alias("labels"))


def response_formats(spark, d):
    """The strict response format for the labels of the train split."""
    inventory = lambda c: audit.inventory(corpus(spark, d).where("split = 'train'"), c).first()["labels"]  # noqa: E731 labels are a dimension
    return spark.createDataFrame([(provenance.canonical(calls.response_format(inventory("intent"), inventory("label"))),)], "format string")


def probe_gate(spark, d):
    """Which levels of the log a short probe would let pass."""
    log = run_log(spark, d)
    rows = log.select("concurrency", "failed", F.lit("stop").alias("finish_reason"), (F.col("pos") % 7 < F.col("concurrency") % 5).alias("valid"), F.when(F.col("pos") % 16 < 3, " ").otherwise("fine text").alias("text"))
    s = quality_gate.shares(rows, ["concurrency"], quality_gate.plain_degenerate(F.col("text")))
    return quality_gate.probe_passes(s, F.when(F.col("concurrency") == 64, "boom")).select("concurrency", F.round("degenerate", 9).alias("degenerate"), F.round("valid", 9).alias("valid"), "passes")


def operating_notes(spark, d):
    return load.operating_note(load.levels(run_log(spark, d), 86_400.0 * 30))


def best_epochs(spark, d):
    """Per language the epoch with most documents of quality 1."""
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    scores = docs.groupBy("lang", F.nullif(F.col("doc_id") % 4, F.lit(0)).alias("epoch")).agg(F.sum("quality").alias("correct"))
    return scoring.best_epoch(scores, ["lang"]).select("lang", F.col("epoch").cast("long").alias("epoch"), F.col("correct").cast("long").alias("correct"))


def half_widths(spark, d):
    """Half the spread of values per kind of event in points, and the widest of all."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return provenance.with_widest(e, F.col("low"), F.col("high")).select("event_type", F.round("half", 9).alias("half"), F.round("widest", 9).alias("widest"), text.format_points(F.col("half")).alias("cell"))


def iso_times(spark, d):
    e = table(configure(spark), d, "events")
    return e.select("event_id", text.iso_time(F.when(F.col("event_id") % 10 > 0, F.unix_timestamp(F.col("ts").cast("timestamp")))).alias("time"))


def _calls(batches):
    """Answers to customers: those of some numbers fail, and failures can be tried again."""
    for batch in batches:
        pos, key = (batch.column(c).to_pylist() for c in ("pos", "key"))
        failed = [k > 100 and k % 100 < 9 for k in key]
        text = lambda s: pa.array([s if f else None for f in failed], pa.string())  # noqa: E731, B023
        null = lambda t: pa.array([None] * len(key), t)  # noqa: E731, B023
        columns = [pa.array(pos, pa.int64()), pa.array(key, pa.int64()), text("boom"), text("retries"), pa.array([True if f else None for f in failed], pa.bool_()), null(pa.int32()), null(pa.string()), null(pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["pos", *_CALL_NAMES])


_CALL = "key long, error string, error_kind string, retriable boolean, status_code int, config_hash string, reset_at double"
_CALL_NAMES = [c.split()[0] for c in _CALL.split(", ")]


def committed_waves(spark, d):
    """All customers answered in waves of 50; the run stops at eight failures in a row, and is resumed to its end. Per customer: its rows, and the wave of its last."""
    log = waves.Waves(spark, scratch_path(spark, "waves"), _CALL, "key")
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    size = max(50, items.count() // 12)  # a few waves at any size
    first = log.run(items, _calls, [F.col("key")], waves.Limits(wave=size))
    if first.status != waves.COMPLETE:
        log.run(items, _calls, [F.col("key")], waves.Limits(wave=size, fail_streak=1 << 30), resume=True)
    return log.rows().groupBy("key").agg(F.count("*").alias("n"), F.max_by(F.col("error").isNotNull(), "pos").alias("failed"), F.lit(first.status).alias("first_run"), F.max(F.when(F.col("wave") <= first.wave, 1).otherwise(0)).cast("long").alias("in_first"))


def merged_table(spark, d):
    """Orders merged into a table that changes as a whole."""
    t = VersionedTable(spark, scratch_path(spark, "versioned"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("state"))
    t.merge(o.where("id % 3 < 2").withColumn("state", F.lit("old")), "id")
    t.merge(o.where("id % 3 > 0"), "id")
    return t.read().groupBy("state").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def lock_documents(spark, d):
    """Locks of nations' systems, written one region after the other; those with a blocker or a key that is locked are refused."""
    n = table(spark, d, "nation")
    system = F.concat(F.lit("s"), (F.col("n_nationkey") % 7).cast("string"))
    systems = n.select(system.alias("system"), F.concat(F.lit("p"), (F.col("n_nationkey") % 7).cast("string")).alias("price_id"), F.create_map(F.lit("repo"), F.when(F.col("n_nationkey") % 7 != 3, F.col("n_name"))).alias("checkpoint"))
    blockers = written(provenance.lock_blockers(systems, n.where("n_nationkey % 7 <> 5").select(F.concat(F.lit("p"), (F.col("n_nationkey") % 7).cast("string")).alias("price_id"))).distinct(), "blockers")
    wanted = n.select(F.lit(1).alias("lock_version"), system.alias("system"), F.lit("S").alias("subset"), F.lit("h").alias("subset_hash"), F.concat(F.lit("c"), (F.col("n_nationkey") % 2).cast("string")).alias("config_hash"), F.create_map(F.lit("model"), system).alias("components"), F.col("n_name").alias("reason"), F.col("n_nationkey").alias("at"))
    path = scratch_path(spark, "lock-documents")
    for key in sorted(r[0] for r in n.select("n_nationkey").collect()):  # nations are a dimension; each is a writer of its own
        try:
            provenance.write_locks(wanted.where(F.col("at") == key).drop("at"), blockers, path)
        except provenance.LockRefused:
            pass
    return provenance.read_lock_documents(spark, path).select("number", "system", "config_hash", "reason")


def subset_documents(spark, d):
    """The document of two nested subsets of the test documents, written, read and checked against rows of which some are gone."""
    full = corpus(spark, d).select("split", F.col("scenario").alias("stratum"), "id", "doc_id")
    test = full.where("split = 'test'")
    members = test.where("doc_id % 20 = 0").withColumn("subset", F.lit("L")).union(test.where("doc_id % 100 = 0").withColumn("subset", F.lit("S"))).select("subset", "stratum", "id")
    plan = [{"name": "L", "split": "test", "floor": 0}, {"name": "S", "split": "test", "parent": "L", "floor": 0}]
    path = scratch_path(spark, "subsets")
    subsets.write_subsets(spark, path, subsets.document(members, full, plan, 7, 0))
    return subsets.drift(spark, subsets.read_subsets(spark, path), full.where("doc_id % 40 > 0 OR split <> 'test'"))


def warning_kinds(spark, d):
    return provenance.distinct_warnings(run_warnings(spark, d))


QUERIES = {
    f.__name__: f
    for f in (examples_file, chat_file, prediction_log_file, lock_history_file, prompt_text_file, prompt_json_file, throughput_documents, category_file, label_inventory, response_formats, probe_gate, operating_notes, best_epochs, half_widths, iso_times, warning_kinds, committed_waves, merged_table, lock_documents, subset_documents)
}

_C = f"WITH {CORPUS_SQL}"
_L = f"WITH {LOG_SQL}"
_ENUM = "'[\"' || string_agg(DISTINCT {0}, '\",\"' ORDER BY {0}) || '\"]'"
_SCHEMA = """'{"json_schema":{"name":"call","schema":{"additionalProperties":false,"properties":{"intent":{"enum":' || INTENTS || ',"type":"string"},"slots":{"items":{"additionalProperties":false,"properties":{"type":{"enum":' || TYPES ||
',"type":"string"},"value":{"type":"string"}},"required":["type","value"],"type":"object"},"type":"array"}},"required":["intent","slots"],"type":"object"},"strict":true},"type":"json_schema"}'"""
ORACLE_SQL = {
    "examples_file": f"{_C} SELECT id, split, scenario, intent, md5(text) AS text_md5, label FROM corpus",
    "chat_file": "SELECT conv_id, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS messages_md5 FROM conversations GROUP BY conv_id",
    "prediction_log_file": f"{_L} SELECT key || '-' || pos AS id, latency_s, model AS model_returned, tokens % 3 AS retries, CASE WHEN failed THEN 'boom' END AS error, retriable, CAST(pos AS VARCHAR) AS date FROM log",
    "lock_history_file": "SELECT 1 AS lock_version, n_name AS system, md5(n_name) AS config_hash, CAST(n_regionkey AS VARCHAR) AS model, n_nationkey % 2 = 0 AS git_dirty, true AS no_commit FROM nation",
    "prompt_text_file": "SELECT row_number() OVER (ORDER BY item_id) AS line, 'user' AS role, md5(trim(regexp_replace(text, '[\\r\\n]', ' ', 'g'))) AS content_md5 FROM benchmark",
    "prompt_json_file": "SELECT row_number() OVER (ORDER BY item_id) AS line, 'user' AS role, md5(text) AS content_md5 FROM benchmark",
    "throughput_documents": f"{_L}, s AS (SELECT concurrency, count(*)::DOUBLE AS n, max(latency_s) AS m FROM log GROUP BY concurrency) SELECT CAST(k.i AS INTEGER) AS spelling, concurrency, n AS requests_per_s, 0.5::DOUBLE AS p50, CASE WHEN k.i < 2 THEN round(m, 9) END AS p95 FROM s, range(3) k(i)",
    "category_file": "SELECT CASE WHEN p_size > 5 AND trim(p_brand) <> '' THEN p_brand ELSE '(blank)' END AS category, count(*) AS n FROM part GROUP BY 1",
    "label_inventory": f"{_C} SELECT string_agg(DISTINCT intent, ',' ORDER BY intent) AS labels FROM corpus WHERE split = 'train'",
    "response_formats": f"{_C} SELECT {_SCHEMA.replace('INTENTS', _ENUM.format('intent')).replace('TYPES', _ENUM.format('label'))} AS format FROM corpus WHERE split = 'train'",
    "probe_gate": f"{_L}, s AS (SELECT concurrency, avg(CASE WHEN pos % 16 < 3 THEN 1.0 ELSE 0.0 END) AS g, avg(CASE WHEN pos % 7 < concurrency % 5 THEN 1.0 ELSE 0.0 END) AS v FROM log GROUP BY concurrency) SELECT concurrency, round(g, 9) AS degenerate, round(v, 9) AS valid, concurrency <> 64 AND g <= 0.25 AND v >= 0.5 AS passes FROM s",
    "operating_notes": f"{_L}, r AS (SELECT concurrency, latency_s, row_number() OVER (PARTITION BY concurrency ORDER BY latency_s) AS k, count(*) OVER (PARTITION BY concurrency) AS n FROM log WHERE NOT failed), p AS (SELECT concurrency, min(latency_s) FILTER (k >= greatest(1, ceil(n * 0.95))) AS p95 FROM r GROUP BY 1), e AS (SELECT concurrency, count(*) FILTER (failed) AS errors FROM log GROUP BY 1) SELECT CASE WHEN bool_or(p95 <= 1 AND errors = 0) THEN 'a level meets the limit' WHEN bool_or(p95 <= 1) THEN 'levels within the limit had errors' ELSE 'no level is within the limit' END AS note FROM e LEFT JOIN p USING (concurrency)",
    "best_epochs": "SELECT lang, epoch, correct FROM (SELECT lang, nullif(doc_id % 4, 0) AS epoch, CAST(sum(quality) AS BIGINT) AS correct FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) WHERE epoch IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY correct DESC, epoch) = 1",
    "half_widths": "WITH h AS (SELECT event_type, (max(value) - min(value)) / 2 AS half FROM events GROUP BY 1) SELECT event_type, round(half, 9) AS half, round(max(half) OVER (), 9) AS widest, printf('%.1f pp', half * 100) AS cell FROM h",
    "iso_times": "SELECT event_id, CASE WHEN event_id % 10 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' ELSE 'unknown' END AS time FROM events",
    "committed_waves": """WITH s AS (SELECT greatest(50, count(*) // 12) AS size, count(*) AS n FROM customer), c AS (SELECT c_custkey AS key, c_custkey > 100 AND c_custkey % 100 < 9 AS failed, row_number() OVER (ORDER BY c_custkey) AS t FROM customer),
i AS (SELECT *, t - coalesce(max(CASE WHEN NOT failed THEN t END) OVER (ORDER BY t), 0) AS run FROM c), w AS (SELECT i.*, (t - 1) // size + 1 AS wave FROM i, s), f AS (SELECT min(wave) AS stop FROM w WHERE failed AND run >= 8)
SELECT key, CASE WHEN stop IS NULL OR NOT failed OR wave > stop THEN 1 ELSE 2 END AS n, failed, CASE WHEN stop IS NULL THEN 'complete' ELSE 'too_many_errors' END AS first_run, CAST(CASE WHEN stop IS NULL OR wave <= stop THEN 1 ELSE 0 END AS BIGINT) AS in_first FROM w, f""",
    "merged_table": "WITH m AS (SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE 'old' END AS state, o_orderkey AS id FROM orders) SELECT state, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM m GROUP BY state",
    "lock_documents": "WITH w AS (SELECT n_nationkey AS k, 's' || n_nationkey % 7 AS system, 'c' || n_nationkey % 2 AS config_hash, n_name AS reason FROM nation WHERE n_nationkey % 7 NOT IN (3, 5)), f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY system, config_hash ORDER BY k) = 1) SELECT row_number() OVER (ORDER BY k) AS number, system, config_hash, reason FROM f",
    "subset_documents": f"{_C}, t AS (SELECT doc_id FROM corpus WHERE split = 'test'), g AS (SELECT count(*) AS was, count(*) FILTER (doc_id % 40 > 0) AS now, count(*) FILTER (doc_id % 40 = 0 AND doc_id % 20 = 0) AS l, count(*) FILTER (doc_id % 40 = 0 AND doc_id % 100 = 0) AS s FROM t) SELECT 'split test' AS what, 'had ' || was || ' ids, has ' || now AS note FROM g UNION ALL SELECT 'subset L', l || ' ids aren''t in the split' FROM g UNION ALL SELECT 'subset S', s || ' ids aren''t in the split' FROM g",
    "warning_kinds": "WITH k AS (SELECT s_suppkey AS k FROM supplier), w AS (SELECT 'partial' AS warning FROM k WHERE k % 3 < 2 UNION ALL SELECT 'not locked' FROM k WHERE k % 2 <> 0 UNION ALL SELECT 'estimated tokens' FROM k WHERE k % 5 > 0 UNION ALL SELECT 'price changed' FROM k WHERE k % 7 = 0) SELECT warning, count(*) AS n FROM w GROUP BY 1",
}
