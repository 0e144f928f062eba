"""Queries on answers: parsing, validation, chat records, errors, provenance, comparison, headers, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritally.functions import calls, headers, text
from veritally.operators import chat, comparison, errors, probes, provenance, quality_gate, resample, sampling
from veritally.operators.scoring import SCORES, item_scores, summarize
from veritally.plans.bindings import LOG_SQL, SLOTS_SQL, answered, examples, run_log, table
from veritally.session import configure
from veritally.storage import written

#: What is done to an answer's JSON, by order number modulo 12.
DEFECTS = 12


def _texts(spark, d):
    """Answers as text: the gold call in JSON, with planted defects."""
    e = examples(configure(spark), d).select("id", "scenario", "intent", "slots", calls.target_json(F.col("intent"), F.col("slots")).alias("j"))
    k = F.pmod("id", F.lit(DEFECTS))
    j = F.col("j")
    made = F.when(k == 1, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), j)).when(k == 3, F.concat(j, F.lit(" trailing")))
    made = made.when(k == 4, F.concat(F.substring(j, 1, 12), F.lit("!"))).when(k == 5, F.regexp_replace(j, r"\}$", ',"extra":1}')).when(k == 6, F.concat(F.lit('{"intent":5,"slots":[]}'))).when(k == 7, F.lit('{"intent":"a"}')).when(k == 8, F.concat(F.lit("["), j, F.lit("]")))
    made = made.when(k == 9, F.concat(F.lit("  "), j, F.lit("\n "))).when(k == 10, F.lit('{"intent":"a","slots":[{"type":"x","value":1}]}')).when(k == 11, F.lit(None).cast("string")).otherwise(j)
    return e.select("id", "scenario", "intent", "slots", k.alias("k"), made.alias("text"))


def json_call_validity(spark, d):
    parsed = _texts(spark, d).select("id", F.col("k").cast("long").alias("k"), calls.parse_object(F.col("text")).alias("v"))
    return parsed.select("id", "k", F.col("v").isNotNull().alias("is_object"), calls.is_valid_object(F.col("v")).alias("valid"))


def json_known_labels(spark, d):
    known = F.array(*map(F.lit, ("1-URGENT", "2-HIGH")))
    return _texts(spark, d).select("id", calls.is_valid_call(F.col("text"), intents=known).alias("valid"))


def parsed_calls(spark, d):
    t = _texts(spark, d).where(calls.is_valid_call(F.col("text"))).withColumn("c", calls.call_of(F.col("text")))
    return t.select("id", calls.call_text(F.col("c.intent"), F.col("c.slots")).alias("call"))


def _chat_issues(spark, d):
    """(conv_id, issues) of every conversation as a chat record."""
    c = table(configure(spark), d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    messages = F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return c.select("conv_id", chat.issues(F.try_parse_json(F.to_json(F.struct(messages.alias("messages"))))).alias("issues"))


def chat_validation_issues(spark, d):
    r = _chat_issues(spark, d).select("conv_id", F.explode("issues").alias("i"))
    return r.select("conv_id", F.col("i.severity").alias("severity"), F.col("i.rule").alias("rule"), F.col("i.at").alias("at"))


def chat_turn_issues(spark, d):
    """The kinds of issues of each conversation."""
    return chat_validation_issues(spark, d).select("conv_id", "severity", "rule").distinct()


def chat_report(spark, d):
    return chat.report(_chat_issues(spark, d))


def _prompts(spark, d):
    """Benchmark requests with their two first neighbours by id as shots."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("t"))
    shots = table(spark, d, "benchmark").where("item_id < 2").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda s: F.struct(s["text"].alias("text"), F.lit("ok").alias("answer"))).alias("shots"))
    return b.crossJoin(F.broadcast(shots)).select("item_id", chat.prompt(F.lit("Answer."), F.col("shots"), F.col("t")).alias("messages"))


def _flat(m):
    return F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")


def render_prompts(spark, d):
    return _prompts(spark, d).select("item_id", _flat("messages").alias("prompt"))


def sft_records(spark, d):
    return _prompts(spark, d).select("item_id", _flat(chat.training_record(F.col("messages"), F.lit("ok"))).alias("record"))


def prompt_completion(spark, d):
    p = _prompts(spark, d).select("item_id", chat.prompt_completion(F.col("messages")).alias("p"))
    return p.select("item_id", F.size("p.prompt").cast("long").alias("n_prompt"), _flat("p.completion").alias("completion"))


def prompt_hashes(spark, d):
    return _prompts(spark, d).select("item_id", provenance.prompt_fingerprint(F.col("messages")).alias("hash"))


def usage_normalised(spark, d):
    """Usage objects of all spellings, made of event numbers: several fields for one thing, numbers as strings and fractions, booleans, no object."""
    e = table(configure(spark), d, "events").select("event_id")
    n = F.col("event_id") % 50
    forms = (
        '{"usage":{"prompt_tokens":%d,"completion_tokens":7,"prompt_tokens_details":{"cached_tokens":3},"cached_tokens":9}}', '{"usage":{"prompt_tokens":"%d","cached_tokens":2,"completion_tokens":true}}',
        '{"usage":{"prompt_tokens":%d.0,"completion_tokens":4,"cached_tokens":8,"prompt_cache_hit_tokens":1,"completion_tokens_details":{"reasoning_tokens":5}}}', '{"usage":[%d]}',
        '{"usage":{"prompt_tokens":"%d.5","completion_tokens":6.9,"prompt_tokens_details":[1],"prompt_cache_hit_tokens":false,"cached_tokens":4}}',
    )
    payload = F.element_at(F.array(*(F.format_string(f, n) for f in forms)), (F.col("event_id") % len(forms) + 1).cast("int"))
    u = calls.complete_usage(calls.usage_of(F.try_parse_json(payload), reasoning_inside=False), F.lit(100).cast("long"), F.lit(20).cast("long"))
    return e.select("event_id", u.alias("u")).select("event_id", "u.prompt_tokens", "u.completion_tokens", "u.cached_tokens", "u.reasoning_tokens", "u.reported", "u.estimated")


def content_texts(spark, d):
    """The turns' texts as contents of messages: strings, lists of parts, and what is neither."""
    c = table(configure(spark), d, "conversations")
    quoted = F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1)
    parts = F.array(F.to_json(F.struct(F.lit("text").alias("type"), F.left("text", F.lit(5)).alias("text"))), F.to_json(F.struct(F.substring("text", 6, 1 << 30).alias("text"))), F.lit('{"image":1}'))
    k = (F.col("conv_id") + F.col("turn")) % 4
    content = F.when(k == 0, quoted).when(k == 1, F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))).when(k == 2, F.length("text").cast("string")).otherwise(F.lit("null"))
    return c.select("conv_id", "turn", F.md5(calls.message_text(F.try_parse_json(content))).alias("text_md5"))


def _spelled(n, k):
    """Durations of event numbers in the spellings of headers, and some that aren't any."""
    s = lambda c: c.cast("string")
    forms = (F.concat(s(n % 59), F.lit("m"), s(n % 7), F.lit(".5s")), F.concat(s(n), F.lit("ms")), F.concat(F.lit(" "), s(n)), F.concat(s(n % 24), F.lit("H "), s(n % 60), F.lit("m")), F.concat(F.lit("soon "), s(n)), s(n + 1_700_000_000), F.concat(s(n), F.lit("x")), F.concat(F.lit("-"), s(n)))
    return F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))


def duration_parse(spark, d):
    e = table(spark, d, "events").select("event_id", _spelled(F.col("event_id") % 5000, F.col("event_id")).alias("x"))
    return e.select("event_id", F.round(headers.duration_seconds(F.col("x"), F.lit(1.7e9)), 6).alias("seconds"))


def retry_hints(spark, d):
    """Headers made of the events' numbers and times."""
    e = table(configure(spark), d, "events")
    n, now = F.col("event_id") % 500, F.unix_seconds(F.col("ts").cast("timestamp")).cast("double") - 60
    s = lambda c: c.cast("string")
    date = F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    kinds = (
        F.create_map(F.lit("Retry-After"), s(n)),
        F.create_map(F.lit("retry-after"), date, F.lit("date"), F.lit("x")),
        F.create_map(F.lit("x-ratelimit-reset-tokens"), F.concat(s(n % 9), F.lit("m")), F.lit("X-RateLimit-Remaining-tokens"), F.lit("0"), F.lit("x-ratelimit-reset-requests"), F.lit("90m"), F.lit("x-ratelimit-remaining-requests"), s(n + 1)),
        F.create_map(F.lit("x-ratelimit-reset"), F.concat(s(n), F.lit("s"))),
        F.create_map(F.lit("date"), s(n)),
    )
    h = F.element_at(F.array(*kinds), (F.col("event_id") % len(kinds) + 1).cast("int"))
    kept = headers.limit_headers(h)
    return e.select("event_id", F.round(headers.reset_seconds(kept, now), 6).alias("seconds"), F.size(kept).alias("kept"))


_BODIES = ("limit per day reached", "RPD ", "xrpdx", "requests per_minute", "Daily cap", "tokens per-day", "TPD")


def daily_quota_hints(spark, d):
    e = table(spark, d, "events")
    body = F.concat("event_type", F.element_at(F.array(*(F.lit(f" {b}") for b in _BODIES)), (F.col("event_id") % len(_BODIES) + 1).cast("int")), F.when(F.col("event_id") % 10 > 0, F.col("user_id").cast("string")))
    return e.select("event_id", headers.daily_quota(body).alias("daily"))


def backoff_delays(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("i"))
    return r.select("i", F.round(headers.backoff_seconds(F.col("i") + 1, F.lit(0.5), F.when(F.col("i") > 2, 200.0)), 6).alias("seconds"))


def degenerate_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", quality_gate.plain_degenerate(F.col("text")).alias("degenerate"))


def compressible_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", quality_gate.degenerate(F.col("text")).alias("degenerate"))


def quality_gate_reasons(spark, d):
    log = run_log(spark, d)
    rows = log.select("concurrency", "failed", F.when(F.col("pos") % 4 == 0, "length").otherwise("stop").alias("finish_reason"), (~F.col("failed") & (F.col("pos") % 2 == 0)).alias("valid"), F.when(F.col("pos") % 10 == 0, " ").otherwise("fine text").alias("text"))
    s = quality_gate.implausible(quality_gate.shares(rows, ["concurrency"], quality_gate.plain_degenerate(F.col("text"))))
    return s.select("concurrency", "n", *(F.round(c, 9).alias(c) for c in ("degenerate", "truncated", "failed", "valid")), "reasons")


def _scored(spark, d):
    return item_scores(answered(spark, d)).select("id", "scenario", "intent", "system", *SCORES)


def error_strata_sample(spark, d):
    """Wrong answers of both systems, ten of each system and kind."""
    s = _scored(spark, d).where("em = 0").withColumn("kind", F.when(F.col("valid") == 0, "invalid").when(F.col("intent_ok") == 0, "intent").otherwise("slots"))
    return sampling.sample_per_stratum(s, ["system", "kind"], "id", 10).select("system", "kind", "id")


def slot_differences(spark, d):
    a = answered(spark, d).where("system = 'A'")
    return a.select("id", errors.differences(F.col("pred_intent"), F.col("intent"), F.col("pred_slots"), F.col("slots"), F.col("valid")).alias("difference"))


def error_category_counts(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 6 == 0, " ").when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("category"))
    return errors.category_counts(e, "category")


def config_fingerprint(spark, d):
    """Fingerprints of a configuration per customer: model and parameters by nation, the prompt by segment."""
    c = table(spark, d, "customer")
    parts = {"prompt": F.to_json(F.struct((F.col("c_custkey") % 20).alias("k"), F.col("c_mktsegment").alias("text"))), "model": F.concat(F.lit('"m'), F.col("c_nationkey").cast("string"), F.lit('"')), "params": F.to_json(F.struct((F.col("c_nationkey") % 3).alias("temperature")))}
    return c.select("c_custkey", provenance.fingerprint_columns(parts).alias("f")).select("c_custkey", "f.*")


def _history(spark, d):
    n = table(spark, d, "nation")
    comp = F.create_map(F.lit("model"), F.concat(F.lit("m"), (F.col("n_nationkey") % 3).cast("string")), F.lit("prompt"), F.concat(F.lit("p"), (F.col("n_nationkey") % 2).cast("string")))
    return n.select(F.col("n_nationkey").cast("long").alias("pos"), F.concat(F.lit("s"), (F.col("n_nationkey") % 4).cast("string")).alias("system"), F.lit("S500").alias("subset"), F.lit("h").alias("subset_hash"), F.md5(F.to_json(comp)).alias("config_hash"), comp.alias("components"), F.lit("why").alias("reason"))


def lock_status(spark, d):
    h = _history(spark, d).where("pos < 20")
    wanted = _history(spark, d).where("pos >= 18")
    return provenance.lock_status(wanted, h)


def new_locks(spark, d):
    return provenance.new_locks(_history(spark, d).where("pos >= 5"), _history(spark, d).where("pos < 7")).select("pos", "system")


def merged_probes(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    old = n.where("n_nationkey < 15").select("n_nationkey", F.lit("old").alias("state"), "n_name")
    new = n.where("n_nationkey >= 10").select("n_nationkey", F.lit("new").alias("state"), "n_name")
    return provenance.merge_new_wins(old, new, "n_nationkey")


def probe_plan(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("endpoint"), (F.col("c_nationkey") % 3).alias("model"), F.col("c_name").alias("system"))
    return probes.plan(s)


def model_catalogue(spark, d):
    """Catalogues of nations, whose models are customers, as lists and as objects; some aren't any."""
    c = table(configure(spark), d, "customer")
    tier = F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment"))
    entry = F.to_json(F.struct(F.col("c_name").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("r"), tier)).alias("rate_limit_tier"), tier.alias("tier")))
    lists = c.groupBy("c_nationkey").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("]")).alias("j"))
    k = F.col("c_nationkey") % 3
    j = F.when(k == 0, F.col("j")).when(k == 1, F.concat(F.lit('{"models":'), "j", F.lit("}"))).otherwise(F.concat(F.lit("oops "), "j"))
    return lists.select("c_nationkey", F.explode(probes.catalogue(j)).alias("m")).select("c_nationkey", "m.id", "m.tier")


def paired_items(spark, d):
    return provenance.pair_scores(_scored(spark, d), "A").groupBy("system").agg(F.count("*").alias("n"), F.count_if((F.col("em") == 1) & (F.col("ref_em") == 0)).alias("only_system"), F.count_if((F.col("em") == 0) & (F.col("ref_em") == 1)).alias("only_reference"))


def comparison_report(spark, d):
    """Per system: scores, difference to the reference in points, and the formatted cells of the report."""
    s = summarize(_scored(spark, d), ["system"])
    ref = s.where("system = 'A'").select(F.col("exact_match").alias("ref"))
    both = s.crossJoin(F.broadcast(ref))
    return both.select("system", "n", F.round("exact_match", 9).alias("exact_match"), F.round("slot_f1", 9).alias("slot_f1"), F.round((F.col("exact_match") - F.col("ref")) * 100, 6).alias("points"), text.format_percent(F.col("exact_match")).alias("cell"))


def _systems(spark):
    """Systems with the names and billing that prices are looked up by; one has no price."""
    return spark.createDataFrame([("A", "Model One (4B)", "Paid"), ("B", "model: two", "FREE"), ("C", "none", "paid")], "system string, name string, billing string")


def _price_list(spark):
    return spark.createDataFrame([("model-one-4b/paid", 1.0, 0.25, 2.0), ("model-two/free", 0.5, None, 1.0)], "key string, price_in double, price_cached double, price_out double")


def resolved_prices(spark, d):
    """Suppliers as systems, whose names and billing are spelled in their own way; nations as the price list."""
    s = table(spark, d, "supplier")
    name = F.concat(F.lit("  Model: "), F.col("s_nationkey").cast("string"), F.lit(" ("), (F.col("s_suppkey") % 5).cast("string"), F.lit("B)"))
    systems = s.select(F.col("s_name").alias("system"), name.alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "Paid").otherwise("FREE").alias("billing"))
    n = table(spark, d, "nation")
    prices = n.select(F.concat(F.lit("model-"), F.col("n_nationkey").cast("string"), F.lit("-"), F.col("n_regionkey").cast("string"), F.lit("b/paid")).alias("key"), (F.col("n_nationkey") / 4.0).alias("price_in"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") / 8.0).alias("price_cached"), (F.col("n_regionkey") + 1.0).alias("price_out"))
    return comparison.resolved_prices(systems, prices)


def system_comparison(spark, d):
    """The whole comparison: scores, pairs, prices, costs, latencies, break-even, warnings, formatted cells."""
    system = lambda c: F.element_at(F.array(F.lit("A"), F.lit("B")), (c % 2 + 1).cast("int")).alias("system")
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("turns"))
    calls = turns.select(system(F.col("conv_id")), F.col("chars").alias("prompt"), F.col("turns").alias("completion"))
    log = run_log(spark, d).select(system(F.col("key")), "failed", "latency_s")
    s = _scored(spark, d)
    runs = s.groupBy("system").agg(F.count("*").alias("n")).select("system", "n", (F.col("n") + F.when(F.col("system") == "B", 1).otherwise(0)).alias("n_subset"), (F.col("system") == "A").alias("locked"), F.when(F.col("system") == "B", 3).otherwise(0).alias("n_estimated"), F.lit(1.0).alias("price_then"), F.lit(1.0).alias("price_now"))
    out = comparison.compare(s, "A", calls, comparison.resolved_prices(_systems(spark), _price_list(spark)), F.lit(40), log, runs, 0.5)
    return out.select("system", *(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c != "system"))


def comparison_sections(spark, d):
    """The sections of the comparison as lines: scores per scenario, unseen texts (orders of the first half of the keys stand for them), cost by load of the hosted system, and provenance."""
    system = lambda c: F.element_at(F.array(F.lit("A"), F.lit("B")), (c % 2 + 1).cast("int"))
    s = written(_scored(spark, d), "scored")
    unseen = s.select("id").distinct().where("id % 4 = 1")
    log = written(run_log(spark, d).withColumn("key", system(F.col("key"))), "log")
    rentals = spark.createDataFrame([("on_demand", 0.5), ("spot", 0.25)], "basis string, usd_per_hour double")
    calls_ = table(spark, d, "conversations").groupBy(system(F.col("conv_id")).alias("system")).agg((F.sum(F.length("text")) / 1e6 / F.countDistinct("conv_id")).alias("usd_per_call"))
    runs = s.select("system").distinct().select("system", F.concat(F.lit("c"), "system").alias("config_hash"), F.lit("h").alias("subset_hash"))
    locks = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("number"), F.lit("A").alias("system"), F.when(F.col("n_nationkey") % 2 == 0, "cA").otherwise("old").alias("config_hash"), F.lit("h").alias("subset_hash"), F.col("n_name").alias("reason"))
    sections = [comparison.scenario_scores(s), comparison.unseen_scores(s, unseen, 1000), comparison.hosted_costs(log, 86_400.0 * 30, rentals, "A", calls_), comparison.run_provenance(runs, log.select("key", "pos", "model", "failed"), locks)]
    out = comparison.full_report(s.groupBy("system").agg(F.count("*").alias("n")), sections)
    r = lambda c: F.round(c, 6)
    text_of = lambda *cs: F.concat_ws(" ", *(c.cast("string") for c in cs))
    return out.select(
        "system", "n", F.array_join(F.transform("scenarios", lambda x: text_of(x["scenario"], x["n"], (x["exact_match"] * x["n"]).cast("int"), x["weakest"])), ";").alias("scenarios"),
        "unseen.excluded", *(r(F.col(f"unseen.{c}")).alias(c) for c in ("exact_match", "low", "high")), F.col("unseen.n").alias("n_unseen"),
        F.size("load").alias("n_load"), r(F.aggregate("load", F.lit(0.0), lambda a, x: a + x["usd_per_1k"])).alias("usd"), r(F.aggregate("load", F.lit(0.0), lambda a, x: a + x["break_even"] / 1e6)).alias("break_even"), F.size(F.filter("load", lambda x: x["meets_limit"])).alias("meeting"),
        "provenance.locked", "provenance.reason", "provenance.models", "provenance.changed",
    )


def run_warnings(spark, d):
    c = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    runs = c.select(F.col("s_name").alias("system"), (k % 3).alias("n"), F.lit(2).alias("n_subset"), (k % 2 == 0).alias("locked"), (k % 5).alias("n_estimated"), F.lit(1.0).alias("price_then"), F.when(k % 7 == 0, 2.0).otherwise(1.0).alias("price_now"))
    return provenance.run_warnings(runs)


def _stream(spark, d):
    """Two files of the log, as a stream would find them."""
    from veritally.storage import scratch_path

    path = scratch_path(spark, "stream-in")
    log = run_log(spark, d).select("key", "pos", (F.col("at_us") / 1e6).alias("at_s"), "failed").withColumn("ts", F.timestamp_seconds("at_s"))
    log.repartition(2, "key").write.parquet(path)
    return path, log.schema, scratch_path(spark, "stream")


def stream_run_log(spark, d):
    """The log read as a stream: rows and failures per key and day, complete."""
    from veritally.streaming import runlog as s

    path, schema, work = _stream(spark, d)
    counted = s.windowed_counts(s.log_stream(spark, path, schema), "ts", "key", late="100 days")
    t = s.run_complete(counted, "counts", work)
    return t.groupBy("key").agg(F.count("*").alias("days"), F.sum("n").alias("n"), F.sum("failed").alias("failed"))


def stream_rate_limit(spark, d):
    from veritally.streaming import runlog as s

    path, schema, work = _stream(spark, d)
    out = s.run_available(s.rate_limited(s.log_stream(spark, path, schema), 2, 86_400.0), "limited", work, "append")
    return out.groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        json_call_validity, json_known_labels, parsed_calls, chat_validation_issues, chat_turn_issues, chat_report, render_prompts, sft_records, prompt_completion, prompt_hashes, usage_normalised, content_texts, duration_parse, retry_hints, daily_quota_hints, backoff_delays,
        degenerate_texts, compressible_texts, quality_gate_reasons, error_strata_sample, slot_differences, error_category_counts, config_fingerprint, lock_status, new_locks, merged_probes, probe_plan, model_catalogue, paired_items, comparison_report, resolved_prices, system_comparison, comparison_sections, run_warnings, stream_run_log, stream_rate_limit,
    )
}

_S = f"WITH {SLOTS_SQL}"
_ISSUES = """c AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id),
m AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations),
i(conv_id, severity, rule, pos) AS (SELECT conv_id, 'error', 'last is not the assistant', -1 FROM c WHERE r[-1] <> 'assistant'
 UNION ALL SELECT conv_id, 'error', 'system is not first', -1 FROM c WHERE list_contains(r[2:], 'system')
 UNION ALL SELECT conv_id, 'unsupported', 'several turns', -1 FROM c WHERE len(list_filter(r, lambda x: x = 'user')) > 1 OR len(list_filter(r, lambda x: x = 'assistant')) > 1
 UNION ALL SELECT conv_id, 'error', 'no user message', -1 FROM c WHERE len(list_filter(r, lambda x: x = 'user')) = 0 AND len(list_filter(r, lambda x: x = 'assistant')) <= 1
 UNION ALL SELECT conv_id, CASE WHEN role IN ('tool', 'function') THEN 'unsupported' ELSE 'error' END, CASE WHEN role IN ('tool', 'function') THEN 'tool role' ELSE 'invalid role' END, n FROM m WHERE role NOT IN ('system', 'user', 'assistant')
 UNION ALL SELECT conv_id, 'error', 'empty content', n FROM m WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) = '')"""
_SHOT = "(SELECT string_agg('user:' || text || '|assistant:ok', '|' ORDER BY item_id DESC) FROM benchmark WHERE item_id < 2)"
_PROMPT = f"'system:Answer.|' || {_SHOT} || '|user:' || text"
#: Pairs of missing and extra slots by type, then by value, by their places; then what is left.
_DIFFERENCES = """g AS (SELECT id, type, value, row_number() OVER (PARTITION BY id, type, value) AS k FROM gold),
p AS (SELECT id, type, value, row_number() OVER (PARTITION BY id, type, value) AS k FROM pred WHERE system = 'A'),
m1 AS (SELECT id, type, value, row_number() OVER (PARTITION BY id, type ORDER BY value) AS r FROM g ANTI JOIN p USING (id, type, value, k)),
e1 AS (SELECT id, type, value, row_number() OVER (PARTITION BY id, type ORDER BY value) AS r FROM p ANTI JOIN g USING (id, type, value, k)),
m2 AS (SELECT id, type, value, row_number() OVER (PARTITION BY id, value ORDER BY type) AS r FROM m1 ANTI JOIN e1 USING (id, type, r)),
e2 AS (SELECT id, type, value, row_number() OVER (PARTITION BY id, value ORDER BY type) AS r FROM e1 ANTI JOIN m1 USING (id, type, r)),
s AS (SELECT id, 1 AS step, type, m1.value, r, type || ' ''' || e1.value || ''' (gold ''' || m1.value || ''')' AS line FROM m1 JOIN e1 USING (id, type, r)
 UNION ALL SELECT id, 2, m2.type, value, r, '''' || value || ''' as ' || e2.type || ' (gold ' || m2.type || ')' FROM m2 JOIN e2 USING (id, value, r)
 UNION ALL SELECT id, 3, type, value, r, 'missing ' || type || '=' || value FROM m2 ANTI JOIN e2 USING (id, value, r)
 UNION ALL SELECT id, 4, type, value, r, 'extra ' || type || '=' || value FROM e2 ANTI JOIN m2 USING (id, value, r)),
notes AS (SELECT id, string_agg(line, '; ' ORDER BY step, type, value, r) AS notes FROM s GROUP BY id)"""
ORACLE_SQL = {
    "json_call_validity": "SELECT o_orderkey AS id, CAST(o_orderkey % 12 AS BIGINT) AS k, o_orderkey % 12 IN (0, 1, 5, 6, 7, 9, 10) AS is_object, o_orderkey % 12 IN (0, 1, 9) AS valid FROM orders",
    "json_known_labels": "SELECT o_orderkey AS id, o_orderkey % 12 IN (0, 1, 9) AND o_orderpriority IN ('1-URGENT', '2-HIGH') AS valid FROM orders",
    "parsed_calls": f"{_S} SELECT o_orderkey AS id, o_orderpriority || coalesce(' | ' || string_agg(type || '=' || value, '; ' ORDER BY line, type, value), '') AS call FROM orders LEFT JOIN gold ON gold.id = o_orderkey WHERE o_orderkey % 12 IN (0, 1, 9) GROUP BY o_orderkey, o_orderpriority",
    "chat_validation_issues": f'WITH {_ISSUES} SELECT conv_id, severity, rule, CAST(pos AS INTEGER) AS "at" FROM i',
    "chat_turn_issues": f"WITH {_ISSUES} SELECT DISTINCT conv_id, severity, rule FROM i",
    "chat_report": f"WITH {_ISSUES} SELECT (SELECT count(*) FROM c) AS records, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'unsupported') AS unsupported, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity <> 'warning') = 0 AS ok FROM i",
    "render_prompts": f"SELECT item_id, {_PROMPT} AS prompt FROM benchmark",
    "sft_records": f"SELECT item_id, {_PROMPT} || '|assistant:ok' AS record FROM benchmark",
    "prompt_completion": "SELECT item_id, 5::BIGINT AS n_prompt, 'user:' || text AS completion FROM benchmark",
    "usage_normalised": """WITH p AS (SELECT event_id, CAST([format('{{"usage":{{"prompt_tokens":{},"completion_tokens":7,"prompt_tokens_details":{{"cached_tokens":3}},"cached_tokens":9}}}}', event_id % 50), format('{{"usage":{{"prompt_tokens":"{}","cached_tokens":2,"completion_tokens":true}}}}', event_id % 50),
 format('{{"usage":{{"prompt_tokens":{}.0,"completion_tokens":4,"cached_tokens":8,"prompt_cache_hit_tokens":1,"completion_tokens_details":{{"reasoning_tokens":5}}}}}}', event_id % 50), format('{{"usage":[{}]}}', event_id % 50),
 format('{{"usage":{{"prompt_tokens":"{}.5","completion_tokens":6.9,"prompt_tokens_details":[1],"prompt_cache_hit_tokens":false,"cached_tokens":4}}}}', event_id % 50)][event_id % 5 + 1] AS JSON) AS j FROM events),
f AS (SELECT event_id, json_type(j, '$.usage') = 'OBJECT' AS reported, list_transform(['$.usage.prompt_tokens', '$.usage.completion_tokens', '$.usage.completion_tokens_details.reasoning_tokens', '$.usage.prompt_tokens_details.cached_tokens', '$.usage.prompt_cache_hit_tokens', '$.usage.cached_tokens'],
 lambda x: CASE WHEN json_type(j, x) IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(j, x) AS BIGINT) WHEN json_type(j, x) = 'DOUBLE' THEN CAST(trunc(CAST(json_extract_string(j, x) AS DOUBLE)) AS BIGINT) WHEN json_type(j, x) = 'VARCHAR' AND regexp_full_match(json_extract_string(j, x), '[0-9]+') THEN CAST(json_extract_string(j, x) AS BIGINT) END) AS v FROM p)
SELECT event_id, coalesce(v[1], 100) AS prompt_tokens, coalesce(v[2] + coalesce(v[3], 0), 20) AS completion_tokens, coalesce(v[4], v[5], v[6]) AS cached_tokens, v[3] AS reasoning_tokens, reported, v[1] IS NULL OR v[2] IS NULL AS estimated FROM f""",
    "content_texts": """WITH j AS (SELECT conv_id, turn, CAST(CASE (conv_id + turn) % 4 WHEN 0 THEN to_json(text) WHEN 1 THEN json_array(json_object('type', 'text', 'text', text[:5]), json_object('text', text[6:]), json_object('image', 1)) WHEN 2 THEN to_json(length(text)) ELSE 'null' END AS JSON) AS j FROM conversations)
SELECT conv_id, turn, md5(CASE json_type(j) WHEN 'VARCHAR' THEN json_extract_string(j, '$') WHEN 'ARRAY' THEN array_to_string(list_transform(CAST(j AS JSON[]), lambda x: coalesce(json_extract_string(x, '$.text'), '')), '') END) AS text_md5 FROM j""",
    "duration_parse": r"""WITH n AS (SELECT event_id, event_id % 5000 AS n FROM events), x AS (SELECT event_id, lower(trim([n % 59 || 'm' || n % 7 || '.5s', n || 'ms', ' ' || n, n % 24 || 'H ' || n % 60 || 'm', 'soon ' || n, CAST(n + 1700000000 AS VARCHAR), n || 'x', '-' || n][event_id % 8 + 1])) AS x FROM n),
p AS (SELECT event_id, x, TRY_CAST(x AS DOUBLE) AS v, regexp_extract_all(x, '(\d+(?:\.\d+)?)(ms|s|m|h|d)', 1) AS q, regexp_extract_all(x, '(\d+(?:\.\d+)?)(ms|s|m|h|d)', 2) AS u, array_to_string(regexp_extract_all(x, '(\d+(?:\.\d+)?)(ms|s|m|h|d)'), '') AS r FROM x)
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN greatest(0, CASE WHEN v > 1e9 THEN v - 1.7e9 ELSE v END) WHEN r <> '' AND r = replace(x, ' ', '') THEN list_sum(list_transform(list_zip(q, u), lambda z: CAST(z[1] AS DOUBLE) * CASE z[2] WHEN 'ms' THEN 0.001 WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END)) END, 6)::DOUBLE AS seconds FROM p""",
    "retry_hints": r"""WITH e AS (SELECT event_id, event_id % 500 AS n, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) - 60 AS now, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS date FROM events),
h AS (SELECT event_id, now, [[{'k': 'Retry-After', 'v': CAST(n AS VARCHAR)}], [{'k': 'retry-after', 'v': date}, {'k': 'date', 'v': 'x'}], [{'k': 'x-ratelimit-reset-tokens', 'v': n % 9 || 'm'}, {'k': 'X-RateLimit-Remaining-tokens', 'v': '0'}, {'k': 'x-ratelimit-reset-requests', 'v': '90m'}, {'k': 'x-ratelimit-remaining-requests', 'v': CAST(n + 1 AS VARCHAR)}],
 [{'k': 'x-ratelimit-reset', 'v': n || 's'}], [{'k': 'date', 'v': CAST(n AS VARCHAR)}]][event_id % 5 + 1] AS h FROM e),
l AS (SELECT event_id, now, unnest(h) AS x FROM h), k AS (SELECT event_id, now, lower(x.k) AS k, x.v AS v FROM l WHERE lower(x.k) LIKE 'x-ratelimit%' OR lower(x.k) = 'retry-after'),
w AS (SELECT event_id, max(CASE WHEN k = 'retry-after' THEN greatest(0, coalesce(TRY_CAST(v AS DOUBLE), epoch(try_strptime(v, '%a, %d %b %Y %H:%M:%S GMT')) - now)) END) AS retry, count(*) AS kept FROM k GROUP BY event_id),
r AS (SELECT a.event_id, max(CAST(regexp_extract(a.v, '\d+') AS DOUBLE) * CASE WHEN a.v LIKE '%m' THEN 60 ELSE 1 END) AS reset FROM k a LEFT JOIN k b ON a.event_id = b.event_id AND b.k = replace(a.k, '-reset', '-remaining') WHERE a.k LIKE 'x-ratelimit-reset%' AND coalesce(b.v IN ('0', '0.0'), true) GROUP BY 1)
SELECT event_id, round(coalesce(retry, reset), 6)::DOUBLE AS seconds, CAST(coalesce(kept, 0) AS INTEGER) AS kept FROM events LEFT JOIN w USING (event_id) LEFT JOIN r USING (event_id)""",
    "daily_quota_hints": rf"""SELECT event_id, coalesce(regexp_matches(event_type || [{", ".join(f"' {b}'" for b in _BODIES)}][event_id % {len(_BODIES)} + 1] || CASE WHEN event_id % 10 > 0 THEN CAST(user_id AS VARCHAR) END, '(?i)per[\s_-]*day|daily|\bRPD\b|\bTPD\b'), false) AS daily FROM events""",
    "backoff_delays": "SELECT r_regionkey AS i, round(greatest(least(60, pow(2, r_regionkey)) * 0.75, CASE WHEN r_regionkey > 2 THEN 120.0 ELSE 0.0 END), 6)::DOUBLE AS seconds FROM region",
    "degenerate_texts": "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' OR (length(text) >= 8 AND len(list_distinct(string_split(text, ''))) <= 2) OR length(regexp_replace(text, '[^�]', '', 'g')) > length(text) // 4 AS degenerate FROM documents",
    "quality_gate_reasons": f"WITH {LOG_SQL}, s AS (SELECT concurrency, count(*) AS n, round(avg(CASE WHEN pos % 10 = 0 THEN 1 ELSE 0 END), 9) AS degenerate, round(avg(CASE WHEN pos % 4 = 0 THEN 1 ELSE 0 END), 9) AS truncated, round(avg(CASE WHEN failed THEN 1 ELSE 0 END), 9) AS failed, round(avg(CASE WHEN NOT failed AND pos % 2 = 0 THEN 1 ELSE 0 END), 9) AS valid FROM log GROUP BY concurrency) SELECT *, concat_ws('; ', CASE WHEN degenerate > 0.05 THEN 'degenerate texts' END, CASE WHEN truncated > 0.2 THEN 'truncated texts' END, CASE WHEN failed > 0.05 THEN 'failed calls' END, CASE WHEN valid < 0.5 THEN 'few valid answers' END) AS reasons FROM s",
    "error_strata_sample": f"{_S}, w AS (SELECT system, id, CASE WHEN valid = 0 THEN 'invalid' WHEN intent_ok = 0 THEN 'intent' ELSE 'slots' END AS kind FROM scored WHERE em = 0) SELECT system, kind, id FROM w QUALIFY row_number() OVER (PARTITION BY system, kind ORDER BY md5('{sampling.SEED}:' || system || ':' || kind || ':' || id), id) <= 10",
    "slot_differences": f"{_S}, {_DIFFERENCES} SELECT id, CASE WHEN NOT ok THEN 'no valid answer' ELSE coalesce(nullif(concat_ws('; ', CASE WHEN pred_intent <> intent THEN 'intent ' || pred_intent || ' (gold ' || intent || ')' END, notes), ''), 'none') END AS difference FROM item LEFT JOIN notes USING (id) WHERE system = 'A'",
    "error_category_counts": "SELECT CASE WHEN event_id % 6 = 0 OR event_id % 7 = 0 THEN '(blank)' ELSE event_type END AS category, count(*) AS n FROM events GROUP BY 1",
    "config_fingerprint": """WITH c AS (SELECT c_custkey, sha256('"m' || c_nationkey || '"') AS model, sha256('{"temperature":' || c_nationkey % 3 || '}') AS params, sha256('{"k":' || c_custkey % 20 || ',"text":"' || c_mktsegment || '"}') AS prompt FROM customer) SELECT *, sha256('{"model":"' || model || '","params":"' || params || '","prompt":"' || prompt || '"}') AS config FROM c""",
    "lock_status": "WITH h AS (SELECT n_nationkey AS pos, 's' || n_nationkey % 4 AS system, 'm' || n_nationkey % 3 AS m, 'p' || n_nationkey % 2 AS p FROM nation), w AS (SELECT * FROM h WHERE pos >= 18), l AS (SELECT * FROM h WHERE pos < 20 QUALIFY row_number() OVER (PARTITION BY system ORDER BY pos DESC) = 1) SELECT w.system, 'S500' AS subset, EXISTS (SELECT 1 FROM h WHERE h.pos < 20 AND h.system = w.system AND h.m = w.m AND h.p = w.p) AS locked, concat_ws(',', CASE WHEN w.m <> l.m THEN 'model' END, CASE WHEN w.p <> l.p THEN 'prompt' END) AS changed FROM w LEFT JOIN l USING (system)",
    "new_locks": "WITH h AS (SELECT CAST(n_nationkey AS BIGINT) AS pos, 's' || n_nationkey % 4 AS system, n_nationkey % 3 AS m, n_nationkey % 2 AS p FROM nation) SELECT pos, system FROM h w WHERE pos >= 5 AND NOT EXISTS (SELECT 1 FROM h WHERE h.pos < 7 AND h.system = w.system AND h.m = w.m AND h.p = w.p)",
    "merged_probes": "SELECT n_nationkey, CASE WHEN n_nationkey >= 10 THEN 'new' ELSE 'old' END AS state, n_name FROM nation",
    "probe_plan": "SELECT c_mktsegment AS endpoint, c_nationkey % 3 AS model, min(c_custkey) AS pos, arg_min(c_name, c_custkey) AS system FROM customer GROUP BY 1, 2",
    "model_catalogue": "SELECT c_nationkey, c_name AS id, CASE WHEN c_custkey % 3 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'r' ELSE '' END || c_mktsegment END AS tier FROM customer WHERE c_nationkey % 3 < 2",
    "paired_items": f"{_S} SELECT 'B' AS system, count(*) AS n, count(*) FILTER (b.em = 1 AND a.em = 0) AS only_system, count(*) FILTER (b.em = 0 AND a.em = 1) AS only_reference FROM scored a JOIN scored b USING (id) WHERE a.system = 'A' AND b.system = 'B'",
    "comparison_report": f"{_S}, s AS (SELECT system, count(*) AS n, avg(em) AS e, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f FROM scored GROUP BY system) SELECT system, n, round(e, 9) AS exact_match, round(f, 9) AS slot_f1, round((e - (SELECT e FROM s WHERE system = 'A')) * 100, 6) AS points, printf('%.1f', round(e * 100, 1)) || ' %' AS cell FROM s",
    "resolved_prices": """WITH s AS (SELECT s_name AS system, '  Model: ' || s_nationkey || ' (' || s_suppkey % 5 || 'B)' AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'Paid' ELSE 'FREE' END AS billing FROM supplier), k AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') || '/' || lower(billing) AS key FROM s),
p AS (SELECT 'model-' || n_nationkey || '-' || n_regionkey || 'b/paid' AS key, n_nationkey / 4.0::DOUBLE AS price_in, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 8.0::DOUBLE END AS price_cached, n_regionkey + 1.0::DOUBLE AS price_out FROM nation) SELECT * FROM k LEFT JOIN p USING (key)""",
    "system_comparison": f"""{_S}, {LOG_SQL}, pl AS (SELECT * FROM (VALUES ('A', 1.0::DOUBLE, 0.25::DOUBLE, 2.0::DOUBLE), ('B', 0.5, 0.5, 1.0)) t(system, pi, pc, po)),
ca AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'A' ELSE 'B' END AS system, sum(length(text)) AS pr, count(*) AS co FROM conversations GROUP BY conv_id),
cc AS (SELECT system, count(*) AS calls, sum((pr * pi + co * po) / 1e6) / count(*) AS usd_per_call, sum((pr * pi + co * po) / 1e6) / count(*) * 1000 AS upper_per_1k, sum(((pr - least(40, pr)) * pi + least(40, pr) * pc + co * po) / 1e6) / count(*) * 1000 AS lower_per_1k FROM ca JOIN pl USING (system) GROUP BY system),
su AS (SELECT system, count(*) AS n, avg(em) AS exact_match, avg(intent_ok) AS intent_accuracy, avg(valid) AS schema_valid, sum(tp) / (sum(tp) + sum(fp)) AS slot_precision, sum(tp) / (sum(tp) + sum(fn)) AS slot_recall, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS slot_f1, sum(n_unfound) / sum(n_pred) AS unfound_rate FROM scored GROUP BY system),
pa AS (SELECT b.system, count(*) AS n_pairs, (avg(b.em) - avg(a.em)) * 100 AS points, count(*) FILTER (b.em = 1 AND a.em = 0) AS only_system, count(*) FILTER (b.em = 0 AND a.em = 1) AS only_reference FROM scored a JOIN scored b USING (id) WHERE a.system = 'A' AND b.system <> 'A' GROUP BY b.system),
pp AS (SELECT *, CASE WHEN only_system + only_reference = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(only_system + only_reference + 1) - lgamma(i + 1) - lgamma(only_system + only_reference - i + 1) - (only_system + only_reference) * ln(2))) FROM range(least(only_system, only_reference) + 1) k(i))) END AS p FROM pa),
la AS (SELECT CASE WHEN key % 2 = 0 THEN 'A' ELSE 'B' END AS system, latency_s, row_number() OVER (PARTITION BY key % 2 ORDER BY latency_s) AS r, count(*) OVER (PARTITION BY key % 2) AS m FROM log WHERE NOT failed),
sl AS (SELECT system, min(latency_s) FILTER (r >= greatest(1, ceil(round(50 * m / 100, 9)))) AS p50, min(latency_s) FILTER (r >= greatest(1, ceil(round(95 * m / 100, 9)))) AS p95 FROM la GROUP BY system)
SELECT system, n, round(exact_match, 6) AS exact_match, round(intent_accuracy, 6) AS intent_accuracy, round(schema_valid, 6) AS schema_valid, round(slot_precision, 6) AS slot_precision, round(slot_recall, 6) AS slot_recall, round(slot_f1, 6) AS slot_f1, round(unfound_rate, 6) AS unfound_rate,
 n_pairs, round(points, 6) AS points, only_system, only_reference, round(p, 6) AS p, calls, round(usd_per_call, 6) AS usd_per_call, round(upper_per_1k, 6) AS upper_per_1k, round(lower_per_1k, 6) AS lower_per_1k, round(p50, 6) AS p50, round(p95, 6) AS p95,
 CASE WHEN system = 'B' THEN 'estimated tokens; not locked; partial: ' || n || ' of ' || (n + 1) ELSE '' END AS warnings, round(0.5 * 730 / usd_per_call, 6) AS break_even,
 concat_ws(' | ', printf('%.1f', round(exact_match * 100, 1)) || ' %', CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END, '$' || CASE WHEN upper_per_1k >= 1 THEN format('{{:,.2f}}', upper_per_1k) WHEN upper_per_1k >= 0.1 THEN printf('%.3f', upper_per_1k) ELSE printf('%.4f', upper_per_1k) END) AS cells
FROM su LEFT JOIN pp USING (system) LEFT JOIN cc USING (system) LEFT JOIN sl USING (system)""",
    "comparison_sections": f"""{_S}, {LOG_SQL}, y AS (SELECT CASE WHEN key % 2 = 0 THEN 'A' ELSE 'B' END AS key, pos, model, failed, concurrency, latency_s FROM log),
e AS (SELECT system, scenario, count(*) AS n, CAST(sum(em) AS INTEGER) AS c, row_number() OVER (PARTITION BY system ORDER BY avg(em), scenario) = 1 AS weak FROM scored GROUP BY system, scenario), sc AS (SELECT system, CAST(sum(n) AS BIGINT) AS n, string_agg(scenario || ' ' || n || ' ' || c || ' ' || weak, ';' ORDER BY scenario) AS scenarios FROM e GROUP BY system),
l AS (SELECT system, em, row_number() OVER (ORDER BY system, id) - 1 AS pos FROM scored WHERE id % 4 = 1), {resample.resampled_sql("l", ["em"], 1000, ("system",))},
q AS (SELECT system, round(quantile_cont(em / w, 0.025), 6) AS low, round(quantile_cont(em / w, 0.975), 6) AS high FROM s GROUP BY system), un AS (SELECT system, count(*) AS n_unseen, round(avg(em), 6) AS exact_match FROM l GROUP BY system),
rr AS (SELECT *, row_number() OVER (PARTITION BY concurrency, failed ORDER BY latency_s) AS r, count(*) OVER (PARTITION BY concurrency, failed) AS m FROM y), lv AS (SELECT concurrency, count(*) FILTER (NOT failed) / (86400.0 * 30) AS rps, count(*) FILTER (failed) AS errors, max(latency_s) FILTER (NOT failed AND r = greatest(1, CAST(ceil(round(95 * m / 100.0, 9)) AS BIGINT))) AS p95 FROM rr GROUP BY concurrency),
cl AS (SELECT sum(length(text)) / 1e6 / count(DISTINCT conv_id) AS usd FROM conversations WHERE conv_id % 2 = 1),
ld AS (SELECT 'A' AS system, CAST(count(*) AS INTEGER) AS n_load, round(sum(h / (rps * 3600) * 1000), 6) AS usd, round(sum(h * 730 / cl.usd / 1e6), 6) AS break_even, CAST(count(*) FILTER (coalesce(p95 <= 1 AND errors = 0, false)) AS INTEGER) AS meeting FROM lv, cl, (VALUES (0.5::DOUBLE), (0.25)) b(h)),
md AS (SELECT key AS system, model, min(pos) AS first FROM y WHERE NOT failed AND model IS NOT NULL GROUP BY ALL), mo AS (SELECT system, string_agg(model, ',' ORDER BY first) AS models, count(*) > 1 AS changed FROM md GROUP BY system),
lk AS (SELECT 'A' AS system, arg_max(n_name, n_nationkey) AS reason FROM nation WHERE n_nationkey % 2 = 0)
SELECT system, n, scenarios, n - n_unseen AS excluded, exact_match, low, high, n_unseen, n_load, usd, break_even, meeting, reason IS NOT NULL AS locked, reason, models, changed FROM sc LEFT JOIN un USING (system) LEFT JOIN q USING (system) LEFT JOIN ld USING (system) LEFT JOIN lk USING (system) LEFT JOIN mo USING (system)""",
    "run_warnings": "WITH r AS (SELECT s_name AS system, s_suppkey AS k FROM supplier) SELECT system, 'partial: ' || k % 3 || ' of 2' AS warning FROM r WHERE k % 3 < 2 UNION ALL SELECT system, 'not locked' FROM r WHERE k % 2 <> 0 UNION ALL SELECT system, 'estimated tokens' FROM r WHERE k % 5 > 0 UNION ALL SELECT system, 'price changed' FROM r WHERE k % 7 = 0",
    "stream_run_log": f"WITH {LOG_SQL} SELECT key, count(DISTINCT at_us // 86400000000) AS days, count(*) AS n, count(*) FILTER (failed) AS failed FROM log GROUP BY key",
}
