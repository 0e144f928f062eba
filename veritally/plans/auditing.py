"""Queries on the audit of a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritally.functions.text import loose, normalize_value, parse_markup
from veritally.operators import audit, resample
from veritally.operators.containment import contained
from veritally.plans.bindings import CORPUS_SQL, SLOTS_SQL, corpus, examples, table
from veritally.storage import written



def _strict():
    return normalize_value(F.col("text"))


def _loose():
    return loose(F.col("text"))


def _label():
    return F.concat_ws("|", "intent", "label")


def split_sizes_rollup(spark, d):
    return audit.split_sizes(corpus(spark, d))


def label_coverage(spark, d):
    return audit.coverage(corpus(spark, d), "intent")


def scenario_histogram(spark, d):
    return corpus(spark, d).groupBy("split", "scenario").agg(F.count("*").alias("n"))


def slot_stats(spark, d):
    slots = F.size("slots")
    absent = F.size(F.filter("slots", lambda s: ~F.contains(F.col("text"), s["value"])))
    return examples(spark, d).groupBy("scenario").agg(F.count("*").alias("n"), F.sum(slots).alias("slots"), F.count_if(slots == 0).alias("without"), F.max(slots).cast("long").alias("most"), F.sum(absent).alias("not_in_text"))


def duplicates_within_train(spark, d):
    return audit.duplicate_groups(corpus(spark, d).where("split = 'train'"), _strict(), _label()).select("digest", "n", "first", "kind")


def duplicate_kinds(spark, d):
    return audit.duplicate_groups(corpus(spark, d).where("split = 'train'"), _strict(), _label()).groupBy("kind").agg(F.count("*").alias("groups"), F.sum("n").alias("rows"))


def _overlaps(spark, d, text):
    c = corpus(spark, d)
    one = audit.overlap(c, text, _label(), "train", "test")
    return one.union(audit.overlap(c, text, _label(), "train", "dev")).union(audit.overlap(c, text, _label(), "dev", "test"))


def overlap_strict(spark, d):
    return _overlaps(spark, d, _strict())


def overlap_loose(spark, d):
    return _overlaps(spark, d, _loose())


def shared_test_rows(spark, d):
    return audit.shared_rows(corpus(spark, d), _strict(), "train", "test").select("id", "intent")


def unseen_text_em(spark, d):
    """Labelled quality on test documents whose text isn't in train, with its interval, and how many were left out."""
    test = corpus(spark, d).where("split = 'test'")
    marks = table(spark, d, "labels").select("doc_id", "quality")
    rows = audit.unseen_rows(corpus(spark, d), _strict(), "train", "test").join(marks, "doc_id").select("doc_id", "quality")
    block = resample.interval(written(rows, "unseen"), [F.col("doc_id")], "mean", ["quality"], resample.RESAMPLES)
    everything = test.join(marks, "doc_id").agg(F.count("*").alias("_all"))
    return block.crossJoin(F.broadcast(everything)).select("n", F.round("value", 9).alias("exact_match"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), (F.col("_all") - F.col("n")).alias("excluded"))


def expected_vs_actual(spark, d):
    c = corpus(spark, d)
    actual = c.groupBy(F.concat(F.lit("rows_"), "split").alias("key")).agg(F.count("*").alias("value"))
    wanted = spark.createDataFrame([("rows_train", 11514), ("rows_dev", 100), ("rows_test", 100), ("rows_extra", 1)], "key string, value long")
    return audit.compare_expected(actual, wanted)


def integrity_counts(spark, d):
    """Markup whose plain text differs from the request, blank slots dropped, malformed rows."""
    line = table(spark, d, "lineitem")
    value = F.when(F.col("l_linenumber") == 7, F.lit(" ")).otherwise(F.col("l_returnflag"))
    text = F.concat(F.lit("ship "), value, F.lit(" by "), "l_linestatus")
    marked = F.concat(F.lit("ship [flag : "), value, F.when(F.col("l_linenumber") == 6, "").otherwise("]"), F.lit(" by "), "l_linestatus")
    p = line.select(text.alias("t"), parse_markup(marked).alias("p"))
    return p.agg(F.count("*").alias("n"), F.count_if(F.col("p.text") != F.col("t")).alias("text_differs"), F.sum("p.empty_dropped").alias("empty_dropped"), F.count_if("p.malformed").alias("malformed"))


def markup_parse(spark, d):
    line = table(spark, d, "lineitem")
    marked = F.concat_ws(" ", F.lit("send"), F.format_string("[quantity : %s]", F.col("l_quantity").cast("int").cast("string")), F.lit("of"), F.concat(F.lit("[flag : "), "l_returnflag", F.lit("]")), F.lit("at [time : 5 : 30]"))
    p = line.select("l_orderkey", "l_linenumber", parse_markup(marked).alias("p"))
    shown = F.array_join(F.transform("p.slots", lambda s: F.concat(s["type"], F.lit("="), s["value"])), ";")
    return p.select("l_orderkey", "l_linenumber", "p.text", shown.alias("slots"), "p.empty_dropped", "p.malformed")


def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(_strict()).alias("text_md5"), F.length(_strict()).cast("long").alias("n"))


def loose_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(_loose()).alias("text_md5"), F.length(_loose()).cast("long").alias("n"))


def leakage_guard(spark, d):
    """Ids that repeat, and rows outside train that an index must not hold."""
    c = corpus(spark, d)
    twice = c.groupBy("id").count().where("count > 1").agg(F.count("*").alias("repeated_ids"))
    return twice.crossJoin(F.broadcast(c.agg(F.count_if(F.col("split") != "train").alias("rows_not_train"))))


def benchmark_contamination(spark, d):
    """Documents that hold a benchmark text verbatim."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("pattern"))
    return contained(table(spark, d, "documents").select("doc_id", "text"), "doc_id", items, "item_id")


def source_mentions(spark, d):
    """How many texts hold the names of sources and languages, short patterns that many texts have."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    names = docs.select(F.explode(F.array("lang", "source")).alias("pattern")).distinct().select(F.xxhash64("pattern").alias("name_id"), "pattern")
    found = contained(docs, "doc_id", names, "name_id").groupBy("name_id").agg(F.count("*").alias("texts"))
    return names.join(found, "name_id").select(F.col("pattern").alias("name"), "texts")


QUERIES = {
    f.__name__: f
    for f in (split_sizes_rollup, label_coverage, scenario_histogram, slot_stats, duplicates_within_train, duplicate_kinds, overlap_strict, overlap_loose, shared_test_rows, unseen_text_em, expected_vs_actual, integrity_counts, markup_parse, normalize_text, loose_text, leakage_guard, benchmark_contamination, source_mentions)
}

_STRICT = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_LOOSE = "trim(regexp_replace(regexp_replace(lower(text), '[''’`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_C = f"WITH {CORPUS_SQL}"


def _overlap_sql(norm: str) -> str:
    one = "SELECT '{a}_{b}' AS pair, count(DISTINCT CASE WHEN split = '{b}' THEN norm END) AS shared_texts, count(*) FILTER (split = '{a}') AS rows_a, count(*) FILTER (split = '{b}') AS rows_b, count(*) FILTER (split = '{b}' AND EXISTS (SELECT 1 FROM c y WHERE y.split = '{a}' AND y.norm = x.norm AND y.k = x.k)) AS identical_labels FROM c x WHERE split IN ('{a}', '{b}') AND norm IN (SELECT norm FROM c WHERE split = '{a}' INTERSECT SELECT norm FROM c WHERE split = '{b}')"
    return f"{_C}, c AS (SELECT split, intent || '|' || label AS k, {norm} AS norm FROM corpus) " + " UNION ALL ".join(one.format(a=a, b=b) for a, b in (("train", "test"), ("train", "dev"), ("dev", "test")))


_DUP = f"{_C}, g AS (SELECT {_STRICT} AS norm, count(*) AS n, min(lpad(id, 20, '0')) AS first, count(DISTINCT intent) AS i, count(DISTINCT intent || '|' || label) AS l FROM corpus WHERE split = 'train' GROUP BY 1 HAVING count(*) > 1), k AS (SELECT *, CASE WHEN l = 1 THEN 'identical' WHEN i > 1 THEN 'intent conflict' ELSE 'slot conflict' END AS kind FROM g)"
ORACLE_SQL = {
    "split_sizes_rollup": f"{_C} SELECT split, count(*) AS n FROM corpus GROUP BY ROLLUP(split)",
    "label_coverage": f"{_C}, l AS (SELECT DISTINCT intent FROM corpus), s AS (SELECT DISTINCT split, intent FROM corpus), x AS (SELECT sp.split, l.intent, EXISTS (SELECT 1 FROM s WHERE s.split = sp.split AND s.intent = l.intent) AS has, EXISTS (SELECT 1 FROM s WHERE s.split = 'train' AND s.intent = l.intent) AS tr FROM l, (VALUES ('train'), ('dev'), ('test')) sp(split)) SELECT split, count(*) FILTER (has) AS n_labels, count(*) FILTER (NOT has) AS n_missing, count(*) FILTER (has AND NOT tr) AS n_not_in_train FROM x GROUP BY split",
    "scenario_histogram": f"{_C} SELECT split, scenario, count(*) AS n FROM corpus GROUP BY ALL",
    "slot_stats": f"WITH {SLOTS_SQL}, o AS (SELECT o_orderkey AS id, c_mktsegment AS scenario FROM orders JOIN customer ON c_custkey = o_custkey), s AS (SELECT o.id, scenario, count(gold.type) AS n, coalesce(sum(CASE WHEN contains(CAST(o.id AS VARCHAR), value) THEN 0 ELSE 1 END) FILTER (value IS NOT NULL), 0) AS a FROM o LEFT JOIN gold ON gold.id = o.id GROUP BY ALL) SELECT scenario, count(*) AS n, CAST(sum(n) AS BIGINT) AS slots, count(*) FILTER (n = 0) AS without, max(n) AS most, CAST(sum(a) AS BIGINT) AS not_in_text FROM s GROUP BY scenario",
    "duplicates_within_train": f"{_DUP} SELECT sha256(norm) AS digest, n, first, kind FROM k",
    "duplicate_kinds": f"{_DUP} SELECT kind, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM k GROUP BY kind",
    "overlap_strict": _overlap_sql(_STRICT),
    "overlap_loose": _overlap_sql(_LOOSE),
    "shared_test_rows": f"{_C} SELECT id, intent FROM corpus WHERE split = 'test' AND {_STRICT} IN (SELECT {_STRICT} FROM corpus WHERE split = 'train')",
    "unseen_text_em": f"""{_C}, t AS (SELECT doc_id, quality, {_STRICT} IN (SELECT {_STRICT} FROM corpus WHERE split = 'train') AS seen FROM corpus JOIN labels USING (doc_id) WHERE split = 'test'),
l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, quality FROM t WHERE NOT seen), {resample.resampled_sql("l", ["quality"], resample.RESAMPLES)}
SELECT count(*) FILTER (NOT seen) AS n, round(avg(quality) FILTER (NOT seen), 9) AS exact_match, (SELECT round(quantile_cont(quality / w, 0.025), 9) FROM s) AS low, (SELECT round(quantile_cont(quality / w, 0.975), 9) FROM s) AS high, count(*) FILTER (seen) AS excluded FROM t""",
    "expected_vs_actual": f"{_C}, a AS (SELECT 'rows_' || split AS key, count(*) AS actual FROM corpus GROUP BY ALL), e AS (SELECT * FROM (VALUES ('rows_train', 11514::BIGINT), ('rows_dev', 100), ('rows_test', 100), ('rows_extra', 1)) t(key, expected)) SELECT key, expected, actual, key || ': expected ' || coalesce(CAST(expected AS VARCHAR), 'nothing') || ', got ' || coalesce(CAST(actual AS VARCHAR), 'nothing') AS note FROM a FULL JOIN e USING (key) WHERE expected IS DISTINCT FROM actual",
    "integrity_counts": "SELECT count(*) AS n, count(*) FILTER (l_linenumber = 6) AS text_differs, CAST(count(*) FILTER (l_linenumber = 7) AS BIGINT) AS empty_dropped, count(*) FILTER (l_linenumber = 6) AS malformed FROM lineitem",
    "markup_parse": "SELECT l_orderkey, l_linenumber, 'send ' || CAST(l_quantity AS INT) || ' of ' || l_returnflag || ' at 5 : 30' AS text, 'quantity=' || CAST(l_quantity AS INT) || ';flag=' || l_returnflag || ';time=5 : 30' AS slots, 0::BIGINT AS empty_dropped, false AS malformed FROM lineitem",
    "normalize_text": f"SELECT doc_id, md5({_STRICT}) AS text_md5, length({_STRICT}) AS n FROM documents",
    "loose_text": f"SELECT doc_id, md5({_LOOSE}) AS text_md5, length({_LOOSE}) AS n FROM documents",
    "leakage_guard": f"{_C} SELECT (SELECT count(*) FROM (SELECT id FROM corpus GROUP BY id HAVING count(*) > 1)) AS repeated_ids, count(*) FILTER (split <> 'train') AS rows_not_train FROM corpus",
    "source_mentions": "WITH n AS (SELECT DISTINCT unnest([lang, source]) AS name FROM documents) SELECT name, count(*) AS texts FROM n JOIN documents ON contains(text, name) GROUP BY name",
    "benchmark_contamination": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
}
