"""Queries on statistics, sampling and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritally.functions.stats import disagreement, verdict
from veritally.operators import neighbours, resample, retrieval, sampling, subsets
from veritally.operators.scoring import item_scores
from veritally.plans.bindings import CORPUS_SQL, SLOTS_SQL, answered, corpus, table

RESAMPLES = resample.RESAMPLES
PLAN = [("D100", 100), ("D50", 50)]


def _labels(spark, d):
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))


def _order():
    return [F.col("doc_id")]


def _rounded(df):
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def summary_with_ci(spark, d):
    return _rounded(resample.interval(_labels(spark, d), _order(), "mean", ["a"], RESAMPLES))


def ratio_with_ci(spark, d):
    return _rounded(resample.interval(_labels(spark, d), _order(), "ratio", ["a", "b"], RESAMPLES))


def _scored(spark, d):
    return item_scores(answered(spark, d)).select("system", "id", "tp", "fp", "fn")


def precision_with_ci(spark, d):
    return _rounded(resample.interval(_scored(spark, d), [F.col("system"), F.col("id")], "precision", ["tp", "fp"], 1000, by=["system"]))


def recall_with_ci(spark, d):
    return _rounded(resample.interval(_scored(spark, d), [F.col("system"), F.col("id")], "recall", ["tp", "fn"], 1000, by=["system"]))


def f1_with_ci(spark, d):
    return _rounded(resample.interval(_scored(spark, d), [F.col("system"), F.col("id")], "f1", ["tp", "fp", "fn"], 1000, by=["system"]))


def paired_bootstrap_labels(spark, d):
    p = resample.paired(_labels(spark, d), _order(), "a", "b", RESAMPLES)
    return _rounded(p.drop("mcnemar_p"))


def mcnemar_exact(spark, d):
    p = resample.paired(_labels(spark, d), _order(), "a", "b", RESAMPLES)
    return p.select("n", "a_only", "b_only", F.round("mcnemar_p", 9).alias("p"), verdict(F.col("low"), F.col("high")).alias("verdict"), disagreement(F.col("low"), F.col("high"), F.col("mcnemar_p")).alias("disagree"))


def numpy_bootstrap(spark, d):
    return _rounded(resample.numpy_interval(_labels(spark, d), _order(), "a"))


def _picks(spark, d):
    sizes = table(spark, d, "documents").groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("n"))
    return sampling.nested_plan(sizes, PLAN)


def allocate_subsets(spark, d):
    return _picks(spark, d).withColumnRenamed("stratum", "lang")


def nested_subset_prefix(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id")
    return sampling.nested_subsets(docs, "lang", "doc_id", _picks(spark, d))


def subset_hash(spark, d):
    """Order-free hashes of the ids of two splits."""
    return subsets.tree_hash(corpus(spark, d).where("split <> 'train'").select("split", "id"), ["split"])


def cycled_prompts(spark, d):
    items = table(spark, d, "benchmark").select("item_id")
    return sampling.cycle(items, F.md5(F.concat(F.lit("7:"), F.col("item_id").cast("string"))), 100)


def topk_cosine(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    index = retrieval.guarded_index(e, F.lit("train"), "vec_id").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.topk(queries, index, 10, digits=6).select("q", "id", "score", "rank")


def topk_by_cells(spark, d):
    """The same by the metric index."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    queries = e.where("id % 100 = 0").select(F.col("id").alias("q"), "v")
    return neighbours.Neighbours(e).topk(queries, 10, digits=6)[0].select("q", "id", "score", "rank")


def bag_embeddings(spark, d):
    b = table(spark, d, "benchmark").select("item_id", retrieval.hashed_bag(F.col("text")).alias("v"))
    return b.select("item_id", F.posexplode("v").alias("cell", "x")).where("x > 0").select("item_id", "cell", F.round("x", 9).alias("x"))


def vector_cache_key(spark, d):
    """The key under which the vectors of all documents and their texts are kept."""
    lines = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.md5("text")).alias("id"))
    return subsets.tree_hash(lines).select("n", F.sha2(F.concat(F.lit("test\n"), "hash"), 256).alias("key"))


QUERIES = {f.__name__: f for f in (summary_with_ci, ratio_with_ci, precision_with_ci, recall_with_ci, f1_with_ci, paired_bootstrap_labels, mcnemar_exact, numpy_bootstrap, allocate_subsets, nested_subset_prefix, subset_hash, cycled_prompts, topk_cosine, topk_by_cells, bag_embeddings, vector_cache_key)}

_DRAW = f"""WITH l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, quality AS a, 1 - toxic AS b FROM labels), {resample.resampled_sql("l", ["a", "b"], RESAMPLES)},
t AS (SELECT count(*) AS n, count(*) FILTER (a = 1 AND b = 0) AS a_only, count(*) FILTER (b = 1 AND a = 0) AS b_only, avg(a) - avg(b) AS difference, avg(a) AS ma, sum(a) / sum(b) AS rt FROM l),
c AS (SELECT quantile_cont((a - b) / w, 0.025) AS low, quantile_cont((a - b) / w, 0.975) AS high, least(1.0, 2.0 * (least(count(*) FILTER (a - b <= 0), count(*) FILTER (a - b >= 0)) + 1) / {RESAMPLES + 1}) AS bootstrap_p FROM s)"""


def _scores_sql(value: str, cols: list[str]) -> str:
    """Intervals per system; ``value`` is a formula of summed columns."""
    summed = f"SELECT system, count(*) AS n, {', '.join(f'sum({c}) AS {c}' for c in cols)} FROM l GROUP BY system"
    return f"""WITH {SLOTS_SQL}, l AS (SELECT row_number() OVER (ORDER BY system, id) - 1 AS pos, system, {", ".join(cols)} FROM scored), {resample.resampled_sql("l", cols, 1000, ("system",))},
q AS (SELECT system, quantile_cont({value}, 0.025) AS low, quantile_cont({value}, 0.975) AS high FROM s GROUP BY system), t AS ({summed})
SELECT system, n, round({value}, 9) AS value, round(low, 9) AS low, round(high, 9) AS high FROM t JOIN q USING (system)"""


_MC = "least(1.0, 2 * (SELECT sum(exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2))) FROM range(least(a_only, b_only) + 1) k(i)))"

def _tree_sql(by: str) -> str:
    """``h`` (by, n, hash) of sets ``o`` (by, id) of up to LEAF * LEAF ids."""
    return f"""r AS (SELECT {by}, id, (row_number() OVER (PARTITION BY {by} ORDER BY id) - 1) // {subsets.LEAF} AS k FROM o), f AS (SELECT {by}, k, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS f FROM r GROUP BY ALL),
h AS (SELECT {by}, CAST(sum(n) AS BIGINT) AS n, CASE WHEN count(*) = 1 THEN any_value(f) ELSE sha256(string_agg(f, chr(10) ORDER BY k)) END AS hash FROM f GROUP BY {by})"""


def _alloc_sql(name: str, total: int, sizes: str) -> str:
    """Recursive CTEs ``{name}_r`` and ``{name}`` (p, the picks as a list): one pick is moved a step, until ``total`` are picked. ``sizes`` yields k and n, the list of sizes."""
    more = "list_transform(range(1, k + 1), lambda i: CASE WHEN p[i] < n[i] THEN ideal[i] - p[i] ELSE -1e300 END)"
    less = "list_transform(range(1, k + 1), lambda i: CASE WHEN p[i] > low[i] THEN p[i] - ideal[i] ELSE -1e300 END)"
    chosen = f"CASE WHEN list_sum(p) < {total} THEN list_position({more}, list_max({more})) ELSE k + 1 - list_position(list_reverse({less}), list_max({less})) END"
    return f"""{name}_s AS (SELECT k, n, list_transform(n, lambda x: {total}::DOUBLE * x / list_sum(n)) AS ideal, list_transform(n, lambda x: least(least({sampling.FLOOR}, {total} // k), x)) AS low FROM ({sizes})),
{name}_r AS (SELECT *, list_transform(range(1, k + 1), lambda i: CAST(least(n[i], greatest(low[i], floor(ideal[i]))) AS BIGINT)) AS p FROM {name}_s
  UNION ALL SELECT k, n, ideal, low, list_transform(range(1, k + 1), lambda i: p[i] + CASE WHEN i = c THEN d ELSE 0 END) FROM (SELECT *, {chosen} AS c, CAST(sign({total} - list_sum(p)) AS BIGINT) AS d FROM {name}_r WHERE list_sum(p) <> {total})),
{name} AS (SELECT k, p FROM {name}_r WHERE list_sum(p) = {total})"""


_ALLOC = f"""WITH RECURSIVE n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), l AS (SELECT list(lang ORDER BY lang) AS langs, list(n ORDER BY lang) AS n, count(*) AS k FROM n),
{_alloc_sql('d100', 100, 'SELECT k, n FROM l')}, {_alloc_sql('d50', 50, 'SELECT k, p AS n FROM d100')},
p AS (SELECT 'D100' AS subset, unnest(langs) AS lang, unnest(p) AS picks FROM l, d100 UNION ALL SELECT 'D50', unnest(langs), unnest(p) FROM l, d50)"""
_TOPK = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT a.vec_id AS q, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM v a, v b WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10"
ORACLE_SQL = {
    "summary_with_ci": f"{_DRAW} SELECT n, round(t.ma, 9) AS value, (SELECT round(quantile_cont(a / w, 0.025), 9) FROM s) AS low, (SELECT round(quantile_cont(a / w, 0.975), 9) FROM s) AS high FROM t",
    "ratio_with_ci": f"{_DRAW} SELECT n, round(t.rt, 9) AS value, (SELECT round(quantile_cont(a / b, 0.025), 9) FROM s) AS low, (SELECT round(quantile_cont(a / b, 0.975), 9) FROM s) AS high FROM t",
    "precision_with_ci": _scores_sql("tp / (tp + fp)", ["tp", "fp"]),
    "recall_with_ci": _scores_sql("tp / (tp + fn)", ["tp", "fn"]),
    "f1_with_ci": _scores_sql("2 * tp / (2 * tp + fp + fn)", ["tp", "fp", "fn"]),
    "paired_bootstrap_labels": f"{_DRAW} SELECT n, round(difference, 9) AS difference, a_only, b_only, round(low, 9) AS low, round(high, 9) AS high, round(bootstrap_p, 9)::DOUBLE AS bootstrap_p FROM t, c",
    "mcnemar_exact": f"{_DRAW} SELECT n, a_only, b_only, round({_MC}, 9) AS p, CASE WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'no difference shown' END AS verdict, (low > 0 OR high < 0) <> ({_MC} < 0.05) AS disagree FROM t, c",
    "allocate_subsets": f"{_ALLOC} SELECT * FROM p",
    "nested_subset_prefix": f"{_ALLOC}, o AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('{sampling.SEED}:' || lang || ':' || doc_id), doc_id) AS place FROM documents) SELECT subset, lang, doc_id FROM o JOIN p USING (lang) WHERE place <= picks",
    "subset_hash": f"WITH {CORPUS_SQL}, o AS (SELECT DISTINCT split, id FROM corpus WHERE split <> 'train'), {_tree_sql('split')} SELECT * FROM h",
    "cycled_prompts": "WITH o AS (SELECT item_id, row_number() OVER (ORDER BY md5('7:' || item_id)) - 1 AS p, count(*) OVER () AS n FROM benchmark) SELECT r.i AS request, item_id FROM range(100) r(i) JOIN o ON r.i % o.n = o.p",
    "topk_cosine": _TOPK,
    "topk_by_cells": _TOPK,
    "bag_embeddings": "WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS w FROM benchmark), c AS (SELECT item_id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS INTEGER) AS cell, count(*) AS n FROM w GROUP BY ALL) SELECT item_id, cell, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 9) AS x FROM c",
    "vector_cache_key": f"WITH o AS (SELECT DISTINCT 0 AS g, doc_id || chr(9) || md5(text) AS id FROM documents), {_tree_sql('g')} SELECT n, sha256('test' || chr(10) || hash) AS key FROM h",
}
