"""URL filters: rules by host and path, and gradient-boosted trees on lexical features.

Method
  1. *Rules.* The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path follows up to ``?``, ``#`` or the end. A rule (host, path)
     fits its host and all subdomains if the path starts with the rule's; the longest rule that fits gives the verdict.
  2. *Features.* Lengths of url, host and path in bytes, depth, digit ratio, digits in the host, entropy of the bytes, number of parameters, hyphens, dots, the longest run of consonants in the host,
     and statistics of the host's last label, of its last two, and of the path's first step: share of bad urls (smoothed) and count among the labelled ones.
  3. *Trees.* Binary log-loss gradient boosting with depth-limited trees on binned features, fitted on labelled urls; a score above 0 means block.

The labelled urls are a bounded sample: at most ``LABELLED`` rows, the smallest by hash. If none are given, the pages that a rule decides are the labelled ones (distant supervision), and the trees judge
the others in their likeness. Without labelled urls, or with labels of one kind only, the score is constant. A url that a rule decides has no score.
A null url, or one without ``://``, has empty host and path, fits no rule and is judged by its features (of the empty url if null). An empty table gives an empty result. Repeated rows get equal
verdicts; extra columns are ignored.
Invalid UTF-8 is read with replacement characters where the trees count suffixes and words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import lean, strings
from veritally.llm.words import text_buffers

# The rules of the production query (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LABELLED = 20_000
ROUNDS, DEPTH, RATE, BINS, LEAF = 60, 3, 0.2, 32, 20


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null (of equally long ones the last in ``rules``)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: What is taken from a url on the JVM: its parts and the keys of its statistics.
PARTS = ("host", "path", "query", "last", "last_two", "step")
_CONSONANT = np.isin(np.arange(256), list(b"bcdfghjklmnpqrstvwxz"))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))


def parts_of(url: Column) -> list[Column]:
    """The columns of `PARTS` for a url."""
    host, path = host_of(url), path_of(url)
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    found = (host, path, query, F.regexp_extract(host, r"([^.]*)$", 1), F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1), F.regexp_extract(path, r"(?s)^/?([^/]*)", 1))
    return [c.alias(n) for n, c in zip(PARTS, found, strict=True)]


def _count(raw: np.ndarray, off: np.ndarray, which: np.ndarray) -> np.ndarray:
    """How many bytes of each row are among ``which`` (a table of 256)."""
    return np.diff(np.concatenate([[0], np.cumsum(which[raw])])[off])


def _one(char: str) -> np.ndarray:
    return np.arange(256) == ord(char)


def _entropy(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros(len(off) - 1)
    for a in range(0, len(out), 1024):
        o = off[a : a + 1025]
        rows = np.repeat(np.arange(len(o) - 1), np.diff(o))
        n = np.bincount(rows * 256 + raw[o[0] : o[-1]], minlength=256 * (len(o) - 1)).reshape(-1, 256)
        p = n / np.maximum(1, n.sum(axis=1, keepdims=True))
        out[a : a + 1024] = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    return out


def _longest(raw: np.ndarray, off: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The longest run of bytes among ``which`` in each row."""
    rows = np.arange(len(off) - 1)
    inside = np.zeros(len(raw) + len(rows) + 1, np.bool_)  # something else between the rows
    owner = np.repeat(rows, np.diff(off))
    inside[np.arange(len(raw)) + owner + 1] = which[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    out = np.zeros(len(rows), np.int64)
    np.maximum.at(out, np.searchsorted(off + np.arange(len(off)), edge[0::2], "right") - 1, edge[1::2] - edge[0::2])
    return out


def features(batch, stats: list[dict[str, tuple[float, float]]]) -> np.ndarray:
    """A row of numbers per url of a batch with ``url`` and `PARTS`."""
    buffers = {c: text_buffers(batch.column(c)) for c in ("url", "host", "path", "query")}
    size = lambda c: np.diff(buffers[c][1])
    url, host, query = buffers["url"], buffers["host"], buffers["query"]
    columns = [
        size("url"), size("host"), size("path"), _count(*buffers["path"], _one("/")), _count(*url, _DIGIT) / np.maximum(1, size("url")), _count(*host, _DIGIT), _entropy(*url),
        _count(*query, _one("=") | _one("&")), _count(*host, _one("-")), _count(*host, _one(".")), _longest(*host, _CONSONANT),
    ]
    for key, known in zip(PARTS[3:], stats, strict=True):
        found = np.array([known.get(k, known[""]) for k in strings(batch.column(key))], float).reshape(-1, 2)
        columns += [found[:, 0], found[:, 1]]
    return np.stack(columns, axis=1).astype(float)


@dataclass(frozen=True)
class Trees:
    """Boosted trees: per tree arrays (feature, cut, value) in heap order; a node goes right if the feature is above the cut."""

    base: float
    nodes: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]
    stats: list[dict[str, tuple[float, float]]]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            out += value[at]
        return out


def fit(rows: pa.Table) -> Trees:
    """Gradient boosting on labelled urls: ``url``, `PARTS` and ``label`` (1 for bad)."""
    y = rows.column("label").to_numpy().astype(float)
    prior = float(y.mean()) if len(y) else 0.5
    stats = []
    for key in PARTS[3:]:
        names, inverse = np.unique(np.array(strings(rows.column(key)), dtype=object).astype(str), return_inverse=True)
        bad, n = np.bincount(inverse, y, len(names)), np.bincount(inverse, minlength=len(names))
        stats.append({"": (prior, 0.0)} | {k: ((b + 20 * prior) / (m + 20), math.log1p(m)) for k, b, m in zip(names.tolist(), bad.tolist(), n.tolist(), strict=True) if k})
    base = math.log((prior + 1e-6) / (1 - prior + 1e-6))
    if not len(y) or not 0 < prior < 1:
        return Trees(base, (), stats)
    x = features(rows, stats)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    f, nodes = np.full(len(y), base), []
    inner, total = 2**DEPTH - 1, 2 ** (DEPTH + 1) - 1
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.zeros(total, np.int64), np.full(total, np.inf), np.zeros(total)
        at = np.zeros(len(y), np.int64)
        for node in range(total):
            mine = at == node
            gs, hs = g[mine].sum(), h[mine].sum()
            value[node] = RATE * gs / (hs + 1.0)
            if node >= inner:
                continue
            best = (1e-9, -1, 0)
            for j, c in enumerate(cuts):
                gb, hb, nb = (np.bincount(binned[mine, j], w, len(c) + 1).cumsum()[:-1] for w in (g[mine], h[mine], np.ones(mine.sum())))
                gain = gb**2 / (hb + 1) + (gs - gb) ** 2 / (hs - hb + 1) - gs**2 / (hs + 1)
                gain[(nb < LEAF) | (mine.sum() - nb < LEAF)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
            _, j, b = best
            if j >= 0:
                feature[node], cut[node] = j, cuts[j][b]
            at[mine] = 2 * node + 1 + (x[mine, feature[node]] > cut[node])
        nodes.append((feature, cut, value))
        f += value[at]
    return Trees(base, tuple(nodes), stats)


def _judge(trees: Trees):
    def run(batches):
        for batch in batches:
            score = np.full(len(batch), np.nan)
            open_ = ~batch.column("decided").to_numpy(zero_copy_only=False)
            if open_.any():
                score[open_] = trees.score(features(batch.filter(pa.array(open_)), trees.stats))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), batch.column("path"), batch.column("rule"), pa.array(score, mask=~open_), batch.column("ruled")], names=_JUDGED)

    return run


_JUDGED = ["page_id", "url", "host", "path", "rule", "score", "ruled"]


def ruled_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, `PARTS`, rule, ruled, decided): what the rules say, ``ruled`` being their verdict."""
    split = pages.select("page_id", "url", *parts_of(F.col("url"))).withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    return split.select("page_id", "url", *PARTS, F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("ruled"), F.col("_r").isNotNull().alias("decided"))


def sample(labelled: DataFrame) -> pa.Table:
    """At most ``LABELLED`` of the rows (url, label), with their parts."""
    some = labelled.where("url IS NOT NULL AND label IN (0, 1)").orderBy(F.xxhash64("url"), "url", "label").limit(LABELLED)
    return some.select("url", *parts_of(F.col("url")), F.col("label").cast("int").alias("label")).toArrow()


def url_filter(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, score, verdict): a row per row of ``pages`` (page_id long, url string); ``labelled`` has url, label (1: bad)."""
    ruled = ruled_pages(pages, rules)
    if labelled is None:
        labelled = ruled.where("decided").select("url", (F.col("ruled") == "block").cast("int").alias("label"))
    schema = "page_id long, url string, host string, path string, rule string, score double, ruled string"
    judged = ruled.mapInArrow(lean(_judge(fit(sample(labelled)))), schema)
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "url", "host", "path", "rule", "score", verdict.alias("verdict"))


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))
