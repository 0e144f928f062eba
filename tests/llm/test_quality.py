import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash

from veritally.llm import quality as Q
from veritally.llm.quality import keep_good, kth_largest, quality_filter


def data():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["on", "the", "er", "at", "is", "re"]) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(600):
        good = i % 5 > 0
        n = rng.randint(5, 60)
        text = " ".join(word() for _ in range(n)) if good else " ".join((word() + rng.choice(["###", "%%%", "!!"])) if i % 2 else "same" for _ in range(n))
        rows.append((i, text, "s"))
        if i % 3 == 0:
            labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = data()
    got = {r["doc_id"]: r["kept"] for r in quality_filter(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    held = [i for i, _, _ in rows if i % 3]
    right = sum(got[i] == (i % 5 > 0) for i in held)
    assert right >= 0.97 * len(held)


def test_keep_good_is_the_filter_with_all_columns(spark, docs):
    rows, labels = data()
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "  \n", None)]
    l = spark.createDataFrame(labels, "doc_id long, quality int")
    d = docs(rows)
    kept = keep_good(d, l)
    assert kept.columns == d.columns
    want = sorted(r["doc_id"] for r in quality_filter(d, l).where("kept").collect())
    assert sorted(r["doc_id"] for r in kept.collect()) == want and not {1000, 1001, 1002} & set(want)
    assert kept.where("_noise = 0.5").count() == len(want)


def test_without_labels_and_empty(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: (r["log_weight"], r["kept"]) for r in quality_filter(docs([(1, "a text", "s"), (2, None, "s"), (3, "a text", "s")]), none).collect()}
    assert got == {1: (0.0, True), 2: (None, False), 3: (0.0, True)}
    assert quality_filter(docs([]), none).count() == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=500), rng.normal(size=200) * 1e-9, [5.0] * 40, [1e12]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for k in (1, 2, 30, 41, 42, 300, len(x) - 1):
        assert kth_largest(df, "x", k) == np.sort(x)[-k]


def gram_cells(text):
    """Cells of a text's 4-grams of character shapes and of its words, gram by gram."""
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    if not words:
        return []
    shape = lambda b: ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else ord("a") if 97 <= b <= 122 or b >= 128 else b
    padded = [32, *map(shape, raw), 32, 32]
    out = []
    for i in range(len(padded) - 3):
        h = padded[i]
        for j in (1, 2, 3):
            h = (h * 0x01000193 + padded[i + j]) & 0xFFFFFFFF
        out.append(((h ^ (h >> 15)) * 0x9E3779B1 & 0xFFFFFFFF) >> 18)
    low = [w.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) for w in words]
    return out + [Q.BUCKETS + (i > 0 and low[i] == low[i - 1]) for i in range(len(low))]


def noise(doc_id, seed):
    """Gumbel noise of a document, from the hash's definition."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), xxhash.xxh64_intdigest(struct.pack("<i", seed), 42))
    h -= (h >> 63) << 64
    return -math.log(-math.log((h % (1 << 52) + 0.5) / (1 << 52)))


def test_models_weights_and_sample_against_a_plain_second_version(spark, docs):
    rng = random.Random(4)
    rows, labels = data()
    rows = rows[:300] + [(5000, None, "s"), (5001, " \t", "s"), (5002, "Same same SAME é ü 12 3", None), (5003, "x" * 3000, "s")]
    labels = [(i, q if rng.random() < 0.9 else 1 - q) for i, q in labels if i < 300]
    cells = {i: gram_cells(t) for i, t, _ in rows}
    good = {i for i, q in labels if q == 1}
    raw, target = Counter(), Counter()
    for i, c in cells.items():
        raw.update(c)
        if i in good:
            target.update(c)
    ratio = {}
    for part in (range(Q.BUCKETS), range(Q.BUCKETS, Q.BUCKETS + 2)):
        n, m = sum(raw[c] for c in part), sum(target[c] for c in part)
        prior = max(1.0, Q.PRIOR * m)
        for c in part:
            p = (raw[c] + 0.01) / (n + 0.01 * len(part))
            ratio[c] = math.log((target[c] + prior * p) / (m + prior) / p)
    weight = {i: sum(ratio[x] for x in c) if c else None for i, c in cells.items()}
    # the cutoff: of all places between two labelled weights, the first with the best balanced accuracy
    marked = sorted((weight[i], q) for i, q in labels if weight[i] is not None)
    n_good, n_bad = sum(q for _, q in marked), sum(1 - q for _, q in marked)
    best, cut = -9.0, None
    for k in range(len(marked)):
        balanced = sum(1 - q for _, q in marked[: k + 1]) / n_bad - sum(q for _, q in marked[: k + 1]) / n_good
        if balanced > best + 1e-12:
            best, cut = balanced, (marked[k][0] + marked[k + 1][0]) / 2 if k + 1 < len(marked) else marked[k][0]
    k = sum(w is not None and w > cut for w in weight.values())
    key = {i: w + noise(i, 23) for i, w in weight.items() if w is not None}
    chosen = set(sorted(key, key=lambda i: -key[i])[:k])
    got = {r["doc_id"]: r for r in quality_filter(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == len(rows) and 0 < k < len(key)
    for i, w in weight.items():
        assert got[i]["log_weight"] == (None if w is None else pytest.approx(w, abs=1e-7))
        assert got[i]["key"] == (None if w is None else pytest.approx(key[i], abs=1e-7))
    assert {i for i, r in got.items() if r["kept"]} == chosen
