import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veritally.llm import spelling as S


def brute(rows, ratio=10):
    """By the definition, with Python's sets."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return grouped({w: n for w, n in count.items() if len(w) >= 7 and n >= 2}, ratio)


def grouped(words, ratio=10):
    letters = sorted(set("".join(words)))
    form, out = {}, {}
    for w, n in words.items():
        near = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near = sorted((near & set(words)) - {w}, key=lambda x: (-words[x], x.encode()))
        form[w] = near[0] if near and words[near[0]] >= ratio * n else None
        out[w] = n, len(near), form[w], words.get(form[w])
    root = lambda w: root(form[w]) if form[w] else w
    return {(w, *x, root(w)) for w, x in out.items()}


COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def got(df):
    return {tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()}


def test_query(spark, docs, tmp_path):
    rng = random.Random(5)
    words = ["spelling", "spellings", "spieling", "Ünderway", "ünderway", "naïvetéé", "naivetéé", "aaaaaaaa", "aaaaaaa", "straßenbahn", "short", "×÷×÷×÷×"]
    noise = lambda w: w[: (k := rng.randrange(len(w)))] + rng.choice(["", "x", "é", "a", w[k] * 2]) + w[k + 1 :]
    rows = [(i, " ".join(noise(w) if rng.random() < 0.2 else w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, range(1, 13), k=300))) for i in range(40)]
    rows += [(None, "spelling2spelling, spelling"), (100, None), (101, ""), (102, "spelling " * 50_000), (5, rows[5][1]), (5, rows[5][1])]
    docs([(i, t, "s") for i, t in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    df = S.op11_spelling_variants(spark, str(tmp_path))
    assert got(df) == brute(rows) and df.count() == len({r.word for r in df.collect()})
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    docs([]).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert S.op11_spelling_variants(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("per_sieve", [16_000_000, 7])
def test_all_neighbours_whatever_the_fields(spark, monkeypatch, per_sieve):
    """Dense vocabularies of few letters, one field or many: every pair at distance one and no other, ties by code point, chains to their ends."""
    monkeypatch.setattr(S, "SIEVE_WORDS", per_sieve)
    rng = random.Random(8)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 4))): rng.choice([1, 1, 10, 100, 1000, 10_000]) for _ in range(40)}
    words |= {"cccccccc" + "d" * k: 10**k for k in range(12)}
    df = S.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert got(df) == grouped(words)


def test_edits_are_distinct():
    import numpy as np

    field = np.full(S.SIEVE_BITS // 8, 255, np.uint8)
    letters = np.frombuffer(b"abc\xe9", np.uint8)
    for word in (b"a", b"aa", b"abba", b"\xe9\xe9b\xe9", b"cabbage"):
        codes = np.frombuffer(word, np.uint8).reshape(1, -1)
        new = [x.tobytes() for _, m in S.neighbourhood(codes, letters, field) for x in m]
        n = len(word)
        every = {word[:i] + word[i + 1 :] for i in range(n)} | {word[:i] + bytes([c]) + word[i + d :] for i in range(n + 1) for c in letters for d in (0, 1) if i + d <= n}
        assert sorted(new) == sorted(every - {word})
        hashes = {S._hashes(np.frombuffer(x, np.uint8).reshape(1, -1))[0] for x in new if x}
        assert len(hashes) == len([x for x in new if x])


def test_misspelt(spark):
    rows = [(i, w) for i in range(200) for w in ("spelling", "übergröße", "aaaaaaaa")]
    df = spark.createDataFrame(rows, "i long, w string").select("i", "w", S.misspelt(F.col("w"), F.col("i")).alias("m"))
    for i, w, m in df.collect():
        h = zlib.crc32(f"{i}:{w}".encode())
        assert m == (w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :])
