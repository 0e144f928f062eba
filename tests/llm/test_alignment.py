import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from veritally.llm import alignment as X

PARTS = ["word", " the", " ", "  ", "\n", "\n\n ", "\t", "é", "über ", "中文", "日本 ", "!", "?!\"", "'ll", "don't", "12345", " 3.14", "<s>", "</s>", "<|endoftext|>", "\xa0", "　", " ", "\x1c", "\x85", "\x00", "🙂", "é", "ſ", "ﬁ", "​", "\r\n", "\x0b", "ø.", "aaaa", "=====", "ǅ", "﻿", "<0x41>"]


@pytest.fixture(scope="module")
def plain():
    """Both libraries as they are: texts to (ids of A, their bytes, ids of B, their bytes)."""
    a, b = Tokenizer.from_file(X.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=X.PIECE_BPE)
    a.encode_special_tokens = True
    letters = X.byte_alphabet()
    names = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}

    def encode(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return x, [names[i] for i in x], y, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]

    return encode


def brute(plain, rows):
    """Offsets of both sides, groups where both end, and links by overlap."""
    out, links = [], []
    for doc_id, text in rows:
        a, ab, b, bb = plain(text) if text else ([], [], [], [])
        if not text or b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            out.append((doc_id, 0, 0, 0, ""))
            links.append([])
            continue
        ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 200 else list(__import__("itertools").accumulate(map(len, parts)))
        ea, eb = ends(ab), ends(bb)
        said, i, j = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            k, m = ea.index(cut, i) + 1, eb.index(cut, j) + 1
            said.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
            i, j = k, m
        mine, j = [], 0
        for i, (x, y) in enumerate(zip([0, *ea], ea, strict=False)):
            while j and eb[j - 1] > x:
                j -= 1
            while j < len(b) and (eb[j - 1] if j else 0) < y:
                if eb[j] > x:
                    mine.append((a[i], b[j]))
                j += 1
        out.append((doc_id, len(a), len(b), len(said), hashlib.sha256(";".join(said).encode()).hexdigest()))
        links.append(mine)
    count = Counter(x for mine in links for x in mine)
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(((*r[:4], len(mine), sum(count[x] == most[x[1]] for x in mine), sum(count[x] for x in mine), r[4]) for r, mine in zip(out, links, strict=True)), key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def texts(seed, n, k=40):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(1, k))) for _ in range(n)]


@pytest.mark.parametrize("heavy", [1_000_000, 40])
def test_query(spark, docs, tmp_path, plain, monkeypatch, heavy):
    """All pairs sent to the tasks, or a few of them and the others by a shuffle."""
    monkeypatch.setattr(X, "HEAVY", heavy)
    rows = [*enumerate(texts(2, 150)), (200, None), (201, ""), (202, " "), (203, "a▁b"), (204, "long text, " * 20_000), (None, "no id"), (7, "again"), (7, "again"), (205, " the"), (206, "x" * 3000 + " " * 2000)]
    docs([(i, t, "s") for i, t in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in X.op12_cross_tokenizer_alignment(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(plain, rows)


def test_stretches_equal_whole_texts(plain):
    """Cutting, the fast encoder and what is remembered change nothing."""
    aligner = X.Aligner(X._file(X.BYTE_BPE), X._file(X.PIECE_BPE))
    assert aligner.b.splits and aligner.a.fast
    for text in [*texts(3, 3000, 12), *texts(4, 200, 200), *(chr(c) + chr(d) for c in range(0x250) for d in (32, 97, c)), *(chr(c) + "a " + chr(c) for c in range(0x2000, 0x2070))]:
        a, ab, b, bb = plain(text)
        got = aligner.align(text)
        if b"".join(ab) == b"".join(bb) == (" " + text).encode():
            ids = [[[int(x) for x in side.split(",")] for side in group.split("|")] for group in got[3].split(";")]
            assert [x for g in ids for x in g[0]] == a and [x for g in ids for x in g[1]] == b, repr(text)
            assert len(got[4]) // 8 == got[0] + got[1] - got[2]
        else:
            assert got is None


def test_transducer():
    a, b = {1: b"ab", 2: b"c", 3: b"a", 4: b"bc"}, {1: b"a", 2: b"bc", 3: b"abc", 4: b"x"}
    t = X.Transducer(a, b)
    assert t.align([1, 2, 3, 4], [1, 2, 3]) == ([(0, 2, 0, 2), (2, 4, 2, 3)], [(1, 1), (1, 2), (2, 2), (3, 3), (4, 3)])
    assert t.align([], []) == ([], [])
    with pytest.raises(ValueError):
        t.align([1], [4])


def test_unusual_rows(spark, docs):
    from pyspark.sql import functions as F

    df = docs([(1, "fine", "s")]).withColumn("text", F.col("text").cast("string"))
    bad = df.select(F.lit(2).cast("long").alias("doc_id"), F.expr("cast(unhex('61FF62') as string)").alias("text"))
    got = {r.doc_id: r for r in X.align_tokens(df.select("doc_id", "text").union(bad)).collect()}
    assert got[1].n_a > 0 and got[1].groups.count("|") == got[1].n_groups and got[2].n_a == 0 and got[2].groups == ""
    assert X.align_tokens(docs([])).count() == 0
