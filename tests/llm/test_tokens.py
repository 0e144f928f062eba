import random
import time

import pytest
import tiktoken

from veritally.llm import tokens as T

PARTS = ["'ll", " ", "\n", "  \n ", "x", "l", "12", "ab c", "", "'", "!!", "é", "　", "'r", "e", "word " * 40, "\t"]


@pytest.fixture(scope="module")
def counter():
    with open(T.VOCABULARY, "rb") as f:
        return T.Counter(f.read())


def test_counts_follow_edits(counter):
    rng = random.Random(1)
    for _ in range(60):
        tree = T.TokenTree("".join(rng.choices(PARTS, k=rng.randint(0, 200))), counter)
        for _ in range(20):
            a = rng.randint(0, len(tree.text))
            tree.edit(a, a + rng.choice([0, 1, 3, 60]), rng.choice(PARTS))
            assert tree.tokens == len(counter.bpe.encode_ordinary(tree.text))


def test_edits_encode_little(counter):
    text = "some words that go on and on, again and again. " * 2000
    tree = T.TokenTree(text, counter)
    tree.edit(40_000, 40_004, "changed")
    assert tree.touched < 20 and tree.tokens == len(counter.bpe.encode_ordinary(tree.text))


def test_query_equals_full_count(spark, docs, counter, tmp_path):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices([*PARTS, "12345", " 0123456789", "4444x5555"], k=rng.randint(0, 60))), "s") for i in range(60)] + [(100, None, "s"), (101, "", "s"), (102, "tel 123456 " * 3000, None), (102, "tel 123456 " * 3000, None)]
    import re

    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"], r["n_tokens"], r["n_edits"], r["n_tokens_edited"]) for r in T.op6_token_counts(spark, str(tmp_path)).collect())
    count = lambda t: len(counter.bpe.encode_ordinary(t))
    assert got == sorted((i, count(t or ""), len(re.findall("[0-9]{4,}", t or "")), count(re.sub("[0-9]{4,}", "#", t or ""))) for i, t, _ in rows)


def test_given_edits_and_empty(spark, counter):
    schema = "doc_id long, text string, edits array<struct<start:long,end:long,text:string>>, extra int"
    rows = [(1, "hello world", [(0, 5, "bye"), (5, 5, ","), (100, 200, "!")], 1), (2, "hello", None, 1), (3, None, [(0, 0, None)], 1)]
    got = {r["doc_id"]: r for r in T.count_tokens(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["n_tokens_edited"] == len(counter.bpe.encode_ordinary("bye, world!")) and got[2]["n_edits"] == 0 and got[3]["n_tokens_edited"] == 0
    assert T.count_tokens(spark.createDataFrame([], schema)).count() == 0


def test_many_edits_of_a_long_text(counter):
    """Thousands of edits of megabytes take seconds, as none copies the text; long runs of white space and letters around them are met, too."""
    text = "word 12345 and more 98765 \n\n" * 100_000
    tree = T.TokenTree(text, counter)
    start = time.monotonic()
    for i in range(5000):
        at = i * 500
        tree.edit(at, at + 3, "xyz ")
    assert time.monotonic() - start < 20 and tree.touched < 5000 * 40
    assert tree.tokens == len(counter.bpe.encode_ordinary(tree.text)) and len(tree.text) == len(text) + 5000
    for text in ("a" + " " * 10_000 + "b", "x" * 5000 + " " + "y" * 5000, "1 " * 3000):
        for at in (0, 1, 5000, 5001, len(text)):
            tree = T.TokenTree(text, counter)
            tree.edit(at, at + 1, " z")
            assert tree.text == text[:at] + " z" + text[at + 1 :] and tree.tokens == len(counter.bpe.encode_ordinary(tree.text))


def depth(node):
    deepest, todo = 0, [(node, 1)]
    while todo:
        node, d = todo.pop()
        deepest = max(deepest, d)
        if node.left is not None:
            todo += [(node.left, d + 1), (node.right, d + 1)]
    return deepest


@pytest.mark.parametrize("where", ["same", "behind", "middle", "random"])
def test_many_edits_at_one_place(counter, where):
    """The tree stays flat whatever the order of places; the counts are those of the text."""
    rng, tree, n = random.Random(4), T.TokenTree("start of a text and its end", counter), 20_000
    start = time.monotonic()
    at = 5
    for i in range(n):
        tree.edit(at, at, f"w{i} ")
        at = at if where == "same" else at + len(f"w{i} ") if where == "behind" else tree.root.chars // 2 if where == "middle" else rng.randrange(tree.root.chars)
    assert time.monotonic() - start < 30
    assert depth(tree.root) <= 4 + 2.1 * tree.root.leaves.bit_length() and tree.root.leaves > 100
    assert tree.tokens == len(counter.bpe.encode_ordinary(tree.text))
    for _ in range(400):  # and after deletions
        tree.edit(3, 3 + tree.root.chars // 50, "")
    assert tree.tokens == len(counter.bpe.encode_ordinary(tree.text)) and depth(tree.root) < 40


def test_insertions_at_one_place_are_one_edit(spark, counter):
    edits = [(6, 6, f"x{i} ") for i in range(200_000)] + [(6, 11, "there")]
    start = time.monotonic()
    (row,) = T._edited(counter, [(1, "hello world", edits)])
    assert time.monotonic() - start < 10 and row[2] == 200_001
    assert row[3] == len(counter.bpe.encode_ordinary("hello " + "".join(f"x{i} " for i in range(200_000)) + "there"))
    assert T.merged([(5, 5, "a"), (1, 3, "b"), (5, 5, None), (5, 7, "c"), (7, 7, "d"), (1, 1, "e")]) == [(1, 3, "b"), (1, 1, "e"), (5, 7, "ac"), (7, 7, "d")]


def test_invalid_utf8(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(unhex('61FF3132333435') as string)").alias("text"))
    assert T.count_masked(df).first().n_edits == 1
