import random
import re

import pytest

from veritally.llm import ngram_join as J


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 80 * len(x | y):
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    least = {}
    for (i, _), c in zip(sets, comp, strict=True):
        least[c] = min(least.get(c, i), i)
    return sorted((i, len(s), least[c]) for (i, s), c in zip(sets, comp, strict=True))


def corpus(seed, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out, i = [], 0
    passage = rng.choices(vocabulary, k=60)
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([6, 9, 30, 120, 400]))
        if rng.random() < 0.4:
            base = base + passage
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append((i, " ".join(w)))
            i += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(docs, rows, seed):
    data = corpus(seed)
    got = J.ngram_jaccard_join(docs([(i, t, "s") for i, t in data]))
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute(data)


def test_blocks_of_a_large_cluster_equal_brute_force(docs, rows, monkeypatch):
    """A cluster beyond the block size is cut by set size; nothing is lost."""
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 300)
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(90)]
    data = [(i, " ".join(base[: 90 - i // 2] + [f"x{i}"] * (i % 3))) for i in range(40)]
    got = J.ngram_jaccard_join(docs([(i, t, "s") for i, t in data]))
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute(data)


@pytest.mark.parametrize("boundary", [0, 10_000])
def test_light_and_heavy_signatures_find_the_same(docs, rows, monkeypatch, boundary):
    monkeypatch.setattr(J, "boundary_by_cost", lambda *a: boundary)
    data = corpus(3)
    got = J.ngram_jaccard_join(docs([(i, t, "s") for i, t in data]))
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute(data)


def test_edge_cases(docs, rows):
    long = " ".join(f"v{i}" for i in range(30_000))
    data = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (6, "a b c d e"), (7, "a b c d e"), (8, long), (9, long + " end"), (10, "É é"), (10, "É é"), (11, "a\x0bb\x1cc")]
    got = rows(J.ngram_jaccard_join(docs([(i, t, "s") for i, t in data])), "doc_id", "n_shingles", "component_id")
    assert got == brute(data)
    assert (1, 0, 1) in got and (5, 1, 4) in got and (7, 1, 6) in got and (9, 29_997, 8) in got


def test_empty_table(docs, rows):
    assert rows(J.ngram_jaccard_join(docs([])), "doc_id", "n_shingles", "component_id") == []


def test_one_of_each_keeps_columns(docs, rows):
    d = docs([(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, None, None)])
    kept = J.one_of_each(d)
    assert kept.columns == d.columns
    assert rows(kept, "doc_id", "source") == [(1, "y"), (2, None)]


def test_rows_without_an_id_keep_their_links(spark, docs, rows):
    """A near copy of two documents ties them together, whether it has an id or not; so does an exact copy without one."""
    words = [f"w{i}" for i in range(120)]
    a, b = " ".join(words), " ".join([*words[:112], *(f"x{i}" for i in range(8))])
    middle = " ".join([*words[:118], "y", "z"])
    far = " ".join(f"q{i}" for i in range(50))
    left = " ".join(["l1", "l2", "l3", "l4", "l5", "l6", "l7", *words[7:]])
    right = " ".join([*words[:113], "r1", "r2", "r3", "r4", "r5", "r6", "r7"])
    for middle_id in (3, None):
        got = dict(rows(J.ngram_jaccard_join(docs([(5, left, "s"), (7, right, "s"), (middle_id, a, "s"), (9, far, "s"), (None, far + " more words here", "s")])), "doc_id", "component_id"))
        assert got[5] == got[7] == (3 if middle_id else 5) and got[9] == 9
    got = rows(J.ngram_jaccard_join(docs([(None, a, "s"), (None, middle, "s"), (None, a, "s"), (8, b, "s"), (None, None, "s")])), "doc_id", "component_id")
    assert sorted(got, key=repr) == [(8, 8), (None, 8), (None, 8), (None, 8), (None, None)]
    assert rows(J.ngram_jaccard_join(docs([(None, a, "s"), (None, middle, "s")])), "component_id") == [(None,), (None,)]
