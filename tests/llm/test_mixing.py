import pytest

from veritally.llm.mixing import apportion, mix_sources


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Shares by weight; what is above the cap is shared again until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def data():
    out = []
    for i in range(300):
        source = ["a", "b", "c", None, "d"][i % 5] if i % 2 else "hot"
        out.append((i, " ".join(["w"] * (i % 40)), source))
    return out


def test_targets_and_taken(docs, rows):
    d = data()
    got = mix_sources(docs(d)).collect()
    sizes = {}
    for _, t, s in d:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= max(1, 0.02 * want[s])
    assert len(got) == len(d)


def test_reruns_agree(docs, rows):
    d = data()
    a, b = (rows(mix_sources(docs(x)), "doc_id", "taken") for x in (d, d[::-1]))
    assert a == b


def test_shards_of_a_hot_source(docs, monkeypatch):
    from veritally.llm import mixing

    monkeypatch.setattr(mixing, "SHARD_WORDS", 200)
    got = mix_sources(docs([(i, "w " * (i % 60), "hot" if i % 3 else "b") for i in range(400)])).collect()
    for s in ("hot", "b"):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.05 * mine[0]["target"]


def test_edge_cases(docs, rows):
    long = "w " * 100_000
    got = rows(mix_sources(docs([(1, None, "a"), (2, "", None), (3, long, "b"), (4, "x\x0cy", "b"), (5, "z", "a"), (5, "z", "a")])), "doc_id", "size", "source_size", "taken")
    assert [g[:3] for g in got] == [(1, 0, 2), (2, 0, 0), (3, 100_000, 100_002), (4, 2, 100_002), (5, 1, 2), (5, 1, 2)]
    assert got[0][3] == got[1][3] == 0
    assert mix_sources(docs([])).count() == 0
    assert rows(mix_sources(docs([(1, None, "a")])), "target", "taken") == [(0.0, 0)]


def test_apportion_is_by_highest_quotients(spark):
    from pyspark.sql import functions as F

    votes = {"a": 53_000, "b": 24_000, "c": 23_000, "d": 10, "e": 0}
    for seats in (0, 1, 7, 100, 1001):
        won = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = max(votes, key=lambda s: (votes[s] / (2 * won[s] + 1), -ord(s)))
            won[best] += 1
        df = spark.createDataFrame(list(votes.items()), "s string, v long")
        got = {r["s"]: r["quota"] for r in apportion(df, [], F.lit(seats), F.col("v"), [F.col("s")]).collect()}
        assert got == won


def near_targets(got, cap=2):
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= cap * r["size"]
        by.setdefault(r["source"], []).append(r)
    for source, mine in by.items():
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(1, 0.05 * mine[0]["target"]), source
    return by


def test_many_tiny_sources_beside_a_large_one(docs):
    d = [(i, "w " * 60, "big") for i in range(100)] + [(1000 + i, "a b c", f"tiny{i:02d}") for i in range(60)]
    by = near_targets(mix_sources(docs(d)).collect())
    want = brute_targets({"big": 6000} | {f"tiny{i:02d}": 3 for i in range(60)})
    for s, mine in by.items():
        assert mine[0]["target"] == pytest.approx(want[s])
    assert all(sum(r["taken"] for r in by[f"tiny{i:02d}"]) == 6 for i in range(60))


def test_sources_of_all_sizes(docs):
    """Sizes from 1 word to 50,000 and weights of 1 to 3: every source comes near its target, whatever the others are."""
    d, i = [], 0
    for n, size in enumerate([1, 2, 5, 19, 20, 21, 40, 100, 333, 1000, 5000, 50_000]):
        for part in range(3):
            d.append((i, "w " * (size // 3 + (part < size % 3)), f"s{n:02d}"))
            i += 1
    by = near_targets(mix_sources(docs(d)).collect())
    want = brute_targets({f"s{n:02d}": size for n, size in enumerate([1, 2, 5, 19, 20, 21, 40, 100, 333, 1000, 5000, 50_000])})
    assert {s: m[0]["target"] for s, m in by.items()} == pytest.approx(want)


def test_levels_of_sources_that_fill_one_after_the_other(spark):
    from veritally.llm.mixing import targets

    sizes = {f"s{i:02d}": 3**i for i in range(30)} | {None: 7, "zero": 0}
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_blocks_are_whole_and_differ_by_seed(docs):
    """A document per word: what is taken once more comes in blocks of 16 words, one to a run, and another seed takes others."""
    d = docs([(i, "w", "a") for i in range(6000)] + [(6000 + i, "w", "b") for i in range(2000)] + [(9000 + i, "w", "c") for i in range(3000)])
    from pyspark.sql import functions as F

    def runs(seed):
        rows = mix_sources(d, seed=seed).where("source = 'a'").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).orderBy("h", "doc_id").collect()
        low = min(r["taken"] for r in rows)
        mark = [r["taken"] > low for r in rows]
        assert len(rows) == 6000 and {r["taken"] - low for r in rows} == {0, 1}
        return [all(mark[i : i + 16]) for i in range(0, 6000, 16) if len(set(mark[i : i + 16])) == 1], mark

    (whole, a), (_, b) = runs(1), runs(2)
    assert len(whole) == 375 and a != b
    at = [i for i, x in enumerate(whole) if x]
    assert len({j - i for i, j in zip(at, at[1:])}) > 1


def test_a_tiny_source_leaves_the_others_choice_alone(docs, rows):
    d = [(i, " ".join(f"w{j}" for j in range(200)), "a") for i in range(300)]
    before = dict(rows(mix_sources(docs(d)), "doc_id", "taken"))
    after = dict(rows(mix_sources(docs([*d, (1000, "one", "b")])), "doc_id", "taken"))
    assert after.pop(1000) == 2
    changed = sum(before[i] != after[i] for i in before)
    assert changed <= 2 and abs(sum(before.values()) - sum(after.values())) <= 20


def test_rows_without_ids_are_many_shards(docs, monkeypatch):
    from veritally.llm import mixing

    monkeypatch.setattr(mixing, "SHARD_WORDS", 200)
    d = docs([(None if i % 3 else 5, f"text {i} " * (i % 30), "hot") for i in range(600)])
    keyed = mixing.sizes(d).selectExpr("xxhash64(17, doc_id, size, digest) AS h")
    assert keyed.distinct().count() > 500
    got = near_targets(mix_sources(d).collect())
    assert got.keys() == {"hot"}
