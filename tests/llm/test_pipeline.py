"""The stages against brute force, on whole small tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("pipeline")
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs[-1], SF).write.parquet(f"file://{out}/{i}")
        docs.append(spark.read.parquet(f"file://{out}/{i}"))
    return docs


def test_columns_and_chain(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[-1] == ids[-2] == ids[-3]


def test_quality_keeps_what_is_labelled_good(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in steps[1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_one_document_of_each_group(steps):
    from tests.llm.test_ngram_join import brute

    before = [(r["doc_id"], r["text"]) for r in steps[1].collect()]
    assert sorted(r["doc_id"] for r in steps[2].collect()) == sorted(i for i, _, c in brute(before) if i == c)


def test_leaks_go_and_secrets_are_masked(spark, steps):
    from tests.llm.test_decontaminate import similar
    from tests.llm.test_secrets import brute

    items = [r["text"].lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    clean = {i for i, t in before.items() if all(similar(t.lower().split(), x) < 0.8 for x in items)}
    assert {r["doc_id"] for r in steps[3].collect()} == clean
    for r in steps[4].collect():
        assert not brute(r["text"]) and r["n_chars"] == len(r["text"]) and (r["text"] == before[r["doc_id"]] or brute(before[r["doc_id"]]))


def test_mix(steps):
    got = steps[-1].collect()
    total = sum(r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - 1.5 * total) <= 0.02 * total and all(r["taken"] <= 2 * r["size"] for r in got)


def test_run(spark, steps):
    cols = ["doc_id", "taken"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*cols).collect())) == sorted(map(tuple, steps[-1].select(*cols).collect()))


def test_every_stage_takes_any_row(spark, tmp_path, docs):
    """Nulls in every column, empty and long texts, repeated rows and ids, copies, leaks, secrets, columns with clashing names; and an empty table."""
    item = " ".join(f"item{i}" for i in range(40))
    word = lambda i: " ".join(f"word{i}x{j}" for j in range(30))
    rows = [(1, None, "a"), (2, "", None), (3, " \n", "a"), (None, word(1), "a"), (None, None, None), (4, word(1), None), (4, word(1), None), (5, word(1) + " more", "b"), (6, "w " * 60_000, "b"), (7, f"before {item} after", "b"), (8, word(2) + " token=abcdefghijklmnop", "c"), (None, f"{item}", "c"), (9, "Ünï " + word(3), "c")]
    spark.createDataFrame([(1, item), (2, None), (None, ""), (None, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(4, 1, 0), (9, 1, 0), (6, 0, 1), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = docs(rows)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, d, str(tmp_path))
        out[name] = [(r["doc_id"], r["text"] if "text" in got.columns else r["taken"]) for r in got.collect()]
        assert name == "mixing sources" or got.columns == d.columns
        assert stage(spark, docs([]), str(tmp_path)).count() == 0
    kept = lambda name: sorted((i is None, i or 0) for i, _ in out[name])
    assert not {1, 2, 3} & {i for i, _ in out["quality classifier"]} and {4, 9} <= {i for i, _ in out["quality classifier"]}
    assert 5 not in {i for i, _ in out["n-gram jaccard join"]} and {1, 2, 3, 4, 6, 7, 8, 9} <= {i for i, _ in out["n-gram jaccard join"]}
    assert {i for i, _ in out["benchmark decontamination"]} == {1, 2, 3, 4, 5, 6, 8, 9} and len(out["benchmark decontamination"]) == 9
    assert len(out["secret scans"]) == len(rows) and any(t and t.endswith("<assign>") for _, t in out["secret scans"])
    assert kept("mixing sources") == sorted((i is None, i or 0) for i, _, _ in rows) and all(n == 0 for i, n in out["mixing sources"] if i in (1, 2, 3))
