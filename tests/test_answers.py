"""Queries on answers, on tables of their own."""

from veritally.plans import answers


def test_prompt_hashes_of_whole_texts(spark, tmp_path):
    def hashes(name, first):
        items = [(0, first), (1, "second shot"), (2, "x" * 40 + " one"), (3, "x" * 40 + " two"), (4, "x" * 40 + " two")]
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        return {r["item_id"]: r["hash"] for r in answers.prompt_hashes(spark, str(tmp_path / name)).collect()}

    a, b = hashes("a", "s" * 20 + " this"), hashes("b", "s" * 20 + " that")
    assert a[2] != a[3] == a[4]
    assert all(a[i] != b[i] for i in range(5))
