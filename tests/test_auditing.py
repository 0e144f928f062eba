"""Queries on the audit against brute force, on tables of their own."""

from veritally.plans import auditing


def test_contamination_of_glued_and_short_texts(spark, tmp_path):
    ten, nine, eight = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 10), ("b", 9), ("c", 8)))
    items = [(1, ten), (2, nine), (3, eight), (4, "two words"), (5, "one"), (6, f" {ten}  x\ty\n"), (7, None), (8, ten + " more of it")]
    texts = [f'He said "{ten}".', f"({nine}), and", f"{eight}.", eight, f"x{ten}x", "twotwo wordsone", "nothing", None, "", f"z {ten}  x\ty\n{ten}", f"pre {ten} more of its kind", ten.upper(), ten.replace(" ", "  ")]
    d = list(enumerate(texts))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(d, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in auditing.benchmark_contamination(spark, str(tmp_path)).collect())
    assert got == sorted((i, j) for i, x in items for j, t in d if x is not None and t is not None and x in t)
