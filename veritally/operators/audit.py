"""Audit of a labelled corpus: coverage, duplicates, overlap between splits, expected figures.

Texts are compared by a 256-bit digest of their normal form, so that shuffles carry the digest and never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.functions.text import id_key


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def split_sizes(examples: DataFrame) -> DataFrame:
    """Rows per split, and in all (split null)."""
    return examples.rollup("split").agg(F.count("*").alias("n"))


def coverage(examples: DataFrame, label: str, splits=("train", "dev", "test")) -> DataFrame:
    """Per split: distinct labels, labels of other splits that are missing, labels that train doesn't have."""
    seen = examples.select(label, "split").distinct()
    flags = seen.groupBy(label).agg(*(F.max((F.col("split") == s).cast("int")).alias(s) for s in splits))
    each = flags.select(label, "train", F.inline(F.array(*(F.struct(F.lit(s).alias("split"), F.col(s).alias("has")) for s in splits))))
    return each.groupBy("split").agg(F.sum("has").cast("long").alias("n_labels"), F.sum(1 - F.col("has")).cast("long").alias("n_missing"), F.sum(F.when((F.col("has") == 1) & (F.col("train") == 0), 1).otherwise(0)).cast("long").alias("n_not_in_train"))


def duplicate_groups(examples: DataFrame, text: Column, label_key: Column) -> DataFrame:
    """Texts that occur more than once (by digest): rows, first id, and whether they agree in intent and in all labels."""
    keyed = examples.select("id", "intent", digest(text).alias("digest"), label_key.alias("_label"))
    groups = keyed.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.lpad("id", 20, "0")).alias("first"), F.countDistinct("intent").alias("_i"), F.countDistinct("_label").alias("_l")).where("n > 1")
    kind = F.when(F.col("_l") == 1, "identical").when(F.col("_i") > 1, "intent conflict").otherwise("slot conflict")
    return groups.select("digest", "n", "first", kind.alias("kind"))


def overlap(examples: DataFrame, text: Column, label_key: Column, a: str, b: str) -> DataFrame:
    """One row: texts that splits a and b share, rows on either side, and rows of b whose labels also occur with the text in a."""
    keyed = examples.where(F.col("split").isin(a, b)).select("split", digest(text).alias("norm"), label_key.alias("_label"))
    by = keyed.groupBy("norm", "_label").agg(F.count_if(F.col("split") == a).alias("na"), F.count_if(F.col("split") == b).alias("nb"))
    per = by.groupBy("norm").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum(F.when(F.col("na") > 0, F.col("nb")).otherwise(0)).alias("same")).where("na > 0 AND nb > 0")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(F.lit(f"{a}_{b}").alias("pair"), F.count("*").alias("shared_texts"), total("na").alias("rows_a"), total("nb").alias("rows_b"), total("same").alias("identical_labels"))


def shared_rows(examples: DataFrame, text: Column, a: str, b: str) -> DataFrame:
    """The rows of split b whose text occurs in split a."""
    known = examples.where(F.col("split") == a).select(digest(text).alias("_norm")).distinct()
    return examples.where(F.col("split") == b).withColumn("_norm", digest(text)).join(known, "_norm", "left_semi").drop("_norm")


def unseen_rows(examples: DataFrame, text: Column, a: str, b: str) -> DataFrame:
    """The rows of split b whose text doesn't occur in split a."""
    known = examples.where(F.col("split") == a).select(digest(text).alias("_norm")).distinct()
    return examples.where(F.col("split") == b).withColumn("_norm", digest(text)).join(known, "_norm", "left_anti").drop("_norm")


def compare_expected(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Differences between two tables (key, value), null and missing alike."""
    both = expected.withColumnRenamed("value", "expected").join(actual.withColumnRenamed("value", "actual"), "key", "full_outer")
    wrong = both.where(~F.col("expected").eqNullSafe(F.col("actual")))
    return wrong.select("key", "expected", "actual", F.format_string("%s: expected %s, got %s", "key", F.coalesce(F.col("expected").cast("string"), F.lit("nothing")), F.coalesce(F.col("actual").cast("string"), F.lit("nothing"))).alias("note"))


def inventory(examples: DataFrame, label: str) -> DataFrame:
    """One row: the sorted distinct labels; any row that isn't of the train split is an error."""
    only = examples.withColumn("_", F.assert_true(F.col("split") == "train", "labels are taken from the train split only"))
    return only.where(F.col("_").isNull()).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def sorted_ids(df: DataFrame) -> DataFrame:
    return df.orderBy(*id_key(F.col("id")))
