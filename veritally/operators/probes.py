"""Catalogues and probes of endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def catalogue(document: Column) -> Column:
    """array<struct<id, tier>> of a JSON catalogue: a list, or an object with ``models``; the tier is ``rate_limit_tier`` or else ``tier``."""
    v = F.try_parse_json(document)
    models = F.coalesce(F.try_variant_get(v, "$.models", "array<variant>"), F.when(F.schema_of_variant(v).startswith("ARRAY<"), F.try_variant_get(v, "$", "array<variant>")))
    tier = lambda m: F.coalesce(F.try_variant_get(m, "$.rate_limit_tier", "string"), F.try_variant_get(m, "$.tier", "string"))
    return F.transform(models, lambda m: F.struct(F.try_variant_get(m, "$.id", "string").alias("id"), tier(m).alias("tier")))


def plan(systems: DataFrame) -> DataFrame:
    """One probe for each endpoint and model: the first system's."""
    rest = [c for c in systems.columns if c not in ("endpoint", "model")]
    return systems.groupBy("endpoint", "model").agg(F.min_by(F.struct(*rest), "pos").alias("_r")).select("endpoint", "model", "_r.*")
