"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with `SETTINGS`; on a cluster master and partitions come from its configuration."""
    builder = SparkSession.builder.config(map=SETTINGS)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Sets what can be set on a running session."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark
