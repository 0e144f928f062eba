"""Scratch tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType, VariantType

#: A side is broadcast only if it was counted and has at most so many rows and, by its values, so many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where it is unset and everything runs on one machine (tests), a local folder."""
    base = spark.conf.get(_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_DIR} must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="veritally-")
        spark.conf.set(_DIR, base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/veritally-{name}-{uuid.uuid4().hex[:12]}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors, and tells Catalyst its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, StringType | BinaryType | VariantType):
        size = F.octet_length(value if not isinstance(kind, VariantType) else F.to_json(value))
    elif isinstance(kind, ArrayType):
        inner = kind.elementType
        fixed = not isinstance(inner, StringType | BinaryType | VariantType | ArrayType | MapType | StructType)
        size = F.size(value) * 8 if fixed else F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + width(x, inner))
    elif isinstance(kind, MapType):
        size = width(F.map_keys(value), ArrayType(kind.keyType)) + width(F.map_values(value), ArrayType(kind.valueType))
    elif isinstance(kind, StructType):
        size = reduce(lambda a, f: a + width(value[f.name], f.dataType), kind.fields, F.lit(0))
    else:
        return F.lit(8).cast("long")
    return F.coalesce(size.cast("long"), F.lit(0)) + 16


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and ``size`` bytes, else as it is (a shuffle join)."""
    held = reduce(lambda a, f: a + width(F.col(f"`{f.name}`"), f.dataType), df.schema.fields, F.lit(0).cast("long"))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(held), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df
