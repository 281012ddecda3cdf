"""Tables on storage: Parquet snapshots, dumps and ordered layouts."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.schema import with_roles


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``directory/name.parquet``."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def dump(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """All rows as Parquet; column roles travel in the field metadata."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def load(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A dump read again; ``schema`` adds the column roles where the files lack them."""
    df = spark.read.parquet(path)
    if schema is not None:
        df = df.select(*[df[f.name].alias(f.name, metadata=json.loads(json.dumps(f.metadata))) for f in schema.fields])
    return df


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one where all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def write_ordered(df: DataFrame, path: str, key: str | list[str], partitions: int | None = None) -> None:
    """Range-partitioned and sorted by ``key``, so that min/max statistics prune files and row groups.

    Of several columns, a frequent value of the first is spread over several files.
    """
    keys = [key] if isinstance(key, str) else key
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int, order: list[str] | None = None, lookups: list[str] | None = None) -> DataFrame:
    """Parquet in one file per bucket of ``keys``, read again with its buckets.

    Joins and aggregations on ``keys`` need no exchange of it, equality on a single key reads one bucket.
    Rows of a bucket are sorted by ``order`` (by default the keys), for row group statistics, and ``lookups``
    get Bloom filters, for equality on columns that are neither. The catalogue entry only lives
    until the table has been read; the files stay.
    """
    spark, name = df.sparkSession, f"tessera_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*(order or keys))
    for c in lookups or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.saveAsTable(name)
    made = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return made


__all__ = ["dump", "load", "scratch", "table", "with_roles", "write_bucketed", "write_ordered"]
