"""Row identity and conditional deletion over immutable DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_wins(batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of every identity, by ``order``.

    ``min_by`` over the whole row combines before the exchange, so a hot identity is one row per task;
    a window would bring all its rows together. Nulls are equal to each other. The result stays
    partitioned by the identity (but for floats, which are grouped in a normal form).
    """
    names = batch.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    if set(keys) == set(names):
        return batch.dropDuplicates()
    got = batch.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, order).alias("__row"))
    grouped = {k: F.col(f"__k{i}") for i, k in enumerate(keys) if not isinstance(batch.schema[k].dataType, (T.FloatType, T.DoubleType))}
    return got.select(*[grouped.get(c, F.col("__row").getField(c)).alias(c) for c in names])


def new_rows(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``batch`` whose identity ``table`` does not have."""
    held = table.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)])
    on = None
    for i, k in enumerate(keys):
        same = batch[f"`{k}`"].eqNullSafe(held[f"__k{i}"])
        on = same if on is None else on & same
    return batch.join(held, on, "left_anti")


def new_rows_bucketed(part: DataFrame, batch: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """:func:`new_rows` against a table in ``buckets`` buckets of ``keys``: only the batch is exchanged.

    For batches without nulls in ``keys``: plain equality keeps the buckets, null-safe equality does not.
    """
    if int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")) != buckets:
        batch = batch.repartition(buckets, *[F.col(f"`{k}`") for k in keys])
    held = part.select(*[F.col(f"`{k}`").alias(f"__h{i}") for i, k in enumerate(keys)])
    on = None
    for i, k in enumerate(keys):
        same = F.col(f"`{k}`") == F.col(f"__h{i}")
        on = same if on is None else on & same
    return batch.join(held.hint("merge"), on, "left_anti")


def held_keys(part: DataFrame, batch: DataFrame, keys: list[str], rows: list[tuple] | None = None) -> DataFrame:
    """The identities of a small ``batch`` that ``part`` has: the batch goes to the table, which is read once.

    ``rows`` are the batch's identities, if they are few: they reach the scan, which then skips row groups
    and, for a single key, buckets.
    """
    for i, k in enumerate(keys):
        if rows and isinstance(part.schema[k].dataType, (T.IntegerType, T.LongType, T.StringType)):
            part = part.filter(F.col(f"`{k}`").isin(list({r[i] for r in rows})))
    return part.select(*keys).join(F.broadcast(batch.select(*keys)), keys, "left_semi")


def delete_rows(table: DataFrame, condition: Column) -> DataFrame:
    """What stays: rows for which the condition is not true (null counts as not true)."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def count_rows(table: DataFrame, condition: Column | None = None) -> DataFrame:
    """One row with the count ``n``."""
    if condition is not None:
        table = table.filter(condition)
    return table.agg(F.count(F.lit(1)).alias("n"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
