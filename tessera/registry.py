"""A table of fixed schema over immutable snapshots: fetch, count, insert, delete, clear, batches.

A snapshot is a list of parts. Writes make a new one; the old stays valid until it is dropped, which makes
rollback the choice of an older snapshot. With ``dedup="identity"`` the first row of an identity (the
hashed columns) wins, with ``"none"`` every row is kept.

Inserts land as small loose parts. Loose parts of ``index_rows`` rows in all are laid out by the schema's
indexes: in buckets of the identity, each sorted by the first ``btree`` column, with Bloom filters
over the ``generic`` ones (tables without identity are range-partitioned by the first ``btree`` column). Laid out parts
of like size are merged, so that a row is rewritten once per doubling of the table, and an insert
joins with them without exchanging them.
"""

from __future__ import annotations

import asyncio
import dataclasses
import functools
import os
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ConstraintCheckFailed, MismatchedDataType, SchemaError, WriteOperationsNotAllowed
from tessera.operators.mutation import delete_rows, first_wins, held_keys, new_rows, new_rows_bucketed
from tessera.plans.binding import check_literal
from tessera.plans.compiler import compile_predicate
from tessera.plans.predicate import Predicate, RowProxy, from_json, from_lambda
from tessera.plans.wire import from_bytes
from tessera.schema import identity_columns, indexed_columns
from tessera.sources import files

#: Loose parts that are merged into one, and deletions after which a part is written out, so that plans stay short.
MATERIALISE_EVERY = 8
#: Rows of loose parts from which they are laid out by the indexes.
INDEX_ROWS = 1_000_000
#: Rows of a batch from the driver that are sent to the table, and identities among them that reach its scan.
SENT_ROWS, SCAN_KEYS = 100_000, 100
_NULL = "tessera: null in a row"

Where = Predicate | dict | bytes | Callable[[RowProxy], Predicate] | None


@dataclasses.dataclass(frozen=True)
class Command:
    """One command of a batch: fetch, count, conditional_count, insert, conditional_delete or clear."""

    name: str
    argument: Any = None

    WRITES = ("insert", "conditional_delete", "clear")


@dataclasses.dataclass(frozen=True)
class Part:
    """Some rows of a table: how many at most (None: not counted yet), in how many buckets (0: loose), deletions since written."""

    df: DataFrame
    rows: int | None
    laid_out: bool = False
    buckets: int = 0
    deletions: int = 0


class Registry:
    def __init__(
        self,
        spark: SparkSession,
        schema: T.StructType,
        rows: DataFrame | None = None,
        dedup: str = "identity",
        strict_index: bool = False,
        storage: str | None = None,
        index_rows: int = INDEX_ROWS,
        buckets: int | None = None,
    ):
        if dedup not in ("identity", "none"):
            raise SchemaError(f"unknown dedup {dedup!r}")
        if dedup == "identity" and not identity_columns(schema):
            raise SchemaError("identity needs at least one hashed column")
        self.spark, self.schema, self.dedup, self.strict_index = spark, schema, dedup, strict_index
        self.version, self._lock, self._storage = 0, threading.RLock(), storage
        self.index_rows, self.buckets = index_rows, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._history: list[tuple[Part, ...]] = []
        if rows is not None and rows.dtypes != [(f.name, f.dataType.simpleString()) for f in schema.fields]:
            raise ConstraintCheckFailed(f"{rows.dtypes} for {schema.simpleString()}")
        self.parts: tuple[Part, ...] = () if rows is None else (Part(rows, None),)

    @property
    def df(self) -> DataFrame:
        """All rows of the present snapshot."""
        if not self.parts:
            return self.spark.createDataFrame([], self.schema)
        return functools.reduce(DataFrame.unionByName, [p.df for p in self.parts])

    # ------------------------------------------------------------------ reading

    def predicate(self, where: Where) -> Predicate | None:
        """A predicate from any of its forms."""
        if where is None or isinstance(where, Predicate):
            return where
        if isinstance(where, dict):
            return from_json(where)
        if isinstance(where, (bytes, bytearray)):
            return from_bytes(where)
        return from_lambda(where)

    def condition(self, where: Where):
        p = self.predicate(where)
        return None if p is None else compile_predicate(p, self.schema, self.strict_index)

    def fetch(self, where: Where = None) -> DataFrame:
        """Rows that match, whole and in no order; all rows without a predicate."""
        c = self.condition(where)
        return self.df if c is None else self.df.filter(c)

    where = fetch

    def count(self, where: Where = None) -> int:
        return self.fetch(where).count()

    @property
    def indexed_column_count(self) -> int:
        return len(indexed_columns(self.schema))

    def output_layout(self) -> DataFrame:
        """(ordinal, name, type) of every column."""
        rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(self.schema.fields)]
        return self.spark.createDataFrame(rows, "ordinal int, name string, type string")

    def to_list(self, where: Where = None, cls: type | None = None) -> list:
        return list(self.iterate(where, cls))

    def to_array(self, where: Where = None, cls: type | None = None) -> tuple:
        return tuple(self.iterate(where, cls))

    async def to_list_async(self, where: Where = None, cls: type | None = None) -> list:
        """:meth:`to_list` in a thread, so that an event loop goes on meanwhile."""
        return await asyncio.to_thread(self.to_list, where, cls)

    async def to_array_async(self, where: Where = None, cls: type | None = None) -> tuple:
        return await asyncio.to_thread(self.to_array, where, cls)

    def iterate(self, where: Where = None, cls: type | None = None) -> Iterator:
        """Rows one by one, a partition at a time; as objects of ``cls`` where given, after a type check."""
        df = self.fetch(where)
        if cls is None:
            return iter(df.toLocalIterator())
        fields = [f.name for f in dataclasses.fields(cls)]
        if fields != df.columns:
            raise ConstraintCheckFailed(f"{cls.__name__} has {fields}, the table {df.columns}")
        return (cls(**r.asDict()) for r in df.toLocalIterator())

    # ------------------------------------------------------------------ writing

    def _rows(self, rows: Iterable) -> list[tuple]:
        """Checked rows, each after its place in the batch."""
        made = []
        for r in rows:
            if dataclasses.is_dataclass(r):
                r = tuple(getattr(r, f.name) for f in self.schema.fields)
            elif isinstance(r, dict):
                r = tuple(r.get(f.name) for f in self.schema.fields)
            if len(r) != len(self.schema.fields):
                raise ConstraintCheckFailed(f"{len(r)} values for {len(self.schema.fields)} columns")
            for f, v in zip(self.schema.fields, r):
                if v is None:
                    raise ConstraintCheckFailed(f"column {f.name!r} is null")
                check_literal(f, v)
            made.append((len(made), *[float(v) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else v for f, v in zip(self.schema.fields, r)]))
        return made

    def insert(self, row) -> bool:
        """Adds one row; False if its identity is there already."""
        return self.bulk_insert([row]) == 1

    def bulk_insert(self, rows: Iterable | DataFrame, order_by: str | None = None) -> int:
        """Adds rows and returns how many; a DataFrame needs ``order_by`` to say which row came first.

        Without it, any one row of an identity is kept. The input is evaluated once.
        """
        with self._lock:
            names = [f.name for f in self.schema.fields]
            made = None
            if isinstance(rows, DataFrame):
                kinds = dict(rows.dtypes)
                if any(kinds.get(f.name) != f.dataType.simpleString() for f in self.schema.fields):
                    raise MismatchedDataType(f"{rows.dtypes} for {self.schema.simpleString()}")
                order = F.col(order_by) if order_by else F.lit(0)
                whole = [F.coalesce(F.col(f"`{f.name}`"), F.raise_error(F.lit(_NULL)).cast(f.dataType)).alias(f.name) for f in self.schema.fields]
                batch = rows.select(order.alias("__seq"), *whole)
            else:
                made = self._rows(rows)
                if not made:
                    return 0
                batch = self.spark.createDataFrame(made, T.StructType([T.StructField("__seq", T.LongType(), False), *self.schema.fields]))
            if self.dedup == "identity":
                batch = self._new(batch, made)
            try:
                batch = self._write(batch.select(*names))
            except Exception as e:
                if _NULL in str(e):
                    raise ConstraintCheckFailed("null in a row") from e
                raise
            n = batch.count()
            if n:
                self._swap(self._merged((*self.parts, Part(batch, n))))
            return n

    def _new(self, batch: DataFrame, made: list[tuple] | None) -> DataFrame:
        """The first row of each identity of the batch that the table does not have."""
        keys = identity_columns(self.schema)
        batch = first_wins(batch, keys, F.col("__seq")).select(*[f.name for f in self.schema.fields])
        if made is not None and len(made) <= SENT_ROWS:
            at = [1 + self.schema.fieldNames().index(k) for k in keys]
            few = [tuple(r[i] for i in at) for r in made] if len(made) <= SCAN_KEYS else None
            held = [held_keys(p.df, batch, keys, few) for p in self.parts]
            return new_rows(functools.reduce(DataFrame.union, held), batch, keys) if held else batch
        for p in self.parts:
            if p.buckets:
                batch = new_rows_bucketed(p.df, batch, keys, p.buckets)
        loose = [p.df for p in self.parts if not p.buckets]
        return new_rows(functools.reduce(DataFrame.unionByName, loose), batch, keys) if loose else batch

    def delete(self, where: Where) -> int:
        """Removes the rows that match and returns how many they were."""
        with self._lock:
            c = self.condition(where)
            if c is None:
                return self.clear()
            n = self.df.filter(c).count()
            if n:
                kept = [dataclasses.replace(p, df=delete_rows(p.df, c), deletions=p.deletions + 1) for p in self.parts]
                self._swap(tuple(self._written([p]) if p.deletions >= MATERIALISE_EVERY else p for p in kept))
            return n

    def clear(self) -> int:
        """Removes all rows and returns how many they were."""
        with self._lock:
            n = self.df.count()
            self._swap(())
            return n

    def _swap(self, parts: tuple[Part, ...]) -> None:
        self._history.append(self.parts)
        self.version, self.parts = self.version + 1, parts

    def _merged(self, parts: tuple[Part, ...]) -> tuple[Part, ...]:
        """Loose parts laid out once they are large, or merged once they are many; laid out ones of like size merged."""
        parts = tuple(p if p.rows is not None else dataclasses.replace(p, rows=p.df.count()) for p in parts)
        loose, done = [p for p in parts if not p.laid_out], [p for p in parts if p.laid_out]
        if sum(p.rows for p in loose) >= self.index_rows:
            run = loose
            while done and sum(p.rows for p in run) * 2 >= done[-1].rows:
                run = [done.pop(), *run]
            return (*done, self._written(run, lay_out=True))
        if len(loose) > MATERIALISE_EVERY:
            loose = [self._written(loose)]
        return (*done, *loose)

    def _written(self, parts: list[Part], lay_out: bool = False) -> Part:
        """Parts as one, written out."""
        df = functools.reduce(DataFrame.unionByName, [p.df for p in parts])
        lay_out = lay_out or any(p.laid_out for p in parts)
        if not lay_out:
            df = self._write(df)
            return Part(df, df.count())
        keys = identity_columns(self.schema) if self.dedup == "identity" else []
        role = {kind: [f.name for f in self.schema.fields if f.metadata.get("indexer") == kind] for kind in ("btree", "generic")}
        ordered = role["btree"][:1]
        if keys:
            df = files.write_bucketed(df, self._path(), keys, self.buckets, ordered or keys, role["generic"])
        elif ordered:
            path = self._path()
            files.write_ordered(df, path, ordered)
            df = self.spark.read.schema(df.schema).parquet(path)
        else:
            df = self._write(df)
        return Part(df, df.count(), True, self.buckets if keys else 0)

    def _path(self) -> str:
        if self._storage is None:
            self._storage = files.scratch(self.spark, "table")
        return os.path.join(self._storage, uuid.uuid4().hex)

    def _write(self, df: DataFrame) -> DataFrame:
        """Rows in the shared folder: later reads do not depend on what made them."""
        path = self._path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # ------------------------------------------------- snapshots, batches, dumps

    def snapshot(self) -> tuple[int, DataFrame]:
        return self.version, self.df

    def rollback(self, steps: int = 1) -> None:
        """Back to an earlier snapshot."""
        with self._lock:
            if not 0 < steps <= len(self._history):
                raise ValueError(f"{steps} of {len(self._history)} snapshots")
            self.parts = self._history[-steps]
            del self._history[-steps:]
            self.version += 1

    def commit(self) -> None:
        """Gives up the possibility to roll back."""
        with self._lock:
            self._history.clear()

    def execute(self, commands: list[Command], write: bool = False) -> list:
        """Runs a batch in order; one that is not declared a write may hold no write command.

        A batch that fails leaves the table as it was.
        """
        if not write and any(c.name in Command.WRITES for c in commands):
            raise WriteOperationsNotAllowed([c.name for c in commands if c.name in Command.WRITES])
        run = {
            "fetch": self.fetch,
            "count": lambda _: self.count(),
            "conditional_count": self.count,
            "insert": self.bulk_insert,
            "conditional_delete": self.delete,
            "clear": lambda _: self.clear(),
        }
        with self._lock:
            before = self.parts, self.version, list(self._history)
            try:
                return [run[c.name](c.argument) for c in commands]
            except Exception:
                self.parts, self.version, self._history = before
                raise

    def dump(self, path: str, codec: str = "zstd") -> None:
        files.dump(self.df, path, codec)

    @classmethod
    def load(cls, spark: SparkSession, path: str, schema: T.StructType, **options) -> Registry:
        df = files.load(spark, path, schema)
        return cls(spark, schema, df, **options)
