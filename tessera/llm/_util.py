"""Plumbing shared by the corpus operators: shared folder, batch slicing, column appending."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step holds at most (one longer text makes a step of its own).
SLICE_BYTES = 2 << 20


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType()}


def struct(**fields: str | T.DataType) -> T.StructType:
    """A schema from names and short type names; ``kind[]`` is an array of the kind."""
    made = T.StructType()
    for name, kind in fields.items():
        if isinstance(kind, str):
            kind = T.ArrayType(_KINDS[kind[:-2]]) if kind.endswith("[]") else _KINDS[kind]
        made.add(name, kind)
    return made


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is configured and all run on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns it read again: lineage ends here."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the text of each slice stays under ``limit`` bytes where rows allow."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i in range(n):
        if held and held + sizes[i] > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(sizes[i])
    yield batch.slice(start, n - start)


def _binary(array: pa.Array) -> list[bytes | None]:
    return array.cast(pa.large_binary()).to_pylist()


def texts_of(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; None for null."""
    return _binary(batch.column(column))


def map_text(
    df: DataFrame,
    text_col: str,
    keep: list[str],
    out: T.StructType,
    compute: Callable[[list[bytes | None]], list],
    limit: int = SLICE_BYTES,
    finish: Callable[[], None] | None = None,
) -> DataFrame:
    """Columns ``keep`` of ``df`` plus the columns ``out``, computed from whole texts slice by slice.

    ``compute`` gets the texts of a slice as bytes and returns one sequence per field of ``out``;
    ``finish`` runs at the end of a partition, to let go of what the worker process would keep.
    Only ``keep`` and the text cross to Python, so further columns never clash with internal names. A kept
    column with the name of a computed one (in any case) is returned as ``<name>_in``.
    """
    src = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("t"))
    schema = T.StructType([T.StructField(f"k{i}", f.dataType, True) for i, f in enumerate(src.schema.fields[:-1])] + [T.StructField(f.name, f.dataType, True) for f in out.fields])
    kinds = [_arrow(f.dataType) for f in out.fields]
    names = [f.name for f in schema.fields]
    n = len(keep)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, n, limit):
                made = compute(texts_of(batch, n))
                cols = [batch.column(i) for i in range(n)] + [m if isinstance(m, pa.Array) else pa.array(m, type=k) for m, k in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        if finish:
            finish()

    made = src.mapInArrow(run, schema)
    names = beside(keep, out.fieldNames())
    return made.toDF(*[f"c{i}" for i in range(len(names) + len(out))]).toDF(*names, *out.fieldNames())


def beside(columns: list[str], made: list[str]) -> list[str]:
    """``columns``, with ``_in`` after every name that ``made`` has too (Spark's names know no case)."""
    taken, out = {m.lower() for m in made}, []
    for c in columns:
        while c.lower() in taken:
            c += "_in"
        taken.add(c.lower())
        out.append(c)
    return out


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ... in order: no name of its own can clash with a computed one."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def named(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns c0, c1, ... of ``df`` under the names of ``like``."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(like.columns)])


def at(df: DataFrame, column: str) -> str:
    """The name that :func:`numbered` gives a column."""
    names = [c.lower() for c in df.columns]
    return f"c{names.index(column.lower())}"


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def doc_offsets(counts) -> np.ndarray:
    """Offsets (length n + 1) of consecutive runs."""
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def sum_by_run(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs, empty runs included."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
