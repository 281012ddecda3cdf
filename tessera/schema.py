"""Table schemas: from configuration dictionaries, JSON or dataclasses to ``StructType``.

Every column carries its indexer (``none``, ``generic``, ``btree`` or ``fuzzy``) and whether it is part of
row identity (``hashed``, by default if and only if it is indexed) as field metadata.
"""

from __future__ import annotations

import dataclasses
import decimal
import json
import typing

from pyspark.sql import types as T

from tessera.errors import DuplicateColumn, SchemaError

#: Type spellings of configurations.
TYPES = {
    "dword": T.IntegerType(),
    "qword": T.LongType(),
    "single": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
}
INDEXERS = ("none", "generic", "btree", "fuzzy")
DECIMAL_PRECISION = 29

_PYTHON = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType()}


class Int32(int):
    """Annotation for 32-bit integers in dataclasses."""


class Float32(float):
    """Annotation for 32-bit floats in dataclasses."""


_PYTHON |= {Int32: T.IntegerType(), Float32: T.FloatType()}


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType))


def is_sequence(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.BinaryType))


def column(name: str, kind: T.DataType, indexer: str = "none", hashed: bool | None = None) -> T.StructField:
    """One column; ordered indexes need numbers and fuzzy ones strings or bytes."""
    if indexer not in INDEXERS:
        raise SchemaError(f"unknown indexer {indexer!r} of column {name!r}")
    if indexer == "btree" and not is_numeric(kind):
        raise SchemaError(f"column {name!r}: a btree index needs a numeric type")
    if indexer == "fuzzy" and not is_sequence(kind):
        raise SchemaError(f"column {name!r}: a fuzzy index needs strings or bytes")
    return T.StructField(name, kind, False, {"indexer": indexer, "hashed": indexer != "none" if hashed is None else bool(hashed)})


def table_schema(columns: list[T.StructField]) -> T.StructType:
    names = [c.name for c in columns]
    for n in names:
        if names.count(n) > 1:
            raise DuplicateColumn(n)
    if not names:
        raise SchemaError("a table needs a column")
    return T.StructType(columns)


def type_of(spelling: str, scale: int = 10) -> T.DataType:
    """A type from its configuration spelling, in any case."""
    low = spelling.lower()
    if low == "decimal":
        return T.DecimalType(DECIMAL_PRECISION, scale)
    if low not in TYPES:
        raise SchemaError(f"unknown type {spelling!r}")
    return TYPES[low]


def schema_from_config(config: dict | str) -> T.StructType:
    """``{"columns": [{"name", "type", "indexer"?, "hashed"?, "scale"?}, ...]}``, or the same as JSON.

    ``indexer`` is a name or ``{"type": name, "degree": n}``; the degree of an ordered index has no
    meaning here beyond being at least 3.
    """
    if isinstance(config, str):
        config = json.loads(config)
    made = []
    for c in config["columns"]:
        indexer = c.get("indexer") or "none"
        if isinstance(indexer, dict):
            if indexer.get("degree") is not None and indexer["degree"] < 3:
                raise SchemaError(f"column {c['name']!r}: degree below 3")
            indexer = indexer.get("type", "none")
        hashed = c.get("hashed", c.get("shouldBeHashed"))
        made.append(column(c["name"], type_of(c["type"], c.get("scale", 10)), indexer.lower(), hashed))
    return table_schema(made)


def indexed(indexer: str, hashed: bool | None = None, scale: int = 10):
    """Default value of a dataclass field that carries its index."""
    return dataclasses.field(metadata={"indexer": indexer, "hashed": hashed, "scale": scale})


def schema_from_class(cls: type, default_indexer: str = "generic") -> T.StructType:
    """The schema of a dataclass: one column per field in order."""
    hints = typing.get_type_hints(cls)
    made = []
    for f in dataclasses.fields(cls):
        hint = hints[f.name]
        if hint is decimal.Decimal:
            kind: T.DataType = T.DecimalType(DECIMAL_PRECISION, f.metadata.get("scale", 10))
        elif hint in _PYTHON:
            kind = _PYTHON[hint]
        else:
            raise SchemaError(f"field {f.name!r} has no column type")
        made.append(column(f.name, kind, f.metadata.get("indexer", default_indexer), f.metadata.get("hashed")))
    return table_schema(made)


def with_roles(schema: T.StructType, indexers: dict[str, str] | None = None, hashed: list[str] | None = None) -> T.StructType:
    """An existing DataFrame schema with indexers and identity columns set; types stay as they are."""
    made = []
    for f in schema.fields:
        indexer = (indexers or {}).get(f.name, "none")
        made.append(T.StructField(f.name, f.dataType, f.nullable, {"indexer": indexer, "hashed": f.name in hashed if hashed is not None else indexer != "none"}))
    return table_schema(made)


def identity_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if f.metadata.get("hashed")]


def indexed_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if f.metadata.get("indexer", "none") != "none"]


def to_config(schema: T.StructType) -> dict:
    """The configuration that :func:`schema_from_config` turns into ``schema``."""
    spelling = {type(v): k for k, v in TYPES.items()}
    made = []
    for f in schema.fields:
        c = {"name": f.name, "type": "decimal" if isinstance(f.dataType, T.DecimalType) else spelling[type(f.dataType)], "indexer": f.metadata["indexer"], "hashed": f.metadata["hashed"]}
        if isinstance(f.dataType, T.DecimalType):
            c["scale"] = f.dataType.scale
        made.append(c)
    return {"columns": made}
