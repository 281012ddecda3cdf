"""Binding and rewriting: predicates checked against a schema, then brought to normal form."""

from __future__ import annotations

import decimal
import math
from dataclasses import replace

from pyspark.sql import types as T

from tessera.errors import MismatchedDataType, OperationNotSupported, UnknownColumn
from tessera.plans.predicate import Always, And, Between, Compare, Fuzzy, Not, Or, Outside, Predicate
from tessera.schema import is_numeric, is_sequence

_RANGES = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def resolve(schema: T.StructType, column: str | int) -> T.StructField:
    """The field of a name or position."""
    if isinstance(column, int):
        if not 0 <= column < len(schema.fields):
            raise UnknownColumn(column)
        return schema.fields[column]
    if column not in schema.fieldNames():
        raise UnknownColumn(column)
    return schema[column]


def check_literal(field: T.StructField, value) -> None:
    """Literals must have the column's type; no silent casts."""
    kind, ok = field.dataType, False
    if type(kind) in _RANGES:
        half = 1 << (_RANGES[type(kind)] - 1)
        ok = isinstance(value, int) and not isinstance(value, bool) and -half <= value < half
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        ok = isinstance(value, (int, float)) and not isinstance(value, bool)
    elif isinstance(kind, T.DecimalType):
        ok = isinstance(value, (decimal.Decimal, int)) and not isinstance(value, bool)
    elif isinstance(kind, T.StringType):
        ok = isinstance(value, str)
    elif isinstance(kind, T.BinaryType):
        ok = isinstance(value, (bytes, bytearray))
    if not ok:
        raise MismatchedDataType(f"column {field.name!r} is {kind.simpleString()}, the operand is {value!r}")


def bind(p: Predicate, schema: T.StructType, strict_index: bool = False) -> Predicate:
    """The same predicate with column names for positions, after all checks.

    With ``strict_index``, leaves need an index that serves them: any for equality, an ordered one for
    ranges, a fuzzy one for fuzzy search.
    """
    match p:
        case And(a, b):
            return And(bind(a, schema, strict_index), bind(b, schema, strict_index))
        case Or(a, b):
            return Or(bind(a, schema, strict_index), bind(b, schema, strict_index))
        case Not(a):
            return Not(bind(a, schema, strict_index))
        case Always():
            return p
        case Compare(c, op, v):
            field = resolve(schema, c)
            check_literal(field, v)
            if op not in ("eq", "ne") and not is_numeric(field.dataType):
                raise OperationNotSupported(f"{op} on {field.dataType.simpleString()} column {field.name!r}")
            _index(field, ("generic", "btree", "fuzzy") if op in ("eq", "ne") else ("btree",), strict_index)
        case Between(c, low, high) | Outside(c, low, high):
            field = resolve(schema, c)
            check_literal(field, low)
            check_literal(field, high)
            if not is_numeric(field.dataType):
                raise OperationNotSupported(f"range on {field.dataType.simpleString()} column {field.name!r}")
            _index(field, ("btree",), strict_index)
        case Fuzzy(c, key, _):
            field = resolve(schema, c)
            if not is_sequence(field.dataType):
                raise OperationNotSupported(f"fuzzy search on {field.dataType.simpleString()} column {field.name!r}")
            check_literal(field, key)
            _index(field, ("fuzzy",), strict_index)
        case _:
            raise TypeError(p)
    return replace(p, column=field.name)


def _index(field: T.StructField, serves: tuple[str, ...], strict: bool) -> None:
    if strict and (field.metadata or {}).get("indexer", "none") not in serves:
        raise OperationNotSupported(f"column {field.name!r} has no index for this")


def _nan(*values) -> bool:
    return any(isinstance(v, float) and math.isnan(v) for v in values)


def normalise(p: Predicate) -> Predicate:
    """Swaps reversed bounds, fuses two bounds on one column into a range, removes contradictions."""
    match p:
        case Between(c, low, high, lc, hc):
            if _nan(low, high):
                return Always(False)
            if low > high:
                low, high, lc, hc = high, low, hc, lc
            return Always(False) if low == high and not (lc and hc) else Between(c, low, high, lc, hc)
        case Outside(c, low, high):
            return replace(p, low=high, high=low) if not _nan(low, high) and low > high else p
        case Compare(_, op, v) if op in ("gt", "ge", "lt", "le") and _nan(v):
            return Always(False)
        case Not(a):
            a = normalise(a)
            return Always(not a.value) if isinstance(a, Always) else Not(a)
        case And(a, b):
            a, b = normalise(a), normalise(b)
            for x, y in ((a, b), (b, a)):
                if isinstance(x, Always):
                    return y if x.value else x
            return fuse(a, b)
        case Or(a, b):
            a, b = normalise(a), normalise(b)
            for x, y in ((a, b), (b, a)):
                if isinstance(x, Always):
                    return x if x.value else y
            return Or(a, b)
    return p


def _bounds(p: Predicate):
    """(column, low, low closed, high, high closed) of a leaf that is a range; None for an open side."""
    match p:
        case Compare(c, "gt", v):
            return c, v, False, None, False
        case Compare(c, "ge", v):
            return c, v, True, None, False
        case Compare(c, "lt", v):
            return c, None, False, v, False
        case Compare(c, "le", v):
            return c, None, False, v, True
        case Between(c, low, high, lc, hc):
            return c, low, lc, high, hc
    return None


def fuse(a: Predicate, b: Predicate) -> Predicate:
    """The intersection of two ranges on one column, else their conjunction."""
    x, y = _bounds(a), _bounds(b)
    if x is None or y is None or x[0] != y[0]:
        return And(a, b)
    lows = [(v, not closed) for v, closed in ((x[1], x[2]), (y[1], y[2])) if v is not None]
    highs = [(v, closed) for v, closed in ((x[3], x[4]), (y[3], y[4])) if v is not None]
    low = max(lows) if lows else None  # of equal bounds the open one is tighter
    high = min(highs) if highs else None
    if low and high:
        if low[0] > high[0] or (low[0] == high[0] and (low[1] or not high[1])):
            return Always(False)
        return Between(x[0], low[0], high[0], not low[1], high[1])
    if low:
        return Compare(x[0], "gt" if low[1] else "ge", low[0])
    return Compare(x[0], "le" if high[1] else "lt", high[0])
