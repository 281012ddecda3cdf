"""Bound predicates to Column expressions.

Literals are cast to the column's type, never the column, so that comparisons reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.fuzzy import fuzzy_match
from tessera.plans.binding import bind, normalise
from tessera.plans.predicate import Always, And, Between, Compare, Fuzzy, Not, Or, Outside, Predicate


def literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.lit(bytes(value))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.lit(float(value)).cast(kind)
    return F.lit(value).cast(kind)


def _number(c: Column, kind: T.DataType, test: Column) -> Column:
    """NaN is in no range."""
    return ~F.isnan(c) & test if isinstance(kind, (T.FloatType, T.DoubleType)) else test


def to_column(p: Predicate, schema: T.StructType) -> Column:
    """The Column of a bound, normalised predicate."""
    match p:
        case Always(v):
            return F.lit(v)
        case And(a, b):
            return to_column(a, schema) & to_column(b, schema)
        case Or(a, b):
            return to_column(a, schema) | to_column(b, schema)
        case Not(a):
            return ~F.coalesce(to_column(a, schema), F.lit(False))
    kind = schema[p.column].dataType
    c = F.col(f"`{p.column}`")
    match p:
        case Compare(_, op, v):
            v = literal(v, kind)
            if op == "eq":
                return c == v
            if op == "ne":
                return c != v
            return _number(c, kind, {"gt": c > v, "ge": c >= v, "lt": c < v, "le": c <= v}[op])
        case Between(_, low, high, lc, hc):
            a, b = literal(low, kind), literal(high, kind)
            return _number(c, kind, ((c >= a) if lc else (c > a)) & ((c <= b) if hc else (c < b)))
        case Outside(_, low, high):
            return _number(c, kind, (c < literal(low, kind)) | (c > literal(high, kind)))
        case Fuzzy(_, key, n):
            return fuzzy_match(c, key, n)
    raise TypeError(p)


def compile_predicate(p: Predicate, schema: T.StructType, strict_index: bool = False) -> Column:
    """Checks, normalises and compiles a predicate."""
    return to_column(normalise(bind(p, schema, strict_index)), schema)
