"""The binary form of a predicate, in little-endian order.

A composition is its code and two predicates. A filter is its code, the column's position (int), the
operation, the type of its operands, and the operands: one, or two for a range; a fuzzy search has a key and
the least length (int). Texts (UTF-8) follow their length in bytes as an int, bytes as a long.
Negations and the outside of a range have no binary form: JSON holds these.
"""

from __future__ import annotations

import decimal
import struct

from pyspark.sql import types as T

from tessera.errors import OperationNotSupported, SchemaError, UnknownColumn
from tessera.plans.predicate import And, Between, Compare, Fuzzy, Or, Predicate

# Fixed values of the format: codes of nodes, operations and types.
AND, OR, FILTER = 1, 2, 3
FUZZY = 64
COMPARE = {"eq": 1, "ne": 2, "gt": 4, "ge": 4 | 16, "lt": 8, "le": 8 | 32}
RANGE = {(True, True): 4 | 8 | 16 | 32, (True, False): 4 | 8 | 16, (False, True): 4 | 8 | 32, (False, False): 4 | 8}
COMPARABLE, NUMERIC, STATIC = 1 << 31, 1 << 30, 1 << 29
TYPES = {
    T.IntegerType: 1 << 14 | COMPARABLE | NUMERIC | STATIC,
    T.LongType: 1 << 15 | COMPARABLE | NUMERIC | STATIC,
    T.FloatType: 1 << 16 | COMPARABLE | NUMERIC | STATIC,
    T.DoubleType: 1 << 17 | COMPARABLE | NUMERIC | STATIC,
    T.StringType: 1 << 18 | COMPARABLE,
    T.BinaryType: 1 << 19,
    T.DecimalType: 1 << 20 | COMPARABLE | NUMERIC | STATIC,
}

_KINDS = {code: kind for kind, code in TYPES.items()}
_COMPARISONS = {code: op for op, code in COMPARE.items()}
_RANGES = {code: closed for closed, code in RANGE.items()}
_PLAIN = {T.IntegerType: "<i", T.LongType: "<q", T.FloatType: "<f", T.DoubleType: "<d"}


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise SchemaError(f"{n} bytes wanted at {self.at} of {len(self.raw)}")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def value(self, kind: type[T.DataType]):
        if kind in _PLAIN:
            return self.number(_PLAIN[kind])
        if kind is T.StringType:
            try:
                return self.take(self.number("<i")).decode()
            except UnicodeDecodeError as bad:
                raise SchemaError(str(bad)) from bad
        if kind is T.BinaryType:
            return self.take(self.number("<q"))
        # A decimal: sign in bit 31 and scale in bits 16 to 23 of the flags, then the high and the low part.
        flags, high, low = struct.unpack("<IIQ", self.take(16))
        with decimal.localcontext(prec=40):
            size = decimal.Decimal(high << 64 | low).scaleb(-(flags >> 16 & 0xFF))
            return -size if flags >> 31 else size


def _predicate(r: _Reader) -> Predicate:
    code = r.number("<I")
    if code in (AND, OR):
        left = _predicate(r)
        return (And if code == AND else Or)(left, _predicate(r))
    if code != FILTER:
        raise SchemaError(f"unknown node {code}")
    column, op, mask = r.number("<i"), r.number("<I"), r.number("<I")
    if mask not in _KINDS:
        raise SchemaError(f"unknown type {mask:#x}")
    first = r.value(_KINDS[mask])
    if op in _COMPARISONS:
        return Compare(column, _COMPARISONS[op], first)
    if op in _RANGES:
        return Between(column, first, r.value(_KINDS[mask]), *_RANGES[op])
    if op == FUZZY:
        return Fuzzy(column, first, r.number("<i"))
    raise OperationNotSupported(f"operation {op}")


def from_bytes(raw: bytes) -> Predicate:
    """The predicate of a binary form; columns are positions."""
    r = _Reader(bytes(raw))
    try:
        out = _predicate(r)
    except RecursionError:
        raise SchemaError("nested too deeply") from None
    if r.at != len(r.raw):
        raise SchemaError(f"{len(r.raw) - r.at} bytes after the predicate")
    return out


def _plain(value, kind: type[T.DataType]) -> bytes:
    if kind in _PLAIN:
        return struct.pack(_PLAIN[kind], value)
    if kind is T.StringType:
        raw = value.encode()
        return struct.pack("<i", len(raw)) + raw
    if kind is T.BinaryType:
        return struct.pack("<q", len(value)) + bytes(value)
    sign, digits, exponent = decimal.Decimal(value).as_tuple()
    size = int("".join(map(str, digits))) * 10 ** max(exponent, 0)
    if size >> 96 or exponent < -28:
        raise SchemaError(f"{value} does not fit 96 bits and 28 places")
    return struct.pack("<IIQ", sign << 31 | max(-exponent, 0) << 16, size >> 64, size & 0xFFFFFFFFFFFFFFFF)


def to_bytes(p: Predicate, schema: T.StructType) -> bytes:
    """The binary form of a predicate over a table of ``schema``."""

    def leaf(column, op: int, *values) -> bytes:
        at = column if isinstance(column, int) else schema.names.index(column) if column in schema.names else -1
        if not 0 <= at < len(schema.fields):
            raise UnknownColumn(str(column))
        kind = type(schema.fields[at].dataType)
        if kind not in TYPES:
            raise OperationNotSupported(f"{kind.__name__} has no binary form")
        return struct.pack("<IiII", FILTER, at, op, TYPES[kind]) + b"".join(_plain(v, kind) for v in values)

    match p:
        case And(a, b):
            return struct.pack("<I", AND) + to_bytes(a, schema) + to_bytes(b, schema)
        case Or(a, b):
            return struct.pack("<I", OR) + to_bytes(a, schema) + to_bytes(b, schema)
        case Compare(c, op, v):
            return leaf(c, COMPARE[op], v)
        case Between(c, low, high, lc, hc):
            return leaf(c, RANGE[lc, hc], low, high)
        case Fuzzy(c, key, n):
            return leaf(c, FUZZY, key) + struct.pack("<i", n)
    raise OperationNotSupported(f"{type(p).__name__} has no binary form")
