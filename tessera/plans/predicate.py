"""The predicate language: an immutable tree, and three ways to write it.

``col("a").eq(1) & col("b").between(2, 3)``, ``where(lambda r: (r.a == 1) & (r.b >= 2))`` and JSON all
give the same tree of :class:`And`, :class:`Or`, :class:`Not` and leaves. Columns are names or positions.
"""

from __future__ import annotations

import base64
import decimal
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from tessera.errors import SchemaError

COMPARISONS = ("eq", "ne", "gt", "ge", "lt", "le")
#: What an operation is called when its operands change sides.
FLIPPED = {"eq": "eq", "ne": "ne", "gt": "lt", "ge": "le", "lt": "gt", "le": "ge"}


class Predicate:
    """Base of all nodes; ``&``, ``|`` and ``~`` compose."""

    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)

    def __bool__(self) -> bool:
        raise TypeError("use & and | between predicates, not 'and', 'or' or chained comparisons")


@dataclass(frozen=True)
class And(Predicate):
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Or(Predicate):
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Not(Predicate):
    child: Predicate


@dataclass(frozen=True)
class Compare(Predicate):
    column: str | int
    op: str
    value: Any


@dataclass(frozen=True)
class Between(Predicate):
    """A range; reversed bounds are swapped when bound to a schema (with the closures of their sides)."""

    column: str | int
    low: Any
    high: Any
    low_closed: bool = True
    high_closed: bool = True


@dataclass(frozen=True)
class Outside(Predicate):
    """Everything not within the closed range."""

    column: str | int
    low: Any
    high: Any


@dataclass(frozen=True)
class Fuzzy(Predicate):
    """Trigram similarity to ``key``; see :mod:`tessera.functions.fuzzy`."""

    column: str | int
    key: Any
    min_length: int = -1


@dataclass(frozen=True)
class Always(Predicate):
    """A constant, as rewriting leaves it."""

    value: bool


@dataclass(frozen=True, eq=False)
class Col:
    """A column reference. Comparison operators and named methods make leaves."""

    column: str | int

    def eq(self, value) -> Predicate:
        return Compare(self.column, "eq", value)

    def ne(self, value) -> Predicate:
        return Compare(self.column, "ne", value)

    def gt(self, value) -> Predicate:
        return Compare(self.column, "gt", value)

    def ge(self, value) -> Predicate:
        return Compare(self.column, "ge", value)

    def lt(self, value) -> Predicate:
        return Compare(self.column, "lt", value)

    def le(self, value) -> Predicate:
        return Compare(self.column, "le", value)

    # A literal on the left arrives here reflected by Python: 5 < x calls x.__gt__(5).
    __eq__, __ne__, __gt__, __ge__, __lt__, __le__ = eq, ne, gt, ge, lt, le  # type: ignore[assignment]
    __hash__ = None  # type: ignore[assignment]

    def between(self, low, high, closed: str = "both") -> Predicate:
        """``closed``: both, left, right or neither."""
        if closed not in ("both", "left", "right", "neither"):
            raise ValueError(closed)
        return Between(self.column, low, high, closed in ("both", "left"), closed in ("both", "right"))

    def outside(self, low, high) -> Predicate:
        return Outside(self.column, low, high)

    def fuzzy(self, key, min_length: int = -1) -> Predicate:
        return Fuzzy(self.column, key, min_length)


def col(name: str) -> Col:
    return Col(name)


def col_at(position: int) -> Col:
    return Col(position)


@dataclass(frozen=True)
class Literal:
    """A literal written on the left: ``lit(5) < col("x")``."""

    value: Any

    def _on(self, op: str, other: Col) -> Predicate:
        return Compare(other.column, FLIPPED[op], self.value)

    def __lt__(self, other: Col) -> Predicate:
        return self._on("lt", other)

    def __le__(self, other: Col) -> Predicate:
        return self._on("le", other)

    def __gt__(self, other: Col) -> Predicate:
        return self._on("gt", other)

    def __ge__(self, other: Col) -> Predicate:
        return self._on("ge", other)

    def equals(self, other: Col) -> Predicate:
        return self._on("eq", other)


def lit(value) -> Literal:
    return Literal(value)


class RowProxy:
    """What a ``where`` lambda gets: attributes and items are columns."""

    def __getattr__(self, name: str) -> Col:
        if name.startswith("__"):
            raise AttributeError(name)
        return Col(name)

    def __getitem__(self, key: str | int) -> Col:
        return Col(key)


def from_lambda(f: Callable[[RowProxy], Predicate]) -> Predicate:
    made = f(RowProxy())
    if not isinstance(made, Predicate):
        raise TypeError(f"the lambda gave {type(made).__name__}, not a predicate")
    return made


def _plain(value):
    if isinstance(value, (bytes, bytearray)):
        return {"bytes": base64.b64encode(bytes(value)).decode()}
    if isinstance(value, decimal.Decimal):
        return {"decimal": str(value)}
    return value


def _value(plain):
    if isinstance(plain, dict):
        if "bytes" in plain:
            return base64.b64decode(plain["bytes"])
        if "decimal" in plain:
            return decimal.Decimal(plain["decimal"])
    return plain


def to_json(p: Predicate) -> dict:
    """The wire form of a predicate."""
    match p:
        case And(a, b):
            return {"and": [to_json(a), to_json(b)]}
        case Or(a, b):
            return {"or": [to_json(a), to_json(b)]}
        case Not(a):
            return {"not": to_json(a)}
        case Compare(c, op, v):
            return {"op": op, "column": c, "value": _plain(v)}
        case Between(c, low, high, lc, hc):
            return {"op": "between", "column": c, "low": _plain(low), "high": _plain(high), "closed": {(True, True): "both", (True, False): "left", (False, True): "right", (False, False): "neither"}[lc, hc]}
        case Outside(c, low, high):
            return {"op": "outside", "column": c, "low": _plain(low), "high": _plain(high)}
        case Fuzzy(c, key, n):
            return {"op": "fuzzy", "column": c, "key": _plain(key), "min_length": n}
        case Always(v):
            return {"always": v}
    raise TypeError(p)


def from_json(made: dict) -> Predicate:
    """The predicate of a wire form; lists under ``and``/``or`` may hold any number of children."""
    if "and" in made or "or" in made:
        kind = And if "and" in made else Or
        children = [from_json(x) for x in made.get("and", made.get("or"))]
        if not children:
            raise SchemaError("an empty composition")
        out = children[0]
        for c in children[1:]:
            out = kind(out, c)
        return out
    if "not" in made:
        return Not(from_json(made["not"]))
    if "always" in made:
        return Always(bool(made["always"]))
    op, c = made.get("op"), Col(made["column"])
    if op in COMPARISONS:
        return Compare(c.column, op, _value(made["value"]))
    if op == "between":
        return c.between(_value(made["low"]), _value(made["high"]), made.get("closed", "both"))
    if op == "outside":
        return c.outside(_value(made["low"]), _value(made["high"]))
    if op == "fuzzy":
        return c.fuzzy(_value(made["key"]), made.get("min_length", -1))
    raise SchemaError(f"unknown operation {op!r}")
