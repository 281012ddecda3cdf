"""Scalar arithmetic and inspection as Column helpers, with fixed rules whatever the session's ANSI mode.

Integers wrap around, integer division truncates, division of floats by zero gives an infinity or NaN, and
mixed numbers widen (an integer with a float stays a float). Integer division or remainder by zero is null.
"""

from __future__ import annotations

import decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _wide(a: T.DataType, b: T.DataType) -> T.DataType:
    """The result type of an arithmetic operation."""
    for kind in (T.DoubleType, T.FloatType, T.DecimalType, T.LongType):
        if isinstance(a, kind):
            return a
        if isinstance(b, kind):
            return b
    return T.IntegerType()


def _wrapped(value: Column, bits: int) -> Column:
    """A decimal brought into the two's complement range."""
    span, half = F.lit(decimal.Decimal(1 << bits)).cast("decimal(38,0)"), F.lit(decimal.Decimal(1 << (bits - 1))).cast("decimal(38,0)")
    return F.pmod(value + half, span) - half


def _exact(op, a: Column, b: Column, kind: T.DataType, checked=None) -> Column:
    """The wrapped result; 64-bit operands take the way over decimals only where ``checked`` finds an overflow."""
    bits = 64 if isinstance(kind, T.LongType) else 32
    if bits == 32:  # the exact result of 32-bit operands fits 64 bits
        r = op(a.cast("bigint"), b.cast("bigint"))
        return (F.pmod(r + (1 << 31), F.lit(1 << 32)) - (1 << 31)).cast("int")
    wrapped = _wrapped(op(a.cast("decimal(19,0)"), b.cast("decimal(19,0)")).cast("decimal(38,0)"), 64).cast("bigint")
    return F.coalesce(checked(a.cast("bigint"), b.cast("bigint")), wrapped) if checked else wrapped


def _binary(op, a: Column, b: Column, ta: T.DataType, tb: T.DataType, checked=None) -> Column:
    kind = _wide(ta, tb)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return _exact(op, a, b, kind, checked)
    return op(a.cast(kind), b.cast(kind))


def add(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    """Sum; text plus anything is concatenation."""
    if isinstance(ta, T.StringType) or isinstance(tb, T.StringType):
        return F.concat(a.cast("string"), b.cast("string"))
    return _binary(lambda x, y: x + y, a, b, ta, tb, F.try_add)


def sub(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    return _binary(lambda x, y: x - y, a, b, ta, tb, F.try_subtract)


def mul(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    if isinstance(_wide(ta, tb), T.LongType):  # beyond 64 bits the full product needs 38 digits, so halves are multiplied
        low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
        dec = lambda c: c.cast("decimal(19,0)")
        x, y = a.cast("bigint"), b.cast("bigint")
        cross = _wrapped((dec(F.shiftright(x, 32)) * dec(low(y)) + dec(low(x)) * dec(F.shiftright(y, 32))).cast("decimal(38,0)"), 32).cast("bigint")
        wrapped = _wrapped((dec(low(x)) * dec(low(y))).cast("decimal(38,0)") + F.shiftleft(cross, 32).cast("decimal(38,0)"), 64).cast("bigint")
        return F.coalesce(F.try_multiply(x, y), wrapped)
    return _binary(lambda x, y: x * y, a, b, ta, tb)


def div(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    kind = _wide(ta, tb)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        safe = F.nullif(b.cast("bigint"), F.lit(0))
        least = F.lit(-(1 << 63))
        x = a.cast("bigint")
        return F.when((x == least) & (safe == -1), least).otherwise(_quotient(x, safe)).cast(kind)
    x, y = a.cast(kind), b.cast(kind)
    if isinstance(kind, T.DecimalType):
        return x / F.nullif(y, F.lit(0))
    # -0.0 divides to the other infinity, which its text tells.
    sign = F.when(F.startswith(y.cast("string"), F.lit("-")), -1.0).otherwise(1.0)
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, sign * float("inf")).otherwise(sign * float("-inf"))
    return F.when(y == 0, by_zero.cast(kind)).otherwise((x / F.nullif(y, F.lit(0.0))).cast(kind))


def _quotient(x: Column, y: Column) -> Column:
    # x - x % y is a multiple of y, so the decimal quotient is exact.
    return ((x - x % y).cast("decimal(20,0)") / y.cast("decimal(20,0)")).cast("bigint")


def mod(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    """Remainder with the sign of the dividend."""
    kind = _wide(ta, tb)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(b.cast(kind) == 0, F.lit(float("nan")).cast(kind)).otherwise(a.cast(kind) % F.nullif(b.cast(kind), F.lit(0.0)))
    return (a.cast(kind) % F.nullif(b.cast(kind), F.lit(0).cast(kind))).cast(kind)


def neg(a: Column, ta: T.DataType) -> Column:
    return sub(F.lit(0), a, T.IntegerType(), ta) if isinstance(ta, _INTS) else -a


def increment(a: Column, ta: T.DataType) -> Column:
    return add(a, F.lit(1), ta, T.IntegerType())


def decrement(a: Column, ta: T.DataType) -> Column:
    return sub(a, F.lit(1), ta, T.IntegerType())


def absolute(a: Column, ta: T.DataType) -> Column:
    return F.when(a < 0, neg(a, ta)).otherwise(a) if isinstance(ta, _INTS) else F.abs(a)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; NaN is below everything and equals itself."""
    x, y = a, b
    low = lambda c: F.isnan(c.cast("double"))
    return F.when(low(x) & low(y), 0).when(low(x), -1).when(low(y), 1).when(x < y, -1).when(x > y, 1).otherwise(0)


def _whole_long(a: Column, ta: T.DataType) -> Column:
    """The value as a long where it is a whole number in range, else null."""
    if isinstance(ta, _INTS):
        return a.cast("bigint")
    d = a.cast("double")
    return F.when(~F.isnan(d) & (d >= -(2.0**63)) & (d < 2.0**63) & (d == F.rint(d)), d.try_cast("bigint"))


def equal(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    """Equality over mixed numbers: 1 equals 1.0, exactly also beyond 2^53; NaN equals itself, text only text."""
    if isinstance(ta, T.StringType) or isinstance(tb, T.StringType):
        return a.eqNullSafe(b) if type(ta) is type(tb) else F.lit(False)
    if isinstance(ta, _INTS) == isinstance(tb, _INTS):
        return F.coalesce(a == b, F.lit(False))
    return F.coalesce(_whole_long(a, ta) == _whole_long(b, tb), F.lit(False))


def number_hash(a: Column, ta: T.DataType) -> Column:
    """A hash that equal numbers share, whatever their types."""
    whole = _whole_long(a, ta)
    return F.when(whole.isNotNull(), F.xxhash64(whole)).otherwise(F.xxhash64(a.cast("double")))


def is_integer(a: Column, ta: T.DataType) -> Column:
    return F.lit(True) if isinstance(ta, _INTS) else is_finite(a) & (a % 1 == 0)


def is_even_integer(a: Column, ta: T.DataType) -> Column:
    return is_integer(a, ta) & (a % 2 == 0)


def is_odd_integer(a: Column, ta: T.DataType) -> Column:
    return is_integer(a, ta) & (F.abs(a % 2) == 1)


def is_nan(a: Column) -> Column:
    return F.isnan(a.cast("double"))


def is_infinity(a: Column) -> Column:
    return F.abs(a.cast("double")) == float("inf")


def is_positive_infinity(a: Column) -> Column:
    return a.cast("double") == float("inf")


def is_negative_infinity(a: Column) -> Column:
    return a.cast("double") == float("-inf")


def is_finite(a: Column) -> Column:
    return ~is_nan(a) & ~is_infinity(a)


def is_negative(a: Column) -> Column:
    """The sign bit: true for -0.0 as well."""
    return F.startswith(a.cast("string"), F.lit("-"))


def is_positive(a: Column) -> Column:
    return ~is_negative(a)


def is_zero(a: Column) -> Column:
    return a == 0


def is_normal(a: Column, ta: T.DataType) -> Column:
    least = 2.0**-126 if isinstance(ta, T.FloatType) else 2.0**-1022
    return is_finite(a) & ((F.abs(a.cast("double")) >= least) if isinstance(ta, (T.FloatType, T.DoubleType)) else a != 0)


def is_subnormal(a: Column, ta: T.DataType) -> Column:
    return is_finite(a) & ~is_zero(a) & ~is_normal(a, ta)


def is_real_number(a: Column) -> Column:
    return ~is_nan(a)


def is_canonical(a: Column) -> Column:
    """True: a number has one form here."""
    return F.lit(True)


def is_complex_number(a: Column) -> Column:
    """False: no number here has an imaginary part beside a real one."""
    return F.lit(False)


def is_imaginary_number(a: Column) -> Column:
    return F.lit(False)


def max_magnitude(a: Column, b: Column) -> Column:
    """The operand further from zero, the greater of equals; NaN wins."""
    x, y = F.abs(a), F.abs(b)
    return F.when(is_nan(a), a).when(is_nan(b), b).when(x > y, a).when(x < y, b).otherwise(F.greatest(a, b))


def min_magnitude(a: Column, b: Column) -> Column:
    x, y = F.abs(a), F.abs(b)
    return F.when(is_nan(a), a).when(is_nan(b), b).when(x < y, a).when(x > y, b).otherwise(F.least(a, b))


def max_magnitude_number(a: Column, b: Column) -> Column:
    """As :func:`max_magnitude`, but a number wins over NaN."""
    return F.when(is_nan(a), b).when(is_nan(b), a).otherwise(max_magnitude(a, b))


def min_magnitude_number(a: Column, b: Column) -> Column:
    return F.when(is_nan(a), b).when(is_nan(b), a).otherwise(min_magnitude(a, b))


def parse(text: Column) -> Column:
    """(as_long, as_double): a whole number if it is one, else a double, else both null."""
    whole = text.try_cast("bigint")
    whole = F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), whole)
    return F.struct(whole.alias("as_long"), F.when(whole.isNull(), text.try_cast("double")).alias("as_double"))


def to_text(a: Column, ta: T.DataType) -> Column:
    """Text of a value; bytes as upper-case hex."""
    return F.hex(a) if isinstance(ta, T.BinaryType) else a.cast("string")


def digest(a: Column, method: str = "sha256") -> Column:
    """md5, sha256, sha512, xxh128 or blake2b as lower-case hex, or xxhash64 as a long.

    Spark has no xxh128 and blake2b, so these two go through Python in Arrow batches.
    """
    if method == "xxhash64":
        return F.xxhash64(a)
    if method == "md5":
        return F.md5(a)
    if method in ("xxh128", "blake2b"):
        return _arrow_digest(method)(a.cast("binary"))
    return F.sha2(a, int(method.removeprefix("sha")))


def _arrow_digest(method: str):
    import hashlib

    import pyarrow as pa

    if method == "xxh128":
        import xxhash

        one = xxhash.xxh3_128_hexdigest
    else:

        def one(value: bytes) -> str:
            return hashlib.blake2b(value).hexdigest()

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else one(v) for v in values.to_pylist()], pa.string())

    # Set out, as postponed annotations of local names are not resolved.
    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.StringType())
