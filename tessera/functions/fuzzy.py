"""Trigram fuzzy matching as Column expressions, without user-defined functions.

A gram without padding is held by the values that contain it, one padded before or after by those that begin or
end with it: comparisons that generated code evaluates, without an array of the value's grams.

A key has an ordered list of (gram, length) pairs, padded with a character that no text holds. The query's
grams are walked in order, with repeats; each one that the column's value has adds its length. A value
matches if a gram matched and the total before the last matched gram reached ``min_length``; the
score is the total.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.files import write_ordered

#: Pads strings; bytes are handled as two hex digits a unit, where no unit reads like the pad.
PAD, PAD_HEX = "\ue000", "zz"


def grams(units: list[str], pad: str) -> list[tuple[str, int]]:
    """The grams of a key in order, with the number of its own units in each."""
    n = len(units)
    p = pad
    if n == 0:
        return []
    if n == 1:
        (a,) = units
        return [(a + p + p, 1), (p + a + p, 1), (p + p + a, 1)]
    if n == 2:
        a, b = units
        return [(b + p + p, 1), (a + b + p, 2), (p + a + b, 2), (p + p + a, 1)]
    inner = [("".join(units[i : i + 3]), 3) for i in range(n - 2)]
    return [*inner, (p + units[0] + units[1], 2), (p + p + units[0], 1), (units[-2] + units[-1] + p, 2), (units[-1] + p + p, 1)]


def key_grams(key: str | bytes) -> list[tuple[str, int]]:
    if isinstance(key, str):
        return grams(list(key), PAD)
    return grams([f"{b:02X}" for b in bytes(key)], PAD_HEX)


def column_grams(value: Column, binary: bool = False) -> Column:
    """The column's grams as an array of strings (no lengths: equality ignores them)."""
    width, pad = (2, PAD_HEX) if binary else (1, PAD)
    text = F.hex(value) if binary else value
    n = (F.length(text) / width).cast("int")
    unit = lambda i, k: F.substring(text, i * width - (width - 1), F.lit(k * width))
    p, pp = F.lit(pad), F.lit(pad + pad)
    one, last = unit(F.lit(1), 1), unit(n, 1)
    inner = F.transform(F.sequence(F.lit(1), n - 2), lambda i: unit(i, 3))
    ends = F.array(F.concat(p, unit(F.lit(1), 2)), F.concat(pp, one), F.concat(unit(n - 1, 2), p), F.concat(last, pp))
    return (
        F.when(n >= 3, F.concat(inner, ends))
        .when(n == 2, F.array(F.concat(last, pp), F.concat(text, p), F.concat(p, text), F.concat(pp, one)))
        .when(n == 1, F.array(F.concat(text, pp), F.concat(p, text, p), F.concat(pp, text)))
        .otherwise(F.array().cast("array<string>"))
    )


def matched(value: Column, key: str | bytes) -> Column | None:
    """The query grams that the value has, as an array of (g, l); None for an empty key."""
    wanted = key_grams(key)
    if not wanted:
        return None
    literal = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(n).alias("l")) for g, n in wanted])
    have = column_grams(value, isinstance(key, (bytes, bytearray)))
    return F.filter(literal, lambda x: F.array_contains(have, x["g"]))


def total(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda acc, x: acc + x["l"])


#: Grams of a key up to which each is a comparison of its own; longer keys look grams up in an array.
COMPARED = 96


def _tests(value: Column, key: str | bytes) -> list[tuple[Column, int]] | None:
    """Per gram of the key in order, whether the value has it, and its length; None for bytes and long keys."""
    wanted = key_grams(key)
    if not isinstance(key, str) or len(wanted) > COMPARED:
        return None
    made = []
    for gram, n in wanted:
        core, before, after = F.lit(gram.strip(PAD)), gram.startswith(PAD), gram.endswith(PAD)
        test = value == core if before and after else F.startswith(value, core) if before else F.endswith(value, core) if after else F.contains(value, core)
        made.append((test, n))
    return made


def _sum(tests: list[tuple[Column, int]]) -> Column:
    out = F.lit(0)
    for test, n in tests:
        out = out + F.when(test, n).otherwise(0)
    return out


def fuzzy_match(value: Column, key: str | bytes, min_length: int = -1) -> Column:
    """Whether the value matches the key."""
    if tests := _tests(value, key):
        last = F.coalesce(*[F.when(test, n) for test, n in reversed(tests)])
        return F.coalesce(_sum(tests) - last >= min_length, F.lit(False))
    hits = matched(value, key)
    if hits is None:
        return F.lit(False)
    return F.coalesce((F.size(hits) > 0) & (total(hits) - F.try_element_at(hits, F.lit(-1))["l"] >= min_length), F.lit(False))


def fuzzy_score(value: Column, key: str | bytes) -> Column:
    """The matched length; 0 without a shared gram."""
    if tests := _tests(value, key):
        return _sum(tests)
    hits = matched(value, key)
    return F.lit(0) if hits is None else F.coalesce(total(hits), F.lit(0))


def gram_index(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The inverted table (gram, id) of a string column, each pair once."""
    return df.select(F.col(id_col), F.explode(F.array_distinct(column_grams(F.col(text_col)))).alias("gram"))


def store_index(df: DataFrame, id_col: str, text_col: str, path: str, partitions: int | None = None) -> DataFrame:
    """:func:`gram_index` in files ordered by (gram, id), read again.

    A search skips all row groups without one of its grams; the postings of a frequent gram fill several files.
    """
    index = gram_index(df, id_col, text_col).select("gram", id_col)
    write_ordered(index, path, ["gram", id_col], partitions)
    return df.sparkSession.read.schema(index.schema).parquet(path)


def search_index(index: DataFrame, id_col: str, key: str, min_length: int = -1) -> DataFrame:
    """(id, matched_length) of the rows of :func:`gram_index` that match ``key``.

    For long texts or many queries over one table: only the query's grams are read from the index. The
    broadcast side holds the grams of one key.
    """
    wanted = key_grams(key)
    spark = index.sparkSession
    if not wanted:
        return index.select(id_col, F.lit(0).cast("bigint").alias("matched_length")).limit(0)
    rows = spark.createDataFrame([(i, g, n) for i, (g, n) in enumerate(wanted)], "i int, gram string, l int")
    # One equality per gram: a long list would reach the scan as the range from the least gram to the greatest.
    any_gram = functools.reduce(Column.__or__, [F.col("gram") == g for g in sorted({g for g, _ in wanted})])
    hits = index.filter(any_gram).join(F.broadcast(rows), "gram")
    found = hits.groupBy(id_col).agg(F.sum("l").alias("matched_length"), F.max_by("l", "i").alias("last"))
    return found.filter(F.col("matched_length") - F.col("last") >= min_length).select(id_col, "matched_length")
