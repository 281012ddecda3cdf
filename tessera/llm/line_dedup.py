"""Site-relative line deduplication, with DataFrame functions only.

Per host, the pages containing a line are divided by the pages of the host; lines above ``max_ratio``
(on at least ``min_pages`` pages, two by default: a line on one page repeats nothing) are boilerplate and go
from every page of that host. Lines are compared after trimming blanks; lines without other characters are
kept and never counted.

Defined cases: null text stays null, is a page of its host and has no lines; null host is a host of
its own; a line that repeats within a page counts one page; repeated rows are pages of their own;
extra columns pass through untouched, whatever their names (one called like a reported count comes back as
``<name>_in``); an empty table stays empty; long texts are split like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._util import at, beside, materialise, numbered

#: Boilerplate entries up to which they are broadcast (24 bytes each); beyond, the join shuffles.
BROADCAST_ENTRIES = 200_000
_KEYS = "array<struct<a:bigint,b:bigint>>"


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\x0c"))


def _hash(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes, of the text alone and of the text after a one."""
    return F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")


def _key(line: Column) -> Column:
    """128 bits of the trimmed line; null for a blank line."""
    t = _trimmed(line)
    return F.when(t != "", F.struct(*_hash(t)))


def _host(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def _page_keys(text: Column) -> Column:
    """The keys of a page's lines, each once."""
    keys = F.filter(F.array_distinct(F.transform(F.split(text, "\n"), _key)), lambda k: k.isNotNull())
    return F.coalesce(keys, F.array().cast(_KEYS))


def boilerplate_lines(pages: DataFrame, host: Column, text: Column, max_ratio: float, min_pages: int = 2, copies_once: bool = False) -> DataFrame:
    """(host, k): the key of every boilerplate line of every host.

    With ``copies_once``, pages of one host and text count as one page, in a line's pages and in the host's.

    Only 16-byte line keys are shuffled, summed before the exchange.
    """
    src = pages.select(_host(host).alias("host"), _page_keys(text).alias("keys"), *(_hash(text) if copies_once else []))
    if copies_once:
        src = src.dropDuplicates(["host", "a", "b"])
    # One pass serves both counts: a null key stands for the page itself.
    marks = F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:bigint>")), F.col("keys"))
    counted = src.select("host", F.explode(marks).alias("k")).groupBy("host", "k").agg(F.count(F.lit(1)).alias("n"))
    many = materialise(counted.filter((F.col("n") >= min_pages) | F.col("k").isNull()), "line-counts")
    total = many.filter("k is null").select("host", F.col("n").alias("pages"))
    return many.filter("k is not null").join(total, "host").filter(F.col("n") > F.lit(max_ratio) * F.col("pages")).select("host", "k")


def _by_broadcast(pages: DataFrame, flagged: DataFrame, host: str) -> DataFrame:
    """``pages`` plus gone, the boilerplate of the page's host (null: none)."""
    lists = flagged.groupBy("host").agg(F.collect_list("k").alias("gone"))
    return pages.withColumn("host", _host(F.col(host))).join(F.broadcast(lists), "host", "left").drop("host")


def _by_exchange(pages: DataFrame, flagged: DataFrame, host: str, text: str) -> DataFrame:
    """As :func:`_by_broadcast`, with the boilerplate that the page itself holds.

    Page lines meet boilerplate by (host, line), in rows of fixed size, so a large host is many keys; texts
    move once, by their row number.
    """
    held = materialise(pages.withColumn("row", F.monotonically_increasing_id()), "pages")
    lines = held.select("row", _host(F.col(host)).alias("host"), F.explode(_page_keys(F.col(text))).alias("k"))
    found = lines.join(flagged, ["host", "k"], "left_semi").groupBy("row").agg(F.collect_list("k").alias("gone"))
    return held.join(found, "row", "left").drop("row")


def drop_boilerplate(pages: DataFrame, host_col: str, text_col: str, max_ratio: float = 0.02, min_pages: int = 2, report: bool = False, copies_once: bool = False) -> DataFrame:
    """``pages`` with the boilerplate lines taken out of ``text_col``.

    With ``report``, also n_lines (lines with other than blanks) and n_dropped. The texts themselves
    are shuffled only where the boilerplate entries exceed the broadcast bound. With ``copies_once``, a
    group of copied pages does not make its lines boilerplate.
    """
    plain, host, text = numbered(pages), at(pages, host_col), at(pages, text_col)
    flagged = materialise(boilerplate_lines(plain, F.col(host), F.col(text), max_ratio, min_pages, copies_once), "boilerplate")
    on = _by_broadcast(plain, flagged, host) if flagged.count() <= BROADCAST_ENTRIES else _by_exchange(plain, flagged, host, text)
    lines = F.split(F.col(text), "\n")
    gone = lambda x: F.coalesce(F.array_contains(F.col("gone"), _key(x)), F.lit(False))
    # Pages without boilerplate keep their text as it is, and are not split at all.
    on = on.withColumn("kept", F.when(F.col("gone").isNotNull(), F.filter(lines, lambda x: ~gone(x))))
    names, extra = list(pages.columns), []
    if report:
        with_words = F.coalesce(F.size(F.filter(lines, lambda x: _trimmed(x) != "")), F.lit(0))
        dropped = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("kept"))
        extra = [F.when(F.col(text).isNull(), 0).otherwise(with_words).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped")]
        names = beside(names, ["n_lines", "n_dropped"])
    made = [F.coalesce(F.array_join("kept", "\n"), F.col(c)) if c == text else F.col(c) for c in plain.columns]
    return on.select(*[x.alias(n) for x, n in zip(made, names)], *extra)
