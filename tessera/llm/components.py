"""Connected components by alternating large-star and small-star rounds over a table of links.

Every round is a few exchanges of the link table, written to the shared folder; nothing is gathered on
the driver. A node's neighbours are only reduced to a minimum by window functions, never listed, and the number of rounds grows with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._util import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours above a node link to the least of its neighbourhood; small star: those below."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    on = both.join(least, "u")
    if large:
        made = on.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = on.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return made.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v): root is the least node of its component."""
    links = materialise(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        links = materialise(_star(_star(links, True), False), "links")
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
