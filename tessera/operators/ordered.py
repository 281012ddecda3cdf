"""Ordered-map access to a table by one key column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.compiler import compile_predicate
from tessera.plans.predicate import Col


class OrderedView:
    """Point and range access, key-ordered iteration and removal over a DataFrame.

    Sorted Parquet files (:func:`tessera.sources.files.write_ordered`) let scans skip row groups.
    """

    def __init__(self, df: DataFrame, key: str):
        self.df, self.key = df, key

    def _where(self, p) -> DataFrame:
        return self.df.filter(compile_predicate(p, self.df.schema))

    def get(self, value) -> DataFrame:
        return self._where(Col(self.key).eq(value))

    def collect_from(self, low, closed: bool = True) -> DataFrame:
        return self._where(Col(self.key).ge(low) if closed else Col(self.key).gt(low))

    def collect_to(self, high, closed: bool = True) -> DataFrame:
        return self._where(Col(self.key).le(high) if closed else Col(self.key).lt(high))

    def collect_between(self, low, high, closed: str = "both") -> DataFrame:
        return self._where(Col(self.key).between(low, high, closed))

    def exclude_range(self, low, high) -> DataFrame:
        return self._where(Col(self.key).outside(low, high))

    def in_order(self, limit: int | None = None, descending: bool = False) -> DataFrame:
        """Key-ordered rows; with ``limit``, only the first ones (no full sort)."""
        made = self.df.orderBy(F.desc(self.key) if descending else F.asc(self.key))
        return made if limit is None else made.limit(limit)

    def remove(self, value) -> OrderedView:
        from tessera.operators.mutation import delete_rows

        return OrderedView(delete_rows(self.df, compile_predicate(Col(self.key).eq(value), self.df.schema)), self.key)
