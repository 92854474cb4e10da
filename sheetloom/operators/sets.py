"""Set operations on numbers, pairs and result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    return a.select(*columns).intersect(b.select(*columns))


def only_in_first(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    return a.select(*columns).subtract(b.select(*columns))


def symmetric(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Pairs in both directions, once each."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    return pairs.select(a, b, *rest).unionAll(pairs.select(F.col(b).alias(a), F.col(a).alias(b), *rest)).distinct()


def all_of(*tables: DataFrame) -> DataFrame:
    """The rows of all tables, columns matched by name, missing ones null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def first_of_each(values: str):
    """An array without repeats, in the order of first places."""
    return F.array_distinct(values)
