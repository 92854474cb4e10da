"""Places of rows in a global order, and the exact k-th key, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, shuffle_width

DIGIT = 11  # bits: a round of the selection brings at most 2**DIGIT counts to the driver


def numbered(rows: DataFrame, order: list[Column], group: str | None = None, name: str = "numbered") -> DataFrame:
    """``rows`` with ``i``, the place from 0 in ``order``, and ``n``, the number of rows; both within ``group``, a column without nulls, if one is given.

    Rows are dealt by ranges of (group, order), so a group of any size is spread; the ranges are written with their number, so that places are
    the same whenever they are asked for. A range is then ranked by itself and set off by the counts of the ranges before it.
    Rows that agree in the whole order may stand in any order. An empty table stays empty. Columns named _at, _m, i or n must not be there.
    """
    keys = [group] if group else []
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), *[F.col(k) for k in keys], *order).withColumn("_at", F.spark_partition_id())
    dealt = materialize(dealt, f"{name}-ranges")
    counts = dealt.groupBy(*keys, "_at").agg(F.count("*").alias("_m"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # as many rows as ranges, and one more for each group
    bases = counts.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_at").alias("_of"), (F.sum("_m").over(own.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")).alias("_base"), F.sum("_m").over(own).alias("n")
    )
    placed = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_at").orderBy(*order)) - 1)
    same = F.col("_at") == F.col("_of")
    for k in keys:
        same &= F.col(k) == F.col(f"_of_{k}")
    return placed.join(bases, same).select(*rows.columns, (F.col("_base") + F.col("_own")).cast("long").alias("i"), F.col("n").cast("long").alias("n"))


def least_keys(rows: DataFrame, key: list[Column], k: int) -> Column:
    """A condition on ``rows`` that holds for the rows up to the k-th least ``key`` (longs without nulls, compared in turn).

    The key is found digit by digit: a round counts the rows below each next digit, of those that share the digits so far, and goes on in the digit that holds
    the k-th. So a few rounds over the bare keys, with ``2**DIGIT`` counts each, find it among any number of rows. Rows that share the k-th key are
    all within, so the condition can hold for more than k rows; it holds for all if there are no more than k, and for none if k is 0.
    """
    if k <= 0:
        return F.lit(False)
    named = rows.select(*[c.alias(f"k{j}") for j, c in enumerate(key)])
    ends = named.agg(*[f(f"k{j}").alias(f"{n}{j}") for j in range(len(key)) for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n")).first()
    if ends.n <= k:
        return F.lit(True)
    left, equal, within = k, F.lit(True), F.lit(False)
    for j, column in enumerate(key):
        lo, hi, at = ends[f"lo{j}"], ends[f"hi{j}"], F.col(f"k{j}")
        shift = 0
        while (hi >> shift) - (lo >> shift) >= 1 << DIGIT:
            shift += 1
        prefix = None
        while True:
            mine = equal if prefix is None else equal & (F.shiftright(at, before) == prefix)
            found = sorted((r.digit, r["count"]) for r in named.where(mine).groupBy(F.shiftright(at, shift).alias("digit")).count().collect())
            for digit, n in found:
                if n >= left:
                    break
                left -= n
            prefix, before = digit, shift
            if n == left or not shift:
                break
            shift = max(0, shift - DIGIT)
        cut = F.shiftright(column, before)
        within = within | (_all(key[:j], chosen) & (cut < prefix)) if j else cut < prefix
        if n == left:  # all rows with these digits are within
            return within | (_all(key[:j], chosen) & (cut == prefix) if j else cut == prefix)
        chosen = [*(chosen if j else []), prefix]
        equal = equal & (at == prefix)
    return within | _all(key, chosen)


def _all(key: list[Column], values: list[int]) -> Column:
    held = F.lit(True)
    for c, v in zip(key, values, strict=True):
        held &= c == v
    return held
