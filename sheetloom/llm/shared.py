"""What the operators share: the shared folder and its tables (from the engine), column-safe row passing, and caches of workers."""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, fresh_path, materialize, release, shared_dir, tables

__all__ = ["boxed", "discard", "fresh_path", "hash_share", "held", "materialize", "release", "shared_dir", "shuffle_width", "tables", "unboxed", "unheld"]

_held: dict[tuple, object] = {}


def boxed(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``row`` beside the given ones, so that no name can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return df.select(row, *[c.alias(k) for k, c in columns.items()])


def unboxed(df: DataFrame, like: DataFrame) -> DataFrame:
    """The rows that :func:`boxed` has wrapped, with the columns of ``like``."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in like.columns])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_share(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About twice ``rows`` rows of ``df``, or all if it has few, by a hash of ``key``.

    The first ``rows`` of them by any order are then found without every task offering that many.
    """
    n = df.count()
    if n <= 4 * rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("share"), key), F.lit(1 << 40)) < int(2 * rows / n * (1 << 40)))


def held(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in this worker until another key is asked for, so that a worker holds one large cache at a time."""
    if key not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


def unheld() -> None:
    """Let go of what this worker keeps, where an operator needs none of it."""
    if _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
