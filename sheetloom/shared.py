"""The folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_made: set[str] = set()
_run: ContextVar[list[str] | None] = ContextVar("tables of the run", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session sets none (tests in local mode) a temporary folder of this
    process is used, and removed when the process ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="sheetloom-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    if (mine := _run.get()) is not None:
        mine.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    The copy cuts lineage, survives lost executors, and has exact sizes, by which
    Spark decides on broadcasts and skew splits.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    _made.discard(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any longer."""
    folders = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}
    for path in [p for p in _made if p.rsplit("/", 1)[1] in folders]:
        _delete(df.sparkSession, path)


@contextmanager
def tables() -> Iterator[list[str]]:
    """The paths of all tables and files made inside, by this run alone: another thread or a run around it has a list of its own."""
    mine: list[str] = []
    token = _run.set(mine)
    try:
        yield mine
    finally:
        _run.reset(token)


def release(spark: SparkSession, keep: DataFrame, mine: list[str]) -> None:
    """Delete the tables and files of a run, except those that ``keep`` reads."""
    read = keep.inputFiles()
    for path in list(mine):
        name = path.rsplit("/", 1)[1]
        if not any(name in f for f in read):
            mine.remove(path)
            _delete(spark, path)


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``most`` rows, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread_if_large(df: DataFrame, most: int = 100_000, rows: int | None = None) -> DataFrame:
    """``df`` with a hint to meet the other side of a join by a shuffle, if it has more than ``most`` rows, which is counted unless given.

    Spark decides on broadcasts by the size of a table's files, and sorted ids take a tenth there of what they take in the driver's memory.
    """
    return df.hint("merge") if (df.count() if rows is None else rows) > most else df


def open_fs(path: str):
    """The file system of a path in the shared folder and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
