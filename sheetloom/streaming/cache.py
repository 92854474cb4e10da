"""Incremental caches: an append log of records whose latest one a key counts, as a stream and as a batch, and folded edit events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas
from ..operators.ranks import best
from ..sources.writers import upserted


def latest(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The record with the largest sequence number of each key."""
    return best(log.where(F.col(keys[-1]).isNotNull()), keys, [F.desc_nulls_last(seq)])


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of a JSON-lines log as a stream; broken lines and records without a parcel are dropped."""
    raw = spark.readStream.schema(schemas.CACHE + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.where(F.col("_corrupt").isNull() & F.col("parcel_id").isNotNull()).drop("_corrupt")


def run_cache_stream(spark: SparkSession, log: str, table: str, checkpoint: str, keys: tuple[str, ...] = ("map_num", "parcel_id"), buckets: int = 64):
    """Fold what is new in a log into a table of latest records; a repeated batch changes nothing.

    Records lie in buckets by a hash of their keys. A batch reads and writes only the buckets that its records are in, as the next
    version of them (folders ``v=<batch>/bucket=<k>``); a bucket's largest version is current. Versions older than the one before it
    are deleted, so the table stays within twice its size.
    """
    keys = list(keys)

    def fold(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new = latest(batch, keys).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most so many buckets
        before = current(session, table, number, touched)
        if before is not None:
            both = before.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("_old", F.lit(0)).unionByName(new.withColumn("_old", F.lit(-1)))
            new = best(both, keys, [F.desc_nulls_last("seq"), "_old"]).drop("_old")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v={number:012d}")
        for bucket, versions in _versions(session, table, number).items():
            for v in versions[:-1]:  # the last one before this batch is what a repeat of it would read
                _delete(session, f"{table}/v={v:012d}/bucket={bucket}")

    query = read_log_stream(spark, log).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return current(spark, table)


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _delete(spark: SparkSession, path: str) -> None:
    fs, hadoop = _at(spark, path)
    fs.delete(hadoop, True)


def _versions(spark: SparkSession, table: str, below: int | None = None) -> dict[int, list[int]]:
    """The whole versions of each bucket, ascending, below a batch if one is given."""
    fs, hadoop = _at(spark, table)
    found: dict[int, list[int]] = {}
    for s in fs.listStatus(hadoop) if fs.exists(hadoop) else ():
        name = s.getPath().getName()
        if not name.startswith("v=") or below is not None and int(name[2:]) >= below or not fs.exists(_at(spark, f"{table}/{name}/_SUCCESS")[1]):
            continue
        for part in fs.listStatus(s.getPath()):
            if part.getPath().getName().startswith("bucket="):
                found.setdefault(int(part.getPath().getName()[7:]), []).append(int(name[2:]))
    return {k: sorted(v) for k, v in found.items()}


def current(spark: SparkSession, table: str, below: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest version of a folded table, or of some of its buckets, or the newest before a batch."""
    paths = [f"{table}/v={v[-1]:012d}/bucket={k}" for k, v in sorted(_versions(spark, table, below).items()) if buckets is None or k in buckets]
    return spark.read.parquet(*paths) if paths else None


class LatestRecord(StatefulProcessor):
    """Keeps the latest record of a key in state and gives it again whenever a newer one comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "seq long, number int, raw string, error string, rotation int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top = self.state.get() if self.state.exists() else None
        changed = False
        for b in rows:
            for r in b.itertuples(index=False):
                if top is None or r.seq > top[0]:
                    plain = [None if pd.isna(x) else x for x in (r.seq, r.number, r.raw, r.error, r.rotation)]
                    top, changed = tuple(int(x) if isinstance(x, float) else x for x in plain), True
        if changed:
            self.state.update(top)
            yield pd.DataFrame([(key[0], key[1], *top)], columns=["map_num", "parcel_id", "seq", "number", "raw", "error", "rotation"])

    def close(self) -> None:
        pass


def latest_stream(stream: DataFrame) -> DataFrame:
    """A stream of latest records by custom state, for sinks that update by key."""
    out = "map_num string, parcel_id int, seq long, number int, raw string, error string, rotation int"
    return stream.groupBy("map_num", "parcel_id").transformWithStateInPandas(LatestRecord(), out, "Update", "None")


def without_done(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """Pairs that no stored result has."""
    return pairs.join(results.select("map_a", "map_b"), ["map_a", "map_b"], "left_anti")


def fold_edits(events: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that edits leave: 'add' puts a row, 'delete' takes the latest state of its id away, 'undo' takes away the row added last before it.

    ``events``: keys, seq, op, id, x, y. An undo takes back one addition still standing at its time, as on a stack, told by the balance of
    additions and undos.
    """
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("op") == "add", 1).when(F.col("op") == "undo", -1).otherwise(0)
    level = events.where(F.col("op").isin("add", "undo")).withColumn("level", F.sum(step).over(w))
    depth = F.when(F.col("op") == "add", F.col("level")).otherwise(F.col("level") + 1)
    nest = Window.partitionBy(*keys, "depth").orderBy("seq")
    standing = level.withColumn("depth", depth).withColumn("next_op", F.lead("op").over(nest)).where("op = 'add' and (next_op is null or next_op = 'add')")
    last = Window.partitionBy(*keys, "id").orderBy(F.desc("seq"))
    kept = standing.select(*events.columns).unionByName(events.where("op = 'delete'"))
    return kept.withColumn("_r", F.row_number().over(last)).where("_r = 1 and op = 'add'").drop("_r", "op")


def nearest_to_delete(points: DataFrame, clicks: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """The id of the nearest point within a radius of each click, strictly; clicks meet the points of the nine grid cells around them."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = F.array(*[F.struct(F.lit(dx).alias("_dx"), F.lit(dy).alias("_dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    asked = clicks.select("*", F.inline(around)).withColumns({"_bx": cell("click_x") + F.col("_dx"), "_by": cell("click_y") + F.col("_dy")}).drop("_dx", "_dy")
    held = points.withColumns({"_bx": cell("x"), "_by": cell("y")})
    d = F.hypot(F.col("x") - F.col("click_x"), F.col("y") - F.col("click_y"))
    met = asked.join(held, [*keys, "_bx", "_by"]).withColumn("d", d).where(F.col("d") < radius)
    return best(met, [*keys, "click_id"], ["d", "id"]).select(*keys, "click_id", "id")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return upserted(old, new, keys)
