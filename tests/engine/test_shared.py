"""Tables in the shared folder belong to the run that made them."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from sheetloom.shared import broadcast_if_small, discard, fresh_path, materialize, release, tables


def test_runs_release_their_own_tables(spark):
    outer = {}
    with tables() as mine:
        first = materialize(spark.range(5), "first")
        with tables() as inner:
            second = materialize(spark.range(6), "second")

        def other():
            with tables() as theirs:
                outer["theirs"] = materialize(spark.range(7), "theirs")
                release(spark, materialize(spark.range(8), "kept"), [p for p in theirs if "theirs" not in p])

        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        assert len(mine) == len(inner) == 1
        kept = materialize(first.select((F.col("id") + 1).alias("id")), "kept")
        release(spark, kept, mine)
        assert len(mine) == 1
    assert kept.count() == 5 and second.count() == 6 and outer["theirs"].count() == 7
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(inner[0]).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    discard(second)
    assert not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(inner[0]))
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_small_tables_are_hinted(spark):
    small, large = broadcast_if_small(spark.range(10), 10), broadcast_if_small(spark.range(11), 10)
    hinted = [("ResolvedHint" in df.join(spark.range(3), "id")._jdf.queryExecution().analyzed().toString()) for df in (small, large)]
    assert hinted == [True, False]
