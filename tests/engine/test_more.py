"""The model surface, sheet preparation, the proximity graph, and the stateful stream."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.operators import filters, graph, joins, models, raster
from sheetloom.plans import panorama, preparation
from sheetloom.streaming import cache


def test_retries():
    waits, tries = [], []

    def call(x):
        tries.append(x)
        if len(tries) < 3:
            raise ValueError("busy")
        return x * 2

    assert models.with_retries(call, sleep=waits.append)(4) == (8, None) and waits == [1.0, 2.0]
    assert models.with_retries(lambda: 1 / 0, sleep=waits.append)() == (None, "ZeroDivisionError: division by zero")


def test_recogniser(spark):
    crops = spark.createDataFrame([("45", 1, b"2580"), ("45", 2, b""), ("45", 3, b"x"), ("45", 4, b"2600")], "map_num string, parcel_id int, data binary")
    known = spark.createDataFrame([("45", 4)], "map_num string, parcel_id int")
    got = {r.parcel_id: (r.number, r.raw, r.error) for r in models.recognise(crops, lambda: lambda data: (f"number {data.decode()}", 0.9), known).collect()}
    assert got == {1: (2580, "number 2580", None), 2: (None, "SKIP_CROP", None), 3: (None, "number x", None)}


def test_assignment_loss(spark):
    s = spark.createDataFrame([("p", 1, 1, 0.5), ("p", 1, 2, 0.5)], "pair string, a int, b int, score double")
    m = spark.createDataFrame([("p", 1, 2)], "pair string, a int, b int")
    assert models.assignment_loss(s, m, ["pair"]).first().loss == pytest.approx(np.log(2))


def grid(h=220, w=260, step=60):
    a = np.full((h, w), 255, np.uint8)
    a[20:-20:step, 20:-20] = a[20:-20, 20:-20:step] = 0
    return a


def test_preparation(spark):
    a = grid()
    images = spark.createDataFrame([raster.as_row("45", a)], raster.IMAGE_SCHEMA)
    r = preparation.prepare(images, denoise=False).first()
    assert len(r.clean) == len(r.binary) == r.height * r.width and r.contrast_before == pytest.approx(float(a.std()))
    assert preparation.summary(preparation.prepare(images, denoise=False)).first().n == 1
    found = preparation.parcels(images).collect()
    cells = [p for p in found if p.area_px < 5000]
    assert len(cells) == 6 and all(p.solidity == pytest.approx(1, abs=0.05) and p.aspect_ratio == 1 for p in cells)
    lines = preparation.segments(images)
    assert lines.count() >= 4
    profile = {p.edge: p.crossings for p in preparation.edge_profiles(images).collect()}
    assert all(list(v) == sorted(v) for v in profile.values())
    crops = preparation.training_splits(images, found and preparation.parcels(images).select("map_num", "polygon"), {"train": 2, "val": 1}, 128)
    ids = [x.id for x in crops.collect()]
    assert len(ids) == len(set(ids))


def test_skew_and_perspective():
    a = grid()
    turned = raster.rotate(a, 4.0)
    assert abs(abs(raster.detect_skew(turned)) - 4.0) < 1.0
    level = raster.correct_skew(turned)
    assert abs(raster.detect_skew(level)) < 1.0
    assert raster.correct_skew(a).shape == a.shape
    sheet = np.full((200, 300), 30, np.uint8)
    p = [(40, 20), (260, 40), (250, 180), (30, 170)]
    sheet[raster.fill_polygon(200, 300, p)] = 255
    flat = raster.correct_perspective(sheet)
    assert flat.shape != sheet.shape and (flat > 128).mean() > 0.97
    assert raster.correct_perspective(np.full((50, 50), 9, np.uint8)).shape == (50, 50)
    holes = np.ones((20, 20), bool)
    holes[5:8, 5:8] = holes[:2] = False
    got = raster.fill_gaps(np.where(holes, 100, 255).astype(np.uint8), holes)
    assert got[6, 6] == 100 and got[0, 0] == 255


def test_proximity_graph(spark):
    rng = np.random.default_rng(5)
    rows = [("45", i, float(x), float(y), (int(x) - 5, int(y) - 5, 10, 10), None, 0.9 if i else 0.1) for i, (x, y) in enumerate(rng.integers(0, 800, (80, 2)))]
    parcels = spark.createDataFrame(rows, "map_num string, parcel_id int, cx double, cy double, bbox struct<x:int,y:int,w:int,h:int>, area_px double, confidence double")
    nodes, edges = graph.proximity_graph(parcels, F.lit(800), F.lit(800), k=5)
    degrees = {}
    for e in edges.collect():
        assert e.distance <= 150 and 0 not in (e.src, e.dst)
        for n in (e.src, e.dst):
            degrees[n] = degrees.get(n, 0) + 1
    got = {n.id: n for n in nodes.collect()}
    assert len(got) == 79 and all(n.degree == degrees.get(i, 0) <= 5 and 0 <= n.local_density <= 1 for i, n in got.items())


def test_worklists(spark):
    adjacent = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "4")], "map_a string, map_b string")
    selected = spark.createDataFrame([("1",), ("2",), ("3",)], "map_num string")
    done = spark.createDataFrame([("1", "2")], "map_a string, map_b string")
    needed, missing = panorama.wanted_pairs(adjacent, selected, done)
    assert needed.count() == 2 and [tuple(r) for r in missing.collect()] == [("2", "3")]
    assert cache.without_done(adjacent, done).count() == 2
    both = joins.both_roles(spark.createDataFrame([("1", "2", "right", "left", 0.5)], "map_a string, map_b string, edge_a string, edge_b string, score double"))
    assert sorted((r.map_num, r.other, r.edge) for r in both.collect()) == [("1", "2", "right"), ("2", "1", "left")]
    assert filters.without(selected, ["1"]).count() == 2 and filters.without(selected, []).count() == 3


def test_latest_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [{"seq": s, "map_num": "45", "parcel_id": p, "number": n, "raw": "r", "rotation": 0} for s, p, n in ((1, 1, 10), (5, 1, 50), (3, 1, 30), (2, 2, 20))]
    (log / "a.json").write_text("\n".join(map(json.dumps, rows)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = cache.latest_stream(cache.read_log_stream(spark, str(log)))
    query = stream.writeStream.format("memory").queryName("latest").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.parcel_id, r.seq, r.number) for r in spark.table("latest").collect()) == [(1, 5, 50), (2, 2, 20)]
