"""Regions over tiles of any size against labels of whole sheets."""

from __future__ import annotations

import numpy as np
import pytest

from sheetloom.operators import raster, tiled

PIXEL = "map_num string, y int, x int"


def sheets():
    rng = np.random.default_rng(2)
    spiral = np.zeros((40, 40), bool)
    for k in range(0, 19, 2):
        spiral[k, k : 40 - k] = spiral[39 - k, k : 40 - k] = spiral[k : 40 - k, 39 - k] = True
        spiral[k + 2 : 40 - k, k] = True
    return {"dense": rng.random((50, 37)) < 0.45, "thin": rng.random((33, 64)) < 0.2, "spiral": spiral, "corners": np.eye(30, dtype=bool) | np.eye(30, dtype=bool)[::-1], "full": np.ones((20, 20), bool)}


def pixels(spark, found):
    return spark.createDataFrame([(m, int(y), int(x)) for m, a in found.items() for y, x in np.argwhere(a)], PIXEL).repartition(3)


@pytest.mark.parametrize("size", [1, 7, 16, 512])
def test_regions_do_not_depend_on_tiles(spark, size):
    found = sheets()
    want = set()
    for m, a in found.items():
        label = raster.components(a)
        for k in range(1, label.max() + 1):
            y, x = np.nonzero(label == k)
            want.add((m, int(y[0]), int(x[0]), len(y), int(y.min()), int(x.min()), int(y.max()), int(x.max())))
    chosen = found if size > 1 else {k: found[k] for k in ("thin", "corners")}
    assert {tuple(r) for r in tiled.regions(pixels(spark, chosen), size).collect()} == {r for r in want if r[0] in chosen}


def test_small_regions_go_and_odd_rows_are_left_out(spark):
    found = sheets()
    rows = pixels(spark, {"thin": found["thin"]})
    odd = spark.createDataFrame([("thin", None, 1), (None, 1, 1), ("thin", -1, 3)], PIXEL)
    got = {(r.y, r.x) for r in tiled.without_small_regions(rows.unionAll(rows).unionAll(odd), 8, 16).collect()}
    assert got == set(map(tuple, np.argwhere(raster.without_small(found["thin"], 8)).tolist()))
    assert tiled.regions(rows.limit(0)).collect() == []


def test_many_labels_meet_by_a_shuffle(spark, monkeypatch):
    """neither the pixels along seams nor the roots of many labels go through the driver, however small their files are."""
    plans, real = {}, tiled.materialize
    monkeypatch.setattr(tiled, "materialize", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or real(df, name))
    monkeypatch.setattr(tiled, "MOST", 0, raising=False)
    pixels = spark.createDataFrame([("a", y, x) for y in range(12) for x in range(12) if (x + y) % 3], "map_num string, y int, x int")
    whole = tiled.labelled(pixels, 4)
    assert "Broadcast" not in plans["seams"] and "Broadcast" not in whole._jdf.queryExecution().executedPlan().toString()
    assert whole.count() == pixels.count()
