"""Clicks and parcels far off, and coordinates that are no numbers."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from sheetloom.operators import joins

CLICK, PARCEL = "map_num string, click int, x double, y double", "map_num string, parcel_id int, cx double, cy double"


def nearest(points, parcels):
    out = {}
    for m, k, x, y in points:
        own = [((cx - x) ** 2 + (cy - y) ** 2, p) for q, p, cx, cy in parcels if q == m]
        if own:
            out[m, k] = min(own)[1]
    return out


def test_far_clicks_and_parcels_change_nothing(spark):
    rng = random.Random(7)
    parcels = [(m, k, rng.uniform(0, 500), rng.uniform(0, 300)) for m in "ab" for k in range(300)]
    parcels += [("a", 900, 1e7, -1e7), ("c", 1, 5.0, 5.0), ("d", 1, 1.0, 1.0), ("d", 2, 1.0, 1.0)]
    clicks = [(m, k, rng.uniform(-100, 600), rng.uniform(-100, 400)) for m in "abcde" for k in range(40)]
    clicks += [("a", 900, 1e9, 1e9), ("b", 901, -1e12, 150.0), ("a", 902, 9.9e6, -9.9e6), ("a", 903, 5e6, -5e6)]
    odd_clicks = [("a", 950 + k, x, 1.0) for k, x in enumerate((None, math.nan, math.inf, -math.inf))]
    odd_parcels = [("b", 950 + k, x, 150.0) for k, x in enumerate((None, math.nan, math.inf, -math.inf))]
    got = joins.nearest_parcel(spark.createDataFrame(clicks + odd_clicks, CLICK), spark.createDataFrame(parcels + odd_parcels, PARCEL), ["map_num"], "click").collect()
    assert {(r.map_num, r.click): r.parcel_id for r in got} == nearest(clicks, parcels) and len(got) == 40 * 4 + 4


def test_a_far_click_leaves_the_grid_fine(spark):
    rng = random.Random(8)
    parcels = spark.createDataFrame([("a", k, rng.uniform(0, 500), rng.uniform(0, 300)) for k in range(1000)] + [("a", 5000, 1e6, 1e6)], PARCEL)
    side = joins._cells(parcels, ["map_num"]).first()._side
    cells = parcels.groupBy(F.floor(F.col("cx") / side), F.floor(F.col("cy") / side)).count().agg(F.max("count")).first()[0]
    assert cells < 20
