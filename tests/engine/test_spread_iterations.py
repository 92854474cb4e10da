"""Soft assignment by tables, Fourier alignment, medians of large groups and layouts by component against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.operators import aggregates, matching, placement, signal
from sheetloom.plans import panorama

SCORES = "pair string, a long, b long, score double"


@pytest.mark.parametrize("rounds, least", [(1, 0.0), (3, 0.0), (24, 0.2)])
def test_soft_matches_by_tables_equal_the_dense_ones(spark, rounds, least):
    rng = random.Random(rounds)
    rows = [(p, a, 5 * b, rng.uniform(-8, 8)) for p, n, m in (("p", 7, 9), ("q", 12, 4), ("r", 1, 1)) for a in range(n) for b in range(m)]
    rows += [("far", a, b, -1e5 if a == b else -2e5) for a in range(3) for b in range(3)]  # scores that exponents can't hold
    df = spark.createDataFrame(rows, SCORES).repartition(3)
    dense = {(r.pair, r.a, r.b): r.score for r in matching.soft_match(df, 1.0, rounds, least).collect()}
    tables = {(r.pair, r.a, r.b): r.score for r in matching.soft_match_by_tables(df, 1.0, rounds, least).collect()}
    assert tables.keys() == dense.keys() and all(tables[k] == pytest.approx(dense[k], abs=1e-7) for k in dense)


def test_soft_potentials_stop_when_nothing_moves(spark, monkeypatch):
    rng, made = random.Random(1), []
    df = spark.createDataFrame([("p", a, b, rng.uniform(-0.5, 0.5)) for a in range(6) for b in range(9)], SCORES)
    real = matching.materialize
    monkeypatch.setattr(matching, "materialize", lambda x, name: made.append(name) or real(x, name))
    cells, u, v = matching.soft_potentials(df, rounds=400)
    assert made.count("soft-columns") < 20
    sums = cells.join(u, ["pair", "a"]).join(v, ["pair", "b"]).groupBy("pair", "b").agg(F.sum(F.exp(F.col("s") + F.col("u") + F.col("v"))).alias("t"))
    assert all(r.t == pytest.approx(1.0) for r in sums.collect())
    assert matching.soft_match_by_tables(df.limit(0)).collect() == []
    odd = spark.createDataFrame([("p", None, 1, 1.0), ("p", 1, None, 1.0), ("p", 1, 1, None), ("p", 2, 2, 9.0)], SCORES)
    assert [(r.a, r.b) for r in matching.soft_match_by_tables(odd, rounds=8).collect()] == [(2, 2)]


def direct_lag(a, b):
    sums = {lag: sum(float(a[i]) * float(b[i - lag]) for i in range(max(0, lag), min(len(a), len(b) + lag))) for lag in [*range(len(a)), *range(1 - len(b), 0)]}
    top = max(sums.values())
    return next(lag for lag, s in sums.items() if s >= top - 1e-12 * max(1, abs(top)))


@pytest.mark.parametrize("n, m", [(1, 1), (2, 5), (40, 40), (63, 65), (100, 7), (200, 128)])
def test_fourier_lags_equal_direct_ones(n, m):
    rng = np.random.default_rng(n * 1000 + m)
    for k in range(20):
        a, b = rng.normal(size=n), rng.normal(size=m)
        if k % 4 == 1:  # whole numbers and repeats: equal correlations at several lags
            a, b = np.round(a), np.round(b)
        if k % 4 == 2:
            a, b = np.tile([1.0, -1.0], n)[:n], np.tile([1.0, -1.0], m)[:m]
        if k % 4 == 3:
            b = np.r_[a[n // 3 :], a[: n // 3]][:m] if n >= m else b
        assert signal.best_lag(a, b) == direct_lag(a, b)
    assert signal.best_lag(np.zeros(9), np.zeros(5)) == 0


def test_a_long_profile_is_aligned():
    rng = np.random.default_rng(3)
    a = rng.normal(size=60_000)
    score, offset = signal.aligned_scores(a, np.r_[a[1234:], rng.normal(size=1234)])
    assert offset == 1234 and score > 0.99


@pytest.mark.parametrize("most", [1 << 30, 50])
def test_medians_of_groups_of_any_size(spark, monkeypatch, most):
    monkeypatch.setattr(aggregates, "GROUP_MOST", most)
    rng = random.Random(6)
    rows = [(k, rng.choice([None, float("nan"), 0.0, -3.5, rng.gauss(0, 100), 1e6])) for k in ["hot"] * 600 + ["a"] * 3 + ["b"] + [None] * 40] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, residual double").repartition(4)
    got = {r.k: (r.median_residual, r.n) for r in aggregates.residual_stats(df, ["k"]).collect()}
    for k in {r[0] for r in rows}:
        values = [v for q, v in rows if q == k and v is not None and not math.isnan(v)]
        want = pytest.approx(float(np.median(values))) if values else None
        assert got[k] == (want, sum(q == k for q, _ in rows))
    points = spark.createDataFrame([("p", float(i), 2.0 * i, i + 5.0 + (i % 3), 2.0 * i - 1.0) for i in range(301)], "pair string, cx_b double, cy_b double, cx_a double, cy_a double")
    r = aggregates.median_translation(points, ["pair"]).first()
    assert (r.dx, r.dy, r.n) == (6.0, -1.0, 301)


def test_layouts_place_every_component_as_a_layout_of_its_own(spark):
    rng, rows, sizes = random.Random(2), [], []
    for c in "ABC":
        n = rng.randrange(3, 7)
        sizes += [(f"{c}{k}", rng.randrange(80, 200), rng.randrange(80, 200)) for k in range(n)]
        rows += [(f"{c}{j}", f"{c}{k}", rng.choice(["left", "right", "top", "bottom"]), "right", float(rng.randrange(4) * 90), rng.random()) for k in range(n) for j in range(k) if j == k - 1 or rng.random() < 0.5]
    sizes.append(("lone", 10, 10))
    scores = spark.createDataFrame(rows + [("A0", "unknown", "left", "right", 0.0, 9.0), (None, "A0", "left", "right", 0.0, 9.0)], "map_a string, map_b string, edge_a string, edge_b string, total_rot double, combined_score double")
    dims = spark.createDataFrame(sizes, "map_num string, w int, h int")
    names = [c.split()[0] for c in panorama.PLACE.split(", ")]
    got = {}
    for r in panorama.layouts(scores, dims).collect():
        got.setdefault(r.component, []).append(r.asDict(recursive=True))
    assert got.keys() == {"A0", "B0", "C0"}
    for root, places in got.items():
        own = [dict(zip(("map_a", "map_b", "edge_a", "edge_b", "total_rot", "combined_score"), r, strict=True)) for r in sorted(rows) if r[0][0] == root[0]]
        want = placement.layout(own, {m: (w, h) for m, w, h in sizes if m[0] == root[0]}, None)
        assert sorted(([p[n] for n in names] for p in places), key=lambda p: p[-1]) == [[p[n] for n in names] for p in want]
    first = panorama.layout(scores.where("map_a like 'A%' and map_b like 'A%'"), dims.where("map_num like 'A%'"), None).collect()
    assert sorted(r.map_num for r in first) == sorted(p["map_num"] for p in got["A0"])
    assert panorama.layouts(scores.limit(0), dims).collect() == []
