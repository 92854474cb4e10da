"""Joins, ranks, graphs, signals, matching and fits against plain versions and properties."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheetloom import dimensions
from sheetloom.functions import geometry as G
from sheetloom.operators import aggregates, filters, fitting, graph, joins, matching, placement, ranks, sets, signal
from sheetloom.shared import materialize


def test_radius_pairs(spark):
    rng = np.random.default_rng(1)
    pts = [(m, i, float(x), float(y)) for m in ("a", "b") for i, (x, y) in enumerate(rng.integers(0, 600, (150, 2)))] + [("a", 900, 0.0, 0.0), ("a", 901, 0.0, 150.0), ("a", 902, 0.0, 0.0)]
    got = {(r.map_num, r.a.parcel_id, r.b.parcel_id) for r in joins.radius_pairs(spark.createDataFrame(pts, "map_num string, parcel_id int, cx double, cy double"), 150.0, ["map_num"]).collect()}
    want = {(p[0], p[1], q[1]) for p, q in itertools.product(pts, pts) if p[0] == q[0] and p[1] < q[1] and math.hypot(p[2] - q[2], p[3] - q[3]) <= 150}
    assert got == want and ("a", 900, 901) in want
    rows = joins.radius_pairs(spark.createDataFrame(pts, "map_num string, parcel_id int, cx double, cy double"), 150.0, ["map_num"]).count()
    assert rows == len(want)


def test_radius_join_has_no_nested_loop(spark):
    pts = spark.createDataFrame([("a", 1, 0.0, 0.0)], "map_num string, parcel_id int, cx double, cy double")
    plan = joins.radius_pairs(pts, 150.0, ["map_num"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_area_gate(spark):
    rng = np.random.default_rng(2)
    a = [("p", i, float(v)) for i, v in enumerate(np.exp(rng.normal(5, 2, 80)))]
    df = spark.createDataFrame(a, "pair string, parcel_id int, area double")
    got = {(r.a.parcel_id, r.b.parcel_id) for r in joins.area_gated_pairs(df, df, ["pair"], 1.8).collect()}
    assert got == {(p[1], q[1]) for p in a for q in a if abs(math.log(p[2]) - math.log(q[2])) <= math.log(1.8)}


def test_multiplicity_gate(spark):
    rows = [("45", i, 2580) for i in range(20)] + [("47", 100, 2580)] + [("45", 200 + i, 2600) for i in range(21)] + [("47", 300, 2600), ("47", 301, None), ("45", 302, None)]
    r = spark.createDataFrame(rows, "map_num string, parcel_id int, number int")
    pairs = spark.createDataFrame([("45", "47")], "map_a string, map_b string")
    got = joins.shared_numbers(r, pairs).collect()
    assert len(got) == 20 and {x.number for x in got} == {2580} and {x.n_dup_a for x in got} == {20}


def test_nearest_shared_limits(spark):
    rows = [("45", 1, 7, 0.0, 0.0), ("47", 2, 7, 400.0, 0.0), ("45", 3, 8, 0.0, 0.0), ("47", 4, 8, 400.1, 0.0), ("45", 5, 9, 0.0, 0.0), ("47", 6, 9, 3.0, 0.0), ("47", 7, 9, -3.0, 0.0)]
    r = spark.createDataFrame(rows, "map_num string, parcel_id int, number int, cx double, cy double")
    found = joins.shared_numbers(r, spark.createDataFrame([("45", "47")], "map_a string, map_b string"))
    res = joins.prior_residual(G.identity(), F.col("a.cx"), F.col("a.cy"), F.col("b.cx"), F.col("b.cy"), F.lit(0), F.lit(0))
    assert {(x.number, x.b.parcel_id) for x in joins.nearest_shared(found, res).collect()} == {(7, 2), (9, 6)}


def test_validation(spark):
    rows = [("45", 2580, "VALID"), ("47", 2580, "INVALID"), ("47", 2660, "BORDER"), ("45", None, "NO_NUMBER"), ("99", 1, "UNKNOWN")]
    df = spark.createDataFrame(rows, "map_num string, number int, want string")
    assert all(r.validation == r.want for r in joins.validate_numbers(df, dimensions.number_ranges(spark)).collect())


def test_dimensions(spark):
    assert dimensions.boundary_numbers(spark).count() == 38 and dimensions.neighbours(spark).count() == 10 and dimensions.number_ranges(spark).count() == 13
    assert dimensions.coarse_configurations(spark).count() == 16 and dimensions.fine_angles(spark).count() == 20
    sheets = spark.createDataFrame([(m,) for m in dimensions.SHEETS], "map_num string")
    assert joins.sheet_pairs(sheets).count() == 78 and 78 * 36 == 2808


def test_tiles(spark):
    t = ranks.tiles(spark.createDataFrame([("1", 1000, 600)], "map_num string, height int, width int"))
    assert sorted((r.ty, r.tx) for r in t.collect()) == [(0, 0), (0, 384), (384, 0), (384, 384), (768, 0), (768, 384)]


def test_ratio_matches(spark):
    rng = np.random.default_rng(3)
    t = rng.random((300, 8))
    q = np.vstack([t[:40] + rng.normal(0, 0.01, (40, 8)), rng.random((20, 8))])
    frame = lambda x: spark.createDataFrame([("p", i, v.tolist()) for i, v in enumerate(x)], "pair string, kp_id int, descriptor array<double>")
    got = {(r.q_id, r.t_id) for r in joins.ratio_matches(frame(q), frame(t), ["pair"]).collect()}
    want = set()
    for i, v in enumerate(q):
        d = np.linalg.norm(t - v, axis=1)
        a, b = np.argsort(d, kind="stable")[:2]
        if d[a] < 0.75 * d[b]:
            want.add((i, int(a)))
    assert got == want and len(got) >= 40


@pytest.mark.parametrize(("edges", "want"), [([(0, 1), (1, 2), (0, 2)], {0: 1.0, 1: 1.0, 2: 1.0}), ([(0, 1), (0, 2), (0, 3)], {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.0})])
def test_local_density(spark, edges, want):
    df = spark.createDataFrame([("m", u, v) for u, v in edges], "map_num string, src int, dst int")
    assert {r.node: r.local_density for r in aggregates.degree_density(df, ["map_num"]).collect()} == want


def test_sequential_prune(spark):
    rng = np.random.default_rng(4)
    pts = rng.random((20, 2)) * 100
    edges = [("m", i, j, float(np.hypot(*(pts[i] - pts[j])))) for i in range(20) for j in range(i + 1, 20)]
    got = graph.prune_neighbours(spark.createDataFrame(edges, "map_num string, src int, dst int, distance double"), 12)
    left = {(i, j): d for _, i, j, d in edges}
    for node in range(20):
        own = sorted((d, i + j - node, (i, j)) for (i, j), d in left.items() if node in (i, j))
        for _, _, e in own[12:]:
            del left[e]
    assert {(r.src, r.dst) for r in got.collect()} == set(left)
    assert max(r.degree for r in aggregates.degrees(got, ["map_num"]).collect()) <= 12


def test_components_and_transforms(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("x", "x")]
    t = spark.createDataFrame([(a, b, [1.0, 0.0, 10.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for a, b in links[:4]] + [("e", "f", [1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 0.0, 0.0, 1.0])], "map_a string, map_b string, h array<double>")
    both = graph.with_inverses(t)
    assert both.count() == 9  # the singular one has no way back
    cc = {r.node: r.root for r in graph.connected_components(both.select("src", "dst")).collect()}
    assert cc == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}
    component = spark.createDataFrame(list(cc.items()), "node string, root string")
    anchors = graph.anchors(both, component)
    assert {r.root: r.anchor for r in anchors.collect()} == {"a": "a", "d": "e"}
    reached = {(r.anchor, r.node): (r.hops, r.h) for r in graph.transforms_to_anchor(both, anchors).collect()}
    assert reached["a", "b"][1][2] == 10 and reached["a", "c"][1][2] == -10 and reached["a", "c"][0] == 1 and reached["e", "d"][1][2] == -10
    chain = spark.createDataFrame([(str(k), str(k + 1), [1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for k in range(4)], "map_a string, map_b string, h array<double>")
    start = spark.createDataFrame([("0",)], "anchor string")
    whole = graph.transforms_to_anchor(graph.with_inverses(chain), start, 4).collect()
    assert sorted((r.node, r.hops, r.h[2]) for r in whole) == [(str(k), k, float(k)) for k in range(5)]
    with pytest.raises(ValueError):
        graph.transforms_to_anchor(graph.with_inverses(chain), start, 3)
    nodes = spark.createDataFrame([("a",), ("z",)], "node string")
    assert [r.node for r in graph.unreachable(nodes, spark.createDataFrame([("a",)], "node string")).collect()] == ["z"]


def test_layout():
    row = lambda a, b, ea, eb, rot, s: {"map_a": a, "map_b": b, "edge_a": ea, "edge_b": eb, "total_rot": rot, "combined_score": s}
    sizes = {m: (100, 80) for m in "ABCDE"}
    scores = [row("A", "B", "right", "left", 0.0, 0.9), row("B", "C", "right", "left", 0.0, 0.8), row("A", "C", "right", "left", 0.0, 0.7), row("C", "D", "bottom", "top", 90.0, 0.6)]
    got = {p["map_num"]: p for p in placement.layout(scores, sizes, None)}
    assert [(got[m]["x"], got[m]["y"]) for m in "AB"] == [(0, 0), (65, 0)] and got["C"]["x"] == 130 and got["C"]["how"] == "best"
    assert (got["D"]["w"], got["D"]["h"], got["D"]["rot"]) == (80, 100, 90.0) and got["D"]["y"] == 45
    assert got["E"]["how"] == "row" and got["E"]["y"] > got["D"]["y"] + 100
    assert placement.layout([], sizes, None) == []
    moved = {p["map_num"]: p for p in placement.layout(scores, sizes, ("C", "D"))}
    assert moved["C"]["how"] == moved["D"]["how"] == "seed" and (moved["C"]["x"], moved["C"]["y"]) == (0, 0) and moved["B"]["x"] == -65


@pytest.mark.parametrize("seed", range(8))
def test_layout_keeps_its_rules(seed):
    """Every sheet has one place; at most one neighbour a side; no box set beside another covers most of one."""
    rng = np.random.default_rng(seed)
    names = [str(k) for k in range(14)]
    sizes = {m: (int(rng.integers(100, 400)), int(rng.integers(100, 400))) for m in names}
    sides = (("right", "left"), ("left", "right"), ("bottom", "top"), ("top", "bottom"))
    scores = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            ea, eb = sides[rng.integers(4)]
            scores.append({"map_a": a, "map_b": b, "edge_a": ea, "edge_b": eb, "total_rot": float(90 * rng.integers(4)), "combined_score": float(rng.random())})
    places = placement.layout(scores, sizes, None)
    assert sorted(p["map_num"] for p in places) == sorted(names) and [p["place"] for p in places] == list(range(14))
    top = max(scores, key=lambda s: s["combined_score"])
    assert [p["map_num"] for p in places[:2]] == [top["map_a"], top["map_b"]]
    for k, p in enumerate(places):
        assert len(p["edges"]) == len(set(p["edges"]))
        assert (p["w"], p["h"]) == sizes[p["map_num"]][:: -1 if round(p["rot"] / 90) % 2 else 1]
        if p["how"] in ("best", "retry"):
            for q in places[:k]:
                assert not (min(p["x"] + p["w"], q["x"] + q["w"]) - max(p["x"], q["x"]) > 0.45 * p["w"] and min(p["y"] + p["h"], q["y"] + q["h"]) - max(p["y"], q["y"]) > 0.45 * p["h"])


def impulses(at, n=64):
    a = np.zeros(n)
    for k, v in at.items():
        a[k] = v
    return a


def test_alignment():
    a = impulses({10: 5, 25: 9, 40: 7})
    assert signal.aligned_scores(a, a) == (pytest.approx(1.0), 0)
    score, offset = signal.aligned_scores(a, np.r_[a[6:], np.zeros(6)])
    assert offset == 6 and score == pytest.approx(1.0)
    assert signal.aligned_scores(np.ones(64), np.ones(64))[0] == 0
    assert signal.aligned_scores(a, a[:10])[0] == 0


def test_offset_equals_lag_join(spark):
    rng = np.random.default_rng(5)
    for _ in range(5):
        a, b = rng.random(50), rng.random(60)
        x, y = a - a.mean(), b - b.mean()
        lags = {k: sum(x[i] * y[i - k] for i in range(50) if 0 <= i - k < 60) for k in range(-59, 50)}
        assert signal.aligned_scores(a, b)[1] == max(lags, key=lags.get)


def test_strips():
    rng = np.random.default_rng(6)
    whole = np.where(rng.random((300, 60)) < 0.1, 0, 255).astype(np.uint8)
    got = signal.strip_scores(whole, "right", whole[25:], "left")
    assert got["best_offset_px"] == 25 and got["ncc_2d"] > 0.99
    mirrored = signal.strip_scores(whole, "right", whole[::-1], "left")
    assert mirrored["ncc_2d"] > 0.99 and abs(mirrored["density_a"] - (whole < 180).mean()) < 1e-12


def test_profile_shift(spark):
    bins = lambda v: [("p", int(x / 1100 * 200), 1.0) for x in v]
    a, b = (spark.createDataFrame(bins(v), "pair string, bin int, value double") for v in ([100, 300, 700], [50, 250, 650]))
    got = signal.profile_shift(signal.lag_correlation(a, b, ["pair"]), ["pair"], F.lit(1100.0), F.lit(3)).first()
    assert got.shift_px == pytest.approx(49.5) and got.score == pytest.approx(3 * math.sqrt(3))
    few = signal.profile_shift(signal.lag_correlation(a, b, ["pair"]), ["pair"], F.lit(1100.0), F.lit(2)).first()
    assert (few.shift_px, few.score) == (0, 0)


def test_peaks():
    assert signal.peaks(impulses({5: 9, 20: 8, 31: 7, 60: 6}), 3, 25) == [5, 31, 60]


@pytest.mark.parametrize("shape", [(1, 1), (4, 4), (5, 3), (3, 6), (6, 6)])
def test_assignment(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(10):
        c = rng.random(shape)
        got = matching.assignment(c)
        small, large = min(shape), max(shape)
        wide = c if shape[0] <= shape[1] else c.T
        best = min(sum(wide[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert sum(c[i, j] for i, j in got) == pytest.approx(best) and len(got) == small
        assert len({i for i, _ in got}) == len({j for _, j in got}) == small


def test_assign_pairs(spark):
    rows = [("p", 1, 1, 0.1), ("p", 1, 2, 0.2), ("p", 2, 1, 0.15), ("p", 2, 2, 0.9), ("p", 3, 3, 0.7), ("q", 1, 1, 0.5)]
    got = {(r.pair, r.parcel_a, r.parcel_b) for r in matching.assign_pairs(spark.createDataFrame(rows, "pair string, parcel_a int, parcel_b int, cost double")).collect()}
    assert got == {("p", 1, 2), ("p", 2, 1), ("q", 1, 1)}


def test_soft_assignment():
    p = matching.soft_assignment(np.array([[8.0, 0, 0], [0, 8.0, 0]]), 1.0, 200)
    assert p.sum(axis=0) == pytest.approx(np.ones(4)) and p[0, 0] > 0.9 and p[1, 1] > 0.9 and p[0, 1] < 0.05


def test_positional_match(spark):
    a = [("p", 1, 0.0, 0.1, 0.1), ("p", 2, 0.1, 0.5, 0.5), ("p", 3, 0.2, 0.9, 0.9), ("p", 4, 0.9, 0.2, 0.2)]
    b = [("p", 7, 0.0, 0.12, 0.1), ("p", 8, 0.0, 0.11, 0.1), ("p", 9, 0.1, 0.52, 0.5)]
    frame = lambda x: spark.createDataFrame(x, "pair string, id long, dist_boundary double, norm_cx double, norm_cy double")
    assert {(r.a, r.b) for r in matching.positional_match(frame(a), frame(b)).collect()} == {(1, 8), (2, 9)}


@pytest.mark.parametrize(("model", "h"), [("similarity", [[0.9, -0.3, 40], [0.3, 0.9, -7], [0, 0, 1]]), ("perspective", [[1.1, 0.1, 5], [-0.05, 0.95, 9], [1e-4, -5e-5, 1]])])
def test_robust_fit(model, h):
    rng = np.random.default_rng(7)
    src = rng.random((60, 2)) * 1000
    dst = fitting.apply(np.array(h), src)
    dst[:18] += rng.random((18, 2)) * 900 + 100
    got, inside = fitting.robust_fit(src, dst, model, 5.0)
    assert inside[18:].all() and not inside[:18].any() and got == pytest.approx(np.array(h) / h[2][2], abs=1e-5)
    got, _ = fitting.robust_fit(src, dst, model)
    assert got == pytest.approx(np.array(h) / h[2][2], abs=1e-5)
    again, _ = fitting.robust_fit(src, dst, model)
    assert (again == got).all()


def test_degenerate_fits():
    p = np.zeros((6, 2))
    assert fitting.fit_similarity(p, p) is None
    assert fitting.robust_fit(p[:3], p[:3], "perspective")[0] is None
    line = np.c_[np.arange(6.0), np.arange(6.0)]
    fitting.robust_fit(line, line, "perspective", 1.0)


def test_tiers(spark):
    rng = np.random.default_rng(8)
    rows = []
    for pair, n in (("one", 1), ("two", 2), ("five", 5), ("eight", 8)):
        b = rng.random((n, 2)) * 500
        rows += [(pair, float(x + 12), float(y - 4), float(x), float(y)) for x, y in b]
    points = spark.createDataFrame(rows, "pair string, cx_a double, cy_a double, cx_b double, cy_b double")
    got = {r.pair: (r.model, r.h) for r in fitting.fit_clicks(points).collect()}
    assert {k: v[0] for k, v in got.items()} == {"one": "translation", "two": "similarity", "five": "similarity", "eight": "perspective"}
    assert all(v[1] == pytest.approx([1, 0, 12, 0, 1, -4, 0, 0, 1], abs=1e-5) for v in got.values())
    current = spark.createDataFrame([(p, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for p in (*got, "none")], "pair string, h array<double>")
    fine = {r.pair: (r.n, r.model, r.h) for r in fitting.refine(points, current).collect()}
    assert fine["none"] == (0, "none", [1, 0, 0, 0, 1, 0, 0, 0, 1]) and fine["two"][1] == "translation" and fine["eight"][1] == "perspective"
    assert all(fine[k][2] == pytest.approx([1, 0, 12, 0, 1, -4, 0, 0, 1], abs=1e-5) for k in got)
    moved = {r.pair: r.h for r in fitting.corrected_by_translation(current, points).collect()}
    assert moved["five"][2] == pytest.approx(12) and moved["none"][2] == 0
    assert {r.n for r in fitting.residual_report(points, fitting.fit_clicks(points)).collect()} == {1, 2, 5, 8}


def test_detections(spark):
    rows = [("1", (384, 0), 0, 0.9, (0, 0, 30, 30)), ("1", (0, 0), 1, 0.8, (500, 500, 512, 512)), ("1", (0, 0), 0, 0.7, (10, 10, 60, 40)), ("1", (0, 0), 2, 0.4, (10, 10, 60, 40)), ("1", (768, 0), 0, 0.9, (0, 0, 300, 10))]
    df = spark.createDataFrame([(m, t, i, s, b, [(b[0], b[1]), (b[2], b[1]), (b[2], b[3])]) for m, t, i, s, b in rows], "map_num string, tile struct<x:int,y:int>, idx int, score double, box struct<x0:int,y0:int,x1:int,y1:int>, polygon array<struct<x:int,y:int>>")
    got = filters.detections_to_parcels(df, F.lit(800), F.lit(600)).orderBy("parcel_id").collect()
    assert [(r.parcel_id, r.bbox.x, r.bbox.w, r.area_px) for r in got] == [(0, 10, 50, 1500.0), (1, 384, 30, 900.0)]


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "n int") for v in ([1, 2, 2, 3], [2, 4]))
    assert sorted(r.n for r in sets.common(a, b, ["n"]).collect()) == [2]
    assert sorted(r.n for r in sets.only_in_first(a, b, ["n"]).collect()) == [1, 3]
    e = spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int")
    assert sorted(map(tuple, sets.symmetric(e).collect())) == [(1, 2), (2, 1)]
    assert sets.all_of(a, spark.createDataFrame([(1, "x")], "n int, s string")).count() == 5
    assert [r.n for r in sets.distinct_sorted(a, "n").collect()] == [1, 2, 3]


def test_free_places(spark):
    places = spark.createDataFrame([(0, 0, 100, 100)], "x int, y int, w int, h int")
    c = spark.createDataFrame([(1, 50, 50, 100, 100), (2, 60, 0, 100, 100), (3, 95, 0, 100, 100)], "id int, x int, y int, w int, h int")
    assert sorted(r.id for r in filters.free_places(c, places).collect()) == [2, 3]


def test_percentiles_match_numpy(spark):
    v = np.random.default_rng(9).random(37)
    got = aggregates.percentiles(spark.createDataFrame([("k", float(x)) for x in v], "k string, v double"), ["k"], "v").first()
    assert [got[f"p{p}"] for p in (10, 25, 50, 75, 90)] == pytest.approx(np.percentile(v, [10, 25, 50, 75, 90]).tolist())


def test_number_points_end_to_end(spark):
    from sheetloom.plans import control_points

    rng = np.random.default_rng(10)
    b = rng.random((30, 2)) * 2000
    rows = [("47", 2700 + i, i, float(x), float(y)) for i, (x, y) in enumerate(b)] + [("45", 2700 + i, 100 + i, float(x + 300), float(y + 20 + (500 if i > 27 else 0))) for i, (x, y) in enumerate(b)]
    readings = spark.createDataFrame(rows, "map_num string, number int, parcel_id int, cx double, cy double")
    priors = spark.createDataFrame([("45", "47", [1.0, 0.0, 290.0, 0.0, 1.0, 25.0, 0.0, 0.0, 1.0], 0.0, 0.0)], "map_a string, map_b string, h array<double>, offset_x double, offset_y double")
    points, fits = control_points.from_numbers(readings, priors.select("map_a", "map_b"), priors, dimensions.boundary_numbers(spark))
    assert points.count() == 28 and {r.is_csv_known for r in points.where("number = 2749").collect()} <= {True}
    f = fits.first()
    assert f.n_inliers == 28 and f.h[2] / f.h[8] == pytest.approx(300, abs=0.01)


def test_shape_points_end_to_end(spark):
    from sheetloom.plans import control_points

    rng = np.random.default_rng(11)
    sig = rng.random((40, 7)) * 5
    side = lambda dx: spark.createDataFrame([("A_B", i, float(50 * i % 900 + dx), float(37 * i % 700), float(1000 + 13 * i), v.tolist()) for i, v in enumerate(sig)], "pair string, parcel_id int, cx double, cy double, area double, signature array<double>")
    a, b = side(250.0), side(0.0)
    points, fits = control_points.from_signatures(a, b, threshold=5.0)
    assert {(r.parcel_a, r.parcel_b) for r in points.collect()} == {(i, i) for i in range(40)}
    assert fits.first().h[2] == pytest.approx(250, abs=1e-3)
    shapes = lambda df: df.withColumnRenamed("signature", "hu")
    points, _ = control_points.from_shapes(shapes(a), shapes(b))
    assert sum(r.parcel_a == r.parcel_b for r in points.collect()) >= 30


def test_stitch(spark):
    from sheetloom.plans import panorama

    t = spark.createDataFrame([("a", "b", [1.0, 0.0, 100.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), ("b", "c", [1.0, 0.0, 100.0, 0.0, 1.0, 10.0, 0.0, 0.0, 1.0]), ("x", "y", [float("nan")] * 9)], "map_a string, map_b string, h array<double>")
    sizes = spark.createDataFrame([(m, 110, 80) for m in "abcxy"], "map_num string, width int, height int")
    sheets, boxes, lost = panorama.stitch(t, sizes)
    assert {r.node: r.h[2] for r in sheets.collect()} == {"a": -100, "b": 0, "c": 100}
    box = boxes.first()
    assert (box.x_min, box.y_min, box.x_max, box.y_max, box.downscale) == (-100, 0, 210, 90, 1.0)
    assert sorted(r.node for r in lost.collect()) == ["x", "y"]
    sheets, _, _ = panorama.stitch(t, sizes, exclude=["b"])
    assert sheets.count() == 0


def test_pandas_is_only_in_kernels():
    assert pd.__version__


def test_nearest_and_clicked_parcels(spark):
    """Clusters, far clicks, ties and a sheet without parcels, against all pairs."""
    rng = np.random.default_rng(11)
    centres = [(m, i, float(x), float(y)) for m, n in (("a", 60), ("b", 1)) for i, (x, y) in enumerate(np.r_[rng.normal(0, 5, (n, 2)), rng.normal(900, 40, (n, 2))])]
    rows = [(m, i, x, y, [(int(x) - 2, int(y) - 2), (int(x) + 2, int(y) - 2), (int(x) + 2, int(y) + 2), (int(x) - 2, int(y) + 2)]) for m, i, x, y in centres]
    parcels = spark.createDataFrame(rows, "map_num string, parcel_id int, cx double, cy double, polygon array<struct<x:int,y:int>>")
    points = [(m, k, float(x), float(y)) for m in ("a", "b", "c") for k, (x, y) in enumerate([(0, 0), (905, 890), (450, 450), (-5000, 3), (1, 1), (1, 1)])]
    clicks = spark.createDataFrame(points, "map_num string, click int, x double, y double")
    want = {}
    for m, k, x, y in points:
        own = [((cx - x) ** 2 + (cy - y) ** 2, i) for n, i, cx, cy in centres if n == m]
        if own:
            want[m, k] = min(own)[1]
    got = joins.nearest_parcel(clicks, parcels, ["map_num"], "click").collect()
    assert {(r.map_num, r.click): r.parcel_id for r in got} == want and len(got) == len(want)
    hit = joins.clicked_parcel(clicks, parcels, ["map_num"], "click").collect()
    for r in hit:
        inside = [i for m, i, cx, cy in centres if m == r.map_num and int(cx) - 2 <= r.x <= int(cx) + 2 and int(cy) - 2 <= r.y <= int(cy) + 2]
        assert (r.parcel_id, r.inside) == ((min(inside), True) if inside else (want[r.map_num, r.click], False))
    assert len(hit) == len(want)


@pytest.mark.parametrize("most", [0, 1000])
def test_percentiles_of_all_signs(spark, monkeypatch, most):
    monkeypatch.setattr(aggregates, "GROUP_MOST", most)
    rng = np.random.default_rng(12)
    values = {"a": np.r_[rng.normal(0, 1e6, 300), np.zeros(50), [1e-9, -1e-9]], "b": np.array([3.0]), "c": np.repeat([-2.0, 7.0], 5), None: np.array([1.0, 2.0])}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("a", float("nan"))]
    got = {r.k: r for r in aggregates.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k, v in values.items():
        assert [got[k][f"p{p}"] for p in (10, 25, 50, 75, 90)] == pytest.approx(np.percentile(v, [10, 25, 50, 75, 90]).tolist())


def test_triangles(spark):
    """A hub linked to all others, a dense part, and parallel keys, against all triples."""
    rng = np.random.default_rng(13)
    links = {("m", 0, k) for k in range(1, 40)} | {("m", *sorted(p)) for p in rng.integers(1, 15, (60, 2)).tolist() if p[0] != p[1]} | {("n", 1, 2), ("n", 2, 3)}
    got = joins.triangles(spark.createDataFrame([(k, b, a) if a % 2 else (k, a, b) for k, a, b in links], "k string, src int, dst int"), ["k"]).collect()
    want = sorted((k, c, a, b) for k, a, b in links for c in range(40) if (k, *sorted((a, c))) in links and (k, *sorted((b, c))) in links)
    assert sorted(tuple(r) for r in got) == want and want


@pytest.mark.parametrize(("model", "h"), [("translation", [[1, 0, 40], [0, 1, -7], [0, 0, 1]]), ("similarity", [[0.9, -0.3, 40], [0.3, 0.9, -7], [0, 0, 1]]), ("perspective", [[1.1, 0.1, 5], [-0.05, 0.95, 9], [1e-4, -5e-5, 1]])])
def test_a_large_pair_is_fitted_in_parts(spark, monkeypatch, model, h):
    """no task has more than a part of a pair's points, and the fit is that of all its inliers."""
    rng = np.random.default_rng(7)
    src = rng.random((400, 2)) * 1000
    dst = fitting.apply(np.array(h, float), src) + rng.normal(0, 0.4, (400, 2))
    dst[:120] += rng.random((120, 2)) * 900 + 100
    rows = [(p, *map(float, (*d, *s))) for p in ("long", None) for d, s in zip(dst, src, strict=True)] * 2
    rows += [("short", *map(float, (*d, *s))) for d, s in zip(dst[100:180], src[100:180], strict=True)] + [("same", 1.0, 2.0, 3.0, 4.0)] * 900
    points = spark.createDataFrame(rows, "pair string, cx_a double, cy_a double, cx_b double, cy_b double")
    plain = {r.pair: r for r in fitting.fit_pairs(points, model, 4.0).collect()}
    made = {}
    monkeypatch.setattr(fitting, "LOCAL_POINTS", 100, raising=False)
    monkeypatch.setattr(fitting, "materialize", lambda df, name: made.setdefault(name, materialize(df, name)), raising=False)
    got = {r.pair: r for r in fitting.fit_pairs(points, model, 4.0).collect()}
    assert got.keys() == plain.keys() == {"long", None, "short", "same"} and {p: r.n for p, r in got.items()} == {"long": 800, None: 800, "short": 80, "same": 900}
    assert {p: r.n_inliers for p, r in got.items()} == {p: r.n_inliers for p, r in plain.items()}
    for p in got:
        assert got[p].h == (plain[p].h and pytest.approx(plain[p].h, abs=1e-6, rel=1e-6)), p
    parts = made["large-points"].groupBy("pair", "part").count().where("pair is null or pair = 'long'").collect()
    assert len(parts) == 18 and sum(r["count"] for r in parts) == 800 and max(r["count"] for r in parts) <= 100
