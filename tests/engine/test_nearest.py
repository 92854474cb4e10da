"""The k-d forest against the exact join."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.operators import joins, nearest

SCHEMA = "pair string, kp_id long, descriptor array<double>"


def low_dimensional(n, seed, dims=128, inner=6):
    """Descriptors as images give them: many columns that follow from a few."""
    rng = np.random.default_rng(seed)
    return np.tanh(rng.normal(size=(n, inner)) @ np.random.default_rng(0).normal(size=(inner, dims))) + rng.normal(size=(n, dims)) * 0.02


def frame(spark, x, pair="p", start=0):
    return [(pair, start + k, v.tolist()) for k, v in enumerate(x)]


def test_leaves_hold_each_row_once_and_probes_widen():
    x = low_dimensional(500, 1, 16)
    axis, cut = nearest.fit_tree(x, 4, 7)
    own = nearest.leaves_of(x, axis, cut)[:, 0]
    assert len(np.unique(own)) == 16 and np.bincount(own).max() < 80
    for probes in (2, 5, 16, 40):
        more = nearest.leaves_of(x, axis, cut, probes)
        assert more.shape == (500, min(probes, 16)) and (np.sort(more, axis=1)[:, 1:] > np.sort(more, axis=1)[:, :-1]).all()
        assert (more == own[:, None]).any(axis=1).all()
    assert nearest.leaves_of(x, *nearest.fit_tree(x, 0, 1)).tolist() == [[0]] * 500


def test_few_leaves_find_nearly_all_and_distances_are_exact(spark):
    train, asked = low_dimensional(3000, 2), low_dimensional(400, 3)
    t = spark.createDataFrame(frame(spark, train), SCHEMA)
    q = spark.createDataFrame(frame(spark, asked, start=10_000), SCHEMA)
    forest = nearest.fit_forest(t, ["pair"], leaf=64)
    assert forest.placed.groupBy("tree").count().collect() and {r["count"] for r in forest.placed.groupBy("tree").count().collect()} == {3000}
    probes = nearest.tuned_probes(q, t, forest, 0.95)
    assert probes is not None and probes <= 16  # of 64 leaves
    found = nearest.forest_nearest(q, forest, probes)
    assert nearest.recall(found, joins.nearest_two(q, t, ["pair"]), ["pair"]).first().recall >= 0.9
    d = {(r.q_id - 10_000, x.t_id): x.d for r in found.collect() for x in r.n}
    assert all(v == pytest.approx(np.linalg.norm(asked[a] - train[b])) for (a, b), v in d.items())


def test_all_leaves_equal_the_exact_join(spark):
    rng = np.random.default_rng(4)
    rows = [r for p, n in (("a", 300), ("b", 40), ("c", 1)) for r in frame(spark, rng.normal(size=(n, 8)), p)]
    t = spark.createDataFrame(rows + [("a", None, [0.0] * 8), ("a", 999, None)], SCHEMA)
    q = spark.createDataFrame([r for p in "abcd" for r in frame(spark, rng.normal(size=(30, 8)), p, 5000)] + [("a", None, [1.0] * 8)], SCHEMA)
    as_set = lambda df: {(r.pair, r.q_id, r.t_id, round(r.d1, 9), round(r.d2, 9)) for r in df.collect()}
    clean = t.where("kp_id is not null and descriptor is not null"), q.where("kp_id is not null")
    want = as_set(joins.ratio_matches(clean[1], clean[0], ["pair"], 0.95))
    for how in ({"probes": 1 << 10}, {"exact": True}, {"least_recall": 1.0}):
        assert as_set(nearest.forest_matches(q, t, ["pair"], 0.95, leaf=16, **how)) == want, how


def test_equal_descriptors_in_one_leaf_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 50)
    monkeypatch.setattr(nearest, "CHUNK", 64)
    same = [("p", k, [1.0, 2.0, 3.0]) for k in range(300)] + [("p", 1000 + k, [float(k), 0.0, -1.0]) for k in range(60)]
    t = spark.createDataFrame(same, SCHEMA)
    q = spark.createDataFrame([("p", k, [1.0, 2.0, 3.0]) for k in range(5000, 5200)], SCHEMA)
    got = nearest.nearest_two(q, t, ["pair"], probes=1, leaf=16).collect()
    assert len(got) == 200 and all([(x.d, x.t_id) for x in r.n] == [(0.0, 0), (0.0, 1)] for r in got)


def test_empty_sides(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(frame(spark, np.eye(4)), SCHEMA)
    assert nearest.forest_matches(none, some, ["pair"]).collect() == []
    assert nearest.forest_matches(some, none, ["pair"]).collect() == []


def test_vectors_in_many_leaves_are_no_broadcast(spark):
    """the table of queries by leaves is small as a file, as a vector stands there once for each leaf, and large in memory."""
    t = spark.createDataFrame(frame(spark, low_dimensional(300, 5, 16)), SCHEMA)
    forest = nearest.fit_forest(t, ["pair"], leaf=16)
    plan = nearest.forest_nearest(t, forest, 8)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_no_more_leaves_than_are_worth_it(spark, monkeypatch):
    """directions that vary alike need most leaves; the exact join compares fewer rows than a query would be sent to leaves."""
    asked, real = [], nearest.forest_nearest
    monkeypatch.setattr(nearest, "forest_nearest", lambda q, f, probes: asked.append(probes) or real(q, f, probes))
    x = np.random.default_rng(6).normal(size=(600, 32))
    t = spark.createDataFrame(frame(spark, x), SCHEMA)
    assert nearest.tuned_probes(t, t, nearest.fit_forest(t, ["pair"], leaf=4), 0.99) is None
    assert max(asked) * nearest.TREES < 64
