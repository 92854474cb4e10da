"""Queries over tables repeated with shifted keys, against their SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sheetloom import catalog
from sheetloom.operators import joins, spots

DATA = Path("/root/testdata/sf0.001")


def repeated(folder: Path, table: str, key: str, step: int, times: int) -> str:
    """A folder with ``table`` repeated, keys shifted by ``step`` each time, and the fixed small tables."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT t.* REPLACE (t.{key} + g.i * {step} AS {key}) FROM '{DATA}/{table}.parquet' t, range({times}) g(i)) TO '{folder}/{table}.parquet' (FORMAT parquet)").fetchall()
    for name in ("nation", "region"):
        (folder / f"{name}.parquet").write_bytes((DATA / f"{name}.parquet").read_bytes())
    return str(folder)


def rows_of(spark, folder: str, name: str) -> tuple[list, list]:
    """A query's rows and those of its SQL, sorted, as text."""
    plain = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got = catalog.queries()[name](spark, folder)
    want = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    return sorted(tuple(plain(r[c]) for c in names) for r in got.collect()), sorted(tuple(plain(v) for v in r) for r in want.fetchall())


def test_only_the_unreadable_crop_fails_among_many_suppliers(spark, tmp_path):
    """supplier 1003 has the same number as the one that can't be read."""
    got, want = rows_of(spark, repeated(tmp_path, "supplier", "s_suppkey", 1000, 2), "recognised_crops")
    assert got == want


@pytest.mark.parametrize("name", ["connected_components", "degree_density", "graph_stats_rollup", "knn_prune_setbased", "parallel_prune", "radius_self_join", "sequential_prune"])
def test_points_that_share_their_places(spark, tmp_path, name):
    """Copies of a point are linked to each other and to the same others."""
    got, want = rows_of(spark, repeated(tmp_path, "part", "p_partkey", 200, 4), name)
    assert got == want and got


def test_points_meet_by_a_shuffle_and_copies_are_counted(spark, tmp_path):
    """no side of the radius join is a broadcast. F9, F11, F22: tables of links to prune or count do not grow with the square of the copies."""
    folder = repeated(tmp_path, "part", "p_partkey", 200, 4)
    points = catalog._points(spark, folder)
    plan = joins.radius_pairs(points, 25.0, ["map_num"])._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    n = points.count()
    assert spots.outward_links(points, 25.0, 3).count() <= 3 * n < joins.radius_pairs(points, 100.0, ["map_num"]).count()
    assert spots.link_counts(points, 25.0, ["map_num"]).count() < n


@pytest.mark.parametrize("name", ["knn_ratio_test", "label_pair_best_runnerup", "per_label_candidate_rank", "shape_cost_percentiles", "shape_distinct_matched", "shape_topk_candidates"])
def test_vectors_with_copies(spark, tmp_path, name):
    """Copies are equally far from others, and of equals the first ids count."""
    got, want = rows_of(spark, repeated(tmp_path, "embeddings", "vec_id", 200, 3), name)
    assert got == want and (got or name == "knn_ratio_test")


def test_contours_with_copies_and_no_table_of_pairs(spark, tmp_path, monkeypatch):
    """a block gives a row for each contour, not for each pair."""

    def whole(*_):
        raise AssertionError("the table of all pairs")

    monkeypatch.setattr(joins, "area_gated_pairs", whole)
    got, want = rows_of(spark, repeated(tmp_path, "embeddings", "vec_id", 200, 3), "contour_costs")
    assert got == want and got


def test_a_block_gives_only_pairs_that_may_count(spark):
    """four or two rows of each block leave a task, with ties by id, not all pairs."""
    from sheetloom.operators import blocks

    side = spark.range(90).selectExpr("0 as k", "id", "array(cast(id % 9 as double), 0.5D) as v")
    every = blocks.block_pairs(side, side, ["k"], block=30)
    assert every.count() == 8100
    near = blocks.block_pairs(side, side, ["k"], blocks.nearest_of_each(2), block=30)
    parts = every.sparkSession.range(90).selectExpr(f"pmod(xxhash64(id), 3) as p").distinct().count()
    assert near.count() <= 90 * 2 * parts
    best = sorted((r.cost, r.b) for r in near.where("a = 40").collect())[:2]
    assert best == [(0.0, 4), (0.0, 13)]
    assert blocks.block_pairs(side, side, ["k"], blocks.least_of_all(2, lambda a, b: 100 * a + b), block=30).count() <= 2 * parts * parts


def test_each_moment_is_made_once(spark):
    """the invariants ask for ten passes over a polygon, not for each use of a moment."""
    from sheetloom.functions import geometry as G

    corners = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)]
    one = spark.createDataFrame([([{"x": x, "y": y} for x, y in corners],)], "polygon array<struct<x double, y double>>").select(G.hu_moments(F.col("polygon")).alias("hu"))
    assert one._jdf.queryExecution().analyzed().toString().count("aggregate(") <= 10
    hu = one.first().hu
    assert abs(hu[0] - (16 + 4) / (12 * 8)) < 1e-9 and abs(hu[1] - ((16 - 4) / (12 * 8)) ** 2) < 1e-9


def test_parcels_of_a_large_sheet_are_in_several_documents(spark, tmp_path, monkeypatch):
    """a document is one task, so it holds about a page of parcels, however many its sheet has."""
    from sheetloom import catalog_files
    from sheetloom.sources import readers

    folder = repeated(tmp_path, "part", "p_partkey", 1000, 5)
    monkeypatch.setattr(catalog_files, "PAGE", 20, raising=False)
    documents = readers.parcels(spark, catalog_files._parcel_files(spark, folder)).groupBy("map_num", F.input_file_name()).count().collect()
    assert sum(r["count"] for r in documents) == 1000 and {r.map_num for r in documents} == {str(n) for n in range(43, 50)}
    assert len(documents) > 40 and max(r["count"] for r in documents) < 60
    for name in ("read_parcels", "read_signed_parcels", "written_parcels"):
        got, want = rows_of(spark, folder, name)
        assert got == want and got


def test_a_parcel_is_signed_once(spark, tmp_path):
    """the signature is made once for the filter, from edges that are made once."""
    from sheetloom.sources import readers

    (tmp_path / "map_45_parcels.json").write_text("[]")
    plan = readers.signed_parcels(spark, str(tmp_path)).select("parcel_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 10
    assert plan.count("pmod(") <= 2


def dense(folder: Path, rows: int = 1500) -> str:
    """A folder with parts of two brands at places of their own, close together, with some copies."""
    con = duckdb.connect()
    places = f"SELECT i AS p_partkey, 'a b' AS p_name, 'Brand#' || (i % 2) AS p_brand, 'S' AS p_type, (1 + i * 7 % 11)::INT AS p_size, 900 + (i * 37 % 700) / 10.0::DOUBLE AS p_retailprice FROM range({rows}) r(i)"
    con.execute(f"COPY (SELECT * FROM ({places})) TO '{folder}/part.parquet' (FORMAT parquet)").fetchall()
    return str(folder)


def test_neither_pairs_nor_triangles_are_listed(spark, tmp_path, monkeypatch):
    """F1 of round 4: points at places of their own have more pairs and triangles than a disk holds; cells are moved instead, large ones in parts."""

    def listed(*_):
        raise AssertionError("pairs or triangles as a table")

    monkeypatch.setattr(joins, "triangles", listed)
    monkeypatch.setattr(joins, "radius_pairs", listed)
    folder = dense(tmp_path)
    for most in (4096, 20):
        monkeypatch.setattr(spots, "CELL", most, raising=False)
        got, want = rows_of(spark, folder, "degree_density")
        assert got == want and len(got) == 1500


def test_percentiles_make_no_row_for_a_pair(spark, tmp_path, monkeypatch):
    """F2 of round 4: blocks give counts of costs and the few between limits; copies, whose costs are equal, and several blocks a side come to the same."""
    from sheetloom.operators import blocks

    def listed(*_, **__):
        raise AssertionError("a row for each pair")

    folder = repeated(tmp_path, "embeddings", "vec_id", 200, 3)
    monkeypatch.setattr(blocks, "block_pairs", listed)
    one = blocks.pair_percentiles
    for block in (1024, 20):
        monkeypatch.setattr(blocks, "pair_percentiles", lambda *a, block=block, **k: one(*a, block=block, **k), raising=False)
        got, want = rows_of(spark, folder, "shape_cost_percentiles")
        assert got == want and got


def test_a_row_goes_to_few_blocks_however_many_rows_there_are(spark):
    """F4, F7 to F9 of round 4: copies of a row stay some, so what is moved grows with the rows."""
    from sheetloom.operators import blocks

    side = spark.range(2000).selectExpr("0 as k", "id", "array(cast(id * 7 % 1999 as float), 0.5F) as v", "cast(id % 5 as double) as size")
    near = blocks.block_pairs(side, side, ["k"], blocks.nearest_of_each(1), gate=1.5, weight=0.4, block=100).toPandas()
    assert near.groupby("a").size().max() <= 4 and near["a"].nunique() == 2000
    best = near.sort_values(["cost", "b"]).groupby("a").first()
    assert (best["cost"] == 0).all() and (best["b"] == best.index.where(best.index < 1999, 0)).sum() >= 1999 - 1


@pytest.mark.parametrize("name", ["knn_prune_setbased", "parallel_prune", "sequential_prune"])
def test_nearest_points_are_found_without_listing_pairs(spark, tmp_path, monkeypatch, name):
    """F3, F5 of round 4: a point has at most three links before any pruning, found in cells, of which large ones are seen in parts."""

    def listed(*_):
        raise AssertionError("pairs of spots as a table")

    monkeypatch.setattr(joins, "radius_pairs", listed)
    folder = dense(tmp_path, 300)
    for most in (4096, 10):
        monkeypatch.setattr(spots, "CELL", most, raising=False)
        got, want = rows_of(spark, folder, name)
        assert got == want and got
