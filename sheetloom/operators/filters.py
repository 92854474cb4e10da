"""Projections and predicates on parcels, readings, keypoints, segments and cache records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def node_features(parcels: DataFrame, width: Column, height: Column) -> DataFrame:
    """Scale-free features of each parcel as a graph node; ``bbox`` gives the box, a missing area is the box's, a missing confidence 1."""
    w, h = F.greatest(width, F.lit(1)), F.greatest(height, F.lit(1))
    bw, bh = F.col("bbox.w"), F.col("bbox.h")
    area = F.coalesce(F.col("area_px"), (bw * bh).cast("double"))
    ncx, ncy = F.col("cx") / w, F.col("cy") / h
    return parcels.select(
        "map_num", F.col("parcel_id").alias("id"), area.cast("double").alias("area_px"), (area / F.greatest(height * width, F.lit(1))).alias("norm_area"),
        bw.cast("double").alias("bbox_w"), bh.cast("double").alias("bbox_h"), (bw / F.greatest(bh, F.lit(1))).alias("aspect_ratio"),
        (F.least(bw, bh) / F.greatest(bw, bh, F.lit(1))).alias("compactness"), (2 * (bw + bh)).cast("double").alias("perim_estimate"),
        ncx.alias("norm_cx"), ncy.alias("norm_cy"), F.least(F.col("cx") / w, (width - F.col("cx")) / w, F.col("cy") / h, (height - F.col("cy")) / h).alias("dist_boundary"),
        F.sqrt((ncx - 0.5) * (ncx - 0.5) + (ncy - 0.5) * (ncy - 0.5)).alias("dist_centre"), F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"),
        F.coalesce(F.col("confidence"), F.lit(1.0)).alias("confidence"),
    )


def edge_features(pairs: DataFrame) -> DataFrame:
    """Features of linked parcels: ``pairs`` has structs a and b with cx, cy, bbox and area_px."""
    a, b = F.col("a"), F.col("b")
    dx, dy = b["cx"] - a["cx"], b["cy"] - a["cy"]
    return pairs.withColumns(
        {"distance": F.hypot(dx, dy), "iou": G.box_iou(a["bbox"], b["bbox"]), "angle": F.atan2(dy, dx), "size_ratio": G.area_ratio(a["area_px"], b["area_px"])}
    )


def parcel_stats(parcels: DataFrame, sheet_pixels: Column) -> DataFrame:
    """Shape statistics of contours: area_px, polygon and bbox, hull_area where known; zero where a ratio has no base."""
    perimeter = G.polygon_perimeter(F.col("polygon"))
    return parcels.withColumns({
        "area_frac": F.col("area_px") / sheet_pixels,
        "perimeter_px": perimeter,
        "aspect_ratio": F.when(F.col("bbox.h") > 0, F.col("bbox.w") / F.col("bbox.h")).otherwise(0.0),
        "solidity": F.when(F.col("hull_area") > 0, F.col("area_px") / F.col("hull_area")).otherwise(0.0),
        "compactness": F.when(perimeter > 0, 4 * F.pi() * F.col("area_px") / (perimeter * perimeter)).otherwise(0.0),
    })


def contours_v1(contours: DataFrame, sheet_pixels: Column) -> DataFrame:
    """Outer contours of 500 pixels to 85 % of the sheet, with an area and whole-numbered centroids."""
    return contours.where((F.col("parent") == -1) & F.col("area_px").between(500, 0.85 * sheet_pixels) & (F.col("m00") != 0)).withColumns(
        {"cx": (F.col("m10") / F.col("m00")).cast("int"), "cy": (F.col("m01") / F.col("m00")).cast("int")}
    )


def contours_v2(contours: DataFrame, sheet_pixels: Column) -> DataFrame:
    """Contours of 800 pixels to 80 % of the sheet with sides of 25 pixels at least."""
    return contours.where(F.col("area_px").between(800, 0.80 * sheet_pixels) & (F.col("bbox.w") >= 25) & (F.col("bbox.h") >= 25))


def crop_parcels(parcels: DataFrame) -> DataFrame:
    return parcels.where(F.col("area_px").between(1000, 300_000) & (F.col("bbox.w") >= 20) & (F.col("bbox.h") >= 20) & F.col("polygon").isNotNull())


def detections_to_parcels(detections: DataFrame, width: Column, height: Column) -> DataFrame:
    """Detections of tiles as parcels of sheets: score of a half at least, boxes kept within the sheet, sides of 5 and areas of 500 pixels at least.

    ``detections``: map_num, tile (x, y), idx, score, box (x0, y0, x1, y1 within the tile), polygon. Ids count from 0 by tile and index.
    """
    x0, y0 = (F.least(F.greatest(F.col(f"box.{c}0") + F.col(f"tile.{c}"), F.lit(0)), s) for c, s in (("x", width), ("y", height)))
    x1, y1 = (F.least(F.greatest(F.col(f"box.{c}1") + F.col(f"tile.{c}"), F.lit(0)), s) for c, s in (("x", width), ("y", height)))
    placed = detections.where(F.col("score") >= 0.5).withColumn("bbox", F.struct(x0.cast("int").alias("x"), y0.cast("int").alias("y"), (x1 - x0).cast("int").alias("w"), (y1 - y0).cast("int").alias("h")))
    kept = placed.where((F.col("bbox.w") >= 5) & (F.col("bbox.h") >= 5) & (F.col("bbox.w") * F.col("bbox.h") >= 500))
    order = Window.partitionBy("map_num").orderBy("tile.y", "tile.x", "idx")
    moved = F.transform("polygon", lambda p: F.struct((p["x"] + F.col("tile.x")).cast("int").alias("x"), (p["y"] + F.col("tile.y")).cast("int").alias("y")))
    return kept.select(
        "map_num", (F.row_number().over(order) - 1).alias("parcel_id"), (F.col("bbox.x") + F.col("bbox.w") / 2).alias("cx"), (F.col("bbox.y") + F.col("bbox.h") / 2).alias("cy"),
        "bbox", (F.col("bbox.w") * F.col("bbox.h")).cast("double").alias("area_px"), moved.alias("polygon"), F.col("score").cast("double").alias("confidence"), F.col("tile").alias("source_tile"),
    )


def plausible_crops(parcels: DataFrame, width: Column, height: Column, margin: int = 25, least: int = 50, most: int = 1500) -> DataFrame:
    """Parcels whose box with a margin, kept within the sheet, has sides within bounds."""
    w = F.least(F.col("bbox.x") + F.col("bbox.w") + margin, width) - F.greatest(F.col("bbox.x") - margin, F.lit(0))
    h = F.least(F.col("bbox.y") + F.col("bbox.h") + margin, height) - F.greatest(F.col("bbox.y") - margin, F.lit(0))
    return parcels.where(w.between(least, most) & h.between(least, most))


def plausible_crop_areas(parcels: DataFrame, least: int = 50, most_area: float = 1.5e6) -> DataFrame:
    return parcels.where((F.col("bbox.w") >= least) & (F.col("bbox.h") >= least) & (F.col("bbox.w").cast("double") * F.col("bbox.h") <= most_area))


def only_ids(df: DataFrame, ids: DataFrame, column: str = "parcel_id") -> DataFrame:
    """Rows whose id is in a table of ids."""
    return df.join(ids.select(column).distinct(), column, "left_semi")


def confident_lines(lines: DataFrame, least: float = 0.30) -> DataFrame:
    return lines.where((F.col("confidence") >= least) & (F.trim("text") != ""))


def edge_band(parcels: DataFrame, width: Column, height: Column, edge: Column, band: float = 1200.0) -> DataFrame:
    return parcels.where(G.in_edge_band(F.col("cx"), F.col("cy"), width, height, edge, band))


def without(df: DataFrame, excluded: list[str], column: str = "map_num") -> DataFrame:
    return df.where(~F.col(column).isin(excluded)) if excluded else df


def without_errors(df: DataFrame) -> DataFrame:
    return df.where(F.col("error_msg").isNull())


def finite_transforms(df: DataFrame, column: str = "h") -> DataFrame:
    return df.where(G.is_finite_matrix(F.col(column)))


def needs_recall(number: Column, raw: Column, error: Column, rotation: Column, current_rotation: int) -> Column:
    """Whether a cached record is stale: a failed call, or one for another rotation; a missing rotation is 0."""
    failed = (F.coalesce(error, F.lit("")) != "") & number.isNull() & ~F.coalesce(raw, F.lit("")).isin("SKIP_CROP", "NONE")
    turned = (F.coalesce(raw, F.lit("")) != "SKIP_CROP") & (F.coalesce(rotation, F.lit(0)) != current_rotation)
    return failed | turned


def recall_worklist(parcels: DataFrame, cache: DataFrame, rotation: int = 0) -> DataFrame:
    """Parcels without a valid cached record; the cache has one row a parcel."""
    valid = cache.where(~needs_recall(F.col("number"), F.col("raw"), F.col("error"), F.col("rotation"), rotation))
    return parcels.join(valid.select("map_num", "parcel_id"), ["map_num", "parcel_id"], "left_anti")


def by_component_size(pixels: DataFrame, label: list[str], least: int = 8) -> DataFrame:
    """Pixels of components of at least ``least`` pixels."""
    big = pixels.groupBy(*label).count().where(F.col("count") >= least).select(*label)
    return pixels.join(big, label, "left_semi")


def varied_keypoints(keypoints: DataFrame, variance: Column, least: float = 50.0) -> DataFrame:
    """Keypoints in patches of some contrast; ``variance`` comes from the raster kernel for local variance."""
    return keypoints.where(variance >= least)


def edge_crossings(segments: DataFrame, width: Column, height: Column) -> DataFrame:
    """edge, crossing of every segment that meets an edge, one row each."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    each = F.array(*[F.struct(F.lit(e).alias("edge"), G.edge_crossing(x1, y1, x2, y2, width, height, e).alias("crossing")) for e in ("left", "right", "top", "bottom")])
    return segments.select("*", F.inline(each)).where(F.col("crossing").isNotNull())


def overlaps_heavily(x: Column, y: Column, w: Column, h: Column, px: Column, py: Column, pw: Column, ph: Column, share: float = 0.45) -> Column:
    """Whether a box overlaps another by more than ``share`` of its own sides in both directions."""
    ox, oy = F.least(x + w, px + pw) - F.greatest(x, px), F.least(y + h, py + ph) - F.greatest(y, py)
    return (ox > share * w) & (oy > share * h)


PLACED_MOST = 100_000


def free_places(candidates: DataFrame, placed: DataFrame) -> DataFrame:
    """Candidate boxes (x, y, w, h) that overlap no placed box heavily.

    ``placed`` is one panorama's boxes, some tens of rows, and is sent to all tasks; more than ``PLACED_MOST`` are no single panorama and raise.
    """
    if placed.count() > PLACED_MOST:
        raise ValueError(f"more than {PLACED_MOST} placed boxes: test components one by one")
    p = F.broadcast(placed.select(*[F.col(c).alias(f"p{c}") for c in ("x", "y", "w", "h")]))
    return candidates.join(p, overlaps_heavily(*[F.col(c) for c in ("x", "y", "w", "h", "px", "py", "pw", "ph")]), "left_anti")


def hit_side(h: Column, x: Column, y: Column, width_a: Column, height_a: Column, width_b: Column, height_b: Column) -> Column:
    """Which sheet a point of A's frame lies on, B's by the inverse of its transform: A, B, overlap, or null."""
    back = G.project(G.inverse(h), x, y)
    on_a = x.between(0, width_a - 1) & y.between(0, height_a - 1)
    on_b = F.coalesce(back["x"].between(0, width_b - 1) & back["y"].between(0, height_b - 1), F.lit(False))
    return F.when(on_a & on_b, "overlap").when(on_a, "A").when(on_b, "B")


def is_sheet_outline(area: Column, corners: Column, sheet_pixels: Column, least: float = 0.30) -> Column:
    """Whether a contour can be the sheet itself: large enough, with four corners."""
    return (area >= least * sheet_pixels) & (F.size(corners) == 4)
