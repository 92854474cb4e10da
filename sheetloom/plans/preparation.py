"""Preparation of scanned sheets: clean and binary images with their quality figures, edges, segments and parcels."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, filters, raster


def prepare(images: DataFrame, denoise: bool = True) -> DataFrame:
    """map_num, clean and binary images, and sharpness and contrast before and after, one sheet a row."""
    def run(m, a):
        began = time.time()
        before = raster.gray(a)
        g = raster.gray(raster.separate_ink(a))
        g = raster.bilateral(g) if denoise else g
        g = raster.correct_perspective(raster.correct_skew(raster.equalize_tiles(g)))
        binary = ~raster.clean_mask(raster.adaptive_threshold(g) == 0)
        yield (
            m, *g.shape, g.tobytes(), np.where(binary, 255, 0).astype(np.uint8).tobytes(), time.time() - began,
            raster.laplacian_variance(before), raster.laplacian_variance(g), float(before.std()), float(g.std()),
        )

    return raster.map_images(images, run, "map_num string, height int, width int, clean binary, binary binary, elapsed double, sharpness_before double, sharpness_after double, contrast_before double, contrast_after double")


def summary(prepared: DataFrame) -> DataFrame:
    return aggregates.run_means(prepared)


def segments(images: DataFrame) -> DataFrame:
    """Straight segments of every sheet's edges: map_num, height, width, x1, y1, x2, y2."""
    def run(m, a):
        found = raster.without_small(raster.dilate(raster.gradient_edges(raster.gray(a)), raster.ellipse(3)))
        for s in raster.line_segments(found):
            yield m, a.shape[0], a.shape[1], *s

    return raster.map_images(images, run, "map_num string, height int, width int, x1 int, y1 int, x2 int, y2 int")


def edge_profiles(images: DataFrame) -> DataFrame:
    """Sorted crossings of segments with each edge of every sheet."""
    s = filters.edge_crossings(segments(images), F.col("width"), F.col("height"))
    return s.groupBy("map_num", "edge").agg(F.sort_array(F.collect_list("crossing")).alias("crossings"))


def parcels(images: DataFrame) -> DataFrame:
    """Parcels with their shape statistics."""
    found = raster.parcels_of(images).withColumn("bbox", F.struct(*[F.col(f"bbox_{c}").alias(c) for c in "xywh"]))
    sized = found.join(images.select("map_num", (F.col("height") * F.col("width")).alias("pixels")), "map_num")
    return filters.parcel_stats(sized, F.col("pixels")).drop("pixels")


def training_splits(images: DataFrame, parcel_rows: DataFrame, per_sheet: dict[str, int], size: int = 512) -> DataFrame:
    """Seeded, augmented crops by split, with ids that are unique within a split: split, id, map_num, data, polygons."""
    out = None
    for k, (split, n) in enumerate(sorted(per_sheet.items())):
        made = raster.training_crops(images, parcel_rows, n, size, seed=1000 * (k + 1)).withColumn("split", F.lit(split))
        out = made if out is None else out.unionByName(made)
    return out.withColumn("id", F.concat_ws("-", "split", "map_num", "crop"))
