"""Connected regions of pixels over tiles, so that one sheet of any size is spread over tasks.

Pixels are a table. A tile labels its own pixels by itself; then the pixels on tiles' borders meet those of the tiles beside, which says what labels touch; and the
components of this much smaller graph of labels join the regions. Nothing holds more of a sheet than a tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize
from . import graph, raster

TILE = 512
MOST = 100_000  # roots that are broadcast
LABEL = "struct<map_num:string,y:int,x:int>"


def _label_tile(size: int):
    """The pixels of a tile, each with the first pixel of its region in the tile."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        mask = np.zeros((size, size), bool)
        mask[y % size, x % size] = True
        label = raster.components(mask)
        own = label[y % size, x % size]
        order = np.lexsort((x, y))
        _, first = np.unique(own[order], return_index=True)
        heads = order[first]
        at = np.zeros(own.max() + 1, np.int64)
        at[own[heads]] = heads
        return pd.DataFrame({"map_num": pdf["map_num"], "y": y, "x": x, "ly": y[at[own]], "lx": x[at[own]]})

    return run


def labelled(pixels: DataFrame, size: int = TILE) -> DataFrame:
    """map_num, y, x and label of every pixel: a label (map_num, y, x) is the first pixel of its region by sheet, row and column; pixels touch by sides and corners.

    ``pixels`` has map_num, y, x (0 or more), repeats count once, and rows with nulls are left out. The rows do not depend on ``size``.
    """
    known = pixels.select(F.col("map_num").cast("string").alias("map_num"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).where("map_num is not null and y >= 0 and x >= 0").distinct()
    tiled = known.groupBy("map_num", F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx"))
    own = materialize(tiled.applyInPandas(_label_tile(size), "map_num string, y int, x int, ly int, lx int"), "tile-labels")
    label = F.struct("map_num", F.col("ly").alias("y"), F.col("lx").alias("x"))
    # a pixel in the last row or column of a tile, or the first column, sees the pixels after it in other tiles; so each pair of pixels meets once
    side = lambda c: F.col(c) % size
    border = own.where((side("y") == size - 1) | (side("x") == size - 1) | (side("x") == 0))
    ahead = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    asked = border.select("map_num", label.alias("src"), "y", "x", F.inline(ahead))
    asked = asked.withColumns({"ny": F.col("y") + F.col("dy"), "nx": F.col("x") + F.col("dx")})
    outside = (F.floor(F.col("ny") / size) != F.floor(F.col("y") / size)) | (F.floor(F.col("nx") / size) != F.floor(F.col("x") / size))
    halo = own.where((side("y") == 0) | (side("x") == size - 1) | (side("x") == 0)).select("map_num", F.col("y").alias("ny"), F.col("x").alias("nx"), label.alias("dst"))
    seams = materialize(asked.where(outside).hint("merge").join(halo, ["map_num", "ny", "nx"]).select("src", "dst").distinct(), "seams")
    roots = materialize(graph.connected_components(seams), "region-roots").select(F.col("node").alias("of"), "root")
    # files of sorted labels are a small part of what they take in memory, so their size says nothing about a broadcast
    roots = F.broadcast(roots) if roots.count() <= MOST else roots.hint("merge")
    return own.select("map_num", "y", "x", label.alias("_own")).join(roots, F.col("_own") == F.col("of"), "left").select("map_num", "y", "x", F.coalesce("root", "_own").alias("label"))


def regions(pixels: DataFrame, size: int = TILE) -> DataFrame:
    """map_num, label_y, label_x, area and box (y0, x0, y1, x1) of every region; tiles sum up their parts first."""
    each = labelled(pixels, size).groupBy("map_num", F.col("label.y").alias("label_y"), F.col("label.x").alias("label_x"))
    return each.agg(F.count("*").alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))


def without_small_regions(pixels: DataFrame, least: int = 8, size: int = TILE) -> DataFrame:
    """The pixels of regions with at least ``least`` pixels: map_num, y, x."""
    own = materialize(labelled(pixels, size), "labelled")
    large = own.groupBy("label").agg(F.count("*").alias("area")).where(F.col("area") >= least).select("label")
    return own.join(large, "label", "left_semi").select("map_num", "y", "x")
