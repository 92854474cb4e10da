"""Adjacency discovery: how every pair of sheets fits, in a coarse and a fine search, and each sheet's ranked neighbours.

A sheet is decoded once for its four edge strips, which stand for all quarter turns, and once more where the fine search turns it by
small angles. A pair's strips travel once, and all its configurations are scored together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dimensions
from ..functions import geometry as G
from ..operators import joins, raster, ranks, signal
from ..shared import materialize

STRIP = "map_num string, rotation double, edge string, h int, w int, data binary"
MEASURES = "phase_score double, best_offset_px int, ncc_2d double, density_a double, density_b double"
_NAMES = [c.split()[0] for c in MEASURES.split(", ")]
#: The edge that an edge becomes by a quarter turn counter-clockwise.
TURNED = {"top": "left", "left": "bottom", "bottom": "right", "right": "top"}


def edge_strips(images: DataFrame, edges: tuple[str, ...] = ("left", "right", "top", "bottom"), width: int = 200) -> DataFrame:
    """Strips of the edges of every sheet, cropped."""

    def cut(m, a):
        cropped = raster.auto_crop(raster.gray(a))
        for e in edges:
            s = raster.edge_strip(cropped, e, width)
            yield m, 0.0, e, s.shape[0], s.shape[1], s.tobytes()

    return raster.map_images(images, cut, STRIP)


def quarter_turned(strips: dict[str, np.ndarray], edge: str, rotation: float) -> np.ndarray:
    """The strip at an edge of a sheet after quarter turns, from the strips of the sheet as it is."""
    turns = round(rotation / 90) % 4
    source = next(e for e in strips if _after(e, turns) == edge)
    return np.rot90(strips[source], turns)


def _after(edge: str, turns: int) -> str:
    for _ in range(turns):
        edge = TURNED[edge]
    return edge


def _array(s) -> np.ndarray:
    return raster.to_array(s["h"], s["w"], 1, bytes(s["data"]))


def _with_errors(scored: DataFrame) -> DataFrame:
    return scored.withColumns(signal.orientation_columns(F.col("phase_score"), F.col("ncc_2d"), F.col("density_a"), F.col("density_b")))


def coarse_search(strips: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sixteen scored configurations of every pair; ``strips`` has the four of each sheet."""
    plan = [(k, float(r), a, b) for k, (r, a, b) in enumerate((r, a, b) for r in dimensions.COARSE_ROTATIONS for a, b in dimensions.EDGE_PAIRS)]
    own = strips.groupBy("map_num").agg(F.collect_list(F.struct("edge", "h", "w", "data")).alias("s"))
    side = lambda n: own.select(F.col("map_num").alias(f"map_{n}"), F.col("s").alias(n))
    names = ["map_a", "map_b", "cfg_idx", "total_rot", "edge_a", "edge_b", *_NAMES]

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                at_a, at_b = ({s["edge"]: _array(s) for s in x} for x in (r.a, r.b))
                rows = []
                for k, rotation, edge_a, edge_b in plan:
                    got = signal.strip_scores(at_a[edge_a], edge_a, quarter_turned(at_b, edge_b, rotation), edge_b)
                    rows.append((r.map_a, r.map_b, k, rotation, edge_a, edge_b, *(got[n] for n in _NAMES)))
                yield pd.DataFrame(rows, columns=names)

    met = pairs.select("map_a", "map_b").join(side("a"), "map_a").join(side("b"), "map_b").select("map_a", "map_b", "a", "b")
    scored = met.mapInPandas(run, f"map_a string, map_b string, cfg_idx int, total_rot double, edge_a string, edge_b string, {MEASURES}")
    return _with_errors(scored).withColumns({"coarse_rot": F.col("total_rot"), "fine_rot": F.lit(0.0), "stage": F.lit("coarse")})


def fine_search(images: DataFrame, strips: DataFrame, winners: DataFrame) -> DataFrame:
    """Twenty angles around each pair's coarse winner; B alone is turned, and only by the angles its winners ask for."""
    spark = images.sparkSession
    plan = joins.with_configurations(winners.select("map_a", "map_b", "edge_a", "edge_b", "coarse_rot"), dimensions.fine_angles(spark))
    plan = plan.withColumn("total_rot", F.col("coarse_rot") + F.col("fine_rot")).withColumnRenamed("fine_idx", "cfg_idx")
    asked = plan.groupBy(F.col("map_b").alias("map_num")).agg(F.collect_set(F.struct("total_rot", "edge_b")).alias("asked"))

    def cut(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                cropped = raster.auto_crop(raster.gray(raster.to_array(r.height, r.width, r.n_channels, r.data)))
                by_angle: dict[float, list[str]] = {}
                for x in r.asked:
                    by_angle.setdefault(x["total_rot"], []).append(x["edge_b"])
                for angle, edges in sorted(by_angle.items()):
                    turned = raster.rotate(cropped, angle)
                    for e in sorted(edges):
                        s = raster.edge_strip(turned, e)
                        yield pd.DataFrame([(r.map_num, angle, e, s.shape[0], s.shape[1], s.tobytes())], columns=[c.split()[0] for c in STRIP.split(", ")])

    turned = images.join(asked, "map_num").select("map_num", "height", "width", "n_channels", "data", "asked").mapInPandas(cut, STRIP)
    turned = materialize(turned, "fine-strips").select(F.col("map_num").alias("map_b"), F.col("rotation").alias("total_rot"), F.col("edge").alias("edge_b"), "h", "w", "data")
    still = strips.select(F.col("map_num").alias("map_a"), F.col("edge").alias("edge_a"), "h", "w", "data")
    one = winners.select("map_a", "map_b", "edge_a").join(still, ["map_a", "edge_a"]).select(F.col("map_a").alias("of_a"), F.col("map_b").alias("of_b"), "h", "w", "data")
    many = plan.join(turned, ["map_b", "total_rot", "edge_b"])
    kept = ["map_a", "map_b", "edge_a", "edge_b", "coarse_rot", "cfg_idx", "fine_rot", "total_rot"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, x in a.head(1).iterrows():
            still = _array(x)
            for _, y in b.iterrows():
                got = signal.strip_scores(still, y["edge_a"], _array(y), y["edge_b"])
                rows.append((*(y[c] for c in kept), *(got[n] for n in _NAMES)))
        return pd.DataFrame(rows, columns=[*kept, *_NAMES])

    schema = f"map_a string, map_b string, edge_a string, edge_b string, coarse_rot double, cfg_idx int, fine_rot double, total_rot double, {MEASURES}"
    scored = one.groupBy("of_a", "of_b").cogroup(many.select(*kept, "h", "w", "data").groupBy("map_a", "map_b")).applyInPandas(run, schema)
    return _with_errors(scored).withColumn("stage", F.lit("fine"))


def discover(images: DataFrame, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(best, all): the best orientation of every pair with its confidence gap, and all scored rows."""
    pairs = joins.sheet_pairs(images) if pairs is None else pairs
    strips = materialize(edge_strips(images), "strips")
    coarse = materialize(coarse_search(strips, pairs), "coarse")
    winners = materialize(ranks.best_and_gap(coarse, ["map_a", "map_b"], "error", "cfg_idx"), "winners")
    fine = materialize(fine_search(images, strips, winners), "fine")
    columns = [c for c in coarse.columns if c in fine.columns]
    best = ranks.best_of_union(winners.select(*columns), fine.select(*columns), ["map_a", "map_b"], "error", "cfg_idx")
    best = best.join(winners.select("map_a", "map_b", "gap"), ["map_a", "map_b"]).withColumn("pair_key", G.F.concat_ws("_", "map_a", "map_b"))
    return best, coarse.select(*columns).unionByName(fine.select(*columns))


def ranked_neighbours(best: DataFrame, top: int | None = None) -> DataFrame:
    """Each sheet's other sheets by score, from either side of a pair: map_num, rank, other, score, error, edge, rotation, gap, pair_key."""
    rows = joins.both_roles(best.select("map_a", "map_b", "edge_a", "edge_b", F.col("combined_score").alias("score"), "error", F.col("total_rot").alias("rotation"), "gap", "pair_key"))
    w = Window.partitionBy("map_num").orderBy(F.desc("score"), "pair_key")
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= top) if top else ranked
