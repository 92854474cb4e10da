"""Control points between sheets: from shared numbers, from shapes one to one, and from shapes by cheapest candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fitting, joins, matching, ranks
from ..shared import materialize


def from_numbers(readings: DataFrame, pairs: DataFrame, priors: DataFrame, boundary: DataFrame | None = None, most: int = 20, within: float = 400.0, direction: str = "b_to_a") -> tuple[DataFrame, DataFrame]:
    """(points, fits) from numbers that both sheets of a pair read, nearest under the prior; robust fits keep the inliers.

    ``readings``: map_num, number, parcel_id, cx, cy; ``priors``: map_a, map_b, h, offset_x, offset_y.
    """
    found = joins.shared_numbers(readings, pairs, most).join(priors.select("map_a", "map_b", "h", "offset_x", "offset_y"), ["map_a", "map_b"])
    residual = joins.prior_residual(F.col("h"), F.col("a.cx"), F.col("a.cy"), F.col("b.cx"), F.col("b.cy"), F.col("offset_x"), F.col("offset_y"), direction)
    near = joins.nearest_shared(found, residual, within)
    flat = near.select(
        F.concat_ws("_", "map_a", "map_b").alias("pair"), F.lit("numbers").alias("method"), "number", F.col("a.parcel_id").alias("parcel_a"), F.col("b.parcel_id").alias("parcel_b"),
        F.col("a.cx").alias("cx_a"), F.col("a.cy").alias("cy_a"), F.col("b.cx").alias("cx_b"), F.col("b.cy").alias("cy_b"), "residual", "n_dup_a", "n_dup_b",
    )
    if boundary is not None:
        known = boundary.groupBy("number").agg(F.collect_set("map_num").alias("maps"))
        flat = flat.join(known, "number", "left").withColumn("is_csv_known", F.col("maps").isNotNull()).drop("maps")
    points = materialize(flat, "number-points")
    return points, fitting.fit_pairs(points)


def from_shapes(parcels_a: DataFrame, parcels_b: DataFrame, accept: float = 0.6, threshold: float = 400.0) -> tuple[DataFrame, DataFrame]:
    """(points, fits) from contours of similar size, least-cost one to one. Sides: pair, parcel_id, cx, cy, area, hu."""
    costs = joins.contour_costs(parcels_a, parcels_b, ["pair"])
    chosen = matching.assign_pairs(costs.select("pair", F.col("a.parcel_id").alias("parcel_a"), F.col("b.parcel_id").alias("parcel_b"), "cost"), accept)
    points = materialize(_placed(chosen, parcels_a, parcels_b), "shape-points")
    return points, fitting.fit_pairs(points, threshold=threshold)


def from_signatures(parcels_a: DataFrame, parcels_b: DataFrame, k: int = 4, threshold: float = 300.0) -> tuple[DataFrame, DataFrame]:
    """(points, fits) from the k cheapest candidates of each parcel; the fit's inliers are the matches. Sides: pair, parcel_id, cx, cy, area, signature."""
    costs = joins.signature_costs(parcels_a, parcels_b, ["pair"]).select("pair", F.col("a.parcel_id").alias("parcel_a"), F.col("b.parcel_id").alias("parcel_b"), "cost")
    candidates = materialize(_placed(ranks.top_k(costs, ["pair", "parcel_a"], ["cost", "parcel_b"], k), parcels_a, parcels_b), "candidates")
    fits = fitting.fit_pairs(candidates, threshold=threshold)
    return fitting.inliers(candidates, fits, threshold), fits


def _placed(chosen: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    at = lambda df, s: df.select("pair", F.col("parcel_id").alias(f"parcel_{s}"), F.col("cx").alias(f"cx_{s}"), F.col("cy").alias(f"cy_{s}"))
    return chosen.join(at(a, "a"), ["pair", "parcel_a"]).join(at(b, "b"), ["pair", "parcel_b"])
