"""Joins: radius, gated, value, nearest, fuzzy, range, configuration and role joins.

Distance and ratio conditions are turned into equi-joins on grid or logarithm bins, so no pair of tables is
compared row by row; the exact condition decides within neighbouring bins.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..shared import materialize
from . import blocks


def _sides(df: DataFrame, side: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(k) for k in keep], F.struct(*[F.col(c) for c in df.columns]).alias(side))


def radius_pairs(points: DataFrame, radius: float, keys: list[str], id_col: str = "parcel_id", x: str = "cx", y: str = "cy") -> DataFrame:
    """Pairs (structs a and b, a's id the lesser) at most ``radius`` apart within the same keys, and their distance.

    Every point goes to its own cell of a grid, and to the four cells after it in a fixed half of its neighbourhood; each pair then
    meets in one cell only.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    tagged = points.withColumns({"_bx": cell(x), "_by": cell(y)})
    a = tagged.select(*keys, F.col("_bx"), F.col("_by"), F.struct(*points.columns).alias("a"))
    half = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    b = tagged.select(*keys, F.struct(*points.columns).alias("b"), "_bx", "_by", F.inline(half))
    b = b.select(*keys, (F.col("_bx") + F.col("dx")).alias("_bx"), (F.col("_by") + F.col("dy")).alias("_by"), "b", ((F.col("dx") == 0) & (F.col("dy") == 0)).alias("_own"))
    distance = F.hypot(F.col("a")[x] - F.col("b")[x], F.col("a")[y] - F.col("b")[y])
    # a file of points is many times as large in memory, so its size says nothing about a broadcast
    met = a.hint("merge").join(b.hint("merge"), [*keys, "_bx", "_by"]).where(~F.col("_own") | (F.col("a")[id_col] < F.col("b")[id_col]))
    pairs = met.withColumn("distance", distance).where(F.col("distance") <= radius)
    swap = F.col("a")[id_col] > F.col("b")[id_col]
    return pairs.select(*keys, F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), "distance")


def area_gated_pairs(left: DataFrame, right: DataFrame, keys: list[str], most_ratio: float, area: str = "area") -> DataFrame:
    """Pairs (structs a and b) within the same keys whose areas differ by a factor of ``most_ratio`` at most.

    The logarithm of the area is binned by the gate's width, so a row meets its own bin and the two beside it.
    """
    width = math.log(most_ratio)
    bin_of = lambda c: F.floor(F.ln(F.col(c)) / width).cast("long")
    a = left.where(F.col(area) > 0).select(*keys, bin_of(area).alias("_bin"), F.struct(*left.columns).alias("a"))
    b = right.where(F.col(area) > 0).select(*keys, F.explode(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: bin_of(area) + k)).alias("_bin"), F.struct(*right.columns).alias("b"))
    met = a.join(b, [*keys, "_bin"]).drop("_bin")
    return met.where(F.abs(F.ln(F.col("a")[area]) - F.ln(F.col("b")[area])) <= width)


def contour_costs(left: DataFrame, right: DataFrame, keys: list[str], most_ratio: float = 2.0, weight: float = 0.3) -> DataFrame:
    """Shape costs of contours (columns area, hu) of similar size: invariants' distance and ``weight`` times the log of the ratio."""
    pairs = area_gated_pairs(left, right, keys, most_ratio)
    cost = G.shape_distance(F.col("a.hu"), F.col("b.hu")) + weight * G.log_area_difference(F.col("a.area"), F.col("b.area"))
    return pairs.withColumn("cost", cost).where(F.col("cost").isNotNull() & ~F.isnan("cost") & (F.col("cost") < float("inf")))


def contour_totals(left: DataFrame, right: DataFrame, keys: list[str], most_ratio: float = 2.0, weight: float = 0.3) -> DataFrame:
    """keys, a, n, least, total: how many contours of the right are of similar size to one of the left (columns id, area, hu), and the least and sum of the costs of :func:`contour_costs`.

    Contours meet in blocks, of which a row leaves for each contour, not for each pair.
    """
    named = lambda df: df.where("area > 0").select(*keys, "id", G.inverse_logs(F.col("hu")).alias("v"), blocks.log_size("area"))
    each = blocks.block_pairs(named(left), named(right), keys, gate=math.log(most_ratio), weight=weight, measure=blocks.gaps, totals=True)
    return each.groupBy(*keys, "a").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("total").alias("total"))


def signature_costs(left: DataFrame, right: DataFrame, keys: list[str], most_ratio: float = 1.8, weight: float = 0.4) -> DataFrame:
    """Costs of parcels (columns area, signature) of similar size: distance of signatures and ``weight`` times the log area difference."""
    pairs = area_gated_pairs(left, right, keys, most_ratio)
    return pairs.withColumn("cost", G.vector_distance(F.col("a.signature"), F.col("b.signature")) + weight * G.log_area_difference(F.col("a.area"), F.col("b.area")))


def _signed(parcels: DataFrame, keys: list[str]) -> DataFrame:
    return parcels.where("area > 0").select(*keys, F.col("parcel_id").alias("id"), F.col("signature").alias("v"), blocks.log_size("area"))


def signature_costs_in_blocks(left: DataFrame, right: DataFrame, keys: list[str], keep: blocks.Keep = blocks.all_pairs, most_ratio: float = 1.8, weight: float = 0.4) -> DataFrame:
    """keys, a, b, cost: the pairs of :func:`signature_costs`, or of each block of them those that ``keep`` chooses; parcels without a signature take no part."""
    return blocks.block_pairs(_signed(left, keys), _signed(right, keys), keys, keep, math.log(most_ratio), weight)


def signature_cost_percentiles(left: DataFrame, right: DataFrame, keys: list[str], at: tuple[float, ...] = (0.10, 0.25, 0.50, 0.75, 0.90), most_ratio: float = 1.8, weight: float = 0.4) -> DataFrame:
    """keys and exact percentiles of the costs of all pairs of :func:`signature_costs`, which are never rows."""
    return blocks.pair_percentiles(_signed(left, keys), _signed(right, keys), keys, at, math.log(most_ratio), weight)


def sheet_pairs(sheets: DataFrame, column: str = "map_num", buckets: int = 8) -> DataFrame:
    """All unordered pairs of sheets: map_a before map_b; their pairs are the work list itself.

    Sheets are dealt to buckets and meet by equal pairs of buckets, so no side has to fit in memory.
    """
    names = sheets.select(F.col(column).alias("_name")).where("_name is not null").distinct().withColumn("_own", F.pmod(F.xxhash64("_name"), F.lit(buckets)))
    every = F.explode(F.array(*[F.lit(k).cast("long") for k in range(buckets)]))
    a = names.select(F.col("_name").alias("map_a"), F.col("_own").alias("_a"), every.alias("_b"))
    b = names.select(F.col("_name").alias("map_b"), every.alias("_a"), F.col("_own").alias("_b"))
    return a.join(b, ["_a", "_b"]).where(F.col("map_a") < F.col("map_b")).select("map_a", "map_b")


def not_adjacent(pairs: DataFrame, adjacent: DataFrame) -> DataFrame:
    """Pairs that are not adjacent in either order."""
    both = adjacent.select("map_a", "map_b").unionAll(adjacent.select(F.col("map_b").alias("map_a"), F.col("map_a").alias("map_b")))
    return pairs.join(both, ["map_a", "map_b"], "left_anti")


def adjacent_among(adjacent: DataFrame, selected: DataFrame, column: str = "map_num") -> DataFrame:
    """Adjacent pairs of which both sheets are selected."""
    one = lambda side: selected.select(F.col(column).alias(side)).distinct()
    return adjacent.join(one("map_a"), "map_a", "left_semi").join(one("map_b"), "map_b", "left_semi").select(*adjacent.columns)


def shared_numbers(readings: DataFrame, pairs: DataFrame, most: int = 20, idx: str = "parcel_id") -> DataFrame:
    """Candidate control points: readings of two sheets of a pair with the same number, numbers read more than ``most`` times on a side left out.

    ``readings``: map_num, number, the index column and others; ``pairs``: map_a, map_b. Counts come first, so a number read everywhere
    never meets itself.
    """
    known = readings.where(F.col("number").isNotNull())
    counts = known.groupBy("map_num", "number").agg(F.count("*").alias("n_dup")).where(F.col("n_dup") <= most)
    usable = known.join(counts, ["map_num", "number"])
    side = lambda s: usable.select(F.col("map_num").alias(f"map_{s}"), "number", F.col("n_dup").alias(f"n_dup_{s}"), F.struct(*known.columns).alias(s))
    return pairs.select("map_a", "map_b").join(side("a"), "map_a").join(side("b"), ["map_b", "number"]).select("map_a", "map_b", "number", "a", "b", "n_dup_a", "n_dup_b")


def nearest_shared(candidates: DataFrame, residual: Column, most: float = 400.0, idx: str = "parcel_id") -> DataFrame:
    """Of each number's candidates in a pair, the one with the least residual, the first of equals; none beyond ``most``."""
    order = Window.partitionBy("map_a", "map_b", "number").orderBy("residual", F.col("a")[idx], F.col("b")[idx])
    best = candidates.withColumn("residual", residual).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return best.where(F.col("residual") <= most)


def prior_residual(h: Column, ax: Column, ay: Column, bx: Column, by: Column, offset_x: Column, offset_y: Column, direction: str = "b_to_a") -> Column:
    """Distance of a point and its counterpart under a prior transform, from B to A, or from A to the panorama where B is offset."""
    if direction == "b_to_a":
        p = G.project(h, bx, by)
        return F.hypot(p["x"] - ax, p["y"] - ay)
    p = G.project(h, ax, ay)
    return F.hypot(p["x"] - (bx + offset_x), p["y"] - (by + offset_y))


def with_configurations(pairs: DataFrame, configurations: DataFrame) -> DataFrame:
    """Every pair with every configuration of a search: a fixed, small dimension."""
    return pairs.join(F.broadcast(configurations))


def _finite(*columns: str) -> Column:
    return reduce(Column.__and__, [F.col(c).cast("double").isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf")) for c in columns])


def _cells(parcels: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the extent of its parcels, and the side of a grid cell that holds about one of those in the middle nine tenths, so far ones don't widen it."""
    middle = lambda c: F.percentile_approx(c, F.array(F.lit(0.05), F.lit(0.95)), F.lit(1000)).alias(f"_mid_{c}")
    ends = [f(F.col(c)).alias(f"_{n}_{c}") for c in ("cx", "cy") for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = parcels.groupBy(*keys).agg(F.count("*").alias("_n"), middle("cx"), middle("cy"), *ends)
    w, h = (F.col(f"_mid_{c}")[1] - F.col(f"_mid_{c}")[0] for c in ("cx", "cy"))
    extent = F.col("_hi_cx") - F.col("_lo_cx") + F.col("_hi_cy") - F.col("_lo_cy")
    side = F.greatest(F.sqrt(w * h / F.col("_n")), (w + h) / F.col("_n"), extent * 1e-7, F.lit(1e-9))
    return boxes.select(*keys, side.alias("_side"), extent.alias("_extent"), *[f"_{n}_{c}" for c in ("cx", "cy") for n in ("lo", "hi")])


def nearest_parcel(points: DataFrame, parcels: DataFrame, keys: list[str], point_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """The nearest parcel centroid of each point within the same keys, the first of equals, by parcel_id; ``point_id`` names a point within its keys.

    Points look in the nine cells of a grid around them, those beyond all parcels around the spot of the parcels' extent that is nearest to them; those that find none that is
    surely nearest look again in cells four times as wide, until all are settled. Each round meets by equal cells, and only the points left take part.
    Points and centroids without coordinates, or with infinite or not-a-number ones, are left out.
    """
    spots = points.where(_finite(x, y)).select(*keys, F.col(point_id).alias("_id"), F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).distinct()
    known = parcels.where(_finite("cx", "cy")).select(*keys, "parcel_id", F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"))
    grid = materialize(_cells(known, keys), "grid")
    inside = lambda p, c: F.least(F.greatest(F.col(p), F.col(f"_lo_{c}")), F.col(f"_hi_{c}"))
    left = spots.join(grid, keys).withColumns({"_nx": inside("_px", "cx"), "_ny": inside("_py", "cy")})
    off = (F.col("_px") - F.col("_nx")) * (F.col("_px") - F.col("_nx")) + (F.col("_py") - F.col("_ny")) * (F.col("_py") - F.col("_ny"))
    own = ["_id", "_px", "_py", "_nx", "_ny", "_off", "_side", "_extent"]
    left = materialize(left.withColumn("_off", off).select(*keys, *own), "points")
    spots_of = materialize(known.join(grid.select(*keys, "_side"), keys), "centroids")
    cell = lambda c, width: F.floor(F.col(c) / width).cast("long")
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    settled, times = None, 1.0
    while True:
        width = F.col("_side") * times
        held = spots_of.select(*keys, cell("cx", width).alias("_bx"), cell("cy", width).alias("_by"), "parcel_id", "cx", "cy")
        asked = left.select("*", cell("_nx", width).alias("_ox"), cell("_ny", width).alias("_oy"), F.inline(around)).withColumns({"_bx": F.col("_ox") + F.col("dx"), "_by": F.col("_oy") + F.col("dy")})
        met = asked.join(held, [*keys, "_bx", "_by"], "left")
        d2 = (F.col("cx") - F.col("_px")) * (F.col("cx") - F.col("_px")) + (F.col("cy") - F.col("_py")) * (F.col("cy") - F.col("_py"))
        best = met.groupBy(*keys, *own).agg(F.min(F.when(F.col("parcel_id").isNotNull(), F.struct(d2.alias("d2"), "parcel_id"))).alias("best"))
        best = materialize(best, "nearest")
        # what lies outside the nine cells is a cell's side off the spot at least, and further off a point beyond it; beyond the extent nothing is outside
        sure = F.coalesce(F.col("best.d2") < F.col("_off") + width * width, F.lit(False)) | (width >= F.col("_extent"))
        found = best.where(sure).select(*keys, "_id", "_px", "_py", "best.parcel_id", "best.d2")
        settled = found if settled is None else settled.unionAll(found)
        left, times = best.where(~sure).drop("best"), 4 * times
        if left.isEmpty():
            break
    return points.join(settled.withColumnRenamed("_id", "_of"), [*keys]).where((F.col("_of") == F.col(point_id)) & (F.col("_px") == F.col(x)) & (F.col("_py") == F.col(y))).select(*points.columns, "parcel_id", "d2")


def clicked_parcel(points: DataFrame, parcels: DataFrame, keys: list[str], point_id: str, x: str = "x", y: str = "y") -> DataFrame:
    """The first parcel whose polygon holds a click, else the nearest centroid; polygons of three points at least count.

    A parcel stands in the grid cells that its bounding box touches, so a click meets only parcels about it.
    """
    drawn = parcels.where(F.size("polygon") >= 3)
    near = nearest_parcel(points, drawn, keys, point_id, x, y).drop("d2")
    box = drawn.select(*keys, "parcel_id", "polygon", *[f(F.col(f"polygon.{c}")).alias(f"_{n}{c}") for c in ("x", "y") for n, f in (("lo", F.array_min), ("hi", F.array_max))])
    sides = materialize(box.groupBy(*keys).agg(F.greatest(F.avg(F.col("_hix") - F.col("_lox")), F.avg(F.col("_hiy") - F.col("_loy")), F.lit(1.0)).alias("_side")), "box-grid")
    cell = lambda c: F.floor(c / F.col("_side")).cast("long")
    spread = lambda c: F.explode(F.sequence(cell(F.col(f"_lo{c}")), cell(F.col(f"_hi{c}"))))
    held = box.join(sides, keys).select(*keys, "parcel_id", "polygon", "_side", "_loy", "_hiy", spread("x").alias("_bx")).select(*keys, "parcel_id", "polygon", "_bx", spread("y").alias("_by"))
    asked = near.select(*keys, F.col(point_id).alias("_id"), F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).distinct().join(sides, keys)
    asked = asked.select(*keys, "_id", "_px", "_py", cell(F.col("_px")).alias("_bx"), cell(F.col("_py")).alias("_by"))
    inside = asked.join(held, [*keys, "_bx", "_by"]).where(G.contains_point(F.col("polygon"), F.col("_px"), F.col("_py")))
    first = inside.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys], "_id", "_px", "_py").agg(F.min("parcel_id").alias("_in"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col(point_id) == F.col("_id"), F.col(x) == F.col("_px"), F.col(y) == F.col("_py")]
    return near.join(first, same, "left").select(*points.columns, F.coalesce("_in", "parcel_id").alias("parcel_id"), F.col("_in").isNotNull().alias("inside"))


def fuzzy_number_lookup(targets: DataFrame, parcels: DataFrame, keys: list[str], tolerance: int = 2, idx: str = "idx") -> DataFrame:
    """The first parcel, in file order, whose number lies within ``tolerance`` of a target's."""
    near = targets.select("*", F.explode(F.sequence(F.col("target") - tolerance, F.col("target") + tolerance)).alias("number"))
    order = Window.partitionBy(*keys, "target").orderBy(idx)
    met = near.join(parcels, [*keys, "number"])
    return met.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def common_clicks(clicks_a: DataFrame, clicks_b: DataFrame) -> DataFrame:
    """Points of two sheets under the same number."""
    side = lambda df, s: df.select("pair", "number", F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}"))
    return side(clicks_a, "a").join(side(clicks_b, "b"), ["pair", "number"])


def nearest_two(queries: DataFrame, train: DataFrame, keys: list[str], block: int = 2048) -> DataFrame:
    """keys, q_id and n, the two nearest train rows (d, t_id) of every query, exact; rows without an id or a descriptor take no part.

    Rows of both sides meet in blocks of about ``block`` rows within the keys; what is shuffled of the pairs is two rows a query and block.
    """
    named = lambda df: df.select(*keys, F.col("kp_id").alias("id"), F.col("descriptor").alias("v"))
    near = blocks.block_pairs(named(queries), named(train), keys, blocks.nearest_of_each(2), block=block)
    near = near.select(*keys, F.col("a").alias("q_id"), F.struct(F.col("cost").alias("d"), F.col("b").alias("t_id")).alias("n"))
    return near.groupBy(*keys, "q_id").agg(F.slice(F.array_sort(F.collect_list("n")), 1, 2).alias("n"))


def passing_ratio(nearest: DataFrame, keys: list[str], ratio: float) -> DataFrame:
    """Of each query's two nearest rows the nearest, if its distance is below ``ratio`` of the other's."""
    first, second = F.col("n")[0], F.get("n", F.lit(1))
    return nearest.where(F.size("n") == 2).where(first["d"] < ratio * second["d"]).select(*keys, "q_id", first["t_id"].alias("t_id"), first["d"].alias("d1"), second["d"].alias("d2"))


def ratio_matches(queries: DataFrame, train: DataFrame, keys: list[str], ratio: float = 0.75, block: int = 2048) -> DataFrame:
    """Two-nearest-neighbour matches of descriptors under the ratio test, exact."""
    return passing_ratio(nearest_two(queries, train, keys, block), keys, ratio)


def validate_numbers(readings: DataFrame, ranges: DataFrame, tolerance: int = 50) -> DataFrame:
    """Validation of each reading against its sheet's range: VALID, BORDER within the tolerance, INVALID, NO_NUMBER, UNKNOWN sheet.

    ``ranges`` has a row a sheet; its size decides whether Spark broadcasts it.
    """
    met = readings.join(ranges.select("map_num", "lo", "hi"), "map_num", "left")
    n = F.col("number")
    status = (
        F.when(n.isNull(), "NO_NUMBER").when(F.col("lo").isNull(), "UNKNOWN").when(n.between(F.col("lo"), F.col("hi")), "VALID")
        .when(n.between(F.col("lo") - tolerance, F.col("hi") + tolerance), "BORDER").otherwise("INVALID")
    )
    return met.withColumn("validation", status).drop("lo", "hi")


def flag_members(df: DataFrame, members: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A boolean column: whether the keys are in the other table."""
    marked = members.select(*keys).distinct().withColumn("_in", F.lit(True))
    return df.join(marked, keys, "left").withColumn(name, F.col("_in").isNotNull()).drop("_in")


def triangles(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Node and two of its neighbours that are linked themselves: keys, node, u, v with u before v. ``edges``: src, dst, each once.

    Links lead from the end with fewer links to the other, so a node linked to all others makes no more pairs of its neighbours
    than there are links among better connected ones.
    """
    keys = keys or []
    canon = edges.select(*keys, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).where("u <> v").distinct()
    degree = canon.select(*keys, F.explode(F.array("u", "v")).alias("node")).groupBy(*keys, "node").agg(F.count("*").alias("n"))
    ends = canon.join(degree.select(*keys, F.col("node").alias("u"), F.col("n").alias("_nu")), [*keys, "u"]).join(degree.select(*keys, F.col("node").alias("v"), F.col("n").alias("_nv")), [*keys, "v"])
    at_u, at_v = F.struct(F.col("_nu").alias("n"), F.col("u").alias("id")), F.struct(F.col("_nv").alias("n"), F.col("v").alias("id"))
    led = materialize(ends.select(*keys, F.least(at_u, at_v).alias("low"), F.greatest(at_u, at_v).alias("high")), "led-edges")
    one, two = led.select(*keys, "low", F.col("high").alias("p")), led.select(*keys, "low", F.col("high").alias("q"))
    closed = one.join(two, [*keys, "low"]).where("p < q").join(led.select(*keys, F.col("low").alias("p"), F.col("high").alias("q")), [*keys, "p", "q"])
    corners = closed.select(*keys, F.array_sort(F.array("low.id", "p.id", "q.id")).alias("t"))
    each = F.array(*[F.struct(F.col("t")[i].alias("node"), F.col("t")[j].alias("u"), F.col("t")[k].alias("v")) for i, j, k in ((0, 1, 2), (1, 0, 2), (2, 0, 1))])
    return corners.select(*keys, F.inline(each))


def missing_from(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that were not found."""
    return expected.select(*keys).distinct().join(found.select(*keys), keys, "left_anti")


def work_list(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs without a stored result."""
    return pairs.join(done.select("map_a", "map_b"), ["map_a", "map_b"], "left_anti")


def both_roles(scores: DataFrame) -> DataFrame:
    """Each pair's row once for either sheet: map_num, other, edge, and the rest."""
    rest = [c for c in scores.columns if c not in ("map_a", "map_b", "edge_a", "edge_b")]
    one = scores.select(F.col("map_a").alias("map_num"), F.col("map_b").alias("other"), F.col("edge_a").alias("edge"), *rest)
    two = scores.select(F.col("map_b").alias("map_num"), F.col("map_a").alias("other"), F.col("edge_b").alias("edge"), *rest)
    return one.unionByName(two)


def by_id(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other, keys)
