"""Boxes, edges, directions, segments, 3x3 transforms and polygons as column expressions.

A 3x3 transform is an array of nine doubles, row by row; a polygon is an array of structs with x and y.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dimensions import EDGE_DIRECTIONS

OVERLAP_PX = 35
OPPOSITE = {"left": "right", "right": "left", "top": "bottom", "bottom": "top"}


def _case(key: Column, values: dict, default: Column | None = None) -> Column:
    out = None
    for k, v in values.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out if default is None else out.otherwise(default)


# boxes


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x, y, w, h); the union counts as one at least."""
    w = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0))
    h = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0))
    both = (w * h).cast("double")
    return both / F.greatest(a["w"] * a["h"] + b["w"] * b["h"] - both, F.lit(1.0))


def area_ratio(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(a, b)


def log_area_difference(a: Column, b: Column) -> Column:
    return F.abs(F.ln(a / b))


def down_scale(width: Column, height: Column, cap: float) -> Column:
    """The factor that brings the longer side to ``cap`` at most."""
    return F.least(F.lit(1.0), F.lit(float(cap)) / F.greatest(width, height))


def pixel_scale(width: Column, height: Column, most_pixels: float) -> Column:
    pixels = width.cast("double") * height
    return F.when(pixels > most_pixels, F.sqrt(F.lit(float(most_pixels)) / pixels)).otherwise(1.0)


# edges and placement


def opposite_edge(edge: Column) -> Column:
    return _case(edge, OPPOSITE)


def edge_direction(edge: Column) -> Column:
    """struct(dx, dy) of the side an edge faces."""
    return _case(edge, {e: F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for e, (dx, dy) in EDGE_DIRECTIONS.items()})


def edge_of_direction(dx: Column, dy: Column) -> Column:
    return F.when(dy == -1, "top").when(dy == 1, "bottom").when(dx == -1, "left").when(dx == 1, "right")


def quarter_turns(alpha: Column) -> Column:
    """Quarter turns nearest to an angle, halves to the even one."""
    return F.pmod(F.bround(alpha / 90).cast("int"), F.lit(4))


def edge_facing(edge: Column, alpha: Column) -> Column:
    """The edge of the canvas that an edge faces after a turn by ``alpha`` degrees counter-clockwise."""
    turn = {"top": "left", "left": "bottom", "bottom": "right", "right": "top"}
    once = _case(edge, turn)
    twice = _case(edge, {k: turn[v] for k, v in turn.items()})
    thrice = _case(edge, {k: turn[turn[v]] for k, v in turn.items()})
    n = quarter_turns(alpha)
    return F.when(n == 0, edge).when(n == 1, once).when(n == 2, twice).otherwise(thrice)


def place_offset(facing: Column, x: Column, y: Column, w: Column, h: Column, new_w: Column, new_h: Column, overlap: int = OVERLAP_PX) -> Column:
    """struct(x, y): top-left corner of a box set against the ``facing`` side of another, centred along it."""
    mid_x, mid_y = (x + F.floor((w - new_w) / 2)).cast("long"), (y + F.floor((h - new_h) / 2)).cast("long")
    at = lambda a, b: F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    return (
        F.when(facing == "top", at(mid_x, y - new_h + overlap))
        .when(facing == "bottom", at(mid_x, y + h - overlap))
        .when(facing == "left", at(x - new_w + overlap, mid_y))
        .otherwise(at(x + w - overlap, mid_y))
    )


def turned(alpha: Column, rotation: Column, back: bool = False) -> Column:
    return F.pmod(alpha - rotation + 360 if back else alpha + rotation, F.lit(360.0))


# segments


def line_class(dx: Column, dy: Column, tolerance: float = 15.0) -> Column:
    angle = F.degrees(F.atan2(F.abs(dy), F.abs(dx)))
    return F.when(angle <= tolerance, "horizontal").when(F.abs(angle - 90) <= tolerance, "vertical").otherwise("diagonal")


def skew_angle(dx: Column, dy: Column) -> Column:
    """The angle of a segment within 45 degrees of level; null for an upright one."""
    angle = F.degrees(F.atan2(dy, dx))
    folded = F.when(angle > 45, angle - 90).when(angle < -45, angle + 90).otherwise(angle)
    return F.when(dx != 0, folded)


def skew_correction(angle: Column, least: float = 0.5, most: float = 10.0) -> Column:
    """The turn to apply: none for an angle too small to matter or too large to be skew."""
    return F.when(F.abs(angle).between(least, most), angle).otherwise(0.0)


def edge_crossing(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, edge: str, margin: int = 50, corner: int = 12) -> Column:
    """Where a segment, drawn on, meets an edge of a sheet; null unless it comes near and crosses within the corners.

    Segments nearly along the edge, and those that lie on it, have none.
    """
    upright = edge in ("left", "right")
    at = F.lit(0) if edge in ("left", "top") else (width if upright else height) - 1
    p, q, r, s = (x1, x2, y1, y2) if upright else (y1, y2, x1, x2)
    length = height if upright else width
    crossing = r + (at - p) / (q - p) * (s - r)
    near = at.between(F.least(p, q) - margin, F.greatest(p, q) + margin)
    usable = (F.abs(q - p) >= 5) & ~((F.abs(p - at) < 3) & (F.abs(q - at) < 3)) & near
    return F.when(usable, F.when((crossing > corner) & (crossing < length - corner), crossing.cast("double")))


def in_edge_band(cx: Column, cy: Column, width: Column, height: Column, edge: Column, band: float = 1200.0) -> Column:
    """Whether a point lies within a band along the named edge; any point does for an unknown edge."""
    return (
        F.when(edge == "left", cx <= band).when(edge == "right", cx >= width - band)
        .when(edge == "top", cy <= band).when(edge == "bottom", cy >= height - band).otherwise(True)
    )


# transforms


def matrix(*values) -> Column:
    return F.array(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double") for v in values])


def identity() -> Column:
    return matrix(1, 0, 0, 0, 1, 0, 0, 0, 1)


def translation(dx, dy) -> Column:
    return matrix(1, 0, dx, 0, 1, dy, 0, 0, 1)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def multiply(a: Column, b: Column) -> Column:
    """The product of two transforms; null if one is."""
    def product(v):
        m, n = v["m"], v["n"]
        cells = [m[3 * i] * n[j] + m[3 * i + 1] * n[3 + j] + m[3 * i + 2] * n[6 + j] for i in range(3) for j in range(3)]
        return F.when(m.isNotNull() & n.isNotNull(), F.array(*cells))

    return bind(F.struct(a.alias("m"), b.alias("n")), product)


def determinant(m: Column) -> Column:
    return bind(m, lambda m: m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6]))


def inverse(m: Column) -> Column:
    """The inverse by the adjugate; null for a singular matrix."""
    def adjugate(v):
        m, d = v["m"], v["d"]
        cofactors = [
            m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
            m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
            m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3],
        ]
        return F.when(d != 0, F.array(*[c / d for c in cofactors]))

    return bind(bind(m, lambda m: F.struct(m.alias("m"), determinant(m).alias("d"))), adjugate)


def is_finite_matrix(m: Column) -> Column:
    return (F.size(m) == 9) & ~F.exists(m, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def project(m: Column, x: Column, y: Column) -> Column:
    """struct(x, y) of a point under a perspective transform."""
    def put(v):
        m, x, y = v["m"], v["x"], v["y"]
        w = m[6] * x + m[7] * y + m[8]
        return F.struct(((m[0] * x + m[1] * y + m[2]) / w).alias("x"), ((m[3] * x + m[4] * y + m[5]) / w).alias("y"))

    return bind(F.struct(m.alias("m"), x.alias("x"), y.alias("y")), put)


def quarter_rotation(angle: Column, width: Column, height: Column) -> Column:
    """The transform of a sheet's points under a counter-clockwise quarter turn; null for other angles."""
    return (
        F.when(angle == 0, identity())
        .when(angle == 90, matrix(0, 1, 0, -1, 0, width - 1, 0, 0, 1))
        .when(angle == 180, matrix(-1, 0, width - 1, 0, -1, height - 1, 0, 0, 1))
        .when(angle == 270, matrix(0, -1, height - 1, 1, 0, 0, 0, 0, 1))
    )


def alignment_transform(angle: Column, edge_a: Column, edge_b: Column, shift: Column, width_a: Column, height_a: Column, width_b: Column, height_b: Column) -> Column:
    """The transform from sheet B to sheet A for edges that face each other; null for edges that do not."""
    sideways = angle.isin(90, 270)
    turned_w, turned_h = F.when(sideways, height_b).otherwise(width_b), F.when(sideways, width_b).otherwise(height_b)
    move = (
        F.when((edge_a == "right") & (edge_b == "left"), translation(width_a, shift))
        .when((edge_a == "left") & (edge_b == "right"), translation(-turned_w, shift))
        .when((edge_a == "bottom") & (edge_b == "top"), translation(shift, height_a))
        .when((edge_a == "top") & (edge_b == "bottom"), translation(shift, -turned_h))
    )
    return multiply(move, quarter_rotation(angle, width_b, height_b))


def chain(*transforms: Column) -> Column:
    """The product of transforms; the last one acts first."""
    out = transforms[0]
    for t in transforms[1:]:
        out = multiply(out, t)
    return out


def full_resolution_transform(back_x, back_y, place_x, place_y, rotation: Column, uncrop_x, uncrop_y) -> Column:
    """Un-crop, rotate, place, move back: a dragged crop's transform at full resolution."""
    return chain(translation(back_x, back_y), translation(place_x, place_y), rotation, translation(uncrop_x, uncrop_y))


def to_window(x: Column, y: Column, zoom: Column, left: Column, top: Column) -> Column:
    """struct(x, y): where a point of the canvas is in a window that shows it from (left, top) on, enlarged by ``zoom``."""
    return F.struct(((x - left) * zoom).alias("x"), ((y - top) * zoom).alias("y"))


def to_canvas(x: Column, y: Column, zoom: Column, left: Column, top: Column) -> Column:
    """struct(x, y): the point of the canvas that a window shows at a place; null for a zoom of 0."""
    return F.struct((x / F.nullif(zoom, F.lit(0)) + left).alias("x"), (y / F.nullif(zoom, F.lit(0)) + top).alias("y"))


# scores


def density_similarity(a: Column, b: Column) -> Column:
    return 1 - F.abs(a - b)


def combined_score(ncc: Column, phase: Column, similarity: Column, weights: tuple[float, float, float] = (0.80, 0.10, 0.10)) -> Column:
    return weights[0] * ncc + weights[1] * phase + weights[2] * similarity


def content_ramp(v: Column, white: float = 245.0, width: float = 15.0) -> Column:
    """How much a pixel counts as content: none at ``white`` and above, fully ``width`` below it."""
    return F.least(F.greatest((white - v) / width, F.lit(0.0)), F.lit(1.0))


# polygons


def _edges(polygon: Column) -> Column:
    """Structs of each vertex and the next, closed."""
    n = F.size(polygon)
    return F.transform(polygon, lambda p, i: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"), F.element_at(polygon, F.pmod(i + 1, n) + 1)["x"].cast("double").alias("u"), F.element_at(polygon, F.pmod(i + 1, n) + 1)["y"].cast("double").alias("v")))


def _sum(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + term(e))


def _total(polygon: Column, term) -> Column:
    return _sum(_edges(polygon), term)


def polygon_perimeter(polygon: Column) -> Column:
    return _total(polygon, lambda e: F.hypot(e["u"] - e["x"], e["v"] - e["y"]))


def polygon_area(polygon: Column) -> Column:
    return F.abs(_total(polygon, lambda e: e["x"] * e["v"] - e["u"] * e["y"])) / 2


def polygon_box(polygon: Column, margin: int = 0, width: Column | None = None, height: Column | None = None) -> Column:
    """The bounding box of a polygon with a margin, kept within a sheet if its size is given."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    x0, y0, x1, y1 = F.array_min(xs) - margin, F.array_min(ys) - margin, F.array_max(xs) + margin, F.array_max(ys) + margin
    if width is not None:
        x0, y0, x1, y1 = F.greatest(x0, F.lit(0)), F.greatest(y0, F.lit(0)), F.least(x1, width), F.least(y1, height)
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def contains_point(polygon: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon or on its boundary."""
    def on(e):
        cross = (e["u"] - e["x"]) * (y - e["y"]) - (e["v"] - e["y"]) * (x - e["x"])
        return (cross == 0) & x.between(F.least(e["x"], e["u"]), F.greatest(e["x"], e["u"])) & y.between(F.least(e["y"], e["v"]), F.greatest(e["y"], e["v"]))

    def crosses(e):
        return ((e["y"] > y) != (e["v"] > y)) & (x < (e["u"] - e["x"]) * (y - e["y"]) / (e["v"] - e["y"]) + e["x"])

    inside = F.aggregate(_edges(polygon), F.lit(False), lambda s, e: F.when(crosses(e), ~s).otherwise(s))
    return F.exists(_edges(polygon), on) | inside


def _moments(edges: Column) -> dict[tuple[int, int], Column]:
    """Raw moments of a polygon's area from its edges up to the third order, by Green's theorem, each up to the orientation's sign."""
    def term(p, q):
        def one(e):
            out = None
            for k in range(p + 1):
                for m in range(q + 1):
                    c = math.comb(k + m, m) * math.comb(p + q - k - m, q - m)
                    t = F.lit(float(c)) * F.pow(e["u"], F.lit(k)) * F.pow(e["x"], F.lit(p - k)) * F.pow(e["v"], F.lit(m)) * F.pow(e["y"], F.lit(q - m))
                    out = t if out is None else out + t
            return (e["x"] * e["v"] - e["u"] * e["y"]) * out
        return one

    made = {}
    for p in range(4):
        for q in range(4 - p):
            scale = (p + q + 2) * (p + q + 1) * math.comb(p + q, p)
            made[p, q] = _sum(edges, term(p, q)) / scale
    return made


def hu_moments(polygon: Column) -> Column:
    """The seven Hu invariants of a polygon; null for fewer than four vertices or no area."""
    # each moment is a pass over the edges, so they are made once and named; the edges and the polygon are made once too
    named = bind(bind(polygon, _edges), lambda edges: F.struct(*[v.alias(f"m{p}{q}") for (p, q), v in _moments(edges).items()]))

    def scaled(r):
        sign = F.signum(r["m00"])
        m = {(p, q): r[f"m{p}{q}"] * sign for p in range(4) for q in range(4 - p)}
        cx, cy = m[1, 0] / m[0, 0], m[0, 1] / m[0, 0]
        mu = {
            (2, 0): m[2, 0] - cx * m[1, 0], (1, 1): m[1, 1] - cx * m[0, 1], (0, 2): m[0, 2] - cy * m[0, 1],
            (3, 0): m[3, 0] - 3 * cx * m[2, 0] + 2 * cx * cx * m[1, 0], (0, 3): m[0, 3] - 3 * cy * m[0, 2] + 2 * cy * cy * m[0, 1],
            (2, 1): m[2, 1] - 2 * cx * m[1, 1] - cy * m[2, 0] + 2 * cx * cx * m[0, 1], (1, 2): m[1, 2] - 2 * cy * m[1, 1] - cx * m[0, 2] + 2 * cy * cy * m[1, 0],
        }
        return F.struct(F.abs(m[0, 0]).alias("area"), *[(v / F.pow(m[0, 0], F.lit(1 + (p + q) / 2))).alias(f"n{p}{q}") for (p, q), v in mu.items()])

    def invariants(n):
        n20, n11, n02, n30, n03, n21, n12 = (n[f"n{k}"] for k in ("20", "11", "02", "30", "03", "21", "12"))
        a, b, c, d = n30 + n12, n21 + n03, n30 - 3 * n12, 3 * n21 - n03
        return F.array(
            n20 + n02, (n20 - n02) * (n20 - n02) + 4 * n11 * n11, c * c + d * d, a * a + b * b,
            c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b), (n20 - n02) * (a * a - b * b) + 4 * n11 * a * b,
            d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b),
        )

    both = F.transform(F.transform(F.array(named), scaled), lambda n: F.when(n["area"] >= 1e-6, invariants(n)))
    return F.when(F.size(polygon) >= 4, F.element_at(both, 1))


def hu_signature(polygon: Column) -> Column:
    """sign(h) * log10(|h| + 1e-30) of the seven Hu invariants."""
    return F.transform(hu_moments(polygon), lambda h: F.signum(h) * F.log10(F.abs(h) + 1e-30))


def shape_distance(hu_a: Column, hu_b: Column, least: float = 1e-5) -> Column:
    """Sum of |1/m_a - 1/m_b| over the invariants, m = sign(h) * log10|h|; invariants near zero on either side are left out."""
    def m(h):
        return F.when(F.abs(h) > least, F.signum(h) * F.log10(F.abs(h)))

    terms = F.zip_with(hu_a, hu_b, lambda a, b: F.coalesce(F.abs(1 / m(a) - 1 / m(b)), F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def inverse_logs(hu: Column, least: float = 1e-5) -> Column:
    """1/m of each invariant as :func:`shape_distance` compares them, no number for those near zero."""
    m = lambda h: F.when(F.abs(h) > least, F.signum(h) * F.log10(F.abs(h)))
    return F.transform(hu, lambda h: F.coalesce(1 / m(h), F.lit(float("nan"))))


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def ordered_corners(points: Column) -> Column:
    """Top-left, top-right, bottom-right, bottom-left of four corners, by sums and differences of their coordinates."""
    keyed = F.transform(points, lambda p, i: F.struct((p["x"] + p["y"]).alias("s"), (p["y"] - p["x"]).alias("d"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y")))
    by = lambda k, sign: F.array_min(F.transform(keyed, lambda p: F.struct((sign * p[k]).alias("k"), p["i"].alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
    return F.array(*[F.struct(c["x"].alias("x"), c["y"].alias("y")) for c in (by("s", 1), by("d", 1), by("s", -1), by("d", -1))])
