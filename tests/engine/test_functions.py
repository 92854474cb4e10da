"""Scalar functions against goldens derived by hand from the formulas."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sheetloom.functions import geometry as G
from sheetloom.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("one", "two", "want"),
    [((2580, 0.9), (2580, 0.8), (2580, 0.84)), ((2580, 0.9), (2581, 0.5), (2580, 0.504)), ((2580, 0.5), (2581, 0.6), (2581, 0.336)), ((None, 0.0), (2580, 0.5), (2580, 0.35)), ((None, 0.0), (None, 0.0), (None, 0.0)),
     ((2580, 0.6), (2581, 0.4), (2581, 0.224))],
)
def test_fuse(spark, one, two, want):
    a, b = (F.lit(n).cast("int") for n in (one[0], two[0]))
    got = value(spark, X.fuse_readings(a, F.lit(one[1]), b, F.lit(two[1])))
    assert got.number == want[0] and got.confidence == pytest.approx(want[1])


@pytest.mark.parametrize(
    ("function", "text", "want"),
    [
        (X.four_digit_numbers, "٢٥٨٠", [2580]), (X.four_digit_numbers, "12 34", []), (X.four_digit_numbers, "25 80 27 49", [2580, 2749]), (X.four_digit_numbers, "12580", []), (X.four_digit_numbers, "", []),
        (X.first_number, "2580", 2580), (X.first_number, "NONE", None), (X.first_number, "none, sorry 2580", None), (X.first_number, "id 1999 then 3054", 3054), (X.first_number, "12580", None), (X.first_number, "رقم ٣٠٥٤", 3054), (X.first_number, "é2580", None),
        (X.single_number, "٣٠٥٤", 3054), (X.single_number, "4000", None), (X.single_number, "a30b54", 3054), (X.single_number, "۳۰۵۴", 3054),
        (X.normalise_number, "no. 2580", 2580), (X.normalise_number, "99", None), (X.normalise_number, "100000", None), (X.normalise_number, "٢٥٨٠", 2580), (X.normalise_number, "x²", None), (X.normalise_number, "00100", 100), (X.normalise_number, "", None),
        (X.normalise_number, "9" * 40, None), (X.map_number, "Sheet no 47.jpg", "47"), (X.map_number, "47", "47"), (X.western_digits, "a١۲3", "123"),
    ],
)
def test_text(spark, function, text, want):
    assert value(spark, function(F.lit(text))) == want


def test_null_text(spark):
    for f in (X.four_digit_numbers, X.first_number, X.single_number, X.normalise_number, X.map_number):
        assert value(spark, f(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(("edge", "alpha", "want"), [("top", 0, "top"), ("top", 90, "left"), ("top", 180, "bottom"), ("top", 270, "right"), ("top", 44, "top"), ("top", 46, "left"), ("top", 179, "bottom"), ("top", 45, "top"), ("top", 135, "bottom"), ("right", 90, "top"), ("left", 90, "bottom"), ("bottom", 90, "right")])
def test_edge_facing(spark, edge, alpha, want):
    assert value(spark, G.edge_facing(F.lit(edge), F.lit(alpha))) == want


@pytest.mark.parametrize(("facing", "want"), [("right", (65, 20)), ("top", (20, -5)), ("bottom", (20, 45)), ("left", (-25, 20))])
def test_place_offset(spark, facing, want):
    got = value(spark, G.place_offset(F.lit(facing), F.lit(0), F.lit(0), F.lit(100), F.lit(80), F.lit(60), F.lit(40)))
    assert (got.x, got.y) == want


def test_place_offset_floors(spark):
    got = value(spark, G.place_offset(F.lit("top"), F.lit(0), F.lit(0), F.lit(10), F.lit(80), F.lit(13), F.lit(40)))
    assert got.x == -2


def box(x, y, w, h):
    return F.struct(*[F.lit(v).alias(n) for v, n in zip((x, y, w, h), "xywh", strict=True)])


def test_iou(spark):
    assert value(spark, G.box_iou(box(0, 0, 10, 10), box(5, 5, 10, 10))) == pytest.approx(1 / 7)
    assert value(spark, G.box_iou(box(0, 0, 10, 10), box(20, 5, 10, 10))) == 0


@pytest.mark.parametrize(("point", "want"), [((0, 0), (0, 5)), ((5, 3), (3, 0))])
def test_quarter_rotation(spark, point, want):
    got = value(spark, G.project(G.quarter_rotation(F.lit(90), F.lit(6), F.lit(4)), F.lit(float(point[0])), F.lit(float(point[1]))))
    assert (got.x, got.y) == want


def test_alignment_transform(spark):
    h = G.alignment_transform(F.lit(0), F.lit("right"), F.lit("left"), F.lit(7.0), F.lit(200), F.lit(100), F.lit(50), F.lit(60))
    got = value(spark, G.project(h, F.lit(0.0), F.lit(0.0)))
    assert (got.x, got.y) == (200, 7)
    assert value(spark, G.alignment_transform(F.lit(0), F.lit("right"), F.lit("top"), F.lit(7.0), F.lit(200), F.lit(100), F.lit(50), F.lit(60))) is None


def test_inverse_and_product(spark):
    m = G.matrix(2, 1, 5, 0, 3, -2, 0.001, 0, 1)
    got = value(spark, G.multiply(m, G.inverse(m)))
    assert got == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1], abs=1e-9)
    assert value(spark, G.inverse(G.matrix(1, 2, 3, 2, 4, 6, 0, 0, 1))) is None
    assert value(spark, G.is_finite_matrix(G.matrix(1, 2, 3, 4, 5, 6, 7, 8, float("nan")))) is False
    assert value(spark, G.is_finite_matrix(F.array(F.lit(1.0)))) is False


def polygon(points):
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points])


SHAPE = [(0, 0), (8, 0), (8, 3), (4, 3), (4, 9), (0, 9)]


def turn(points, angle, scale, dx, dy):
    c, s = math.cos(angle), math.sin(angle)
    return [(scale * (c * x - s * y) + dx, scale * (s * x + c * y) + dy) for x, y in points]


def test_hu_signature_is_invariant(spark):
    a = value(spark, G.hu_moments(polygon(SHAPE)))
    b = value(spark, G.hu_moments(polygon(turn(SHAPE, 0.7, 3.0, 100.0, -40.0))))
    c = value(spark, G.hu_moments(polygon(SHAPE[::-1])))
    assert b == pytest.approx(a, rel=1e-6, abs=1e-12) and c == pytest.approx(a, rel=1e-9)
    assert value(spark, G.hu_moments(polygon(SHAPE[:3]))) is None
    assert value(spark, G.shape_distance(G.hu_moments(polygon(SHAPE)), G.hu_moments(polygon(turn(SHAPE, 1.0, 2.0, 5.0, 5.0))))) == pytest.approx(0, abs=1e-6)


def test_polygon(spark):
    assert value(spark, G.polygon_area(polygon(SHAPE))) == 48
    assert value(spark, G.polygon_perimeter(polygon(SHAPE))) == 34
    for (x, y), want in {(1, 1): True, (7, 2): True, (6, 5): False, (8, 3): True, (4, 6): True, (-1, 0): False}.items():
        assert value(spark, G.contains_point(polygon(SHAPE), F.lit(float(x)), F.lit(float(y)))) is want
    got = value(spark, G.polygon_box(polygon(SHAPE), 2, F.lit(9), F.lit(9)))
    assert (got.x, got.y, got.w, got.h) == (0, 0, 9, 9)
    corners = value(spark, G.ordered_corners(polygon([(10, 10), (0, 0), (0, 9), (11, 1)])))
    assert [(c.x, c.y) for c in corners] == [(0, 0), (11, 1), (10, 10), (0, 9)]
