"""Small reference tables: sheets, neighbours, number ranges, boundary numbers, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# They must be exactly these for right results.
SHEETS = ("43", "44", "45", "46", "47", "48", "49", "50", "51", "52", "53", "54", "55")
NEIGHBOURS = (("45", "46"), ("45", "47"), ("47", "48"), ("48", "49"), ("49", "50"), ("50", "51"), ("52", "53"), ("52", "54"), ("52", "55"), ("54", "55"))
NUMBER_RANGES = {
    "43": (2477, 2500), "44": (2451, 2476), "45": (2501, 2750), "46": (2751, 3000), "47": (2701, 2750), "48": (2751, 3000), "49": (2951, 3250),
    "50": (3201, 3500), "51": (3051, 3250), "52": (3201, 3500), "53": (3251, 3500), "54": (3301, 3500), "55": (3351, 3500),
}
RANGE_TOLERANCE = 50
BOUNDARY_NUMBERS = {
    ("45", "47"): (2580,), ("45", "46"): (2616, 2619), ("47", "48"): (2749, 2803, 2814), ("48", "49"): (2893,), ("49", "50"): (3022, 3054),
    ("50", "51"): (3068, 3813, 3866), ("52", "53"): (3215,), ("52", "54"): (3216,), ("52", "55"): (3217,), ("54", "55"): (3338, 3339, 3345, 3346),
}
EDGE_DIRECTIONS = {"top": (0, -1), "bottom": (0, 1), "left": (-1, 0), "right": (1, 0)}
EDGE_PAIRS = (("right", "left"), ("left", "right"), ("bottom", "top"), ("top", "bottom"))
COARSE_ROTATIONS = (0, 90, 180, 270)
FINE_RANGE, FINE_STEP = 5.0, 0.5


def neighbours(spark: SparkSession) -> DataFrame:
    """map_a, map_b of sheets that touch."""
    return spark.createDataFrame(list(NEIGHBOURS), "map_a string, map_b string")


def number_ranges(spark: SparkSession) -> DataFrame:
    """map_num, lo, hi of the numbers expected on each sheet."""
    return spark.createDataFrame([(m, lo, hi) for m, (lo, hi) in NUMBER_RANGES.items()], "map_num string, lo int, hi int")


def boundary_numbers(spark: SparkSession) -> DataFrame:
    """number, map_num: each boundary number on each of its two sheets."""
    return spark.createDataFrame([(n, m) for pair, numbers in BOUNDARY_NUMBERS.items() for n in numbers for m in pair], "number int, map_num string")


def numbers_of_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("_".join(pair), n) for pair, numbers in BOUNDARY_NUMBERS.items() for n in numbers], "pair string, number int")


def coarse_configurations(spark: SparkSession) -> DataFrame:
    """cfg_idx, rotation, edge_a, edge_b: four rotations by four edge pairs, in the order of the search."""
    rows = [(r, a, b) for r in COARSE_ROTATIONS for a, b in EDGE_PAIRS]
    return spark.createDataFrame([(i, float(r), a, b) for i, (r, a, b) in enumerate(rows)], "cfg_idx int, rotation double, edge_a string, edge_b string")


def fine_angles(spark: SparkSession) -> DataFrame:
    """fine_idx, fine_rot: the steps around a coarse winner, without zero."""
    n = round(FINE_RANGE / FINE_STEP)
    angles = [k * FINE_STEP for k in range(-n, n + 1) if k]
    return spark.createDataFrame(list(enumerate(angles)), "fine_idx int, fine_rot double")
