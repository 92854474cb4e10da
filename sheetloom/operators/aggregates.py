"""Aggregations: groups of readings, order statistics, counters, histograms, profiles, blends and boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..shared import broadcast_if_small, materialize


def readings_by_number(readings: DataFrame, most_listed: int | None = None) -> DataFrame:
    """map_num, number, n and the parcels that read it, in order; readings without a number are left out.

    ``most_listed`` keeps the list to so many parcels; n counts all.
    """
    grouped = readings.where(F.col("number").isNotNull()).groupBy("map_num", "number")
    listed = F.array_sort(F.collect_list("parcel_id"))
    return grouped.agg(F.count("*").alias("n"), (F.slice(listed, 1, most_listed) if most_listed else listed).alias("parcels"))


def invert_map(df: DataFrame, key: str, values: str) -> DataFrame:
    """key -> list becomes value -> sorted list of keys."""
    return df.select(key, F.explode(values).alias("value")).groupBy("value").agg(F.array_sort(F.collect_list(key)).alias("keys"))


def distinct_matched(matches: DataFrame, keys: list[str], a: str = "parcel_a", b: str = "parcel_b") -> DataFrame:
    return matches.groupBy(*keys).agg(F.countDistinct(a).alias("n_a"), F.countDistinct(b).alias("n_b"))


GROUP_MOST = 2_000_000


def percentiles(df: DataFrame, keys: list[str], column: str, at: tuple[float, ...] = (0.10, 0.25, 0.50, 0.75, 0.90), bound: int | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, one column each; null and not-a-number values are left out.

    Groups are counted first, unless the caller knows a ``bound`` of their rows that is small enough. Where none has more than ``GROUP_MOST`` rows each is one buffer. Else values are counted in bins that grow with
    their size, and the bins that hold the wanted ranks are ranked value by value, so no task holds a whole group, but at most a bin of
    one (about a thousandth of the values' magnitude).
    """
    own = df.select(*[F.col(k) for k in keys], F.col(column).cast("double").alias("_v"))
    if bound is None or bound > GROUP_MOST:
        bound = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    own = own.where("_v is not null and not isnan(_v)")
    if bound <= GROUP_MOST:
        grouped = own.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(p) for p in at])).alias("_p"))
        return grouped.select(*keys, *[F.col("_p")[k].alias(f"p{round(100 * p)}") for k, p in enumerate(at)])
    own = own.withColumn("_bin", F.floor(F.signum("_v") * F.log1p(F.abs("_v")) * 1024).cast("long"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy(*keys, "_bin").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    # for each percentile the ranks (from 0) below and above its place, and how far it is between them
    place = lambda p: (F.col("_all") - 1) * F.lit(p)
    wanted = F.array(*[F.struct(F.lit(p).alias("p"), r.cast("long").alias("rank"), (F.lit(1.0) - F.abs(place(p) - r)).alias("share")) for p in at for r in (F.floor(place(p)), F.floor(place(p)) + 1)])
    bins = counts.select("*", F.inline(wanted)).where("share > 0 and rank >= _before and rank < _before + _n")
    bins = materialize(bins.select(*keys, "_bin", "p", "share", (F.col("rank") - F.col("_before") + 1).alias("_own")), "wanted-ranks")
    few = broadcast_if_small(bins.select(*keys, "_bin").distinct())
    same = lambda a, b: reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in [*keys, "_bin"]])
    ranked = own.join(few, same(own, few), "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy("_v")))
    met = ranked.alias("v").join(broadcast_if_small(bins).alias("b"), reduce(Column.__and__, [F.col(f"v.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_bin"]]) & (F.col("_r") == F.col("_own")))
    summed = [F.sum(F.when(F.col("p") == p, F.col("_v") * F.col("share"))).alias(f"p{round(100 * p)}") for p in at]
    return met.groupBy(*[F.col(f"v.{k}").alias(k) for k in keys]).agg(*summed)


def with_medians(df: DataFrame, keys: list[str], medians: dict[str, Column], others: list[Column]) -> DataFrame:
    """One row a group: the medians of some values, exact and by :func:`percentiles`, so a large group is spread, and other aggregates.

    ``others`` may ask for the columns of ``df`` and of ``medians``. Null and not-a-number values have no part in a median; a group without any has a null.
    """
    own = materialize(df.withColumns(medians), "measured")
    whole = own.groupBy(*keys).agg(F.count("*").alias("_n"), *others)
    most = whole.agg(F.max("_n")).first()[0] or 0
    for name in medians:
        mid = percentiles(own, keys, name, (0.5,), bound=most).select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("p50").alias(f"_median_{name}"))
        whole = whole.join(mid, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]), "left").drop(*[f"_of_{k}" for k in keys])
    return whole.drop("_n")


def residual_stats(df: DataFrame, keys: list[str], column: str = "residual") -> DataFrame:
    """Median, mean and number of residuals."""
    s = with_medians(df, keys, {"_v": F.col(column).cast("double")}, [F.avg(column).alias("mean_residual"), F.count("*").alias("n")])
    return s.select(*keys, F.col("_median__v").alias("median_residual"), "mean_residual", "n")


def median_translation(points: DataFrame, keys: list[str]) -> DataFrame:
    """Median shift from B's points (in A's frame) to A's: dx, dy and the number of points."""
    shift = {"_dx": F.col("cx_a") - F.col("cx_b"), "_dy": F.col("cy_a") - F.col("cy_b")}
    s = with_medians(points, keys, shift, [F.count("*").alias("n")])
    return s.select(*keys, F.col("_median__dx").alias("dx"), F.col("_median__dy").alias("dy"), "n")


def graph_summary(nodes: DataFrame, edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Nodes, edges and average degree of each sheet and, under a null map_num, of all. With ``weight`` a row stands for so many edges."""
    counts = nodes.select("map_num", F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(edges.select("map_num", F.lit(0).alias("n"), (F.col(weight) if weight else F.lit(1)).alias("e")))
    return counts.rollup("map_num").agg(F.sum("n").alias("n_nodes"), F.sum("e").alias("n_edges")).withColumn(
        "avg_degree", F.when(F.col("n_nodes") > 0, 2 * F.col("n_edges") / F.col("n_nodes")).otherwise(0.0)
    )


def run_means(metrics: DataFrame) -> DataFrame:
    """Means and totals of a run's rows: sharpness and contrast gains, seconds."""
    return metrics.agg(
        F.avg(F.col("sharpness_after") - F.col("sharpness_before")).alias("sharpness_gain"), F.avg(F.col("contrast_after") - F.col("contrast_before")).alias("contrast_gain"),
        F.avg("elapsed").alias("mean_elapsed"), F.sum("elapsed").alias("total_elapsed"), F.count("*").alias("n"),
    )


def keypoint_stats(keypoints: DataFrame, keys: list[str], bins: int = 36) -> DataFrame:
    """Means and population deviations of response and size, and the entropy in bits of the angles' histogram."""
    part = keypoints.groupBy(*keys, F.least(F.floor(F.col("angle") / (360 / bins)), F.lit(bins - 1)).alias("bin"))
    sums = part.agg(F.count("*").alias("n"), *[F.sum(F.pow(c, F.lit(p))).alias(f"{c}_{p}") for c in ("response", "size") for p in (1, 2)])
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy(F.lit(1)))
    share = F.col("n") / F.col("total")
    agg = sums.withColumn("total", total).groupBy(*keys).agg(
        F.sum("n").alias("n_keypoints"), (-F.sum(share * F.log2(share + 1e-9))).alias("angle_entropy"), *[F.sum(f"{c}_{p}").alias(f"{c}_{p}") for c in ("response", "size") for p in (1, 2)]
    )
    out = []
    for c in ("response", "size"):
        mean = F.col(f"{c}_1") / F.col("n_keypoints")
        out += [mean.alias(f"{c}_mean"), F.sqrt(F.greatest(F.col(f"{c}_2") / F.col("n_keypoints") - mean * mean, F.lit(0.0))).alias(f"{c}_std")]
    return agg.select(*keys, "n_keypoints", "angle_entropy", *out)


def angle_entropy(df: DataFrame, keys: list[str], angle: Column, bins: int = 36) -> DataFrame:
    """Entropy in bits of a histogram of angles in degrees."""
    counts = df.groupBy(*keys, F.least(F.floor(F.pmod(angle, F.lit(360.0)) / (360 / bins)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("share", share).groupBy(*keys).agg((-F.sum(F.col("share") * F.log2(F.col("share") + 1e-9))).alias("entropy"))


def validation_counts(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by validation; an unknown sheet counts as no number."""
    v = F.col("validation")
    return readings.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(v == "VALID").alias("n_valid"), F.count_if(v == "BORDER").alias("n_border"), F.count_if(v == "INVALID").alias("n_invalid"),
        F.count_if(v.isin("NO_NUMBER", "UNKNOWN")).alias("n_no_number"),
    )


def status_counts(results: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    s = F.col(status)
    return results.groupBy(*keys).agg(*[F.count_if(s == k).alias(f"n_{k.lower()}") for k in ("STAGE1", "STAGE2", "FAIL", "SKIP")], F.sum("elapsed").alias("total_elapsed"))


def cache_class(number: Column, raw: Column, error: Column) -> Column:
    """error, skip, none, parsed or other; an error is told first."""
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "error").when(raw == "SKIP_CROP", "skip").when(number.isNotNull(), "parsed")
        .when(F.upper(F.trim(raw)).startswith("NONE"), "none").otherwise("other")
    )


def cache_report(cache: DataFrame, keys: list[str]) -> DataFrame:
    kinds = cache.withColumn("_kind", cache_class(F.col("number"), F.col("raw"), F.col("error")))
    return kinds.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col("_kind") == k).alias(f"n_{k}") for k in ("parsed", "none", "error", "skip", "other")])


def reading_summary(readings: DataFrame, keys: list[str]) -> DataFrame:
    return readings.groupBy(*keys).agg(F.count("recognised_number").alias("n_numbers"), F.count_if("is_csv_target").alias("n_csv_hits"))


def token_totals(calls: DataFrame, keys: list[str]) -> DataFrame:
    from ..functions.text import token_cost

    sums = calls.groupBy(*keys).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return sums.withColumn("cost", token_cost(F.col("tokens_in"), F.col("tokens_out")))


def detection_scores(predictions: DataFrame, images: DataFrame, image: str = "image_id", thresholds: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """Per image over all images: mean predictions at each threshold, mean of the best scores, share with any prediction."""
    counts = [F.count_if(F.col("score") >= t).alias(f"n_{round(100 * t)}") for t in thresholds]
    per = images.select(image).distinct().join(predictions.groupBy(image).agg(F.max("score").alias("best"), *counts), image, "left")
    return per.agg(
        *[F.avg(F.coalesce(F.col(f"n_{round(100 * t)}"), F.lit(0))).alias(f"mean_at_{round(100 * t)}") for t in thresholds],
        F.avg(F.coalesce("best", F.lit(0.0))).alias("mean_best"), F.avg(F.col("best").isNotNull().cast("int")).alias("share_with"),
    )


def class_shares(df: DataFrame, keys: list[str], label: Column) -> DataFrame:
    """Count and percent of each class within the keys."""
    counts = df.groupBy(*keys, label.alias("class")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(*(keys or [F.lit(1)]))))


def degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    both = edges.select(*keys, F.col("src").alias("node")).unionAll(edges.select(*keys, F.col("dst").alias("node")))
    return both.groupBy(*keys, "node").agg(F.count("*").alias("degree"))


def degree_density(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Degree of each node and the share of its neighbour pairs that are linked; 0 below two neighbours. ``edges``: each once."""
    from .joins import triangles

    links = triangles(edges, keys).groupBy(*keys, "node").agg(F.count("*").alias("links"))
    k = F.col("degree")
    met = degrees(edges, keys).join(links, [*keys, "node"], "left")
    return met.withColumn("local_density", F.when(k >= 2, F.coalesce("links", F.lit(0)) / (k * (k - 1) / 2)).otherwise(0.0)).drop("links")


def minmax(df: DataFrame, keys: list[str], columns: list[str], least_range: float = 1e-8) -> DataFrame:
    """Columns scaled to 0..1 within the keys. Minima and maxima are added up before the join, so a hot key is no hot partition."""
    bounds = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    met = df.join(bounds, keys)
    scaled = {c: (F.col(c) - F.col(f"_lo_{c}")) / F.greatest(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(least_range)) for c in columns}
    return met.withColumns(scaled).select(*df.columns)


def crop_box(pixels: DataFrame, keys: list[str], threshold: int = 200, least: float = 0.001, padding: int = 30) -> DataFrame:
    """First and last rows and columns with enough ink, with padding, of pixel rows (y, x, v): y0, y1, x0, x1 (ends exclusive)."""
    size = pixels.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    found = size
    for axis, length in (("y", "h"), ("x", "w")):
        ink = pixels.groupBy(*keys, axis).agg(F.avg((F.col("v") < threshold).cast("int")).alias("density")).where(F.col("density") >= least)
        ends = ink.groupBy(*keys).agg(F.min(axis).alias("_lo"), F.max(axis).alias("_hi"))
        found = found.join(ends, keys, "left")
        found = found.withColumns({
            f"{axis}0": F.coalesce(F.greatest(F.col("_lo") - padding, F.lit(0)), F.lit(0)),
            f"{axis}1": F.coalesce(F.least(F.col("_hi") + padding + 1, F.col(length)), F.col(length)),
        }).drop("_lo", "_hi")
    return found


def boundary_profile(pixels: DataFrame, keys: list[str], along: str) -> DataFrame:
    """Ink along a strip: 255 less the mean of each row or column."""
    return pixels.groupBy(*keys, F.col(along).alias("pos")).agg((255 - F.avg("v")).alias("value"))


def ink_density(pixels: DataFrame, keys: list[str], threshold: int = 180) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.avg((F.col("v") < threshold).cast("int")).alias("density"))


def crossing_histogram(crossings: DataFrame, keys: list[str], value: str, norm: Column, bins: int = 200) -> DataFrame:
    """Counts of crossings in bins of a normalised length, divided by the largest."""
    counts = crossings.groupBy(*keys, F.least(F.floor(F.col(value) / norm * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("value", F.col("n") / F.max("n").over(Window.partitionBy(*keys))).drop("n")


def size_stats(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    s = with_medians(df, keys, {"_v": F.col(column).cast("double")}, [F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most")])
    return s.select(*keys, "n", "least", "most", F.col("_median__v").alias("median"))


def panorama_box(sheets: DataFrame, keys: list[str], transform: str = "t", whole: bool = True) -> DataFrame:
    """The box of all sheets' warped corners; ``sheets`` has a transform, width and height. Whole pixels by floor and ceiling."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    corners = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.lit(0.0), F.lit(0.0)), (w, F.lit(0.0)), (w, h), (F.lit(0.0), h))])
    put = sheets.select(*keys, F.col(transform).alias("_t"), F.explode(corners).alias("_c")).select(*keys, G.project(F.col("_t"), F.col("_c.x"), F.col("_c.y")).alias("_p"))
    lo, hi = (F.floor, F.ceil) if whole else (lambda c: c, lambda c: c)
    return put.groupBy(*keys).agg(lo(F.min("_p.x")).alias("x_min"), lo(F.min("_p.y")).alias("y_min"), hi(F.max("_p.x")).alias("x_max"), hi(F.max("_p.y")).alias("y_max"))


def canvas_of(placed: DataFrame, keys: list[str], pad: int = 200) -> DataFrame:
    """The canvas of placed boxes (x, y, w, h) with a border."""
    return placed.groupBy(*keys).agg(
        (F.min("x") - pad).alias("min_x"), (F.min("y") - pad).alias("min_y"), (F.max(F.col("x") + F.col("w")) + pad).alias("max_x"), (F.max(F.col("y") + F.col("h")) + pad).alias("max_y")
    )


def weighted_blend(pixels: DataFrame, keys: list[str], least: float = 1e-6, paper: float = 255.0) -> DataFrame:
    """Weighted mean of the values at each pixel, paper where the weights come to nothing."""
    sums = pixels.groupBy(*keys).agg(F.sum(F.col("v") * F.col("w")).alias("_vw"), F.sum("w").alias("weight"))
    return sums.select(*keys, F.when(F.col("weight") > least, F.col("_vw") / F.col("weight")).otherwise(paper).alias("v"), "weight")


def first_writer(pixels: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The value of the first sheet that covers a pixel."""
    return pixels.groupBy(*keys).agg(F.min_by("v", order).alias("v"))


def overlap_average(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Whole-numbered mean where sheets overlap, else the one value."""
    return pixels.groupBy(*keys).agg(F.floor(F.sum(F.col("v").cast("long")) / F.count("*")).alias("v"), F.count("*").alias("n"))


def coverage(pixels: DataFrame, keys: list[str], total: Column) -> DataFrame:
    return pixels.groupBy(*keys).agg((F.count_if(F.col("written") > 0) / F.max(total)).alias("coverage"))


def paper_tone(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Median tone of covered pixels, which fills interior gaps."""
    s = with_medians(pixels.where(F.col("written") > 0), keys, {"_v": F.col("v").cast("double")}, [])
    return s.select(*keys, F.col("_median__v").alias("tone"))


def split_stats(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images and annotations of each split."""
    a = annotations.groupBy("split").agg(F.count("*").alias("n_annotations"))
    return images.groupBy("split").agg(F.count("*").alias("n_images")).join(a, "split", "left").withColumn("n_annotations", F.coalesce("n_annotations", F.lit(0)))


def best_reading(readings: DataFrame, keys: list[str], value: str = "number", confidence: str = "confidence", idx: str = "idx") -> DataFrame:
    """The reading of the largest confidence of each group, the first of equals."""
    top = F.max_by(F.struct(*[F.col(c) for c in readings.columns if c not in keys]), F.struct(F.col(confidence), -F.col(idx)))
    return readings.where(F.col(value).isNotNull()).groupBy(*keys).agg(top.alias("best")).select(*keys, "best.*")


def count_where(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
