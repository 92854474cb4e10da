"""Robust fits of transforms between point pairs: translation, similarity, perspective. Kernels are seeded numpy; tiers and residuals are expressions.

A pair of many points is fitted by many tasks: tasks draw and score samples, sums of the best one's inliers give the last fit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..shared import materialize
from . import aggregates

SEED = 20_240_601
LOCAL_POINTS = 50_000  # points of a pair that one task fits, or scores of a larger pair
BATCH = 512  # points that meet all samples at once
COORDINATES = ["cx_a", "cy_a", "cx_b", "cy_b"]


def apply(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return q[:, :2] / q[:, 2:]


def fit_translation(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    h = np.eye(3)
    h[:2, 2] = (dst - src).mean(axis=0)
    return h


def fit_similarity(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Least-squares rotation, uniform scale and shift; None if the source points coincide."""
    a, b = src.mean(axis=0), dst.mean(axis=0)
    z, w = (src - a) @ np.array([1, 1j]), (dst - b) @ np.array([1, 1j])
    spread = float((np.abs(z) ** 2).sum())
    if spread < 1e-12:
        return None
    s = (np.conj(z) @ w) / spread
    h = np.array([[s.real, -s.imag, 0], [s.imag, s.real, 0], [0, 0, 1.0]])
    h[:2, 2] = b - h[:2, :2] @ a
    return h


def _spread_out(p: np.ndarray) -> np.ndarray:
    c = p.mean(axis=0)
    s = np.sqrt(2) / max(float(np.linalg.norm(p - c, axis=1).mean()), 1e-12)
    return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def fit_perspective(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Direct linear transform with normalised points; None for degenerate ones."""
    if len(src) < 4:
        return None
    ts, td = _spread_out(src), _spread_out(dst)
    p, q = apply(ts, src), apply(td, dst)
    x, y, u, v = p[:, 0], p[:, 1], q[:, 0], q[:, 1]
    o, z = np.ones_like(x), np.zeros_like(x)
    rows = np.r_[np.c_[x, y, o, z, z, z, -u * x, -u * y, -u], np.c_[z, z, z, x, y, o, -v * x, -v * y, -v]]
    _, sizes, vt = np.linalg.svd(rows)
    if len(sizes) > 7 and sizes[7] < 1e-9 * sizes[0]:
        return None
    h = np.linalg.inv(td) @ vt[-1].reshape(3, 3) @ ts
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


FITS = {"translation": (1, fit_translation), "similarity": (2, fit_similarity), "perspective": (4, fit_perspective)}


def _residuals(h: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    d = np.linalg.norm(apply(h, src) - dst, axis=1)
    return np.where(np.isfinite(d), d, np.inf)


def robust_fit(src: np.ndarray, dst: np.ndarray, model: str, threshold: float | None = None, rounds: int = 500, seed: int = SEED) -> tuple[np.ndarray | None, np.ndarray]:
    """(transform, inliers): consensus within ``threshold`` pixels, or without one the least median of residuals.

    Samples are drawn by a seeded generator, so the same points give the same fit; the best sample's inliers are fitted again.
    """
    least, fit = FITS[model]
    n = len(src)
    if n < least:
        return None, np.zeros(n, bool)
    rng, best, kept = np.random.default_rng(seed), None, np.zeros(n, bool)
    samples = [np.arange(n)] if n == least else [rng.choice(n, least, replace=False) for _ in range(rounds)]
    for at in samples:
        h = fit(src[at], dst[at])
        if h is None or not np.isfinite(h).all():
            continue
        r = _residuals(h, src, dst)
        if threshold is None:
            mid = float(np.median(r))
            score, inside = -mid, r <= max(2.5 * 1.4826 * (1 + 5 / max(n - least, 1)) * mid, 1e-6)
        else:
            inside = r <= threshold
            score = float(inside.sum()) - 1e-9 * float(r[inside].sum())
        if best is None or score > best:
            best, kept, out = score, inside, h
    if best is None:
        return None, np.zeros(n, bool)
    again = fit(src[kept], dst[kept]) if kept.sum() >= least else None
    if again is not None and np.isfinite(again).all() and (threshold is None or (_residuals(again, src, dst) <= threshold).sum() >= kept.sum()):
        out = again
        if threshold is not None:
            kept = _residuals(out, src, dst) <= threshold
    return out, kept


def fit_pairs(points: DataFrame, model: str = "perspective", threshold: float | None = 300.0, least: int = 4) -> DataFrame:
    """A transform from B to A for each pair of sheets: pair, n, n_inliers, h; null below ``least`` points. ``points``: pair, cx_a, cy_a, cx_b, cy_b.

    Pairs of more than ``LOCAL_POINTS`` points, which are counted, are fitted by many tasks; without a threshold every pair is one task.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(COORDINATES, kind="stable")
        src, dst = pdf[["cx_b", "cy_b"]].to_numpy(float), pdf[["cx_a", "cy_a"]].to_numpy(float)
        h, inside = robust_fit(src, dst, model, threshold) if len(pdf) >= least else (None, np.zeros(len(pdf), bool))
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "n": [len(pdf)], "n_inliers": [int(inside.sum())], "h": [None if h is None else h.ravel().tolist()]})

    points = points.select("pair", *COORDINATES)
    local = lambda df: df.groupBy("pair").applyInPandas(solve, "pair string, n long, n_inliers long, h array<double>")
    if threshold is None:
        return local(points)
    large = materialize(points.groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") > max(LOCAL_POINTS, least)), "large-pairs")
    if large.isEmpty():
        return local(points)
    return local(_met(points, large, "left_anti")).unionByName(_fit_large(points, large, model, threshold))


def _met(df: DataFrame, of_pairs: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the columns of their pair's row in ``of_pairs``, which has a row for each large pair; a missing pair meets itself."""
    side = of_pairs.withColumnRenamed("pair", "_pair")
    return df.join(F.broadcast(side), F.col("pair").eqNullSafe(F.col("_pair")), how).drop("_pair")


def score_samples(src: np.ndarray, dst: np.ndarray, times: np.ndarray, hs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """How many points lie within the threshold under each transform (k, 3, 3), and the sum of their residuals; points count ``times``."""
    inside, off = np.zeros(len(hs)), np.zeros(len(hs))
    for k in range(0, len(src), BATCH):
        p, d, n = np.c_[src[k : k + BATCH], np.ones(len(src[k : k + BATCH]))], dst[k : k + BATCH], times[k : k + BATCH]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            x, y = p @ hs[:, 0].T, p @ hs[:, 1].T
            if (hs[:, 2] != (0, 0, 1)).any():
                w = p @ hs[:, 2].T
                x, y = x / w, y / w
            r = np.sqrt((x - d[:, :1]) ** 2 + (y - d[:, 1:]) ** 2)
            near = r <= threshold
        inside += n @ near
        off += n @ np.where(near, r, 0.0)
    return inside, off


def _fit_large(points: DataFrame, large: DataFrame, model: str, threshold: float, rounds: int = 500) -> DataFrame:
    """The fits of ``robust_fit`` for large pairs (pair, n): no task holds more than a part of a pair.

    Equal points are one with a number of times. Samples are drawn from points that come first by a hash, weighted by their times, so
    they are not those of ``robust_fit``; the best one by the same score is fitted again over all its inliers, by sums.
    """
    least, fit = FITS[model]
    drawn = rounds * least
    dealt = F.xxhash64(F.lit(SEED), *COORDINATES)
    # the part goes by another hash than the draw, and so do the tasks of the shuffle
    each = _met(points, large).withColumn("part", F.pmod(F.hash(*COORDINATES, F.lit(SEED)), F.floor(F.col("n") / LOCAL_POINTS) + 1))
    each = materialize(each.groupBy("pair", "part", *COORDINATES).agg(F.count("*").cast("double").alias("w")), "large-points")
    u = (F.shiftrightunsigned(dealt, 11) + 0.5) / float(1 << 53)
    first = Window.partitionBy("pair").orderBy("late", *COORDINATES)
    some = each.withColumn("late", -F.ln(u) / F.col("w")).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= drawn)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rng, hs = pdf.sort_values("_r"), np.random.default_rng(SEED), []
        src, dst = pdf[["cx_b", "cy_b"]].to_numpy(float), pdf[["cx_a", "cy_a"]].to_numpy(float)
        share = None if len(pdf) == drawn else (pdf["w"] / pdf["w"].sum()).to_numpy()
        for _ in range(rounds if len(pdf) >= least else 0):
            at = rng.choice(len(pdf), least, replace=False, p=share)
            h = fit(src[at], dst[at])
            if h is not None and np.isfinite(h).all():
                hs.append(h.ravel())
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "hs": [np.concatenate(hs).tolist() if hs else []]})

    samples = materialize(some.groupBy("pair").applyInPandas(draw, "pair string, hs array<double>"), "samples")
    parts = _met(samples, large).select("pair", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / LOCAL_POINTS))).alias("part"), "hs")

    def score(pts: pd.DataFrame, sampled: pd.DataFrame) -> pd.DataFrame:
        hs = np.array(sampled["hs"].iloc[0] if len(sampled) and len(pts) else [], float).reshape(-1, 3, 3)
        inside, off = score_samples(pts[["cx_b", "cy_b"]].to_numpy(float), pts[["cx_a", "cy_a"]].to_numpy(float), pts["w"].to_numpy(float), hs, threshold)
        return pd.DataFrame({"pair": pd.Series([pts["pair"].iloc[0] if len(pts) else None] * len(hs), dtype=object), "sample": np.arange(len(hs)), "inside": inside, "off": off})

    scored = each.groupBy("pair", "part").cogroup(parts.groupBy("pair", "part")).applyInPandas(score, "pair string, sample int, inside double, off double")
    scored = scored.groupBy("pair", "sample").agg(F.sum("inside").alias("inside"), F.sum("off").alias("off"))
    best = scored.groupBy("pair").agg(F.max_by(F.struct("sample", "inside"), F.struct(F.col("inside") - 1e-9 * F.col("off"), -F.col("sample"))).alias("b"))
    best = _met(samples, best).select("pair", F.slice("hs", F.col("b.sample") * 9 + 1, 9).alias("h"), F.col("b.inside").alias("kept"))
    best = materialize(best, "best-samples")
    again = materialize(_fitted_again(_within(each, best, threshold), model), "fits-again")
    recount = _within(each, again.select("pair", "h"), threshold).groupBy("pair").agg(F.sum("w").alias("again"))
    found = _met(_met(best, again.withColumnRenamed("h", "h2"), "left"), recount, "left")
    better = (F.col("kept") >= least) & (F.col("again") >= F.col("kept"))
    found = found.select("pair", F.when(better, F.col("again")).otherwise(F.col("kept")).alias("kept"), F.when(better, F.col("h2")).otherwise(F.col("h")).alias("h"))
    return _met(large, found, "left").select(F.col("pair").cast("string").alias("pair"), "n", F.coalesce(F.col("kept").cast("long"), F.lit(0)).alias("n_inliers"), "h")


def _within(each: DataFrame, fits: DataFrame, threshold: float) -> DataFrame:
    """Points within the threshold under their pair's transform."""
    x, y, w = (F.col("h")[k] * F.col("cx_b") + F.col("h")[k + 1] * F.col("cy_b") + F.col("h")[k + 2] for k in (0, 3, 6))
    dx, dy = F.try_divide(x, w) - F.col("cx_a"), F.try_divide(y, w) - F.col("cy_a")
    return _met(each, fits.select("pair", "h")).where(F.sqrt(dx * dx + dy * dy) <= threshold).drop("h")


def _fitted_again(inside: DataFrame, model: str) -> DataFrame:
    """pair, h: the plain fit of each pair's points, from sums about their means; no row where there is none."""
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"m_{c}")
    means = materialize(inside.groupBy("pair").agg(*[mean(c) for c in COORDINATES]), "means")
    u, v, x, y = (F.col(c) - F.col(f"m_{c}") for c in COORDINATES)
    total = lambda c: F.sum(F.col("w") * c)
    moved = _met(inside, means)
    if model == "perspective":
        far = lambda a, b: (total(F.sqrt(a * a + b * b)) / F.sum("w"))
        spread = moved.groupBy("pair").agg(*[(math.sqrt(2) / F.greatest(far(*c), F.lit(1e-12))).alias(n) for n, c in (("s_a", (u, v)), ("s_b", (x, y)))])
        moved = _met(moved, materialize(spread, "spreads"))
        x, y, u, v = x * F.col("s_b"), y * F.col("s_b"), u * F.col("s_a"), v * F.col("s_a")
        one = F.lit(1.0)
        products = [a * b for a, b in ((x, x), (x, y), (x, one), (y, y), (y, one), (one, one))]
        sums = F.array(*[total(by * p) for by in (one, u, v, u * u + v * v) for p in products])
        sums = moved.groupBy("pair", *[f"m_{c}" for c in COORDINATES], "s_a", "s_b").agg(sums.alias("sums"))
        given = ["s_a", "s_b"]
    else:
        sums = moved.groupBy("pair", *[f"m_{c}" for c in COORDINATES]).agg(F.array(total(x * x + y * y), total(x * u + y * v), total(x * v - y * u)).alias("sums"))
        given = []

    @F.udf("array<double>")
    def h(centre, scale, sums):
        found = fit_of_sums(model, np.array(centre, float), scale, np.array(sums, float))
        return None if found is None or not np.isfinite(found).all() else found.ravel().tolist()

    return sums.select("pair", h(F.array(*[f"m_{c}" for c in COORDINATES]), F.array(*given).cast("array<double>"), "sums").alias("h")).where("h is not null")


def fit_of_sums(model: str, centre: np.ndarray, scale: list[float], sums: np.ndarray) -> np.ndarray | None:
    """A fit from the means of A and B and the sums about them, as the fits of points give; for perspective ones of points scaled by ``scale``."""
    a, b = centre[:2], centre[2:]
    h = np.eye(3)
    if model == "translation":
        h[:2, 2] = a - b
    elif model == "similarity":
        if sums[0] < 1e-12:
            return None
        c, s = sums[1:] / sums[0]
        h[:2, :2] = [[c, -s], [s, c]]
        h[:2, 2] = a - h[:2, :2] @ b
    else:
        o, u, v, q = (np.array([[m[0], m[1], m[2]], [m[1], m[3], m[4]], [m[2], m[4], m[5]]]) for m in sums.reshape(4, 6))
        sizes, vectors = np.linalg.eigh(np.block([[o, np.zeros((3, 3)), -u], [np.zeros((3, 3)), o, -v], [-u, -v, q]]))
        if sizes[1] < 1e-14 * sizes[-1]:  # squares of singular values
            return None
        turn = lambda s, m: np.array([[s, 0, -s * m[0]], [0, s, -s * m[1]], [0, 0, 1]])
        h = np.linalg.inv(turn(scale[0], a)) @ vectors[:, 0].reshape(3, 3) @ turn(scale[1], b)
        return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None
    return h


def inliers(points: DataFrame, fits: DataFrame, threshold: float = 300.0) -> DataFrame:
    """Points with their residual under the pair's fit, those within the threshold."""
    return with_residuals(points.join(fits.select("pair", "h"), "pair"), F.col("h")).where(F.col("residual") <= threshold).drop("h")


def with_residuals(points: DataFrame, h: Column) -> DataFrame:
    """residual: distance of A's point and B's under a transform from B to A."""
    p = G.project(h, F.col("cx_b"), F.col("cy_b"))
    return points.withColumn("residual", F.hypot(p["x"] - F.col("cx_a"), p["y"] - F.col("cy_a")))


def residual_report(points: DataFrame, priors: DataFrame) -> DataFrame:
    """Median and mean residual of each pair's points under a prior transform."""
    return aggregates.residual_stats(with_residuals(points.join(priors.select("pair", "h"), "pair"), F.col("h")), ["pair"])


def click_model(n: Column) -> Column:
    """The model for so many clicked points: none, translation, similarity up to five, then perspective."""
    return F.when(n == 0, "none").when(n == 1, "translation").when(n < 6, "similarity").otherwise("perspective")


def refine_model(n: Column) -> Column:
    """The model for so many line ends: none, median translation of the current transform up to two, similarity of three, then perspective."""
    return F.when(n == 0, "none").when(n <= 2, "translation").when(n == 3, "similarity").otherwise("perspective")


def fit_clicks(points: DataFrame) -> DataFrame:
    """Tiered fits of clicked points, by least median of squares beyond one point: pair, n, model, h. A tier that fails falls back."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cx_a", "cy_a", "cx_b", "cy_b"], kind="stable")
        src, dst, n = pdf[["cx_b", "cy_b"]].to_numpy(float), pdf[["cx_a", "cy_a"]].to_numpy(float), len(pdf)
        model = "translation" if n == 1 else "similarity" if n < 6 else "perspective"
        h = fit_translation(src, dst) if n == 1 else robust_fit(src, dst, model)[0]
        if h is None and 4 <= n < 6:
            model, h = "perspective", robust_fit(src, dst, "perspective")[0]
        elif h is None and n < 4:
            model, h = "translation", fit_translation(src, dst)
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "n": [n], "model": [model], "h": [None if h is None else h.ravel().tolist()]})

    return points.select("pair", "cx_a", "cy_a", "cx_b", "cy_b").groupBy("pair").applyInPandas(solve, "pair string, n long, model string, h array<double>")


def refine(points: DataFrame, current: DataFrame) -> DataFrame:
    """Refined transforms of pairs with line ends: one or two correct the current transform by their median shift, more are fitted anew.

    Pairs without points keep their transform: pair, n, model, h.
    """
    met = points.join(current.select("pair", F.col("h").alias("h0")), "pair")
    p = G.project(F.col("h0"), F.col("cx_b"), F.col("cy_b"))
    moved = met.select("pair", "h0", "cx_a", "cy_a", p["x"].alias("cx_b"), p["y"].alias("cy_b"))
    shift = aggregates.median_translation(moved, ["pair"])
    fits = fit_pairs(points, "similarity", 30.0, 3).select("pair", F.col("h").alias("h3")).join(fit_pairs(points, "perspective", 20.0, 4).select("pair", F.col("h").alias("h4")), "pair")
    out = current.select("pair", F.col("h").alias("h0")).join(shift, "pair", "left").join(fits, "pair", "left")
    n = F.coalesce("n", F.lit(0))
    h = F.when(n == 0, F.col("h0")).when(n <= 2, G.multiply(G.translation(F.col("dx"), F.col("dy")), F.col("h0"))).when(n == 3, F.coalesce("h3", "h0")).otherwise(F.coalesce("h4", "h0"))
    return out.select("pair", n.alias("n"), refine_model(n).alias("model"), h.alias("h"))


def corrected_by_translation(rough: DataFrame, points: DataFrame) -> DataFrame:
    """Rough transforms moved by the median shift of the pair's control points; pairs without points stay: pair, n, h."""
    met = points.join(rough.select("pair", F.col("h").alias("h0")), "pair")
    p = G.project(F.col("h0"), F.col("cx_b"), F.col("cy_b"))
    shift = aggregates.median_translation(met.select("pair", "cx_a", "cy_a", p["x"].alias("cx_b"), p["y"].alias("cy_b")), ["pair"])
    out = rough.select("pair", "h").join(shift, "pair", "left")
    return out.select("pair", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, G.multiply(G.translation(F.col("dx"), F.col("dy")), F.col("h"))).otherwise(F.col("h")).alias("h"))
