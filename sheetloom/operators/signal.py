"""Alignment of one-dimensional profiles and of strips: by lag joins in SQL and by numpy kernels for whole strips."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G

LEAST_OVERLAP = 20
MOST_EXACT = 256  # lags that are summed up directly where the transform can't tell them apart


def best_lag(a: np.ndarray, b: np.ndarray) -> int:
    """The lag of the largest cross-correlation of two signals, from 1 - len(b) to len(a) - 1, by a zero-padded Fourier transform.

    Lags that its rounding can't tell apart are summed up directly. Of equal ones the least from 0 upwards counts, then the least of the negative ones.
    """
    n = len(a) + len(b) - 1
    size = 1 << (n - 1).bit_length()
    by_lag = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)
    by_lag = np.concatenate([by_lag[: len(a)], by_lag[size - len(b) + 1 :]])
    scale = float(np.sqrt((a @ a) * (b @ b)))
    lags = np.flatnonzero(by_lag >= by_lag.max() - 1e-9 * scale)
    lags = np.where(lags < len(a), lags, lags - n)
    if 1 < len(lags) <= MOST_EXACT:
        exact = np.array([_dot_at(a, b, lag) for lag in lags.tolist()])
        lags = lags[exact >= exact.max() - 1e-13 * scale]
    return int(lags[0])


def _dot_at(a: np.ndarray, b: np.ndarray, lag: int) -> float:
    x, y = a[max(lag, 0) :], b[max(-lag, 0) :]
    common = min(len(x), len(y))
    return float(x[:common] @ y[:common])


def aligned_scores(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """(score, offset): the offset of the largest plain cross-correlation, and the correlation coefficient there, brought to 0..1.

    Uncorrelated signals score a half; fewer than ``LEAST_OVERLAP`` common positions, or a constant stretch, score 0. Offsets are those of :func:`best_lag`.
    """
    a, b = (np.asarray(x, float) for x in (a, b))
    if not a.size or not b.size:
        return 0.0, 0
    a, b = a - a.mean(), b - b.mean()
    lag = best_lag(a, b)
    x, y = a[max(lag, 0) :], b[max(-lag, 0) :]
    common = min(len(x), len(y))
    spread = x[:common].std() * y[:common].std() if common else 0.0
    if common < LEAST_OVERLAP or min(x[:common].std(), y[:common].std()) < 1e-6:
        return 0.0, lag
    return float(min(1.0, max(0.0, 0.5 + 0.5 * float(x[:common] @ y[:common]) / (common * spread)))), lag


def strip_similarity(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Correlation coefficient, as 0..1, of two strips whose first axis runs along the boundary, b shifted by ``offset``."""
    w = min(a.shape[1], b.shape[1])
    i, j = max(0, offset), max(0, -offset)
    m = min(len(a) - i, len(b) - j)
    if m < LEAST_OVERLAP:
        return 0.0
    x, y = a[i : i + m, :w].astype(float), b[j : j + m, :w].astype(float)
    x, y = x - x.mean(), y - y.mean()
    if min(x.std(), y.std()) < 1e-6:
        return 0.0
    return max(0.0, float(((x * y).mean() / (x.std() * y.std()) + 1) / 2))


def along_boundary(strip: np.ndarray, edge: str) -> np.ndarray:
    """A strip with its first axis along the boundary."""
    return strip if edge in ("left", "right") else strip.T


def strip_scores(strip_a: np.ndarray, edge_a: str, strip_b: np.ndarray, edge_b: str, dark: int = 180) -> dict[str, float]:
    """Phase score, similarity, densities and offset of two edge strips; b is read forwards or backwards, whichever aligns better."""
    a, b = along_boundary(strip_a, edge_a), along_boundary(strip_b, edge_b)
    profile_a, profile_b = 255 - a.mean(axis=1), 255 - b.mean(axis=1)
    forward, backward = aligned_scores(profile_a, profile_b), aligned_scores(profile_a, profile_b[::-1])
    mirrored = backward[0] > forward[0]
    phase, offset = backward if mirrored else forward
    return {
        "phase_score": phase, "best_offset_px": offset, "ncc_2d": strip_similarity(a, b[::-1] if mirrored else b, offset),
        "density_a": float((strip_a < dark).mean()) if strip_a.size else 0.0, "density_b": float((strip_b < dark).mean()) if strip_b.size else 0.0,
    }


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("offset", T.IntegerType())]))
def phase_offset(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """score, offset of two array columns."""
    return pd.DataFrame([aligned_scores(x, y) for x, y in zip(a, b, strict=True)], columns=["score", "offset"])


def orientation_columns(phase: Column, ncc: Column, density_a: Column, density_b: Column, weights: tuple[float, float, float] = (0.80, 0.10, 0.10)) -> dict[str, Column]:
    """density_sim, combined_score and error from a kernel's measures; the weights are parameters."""
    similarity = G.density_similarity(density_a, density_b)
    combined = G.combined_score(ncc, phase, similarity, weights)
    return {"density_sim": similarity, "combined_score": combined, "error": 1 - combined}


def lag_correlation(a: DataFrame, b: DataFrame, keys: list[str], bins: int = 200) -> DataFrame:
    """Full discrete cross-correlation of two binned profiles (keys, bin, value): keys, lag, corr for each lag with common bins.

    A profile has at most ``bins`` rows, so the join of two profiles is bounded by its square.
    """
    x = a.select(*keys, F.col("bin").alias("i"), F.col("value").alias("x"))
    y = b.select(*keys, F.col("bin").alias("j"), F.col("value").alias("y"))
    return x.join(y, keys).groupBy(*keys, (F.col("i") - F.col("j")).alias("lag")).agg(F.sum(F.col("x") * F.col("y")).alias("corr"))


def profile_shift(lags: DataFrame, keys: list[str], norm: Column, n: Column, bins: int = 200) -> DataFrame:
    """The first best lag of each pair as shift_px and score: peak times the root of the lesser crossing count, nothing below three."""
    best = lags.groupBy(*keys).agg(F.max(F.struct("corr", (-F.col("lag")).alias("l"))).alias("best"))
    few = n < 3
    return best.select(
        *keys, F.when(few, 0.0).otherwise(-F.col("best.l") * (norm / bins)).alias("shift_px"), F.when(few, 0.0).otherwise(F.col("best.corr") * F.sqrt(n.cast("double"))).alias("score")
    )


def peaks(profile: np.ndarray, n: int = 5, apart: int = 25) -> list[int]:
    """Up to n highest positions at least ``apart`` from each other, highest first taken, in order."""
    profile = np.asarray(profile, float)
    found: list[int] = []
    for at in np.lexsort((-np.arange(len(profile)), profile))[::-1].tolist():
        if len(found) == n:
            break
        if all(abs(at - p) >= apart for p in found):
            found.append(at)
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def profile_peaks(profile: pd.Series) -> pd.Series:
    return profile.map(peaks)
