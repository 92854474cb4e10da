"""Keypoints of sheets: extrema of differences of Gaussians with orientations and histograms of gradients, after Lowe (2004).

The kernel is plain numpy; :func:`detect` runs it over rows of images, one sheet at a time, and gives the keypoint table that the nearest-neighbour
join takes. The defaults are the contrast, edge and blur limits of the paper.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from . import raster

SIGMA, SCALES, CONTRAST, EDGE_RATIO, MOST = 1.6, 3, 0.03, 10.0, 5000
BINS, CELLS, DIRECTIONS = 36, 4, 8
SCHEMA = "map_num string, detector string, kp_id int, x float, y float, size float, angle float, response float, octave int, class_id int, descriptor array<float>"


def blurred(img: np.ndarray, sigma: float) -> np.ndarray:
    return raster.gauss(img, 2 * max(1, math.ceil(3 * sigma)) + 1, sigma).astype(np.float32)


def scale_space(img: np.ndarray, sigma: float = SIGMA, scales: int = SCALES) -> list[np.ndarray]:
    """For each octave its blurred images (scale, y, x); an octave has half the sides of the one before."""
    base = blurred(img.astype(np.float32) / 255, math.sqrt(max(sigma**2 - 0.25, 0.01)))
    octaves = []
    while min(base.shape) >= 8:
        levels = [base]
        for k in range(1, scales + 3):
            before, now = sigma * 2 ** ((k - 1) / scales), sigma * 2 ** (k / scales)
            levels.append(blurred(levels[-1], math.sqrt(now**2 - before**2)))
        octaves.append(np.stack(levels))
        base = levels[scales][::2, ::2]
    return octaves


def extrema(differences: np.ndarray, contrast: float, edge_ratio: float, scales: int) -> np.ndarray:
    """(scale, y, x, response) of the places that are larger or smaller than all 26 around them, refined by a parabola; flat and edge-like ones are left out."""
    d, found = differences, []
    for k in range(1, len(d) - 1):
        mid = d[k, 1:-1, 1:-1]
        peak, pit = np.ones(mid.shape, bool), np.ones(mid.shape, bool)
        for i, y, x in np.ndindex(3, 3, 3):
            other = d[k - 1 + i, y : y + mid.shape[0], x : x + mid.shape[1]]
            if (i, y, x) < (1, 1, 1):  # of equal neighbours the last one stands
                peak &= mid >= other
                pit &= mid <= other
            elif (i, y, x) > (1, 1, 1):
                peak &= mid > other
                pit &= mid < other
        at = np.argwhere((np.abs(mid) > 0.5 * contrast / scales) & (peak | pit)) + 1
        found.append(np.c_[np.full(len(at), k), at])
    found = np.concatenate(found) if found else np.zeros((0, 3), int)
    kept = set()
    for at in found.tolist():
        for _ in range(5):  # to the sample that the parabola's peak is nearest to
            (s, y, x), c = at, d[at[0] - 1 : at[0] + 2, at[1] - 1 : at[1] + 2, at[2] - 1 : at[2] + 2].astype(float)
            step, response, curved = _peak(c)
            if step is None or np.abs(step).max() <= 0.6:
                break
            at = [min(max(v + round(u), 1), n - 2) for v, u, n in zip(at, step.tolist(), d.shape, strict=True)]
        if step is None or np.abs(step).max() > 1.0 or abs(response) * scales < contrast:
            continue
        yy, xx, yx = curved
        trace, det = yy + xx, yy * xx - yx * yx
        if det > 0 and trace * trace * edge_ratio < (edge_ratio + 1) ** 2 * det:
            kept.add((s + float(step[0]), y + float(step[1]), x + float(step[2]), abs(response)))
    return np.array(sorted(kept)).reshape(-1, 4)


def _peak(c: np.ndarray) -> tuple[np.ndarray | None, float, tuple[float, float, float]]:
    """Where the parabola through a 3 x 3 x 3 cube peaks, from its middle; its height there; and its second derivatives in the plane."""
    g = np.array([c[2, 1, 1] - c[0, 1, 1], c[1, 2, 1] - c[1, 0, 1], c[1, 1, 2] - c[1, 1, 0]]) / 2
    ss, yy, xx = c[2, 1, 1] + c[0, 1, 1] - 2 * c[1, 1, 1], c[1, 2, 1] + c[1, 0, 1] - 2 * c[1, 1, 1], c[1, 1, 2] + c[1, 1, 0] - 2 * c[1, 1, 1]
    sy, sx = (c[2, 2, 1] - c[2, 0, 1] - c[0, 2, 1] + c[0, 0, 1]) / 4, (c[2, 1, 2] - c[2, 1, 0] - c[0, 1, 2] + c[0, 1, 0]) / 4
    yx = (c[1, 2, 2] - c[1, 2, 0] - c[1, 0, 2] + c[1, 0, 0]) / 4
    hessian = np.array([[ss, sy, sx], [sy, yy, yx], [sx, yx, xx]])
    if abs(np.linalg.det(hessian)) < 1e-18:
        return None, 0.0, (yy, xx, yx)
    step = -np.linalg.solve(hessian, g)
    return step, float(c[1, 1, 1] + 0.5 * g @ step), (yy, xx, yx)


def _patch(gy: np.ndarray, gx: np.ndarray, y: float, x: float, radius: int) -> tuple[np.ndarray, ...]:
    """Offsets, size and angle (in turns) of the gradients in a square around a place, as far as it lies within the image."""
    cy, cx = round(y), round(x)
    ys, xs = np.arange(max(cy - radius, 1), min(cy + radius + 1, gy.shape[0] - 1)), np.arange(max(cx - radius, 1), min(cx + radius + 1, gy.shape[1] - 1))
    at = np.ix_(ys, xs)
    dy, dx = np.meshgrid(ys - y, xs - x, indexing="ij")
    return dy.ravel(), dx.ravel(), np.hypot(gy[at], gx[at]).ravel(), (np.arctan2(gy[at], gx[at]).ravel() / (2 * np.pi)) % 1.0


def orientations(gy: np.ndarray, gx: np.ndarray, y: float, x: float, sigma: float) -> list[float]:
    """The peaks, in turns, of a place's histogram of gradient directions that reach four fifths of the highest."""
    dy, dx, size, turn = _patch(gy, gx, y, x, max(1, round(4.5 * sigma)))
    votes = np.bincount((turn * BINS).astype(int) % BINS, size * np.exp(-(dy * dy + dx * dx) / (2 * (1.5 * sigma) ** 2)), BINS)
    votes = sum(w * np.roll(votes, k) for k, w in ((-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1))) / 16
    left, right = np.roll(votes, 1), np.roll(votes, -1)
    made = []
    for k in np.flatnonzero((votes > left) & (votes > right) & (votes >= 0.8 * votes.max())).tolist():
        bend = left[k] - 2 * votes[k] + right[k]
        made.append(((k + 0.5 + 0.5 * (left[k] - right[k]) / bend) / BINS) % 1.0)
    return made


def descriptor(gy: np.ndarray, gx: np.ndarray, y: float, x: float, sigma: float, turn: float) -> np.ndarray:
    """Gradient histograms of 4 x 4 cells by 8 directions relative to the orientation; unit length, large parts cut at a fifth."""
    width = 3 * sigma
    dy, dx, size, angle = _patch(gy, gx, y, x, round(width * math.sqrt(2) * (CELLS + 1) / 2))
    c, s = math.cos(2 * math.pi * turn), math.sin(2 * math.pi * turn)
    u, v = (c * dx + s * dy) / width, (c * dy - s * dx) / width
    size = size * np.exp(-(u * u + v * v) / (2 * (CELLS / 2) ** 2))
    u, v, o = u + CELLS / 2 - 0.5, v + CELLS / 2 - 0.5, ((angle - turn) % 1.0) * DIRECTIONS
    out = np.zeros((CELLS + 2, CELLS + 2, DIRECTIONS))
    inside = (u > -1) & (u < CELLS) & (v > -1) & (v < CELLS)
    u, v, o, size = (z[inside] for z in (u, v, o, size))
    i, j, k = np.floor(v).astype(int), np.floor(u).astype(int), np.floor(o).astype(int)
    for di in (0, 1):
        for dj in (0, 1):
            for dk in (0, 1):
                share = np.abs(1 - di - (v - i)) * np.abs(1 - dj - (u - j)) * np.abs(1 - dk - (o - k))
                np.add.at(out, (i + di + 1, j + dj + 1, (k + dk) % DIRECTIONS), size * share)
    d = out[1:-1, 1:-1].ravel()
    d = np.minimum(d / max(float(np.linalg.norm(d)), 1e-12), 0.2)
    return d / max(float(np.linalg.norm(d)), 1e-12)


def keypoints(img: np.ndarray, most: int = MOST, contrast: float = CONTRAST, edge_ratio: float = EDGE_RATIO, sigma: float = SIGMA, mask: np.ndarray | None = None) -> list[tuple]:
    """(x, y, size, angle in degrees, response, octave, descriptor) of up to ``most`` keypoints, the strongest ones; only within ``mask`` if one is given."""
    made = []
    for octave, levels in enumerate(scale_space(img, sigma)):
        gradients: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for s, y, x, response in extrema(np.diff(levels, axis=0), contrast, edge_ratio, SCALES).tolist():
            times = 2**octave
            py, px = min(img.shape[0] - 1, max(0, round(y * times))), min(img.shape[1] - 1, max(0, round(x * times)))
            if mask is not None and not mask[py, px]:
                continue
            level = min(max(round(s), 0), len(levels) - 1)
            gy, gx = gradients.get(level) or gradients.setdefault(level, np.gradient(levels[level]))
            own = sigma * 2 ** (s / SCALES)
            for turn in orientations(gy, gx, y, x, own):
                made.append((x * times, y * times, 2 * own * times, 360 * turn, response, octave, descriptor(gy, gx, y, x, own, turn)))
    made.sort(key=lambda k: (-k[4], k[1], k[0], k[3]))
    return made[:most]


def detect(images: DataFrame, most: int = MOST, contrast: float = CONTRAST, edge_ratio: float = EDGE_RATIO, sigma: float = SIGMA) -> DataFrame:
    """The keypoint table of sheets, by response: kp_id counts from 0 within a sheet."""

    def run(m, a):
        for k, (x, y, size, angle, response, octave, d) in enumerate(keypoints(raster.gray(a), most, contrast, edge_ratio, sigma)):
            yield m, "gradients", k, x, y, size, angle, response, octave, 0, d.tolist()

    return raster.map_images(images, run, SCHEMA)
