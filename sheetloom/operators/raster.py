"""Raster kernels in numpy, and their application to image rows (map_num, height, width, n_channels, data).

Gray sheets have ink at 0 and paper at 255. A kernel takes and gives arrays; the operators at the end run kernels over rows of images in
Arrow batches, one image a row, and blend sheets tile by tile, so no task holds a canvas.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import OVERLAP_PX

IMAGE_SCHEMA = "map_num string, height int, width int, n_channels int, data binary"


def to_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    return a.reshape(height, width) if channels == 1 else a.reshape(height, width, channels)


def gray(img: np.ndarray) -> np.ndarray:
    """Luma of blue, green, red."""
    if img.ndim == 2:
        return img
    return np.clip(np.rint(img[..., :3] @ np.array([0.114, 0.587, 0.299])), 0, 255).astype(np.uint8)


def crop_bounds(img: np.ndarray, ink: int = 200, least: float = 0.001, padding: int = 30) -> tuple[int, int, int, int]:
    """y0, y1, x0, x1 of the rows and columns with enough ink, with padding; the whole image without any."""
    dark = img < ink
    ys, xs = (np.flatnonzero(dark.mean(axis=k) >= least) for k in (1, 0))
    h, w = img.shape
    if not len(ys) or not len(xs):
        return 0, h, 0, w
    return max(0, ys[0] - padding), min(h, ys[-1] + padding + 1), max(0, xs[0] - padding), min(w, xs[-1] + padding + 1)


def auto_crop(img: np.ndarray, **k) -> np.ndarray:
    y0, y1, x0, x1 = crop_bounds(img, **k)
    return img[y0:y1, x0:x1]


def sample(img: np.ndarray, x: np.ndarray, y: np.ndarray, outside: float) -> np.ndarray:
    """Bilinear values at points; beyond the image ``outside`` counts."""
    h, w = img.shape
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0

    def at(yy, xx):
        inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
        return np.where(inside, img[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)], outside)

    return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy


def rotate(img: np.ndarray, angle: float, paper: int = 255) -> np.ndarray:
    """Counter-clockwise turn: quarters exactly, others on an enlarged canvas of paper."""
    if angle % 90 == 0:
        return np.rot90(img, int(angle // 90) % 4)
    h, w = img.shape
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    new_w, new_h = int(w * abs(c) + h * abs(s)), int(w * abs(s) + h * abs(c))
    y, x = np.mgrid[:new_h, :new_w].astype(float)
    x, y = x - new_w / 2, y - new_h / 2
    return np.clip(np.rint(sample(img, c * x - s * y + w / 2, s * x + c * y + h / 2, paper)), 0, 255).astype(np.uint8)


def edge_strip(img: np.ndarray, edge: str, width: int = 200) -> np.ndarray:
    h, w = img.shape
    n = min(width, w // 4, h // 4)
    return {"left": img[:, :n], "right": img[:, w - n :], "top": img[:n], "bottom": img[h - n :]}[edge]


def trim_edge(img: np.ndarray, edge: str, ink: int = 200, least: float = 0.003) -> np.ndarray:
    """Cut the blank margin of one side, at most to the middle; an image without ink in that half stays."""
    turns = {"top": 0, "right": 1, "bottom": 2, "left": 3}[edge]
    up = np.rot90(img, turns)
    h = len(up)
    lines = (up < ink).mean(axis=1)[: h // 2 if edge in ("top", "left") else h - 1 - h // 2]
    found = np.flatnonzero(lines >= least)
    return np.rot90(up[found[0] :], -turns) if len(found) else img


def shrink(img: np.ndarray, scale: float) -> np.ndarray:
    """Area-weighted reduction."""
    def weights(n, m):
        edges = np.linspace(0, n, m + 1)
        lo, hi = edges[:-1, None], edges[1:, None]
        cover = np.clip(np.minimum(hi, np.arange(1, n + 1)) - np.maximum(lo, np.arange(n)), 0, None)
        return cover / cover.sum(axis=1, keepdims=True)

    h, w = img.shape
    m, n = max(1, int(h * scale)), max(1, int(w * scale))
    return np.clip(np.rint(weights(h, m) @ img.astype(float) @ weights(w, n).T), 0, 255).astype(np.uint8)


def cubic_weights(n: int, m: int, sharpness: float = -0.75) -> np.ndarray:
    """Rows of weights that resample n values to m by cubic convolution between pixel centres; beyond the ends the last value counts."""
    at = (np.arange(m) + 0.5) * n / m - 0.5
    first = np.floor(at).astype(int)
    out = np.zeros((m, n))
    for k in range(-1, 3):
        d = np.abs(at - first - k)
        near = ((sharpness + 2) * d - (sharpness + 3)) * d * d + 1
        far = ((sharpness * d - 5 * sharpness) * d + 8 * sharpness) * d - 4 * sharpness
        np.add.at(out, (np.arange(m), np.clip(first + k, 0, n - 1)), np.where(d <= 1, near, far))
    return out


def enlarge(img: np.ndarray, factor: int) -> np.ndarray:
    h, w = img.shape
    return np.clip(np.rint(cubic_weights(h, h * factor) @ img.astype(float) @ cubic_weights(w, w * factor).T), 0, 255).astype(np.uint8)


def recognition_crop(img: np.ndarray, x: int, y: int, w: int, h: int, pad: int = 15, factor: int = 3, least: int = 10) -> np.ndarray | None:
    """A box with a margin, enlarged, with its contrast equalised and lightly smoothed, as recognisers want it; None where nothing is left."""
    part = img[max(0, y - pad) : max(0, y + h + pad), max(0, x - pad) : max(0, x + w + pad)]
    if not part.size or min(part.shape) * factor < least:
        return None
    even = equalize_tiles(enlarge(part, factor), 3.0, 4)
    return np.clip(np.rint(gauss(even, 3, 0.5)), 0, 255).astype(np.uint8)


def thumbnail(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image shrunk to fit into a box; never enlarged."""
    return shrink(img, min(1.0, width / img.shape[1], height / img.shape[0]))


def prepare_for_placement(img: np.ndarray, angle: float, contact: str | None, scale: float = 0.10) -> np.ndarray:
    """Crop, turn, crop, trim the contact side, shrink."""
    img = auto_crop(rotate(auto_crop(img), angle))
    return shrink(trim_edge(img, contact) if contact else img, scale)


def otsu(img: np.ndarray) -> int:
    """The threshold that separates two classes of gray values best."""
    n = np.bincount(img.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def box_sums(img: np.ndarray, radius: int, power: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts over (2r+1)-squares cut off at the borders, by an integral image."""
    a = np.zeros((img.shape[0] + 1, img.shape[1] + 1))
    a[1:, 1:] = (img.astype(float) ** power).cumsum(0).cumsum(1)
    h, w = img.shape
    y0, y1 = np.maximum(np.arange(h) - radius, 0), np.minimum(np.arange(h) + radius + 1, h)
    x0, x1 = np.maximum(np.arange(w) - radius, 0), np.minimum(np.arange(w) + radius + 1, w)
    total = a[np.ix_(y1, x1)] - a[np.ix_(y0, x1)] - a[np.ix_(y1, x0)] + a[np.ix_(y0, x0)]
    return total, np.outer(y1 - y0, x1 - x0)


def local_variance(img: np.ndarray, radius: int = 15) -> np.ndarray:
    s, n = box_sums(img, radius)
    q, _ = box_sums(img, radius, 2)
    return q / n - (s / n) ** 2


def gauss(img: np.ndarray, size: int, sigma: float | None = None) -> np.ndarray:
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    p = np.pad(img.astype(float), size // 2, mode="edge")
    p = sum(k[i] * p[i : i + img.shape[0]] for i in range(size))
    return sum(k[i] * p[:, i : i + img.shape[1]] for i in range(size))


def adaptive_threshold(img: np.ndarray, block: int = 25, c: float = 10) -> np.ndarray:
    """Paper where a pixel is lighter than its weighted surroundings less ``c``, else ink."""
    return np.where(img > gauss(img, block) - c, 255, 0).astype(np.uint8)


def ellipse(size: int) -> np.ndarray:
    r = (size - 1) / 2
    y, x = np.mgrid[:size, :size] - r
    return (x * x + y * y <= (r + 0.25) ** 2) if size > 2 else np.ones((size, size), bool)


def _shifted(mask: np.ndarray, kernel: np.ndarray, fill: bool) -> Iterator[np.ndarray]:
    k = kernel.shape[0]
    p = np.pad(mask, (k // 2, k - 1 - k // 2), constant_values=fill)
    for dy, dx in np.argwhere(kernel):
        yield p[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]


def dilate(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce(list(_shifted(mask, kernel[::-1, ::-1], False)))


def erode(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce(list(_shifted(mask, kernel, True)))


def clean_mask(mask: np.ndarray) -> np.ndarray:
    """Opening by a small disc, then closing by a smaller square."""
    opened = dilate(erode(mask, ellipse(3)), ellipse(3))
    return erode(dilate(opened, ellipse(2)), ellipse(2))


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of 8-connected components, 0 for the ground; labels follow the first pixel row by row."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    big = h * w + 1
    while True:
        p = np.pad(np.where(label > 0, label, big), 1, constant_values=big)
        near = np.minimum.reduce([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])
        after = np.where(mask, near, 0)
        flat = np.concatenate([[0], after.ravel()])  # a label names a pixel: jump to that pixel's label
        while not (flat[flat] == flat).all():
            flat = flat[flat]
        after = flat[1:].reshape(h, w)
        if (after == label).all():
            break
        label = after
    _, dense = np.unique(label, return_inverse=True)
    dense = dense.reshape(h, w)
    return dense if (label == 0).any() else dense + 1


def without_small(mask: np.ndarray, least: int = 8) -> np.ndarray:
    label = components(mask)
    size = np.bincount(label.ravel())
    size[0] = 0
    return size[label] >= least


def hull_area(x: np.ndarray, y: np.ndarray) -> float:
    """Area of the convex hull of pixels' centres; only the ends of each row can be corners."""
    rows, row = np.unique(y, return_inverse=True)
    low, high = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), np.iinfo(np.int64).min)
    np.minimum.at(low, row, x)
    np.maximum.at(high, row, x)
    p = np.unique(np.c_[np.r_[low, high], np.r_[rows, rows]], axis=0)

    def chain(points):
        out: list = []
        for q in points.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    if len(p) < 3:
        return 0.0
    hull = np.array(chain(p) + chain(p[::-1]), float)
    u, v = hull[:, 0], hull[:, 1]
    return abs(float(u @ np.roll(v, -1) - v @ np.roll(u, -1))) / 2


def simplify(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Douglas-Peucker on an open line of points."""
    keep, stack = np.zeros(len(points), bool), [(0, len(points) - 1)]
    keep[[0, -1]] = True
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, q, mid = points[a].astype(float), points[b].astype(float), points[a + 1 : b].astype(float)
        d = q - p
        length = float(np.hypot(*d))
        off = np.abs(d[0] * (mid[:, 1] - p[1]) - d[1] * (mid[:, 0] - p[0])) / length if length else np.hypot(*(mid - p).T)
        k = int(np.argmax(off))
        if off[k] > epsilon:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def outline(mask: np.ndarray) -> np.ndarray:
    """Boundary pixels (x, y) of a mask's first component, clockwise, by following its border."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return np.zeros((0, 2), int)
    p = np.pad(mask, 1)
    start = (ys[0] + 1, xs[0] + 1)
    steps = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    out, at, came, first = [start], start, 6, None
    for _ in range(4 * mask.size + 8):
        for k in range(8):
            d = (came + k) % 8
            to = (at[0] + steps[d][0], at[1] + steps[d][1])
            if p[to]:
                break
        else:
            break
        if at == start and first == d:
            out.pop()
            break
        first = d if first is None else first
        out.append(to)
        at, came = to, (d + 5) % 8 if d % 2 else (d + 6) % 8
    return np.array([(x - 1, y - 1) for y, x in out])


def mask_polygon(mask: np.ndarray, share: float = 0.005, least_area: int = 50) -> list[tuple[int, int]] | None:
    """A mask's outline simplified by a share of its length; None if too small or with fewer than three corners."""
    if int(mask.sum()) < least_area:
        return None
    line = outline(mask)
    closed = np.vstack([line, line[:1]]).astype(float)
    length = float(np.hypot(*np.diff(closed, axis=0).T).sum())
    got = simplify(closed, share * length)[:-1].astype(int)
    return [tuple(p) for p in got.tolist()] if len(got) >= 3 else None


def fill_polygon(height: int, width: int, polygon: list[tuple[float, float]]) -> np.ndarray:
    """Mask of the pixels whose centres lie in a polygon or on its boundary."""
    p = np.array(polygon, float)
    y, x = np.mgrid[:height, :width].astype(float)
    inside, on = np.zeros((height, width), bool), np.zeros((height, width), bool)
    for (x1, y1), (x2, y2) in zip(p, np.roll(p, -1, axis=0), strict=True):
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        on |= (cross == 0) & (np.minimum(x1, x2) <= x) & (x <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= y) & (y <= np.maximum(y1, y2))
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside | on


def laplacian_variance(img: np.ndarray) -> float:
    p = np.pad(img.astype(float), 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def feather_mask(h: int, w: int, ramp: int = 80) -> np.ndarray:
    """Weights that rise linearly over ``ramp`` pixels from each border; a root of a bell where a side is too short."""
    def one(n):
        if ramp <= 0:
            return np.ones(n)
        if n <= 2 * ramp:
            return np.sqrt(np.hanning(n))
        up = np.linspace(0, 1, ramp)
        return np.r_[up, np.ones(n - 2 * ramp), up[::-1]]

    return np.outer(one(h), one(w))


def seam_alpha(h: int, w: int, edges: list[str], ramp: int = OVERLAP_PX) -> np.ndarray:
    """Weights that rise over ``ramp`` pixels from each contact side."""
    up = np.linspace(0, 1, ramp)
    y, x = np.ones(h), np.ones(w)
    for e in edges:
        line = y if e in ("top", "bottom") else x
        n = min(ramp, len(line))
        if e in ("top", "left"):
            line[:n] *= up[:n]
        else:
            line[-n:] *= up[::-1][-n:]
    return np.outer(y, x)


def blueprint_mask(img: np.ndarray) -> np.ndarray:
    """Pixels of blue ink in a colour image (blue, green, red): hue of 180 to 320 degrees with some saturation and brightness, spread by a small disc."""
    b, g, r = (img[..., k].astype(float) for k in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = np.maximum(top - low, 1e-9)
    hue = np.where(top == r, (g - b) / span, np.where(top == g, 2 + (b - r) / span, 4 + (r - g) / span)) * 60 % 360
    saturation = np.where(top > 0, 255 * (top - low) / np.maximum(top, 1e-9), 0)
    return dilate((hue >= 180) & (hue <= 320) & (saturation >= 20) & (top >= 20), ellipse(5))


def bilateral(img: np.ndarray, spread: float = 40.0, size: int = 5) -> np.ndarray:
    """Bilateral smoothing: near pixels of like value are averaged."""
    p, a = np.pad(img.astype(float), size // 2, mode="reflect"), img.astype(float)
    total, weight = np.zeros_like(a), np.zeros_like(a)
    for dy in range(size):
        for dx in range(size):
            b = p[dy : dy + a.shape[0], dx : dx + a.shape[1]]
            w = np.exp(-((dy - size // 2) ** 2 + (dx - size // 2) ** 2) / (2 * spread**2) - (b - a) ** 2 / (2 * spread**2))
            total, weight = total + w * b, weight + w
    return np.clip(np.rint(total / weight), 0, 255).astype(np.uint8)


def equalize_tiles(img: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited equalisation: clipped histograms of a grid of tiles, blended between their centres."""
    h, w = img.shape
    ys, xs = np.linspace(0, h, grid + 1).astype(int), np.linspace(0, w, grid + 1).astype(int)
    tables = np.empty((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            part = img[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            n = np.bincount(part.ravel(), minlength=256).astype(float)
            top = max(1.0, clip * part.size / 256)
            over = np.clip(n - top, 0, None).sum()
            tables[i, j] = 255 * np.cumsum(np.minimum(n, top) + over / 256) / max(part.size, 1)
    cy, cx = (ys[:-1] + ys[1:]) / 2, (xs[:-1] + xs[1:]) / 2
    fy, fx = np.interp(np.arange(h), cy, np.arange(grid)), np.interp(np.arange(w), cx, np.arange(grid))
    i, j = np.minimum(fy.astype(int), max(grid - 2, 0)), np.minimum(fx.astype(int), max(grid - 2, 0))
    a, b = (fy - i)[:, None], (fx - j)[None, :]
    at = lambda di, dj: tables[np.minimum(i + di, grid - 1)[:, None], np.minimum(j + dj, grid - 1)[None, :], img]
    out = at(0, 0) * (1 - a) * (1 - b) + at(0, 1) * (1 - a) * b + at(1, 0) * a * (1 - b) + at(1, 1) * a * b
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def gradient_edges(img: np.ndarray, low: float = 30, high: float = 90) -> np.ndarray:
    """Edge pixels: thinned gradient maxima above ``low`` that connect to one above ``high``."""
    p = np.pad(img.astype(float), 1, mode="reflect")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    g = np.hypot(gx, gy)
    q = np.pad(g, 1)
    h, w = g.shape
    sector = np.rint(np.degrees(np.arctan2(gy, gx)) % 180 / 45).astype(int) % 4
    best = np.zeros_like(g, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        best |= (sector == k) & (g >= q[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]) & (g > q[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w])
    label = components(best & (g > low))
    strong = np.zeros(label.max() + 1, bool)
    strong[np.unique(label[best & (g > high)])] = True
    strong[0] = False
    return strong[label]


def line_segments(mask: np.ndarray, angles: int = 180, votes: int = 80, gap: int = 10, least: int = 40) -> list[tuple[int, int, int, int]]:
    """Straight segments of a mask by a deterministic accumulator: strongest line first, its runs taken and their pixels removed."""
    left, out = mask.copy(), []
    theta = np.arange(angles) * np.pi / angles
    c, s, size = np.cos(theta), np.sin(theta), int(np.hypot(*mask.shape)) + 1
    ys, xs = np.nonzero(left)
    acc = np.zeros((angles, 2 * size + 1), int)
    for k in range(angles):
        acc[k] = np.bincount(np.rint(xs * c[k] + ys * s[k]).astype(int) + size, minlength=2 * size + 1)
    while acc.size and acc.max() >= votes:
        k, r = np.unravel_index(int(np.argmax(acc)), acc.shape)
        ys, xs = np.nonzero(left)
        near = np.abs(xs * c[k] + ys * s[k] - (r - size)) <= 1
        x, y = xs[near], ys[near]
        along = -x * s[k] + y * c[k]
        order = np.argsort(along, kind="stable")
        x, y, along = x[order], y[order], along[order]
        for run in np.split(np.arange(len(x)), np.flatnonzero(np.diff(along) > gap) + 1):
            if len(run) and along[run[-1]] - along[run[0]] >= least:
                out.append((int(x[run[0]]), int(y[run[0]]), int(x[run[-1]]), int(y[run[-1]])))
        for j in range(angles):
            np.subtract.at(acc[j], np.rint(x * c[j] + y * s[j]).astype(int) + size, 1)
        left[y, x] = False
        acc[k, r] = 0
    return out


# operators over rows of images


def map_images(images: DataFrame, kernel, schema: str) -> DataFrame:
    """Run ``kernel(map_num, array)``, which gives rows (tuples), over images; one image at a time is an array."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                rows = list(kernel(r.map_num, to_array(r.height, r.width, r.n_channels, r.data)))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return images.select("map_num", "height", "width", "n_channels", "data").mapInPandas(run, schema)


def as_row(map_num: str, img: np.ndarray) -> tuple:
    img = np.ascontiguousarray(img)
    return map_num, img.shape[0], img.shape[1], 1 if img.ndim == 2 else img.shape[2], img.tobytes()


def transformed(images: DataFrame, kernel) -> DataFrame:
    """Images under a kernel from array to array."""
    return map_images(images, lambda m, a: [as_row(m, kernel(a))], IMAGE_SCHEMA)


def pixels(images: DataFrame) -> DataFrame:
    """One row a pixel: map_num, y, x, v. Images come row by row from the kernel and are taken apart by Spark."""
    rows = map_images(images, lambda m, a: ((m, y, a[y].tolist()) for y in range(a.shape[0])), "map_num string, y int, line array<int>")
    return rows.select("map_num", "y", F.posexplode("line").alias("x", "v"))


def image_metrics(images: DataFrame) -> DataFrame:
    """Sharpness (variance of the Laplacian) and contrast (population deviation) of each image."""
    return map_images(images, lambda m, a: [(m, laplacian_variance(gray(a)), float(gray(a).std()))], "map_num string, sharpness double, contrast double")


def parcels_of(images: DataFrame, ink_below: int = 128, least: int = 500, most_share: float = 0.85) -> DataFrame:
    """Parcels as components of paper between the lines: map_num, id, area_px, m00, cx, cy, bbox fields, hull_area, polygon corners."""
    def find(m, a):
        label = components(gray(a) >= ink_below).ravel()
        size = np.bincount(label)
        order, stops = np.argsort(label, kind="stable"), np.cumsum(size)
        for k in range(1, len(size)):
            if least <= size[k] <= most_share * a.shape[0] * a.shape[1]:
                ys, xs = np.divmod(order[stops[k] - size[k] : stops[k]], a.shape[1])
                y0, x0 = ys.min(), xs.min()
                mask = np.zeros((int(np.ptp(ys)) + 1, int(np.ptp(xs)) + 1), bool)
                mask[ys - y0, xs - x0] = True
                polygon = [{"x": int(x + x0), "y": int(y + y0)} for x, y in mask_polygon(mask) or []]
                yield m, k, float(size[k]), float(xs.mean()), float(ys.mean()), int(x0), int(y0), mask.shape[1], mask.shape[0], hull_area(xs, ys), polygon

    return map_images(images, find, "map_num string, id int, area_px double, cx double, cy double, bbox_x int, bbox_y int, bbox_w int, bbox_h int, hull_area double, polygon array<struct<x:int,y:int>>")


def recognition_crops(images: DataFrame, parcels: DataFrame) -> DataFrame:
    """map_num, parcel_id, height, width, data of every parcel's crop for recognisers, null where its box is outside the sheet.

    ``parcels``: map_num, parcel_id, bbox. A sheet comes with its boxes and is decoded once.
    """
    boxes = parcels.groupBy("map_num").agg(F.sort_array(F.collect_list(F.struct("parcel_id", "bbox"))).alias("boxes"))
    met = images.join(boxes, "map_num").select("map_num", "height", "width", "n_channels", "data", "boxes")
    names = ["map_num", "parcel_id", "height", "width", "data"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                sheet = gray(to_array(r.height, r.width, r.n_channels, r.data))
                for p in r.boxes:
                    crop = recognition_crop(sheet, *(p["bbox"][c] for c in "xywh"))
                    yield pd.DataFrame([(r.map_num, p["parcel_id"], *((0, 0, None) if crop is None else (*crop.shape, crop.tobytes())))], columns=names)

    return met.mapInPandas(run, "map_num string, parcel_id long, height int, width int, data binary")


def blend_tiles(images: DataFrame, transforms: DataFrame, tile: int = 512, ramp: int = 80, scale: float = 1.0, x_min: float = 0.0, y_min: float = 0.0) -> DataFrame:
    """Sheets warped into one canvas and blended by feathered weights, tile by tile: component, ty, tx, data (tile x tile bytes, paper where nothing lies).

    ``transforms``: component, map_num, h from sheet to canvas. A sheet is warped once for each tile it touches, and what is shuffled are
    those tiles' sums, value times weight and weight; a tile is one group however many sheets meet there.
    """
    from ..operators.fitting import apply

    def warp(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        move = np.array([[scale, 0, -x_min * scale], [0, scale, -y_min * scale], [0, 0, 1]])
        for b in batches:
            for r in b.itertuples(index=False):
                a = gray(to_array(r.height, r.width, r.n_channels, r.data)).astype(float)
                weight, t = feather_mask(*a.shape, ramp), move @ np.array(r.h, float).reshape(3, 3)
                corners = apply(t, np.array([[0, 0], [a.shape[1], 0], [a.shape[1], a.shape[0]], [0, a.shape[0]]], float))
                back = np.linalg.inv(t)
                lo, hi = np.floor(corners.min(axis=0) / tile).astype(int), np.floor(corners.max(axis=0) / tile).astype(int)
                for ty in range(max(0, lo[1]), hi[1] + 1):
                    for tx in range(max(0, lo[0]), hi[0] + 1):
                        y, x = np.mgrid[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]
                        p = apply(back, np.c_[x.ravel(), y.ravel()].astype(float))
                        w = sample(weight, p[:, 0], p[:, 1], 0.0)
                        if (w > 0).any():
                            v = sample(a, p[:, 0], p[:, 1], 0.0) * w
                            yield pd.DataFrame({"component": [r.component], "ty": [ty], "tx": [tx], "vw": [v.astype(np.float32).tobytes()], "w": [w.astype(np.float32).tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        vw, w = (np.sum([np.frombuffer(x, np.float32).astype(float) for x in pdf[c]], axis=0) for c in ("vw", "w"))
        v = np.where(w > 1e-3, vw / np.maximum(w, 1e-9), 255)
        return pd.DataFrame({"component": pdf["component"].iloc[:1], "ty": pdf["ty"].iloc[:1], "tx": pdf["tx"].iloc[:1], "data": [np.clip(v, 0, 255).astype(np.uint8).tobytes()]})

    met = images.join(transforms.select("component", "map_num", "h"), "map_num")
    parts = met.select("component", "height", "width", "n_channels", "data", "h").mapInPandas(warp, "component string, ty int, tx int, vw binary, w binary")
    return parts.groupBy("component", "ty", "tx").applyInPandas(merge, "component string, ty int, tx int, data binary")


# training crops


def augment(img: np.ndarray, seed: int) -> np.ndarray:
    """A seeded mix of ageing effects on a gray crop; at least noise. Effects that move ink are left to :func:`flip_with_labels`."""
    rng, a = np.random.default_rng(seed), img.astype(float)
    h, w = img.shape
    y, x = np.mgrid[:h, :w].astype(float)
    blob = lambda: np.clip(1 - np.hypot(x - rng.uniform(0, w), y - rng.uniform(0, h)) / rng.uniform(min(h, w) / 8, min(h, w) / 2), 0, 1)

    def fade(a):
        m = np.clip(1 + sum(rng.uniform(0.05, 0.35) * blob() for _ in range(rng.integers(3, 9))), 1, 1.5)
        return 255 - (255 - a) / m

    def fold(a):
        for _ in range(rng.integers(1, 4)):
            a = a - 40 * np.exp(-((x - rng.uniform(0, w)) ** 2 if rng.random() < 0.5 else (y - rng.uniform(0, h)) ** 2) / (2 * rng.uniform(0.7, 2.0) ** 2))
        return a

    effects = [
        (0.60, fade), (0.50, lambda a: a - rng.uniform(5, 30) * gauss(rng.random((h, w)), 31)), (0.40, fold), (0.70, lambda a: a + rng.normal(0, rng.uniform(2, 12), (h, w))),
        (0.35, lambda a: a * (1 - rng.uniform(0.1, 0.4) * np.hypot((x - w / 2) / w, (y - h / 2) / h) ** 2 * 2)), (0.40, lambda a: np.where(blob() > 0.3, gauss(a, 5), a)),
        (0.65, lambda a: (a - 128) * rng.uniform(0.7, 1.3) + 128 + rng.uniform(-15, 15)), (0.25, lambda a: a - rng.uniform(10, 40) * blob()),
    ]
    used = 0
    for chance, effect in effects:
        if rng.random() < chance:
            a, used = effect(a), used + 1
    if not used:
        a = a + rng.normal(0, 5, (h, w))
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def flip_with_labels(img: np.ndarray, polygons: list[list[tuple[int, int]]]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """A mirrored crop and its labels mirrored with it."""
    w = img.shape[1]
    return img[:, ::-1], [[(w - 1 - x, y) for x, y in p] for p in polygons]


def training_crops(images: DataFrame, parcels: DataFrame, per_sheet: int, size: int = 512, least: int = 2, attempts: int = 20, seed: int = 7, mirror: float = 0.45) -> DataFrame:
    """Seeded crops with at least ``least`` whole parcels, augmented: map_num, crop, y, x, n_parcels, data, polygons. A crop that finds no place in ``attempts`` is skipped.

    ``parcels``: map_num, polygon. Crops of a sheet are one group, their seeds come from the sheet and the crop's number.
    """
    labels = parcels.groupBy("map_num").agg(F.array_sort(F.collect_list("polygon")).alias("polygons"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                a = gray(to_array(r.height, r.width, r.n_channels, r.data))
                shapes = [[(p["x"], p["y"]) for p in poly] for poly in (r.polygons if r.polygons is not None else [])]
                for k in range(per_sheet):
                    own = sum(map(ord, r.map_num)) * 1_000_003 + k + seed
                    rng = np.random.default_rng(own)
                    for _ in range(attempts):
                        y, x = (int(rng.integers(0, max(1, n - size + 1))) for n in a.shape)
                        inside = [[(u - x, v - y) for u, v in s] for s in shapes if all(0 <= u - x < size and 0 <= v - y < size for u, v in s)]
                        if len(inside) >= least:
                            crop = augment(a[y : y + size, x : x + size], own)
                            if rng.random() < mirror:
                                crop, inside = flip_with_labels(crop, inside)
                            yield pd.DataFrame({"map_num": [r.map_num], "crop": [k], "y": [y], "x": [x], "n_parcels": [len(inside)], "data": [np.ascontiguousarray(crop).tobytes()], "polygons": [[[{"x": u, "y": v} for u, v in s] for s in inside]]})
                            break

    met = images.join(labels, "map_num", "left").select("map_num", "height", "width", "n_channels", "data", "polygons")
    return met.mapInPandas(make, "map_num string, crop int, y int, x int, n_parcels int, data binary, polygons array<array<struct<x:int,y:int>>>")


# whole-sheet preparation


def warp(img: np.ndarray, h: np.ndarray, height: int, width: int, paper: int = 255) -> np.ndarray:
    """An image under a transform from its points to the canvas."""
    from .fitting import apply

    y, x = np.mgrid[:height, :width]
    p = apply(np.linalg.inv(h), np.c_[x.ravel(), y.ravel()].astype(float))
    return np.clip(np.rint(sample(img, p[:, 0], p[:, 1], paper)), 0, 255).astype(np.uint8).reshape(height, width)


def detect_skew(img: np.ndarray) -> float:
    """Median angle, within 45 degrees of level, of the straight segments along edges; upright ones are left out, 0 without any."""
    angles = []
    for x1, y1, x2, y2 in line_segments(gradient_edges(img, 50, 150), votes=max(30, min(img.shape) // 6), least=max(20, min(img.shape) // 8)):
        if x1 != x2:
            a = math.degrees(math.atan2(y2 - y1, x2 - x1))
            a = a - 180 if a > 90 else a + 180 if a < -90 else a
            angles.append(a - 90 if a > 45 else a + 90 if a < -45 else a)
    return float(np.median(angles)) if angles else 0.0


def correct_skew(img: np.ndarray, least: float = 0.5, most: float = 10.0) -> np.ndarray:
    """The image turned level, if its skew is neither too small to matter nor too large to be one."""
    angle = detect_skew(img)
    return rotate(img, angle) if least <= abs(angle) <= most else img


def correct_perspective(img: np.ndarray, least: float = 0.30) -> np.ndarray:
    """A sheet's largest outline drawn out to a rectangle, if it is large enough and has four corners."""
    from .fitting import fit_perspective

    label = components(img > otsu(img))
    size = np.bincount(label.ravel())
    size[0] = 0
    if not size.any() or size.max() < least * img.size:
        return img
    corners = mask_polygon(label == size.argmax(), 0.02) or []
    if len(corners) != 4:
        return img
    p = np.array(corners, float)
    s, d = p.sum(axis=1), p[:, 1] - p[:, 0]
    src = p[[s.argmin(), d.argmin(), s.argmax(), d.argmax()]]
    w, h = (int(max(np.hypot(*(src[a] - src[b])), np.hypot(*(src[c] - src[e])))) + 1 for a, b, c, e in ((0, 1, 3, 2), (0, 3, 1, 2)))
    t = fit_perspective(src, np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float))
    return img if t is None else warp(img, t, h, w)


def fill_gaps(img: np.ndarray, written: np.ndarray) -> np.ndarray:
    """Interior pixels that no sheet covers get the median tone of covered ones; gaps open to the border stay."""
    label = components(~written)
    open_ = np.unique(np.r_[label[0], label[-1], label[:, 0], label[:, -1]])
    inner = ~written & ~np.isin(label, open_[open_ > 0])
    out = img.copy()
    if inner.any() and written.any():
        out[inner] = int(np.median(img[written]))
    return out


def separate_ink(img: np.ndarray) -> np.ndarray:
    """A colour sheet with everything but its blue drawing set to paper; a gray one as it is."""
    if img.ndim == 2:
        return img
    out = img.copy()
    out[~blueprint_mask(img)] = 255
    return out
