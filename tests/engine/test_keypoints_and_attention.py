"""Keypoints: places, turns, light; attention: plain loops and the order of nodes."""

from __future__ import annotations

import numpy as np
import pytest

from sheetloom.operators import attention, keypoints


def drawing(seed=0, n=12, side=160):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:side, :side]
    img = np.full((side, side), 230.0)
    for _ in range(n):
        cy, cx, s = rng.uniform(20, side - 20), rng.uniform(20, side - 20), rng.uniform(2, 6)
        img -= rng.uniform(60, 200) * np.exp(-((y - cy) ** 2 + 2 * (x - cx) ** 2) / (2 * s * s))
    return np.clip(np.rint(img), 0, 255).astype(np.uint8)


def matched(a, b):
    """Pairs of keypoints whose descriptors pass the ratio test."""
    da, db = (np.array([k[6] for k in x]) for x in (a, b))
    d = np.sqrt(np.maximum(0, 2 - 2 * da @ db.T))
    order = np.argsort(d, axis=1)
    return [(a[i], b[order[i, 0]]) for i in range(len(a)) if d[i, order[i, 0]] < 0.75 * d[i, order[i, 1]]]


def test_blobs_and_blank():
    assert keypoints.keypoints(np.full((64, 64), 200, np.uint8)) == []
    img = drawing()
    found = keypoints.keypoints(img)
    assert len(found) > 8 and all(abs(np.linalg.norm(k[6]) - 1) < 1e-6 and k[6].shape == (128,) for k in found)
    assert [k[4] for k in found] == sorted((k[4] for k in found), reverse=True)
    mask = np.zeros(img.shape, bool)
    mask[:, :80] = True
    assert all(k[0] < 81 for k in keypoints.keypoints(img, mask=mask)) and len(keypoints.keypoints(img, 3)) == 3


@pytest.mark.parametrize("seed", range(3))
def test_descriptors_follow_turns_shifts_and_light(seed):
    img = drawing(seed)
    own, n = keypoints.keypoints(img), img.shape[0]
    turned = matched(own, keypoints.keypoints(np.rot90(img).copy()))
    good = [abs(q[0] - p[1]) < 2 and abs(q[1] - (n - 1 - p[0])) < 2 for p, q in turned]
    assert len(good) >= 5 and np.mean(good) >= 0.9
    moved = matched(own, keypoints.keypoints(np.pad(img, ((8, 0), (16, 0)), mode="edge")[:n, :n]))
    good = [abs(q[0] - p[0] - 16) < 2 and abs(q[1] - p[1] - 8) < 2 for p, q in moved]
    assert len(good) >= 5 and np.mean(good) >= 0.9
    dim = matched(own, keypoints.keypoints((img * 0.7 + 20).astype(np.uint8)))
    assert len(dim) >= 5 and np.mean([abs(q[0] - p[0]) < 1.5 and abs(q[1] - p[1]) < 1.5 for p, q in dim]) >= 0.9


def plain_graph_attention(x, edges, w, k):
    heads, width = w[f"g{k}_from"].shape
    h, out = (x @ w[f"g{k}"]).reshape(len(x), heads, width), np.zeros((len(x), heads, width))
    for i in range(len(x)):
        near = [a for a, b in edges if b == i] + [i]
        for t in range(heads):
            e = [h[j, t] @ w[f"g{k}_from"][t] + h[i, t] @ w[f"g{k}_to"][t] for j in near]
            e = np.exp([v if v > 0 else 0.2 * v for v in e])
            out[i, t] = sum(p * h[j, t] for p, j in zip(e / e.sum(), near, strict=True))
    return out.reshape(len(x), -1) + w[f"g{k}_bias"]


def test_attention_against_loops_and_orders():
    rng = np.random.default_rng(1)
    w = attention.initial_weights(5, 8, 2, 2, seed=3)
    x, y = rng.random((6, 5)), rng.random((4, 5))
    edges = [(0, 1), (1, 0), (2, 3), (3, 2), (4, 1), (1, 4)]
    src, dst = np.array(edges).T
    h = x @ w["in1"]
    assert np.allclose(attention.graph_attention(h, src, dst, w, 0), plain_graph_attention(h, edges, w, 0))
    none = np.zeros(0, np.int64)
    g = y @ w["in1"]
    q, k, v = h @ w["c0_query"], g @ w["c0_key"], g @ w["c0_value"]
    want = []
    for i in range(6):
        parts = []
        for t in (slice(0, 4), slice(4, 8)):
            e = np.exp([q[i, t] @ k[j, t] / 2 for j in range(4)])
            parts.append(sum(p * v[j, t] for j, p in enumerate(e / e.sum())))
        want.append(np.concatenate(parts) @ w["c0_join"])
    assert np.allclose(attention.cross_attention(h, g, w, 0), want)
    scores = attention.pair_scores((x, src, dst), (y, none, none), w)
    order = rng.permutation(6)
    back = np.argsort(order)
    moved = attention.pair_scores((x[order], back[src], back[dst]), (y, none, none), w)
    assert scores.shape == (6, 4) and np.allclose(moved, scores[order]) and np.abs(scores).max() <= 10 + 1e-9
