"""Attentional matching of two sheets' graphs: node features are enriched by attention within each graph and across the two, then scored.

Inference only: the weights are a parameter, a dictionary of arrays as :func:`initial_weights` makes it, trained elsewhere or by the
caller. Graph attention is that of Velickovic et al. (2018), attention across graphs that of Vaswani et al. (2017).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOPE, EPSILON = 0.2, 1e-5


def initial_weights(n_features: int, hidden: int = 64, layers: int = 3, heads: int = 4, seed: int = 0) -> dict[str, np.ndarray]:
    """Random weights of the right shapes: in1, in2 (features to hidden), and for each layer k the graph (g), cross (c) and norm (s, t) parts; out."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    made = {"in1": draw(n_features, hidden), "in1_bias": np.zeros(hidden), "in2": draw(hidden, hidden), "in2_bias": np.zeros(hidden), "out": draw(hidden, hidden), "out_bias": np.zeros(hidden)}
    for k in range(layers):
        made |= {f"g{k}": draw(hidden, hidden), f"g{k}_from": draw(hidden // heads, heads).T, f"g{k}_to": draw(hidden // heads, heads).T, f"g{k}_bias": np.zeros(hidden)}
        made |= {f"c{k}_{n}": draw(hidden, hidden) for n in ("query", "key", "value", "join")} | {f"c{k}_{n}_bias": np.zeros(hidden) for n in ("query", "key", "value", "join")}
        made |= {f"{n}{k}_scale": np.ones(hidden) for n in "st"} | {f"{n}{k}_shift": np.zeros(hidden) for n in "st"}
    return made


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def normalised(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + EPSILON) * scale + shift


def graph_attention(x: np.ndarray, src: np.ndarray, dst: np.ndarray, weights: dict[str, np.ndarray], k: int) -> np.ndarray:
    """Each node's mix of its neighbours (edges lead from ``src`` to ``dst``) and itself, by heads, over the edges only."""
    heads, width = weights[f"g{k}_from"].shape
    n, own = len(x), np.arange(len(x))
    src, dst = np.concatenate([src, own]), np.concatenate([dst, own])
    h = (x @ weights[f"g{k}"]).reshape(n, heads, width)
    e = (h * weights[f"g{k}_from"]).sum(axis=2)[src] + (h * weights[f"g{k}_to"]).sum(axis=2)[dst]
    e = np.where(e > 0, e, SLOPE * e)
    top = np.full((n, heads), -np.inf)
    np.maximum.at(top, dst, e)
    share, total, out = np.exp(e - top[dst]), np.zeros((n, heads)), np.zeros((n, heads, width))
    np.add.at(total, dst, share)
    np.add.at(out, dst, (share / total[dst])[:, :, None] * h[src])
    return out.reshape(n, -1) + weights[f"g{k}_bias"]


def cross_attention(x: np.ndarray, other: np.ndarray, weights: dict[str, np.ndarray], k: int) -> np.ndarray:
    """What each node of one graph gathers from all nodes of the other, by heads."""
    heads = len(weights[f"g{k}_from"])
    part = lambda v, n: (v @ weights[f"c{k}_{n}"] + weights[f"c{k}_{n}_bias"]).reshape(len(v), heads, -1).transpose(1, 0, 2)
    q, key, value = part(x, "query"), part(other, "key"), part(other, "value")
    mixed = _softmax(q @ key.transpose(0, 2, 1) / np.sqrt(q.shape[2]), 2) @ value
    return mixed.transpose(1, 0, 2).reshape(len(x), -1) @ weights[f"c{k}_join"] + weights[f"c{k}_join_bias"]


def pair_scores(a: tuple, b: tuple, weights: dict[str, np.ndarray], temperature: float = 0.1) -> np.ndarray:
    """Scores of all nodes of two graphs (features, src, dst): dot products of their enriched unit vectors by ``temperature``."""
    x = [np.maximum(f @ weights["in1"] + weights["in1_bias"], 0) @ weights["in2"] + weights["in2_bias"] for f, _, _ in (a, b)]
    for k in range(sum(n.endswith("_from") for n in weights)):
        near = [graph_attention(v, src, dst, weights, k) for v, (_, src, dst) in zip(x, (a, b), strict=True)]
        x = [normalised(v + np.maximum(m, 0), weights[f"s{k}_scale"], weights[f"s{k}_shift"]) for v, m in zip(x, near, strict=True)]
        across = [cross_attention(x[0], x[1], weights, k), cross_attention(x[1], x[0], weights, k)]
        x = [normalised(v + m, weights[f"t{k}_scale"], weights[f"t{k}_shift"]) for v, m in zip(x, across, strict=True)]
    x = [v @ weights["out"] + weights["out_bias"] for v in x]
    u, v = (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12) for y in x)
    return u @ v.T / temperature


def attentional_scores(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, weights: dict[str, np.ndarray], temperature: float = 0.1) -> DataFrame:
    """pair, a, b, score for all nodes of each pair of sheets, as ``matching.soft_match`` takes them.

    ``nodes``: map_num, id, x (feature vector); ``edges``: map_num, src, dst in both directions, as ``graph.tensor_graph`` gives them;
    ``pairs``: map_a, map_b. A row is one pair of sheets; sheets without nodes give none.
    """
    graphs = nodes.groupBy("map_num").agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias("nodes"))
    links = edges.groupBy("map_num").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    whole = graphs.join(links, "map_num", "left")
    side = lambda s: whole.select(F.col("map_num").alias(f"map_{s}"), F.col("nodes").alias(f"nodes_{s}"), F.col("edges").alias(f"edges_{s}"))
    met = pairs.select("map_a", "map_b").join(side("a"), "map_a").join(side("b"), "map_b")

    def graph_of(nodes, edges):
        ids = np.array([n["id"] for n in nodes], np.int64)
        ends = np.array([[e["src"], e["dst"]] for e in (edges if edges is not None else ())], np.int64).reshape(-1, 2)
        ends = ends[np.isin(ends, ids).all(axis=1)]
        return ids, (np.array([n["x"] for n in nodes], float), *np.searchsorted(ids, ends.T))

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                (ids_a, a), (ids_b, b) = graph_of(r.nodes_a, r.edges_a), graph_of(r.nodes_b, r.edges_b)
                scores = pair_scores(a, b, weights, temperature)
                step = max(1, (1 << 18) // len(ids_b))
                for i in range(0, len(ids_a), step):
                    part = ids_a[i : i + step]
                    yield pd.DataFrame({"pair": f"{r.map_a}_{r.map_b}", "a": np.repeat(part, len(ids_b)), "b": np.tile(ids_b, len(part)), "score": scores[i : i + step].ravel()})

    return met.mapInPandas(run, "pair string, a long, b long, score double")
