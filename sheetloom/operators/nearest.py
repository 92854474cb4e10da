"""Approximate nearest neighbours of descriptors by a forest of randomised k-d trees, spread over tasks.

A tree of each set of train descriptors is fitted on a bounded sample: a node splits at the median of an axis drawn from those that vary most. Every train
row goes to one leaf of each tree, every query to the leaves that lie nearest to it; they meet leaf by leaf, in blocks of bounded size, where
distances are exact. So a query meets some leaves a tree instead of all train rows. How many leaves is settled by measuring: a sample of queries is
compared with the exact join until the asked share of their nearest neighbours is found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import broadcast_if_small, materialize, spread_if_large
from . import joins

TREES, LEAF = 4, 64
SAMPLE = 1 << 16  # train rows, about, that the trees of a set are fitted on
CHUNK = 4096  # rows that a task takes down the trees at a time
BLOCK = 2048  # rows of a leaf, of either side, that meet at once
TOP_AXES, PER_LEAF = 5, 8
COPY = 48  # comparisons that cost about as much as to send a query to one leaf more


def fit_tree(x: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, cut) of the nodes of a full binary tree in order of levels; node k has the children 2k+1 and 2k+2."""
    rng, axes, cuts = np.random.default_rng(seed), np.zeros((1 << depth) - 1, np.int32), np.zeros((1 << depth) - 1)
    own = [np.arange(len(x))]
    for node in range(len(axes)):
        rows = own[node]
        if len(rows):
            spread = x[rows].var(axis=0)
            axis = int(rng.choice(np.argsort(-spread, kind="stable")[:TOP_AXES]))
            axes[node], cuts[node] = axis, np.median(x[rows, axis])
        above = x[rows, axes[node]] > cuts[node]
        own += [rows[~above], rows[above]]
        own[node] = None
    return axes, cuts


def leaves_of(x: np.ndarray, axis: np.ndarray, cut: np.ndarray, probes: int = 1) -> np.ndarray:
    """The leaf of every row of ``x``, and the next nearest ones up to ``probes``: at each level the nodes with the least sum of squared distances to the cuts go on."""
    depth = (len(axis) + 1).bit_length() - 1
    nodes, cost, each = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1)), np.arange(len(x))[:, None]
    for _ in range(depth):
        gap = x[each, axis[nodes]] - cut[nodes]
        near = 2 * nodes + 1 + (gap > 0)
        nodes = np.concatenate([near, 4 * nodes + 3 - near], axis=1)  # the two children add up to 4 * node + 3
        cost = np.concatenate([cost, cost + gap * gap], axis=1)
        if nodes.shape[1] > probes:
            best = np.argpartition(cost, probes - 1, axis=1)[:, :probes] if probes > 1 else np.argmin(cost, axis=1)[:, None]
            nodes, cost = np.take_along_axis(nodes, best, 1), np.take_along_axis(cost, best, 1)
    return nodes - ((1 << depth) - 1)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Descriptors as bytes, so that batches of them are one copy. Rows without a descriptor are left out."""

    def pack(batches):
        for b in batches:
            yield b.assign(x=[np.asarray(d, "<f8").tobytes() for d in b["descriptor"]])[[*keys, "id", "x"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    named = rows.select(*keys, F.col("kp_id").cast("long").alias("id"), F.transform("descriptor", lambda v: v.cast("double")).alias("descriptor"))
    return named.where("id is not null and descriptor is not null").mapInPandas(pack, f"{kinds}, id long, x binary")


@dataclass
class Forest:
    """The trees of some sets of descriptors and where their rows stand: keys, tree, axis, cut and keys, tree, leaf, id, x."""

    keys: list[str]
    trees: DataFrame
    placed: DataFrame
    kinds: str

    def place(self, packed: DataFrame, probes: int) -> DataFrame:
        """The leaves of rows (keys, id, x) in every tree of their set; rows of sets without trees are left out."""
        keys, columns = self.keys, [*self.keys, "tree", "leaf", "id", "x"]
        chunks = broadcast_if_small(materialize(packed.groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks")), "chunks"))
        rows = packed.join(chunks, keys).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
        trees = self.trees.join(chunks, keys).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
        named = trees.toDF(*[f"t_{c}" for c in trees.columns])

        def down(pdf: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
            if pdf.empty or forest.empty:
                return pd.DataFrame(columns=columns)
            x, parts = _vectors(pdf["x"]), []
            for tree, axis, cut in zip(forest["t_tree"], forest["t_axis"], forest["t_cut"], strict=True):
                leaf = leaves_of(x, np.asarray(axis, np.int64), np.asarray(cut, float), probes)
                at = np.repeat(np.arange(len(pdf)), leaf.shape[1])
                parts.append(pdf[[*keys, "id", "x"]].iloc[at].assign(tree=tree, leaf=leaf.ravel()))
            return pd.concat(parts)[columns]

        return rows.groupBy(*keys, "chunk").cogroup(named.groupBy(*[f"t_{k}" for k in keys], "t_chunk")).applyInPandas(down, f"{self.kinds}, tree int, leaf long, id long, x binary")


def fit_forest(train: DataFrame, keys: list[str], trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> Forest:
    """A forest over ``train`` (keys, kp_id, descriptor): as many leaves as hold about ``leaf`` rows each, with ``PER_LEAF`` rows of the sample at least."""
    packed = materialize(_packed(train, keys), "descriptors")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields if f.name in keys)
    counts = broadcast_if_small(materialize(packed.groupBy(*keys).agg(F.count("*").alias("rows")), "set-sizes"))
    share = F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 30)) < F.col("rows") ** -1 * float(sample) * (1 << 30)
    taken = packed.join(counts, keys).where(share).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x, n = _vectors(pdf["x"]), int(pdf["rows"].iloc[0])
        depth = max(0, math.ceil(math.log2(max(1, min(n / leaf, len(x) / PER_LEAF)))))
        axis, cut = fit_tree(x, depth, int(pdf["tree"].iloc[0]))
        return pdf[[*keys, "tree"]].iloc[:1].assign(axis=[axis.tolist()], cut=[cut.tolist()])

    fitted = materialize(taken.groupBy(*keys, "tree").applyInPandas(fit, f"{kinds}, tree int, axis array<int>, cut array<double>"), "forest")
    forest = Forest(keys, fitted, packed, kinds)
    forest.placed = materialize(forest.place(packed, 1), "forest-rows")
    return forest


def forest_nearest(queries: DataFrame, forest: Forest, probes: int) -> DataFrame:
    """keys, q_id and n, the two nearest rows (d, t_id) of those in ``probes`` leaves of each tree; equal distances go by id."""
    keys, at = forest.keys, [*forest.keys, "tree", "leaf"]
    asked = materialize(forest.place(_packed(queries, keys), probes), "forest-queries")
    parts = lambda df, name: df.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias(name))
    split = parts(forest.placed, "train_parts").hint("merge").join(parts(asked, "query_parts"), at)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    # a file of vectors that stand in many leaves is a small part of what they take in memory, so its size says nothing about a broadcast
    q = asked.hint("merge").join(split, at).withColumn("q_part", mine("query_parts")).withColumn("t_part", every("train_parts"))
    t = forest.placed.hint("merge").join(split, at).withColumn("t_part", mine("train_parts")).withColumn("q_part", every("query_parts"))
    q = q.select(*at, "q_part", "t_part", "id", "x")
    t = t.select(*[F.col(c).alias(f"t_{c}") for c in at], F.col("q_part").alias("of_q_part"), F.col("t_part").alias("of_t_part"), F.col("id").alias("t_id"), F.col("x").alias("t_x"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, "q_id", "d", "t_id"]
        if a.empty or b.empty:
            return pd.DataFrame(columns=columns)
        b = b.sort_values("t_id", kind="stable")
        x, y, ids = _vectors(a["x"]), _vectors(b["t_x"]), b["t_id"].to_numpy()
        rough = (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)
        k = min(4, len(y))
        few = np.sort(np.argpartition(rough, k - 1, axis=1)[:, :k], axis=1)
        d = np.sqrt(((x[:, None, :] - y[few]) ** 2).sum(2))
        first = np.argsort(d, axis=1, kind="stable")[:, :2]
        d, who = np.take_along_axis(d, first, 1), ids[np.take_along_axis(few, first, 1)]
        row = np.repeat(np.arange(len(a)), d.shape[1])
        return a[keys].iloc[row].assign(q_id=a["id"].to_numpy()[row], d=d.ravel(), t_id=who.ravel())[columns]

    met = q.groupBy(*at, "q_part", "t_part").cogroup(t.groupBy(*[f"t_{c}" for c in at], "of_q_part", "of_t_part")).applyInPandas(meet, f"{forest.kinds}, q_id long, d double, t_id long")
    once = met.groupBy(*keys, "q_id", "t_id").agg(F.min("d").alias("d"))
    return once.groupBy(*keys, "q_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "t_id"))), 1, 2).alias("n"))


def recall(found: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_queries, and the share of the exact nearest two rows of all queries that were found."""
    pairs = lambda df: df.select(*keys, "q_id", F.explode("n").alias("m")).select(*keys, "q_id", F.col("m.t_id").alias("t_id"))
    hit = pairs(exact).join(pairs(found).withColumn("hit", F.lit(1)), [*keys, "q_id", "t_id"], "left")
    return hit.groupBy(*keys).agg(F.countDistinct("q_id").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def tuned_probes(queries: DataFrame, train: DataFrame, forest: Forest, least: float, sample: int = 256) -> int | None:
    """How many leaves of each tree a query must look in, so that ``least`` of the nearest neighbours of about ``sample`` queries a set are found.

    None if that takes so many that the exact join does less: a query is sent to each leaf it looks in, and compared with the rows there.
    """
    keys = forest.keys
    counts = queries.groupBy(*keys).agg(F.count("*").alias("_rows"))
    share = F.pmod(F.xxhash64(F.lit("tune"), "kp_id"), F.lit(1 << 30)) < F.col("_rows") ** -1 * float(sample) * (1 << 30)
    some = materialize(queries.select(*keys, "kp_id", "descriptor").join(counts, keys).where(share).drop("_rows"), "tuning-queries")
    exact = materialize(joins.nearest_two(some, train, keys), "tuning-exact")
    leaves = 1 + (forest.trees.agg(F.max(F.size("axis"))).first()[0] or 0)
    trees = forest.trees.select("tree").distinct().count()
    rows = forest.placed.where("tree = 0").groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    worth = [1 << k for k in range(leaves.bit_length()) if 1 << k < leaves and (k == 0 or trees * (1 << k) * (rows / leaves + COPY) < rows + COPY)]

    def reached(probes: int) -> bool:
        share = recall(forest_nearest(some, forest, probes), exact, keys).agg((F.sum(F.col("recall") * F.col("n_queries")) / F.sum("n_queries")).alias("r")).first().r
        return share is None or share >= least

    # the most that are worth it come first, as no fewer can do where those don't
    if worth and reached(worth[-1]):
        return next((p for p in worth[:-1] if reached(p)), worth[-1])
    return None


def forest_matches(
    queries: DataFrame, train: DataFrame, keys: list[str], ratio: float = 0.75, least_recall: float = 0.95, probes: int | None = None, exact: bool = False, trees: int = TREES, leaf: int = LEAF
) -> DataFrame:
    """Two-nearest-neighbour matches under the ratio test, as :func:`joins.ratio_matches` gives them, by a forest.

    ``probes`` leaves of each tree are looked in, or as many as reach ``least_recall`` on a sample; a query that meets fewer than two rows there looks through all, and
    with ``exact`` all queries do. Ids and descriptors that are null take no part; an empty side has no matches.
    """
    return joins.passing_ratio(nearest_two(queries, train, keys, least_recall, probes, exact, trees, leaf), keys, ratio)


def nearest_two(queries: DataFrame, train: DataFrame, keys: list[str], least_recall: float = 0.95, probes: int | None = None, exact: bool = False, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """keys, q_id and the two nearest rows of every query, as :func:`forest_matches` finds them."""
    known = lambda df: df.where("kp_id is not null and descriptor is not null")
    queries, train = known(queries), known(train)
    if exact:
        return joins.nearest_two(queries, train, keys)
    forest = fit_forest(train, keys, trees, leaf)
    probes = probes or tuned_probes(queries, train, forest, least_recall)
    if probes is None:
        return joins.nearest_two(queries, train, keys)
    found = materialize(forest_nearest(queries, forest, probes).where("size(n) = 2"), "nearest-two")
    left = queries.select(*keys, "kp_id", "descriptor").join(spread_if_large(found.select(*keys, F.col("q_id").alias("kp_id"))), [*keys, "kp_id"], "left_anti")
    left = materialize(left, "unmet-queries")
    return found if left.isEmpty() else found.unionByName(joins.nearest_two(left, train, keys))
