"""One-to-one matching of two sides: least-cost assignment, soft assignment, positional greedy. One group a sheet pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import discard, materialize
from . import ranks


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost one-to-one assignment of a rectangular cost matrix, by shortest augmenting paths."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assignment(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)  # the row, from 1, that has a column
    for row in range(1, n + 1):
        owner[0], col = row, 0
        least, before, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[col]:
            done[col] = True
            i = owner[col]
            open_ = ~done[1:]
            slack = cost[i - 1] - u[i] - v[1:]
            better = open_ & (slack < least[1:])
            least[1:][better] = slack[better]
            before[1:][better] = col
            nearest = 1 + int(np.argmin(np.where(open_, least[1:], np.inf)))
            step = least[nearest]
            u[owner[done]] += step
            v[done] -= step
            least[1:][open_] -= step
            col = nearest
        while col:
            owner[col] = owner[before[col]]
            col = before[col]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def assign_pairs(costs: DataFrame, accept: float = 0.6, missing: float = 1e6) -> DataFrame:
    """Least-cost one-to-one pairs within each ``pair``, of which those below ``accept`` stay: pair, parcel_a, parcel_b, cost.

    ``costs`` is long, one row an allowed combination; a combination without a row costs ``missing``. A group is one pair of sheets.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["parcel_a", "parcel_b"])
        a, b = np.unique(pdf["parcel_a"]), np.unique(pdf["parcel_b"])
        dense = np.full((len(a), len(b)), missing)
        dense[np.searchsorted(a, pdf["parcel_a"]), np.searchsorted(b, pdf["parcel_b"])] = pdf["cost"]
        got = [(i, j) for i, j in assignment(dense) if dense[i, j] < accept]
        return pd.DataFrame({"pair": pdf["pair"].iloc[0], "parcel_a": [a[i] for i, _ in got], "parcel_b": [b[j] for _, j in got], "cost": [dense[i, j] for i, j in got]}, columns=["pair", "parcel_a", "parcel_b", "cost"])

    kind = costs.schema["parcel_a"].dataType.simpleString()
    return costs.select("pair", "parcel_a", "parcel_b", "cost").groupBy("pair").applyInPandas(solve, f"pair string, parcel_a {kind}, parcel_b {kind}, cost double")


def soft_assignment(scores: np.ndarray, dustbin: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Sinkhorn normalisation in the log domain of scores with a dustbin row and column; rows first, then rows and columns in turn."""
    scores = np.asarray(scores, float)
    full = np.full((scores.shape[0] + 1, scores.shape[1] + 1), float(dustbin))
    full[:-1, :-1] = scores

    def spread(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return x - top - np.log(np.exp(x - top).sum(axis=axis, keepdims=True))

    full = spread(full, 1)
    for _ in range(rounds):
        full = spread(spread(full, 1), 0)
    return np.exp(full)


def soft_match(scores: DataFrame, dustbin: float = 1.0, rounds: int = 100, least: float = 0.2) -> DataFrame:
    """Each row's best column under soft assignment, if it reaches ``least``: pair, a, b, score. ``scores``: pair, a, b, score for all a and b of a pair."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.unique(pdf["a"]), np.unique(pdf["b"])
        dense = np.full((len(a), len(b)), -1e9)
        dense[np.searchsorted(a, pdf["a"]), np.searchsorted(b, pdf["b"])] = pdf["score"]
        p = soft_assignment(dense, dustbin, rounds)[:-1, :-1]
        return pd.DataFrame({"pair": pdf["pair"].iloc[0], "a": np.repeat(a, len(b)), "b": np.tile(b, len(a)), "score": p.ravel()})

    soft = scores.select("pair", "a", "b", "score").groupBy("pair").applyInPandas(solve, "pair string, a long, b long, score double")
    return ranks.confident_row_best(soft, ["pair"], "a", "b", least)


DUSTBIN = -(1 << 63)  # the id of the dustbin of either side


def _with_dustbins(scores: DataFrame, dustbin: float) -> DataFrame:
    known = scores.where("a is not null and b is not null and score is not null").select("pair", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("score").cast("double").alias("s"))
    bin_, d = F.lit(DUSTBIN).cast("long"), F.lit(float(dustbin))
    ends = lambda *c: known.select("pair", *c).distinct().withColumn("s", d).select("pair", *[F.col(x) if x in c else bin_.alias(x) for x in ("a", "b")], "s")
    return known.unionAll(ends("a")).unionAll(ends("b")).unionAll(ends())


def soft_potentials(scores: DataFrame, dustbin: float = 1.0, rounds: int = 100, every: int = 4, tolerance: float = 1e-8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, rows, columns): pair, a, b, s with the dustbins' cells, and the potentials u of rows and v of columns; a cell's soft assignment is exp(s + u + v).

    Rows and columns are normalised in turn, each by one join with the other side's potentials and one sum a row or column; the potentials of the round before keep
    the exponents small. It ends after ``rounds`` rounds, or when in ``every`` rounds the columns of no pair have moved apart by more than ``tolerance`` (all
    together they may drift, as the two sides' sums differ, and the rows drift back).
    """
    cells = materialize(_with_dustbins(scores, dustbin), "soft-cells")
    u = materialize(cells.groupBy("pair", "a").agg((-F.max("s")).alias("u")), "soft-rows")
    v = materialize(cells.select("pair", "b").distinct().withColumn("v", F.lit(0.0)), "soft-columns")
    small = u.count() + v.count() <= 100_000
    hint = F.broadcast if small else (lambda df: df)

    def normalised(u, v, at, name):
        x = cells.join(hint(u), ["pair", "a"]).join(hint(v), ["pair", "b"])
        return x.groupBy("pair", at).agg((F.max(name) - F.ln(F.sum(F.exp(F.col("s") + F.col("u") + F.col("v"))))).alias(name))

    before = v
    for done in range(1, rounds + 1):
        # each side is a table, as the next one asks for both: a plan over some rounds would hold the first ones many times
        was_u, was_v = u, v
        u = materialize(normalised(u, v, "a", "u"), "soft-rows")
        discard(was_u)
        v = materialize(normalised(u, v, "b", "v"), "soft-columns")
        if was_v is not before:
            discard(was_v)
        if done % every and done < rounds:
            continue
        moved = v.join(before.withColumnRenamed("v", "was"), ["pair", "b"]).groupBy("pair").agg((F.max(F.col("v") - F.col("was")) - F.min(F.col("v") - F.col("was"))).alias("apart"))
        if (moved.agg(F.max("apart")).first()[0] or 0.0) <= tolerance:
            break
        if before is not v:
            discard(before)
        before = v
    return cells, u, v


def soft_match_by_tables(scores: DataFrame, dustbin: float = 1.0, rounds: int = 100, least: float = 0.2) -> DataFrame:
    """The rows of :func:`soft_match` from potentials as tables, so neither a pair's matrix nor a pair stands in one task. Repeated cells add up; cells with nulls are left out."""
    cells, u, v = soft_potentials(scores, dustbin, rounds)
    own = cells.where(f"a <> {DUSTBIN} and b <> {DUSTBIN}").join(u, ["pair", "a"]).join(v, ["pair", "b"])
    return ranks.confident_row_best(own.select("pair", "a", "b", F.exp(F.col("s") + F.col("u") + F.col("v")).alias("score")), ["pair"], "a", "b", least)


def embedding_scores(left: DataFrame, right: DataFrame, keys: list[str], temperature: float = 0.1) -> DataFrame:
    """Scores of unit vectors: dot product by temperature, for all of a pair's left and right (columns id, vec)."""
    a = left.select(*keys, F.col("id").alias("a"), F.col("vec").alias("va"))
    b = right.select(*keys, F.col("id").alias("b"), F.col("vec").alias("vb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return a.join(b, keys).select(*keys, "a", "b", (dot / (norm("va") * norm("vb")) / temperature).alias("score"))


def positional_match(nodes_a: DataFrame, nodes_b: DataFrame, n: int = 3, within: float = 0.3) -> DataFrame:
    """Boundary nodes matched in order of their distance to the boundary, each to the nearest unused one within reach: pair, a, b, distance.

    ``nodes``: pair, id, dist_boundary, norm_cx, norm_cy, scaled to 0..1. The n nearest of A are matched among the 2n nearest of B.
    """

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            b = b.set_axis(columns, axis=1)
            k = min(2 * n, len(a), len(b))
            a, b = (x.sort_values(["dist_boundary", "id"], kind="stable").head(k) for x in (a, b))
            at, used = b[["norm_cx", "norm_cy"]].to_numpy(), np.zeros(len(b), bool)
            for i, x, y in a[["id", "norm_cx", "norm_cy"]].head(n).itertuples(index=False):
                d = np.where(used, np.inf, np.hypot(at[:, 0] - x, at[:, 1] - y))
                j = int(np.argmin(d))
                if d[j] < within:
                    used[j] = True
                    rows.append((a["pair"].iloc[0], i, b["id"].iloc[j], d[j]))
        return pd.DataFrame(rows, columns=["pair", "a", "b", "distance"])

    columns = ["pair", "id", "dist_boundary", "norm_cx", "norm_cy"]
    other = nodes_b.select(*columns).toDF(*[f"{c}_b" for c in columns])  # both sides may be parts of one table
    return nodes_a.select(*columns).groupBy("pair").cogroup(other.groupBy("pair_b")).applyInPandas(match, "pair string, a long, b long, distance double")
