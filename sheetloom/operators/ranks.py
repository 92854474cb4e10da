"""Ranking, top-k, best and runner-up, tiles, sequential ids. Every order ends in an index, so equal values rank the same each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group by the given order, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def best(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_k(df, keys, order, 1, "_rank").drop("_rank")


def first_max(value: str, score: Column, idx: Column) -> Column:
    """Aggregate: the value with the largest score, the first by index of equals."""
    return F.max_by(F.col(value), F.struct(score, -idx))


def best_and_gap(df: DataFrame, keys: list[str], error: str, idx: str) -> DataFrame:
    """The row with the least error of each group, and how much larger the runner-up's error is."""
    w = Window.partitionBy(*keys).orderBy(error, idx)
    ranked = df.withColumns({"_rank": F.row_number().over(w), "_next": F.lead(error).over(w)})
    return ranked.where("_rank = 1").withColumn("gap", F.col("_next") - F.col(error)).drop("_rank", "_next")


def best_of_union(first: DataFrame, second: DataFrame, keys: list[str], error: str, idx: str) -> DataFrame:
    """The least error of two result lists, rows of the first before equal ones of the second."""
    both = first.withColumn("_list", F.lit(0)).unionByName(second.withColumn("_list", F.lit(1)))
    return best(both, keys, [error, "_list", idx]).drop("_list")


def confident_row_best(scores: DataFrame, keys: list[str], row: str, col: str, least: float = 0.2) -> DataFrame:
    """Each row's best column if its score reaches ``least``; many rows may share a column."""
    return best(scores, [*keys, row], [F.desc("score"), col]).where(F.col("score") >= least)


def nearest_to_boundary(nodes: DataFrame, keys: list[str], k: Column | int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("dist_boundary", "id")
    return nodes.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def largest(df: DataFrame, keys: list[str], size: str = "area_px", idx: str = "id") -> DataFrame:
    return best(df, keys, [F.desc(size), idx])


def prune_neighbours_setbased(edges: DataFrame, k: int = 12) -> DataFrame:
    """Edges that are among the ``k`` nearest of both their ends: map_num, src, dst, distance.

    This is not the sequential pruning, which removes edges as it goes; see graph.prune_neighbours.
    """
    both = edges.select("map_num", F.col("src").alias("node"), F.col("dst").alias("other"), "distance", "src", "dst").unionAll(
        edges.select("map_num", F.col("dst").alias("node"), F.col("src").alias("other"), "distance", "src", "dst")
    )
    near = top_k(both, ["map_num", "node"], ["distance", "other"], k)
    kept = near.groupBy("map_num", "src", "dst").agg(F.count("*").alias("ends"), F.first("distance").alias("distance"))
    return kept.where("ends = 2").select("map_num", "src", "dst", "distance")


def tiles(sheets: DataFrame, size: int = 512, stride: int = 384) -> DataFrame:
    """Tile origins of every sheet (map_num, height, width): ty, tx and the part of the tile on the sheet, th, tw."""
    ys = sheets.select("*", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(stride))).alias("ty"))
    both = ys.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(stride))).alias("tx"))
    return both.withColumns({"th": F.least(F.lit(size), F.col("height") - F.col("ty")), "tw": F.least(F.lit(size), F.col("width") - F.col("tx"))})


def sequential_ids(df: DataFrame, keys: list[str], order: list, name: str = "id") -> DataFrame:
    """Ids from 0 within the keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
