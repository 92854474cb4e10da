"""Connected components of a distributed edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def _stars(edges: DataFrame, name: str) -> DataFrame:
    """For rows (u, v): every v and u itself linked to the least of them; both inputs of the join are tables, so skewed u can be split."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("at", "m").alias("m")), name)
    return edges.join(least, F.col("u") == F.col("at")).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (columns u, v; longs without nulls); the root is the least node reachable.

    Self links, repeated links and either direction are fine; an empty table gives an empty table. The rounds grow
    with the logarithm of the longest path; every round's links are a table in the shared folder.
    """
    links = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, "large-star").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "links")
        small = _stars(large, "small-star")
        small = small.select("u", F.col("m").alias("v")).unionAll(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = materialize(small.where("u <> v").distinct(), "links")
        r = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        discard(links)
        discard(large)
        links = after
        if (r.n, r.s) == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = (r.n, r.s)
