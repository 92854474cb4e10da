"""Panoramas: placement from scores, or from a graph of transforms; both end in a blend by tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import aggregates, filters, graph, placement, raster

PLACE = "map_num string, rot double, x long, y long, w long, h long, edges array<string>, how string, place int"


def wanted_pairs(adjacent: DataFrame, selected: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(needed, missing): adjacent pairs among the selected sheets, and those without a stored score."""
    from ..operators import joins

    needed = joins.adjacent_among(adjacent, selected)
    return needed, joins.work_list(needed, done)


def _placed(scores: DataFrame, sizes: DataFrame, key: str, seed: tuple[str, str] | None = None) -> DataFrame:
    """Every group's sheets placed from its scores, best fits first: one task a group, which holds the pairs and sizes of one panorama."""
    import pandas as pd

    names = [key, *[c.split()[0] for c in PLACE.split(", ")]]

    def place(fits: pd.DataFrame, dims: pd.DataFrame) -> pd.DataFrame:
        if fits.empty:
            return pd.DataFrame(columns=names)
        own = {m: (int(w), int(h)) for m, w, h in zip(dims["map_num"], dims["w"], dims["h"], strict=True)}
        rows = [r for r in fits.sort_values(["map_a", "map_b"], kind="stable").to_dict("records") if r["map_a"] in own and r["map_b"] in own]
        return pd.DataFrame([{key: fits[key].iloc[0], **p} for p in placement.layout(rows, own, seed)], columns=names)

    kind = scores.schema[key].dataType.simpleString()
    fits = scores.select(key, "map_a", "map_b", "edge_a", "edge_b", F.col("total_rot").cast("double").alias("total_rot"), F.col("combined_score").cast("double").alias("combined_score"))
    dims = sizes.select(F.col(key).alias(f"{key}_of"), "map_num", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"))
    return fits.groupBy(key).cogroup(dims.groupBy(f"{key}_of")).applyInPandas(place, f"{key} {kind}, {PLACE}")


def layout(scores: DataFrame, sizes: DataFrame, seed: tuple[str, str] | None, exclude: list[str] | None = None, most_pairs: int = 100_000) -> DataFrame:
    """Placement of one panorama's sheets from the ``seed`` pair on (None: the best pair); excluded sheets are filtered first. It is one sequence, so one task.

    More than ``most_pairs`` pairs are no single panorama and raise.
    """
    kept = filters.without(filters.without(scores, exclude or [], "map_a"), exclude or [], "map_b")
    if kept.limit(most_pairs + 1).count() > most_pairs:
        raise ValueError(f"more than {most_pairs} pairs: place components one by one")
    one = F.lit(0)
    return _placed(kept.withColumn("panorama", one), filters.without(sizes, exclude or []).withColumn("panorama", one), "panorama", seed).drop("panorama")


def layouts(scores: DataFrame, sizes: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Placements of all panoramas at once, one for each component of sheets that fits connect: component (its first sheet) and its places.

    A component starts with its best pair and is one task; components are spread. Sheets without a score have no place.
    """
    from ..shared import materialize

    kept = filters.without(filters.without(scores, exclude or [], "map_a"), exclude or [], "map_b").where("map_a is not null and map_b is not null")
    known = filters.without(sizes, exclude or []).select("map_num", "w", "h")
    kept = materialize(kept.join(known.select(F.col("map_num").alias("map_a")), "map_a", "left_semi").join(known.select(F.col("map_num").alias("map_b")), "map_b", "left_semi"), "panorama-fits")
    roots = graph.connected_components(kept.select(F.col("map_a").alias("src"), F.col("map_b").alias("dst"))).select("node", F.col("root").alias("component"))
    fits = kept.join(roots.withColumnRenamed("node", "map_a"), "map_a")
    return _placed(fits, known.join(roots.withColumnRenamed("node", "map_num"), "map_num"), "component")


def placed_images(images: DataFrame, places: DataFrame, scale: float = 0.10) -> DataFrame:
    """Sheets cropped, turned, trimmed at their first contact side and shrunk as placement saw them, with their place."""
    import pandas as pd

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                a = raster.prepare_for_placement(raster.gray(raster.to_array(r.height, r.width, r.n_channels, r.data)), r.rot, r.edges[0] if len(r.edges) else None, scale)
                yield pd.DataFrame([(*raster.as_row(r.map_num, a), r.x, r.y, list(r.edges))], columns=["map_num", "height", "width", "n_channels", "data", "x", "y", "edges"])

    met = images.join(places, "map_num").select("map_num", "height", "width", "n_channels", "data", "rot", "x", "y", "edges")
    return met.mapInPandas(run, f"{raster.IMAGE_SCHEMA}, x long, y long, edges array<string>")


def blended(placed: DataFrame, tile: int = 512, pad: int = 200) -> DataFrame:
    """Placed images blended with seam ramps and content weights, by tiles: ty, tx, data."""
    import numpy as np
    import pandas as pd

    box = placed.agg((F.min("x") - pad).alias("x"), (F.min("y") - pad).alias("y")).first()
    x0, y0 = box.x or 0, box.y or 0

    def cut(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                a = raster.to_array(r.height, r.width, r.n_channels, r.data).astype(float)
                w = raster.seam_alpha(*a.shape, list(r.edges)) * np.clip((245 - a) / 15, 0, 1)
                left, top = r.x - x0, r.y - y0
                for ty in range(top // tile, (top + a.shape[0] - 1) // tile + 1):
                    for tx in range(left // tile, (left + a.shape[1] - 1) // tile + 1):
                        vw, ww = np.zeros((tile, tile), np.float32), np.zeros((tile, tile), np.float32)
                        ya, yb, xa, xb = max(top, ty * tile), min(top + a.shape[0], (ty + 1) * tile), max(left, tx * tile), min(left + a.shape[1], (tx + 1) * tile)
                        part = (slice(ya - top, yb - top), slice(xa - left, xb - left))
                        there = (slice(ya - ty * tile, yb - ty * tile), slice(xa - tx * tile, xb - tx * tile))
                        vw[there], ww[there] = a[part] * w[part], w[part]
                        yield pd.DataFrame({"ty": [ty], "tx": [tx], "vw": [vw.tobytes()], "w": [ww.tobytes()]})

    def merge(pdf):
        vw, w = (np.sum([np.frombuffer(x, np.float32).astype(float) for x in pdf[c]], axis=0) for c in ("vw", "w"))
        out = np.where(w > 1e-6, vw / np.maximum(w, 1e-12), 255)
        return pd.DataFrame({"ty": pdf["ty"].iloc[:1], "tx": pdf["tx"].iloc[:1], "data": [np.clip(out, 0, 255).astype(np.uint8).tobytes()]})

    return placed.mapInPandas(cut, "ty int, tx int, vw binary, w binary").groupBy("ty", "tx").applyInPandas(merge, "ty int, tx int, data binary")


def stitch(transforms: DataFrame, sizes: DataFrame, exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sheets, boxes, unreachable): every sheet's transform to its component's anchor, each component's box, and sheets without a path.

    Excluded sheets are filtered before components are found.
    """
    from ..shared import materialize

    links = filters.without(filters.without(filters.finite_transforms(transforms), exclude or [], "map_a"), exclude or [], "map_b")
    links = materialize(graph.with_inverses(links.select("map_a", "map_b", "h")), "transform-links")
    component = materialize(graph.connected_components(links.select("src", "dst")), "sheet-components")
    reached = graph.transforms_by_doubling(links, materialize(graph.anchors(links, component), "anchors"))
    sheets = reached.join(sizes.select(F.col("map_num").alias("node"), "width", "height"), "node")
    boxes = aggregates.panorama_box(sheets.withColumnRenamed("h", "t"), ["anchor"])
    scale = G.pixel_scale(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"), 200e6)
    return sheets, boxes.withColumn("downscale", scale), graph.unreachable(sizes.select(F.col("map_num").alias("node")), reached)
