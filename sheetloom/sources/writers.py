"""Writers of documents, logs, CSV, keyed upserts, graphs, annotated sets, manifests and PNG images."""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import graph_document


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def write_documents(df: DataFrame, path: str, key: str = "pair", mode: str = "overwrite") -> None:
    """Rows as JSON, one folder a key."""
    df.write.mode(mode).partitionBy(key).json(path)


def write_parcels(df: DataFrame, path: str) -> None:
    """Numbered parcels as JSON by sheet: centres to two places, confidence to four, area to one."""
    write_documents(rounded(df, {"cx": 2, "cy": 2, "confidence": 4, "area_px": 1}), path, "map_num")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], places: dict[str, int] | None = None) -> None:
    """CSV with a header and just the given columns; arrays are joined by semicolons."""
    kinds = dict(df.dtypes)
    flat = rounded(df, places or {}).select(*[(F.array_join(F.col(c).cast("array<string>"), ";") if kinds[c].startswith("array") else F.col(c)).alias(c) for c in columns])
    flat.write.mode("overwrite").option("header", True).csv(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """The old rows whose keys have no new one, and the new rows; of new rows with equal keys the one with the largest ``seq``, then by all columns."""
    kinds = dict(new.dtypes)
    rest = [c for c in new.columns if c not in keys and c != seq]
    order = [F.desc_nulls_last(F.to_json(F.struct(c)) if kinds[c].startswith("map") else F.col(c)) for c in ([seq] if seq else []) + rest]
    once = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r") if order else new.distinct()
    return old.join(once.select(*keys), keys, "left_anti").unionByName(once, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], path: str, seq: str | None = None) -> None:
    """Replace the table at ``path``, read as ``old``, by its upserted rows.

    They are written beside it and swapped in by renaming, so the table is whole at all times, under its own name or, if the job ends
    between the two renames, under ``<path>.old-<id>``.
    """
    spark, name = old.sparkSession, uuid.uuid4().hex
    beside, aside = f"{path}.new-{name}", f"{path}.old-{name}"
    upserted(old, new, keys, seq).write.parquet(beside)
    at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for a, b in ((path, aside), (beside, path)):
        if not fs.rename(at(a), at(b)):
            raise OSError(f"{a} can't be renamed to {b}")
    fs.delete(at(aside), True)
    spark.catalog.refreshByPath(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    graph_document(nodes, edges).write.mode("overwrite").parquet(path)


def _escaped(c: Column) -> Column:
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        c = F.replace(c, F.lit(sign), F.lit(f"&{name};"))
    return c


def graphml_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One GraphML text a sheet, with its keys declared; a null attribute is left out."""
    kinds = {"int": "int", "bigint": "long", "double": "double", "float": "float", "boolean": "boolean"}
    fields = lambda df, skip: [(c, kinds.get(t, "string")) for c, t in df.dtypes if c not in skip]
    text = lambda c: _escaped(F.col(c).cast("string"))
    data = lambda names: F.concat_ws("", *[F.concat(F.lit(f'<data key="{c}">'), text(c), F.lit("</data>")) for c, _ in names])
    listed = lambda *order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda v: v["x"]), "")
    own, of = fields(nodes, ("id", "map_num", "bbox")), fields(edges, ("src", "dst", "map_num"))
    node = F.concat(F.lit('<node id="'), text("id"), F.lit('">'), data(own), F.lit("</node>")).alias("x")
    edge = F.concat(F.lit('<edge source="'), text("src"), F.lit('" target="'), text("dst"), F.lit('">'), data(of), F.lit("</edge>")).alias("x")
    n, e = nodes.groupBy("map_num").agg(listed("id", node).alias("n")), edges.groupBy("map_num").agg(listed("src", "dst", edge).alias("e"))
    sides = {**{x: "node" for x in own}, **{x: "all" if x in own else "edge" for x in of}}
    keys = "".join(f'<key id="{c}" for="{side}" attr.name="{c}" attr.type="{t}"/>' for (c, t), side in sides.items())
    head = f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">'
    return n.join(e, "map_num", "left").select("map_num", F.concat(F.lit(head), "n", F.coalesce("e", F.lit("")), F.lit("</graph></graphml>")).alias("document"))


def manifest(reached: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """One row a component: its sheets in order, box and canvas."""
    listed = reached.groupBy(*keys).agg(F.array_sort(F.collect_list("node")).alias("maps"))
    return listed.join(boxes, keys).withColumn("canvas_size", F.array(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")))


def coco_document(images: DataFrame, annotations: DataFrame, categories: Column) -> DataFrame:
    """One JSON text a split."""
    i = images.groupBy("split").agg(F.array_sort(F.collect_list(F.struct("id", "file_name", "width", "height"))).alias("images"))
    a = annotations.groupBy("split").agg(F.array_sort(F.collect_list(F.struct("id", "image_id", "category_id", "segmentation", "area", "bbox", "iscrowd"))).alias("annotations"))
    met = i.join(a, "split", "left").withColumn("categories", categories)
    return met.select("split", F.to_json(F.struct("images", F.coalesce("annotations", F.array()).alias("annotations"), "categories")).alias("document"))


def write_annotated(images: DataFrame, annotations: DataFrame, path: str) -> None:
    """An annotated set as two tables by split, for sets too large for one document; :func:`coco_document` is for exchange."""
    images.write.mode("overwrite").partitionBy("split").parquet(f"{path}/images")
    annotations.write.mode("overwrite").partitionBy("split").parquet(f"{path}/annotations")


def png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A PNG file of gray or blue-green-red bytes."""
    import numpy as np

    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    a = a[..., ::-1] if channels == 3 else a
    lines = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(a).reshape(height, width * channels)], axis=1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def encoded_png(images: DataFrame) -> DataFrame:
    """map_num and the PNG file of each image, and its base64 text."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"map_num": b["map_num"], "png": [png(r.height, r.width, r.n_channels, bytes(r.data)) for r in b.itertuples(index=False)]})

    made = images.select("map_num", "height", "width", "n_channels", "data").mapInPandas(run, "map_num string, png binary")
    return made.withColumn("base64", F.base64("png"))


def write_png(images: DataFrame, folder: str, kind: str = "clean") -> DataFrame:
    """Write each image as ``map_<map_num>_<kind>.png`` in a folder that all executors share: map_num, path, n_bytes.

    A file appears whole, by a rename under a name that depends on the image only, so a repeated task leaves the same files.
    """
    import pandas as pd

    from ..shared import open_fs

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                path = f"{folder}/map_{r.map_num}_{kind}.png"
                fs, inner = open_fs(path)
                body, part = png(r.height, r.width, r.n_channels, bytes(r.data)), f"{inner}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(body)
                fs.move(part, inner)
                rows.append((r.map_num, path, len(body)))
            yield pd.DataFrame(rows, columns=["map_num", "path", "n_bytes"])

    fs, inner = open_fs(folder)
    fs.create_dir(inner, recursive=True)
    return images.select("map_num", "height", "width", "n_channels", "data").mapInPandas(run, "map_num string, path string, n_bytes long")
