"""Readers of sheets, parcels, readings, caches, transforms, scores, graphs, clicks and annotated sets. Paths may be any that Spark reads.

The key that a file's name carries becomes a column. Documents that hold a list under a name or a bare list are both read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geometry as G
from ..functions.text import map_number
from ..operators.filters import finite_transforms
from ..operators.ranks import best
from . import elements

PARCEL_ITEM = (
    "parcel_id int, id int, cx double, cy double, centroid_x double, centroid_y double, bbox array<int>, area_px double, mask_area_px double, polygon array<array<double>>,"
    " confidence double, source_tile array<int>, detected_number int, ocr_text string, number int, validation string, source string"
)
DEFAULT_SIZE = (6000, 8000)


def key_of(path: Column, pattern: str = r"map_(\d+)_") -> Column:
    return F.regexp_extract(path, pattern, 1)


def images(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """map_num, kind, height, width, n_channels, data of image files; files that do not decode are dropped, or kept without size."""
    raw = spark.read.format("image").option("dropInvalid", drop_invalid).load(path)
    kind = F.regexp_extract("image.origin", r"_(clean|binary)\.", 1)
    return raw.select(
        key_of(F.col("image.origin")).alias("map_num"), kind.alias("kind"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data", F.col("image.origin").alias("path")
    )


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """map_num, height, width; a usual size stands in for files that do not decode."""
    h, w = DEFAULT_SIZE
    found = images(spark, path, drop_invalid=False)
    return found.select("map_num", *[F.when(F.col(c) > 0, F.col(c)).otherwise(d).alias(c) for c, d in (("height", h), ("width", w))])


def source_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The file of each sheet, of several the one with the shortest name, then the first."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    named = found.select(map_number(F.col("path")).alias("map_num"), "path")
    return named.groupBy("map_num").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("path"))


def image_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Clean sheets with their binary ones; where the binary is missing the clean one is cut at Otsu's threshold."""
    import numpy as np

    from ..operators import raster

    both = images(spark, path)
    clean = both.where("kind = 'clean'").drop("kind", "path")
    binary = both.where("kind = 'binary'").select("map_num", F.col("data").alias("given"))

    @F.udf("binary")
    def cut(height, width, channels, data):
        a = raster.gray(raster.to_array(height, width, channels, bytes(data)))
        return np.where(a > raster.otsu(a), 255, 0).astype(np.uint8).tobytes()

    met = clean.join(binary, "map_num", "left")
    return met.select("map_num", "height", "width", "n_channels", "data", F.coalesce("given", F.when(F.col("given").isNull(), cut("height", "width", "n_channels", "data"))).alias("binary"))


def _items(spark: SparkSession, path: str, item: str, name: str, pattern: str) -> DataFrame:
    """Rows of JSON documents, one a file: a bare list, or a list under ``name``; with map_num of the file and idx in the list."""
    text = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("path"))
    bare = F.trim("value").startswith("[")
    listed = F.when(bare, F.from_json("value", f"array<struct<{_fields(item)}>>")).otherwise(F.from_json("value", f"{name} array<struct<{_fields(item)}>>")[name])
    return text.select(key_of(F.col("path"), pattern).alias("map_num"), F.posexplode(listed).alias("idx", "item")).select("map_num", "idx", "item.*")


def _fields(ddl: str) -> str:
    out, depth = [], 0
    for part in ddl.replace(", ", ",\0").split("\0"):
        out.append(part if depth else part.replace(" ", ":", 1) if not part.startswith(" ") else part)
        depth += part.count("<") - part.count(">")
    return "".join(out).strip()


def parcels(spark: SparkSession, path: str, pattern: str = r"map_(\d+)_") -> DataFrame:
    """Parcels of JSON files as declared rows; the file's older names of fields count where newer ones are missing."""
    raw = _items(spark, path, PARCEL_ITEM, "parcels", pattern)
    box = F.struct(*[F.col("bbox")[i].alias(n) for i, n in enumerate("xywh")])
    polygon = F.transform("polygon", lambda p: F.struct(p[0].cast("int").alias("x"), p[1].cast("int").alias("y")))
    number = F.coalesce(F.col("ocr_text").try_cast("int"), "detected_number", "number")
    return raw.select(
        "map_num", "idx", F.coalesce("parcel_id", "id").alias("parcel_id"), F.coalesce("cx", "centroid_x").alias("cx"), F.coalesce("cy", "centroid_y").alias("cy"),
        F.when(F.col("bbox").isNotNull(), box).alias("bbox"), F.coalesce("area_px", (F.col("bbox")[2] * F.col("bbox")[3]).cast("double")).alias("area_px"), "mask_area_px", polygon.alias("polygon"),
        "confidence", number.alias("detected_number"), "validation", "source",
    )


def confident_parcels(spark: SparkSession, path: str, least: float = 0.35) -> DataFrame:
    return parcels(spark, path).where(F.coalesce("confidence", F.lit(1.0)) >= least)


def shaped_parcels(spark: SparkSession, path: str, vertices: int = 3, least_area: float = 800.0) -> DataFrame:
    """Parcels with a polygon and enough mask area; a missing area is none."""
    return parcels(spark, path).where((F.size("polygon") >= vertices) & (F.coalesce("mask_area_px", F.lit(0.0)) >= least_area))


def signed_parcels(spark: SparkSession, path: str) -> DataFrame:
    """Parcels with at least four vertices, an area of 1000 pixels and a finite shape signature."""
    area = F.coalesce(F.expr("nullif(mask_area_px, 0)"), F.expr("nullif(area_px, 0)"), F.lit(1.0))
    signed = shaped_parcels(spark, path, 4, 0.0).withColumns({"area": area, "signature": G.hu_signature(F.col("polygon"))})
    # one use of the signature, which is made again for each
    return signed.where((F.col("area") >= 1000) & F.coalesce(~F.exists("signature", lambda x: F.isnan(x)), F.lit(False)))


def annotated_parcels(spark: SparkSession, path: str) -> DataFrame:
    return parcels(spark, path).where(F.col("detected_number").isNotNull())


def readings(spark: SparkSession, path: str, source: str = "clean") -> DataFrame:
    """Readings of recognised numbers."""
    item = "parcel_id int, cx double, cy double, bbox array<int>, recognised_number int, confidence double, raw_text string, model string, rotation int, is_csv_target boolean"
    raw = _items(spark, path, item, "parcels", r"map_(\d+)_")
    return raw.withColumns({"source": F.lit(source), "bbox": F.struct(*[F.col("bbox")[i].alias(n) for i, n in enumerate("xywh")])})


def cache(spark: SparkSession, path: str) -> DataFrame:
    """The latest record of every parcel of an append log, one JSON object a line; blank and broken lines and records without a parcel are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    parsed = lines.select(key_of(F.col("path")).alias("file_map"), F.from_json("value", schemas.CACHE).alias("r"), "at")
    known = parsed.where(F.col("r.parcel_id").isNotNull()).select(F.coalesce("r.map_num", "file_map").alias("map_num"), *[f"r.{c}" for c in ("seq", "parcel_id", "number", "raw", "error", "model", "rotation")], "at")
    return best(known, ["map_num", "parcel_id"], [F.desc_nulls_last("seq"), F.desc("at")]).drop("at")


def homographies(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """pair, map_a, map_b, h and the other fields of a transform document; entries without a finite 3x3 are left out.

    ``only`` keeps pairs of which both sheets are among the given.
    """
    value = (
        "struct<map_a:string,map_b:string,rotation_b_deg:double,edge_a:string,edge_b:string,shift_px:double,stage1_score:double,n_crossings_a:int,n_crossings_b:int,stage2_status:string,"
        "shape_a:array<int>,shape_b:array<int>,boundary_parcels:array<int>,H:array<array<double>>,b_offset:array<int>,refinement:struct<method:string,n_pairs:int>>"
    )
    doc = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("pair", "v"))
    sides = F.split("pair", "_")
    flat = doc.select("pair", "v.*").withColumns({"map_a": F.coalesce("map_a", sides[0]), "map_b": F.coalesce("map_b", sides[1]), "h": F.flatten("H")})
    found = finite_transforms(flat.where(F.col("h").isNotNull()))
    if only is not None:
        found = found.where(F.col("map_a").isin(only) & F.col("map_b").isin(only))
    return found


def pair_scores(spark: SparkSession, path: str) -> DataFrame:
    """The best score row of every pair document."""
    best_row = (
        "struct<edge_a:string,edge_b:string,coarse_rot:double,fine_rot:double,total_rot:double,phase_score:double,ncc_2d:double,density_a:double,density_b:double,"
        "density_sim:double,combined_score:double,error:double,best_offset_px:int,label:string>"
    )
    doc = spark.read.option("wholetext", True).text(path)
    return doc.select(F.from_json("value", f"map_a string, map_b string, best {best_row}").alias("d")).select("d.map_a", "d.map_b", "d.best.*").where("combined_score is not null")


def score_report(spark: SparkSession, path: str) -> DataFrame:
    """Ranked neighbours of a saved report: map_num, rank, and the entry's fields."""
    entry = "struct<map:string,score:double,error:double,edge:string,rotation:double,gap:double,pair_key:string>"
    doc = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", f"map<string,array<{entry}>>")).alias("map_num", "list"))
    return doc.select("map_num", F.posexplode("list").alias("rank", "e")).select("map_num", (F.col("rank") + 1).alias("rank"), F.col("e.map").alias("other"), "e.score", "e.error", "e.edge", "e.rotation", "e.gap", "e.pair_key")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML: ids as strings, attributes as a map by key."""
    data = "array<struct<_VALUE:string,_key:string>>"
    attributes = F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"].alias("k"), d["_VALUE"].alias("v"))))
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, data {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {data}").load(path)
    return nodes.select(F.col("_id").alias("id"), attributes.alias("attributes")), edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), attributes.alias("attributes"))


def keypoints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.KEYPOINT).parquet(path)


def clicks(spark: SparkSession, path: str) -> DataFrame:
    """pair, side, number, x, y of click documents; a document without clicks has no rows."""
    text = spark.read.option("wholetext", True).text(path)
    doc = text.select(F.from_json("value", schemas.CLICKS).alias("d")).select("d.*")
    side = lambda s: doc.select(F.coalesce("pair", F.concat_ws("_", "map_a", "map_b")).alias("pair"), F.lit(s).alias("side"), F.explode(f"clicks_{s}").alias("k", "p"))
    both = side("a").unionAll(side("b"))
    return both.select("pair", "side", F.col("k").cast("int").alias("number"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


COCO = {
    "images": "id long, file_name string, width int, height int, source_map string",
    "annotations": "id long, image_id long, category_id int, segmentation array<array<double>>, area double, bbox array<int>, iscrowd int",
}


def coco(spark: SparkSession, path: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of an annotated set, with its split; a document is one task, see :func:`coco_elements` for large ones."""
    item = ", ".join(f"{n} array<struct<{fields.replace(', ', ',').replace(' ', ':')}>>" for n, fields in COCO.items())
    doc = spark.read.option("wholetext", True).text(path).select(F.from_json("value", item).alias("d"))
    part = lambda n: doc.select(F.lit(split).alias("split"), F.inline(f"d.{n}"))
    return part("images"), part("annotations")


def coco_elements(spark: SparkSession, path: str, split: str, chunk: int = elements.CHUNK) -> tuple[DataFrame, DataFrame]:
    """The tables of :func:`coco` of one large file, read by a task for each ``chunk`` bytes."""
    part = lambda n: elements.elements(spark, path, n, chunk).select(F.lit(split).alias("split"), F.from_json("value", COCO[n]).alias("d")).select("split", "d.*")
    return part("images"), part("annotations")


def annotated(spark: SparkSession, path: str, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of a set kept as tables, of one split or all; readers of a split touch its files only."""
    both = tuple(spark.read.parquet(f"{path}/{n}") for n in ("images", "annotations"))
    return both if split is None else tuple(t.where(F.col("split") == split) for t in both)


def grouped_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Each image with its annotations in order; images without any keep an empty list."""
    listed = annotations.groupBy("split", "image_id").agg(F.array_sort(F.collect_list(F.struct("id", "category_id", "segmentation", "area", "bbox", "iscrowd"))).alias("annotations"))
    met = images.join(listed.withColumnRenamed("image_id", "id"), ["split", "id"], "left")
    return met.withColumn("annotations", F.coalesce("annotations", F.array()))
