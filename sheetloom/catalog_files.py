"""Queries of sources and sinks: rows of the driver's tables are written in each format, read back, and compared with the rows themselves.

Files lie in the session's shared folder. The SQL selects the same rows from the tables, without any file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dimensions
from .catalog import _r, _t, query
from .functions import geometry as G
from .functions import text as X
from .operators import filters, graph
from .shared import fresh_path
from .sources import arrays, readers, writers


def _documents(spark, rows: DataFrame, name: str) -> str:
    """``rows`` (doc, value) as text files, one a row, under a folder named by ``doc``."""
    path = fresh_path(spark, name)
    rows.select("doc", "value").repartition("doc").write.partitionBy("doc").text(path)
    return path


# parcels, as JSON documents by sheet

_ITEMS = """p AS (SELECT (43 + p_partkey % 7)::VARCHAR AS map_num, p_partkey::INT AS parcel_id, p_retailprice::DOUBLE AS cx, p_size * 10.0::DOUBLE AS cy, p_size::INT AS x, (2 * p_size)::INT AS y,
 (p_partkey % 90 + 10)::INT AS w, (p_partkey % 70 + 10)::INT AS h, (p_partkey * 37 % 3000)::DOUBLE AS mask_area_px, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 100) / 100.0::DOUBLE END AS confidence,
 CASE WHEN p_partkey % 3 <> 0 THEN 4 WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END AS vertices, CASE WHEN p_partkey % 4 = 0 THEN (2000 + p_partkey % 1000)::INT END AS detected_number FROM part)"""
_PARCEL = "map_num, parcel_id, round(cx, 6) AS cx, round(cy, 6) AS cy, (w * h)::DOUBLE AS area_px, confidence, detected_number, vertices::INT AS vertices"


PAGE = 10_000  # parcels of a document, about; a sheet of more has several, as a document is one task


def _parcel_files(spark, d) -> str:
    k, s = F.col("p_partkey"), F.col("p_size")
    corner = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    x, y, w, h = s, 2 * s, k % 90 + 10, k % 70 + 10
    corners = F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h))
    item = F.struct(
        k.cast("int").alias("parcel_id"), F.col("p_retailprice").cast("double").alias("cx"), (s * 10).cast("double").alias("cy"), F.array(*[c.cast("int") for c in (x, y, w, h)]).alias("bbox"),
        (k * 37 % 3000).cast("double").alias("mask_area_px"), F.when(k % 5 != 0, (k % 100) / 100).alias("confidence"),
        F.slice(corners, 1, F.when(k % 3 != 0, 4).when(k % 2 == 0, 3).otherwise(2)).alias("polygon"), F.when(k % 4 == 0, (2000 + k % 1000).cast("int")).alias("detected_number"),
    )
    part = _t(spark, d, "part")
    page = F.pmod(F.xxhash64(k), F.lit(part.count() // (7 * PAGE) + 1)).cast("string")
    items = part.select(F.concat(F.lit("map_"), (43 + k % 7).cast("string"), F.lit("_parcels-"), page).alias("doc"), item.alias("item"))
    listed = items.groupBy("doc").agg(F.sort_array(F.collect_list("item")).alias("items"))
    bare = F.to_json("items")
    return _documents(spark, listed.select("doc", F.when(F.col("doc").contains("_44_"), F.concat(F.lit('{"parcels":'), bare, F.lit("}"))).otherwise(bare).alias("value")), "parcel-files")


def _parcel_rows(df: DataFrame) -> DataFrame:
    return df.select("map_num", "parcel_id", _r("cx", "cx"), _r("cy", "cy"), "area_px", "confidence", "detected_number", F.size("polygon").alias("vertices"))


@query(f"WITH {_ITEMS} SELECT {_PARCEL} FROM p")
def read_parcels(spark, d):
    return _parcel_rows(readers.parcels(spark, _parcel_files(spark, d)))


@query(f"WITH {_ITEMS} SELECT {_PARCEL} FROM p WHERE coalesce(confidence, 1) >= 0.35")
def read_confident_parcels(spark, d):
    return _parcel_rows(readers.confident_parcels(spark, _parcel_files(spark, d)))


@query(f"WITH {_ITEMS} SELECT {_PARCEL} FROM p WHERE vertices >= 3 AND mask_area_px >= 800")
def read_shaped_parcels(spark, d):
    return _parcel_rows(readers.shaped_parcels(spark, _parcel_files(spark, d)))


@query(f"WITH {_ITEMS} SELECT {_PARCEL} FROM p WHERE vertices >= 4 AND coalesce(nullif(mask_area_px, 0), w * h) >= 1000")
def read_signed_parcels(spark, d):
    return _parcel_rows(readers.signed_parcels(spark, _parcel_files(spark, d)))


@query(f"WITH {_ITEMS} SELECT {_PARCEL} FROM p WHERE detected_number IS NOT NULL")
def read_annotated_parcels(spark, d):
    return _parcel_rows(readers.annotated_parcels(spark, _parcel_files(spark, d)))


@query(f"WITH {_ITEMS} SELECT map_num, parcel_id, round(cx, 2) AS cx, round(round(cy, 2), 6) AS cy, round(confidence, 4) AS confidence FROM p")
def written_parcels(spark, d):
    path = fresh_path(spark, "written-parcels")
    p = readers.parcels(spark, _parcel_files(spark, d))
    writers.write_parcels(p.select("map_num", "parcel_id", "cx", "cy", "confidence", "area_px"), path)
    return spark.read.schema("map_num string, parcel_id int, cx double, cy double, confidence double").json(path).select("map_num", "parcel_id", _r("cx", "cx"), _r("cy", "cy"), "confidence")


# transforms, scores, reports and clicks, as JSON documents

_PAIRS = "x AS (SELECT n_nationkey AS k, n_nationkey::VARCHAR AS map_a, (n_nationkey + 1)::VARCHAR AS map_b FROM nation)"


def _pairs(spark, d) -> DataFrame:
    k = F.col("n_nationkey").cast("int")
    return _t(spark, d, "nation").select(k.alias("k"), k.cast("string").alias("map_a"), (k + 1).cast("string").alias("map_b"))


@query(f"WITH {_PAIRS} SELECT map_a || '_' || map_b AS pair, map_a, map_b, (10 * k)::DOUBLE AS dx, (k / 4.0)::DOUBLE AS dy, k::INT AS shift FROM x WHERE k % 5 <> 0")
def read_homographies(spark, d):
    k = F.col("k")
    row = lambda *v: F.array(*[F.lit(x).cast("double") if not hasattr(x, "cast") else x.cast("double") for x in v])
    whole, short = F.array(row(1, 0, 10 * k), row(0, 1, k / 4), row(0, 0, 1)), F.array(row(1, 0, 0), row(0, 1, 0))
    value = F.struct(F.when(k % 2 == 0, F.col("map_a")).alias("map_a"), k.cast("double").alias("shift_px"), F.when(k % 5 != 0, whole).when(k % 10 == 0, short).alias("H"))
    entries = _pairs(spark, d).groupBy().agg(F.map_from_entries(F.collect_list(F.struct(X.pair_key(F.col("map_a"), F.col("map_b")), value))).alias("m"))
    found = readers.homographies(spark, _documents(spark, entries.select(F.lit("homographies").alias("doc"), F.to_json("m").alias("value")), "homographies"))
    return found.select("pair", "map_a", "map_b", F.col("h")[2].alias("dx"), F.col("h")[5].alias("dy"), F.col("shift_px").cast("int").alias("shift"))


@query(f"WITH {_PAIRS} SELECT map_a, map_b, CASE k % 2 WHEN 0 THEN 'left' ELSE 'top' END AS edge_a, (90 * (k % 4))::DOUBLE AS total_rot, (k / 32.0)::DOUBLE AS combined_score FROM x WHERE k % 7 <> 0")
def read_pair_scores(spark, d):
    k = F.col("k")
    best = F.struct(F.when(k % 2 == 0, "left").otherwise("top").alias("edge_a"), (90 * (k % 4)).cast("double").alias("total_rot"), (k / 32).alias("combined_score"))
    docs = _pairs(spark, d).select(X.pair_key(F.col("map_a"), F.col("map_b")).alias("doc"), F.to_json(F.struct("map_a", "map_b", F.when(k % 7 != 0, best).alias("best"))).alias("value"))
    return readers.pair_scores(spark, _documents(spark, docs, "scores")).select("map_a", "map_b", "edge_a", "total_rot", "combined_score")


@query("SELECT (n_regionkey + 40)::VARCHAR AS map_num, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INT AS rank, n_name AS other, (n_nationkey / 32.0)::DOUBLE AS score FROM nation")
def read_score_report(spark, d):
    n = _t(spark, d, "nation")
    entry = F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("map"), (F.col("n_nationkey") / 32).alias("score"))
    listed = n.groupBy((F.col("n_regionkey") + 40).cast("string").alias("map_num")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["map"].alias("map"), e["score"].alias("score"))).alias("l"))
    doc = listed.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("map_num", "l"))).alias("m")).select(F.lit("report").alias("doc"), F.to_json("m").alias("value"))
    return readers.score_report(spark, _documents(spark, doc, "report")).select("map_num", F.col("rank").cast("int").alias("rank"), "other", "score")


@query(f"""WITH {_PAIRS} SELECT map_a || '_' || map_b AS pair, 'a' AS side, (100 + k)::INT AS number, k::DOUBLE AS x, (2 * k)::DOUBLE AS y FROM x WHERE k % 3 = 0
UNION ALL SELECT map_a || '_' || map_b, 'b', (100 + k + i)::INT, (k + i)::DOUBLE, 0.5::DOUBLE FROM x, range(2) AS r(i)""")
def read_clicks(spark, d):
    k = F.col("k")
    point = lambda n, x, y: F.struct((100 + n).cast("string").alias("key"), F.array(x.cast("double"), y.cast("double")).alias("value"))
    a = F.map_from_entries(F.when(k % 3 == 0, F.array(point(k, k, 2 * k))).otherwise(F.array().cast("array<struct<key:string,value:array<double>>>")))
    b = F.map_from_entries(F.array(*[point(k + i, k + i, F.lit(0.5)) for i in range(2)]))
    docs = _pairs(spark, d).select(X.pair_key(F.col("map_a"), F.col("map_b")).alias("doc"), F.to_json(F.struct("map_a", "map_b", a.alias("clicks_a"), b.alias("clicks_b"))).alias("value"))
    return readers.clicks(spark, _documents(spark, docs, "clicks"))


# graphs, keypoints, annotated sets, manifests

_GRAPH = """g AS (SELECT (n_regionkey + 40)::VARCHAR AS map_num, n_nationkey AS id, n_name || ' <&> "' || n_regionkey || '"' AS label, n_nationkey / 8.0::DOUBLE AS weight FROM nation),
e AS (SELECT a.map_num, a.id AS src, b.id AS dst, (b.id - a.id)::DOUBLE AS distance FROM g a JOIN g b ON a.map_num = b.map_num AND a.id < b.id)"""


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    k = F.col("n_nationkey")
    label = F.concat("n_name", F.lit(' <&> "'), F.col("n_regionkey").cast("string"), F.lit('"'))
    nodes = _t(spark, d, "nation").select((F.col("n_regionkey") + 40).cast("string").alias("map_num"), k.alias("id"), label.alias("label"), (k / 8).alias("weight"))
    a, b = (nodes.select("map_num", F.col("id").alias(n)) for n in ("src", "dst"))
    return nodes, a.join(b, "map_num").where("src < dst").withColumn("distance", (F.col("dst") - F.col("src")).cast("double"))


def _graph_files(spark, d) -> str:
    doc = writers.graphml_document(*_graph(spark, d))
    return _documents(spark, doc.select(F.col("map_num").alias("doc"), F.col("document").alias("value")), "graphs")


@query(f"WITH {_GRAPH} SELECT id::VARCHAR AS id, label, weight FROM g")
def graph_file_nodes(spark, d):
    nodes, _ = readers.graphml(spark, _graph_files(spark, d))
    return nodes.select("id", F.col("attributes")["label"].alias("label"), F.col("attributes")["weight"].cast("double").alias("weight"))


@query(f"WITH {_GRAPH} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, distance FROM e")
def graph_file_edges(spark, d):
    _, edges = readers.graphml(spark, _graph_files(spark, d))
    return edges.select("src", "dst", F.col("attributes")["distance"].cast("double").alias("distance"))


@query(f"WITH {_GRAPH} SELECT map_num, count(DISTINCT id) AS n_nodes, (count(DISTINCT id) * (count(DISTINCT id) - 1)) // 2 AS n_edges, max(id) AS last_node FROM g GROUP BY map_num")
def graph_documents(spark, d):
    path = fresh_path(spark, "graph-documents")
    writers.write_graph(*_graph(spark, d), path)
    doc = F.from_json("document", "nodes array<struct<id:long>>, edges array<struct<src:long,dst:long>>")
    return spark.read.parquet(path).select("map_num", doc.alias("x")).select("map_num", F.size("x.nodes").cast("long").alias("n_nodes"), F.size("x.edges").cast("long").alias("n_edges"), F.element_at("x.nodes", -1)["id"].alias("last_node"))


@query(f"""WITH {_GRAPH}, b AS (SELECT map_num, min(weight) AS lo, max(weight) AS hi FROM g GROUP BY map_num)
SELECT map_num, id, round((weight - lo) / greatest(hi - lo, 1e-8), 6) AS x, (SELECT count(*) FROM e WHERE src = id) + (SELECT count(*) FROM e WHERE dst = id) AS n_out FROM g JOIN b USING (map_num)""")
def graph_tensors(spark, d):
    vectors, both = graph.tensor_graph(*_graph(spark, d), ["weight"])
    out = both.groupBy("map_num", F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    return vectors.join(out, ["map_num", "id"], "left").select("map_num", "id", _r(F.col("x")[0], "x"), F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"))


def _keypoint_rows(spark, d) -> DataFrame:
    e, zero = _t(spark, d, "embeddings"), F.lit(0)
    return e.select(
        F.col("label").cast("string").alias("map_num"), F.lit("d").alias("detector"), F.col("vec_id").cast("int").alias("kp_id"), *[F.col("embedding")[0].cast("float").alias(c) for c in ("x", "y", "size", "angle", "response")],
        zero.alias("octave"), zero.alias("class_id"), F.transform("embedding", lambda v: v.cast("float")).alias("descriptor"),
    )


def _keypoint_sums(k: DataFrame, *ids: str) -> DataFrame:
    total = F.aggregate("descriptor", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return k.select("map_num", *ids, _r(F.col("size").cast("double"), "size"), F.round(total, 4).alias("total"))


@query("SELECT label::VARCHAR AS map_num, vec_id::INT AS kp_id, round(embedding[1]::DOUBLE, 6) AS size, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def read_keypoints(spark, d):
    path = fresh_path(spark, "keypoints")
    _keypoint_rows(spark, d).write.parquet(path)
    return _keypoint_sums(readers.keypoints(spark, path), "kp_id")


@query("""WITH k AS (SELECT label::VARCHAR AS map_num, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS kp_id, embedding FROM embeddings)
SELECT map_num, kp_id::INT AS kp_id, round(embedding[1]::DOUBLE, 6) AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM k""")
def keypoint_archives(spark, d):
    """Written as one archive a sheet and read back; ids count from 0 in a sheet."""
    path = fresh_path(spark, "keypoint-archives")
    arrays.write_keypoints_npz(_keypoint_rows(spark, d), path).write.format("noop").mode("overwrite").save()
    return _keypoint_sums(arrays.keypoints_npz(spark, path), "kp_id")


_ANNOTATED = ("""SELECT s_nationkey AS id, n_name || '.png' AS file_name, count(*) AS n, min(s_suppkey) AS first_id, sum(round(s_acctbal, 2)) > 0 AS positive FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""")


def _annotated_document(spark, d) -> str:
    n, s = _t(spark, d, "nation"), _t(spark, d, "supplier")
    used = n.join(s.select(F.col("s_nationkey").alias("n_nationkey")).distinct(), "n_nationkey")
    images = used.select(F.lit("train").alias("split"), F.col("n_nationkey").cast("long").alias("id"), F.concat("n_name", F.lit(".png")).alias("file_name"), F.lit(5).alias("width"), F.lit(6).alias("height"))
    annotations = s.select(
        F.lit("train").alias("split"), F.col("s_suppkey").cast("long").alias("id"), F.col("s_nationkey").cast("long").alias("image_id"), F.lit(1).alias("category_id"),
        F.array(F.array(F.lit(0.0), F.lit(1.0))).alias("segmentation"), F.round("s_acctbal", 2).cast("double").alias("area"), F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("bbox"), F.lit(0).alias("iscrowd"),
    )
    doc = writers.coco_document(images, annotations, F.expr("array(named_struct('id', 1, 'name', 'parcel'))"))
    path = _documents(spark, doc.select(F.col("split").alias("doc"), F.col("document").alias("value")), "annotated")
    return path


def _annotated_rows(images: DataFrame, annotations: DataFrame) -> DataFrame:
    grouped = readers.grouped_annotations(images, annotations)
    each = grouped.select("id", "file_name", F.col("annotations").alias("a"))
    total = F.aggregate("a", F.lit(0.0), lambda t, x: t + x["area"])
    return each.select("id", "file_name", F.size("a").cast("long").alias("n"), F.col("a")[0]["id"].alias("first_id"), (total > 0).alias("positive"))


@query(_ANNOTATED)
def annotated_set(spark, d):
    return _annotated_rows(*readers.coco(spark, _annotated_document(spark, d), "train"))


@query(_ANNOTATED)
def annotated_elements(spark, d):
    """The same set read by byte ranges of its one document."""
    file = next(f for f in spark.read.text(_annotated_document(spark, d)).inputFiles())
    return _annotated_rows(*readers.coco_elements(spark, file, "train", 1 << 14))



@query("""SELECT (CASE WHEN n_regionkey < 3 THEN 'train' ELSE 'val' END) AS split, n_nationkey AS id, n_name AS file_name, count(s_suppkey) AS n, coalesce(sum(s_suppkey), 0)::BIGINT AS total
 FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey < 3 GROUP BY ALL""")
def annotated_tables(spark, d):
    """The training split of an annotated set kept as tables."""
    n, s = _t(spark, d, "nation"), _t(spark, d, "supplier")
    split = F.when(F.col("n_regionkey") < 3, "train").otherwise("val").alias("split")
    images = n.select(split, F.col("n_nationkey").alias("id"), F.col("n_name").alias("file_name"))
    annotations = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        split, F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("image_id"), F.lit(1).alias("category_id"), F.array(F.array(F.lit(0.0))).alias("segmentation"), F.lit(1.0).alias("area"), F.array(F.lit(1)).alias("bbox"), F.lit(0).alias("iscrowd")
    )
    path = fresh_path(spark, "annotated-tables")
    writers.write_annotated(images, annotations, path)
    grouped = readers.grouped_annotations(*readers.annotated(spark, path, "train"))
    total = F.aggregate("annotations", F.lit(0).cast("long"), lambda t, x: t + x["id"])
    return grouped.select("split", "id", "file_name", F.size("annotations").cast("long").alias("n"), total.alias("total"))


@query("""SELECT n_regionkey AS root, array_to_string(list_sort(list(n_name)), ',') AS maps, (100 * max(n_nationkey) - 10 * min(n_nationkey))::INT AS width, (max(n_nationkey) + 5)::INT AS height FROM nation GROUP BY n_regionkey""")
def canvas_manifest(spark, d):
    n, k = _t(spark, d, "nation"), F.col("n_nationkey")
    boxes = n.groupBy(F.col("n_regionkey").alias("root")).agg((10 * F.min(k)).alias("x_min"), (100 * F.max(k)).alias("x_max"), F.lit(-5).alias("y_min"), F.max(k).alias("y_max"))
    m = writers.manifest(n.select(F.col("n_regionkey").alias("root"), F.col("n_name").alias("node")), boxes, ["root"])
    return m.select("root", F.array_join("maps", ",").alias("maps"), F.col("canvas_size")[0].cast("int").alias("width"), F.col("canvas_size")[1].cast("int").alias("height"))


# logs, CSV, documents, rounding, keys


@query("SELECT event_id, event_type, value, (user_id % 50)::INT AS parcel_id FROM events UNION ALL SELECT event_id + 1000000000, event_type, value, (user_id % 50)::INT FROM events")
def appended_log(spark, d):
    path = fresh_path(spark, "log")
    e = _t(spark, d, "events").select("event_id", "event_type", "value", (F.col("user_id") % 50).cast("int").alias("parcel_id"))
    writers.append_log(e, path)
    writers.append_log(e.withColumn("event_id", F.col("event_id") + 1_000_000_000), path)
    return spark.read.schema("event_id long, event_type string, value double, parcel_id int").json(path)


@query("SELECT c_custkey AS k, c_custkey || ';' || c_nationkey AS pair, round(c_acctbal::DOUBLE, 1) AS balance, c_mktsegment AS segment FROM customer")
def written_csv(spark, d):
    path = fresh_path(spark, "csv")
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.array("c_custkey", "c_nationkey").alias("pair"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_mktsegment").alias("segment"), F.lit(1).alias("extra"))
    writers.write_csv(c, path, ["k", "pair", "balance", "segment"], {"balance": 1})
    return spark.read.option("header", True).schema("k long, pair string, balance double, segment string").csv(path)


@query("SELECT s_nationkey::INT AS pair, s_suppkey AS k, s_name AS name FROM supplier")
def written_documents(spark, d):
    path = fresh_path(spark, "documents")
    writers.write_documents(_t(spark, d, "supplier").select(F.col("s_nationkey").alias("pair"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), path)
    return spark.read.schema("k long, name string, pair int").json(path)


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * 1.017::DOUBLE, 1) AS price, round(l_discount * 1.03::DOUBLE, 3) AS discount FROM lineitem")
def rounded_values(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice").cast("double") * 1.017).alias("price"), (F.col("l_discount").cast("double") * 1.03).alias("discount"))
    return writers.rounded(rows, {"price": 1, "discount": 3})


@query(f"WITH {_PAIRS} SELECT map_a || '_' || map_b AS pair, map_a, map_b FROM x")
def pair_keys(spark, d):
    named = _pairs(spark, d).select(X.pair_key(F.col("map_a"), F.col("map_b")).alias("pair"))
    a, b = X.pair_sides(F.col("pair"))
    return named.select("pair", a.alias("map_a"), b.alias("map_b"))


@query("""WITH o AS (SELECT c_custkey AS k, c_acctbal::DOUBLE AS v FROM customer), n AS (SELECT s_suppkey AS k, s_suppkey::DOUBLE AS v FROM supplier)
SELECT k, v FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT k, v FROM n""")
def swapped_upsert(spark, d):
    """New rows come three times with a sequence number; the last one counts, and the table is swapped in whole."""
    path = fresh_path(spark, "upsert")
    _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("double").alias("v"), F.lit(0).alias("seq")).write.parquet(path)
    s = F.col("s_suppkey")
    new = _t(spark, d, "supplier").select(s.alias("k"), F.inline(F.array(*[F.struct((s + v).cast("double").alias("v"), F.lit(q).alias("seq")) for q, v in ((9, 5), (10, 0), (2, 7))])))
    writers.upsert(spark.read.parquet(path), new, ["k"], path, "seq")
    return spark.read.parquet(path).select("k", "v")


# small tables

_RANGES = ", ".join(f"('{m}', {lo}, {hi})" for m, (lo, hi) in dimensions.NUMBER_RANGES.items())
_NEAR = ", ".join(f"('{a}', '{b}')" for a, b in dimensions.NEIGHBOURS)


@query(f"""SELECT m AS map_num, lo::INT AS lo, hi::INT AS hi, (SELECT count(*) FROM (VALUES {_NEAR}) AS t(a, b) WHERE a = m OR b = m) AS n_near,
 (SELECT count(*) FROM part WHERE 2000 + p_partkey * 7 % 2000 BETWEEN lo AND hi) AS n_parts FROM (VALUES {_RANGES}) AS r(m, lo, hi)""")
def dimension_tables(spark, d):
    """Each sheet's range and neighbours, and how many parts have a number in its range."""
    near = dimensions.neighbours(spark)
    each = near.select(F.explode(F.array("map_a", "map_b")).alias("map_num")).groupBy("map_num").agg(F.count("*").alias("n_near"))
    ranges = dimensions.number_ranges(spark)
    parts = _t(spark, d, "part").select((2000 + F.col("p_partkey") * 7 % 2000).alias("number")).join(F.broadcast(ranges), F.col("number").between(F.col("lo"), F.col("hi")))  # a row a sheet
    counted = ranges.join(each, "map_num", "left").join(parts.groupBy("map_num").agg(F.count("*").alias("n_parts")), "map_num", "left")
    return counted.select("map_num", "lo", "hi", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_near", "n_parts")])


@query("SELECT event_type AS map_num, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') AND event_id % 7 <> 0 GROUP BY event_type")
def excluded_rows(spark, d):
    """The exclusion list and the exclusion of rows with errors."""
    e = _t(spark, d, "events").select(F.col("event_type").alias("map_num"), F.when(F.col("event_id") % 7 == 0, "broken").alias("error_msg"))
    return filters.without_errors(filters.without(e, ["view", "click"])).groupBy("map_num").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS parcel_id, (s_acctbal > 0 AND s_suppkey % 3 <> 0) AS is_outline FROM supplier""")
def sheet_outlines(spark, d):
    """Contours that can be the sheet itself: a third of it at least, with four corners."""
    k = F.col("s_suppkey")
    corner = G.F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))
    corners = F.when(k % 3 != 0, F.array(*[corner] * 4)).otherwise(F.array(*[corner] * 3))
    s = _t(spark, d, "supplier").select(k.alias("parcel_id"), F.when(F.col("s_acctbal") > 0, 300.0).otherwise(200.0).alias("area"), corners.alias("corners"))
    return s.select("parcel_id", filters.is_sheet_outline(F.col("area"), F.col("corners"), F.lit(1000.0)).alias("is_outline"))
