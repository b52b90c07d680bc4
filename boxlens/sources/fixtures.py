"""Detections, ground truth and cache rows derived from the supplied tables; stand-ins, no image data. SQL of the same for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlens.operators.ranking import number_rows

WIDTH, HEIGHT, IMAGES, CLASSES = 500, 375, 200, 20
DET_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]

DET_SQL = """det AS (
  SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS det_id,
    l_orderkey % 200 AS image_id, l_suppkey % 20 AS cls_id, CAST(l_linenumber % 3 + 1 AS BIGINT) AS comp,
    (l_partkey * 7) % 520 - 20 AS x1, (l_suppkey * 13 + l_linenumber * 37) % 400 - 20 AS y1,
    (l_partkey * 7) % 520 - 20 + 19 + CAST(l_quantity AS BIGINT) * 3 AS x2,
    (l_suppkey * 13 + l_linenumber * 37) % 400 - 20 + 19 + (l_partkey % 50) * 3 AS y2,
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 4000 - 2000 AS DOUBLE) / 1000.0 AS score
  FROM lineitem)"""

GT_SQL = """gt AS (
  SELECT o_orderkey AS gt_id, o_orderkey % 200 AS image_id, o_custkey % 20 AS cls_id,
    1 + (o_orderkey * 11) % 400 AS x1, 1 + (o_custkey * 17) % 300 AS y1,
    least(500, 1 + (o_orderkey * 11) % 400 + 39 + (o_custkey % 40) * 3) AS x2,
    least(375, 1 + (o_custkey * 17) % 300 + 39 + (o_orderkey % 40) * 3) AS y2,
    o_orderstatus = 'P' AS difficult, o_orderpriority = '5-LOW' AS truncated
  FROM orders)"""

CLIP_SQL = """clip AS (
  SELECT det_id, image_id, cls_id, comp, greatest(x1, 1) AS x1, greatest(y1, 1) AS y1, least(x2, 500) AS x2, least(y2, 375) AS y2, score
  FROM det WHERE least(x2, 500) >= greatest(x1, 1) AND least(y2, 375) >= greatest(y1, 1))"""

CACHE_SQL = """cache_info AS (
  SELECT det_id AS eid, image_id AS dataid, cls_id AS scale, comp AS x, (x1 + 20) % 7 AS y, 0 AS is_belief, CASE WHEN det_id % 3 <> 0 THEN 1 ELSE 0 END AS is_mined,
    4 * (x2 - x1 + 1) AS byte_size, score AS margin FROM det
  UNION ALL
  SELECT -min(det_id), image_id, cls_id, comp, (x1 + 20) % 7, 1, 1, 0, 0.0 FROM det WHERE det_id % 3 <> 0 GROUP BY image_id, cls_id, comp, (x1 + 20) % 7)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def version(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a path's files, so that what is remembered of it ends when it is written anew."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in system.listStatus(at))


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    memo = ("det", spark.conf.get("spark.sql.shuffle.partitions"), *version(spark, f"{sf_dir}/lineitem.parquet"))
    rows = number_rows(read(spark, sf_dir, "lineitem"), DET_ORDER, "det_id", memo=memo)
    return rows.selectExpr(
        "det_id", "l_orderkey % 200 AS image_id", "l_suppkey % 20 AS cls_id", "CAST(l_linenumber % 3 + 1 AS BIGINT) AS comp",
        "(l_partkey * 7) % 520 - 20 AS x1", "(l_suppkey * 13 + l_linenumber * 37) % 400 - 20 AS y1",
        "(l_partkey * 7) % 520 - 20 + 19 + CAST(l_quantity AS BIGINT) * 3 AS x2", "(l_suppkey * 13 + l_linenumber * 37) % 400 - 20 + 19 + (l_partkey % 50) * 3 AS y2",
        "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 4000 - 2000 AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS score",
    )


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS gt_id", "o_orderkey % 200 AS image_id", "o_custkey % 20 AS cls_id", "1 + (o_orderkey * 11) % 400 AS x1", "1 + (o_custkey * 17) % 300 AS y1",
        "least(500, 1 + (o_orderkey * 11) % 400 + 39 + (o_custkey % 40) * 3) AS x2", "least(375, 1 + (o_custkey * 17) % 300 + 39 + (o_orderkey % 40) * 3) AS y2",
        "o_orderstatus = 'P' AS difficult", "o_orderpriority = '5-LOW' AS truncated",
    )


def cache_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = det(spark, sf_dir)
    rows = d.selectExpr("det_id AS eid", "image_id AS dataid", "cls_id AS scale", "comp AS x", "(x1 + 20) % 7 AS y", "0 AS is_belief", "CASE WHEN det_id % 3 <> 0 THEN 1 ELSE 0 END AS is_mined", "4 * (x2 - x1 + 1) AS byte_size", "score AS margin")
    beliefs = rows.where("is_mined = 1").groupBy("dataid", "scale", "x", "y").agg((-F.min("eid")).alias("eid"))
    beliefs = beliefs.select("eid", "dataid", "scale", "x", "y", F.lit(1).alias("is_belief"), F.lit(1).alias("is_mined"), F.lit(0).cast("long").alias("byte_size"), F.lit(0.0).alias("margin"))
    return rows.unionByName(beliefs)


#: Scenes: wide images, one for SCENE_ORDERS orders, so that there are more of them as tables grow; a few of their boxes are very large.
SCENE_ORDERS, SCENE_SIDE = 64, 2000
_W_SIZE = "CASE WHEN l_orderkey % 97 = 0 THEN 12 ELSE 1 END"
_B_SIZE = "CASE WHEN o_orderkey % 50 = 0 THEN 15 ELSE 1 END"
_W_X, _W_Y = f"(l_partkey * 7919 + l_linenumber * 3571 + l_orderkey * 31) % {SCENE_SIDE}", f"(l_suppkey * 7919 + l_orderkey * 104729 + l_linenumber * 37) % {SCENE_SIDE}"
_B_X, _B_Y = f"(o_orderkey * 7919 + o_custkey * 31) % {SCENE_SIDE}", f"(o_custkey * 7919 + o_orderkey * 104729) % {SCENE_SIDE}"

SCENE_SQL = f"""windows AS (
  SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS window_id, l_orderkey // {SCENE_ORDERS} AS image_id,
    {_W_X} AS x1, {_W_Y} AS y1, {_W_X} + (19 + CAST(l_quantity AS BIGINT) * 3) * {_W_SIZE} AS x2, {_W_Y} + (19 + (l_partkey % 50) * 3) * {_W_SIZE} AS y2,
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 4000 - 2000 AS DOUBLE) / 1000.0 AS score FROM lineitem),
boxes AS (
  SELECT o_orderkey AS box_id, o_orderkey // {SCENE_ORDERS} AS image_id, {_B_X} AS x1, {_B_Y} AS y1, {_B_X} + (39 + (o_custkey % 40) * 3) * {_B_SIZE} AS x2, {_B_Y} + (39 + (o_orderkey % 40) * 3) * {_B_SIZE} AS y2 FROM orders)"""


def scene_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    memo = ("det", spark.conf.get("spark.sql.shuffle.partitions"), *version(spark, f"{sf_dir}/lineitem.parquet"))
    rows = number_rows(read(spark, sf_dir, "lineitem"), DET_ORDER, "window_id", memo=memo)
    return rows.selectExpr(
        "window_id", f"l_orderkey div {SCENE_ORDERS} AS image_id", f"{_W_X} AS x1", f"{_W_Y} AS y1",
        f"{_W_X} + (19 + CAST(l_quantity AS BIGINT) * 3) * {_W_SIZE} AS x2", f"{_W_Y} + (19 + (l_partkey % 50) * 3) * {_W_SIZE} AS y2",
        "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 4000 - 2000 AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS score",
    )


def scene_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS box_id", f"o_orderkey div {SCENE_ORDERS} AS image_id", f"{_B_X} AS x1", f"{_B_Y} AS y1",
        f"{_B_X} + (39 + (o_custkey % 40) * 3) * {_B_SIZE} AS x2", f"{_B_Y} + (39 + (o_orderkey % 40) * 3) * {_B_SIZE} AS y2",
    )
