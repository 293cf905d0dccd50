"""Detection tables made from the star-schema tables, by SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")



def sequence(key: str) -> str:
    """Twenty sequences side by side, and twenty new ones after each 751 frames: a sequence is bounded, their number grows with the tables."""
    return f"concat('s', CAST({key} % 20 + 20 * CAST(floor({key} / 15020.0) AS BIGINT) AS STRING))"


#: One row per box. (l_orderkey, l_linenumber) repeats, so boxes are numbered inside their image.
DETECTIONS = f"""
SELECT l_orderkey * 1000 + rn AS det_id, {sequence('l_orderkey')} AS seq, l_orderkey AS image_id,
       CAST(floor(l_orderkey / 20.0) AS BIGINT) AS frame,
       CAST(l_partkey * 37 % 300 AS DOUBLE) AS l, CAST((l_suppkey * 53 + l_linenumber * 17) % 300 AS DOUBLE) AS t,
       CAST(5 + l_partkey % 56 AS DOUBLE) AS w, CAST(5 + CAST(l_quantity AS BIGINT) * 7 % 116 AS DOUBLE) AS h,
       CAST(l_discount AS DOUBLE) * 10 AS conf,
       CASE WHEN l_returnflag <> 'N' THEN l_suppkey % 25 END AS track_id,
       CASE WHEN l_partkey % 50 <> 0 THEN (l_partkey % 1300) / 10.0E0 - 65.0E0 END AS px,
       CASE WHEN l_partkey % 50 <> 0 THEN ((l_suppkey * 7 + l_partkey) % 900) / 10.0E0 - 45.0E0 END AS py,
       CASE WHEN l_partkey % 3 > 0 THEN CAST(l_partkey % 99 + 1 AS STRING) END AS number
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem) x
"""

#: One row per image.
FRAMES = f"""
SELECT DISTINCT {sequence('o_orderkey')} AS seq, o_orderkey AS image_id, CAST(floor(o_orderkey / 20.0) AS BIGINT) AS frame,
       concat('data/', {sequence('o_orderkey')}, '/img1/', lpad(CAST(CAST(floor(o_orderkey / 20.0) AS BIGINT) AS STRING), 8, '0'), '.jpg') AS file_path,
       CAST(o_custkey % 101 AS DOUBLE) / 100.0E0 AS score, CAST(o_custkey % 90 AS DOUBLE) - 45.0E0 AS pan, CAST(60 + o_custkey % 30 AS DOUBLE) AS tilt,
       CAST(30 + o_custkey % 40 AS DOUBLE) AS hfov, o_custkey % 7 > 0 AS listed
FROM (SELECT o_orderkey, min(o_custkey) AS o_custkey FROM orders GROUP BY o_orderkey) x
"""

#: One row per tracked box, one box per (image, track).
TRACKED = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, track_id ORDER BY det_id) AS dup FROM ({DETECTIONS}) d WHERE track_id IS NOT NULL) e WHERE dup = 1
"""


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    return spark.sql(DETECTIONS)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return spark.sql(FRAMES)


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    return spark.sql(TRACKED)
