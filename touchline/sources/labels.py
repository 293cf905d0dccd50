"""Game-state label files, one JSON document a sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.text import basename, grandparent, label, namespaced

# Name of the label file of a sequence (fixed value).
FILE = "Labels-GameState.json"
SCHEMA = """info struct<num_tracklets: string>,
images array<struct<image_id: string, id: string, file_name: string>>,
annotations array<struct<image_id: string, track_id: string, bbox_image: struct<x: double, y: double, x_topleft: double, y_topleft: double, w: double, h: double>, attributes: struct<role: string, jersey: string>>>"""
ROLES = ("player", "goalkeeper")


def read(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """Label documents below root with their path and sequence; split keeps paths with a directory of that name."""
    docs = spark.read.schema(SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", FILE).json(root)
    docs = docs.withColumn("path", F.input_file_name()).withColumn("seq", F.element_at(F.split("path", "/"), -2))
    return docs.where(F.lower("path").contains(f"/{split.lower()}/")) if split else docs


def tracklets(docs: DataFrame) -> DataFrame:
    """Declared tracklets of all sequences; a field that is no number counts 0."""
    return docs.agg(F.sum(F.coalesce(F.col("info.num_tracklets").try_cast("int"), F.lit(0))).alias("tracklets"))


def boxes(docs: DataFrame) -> DataFrame:
    """seq, track (namespaced), number, frame_path, l, t, w, h of players and keepers.

    Annotations of other roles, without a whole box or without a known image are left out.
    """
    dir_ = F.regexp_replace("path", "/[^/]+$", "")
    images = docs.select("seq", dir_.alias("dir"), F.explode("images").alias("i")).select("seq", F.coalesce("i.image_id", "i.id").alias("image_id"), F.concat("dir", F.lit("/img1/"), basename(F.col("i.file_name"))).alias("frame_path"))
    a = docs.select("seq", F.explode("annotations").alias("a")).where(F.col("a.attributes.role").isin(*ROLES))
    b = F.col("a.bbox_image")
    a = a.select("seq", F.col("a.image_id").alias("image_id"), namespaced(F.col("seq"), F.col("a.track_id")).alias("track"), label(F.col("a.attributes.jersey")).alias("number"), F.coalesce(b["x"], b["x_topleft"]).alias("l"), F.coalesce(b["y"], b["y_topleft"]).alias("t"), b["w"].alias("w"), b["h"].alias("h"))
    return a.where("l IS NOT NULL AND t IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL").join(images, ["seq", "image_id"])


def pool(rows: DataFrame) -> DataFrame:
    """One row a track: its number and its frames in path order."""
    return rows.groupBy("track").agg(F.min("number").alias("number"), F.array_sort(F.collect_list(F.struct("frame_path", "l", "t", "w", "h"))).alias("frames"))


def sequence_of(path):
    return grandparent(path)
