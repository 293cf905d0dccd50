"""Camera files of an external calibrator: one JSON object a sequence, from frame path to camera, score and reinit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.text import basename, stem

CP = "struct<sensorResolutionWidthPixels: double, sensorResolutionHeightPixels: double, horizontalFieldOfViewDegrees: double, panDegrees: double, tiltDegrees: double, rollDegrees: double, positionXMeters: double, positionYMeters: double, positionZMeters: double, normalizedRadialDistortionCoefficients: array<double>>"
SCHEMA = f"map<string, struct<cp: {CP}, score: double, reinit: boolean>>"


def parse(files: DataFrame) -> DataFrame:
    """seq, name (file name of the frame), cp, score (0 if absent), reinit from rows of (seq, value)."""
    rows = files.select("seq", F.explode(F.from_json("value", SCHEMA)).alias("path", "x"))
    return rows.select("seq", basename(F.col("path")).alias("name"), F.col("x.cp").alias("cp"), F.coalesce("x.score", F.lit(0.0)).alias("score"), F.coalesce("x.reinit", F.lit(False)).alias("reinit"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All camera files below path; the file name is the sequence."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    return parse(files.select(stem(F.input_file_name()).alias("seq"), "value"))
