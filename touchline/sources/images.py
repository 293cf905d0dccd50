"""Images and arrays in files: frames by path, labelled crops, cached numpy archives."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.labels import prepared
from touchline.functions.text import basename, grandparent


def frames(spark: SparkSession, root: str, pattern: str = "*.jpg") -> DataFrame:
    """path, seq (two levels above the file), name and the encoded bytes of every image below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", grandparent(F.col("path")).alias("seq"), basename(F.col("path")).alias("name"), "content")


def labelled(spark: SparkSession, root: str, labels: str, charset: str, most: int = 25, pattern: str = "*.png") -> DataFrame:
    """name, content and prepared label of the images below root that the label file (lines "name<tab>label") names; a label that is not usable drops its image."""
    lines = spark.read.text(labels).select(F.split("value", "\t", 2).alias("v")).where(F.size("v") == 2)
    named = lines.select(F.col("v")[0].alias("n"), prepared(charset, most)(F.col("v")[1]).alias("label")).where("label IS NOT NULL")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(basename(F.col("path")).alias("name"), "content").join(named, F.col("name") == F.col("n")).drop("n")


def arrays(spark: SparkSession, root: str, name: str) -> DataFrame:
    """path, row and values of one array of every numpy archive (.npz) below root; archives without it give nothing."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for path, content in zip(p.path, p.content, strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    if name in z:
                        a = np.atleast_2d(z[name].astype(float).reshape(len(z[name]), -1) if z[name].ndim else z[name].astype(float))
                        yield pd.DataFrame({"path": path, "row": np.arange(len(a)), "values": list(a)})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(root)
    return files.select("path", "content").mapInPandas(run, "path string, row long, values array<double>")
