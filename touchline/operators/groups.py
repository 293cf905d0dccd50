"""Grouped Arrow functions, exact spread of pairs over blocks, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.scratch import scratch


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by the keys over twice as many tasks as a shuffle has. Spark merges small shuffle partitions by their bytes; not these: their rows cost far more time than their bytes tell.

    Not over as many: a shuffle below by the same keys would be taken for this one, and that one is merged.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(2 * n, *keys)


def each_group(df: DataFrame, keys: list[str], f: Callable[[pa.Table], pa.RecordBatch | None], schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """f over the rows of every group of the keys, in the given order. Many groups share a task; the caller bounds the size of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows - 1, bool)
            for k in keys:
                new |= pc.not_equal(b[k][1:], b[k][:-1]).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                this = tuple(b[k][s].as_py() for k in keys)
                if held and this != last and (out := f(pa.Table.from_batches(held))) is not None:
                    yield out
                if this != last:
                    held, last = [], this
                held.append(b.slice(s, e - s))
        if held and (out := f(pa.Table.from_batches(held))) is not None:
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def matrix(t: pa.Table, name: str) -> np.ndarray:
    """A column of lists of one length as rows."""
    flat = t[name].combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def block_pairs(df: DataFrame, key: Column, blocks: Column) -> DataFrame:
    """Each row once for every pair (i, j) of blocks in which its own block c takes part: any two rows of a group meet in one pair."""
    own = F.pmod(F.xxhash64(key), blocks).cast("int")
    out = df.withColumn("c", own).withColumn("o", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    return out.withColumn("i", F.least("c", "o")).withColumn("j", F.greatest("c", "o")).drop("o")


def components(edges: DataFrame) -> DataFrame:
    """node and its component's least node, for the nodes of edges(a long, b long).

    Large-star and small-star rounds: the neighbours of a node are hung on the least
    one among them, first the larger ones, then the smaller ones, until nothing moves. A
    node's edges meet only in a minimum and in a join with that minimum.
    """
    spark: SparkSession = edges.sparkSession
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        step = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        same = step.count() == edges.count() and not step.exceptAll(edges).limit(1).count()
        edges = step
        if same:
            roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return spark.createDataFrame([], "node long, root long").union(edges.select("a", "b")).union(roots)
