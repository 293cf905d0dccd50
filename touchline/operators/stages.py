"""Whole stages made of the smaller operators: calibration, team descriptors, shirt numbers, and writing answers back to rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import geometry as geo
from touchline.functions.text import basename, shirt
from touchline.operators import cluster, tracks, votes


def write_back(rows: DataFrame, per_track: DataFrame, *columns: str) -> DataFrame:
    """Columns of a trajectory on each of its rows; rows without a trajectory, or whose trajectory has none, get null."""
    a = per_track.select(F.col("seq").alias("_s"), F.col("track_id").alias("_t"), *columns)
    return rows.join(a, (F.col("seq") == F.col("_s")) & (F.col("track_id") == F.col("_t")), "left").drop("_s", "_t")


def track_key(text: Column) -> Column:
    """The number in a textual track id, as in "7" or "7.0"; null for anything else."""
    return F.regexp_extract(F.trim(text), r"^(\d+)(?:\.0+)?$", 1).try_cast("long")


def join_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Shirt answers (seq, track as text, number, confidence, candidates) on the rows of their trajectories.

    A number that is not 1..99 leaves number and confidence null; maxconf is the
    score of the chosen label among the candidates.
    """
    n = F.when(shirt(F.col("number")), F.col("number"))
    chosen = F.element_at(F.filter("candidates", lambda c: c["label"] == F.col("number")), 1)
    a = answers.select(
        F.col("seq"), track_key(F.col("track")).alias("track_id"), n.alias("jersey_number"), F.when(n.isNotNull(), F.col("confidence")).alias("jersey_confidence"),
        F.when(n.isNotNull(), F.exp(chosen["mx"]) * chosen["conf_sum"]).alias("jersey_maxconf"), "candidates",
    )
    return write_back(rows, a.where("track_id IS NOT NULL"), "jersey_number", "jersey_confidence", "jersey_maxconf", "candidates")


def calibrated_frames(frames: DataFrame, entries: DataFrame, min_score: float = 0.5, most: int = 0, carry: bool = True) -> DataFrame:
    """frames with cam, accepted and carried. entries: seq, path, score, cp (the calibrator's camera), matched by file name.

    A frame without an entry of min_score takes the camera of the last one that
    has it, at most ``most`` frames in a row (0: no bound).
    """
    e = entries.select(F.col("seq").alias("_s"), basename(F.col("path")).alias("_n"), F.coalesce("score", F.lit(0.0)).alias("entry_score"), geo.camera_from_calibrator(F.col("cp")).alias("own"))
    rows = tracks.frame_rank(frames)
    rows = rows.join(e, (F.col("seq") == F.col("_s")) & (basename(F.col("file_path")) == F.col("_n")), "left").drop("_s", "_n")
    ok = F.coalesce(F.col("entry_score") >= min_score, F.lit(False))
    rows = rows.withColumn("accepted", ok)
    before = Window.partitionBy("seq").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("accepted"), F.struct("rank", "own")), ignorenulls=True).over(before)
    rows = rows.withColumn("_last", last)
    near = (F.col("rank") - F.col("_last.rank") <= most) if most else F.lit(True)
    cam = F.when(F.col("accepted"), F.col("own")).otherwise(F.when(F.lit(carry) & near, F.col("_last.own")))
    return rows.withColumn("cam", cam).withColumn("carried", F.col("cam").isNotNull() & ~F.col("accepted")).drop("_last", "own")


def calibration(det: DataFrame, frames: DataFrame, entries: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Detections with bbox_pitch (null without a camera) and frames with their cameras."""
    f = calibrated_frames(frames, entries, **options)
    cams = f.select(F.col("seq").alias("_s"), F.col("image_id").alias("_i"), "cam")
    rows = det.join(cams, (F.col("seq") == F.col("_s")) & (F.col("image_id") == F.col("_i")), "left")
    place = F.when(F.col("cam").isNotNull(), geo.bbox_pitch(F.col("cam"), *[F.col(c) for c in "ltwh"]))
    return rows.withColumn("bbox_pitch", place).drop("_s", "_i", "cam"), f


def team_descriptors(det: DataFrame, stride: int = 5, most: int = 16) -> DataFrame:
    """seq, track_id, unit: the median of the sampled clean crops' embeddings, of unit length; none without a usable one."""
    picked = tracks.stride_samples(det.where("crop_single"), stride, most).where("is_crop")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return tracks.median_vectors(picked.where(fine), ["seq", "track_id"], "embedding").where("norm > 1e-8").select("seq", "track_id", "unit")


def team_embed(det: DataFrame, stride: int = 5, most: int = 16, k: float = 3.25) -> DataFrame:
    """det with cluster and nearest of their trajectories. Fewer than two descriptors in a sequence make no clusters."""
    return write_back(det, cluster.team_clusters(team_descriptors(det, stride, most), k), "cluster", "nearest")


def jersey_answers(a: DataFrame, b: DataFrame, stride: int = 3, legible: float = 0.5, detector: float = 0.52) -> DataFrame:
    """The answer of each trajectory with clean rows from two readers' reads (seq, track_id, frame, det_id, legibility, det_score, tens, units).

    Every stride-th read that passes both gates votes; number is the pooled vote's
    label, confidence its share, candidates all labels by rank. A trajectory with
    no read left has -1, share 0 and no candidates. Readers that answer for
    different numbers of frames are an error.
    """
    by = ["seq", "track_id"]
    ok = F.coalesce(votes.passes(legible, detector), F.lit(False))
    # one table of both readers' reads: its statistics are the pooled ones
    rows = a.withColumn("_second", F.lit(False)).unionByName(b.withColumn("_second", F.lit(True)))
    rows = rows.select(*by, "frame", "det_id", "_second", ok.alias("_ok"), *[F.when(ok, F.col(c)).alias(c) for c in ("tens", "units")])
    # what passes is decoded before rows move, as the vectors are most of a row; they move once, by trajectory
    rows = votes.decoded(rows).drop("tens", "units").repartition(*by)
    i = F.row_number().over(Window.partitionBy(*by, "_second").orderBy("frame", "det_id"))
    rows = rows.withColumn("_in", F.col("_ok") & F.col("track_id").isNotNull() & ((i - 1) % stride == 0))
    rows = rows.withColumns({c: F.when(F.col("_in"), F.col(c)) for c in ("label", "raw", "conf")})
    stats = rows.groupBy(*by, "label").agg(
        F.max("raw").alias("mx"), F.sum("conf").alias("conf_sum"), F.count_if("_in").alias("votes"), F.sum("raw").alias("strength"),
        F.count_if(F.col("_in") & ~F.col("_second")).alias("n_a"), F.count_if(F.col("_in") & F.col("_second")).alias("n_b"), F.bool_or(~F.col("_second")).alias("asked"),
    )
    some = F.col("votes") > 0  # a group without votes holds the reads that do not count
    most = F.max_by(F.struct("label", "votes"), F.when(some, votes.tied(F.col("votes").cast("double"), F.col("votes"), F.col("strength"), F.col("label"))))
    key = votes.tied(votes.maxconf(), F.col("votes"), F.col("strength"), F.col("label"))
    listed = F.sort_array(F.collect_list(F.when(some, F.struct(key.alias("key"), "label", "mx", "conf_sum", "votes"))), asc=False)
    out = stats.groupBy(*by).agg(most.alias("won"), listed.alias("listed"), *[F.sum(c).alias(c) for c in ("votes", "n_a", "n_b")], F.bool_or("asked").alias("asked"))
    out = out.where(F.assert_true(F.col("n_a") == F.col("n_b"), F.lit("readers disagree on the number of frames")).isNull() & F.col("asked"))
    cand = F.transform("listed", lambda c: F.struct(*[c[n].alias(n) for n in ("label", "mx", "conf_sum", "votes")]))
    return out.select(*by, F.coalesce("won.label", F.lit("-1")).alias("number"), F.coalesce(F.col("won.votes") / F.col("votes"), F.lit(0.0)).alias("confidence"), F.col("n_a").alias("n_used"), cand.alias("candidates"))


Reader = Callable[[list], np.ndarray]


def read_many(crops: DataFrame, reader: Callable[[], Reader], column: str = "crop", result: str = "logits", batch: int = 256) -> DataFrame:
    """crops with the reader's answer, one list of doubles a row. reader() is called once a task and may load a model; null crops get null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for b in batches:
            values, out = b[column].to_pylist(), [None] * b.num_rows
            some = [k for k, v in enumerate(values) if v is not None]
            for x in range(0, len(some), batch):
                part = some[x : x + batch]
                for k, v in zip(part, read([values[k] for k in part]), strict=True):
                    out[k] = np.asarray(v, float).ravel().tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], [*b.schema.names, result])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in crops.schema.fields)
    return crops.mapInArrow(run, f"{fields}, `{result}` array<double>")
