"""Crop labels from box overlap inside a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("all", "conf", "tracked", "tracked_or_conf")


def intersection(a: str, b: str) -> Column:
    """Area that boxes (l, t, w, h) of two aliases share."""

    def c(x, y):
        return F.col(f"{x}.{y}")

    def side(p, s):
        return F.greatest(F.lit(0.0), F.least(c(a, p) + c(a, s), c(b, p) + c(b, s)) - F.greatest(c(a, p), c(b, p)))

    return side("l", "w") * side("t", "h")


def crop_filter(det: DataFrame, mode: str = "tracked", conf_thr: float = 0.3, thr_target: float = 0.25, thr_other: float = 0.40) -> DataFrame:
    """Adds crop_rt, crop_rb (largest shared area over the own and over the other area), crop_single and crop_trigger.

    One keyed self-join on the frame, so its size is bounded by the boxes of a
    frame. The overlap is part of the join condition and the join is outer: boxes
    that touch no other keep ratio 0. A box that may not count as contaminator is
    still labelled itself. Equal ratios go to the smaller det_id.
    """
    if mode not in MODES or (mode == "conf" and conf_thr <= 0):
        raise ValueError(f"mode {mode!r} with confidence {conf_thr}")
    counts = {"all": F.lit(True), "conf": F.col("conf") > conf_thr, "tracked": F.col("track_id").isNotNull(), "tracked_or_conf": F.col("track_id").isNotNull() | (F.col("conf") > conf_thr)}[mode]
    box = ["seq", "image_id", "det_id", "l", "t", "w", "h"]
    a, b = det.select(*box).alias("a"), det.where(counts).select(*box).alias("b")
    inter = intersection("a", "b")
    on = (F.col("a.seq") == F.col("b.seq")) & (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.det_id") != F.col("b.det_id"))
    area = {x: F.greatest(F.col(f"{x}.w") * F.col(f"{x}.h"), F.lit(1e-9)) for x in "ab"}
    best = {x: F.max(F.struct((inter / area[x]).alias("r"), (-F.col("b.det_id")).alias("d"))) for x in "ab"}
    got = a.join(b, on).where(inter > 0).groupBy(F.col("a.det_id").alias("_id")).agg(best["a"].alias("_t"), best["b"].alias("_b"))
    rt, rb = F.coalesce("_t.r", F.lit(0.0)), F.coalesce("_b.r", F.lit(0.0))
    out = det.join(got, det["det_id"] == F.col("_id"), "left").withColumns({"crop_rt": rt, "crop_rb": rb, "crop_single": (rt <= thr_target) & (rb < thr_other)})
    fired = F.when(rt > thr_target, -F.col("_t.d")).when(rb >= thr_other, -F.col("_b.d"))
    return out.withColumn("crop_trigger", fired).drop("_id", "_t", "_b")
