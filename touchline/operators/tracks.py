"""Per-track aggregates, gates, sampling and ordered operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pitch half length and half width in metres (fixed values).
HALF_LENGTH, HALF_WIDTH = 52.5, 34.0
# Penalty area: distance from the centre where it begins, and its half width (fixed values).
BOX_X, BOX_Y = HALF_LENGTH - 16.5, 20.16


def located(x: str = "px", y: str = "py") -> Column:
    return F.col(x).isNotNull() & F.col(y).isNotNull()


def mean(values: Column) -> Column:
    """Mean of doubles, the same in whatever order their rows come: a sum of 18 decimal places, rounded once. Groups with values that decimals do not hold have the plain mean."""
    exact = values.try_cast("decimal(38,18)")
    whole = F.try_sum(exact).cast("double") / F.nullif(F.count(exact), F.lit(0))
    return F.coalesce(F.when(F.count(exact) == F.count(values), whole), F.avg(values))


def mean_position(det: DataFrame, average=F.avg) -> DataFrame:
    """Per track: rows, rows with both coordinates, and their mean. What compares it with a limit takes ``mean`` as its average."""
    both = located()
    return det.where("track_id IS NOT NULL").groupBy("seq", "track_id").agg(
        F.count("*").alias("n_rows"), F.count_if(both).alias("n_positions"), average(F.when(both, F.col("px"))).alias("mean_x"), average(F.when(both, F.col("py"))).alias("mean_y")
    )


def off_pitch(margin: float) -> Column:
    """Strictly beyond the lines plus margin; unknown means stay."""
    return F.coalesce((F.abs("mean_x") > HALF_LENGTH + margin) | (F.abs("mean_y") > HALF_WIDTH + margin), F.lit(False))


def pitch_gate(det: DataFrame, margin: float = 5.0, enabled: bool = True) -> DataFrame:
    """Clears track_id of off-pitch tracks; the incoming id stays as track_id_pregate. Disabled, it writes the columns only."""
    per = mean_position(det, mean).withColumn("pitch_gate_offpitch", off_pitch(margin)).select("seq", F.col("track_id").alias("_t"), F.col("mean_x").alias("pitch_mean_x"), F.col("mean_y").alias("pitch_mean_y"), "pitch_gate_offpitch")
    out = det.withColumn("track_id_pregate", F.col("track_id")).join(per.withColumnRenamed("seq", "_s"), (F.col("seq") == F.col("_s")) & (F.col("track_id") == F.col("_t")), "left").drop("_s", "_t")
    out = out.withColumn("pitch_gate_offpitch", F.coalesce("pitch_gate_offpitch", F.lit(False)))
    return out.withColumn("track_id", F.when(~F.col("pitch_gate_offpitch"), F.col("track_id"))) if enabled else out


def product_sum(a: Column, b: Column, c: Column) -> Column:
    """a * b + c of doubles, rounded once: the errors of the product and of the sum are added at the end."""

    def halves(x):
        high = x * 134217729.0 - (x * 134217729.0 - x)
        return high, x - high

    (a1, a2), (b1, b2), p = halves(a), halves(b), a * b
    s = p + c
    lost = a2 * b2 - (((p - a1 * b1) - a2 * b1) - a1 * b2) + ((p - (s - (s - p))) + (c - (s - p)))
    return F.when(F.isnan(lost), s).otherwise(s + lost)


def quantile(values: Column, q: float) -> Column:
    """Linear quantile of a sorted array; null of an empty one. Rounded as DuckDB's quantile_cont: F.percentile ends in other last digits, which decide comparisons with a limit."""
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at)
    return product_sum(F.get(values, low.cast("int")), 1 - (at - low), F.get(values, F.ceil(at).cast("int")) * (at - low))


def position_stats(det: DataFrame) -> DataFrame:
    """Per track: samples, mean and population deviation of x, 75th percentile of |x|; of y only from three values on; least and largest y."""
    three = F.count("py") >= 3
    return det.where("track_id IS NOT NULL").groupBy("seq", "track_id").agg(
        F.count("*").alias("n"), F.avg("px").alias("mx"), F.stddev_pop("px").alias("sx"), F.sort_array(F.collect_list(F.abs("px"))).alias("q75"),
        F.when(three, F.avg("py")).alias("my"), F.when(three, F.stddev_pop("py")).alias("sy"), F.min("py").alias("ymin"), F.max("py").alias("ymax"),
    ).withColumn("q75", quantile(F.col("q75"), 0.75))


def frame_rank(frames: DataFrame) -> DataFrame:
    """Rank of every frame of its sequence by file name, from 0."""
    name = F.regexp_extract("file_path", r"[^/]+$", 0)
    return frames.withColumn("rank", F.row_number().over(Window.partitionBy("seq").orderBy(name, "image_id")) - 1)


def stride_samples(det: DataFrame, stride: int = 5, most: int = 16) -> DataFrame:
    """Rows on the stride grid of each track (all rows where none is), and among them ``most`` evenly spaced ones (is_crop)."""
    track = Window.partitionBy("seq", "track_id")
    on = F.col("frame") % stride == 0
    rows = det.where("track_id IS NOT NULL").withColumn("fallback", ~F.bool_or(on).over(track)).where(F.col("fallback") | on)
    rows = rows.withColumn("i", F.row_number().over(track.orderBy("frame", "det_id")) - 1).withColumn("n", F.count("*").over(track))
    k = F.least(F.lit(most), F.col("n"))
    # position i is taken if some j in 0 .. k-1 has floor(j * (n-1) / (k-1)) = i
    picks = F.when(k == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda j: F.floor(j * (F.col("n") - 1).cast("double") / (k - 1)).cast("int")))
    return rows.withColumn("is_crop", F.array_contains(picks, F.col("i").cast("int"))).drop("i", "n")


def positional_stride(det: DataFrame, stride: int = 3, *more: str) -> DataFrame:
    """Every stride-th row of each track (and value of the further columns) in order, counted from its first row."""
    w = Window.partitionBy("seq", "track_id", *more).orderBy("frame", "det_id")
    return det.where("track_id IS NOT NULL").withColumn("_i", F.row_number().over(w)).where((F.col("_i") - 1) % stride == 0).drop("_i")


def carry_forward(frames: DataFrame, min_score: float = 0.5, most: int = 0) -> DataFrame:
    """Last accepted camera at or before each frame; ``most`` bounds the frames in a row that are served so (0: no bound).

    Frames without an entry or below min_score are filled; leading ones stay null.
    """
    w = Window.partitionBy("seq").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("listed") & (F.col("score") >= min_score)
    rows = frame_rank(frames).withColumn("accepted", ok)
    rows = rows.withColumn("source_rank", F.last(F.when(ok, F.col("rank")), ignorenulls=True).over(w))
    gap = F.col("rank") - F.col("source_rank")
    rows = rows.withColumn("source_rank", F.when(gap <= most, F.col("source_rank")) if most else F.col("source_rank"))
    for c in ("pan", "tilt", "hfov"):
        rows = rows.withColumn(c, F.when(F.col("source_rank").isNotNull(), F.last(F.when(ok, F.col(c)), ignorenulls=True).over(w)))
    return rows.withColumn("carried", F.col("source_rank").isNotNull() & ~ok)


def interpolate(det: DataFrame, frames: DataFrame, n_dti: int = 25, n_min: int = 5) -> DataFrame:
    """Adds linear rows in gaps of 1 < dt < n_dti frame ranks, on tracks of n_min rows or more. conf is the mean of the ends.

    Rows are dealt by sequence before they grow: a sequence's images, in order of rank, are joined to them as one array.
    """
    ranks = frame_rank(frames).select("seq", "image_id", "rank")
    images = ranks.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("rank", "image_id"))).getField("image_id").alias("images"))
    w = Window.partitionBy("seq", "track_id")
    ends = ["rank", "l", "t", "w", "h", "conf"]
    rows = det.select("seq", "image_id", "track_id", "det_id", *ends[1:]).join(ranks, ["seq", "image_id"], "left").repartition("seq").withColumn("n", F.count("rank").over(w))
    nxt = F.lead(F.struct(*ends)).over(w.orderBy(F.col("rank").asc_nulls_last(), "det_id"))
    rows = rows.withColumn("nxt", nxt).withColumn("dt", F.col("nxt.rank") - F.col("rank")).join(images, "seq", "left")
    gap = F.col("track_id").isNotNull() & (F.col("n") >= n_min) & (F.col("dt") > 1) & (F.col("dt") < n_dti)
    # the row itself, and the frames up to the next one
    fill = rows.select("*", F.posexplode(F.when(gap, F.slice("images", F.col("rank") + 1, F.col("dt"))).otherwise(F.array("image_id"))).alias("j", "at"))
    new = F.col("j") > 0
    step = {c: F.when(new, F.col(c) + (F.col(f"nxt.{c}") - F.col(c)) * (F.col("j") / F.col("dt"))).otherwise(F.col(c)) for c in "ltwh"}
    conf = F.when(new, F.coalesce((F.col("conf") + F.col("nxt.conf")) / 2, F.col("conf"), F.col("nxt.conf"))).otherwise(F.col("conf"))
    return fill.select("seq", F.col("at").alias("image_id"), "track_id", *[step[c].alias(c) for c in "ltwh"], conf.alias("conf"), new.alias("interpolated"))


def first_last(det: DataFrame) -> DataFrame:
    """First and last box of each track over its clean rows, or over all where it has none."""
    any_clean = F.bool_or("crop_single").over(Window.partitionBy("seq", "track_id"))
    rows = det.where("track_id IS NOT NULL").withColumn("_any", any_clean).where(F.col("crop_single") | ~F.col("_any"))
    key = F.struct("frame", "det_id")
    return rows.groupBy("seq", "track_id").agg(F.min_by("det_id", key).alias("first_det"), F.max_by("det_id", F.struct("frame", -F.col("det_id"))).alias("last_det"))


def repeated_in_frame(det: DataFrame) -> DataFrame:
    """Flags rows whose track has another row in the frame."""
    return det.where("track_id IS NOT NULL").withColumn("duplicated", F.count("*").over(Window.partitionBy("image_id", "track_id")) > 1)


def dense_ids(det: DataFrame) -> DataFrame:
    """New track ids 1..T of each sequence in the order of the old ones."""
    return det.where("track_id IS NOT NULL").withColumn("new_id", F.dense_rank().over(Window.partitionBy("seq").orderBy("track_id")))


def shards(det: DataFrame, n: int = 3) -> DataFrame:
    """Shard of each track: round robin over the sorted tracks of a sequence."""
    ids = det.where("track_id IS NOT NULL").select("seq", "track_id").distinct()
    return ids.withColumn("shard", (F.row_number().over(Window.partitionBy("seq").orderBy("track_id")) - 1) % n)


def robust_outliers(values: DataFrame, by: str, value: str, k: float = 3.25) -> DataFrame:
    """Flags values above median + k * MAD of their group; a MAD under 5 % of the median switches the rule off."""
    m = values.groupBy(by).agg(F.median(value).alias("m"))
    d = values.join(m, by).withColumn("_d", F.abs(F.col(value) - F.col("m")))
    s = d.groupBy(by).agg(F.median("_d").alias("s"))
    ok = F.col("s") >= 0.05 * F.col("m")
    return d.drop("_d").join(s, by).withColumn("enabled", ok).withColumn("outlier", ok & (F.col(value) > F.col("m") + k * F.col("s")))


def median_vectors(rows: DataFrame, by: list[str], vec: str) -> DataFrame:
    """Element-wise median of the vectors of each group, scaled to unit length."""
    long = rows.where(F.col(vec).isNotNull()).select(*by, F.posexplode(vec).alias("pos", "v"))
    med = long.groupBy(*by, "pos").agg(F.median(F.col("v").cast("double")).alias("m"))
    out = med.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("median"))
    norm = F.sqrt(F.aggregate("median", F.lit(0.0), lambda s, x: s + x * x)) + 1e-9
    return out.withColumn("norm", norm).withColumn("unit", F.transform("median", lambda x: x / F.col("norm")))


def centroids(rows: DataFrame, by: list[str], vec: str, clean: str) -> DataFrame:
    """Mean of the clean non-zero vectors of each group, else of any non-zero ones; groups of zero vectors have none."""
    nonzero = F.exists(vec, lambda x: F.abs(x) > 1e-6)
    pick = rows.where(nonzero).withColumn("_c", F.bool_or(clean).over(Window.partitionBy(*by))).where(F.col(clean) | ~F.col("_c"))
    mean = pick.select(*by, F.posexplode(vec).alias("pos", "v")).groupBy(*by, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return mean.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b clipped to 0..2, for unit vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot))
