"""Quality metrics over predictions and ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.text import edit_similarity


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b)


def iou(a: str, b: str) -> Column:
    from touchline.operators.overlap import intersection

    inter = intersection(a, b)
    union = F.col(f"{a}.w") * F.col(f"{a}.h") + F.col(f"{b}.w") * F.col(f"{b}.h") - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def iou_pairs(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """IoU of every prediction and ground-truth box of a frame that touch."""
    p, g = pred.alias("p"), gt.alias("g")
    return p.join(g, (F.col("p.seq") == F.col("g.seq")) & (F.col("p.image_id") == F.col("g.image_id"))).select(
        F.col("p.seq").alias("seq"), F.col("p.image_id").alias("image_id"), F.col("p.det_id").alias("pred_id"), F.col("g.det_id").alias("gt_id"), iou("p", "g").alias("iou")
    ).where("iou > 0")


def track_accuracy(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Accuracy over all tracks and over numbered ones; a track without a prediction counts as -1."""
    j = gt.join(pred, "track", "left").withColumn("pred", F.coalesce("pred", F.lit("-1")))
    ok = (F.col("pred") == F.col("gt")).cast("double")
    return j.agg(F.avg(ok).alias("acc_all"), F.avg(F.when(F.col("gt") != "-1", ok)).alias("acc_numbered"), F.count("*").alias("n"))


def minus_one(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the class -1."""
    j = gt.join(pred, "track", "left").withColumn("pred", F.coalesce("pred", F.lit("-1")))
    g, p = F.col("gt") == "-1", F.col("pred") == "-1"
    c = j.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def by_digits(gt: DataFrame, pred: DataFrame) -> DataFrame:
    j = gt.where("gt <> '-1'").join(pred, "track", "left").withColumn("ok", F.coalesce(F.col("pred") == F.col("gt"), F.lit(False)).cast("double"))
    return j.groupBy(F.length("gt").alias("digits")).agg(F.count("*").alias("n"), F.avg("ok").alias("acc"))


def image_metrics(pairs: DataFrame) -> DataFrame:
    """Accuracy and mean normalised edit similarity of pred against gt."""
    return pairs.agg(F.avg((F.col("pred") == F.col("gt")).cast("double")).alias("accuracy"), F.avg(edit_similarity(F.col("pred"), F.col("gt"))).alias("one_minus_ned"), F.count("*").alias("n_images"))


def detection_summary(gt: DataFrame, n_pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Precision, recall, F1 and mean IoU from one-to-one matches (gt_id, iou)."""
    m = matches.agg(F.count("*").alias("tp"), F.avg("iou").alias("mean_iou"))
    c = m.crossJoin(gt.agg(F.count("*").alias("n_gt"))).crossJoin(n_pred.agg(F.count("*").alias("n_pred")))  # one row each
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("n_pred")), "recall": ratio(F.col("tp"), F.col("n_gt"))})
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def recall_by_height(gt: DataFrame, matches: DataFrame, edges: tuple = (0, 40, 80)) -> DataFrame:
    """Share of ground-truth boxes that are matched, by half-open height bins."""
    bins = None
    for k, e in enumerate(edges):
        inside = F.col("h") >= e if k + 1 == len(edges) else (F.col("h") >= e) & (F.col("h") < edges[k + 1])
        bins = F.when(inside, e) if bins is None else bins.when(inside, e)
    j = gt.withColumn("bin", bins).join(matches.select(F.col("gt_id").alias("det_id"), F.lit(1.0).alias("hit")), "det_id", "left")
    return j.groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def jersey_counts(pairs: DataFrame) -> DataFrame:
    """Number metrics of matched boxes; a wrong number on a numbered box is a false positive and a false negative."""
    p, g = F.col("pred_jn"), F.col("gt_jn")
    c = pairs.agg(F.avg((p == g).cast("double")).alias("det_acc_all"), F.count_if((g != -1) & (p == g)).alias("tp"), F.count_if((p != -1) & (p != g)).alias("fp"), F.count_if((g != -1) & (p != g)).alias("fn"))
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return c.withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def jersey_tracks(pairs: DataFrame, gt: DataFrame) -> DataFrame:
    """Track accuracy: each predicted track against the number of the ground-truth track it mostly covers."""
    truth = gt.groupBy(F.col("track_id").alias("gt_track")).agg(F.mode("jn", True).alias("gt_number"))
    per = pairs.groupBy("pred_track").agg(F.mode("pred_jn", True).alias("pred_number"), F.mode("gt_track", True).alias("gt_track")).join(truth, "gt_track", "left")
    ok = (F.col("pred_number") == F.col("gt_number")).cast("double")
    return per.agg(F.avg(ok).alias("trk_acc_all"), F.avg(F.when(F.col("gt_number") != -1, ok)).alias("trk_acc_numbered"), F.count("*").alias("n_tracks"))


def best_attempt(attempts: DataFrame, min_score: float) -> DataFrame:
    """Mean and number of accepted scores per attempt of each sequence; the best by mean, number, then the earliest."""
    ok = F.col("score") >= min_score
    q = attempts.groupBy("seq", "attempt").agg(F.coalesce(F.avg(F.when(ok, F.col("score"))), F.lit(0.0)).alias("mean"), F.count_if(ok).alias("accepted"), F.count("*").alias("frames"))
    return q.withColumn("winner", F.row_number().over(Window.partitionBy("seq").orderBy(F.round("mean", 9).desc(), F.desc("accepted"), "attempt")) == 1)


def confusion(lines: DataFrame, threshold: float) -> DataFrame:
    """Line classes of each image as TP, FP or FN: a class counts as found only if all its points are near.

    lines: image_id, class, in_pred, in_gt, dists (of the ground-truth points to the predicted line).
    """
    near = F.forall("dists", lambda d: d < threshold)
    kind = F.when(F.col("in_pred") & F.col("in_gt"), F.when(near, "TP").otherwise("FP")).when(F.col("in_pred"), "FP").otherwise("FN")
    return lines.withColumn("kind", kind).groupBy("image_id").agg(*[F.count_if(F.col("kind") == k).alias(k.lower()) for k in ("TP", "FP", "FN")])
