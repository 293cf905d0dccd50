"""Further registered queries: predicates and geometry, joins, sets, scalar functions, audit checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import geometry as geo
from touchline.functions import text
from touchline.operators import audit, cluster, matching, metric_space, metrics, overlap, refine, roles, tracks, votes
from touchline.plans import fixtures as fx
from touchline.plans.queries import FR, IOU_SQL, POOL, RANKED, ROLE_SQL, TR, TRAJ, D, both_stats, overlap_sql, pred_gt, r6, register, trajectories
from touchline.sources import state

# --- predicates and boxes ------------------------------------------------------------------------------


@register("p1_confidence_filter", f"SELECT det_id FROM {D} d WHERE conf >= 0.4")
def _(spark, d):
    return fx.detections(spark, d).where("conf >= 0.4").select("det_id")


@register("p2_ltrb", f"SELECT det_id, l, t, l + w AS r, t + h AS b FROM {D} d")
def _(spark, d):
    return fx.detections(spark, d).select("det_id", geo.ltrb(F.col("l"), F.col("t"), F.col("w"), F.col("h")).alias("x")).select("det_id", "x.*")


@register("p3_high_confidence", f"SELECT det_id FROM {D} d WHERE conf > 0.6")
def _(spark, d):
    return fx.detections(spark, d).where("conf > 0.6").select("det_id")


SHIFT = "l * 1.37 - 20.5 AS l, t * 1.21 - 10.25 AS t, w * 0.9 AS w, h * 0.8 AS h"


def shifted(spark, d) -> DataFrame:
    return fx.detections(spark, d).select("det_id", (F.col("l") * 1.37 - 20.5).alias("l"), (F.col("t") * 1.21 - 10.25).alias("t"), (F.col("w") * 0.9).alias("w"), (F.col("h") * 0.8).alias("h"))


def clamp_sql(f: str, least: int) -> str:
    c = {k: f.format(e) for k, e in (("x1", "l"), ("y1", "t"), ("x2", "l + w"), ("y2", "t + h"))}
    return f"""WITH d AS (SELECT det_id, {SHIFT} FROM {D} q), c AS (SELECT det_id, greatest(0, {c["x1"]}) AS x1, greatest(0, {c["y1"]}) AS y1, least(320, {c["x2"]}) AS x2, least(300, {c["y2"]}) AS y2 FROM d)
    SELECT det_id, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1, CASE WHEN ok THEN x2 END AS x2, CASE WHEN ok THEN y2 END AS y2 FROM (SELECT *, x2 - x1 >= {least} AND y2 - y1 >= {least} AS ok FROM c) z"""


@register("p4_crop_truncated", clamp_sql("CAST(trunc({}) AS INTEGER)", 1))
def _(spark, d):
    return shifted(spark, d).select("det_id", geo.crop_truncated(F.col("l"), F.col("t"), F.col("w"), F.col("h"), 320, 300).alias("x")).select("det_id", "x.*")


@register("p5_crop_rounded", clamp_sql("CAST(round_even({}, 0) AS INTEGER)", 2))
def _(spark, d):
    return shifted(spark, d).select("det_id", geo.crop_rounded(F.col("l"), F.col("t"), F.col("w"), F.col("h"), 320, 300, 2).alias("x")).select("det_id", "x.*")


@register("p6_crop_box", clamp_sql("CAST(round_even({}, 0) AS INTEGER)", 1))
def _(spark, d):
    return shifted(spark, d).select("det_id", geo.crop_rounded(F.col("l"), F.col("t"), F.col("w"), F.col("h"), 320, 300).alias("x")).select("det_id", "x.*")


@register("p7_pad_box", f"SELECT det_id, greatest(0, CAST(round_even(l - w * 0.18, 0) AS INTEGER)) AS x0, greatest(0, CAST(round_even(t - h * 0.18, 0) AS INTEGER)) AS y0, least(320, CAST(round_even(l + w + w * 0.18, 0) AS INTEGER)) AS x1, least(300, CAST(round_even(t + h + h * 0.18, 0) AS INTEGER)) AS y1 FROM {D} d")
def _(spark, d):
    return fx.detections(spark, d).select("det_id", geo.pad_box(F.col("l"), F.col("t"), F.col("w"), F.col("h"), 320, 300).alias("x")).select("det_id", "x.*")


@register("p8_quad_box", f"SELECT det_id, l AS x0, t - 3 AS y0, l + w AS x1, t + h AS y1, round(CASE WHEN h / sqrt(h * h + 4) * 0 + 2 / sqrt(4 + h * h) <= 1 / sqrt(1 + (h + 3) * (h + 3)) THEN sqrt(4 + h * h) ELSE sqrt(1 + (h + 3) * (h + 3)) END, 6) AS glyph FROM {D} d")
def _(spark, d):
    # a leaning quadrilateral: the right edge leans by one, the left by two
    pts = [(F.col("l"), F.col("t")), (F.col("l") + F.col("w") - 1, F.col("t") - 3), (F.col("l") + F.col("w"), F.col("t") + F.col("h")), (F.col("l") + 2, F.col("t") + F.col("h"))]
    quad = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in pts])
    return fx.detections(spark, d).select("det_id", geo.quad_box(quad).alias("b"), F.round(geo.quad_height(quad), 6).alias("glyph")).select("det_id", "b.*", "glyph")


@register("p9_best_roi", f"SELECT image_id, det_id, floor(l - 2) AS x0, floor(t - 2) AS y0, ceil(l + w + 2) AS x1, ceil(t + h + 2) AS y1 FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS r FROM {D} d WHERE conf >= 0.3) q WHERE r = 1 AND w >= 8 AND h >= 8")
def _(spark, d):
    best = fx.detections(spark, d).where("conf >= 0.3").groupBy("image_id").agg(F.max_by(F.struct("det_id", "l", "t", "w", "h"), F.struct("conf", -F.col("det_id"))).alias("x")).select("image_id", "x.*").where("w >= 8 AND h >= 8")
    return best.select("image_id", "det_id", *[c.cast("double").alias(n) for n, c in (("x0", F.floor(F.col("l") - 2)), ("y0", F.floor(F.col("t") - 2)), ("x1", F.ceil(F.col("l") + F.col("w") + 2)), ("y1", F.ceil(F.col("t") + F.col("h") + 2)))])


@register("p10_top_score", f"SELECT image_id, coalesce(max(CASE WHEN conf >= 0.8 THEN conf END), 0) AS top FROM {D} d GROUP BY image_id")
def _(spark, d):
    return fx.detections(spark, d).groupBy("image_id").agg(F.coalesce(F.max(F.when(F.col("conf") >= 0.8, F.col("conf"))), F.lit(0.0)).alias("top"))


@register("p11_letterbox", f"SELECT det_id, CAST(round_even(w * s, 0) AS INTEGER) AS w, CAST(round_even(h * s, 0) AS INTEGER) AS h, CAST(floor((128 - CAST(round_even(w * s, 0) AS INTEGER)) / 2.0) AS INTEGER) AS \"left\", CAST(floor((64 - CAST(round_even(h * s, 0) AS INTEGER)) / 2.0) AS INTEGER) AS top FROM (SELECT *, least(128 / w, 64 / h) AS s FROM {D} d) q")
def _(spark, d):
    return fx.detections(spark, d).select("det_id", geo.letterbox(F.col("w"), F.col("h"), 128, 64).alias("x")).select("det_id", "x.w", "x.h", "x.left", "x.top")


@register("p12_legible_tracks", f"SELECT seq, track_id, count(CASE WHEN conf > 0.5 THEN 1 END) > 3 AS legible FROM {D} d WHERE track_id IS NOT NULL GROUP BY seq, track_id")
def _(spark, d):
    return fx.detections(spark, d).where("track_id IS NOT NULL").groupBy("seq", "track_id").agg((F.count_if(F.col("conf") > 0.5) > 3).alias("legible"))


@register("p16_radar", f"SELECT det_id, CAST(round_even((greatest(-57.5, least(57.5, px)) + 57.5) * 8, 0) AS INTEGER) AS u, CAST(round_even((greatest(-39, least(39, py)) + 39) * 8, 0) AS INTEGER) AS v FROM {D} d WHERE px IS NOT NULL")
def _(spark, d):
    return fx.detections(spark, d).where("px IS NOT NULL").select("det_id", geo.radar_pixel(F.col("px"), F.col("py")).alias("x")).select("det_id", "x.*")


@register("p17_display_label", f"SELECT det_id, concat_ws(' | ', CASE WHEN track_id % 11 = 0 THEN 'GK' END, number, 'ID ' || CAST(track_id AS STRING)) AS label FROM {D} d")
def _(spark, d):
    return fx.detections(spark, d).select("det_id", geo.display_label(F.when(F.col("track_id") % 11 == 0, "goalkeeper").otherwise("player"), F.col("number"), F.col("track_id")).alias("label"))


@register("p30_edge_side", f"SELECT det_id, CASE WHEN l + w / 2 < 150 THEN 'left' ELSE 'right' END AS side FROM {D} d")
def _(spark, d):
    return fx.detections(spark, d).select("det_id", geo.edge_side(F.col("l"), F.col("w"), 300).alias("side"))


# --- cameras ----------------------------------------------------------------------------------------------


def cameras(frames: DataFrame) -> DataFrame:
    """Cameras of the frames, without distortion, above and behind the side line."""
    w, h = F.lit(1920.0), F.lit(1080.0)
    f = geo.focal_from_hfov(w, F.col("hfov"))
    zero = F.array_repeat(F.lit(0.0), 6)
    cam = F.struct(F.array(w / 2, h / 2).alias("principal_point"), f.alias("x_focal_length"), f.alias("y_focal_length"), F.col("pan").alias("pan_degrees"), F.col("tilt").alias("tilt_degrees"), F.lit(0.0).alias("roll_degrees"), F.array(F.lit(0.0), F.lit(60.0), F.lit(-15.0)).alias("position_meters"), zero.alias("radial_distortion"))
    return frames.withColumn("cam", cam)


#: Rotation rows for roll 0 and the ray of a pixel, as the oracle computes them.
CAM_SQL = f"""(SELECT *, 960 / tan(radians(hfov) / 2) AS f, cos(radians(pan)) AS cp, sin(radians(pan)) AS sp, cos(radians(tilt)) AS ct, sin(radians(tilt)) AS st FROM {FR} fr)"""


def ground_sql(u: str, v: str, n: str) -> str:
    """Ray R'(x, y, 1) with R' columns of Rz(pan) Rx(tilt), met with z = 0 from (0, 60, -15)."""
    x, y = f"(({u} - 960) / f)", f"(({v} - 540) / f)"
    rz = f"nullif(st * {y} + ct, 0)"
    return f"0 + 15 / {rz} * (cp * {x} - sp * ct * {y} + sp * st) AS x_{n}, 60 + 15 / {rz} * (sp * {x} + cp * ct * {y} - cp * st) AS y_{n}"


@register("p19_camera_conversion", f"SELECT image_id, round(960 / tan(radians(hfov) / 2), 6) AS focal, round(0.01 * power(960 / tan(radians(hfov) / 2) / 1080, 2), 6) AS k1, round(0.002 * power(960 / tan(radians(hfov) / 2) / 1080, 4), 6) AS k2 FROM {FR} f")
def _(spark, d):
    cp = F.struct(*[F.lit(v).alias(k) for k, v in (("sensorResolutionWidthPixels", 1920.0), ("sensorResolutionHeightPixels", 1080.0), ("rollDegrees", 0.0), ("positionXMeters", 0.0), ("positionYMeters", 60.0), ("positionZMeters", -15.0))], F.col("hfov").alias("horizontalFieldOfViewDegrees"), F.col("pan").alias("panDegrees"), F.col("tilt").alias("tiltDegrees"), F.array(F.lit(0.01), F.lit(0.002)).alias("normalizedRadialDistortionCoefficients"))
    c = geo.camera_from_calibrator(cp)
    return fx.frames(spark, d).select("image_id", F.round(c["x_focal_length"], 6).alias("focal"), F.round(F.get(c["radial_distortion"], F.lit(0)), 6).alias("k1"), F.round(F.get(c["radial_distortion"], F.lit(1)), 6).alias("k2"))


@register("p20_bbox_pitch", f"""WITH c AS {CAM_SQL}, g AS (SELECT det_id, {ground_sql("l * 6", "(t + h) * 3", "bottom_left")}, {ground_sql("(l + w) * 6", "(t + h) * 3", "bottom_right")}, {ground_sql("(l + w / 2) * 6", "(t + h) * 3", "bottom_middle")} FROM {D} d JOIN c USING (image_id))
SELECT det_id, {", ".join(f"CASE WHEN abs(x_bottom_middle) < 1000 AND abs(y_bottom_middle) < 1000 THEN round({a}_bottom_{n}, 4) END AS {a}_bottom_{n}" for n in ("left", "right", "middle") for a in "xy")}, NOT (abs(x_bottom_middle) < 1000 AND abs(y_bottom_middle) < 1000) AS far FROM g""")
def _(spark, d):
    cams = cameras(fx.frames(spark, d)).select("image_id", "cam")
    p = fx.detections(spark, d).join(cams, "image_id").select("det_id", geo.bbox_pitch(F.col("cam"), F.col("l") * 6, F.col("t") * 3, F.col("w") * 6, F.col("h") * 3).alias("p")).where("p IS NOT NULL").select("det_id", "p.*")
    names = [f"{a}_bottom_{n}" for n in ("left", "right", "middle") for a in "xy"]
    near = F.expr("abs(x_bottom_middle) < 1000 AND abs(y_bottom_middle) < 1000")  # places near the horizon are flagged: their last digits are noise
    return p.select("det_id", *[F.when(near, F.round(c, 4)).alias(c) for c in names], (~near).alias("far"))


@register("p22_project", f"SELECT image_id, CASE WHEN z > 1e-3 THEN round(f * (cp * x + sp * y) / z + 960, 4) END AS u, CASE WHEN z > 1e-3 THEN round(f * (-sp * ct * x + cp * ct * y + st * 15) / z + 540, 4) END AS v FROM (SELECT *, sp * st * x - cp * st * y + ct * 15 AS z FROM (SELECT *, image_id % 100 - 50.0 AS x, image_id % 60 - 30.0 - 60 AS y FROM {CAM_SQL} c) q) w")
def _(spark, d):
    p = geo.project(F.col("cam"), (F.col("image_id") % 100 - 50).cast("double"), (F.col("image_id") % 60 - 30).cast("double"), F.lit(0.0))
    return cameras(fx.frames(spark, d)).select("image_id", p.alias("p")).select("image_id", F.round("p.x", 4).alias("u"), F.round("p.y", 4).alias("v"))


@register("p23_angles_round_trip", f"SELECT image_id, pan, tilt, 2.0 AS roll FROM {FR} f")
def _(spark, d):
    r = geo.rotation(F.col("pan"), F.col("tilt"), F.lit(2.0))
    return fx.frames(spark, d).select("image_id", geo.angles(r).alias("a")).select("image_id", *[F.round(f"a.{c}", 6).alias(c) for c in ("pan", "tilt", "roll")])


#: The product of the three turns, step by step, and its transpose.
TURNED = f"(SELECT image_id, cp, -sp * ct AS a01, sp * st AS a02, sp, cp * ct AS a11, -cp * st AS a12, st AS a21, ct AS a22, cos(radians(2.0)) AS cr, sin(radians(2.0)) AS sr FROM (SELECT image_id, cos(radians(pan)) AS cp, sin(radians(pan)) AS sp, cos(radians(tilt)) AS ct, sin(radians(tilt)) AS st FROM {FR} f) q)"


@register("p23_rotation", f"SELECT image_id, round(cp * cr + a01 * sr, 6) AS r00, round(sp * cr + a11 * sr, 6) AS r01, round(a21 * sr, 6) AS r02, round(-cp * sr + a01 * cr, 6) AS r10, round(-sp * sr + a11 * cr, 6) AS r11, round(a21 * cr, 6) AS r12, round(a02, 6) AS r20, round(a12, 6) AS r21, round(a22, 6) AS r22 FROM {TURNED} t")
def _(spark, d):
    r = geo.rotation(F.col("pan"), F.col("tilt"), F.lit(2.0))
    return fx.frames(spark, d).select("image_id", *[F.round(r[i][j], 6).alias(f"r{i}{j}") for i in range(3) for j in range(3)])


@register("p24_homography", f"SELECT image_id, CASE WHEN abs(z) > 0.5 THEN round(f * (cp * x + sp * y) / z + 960, 4) END AS u, CASE WHEN abs(z) > 0.5 THEN round(f * (-sp * ct * x + cp * ct * y + st * 15) / z + 540, 4) END AS v FROM (SELECT *, sp * st * x - cp * st * y + ct * 15 AS z FROM (SELECT *, image_id % 90 - 45.0E0 AS x, image_id % 50 - 25.0E0 - 60 AS y FROM {CAM_SQL} c) q) w")
def _(spark, d):
    f = cameras(fx.frames(spark, d))
    p = geo.apply_homography(geo.homography(F.col("cam")), (F.col("image_id") % 90 - 45).cast("double"), (F.col("image_id") % 50 - 25).cast("double"))
    depth = F.expr("abs(sin(radians(pan)) * sin(radians(tilt)) * (image_id % 90 - 45.0D) - cos(radians(pan)) * sin(radians(tilt)) * (image_id % 50 - 85.0D) + cos(radians(tilt)) * 15)")
    return f.select("image_id", "pan", "tilt", p.alias("p")).select("image_id", F.when(depth > 0.5, F.round("p.x", 4)).alias("u"), F.when(depth > 0.5, F.round("p.y", 4)).alias("v"))


@register("p24_homography_round_trip", f"SELECT image_id, CAST(image_id % 90 - 45 AS DOUBLE) AS x, CAST(image_id % 50 - 25 AS DOUBLE) AS y FROM {FR} f")
def _(spark, d):
    h = geo.homography(F.col("cam"))
    there = cameras(fx.frames(spark, d)).select("image_id", "cam", geo.apply_homography(h, (F.col("image_id") % 90 - 45).cast("double"), (F.col("image_id") % 50 - 25).cast("double")).alias("p"))
    back = there.select("image_id", geo.apply_homography(geo.inverse(h), F.col("p.x"), F.col("p.y")).alias("q"))
    return back.select("image_id", (F.round("q.x", 4) + 0.0).alias("x"), (F.round("q.y", 4) + 0.0).alias("y"))


@register("p27_rescaled_camera", f"SELECT image_id, round(960 / tan(radians(hfov) / 2) * 0.5, 6) AS fx, 480.0 AS cx, 270.0 AS cy FROM {FR} f")
def _(spark, d):
    c = geo.rescaled(F.col("cam"), 960.0, 540.0)
    return cameras(fx.frames(spark, d)).select("image_id", F.round(c["x_focal_length"], 6).alias("fx"), F.get(c["principal_point"], F.lit(0)).alias("cx"), F.get(c["principal_point"], F.lit(1)).alias("cy"))


def pt(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


@register("p28_scaled_lines", f"SELECT det_id, round(CASE WHEN det_id % 2 = 0 THEN l / 400 * 960 WHEN greatest(l, t) > 1.5 THEN l * 0.5 ELSE l * 960 END, 6) AS x, round(CASE WHEN det_id % 2 = 0 THEN t / 400 * 540 WHEN greatest(l, t) > 1.5 THEN t * 0.5 ELSE t * 540 END, 6) AS y FROM {D} d")
def _(spark, d):
    k = F.when(F.col("det_id") % 2 == 0, 400.0).otherwise(1.0)
    lines = F.create_map(F.lit("a"), F.array(pt(F.col("l") / k, F.col("t") / k)))
    s = geo.scaled_lines(lines, 960.0, 540.0)
    return fx.detections(spark, d).select("det_id", F.get(s["a"], F.lit(0)).alias("p")).select("det_id", *[F.round(f"p.{c}", 6).alias(c) for c in "xy"])


SEG = "sqrt(power({x} - ({a} + k{i} * ({c} - {a})), 2) + power({y} - ({b} + k{i} * ({e} - {b})), 2))"


@register(
    "j19_polyline_distance",
    f"""WITH q AS (SELECT det_id, l, t, w, h, greatest(0, least(1, ((l - 50) * 100 + (t - 60) * 40) / 11600)) AS k1, greatest(0, least(1, ((l - 150) * 50 + (t - 100) * 150) / 25000)) AS k2 FROM {D} d)
    SELECT det_id, round(least({SEG.format(x="l", y="t", a=50, b=60, c=150, e=100, i=1)}, {SEG.format(x="l", y="t", a=150, b=100, c=200, e=250, i=2)}), 6) AS d FROM q""",
)
def _(spark, d):
    line = F.array(*[pt(F.lit(float(x)), F.lit(float(y))) for x, y in ((50, 60), (150, 100), (200, 250))])
    return fx.detections(spark, d).select("det_id", F.round(geo.polyline_distance(F.col("l"), F.col("t"), line), 6).alias("d"))


@register("a30_extremities", f"SELECT det_id, round(CASE WHEN flip THEN b1 ELSE a1 END, 6) AS d1, round(CASE WHEN flip THEN b2 ELSE a2 END, 6) AS d2, CAST((CASE WHEN flip THEN b1 ELSE a1 END < 60) AS INTEGER) + CAST((CASE WHEN flip THEN b2 ELSE a2 END < 60) AS INTEGER) AS tp FROM (SELECT *, b1 <= a1 AND b2 <= a2 AS flip FROM (SELECT det_id, sqrt(power(l - 50, 2) + power(t - 60, 2)) AS a1, sqrt(power(l + w - 200, 2) + power(t + h - 250, 2)) AS a2, sqrt(power(l - 200, 2) + power(t - 250, 2)) AS b1, sqrt(power(l + w - 50, 2) + power(t + h - 60, 2)) AS b2 FROM {D} d) q) z")
def _(spark, d):
    gt = F.array(pt(F.lit(50.0), F.lit(60.0)), pt(F.lit(200.0), F.lit(250.0)))
    e = geo.extremity_distances(F.array(pt(F.col("l"), F.col("t")), pt(F.col("l") + F.col("w"), F.col("t") + F.col("h"))), gt)
    out = fx.detections(spark, d).select("det_id", e.alias("e"))
    return out.select("det_id", F.round(F.get("e", F.lit(0)), 6).alias("d1"), F.round(F.get("e", F.lit(1)), 6).alias("d2"), F.size(F.filter("e", lambda x: x < 60)).alias("tp"))


@register("a29_line_confusion", f"SELECT image_id, count(*) FILTER (p AND g AND far = 0) AS tp, count(*) FILTER (p AND (NOT g OR far > 0)) AS fp, count(*) FILTER (NOT p) AS fn FROM (SELECT image_id, class, bool_or(conf > 0.3) AS p, bool_or(conf < 0.8) AS g, count(*) FILTER (w >= 45) AS far FROM (SELECT *, l % 3 AS class FROM {D} d) q GROUP BY image_id, class) z WHERE p OR g GROUP BY image_id")
def _(spark, d):
    lines = fx.detections(spark, d).groupBy("image_id", (F.col("l") % 3).alias("class")).agg(F.bool_or(F.col("conf") > 0.3).alias("in_pred"), F.bool_or(F.col("conf") < 0.8).alias("in_gt"), F.collect_list("w").alias("dists"))
    return metrics.confusion(lines.where("in_pred OR in_gt"), 45.0)


# --- joins and sets ----------------------------------------------------------------------------------------


@register("j2_frame_lookup", f"SELECT det_id, regexp_extract(file_path, '[^/]+$') AS file, d.frame = f.frame AS same FROM {D} d JOIN {FR} f USING (image_id)")
def _(spark, d):
    f = fx.frames(spark, d).select("image_id", "file_path", F.col("frame").alias("f"))
    return fx.detections(spark, d).join(f, "image_id").select("det_id", text.basename(F.col("file_path")).alias("file"), (F.col("frame") == F.col("f")).alias("same"))


@register("j3_camera_by_name", f"SELECT a.image_id, b.score FROM {FR} a LEFT JOIN (SELECT seq, regexp_extract(file_path, '[^/]+$') AS n, score FROM {FR} f WHERE listed) b ON b.seq = a.seq AND b.n = regexp_extract(a.file_path, '[^/]+$')")
def _(spark, d):
    f = fx.frames(spark, d).withColumn("n", text.basename(F.col("file_path")))
    return f.select("seq", "image_id", "n").join(f.where("listed").select("seq", "n", "score"), ["seq", "n"], "left").select("image_id", "score")


@register("j7_single_manifest", f"WITH f AS ({overlap_sql('b.track_id IS NOT NULL')}) SELECT seq, track_id, count(*) AS frames, min(frame) AS first FROM {D} d JOIN f USING (det_id) WHERE track_id IS NOT NULL AND crop_single GROUP BY seq, track_id")
def _(spark, d):
    rows = overlap.crop_filter(fx.detections(spark, d)).where("track_id IS NOT NULL AND crop_single")
    man = rows.groupBy("seq", "track_id").agg(F.array_sort(F.collect_list(F.struct("frame", "det_id"))).alias("m"))
    return man.select("seq", "track_id", F.size("m").cast("long").alias("frames"), F.get("m", F.lit(0))["frame"].alias("first"))


@register("j8_unanswered", f"SELECT seq, track_id FROM {D} d WHERE track_id IS NOT NULL EXCEPT SELECT seq, track_id FROM {D} d WHERE conf > 0.95")
def _(spark, d):
    det = fx.detections(spark, d)
    all_ = det.where("track_id IS NOT NULL").select("seq", "track_id").distinct()
    return all_.join(det.where("conf > 0.95").select("seq", "track_id"), ["seq", "track_id"], "left_anti")


NUM = f"(SELECT seq, track_id, CAST(track_id % 8 AS STRING) AS number, cluster FROM {TRAJ} t WHERE track_id % 5 > 0)"


def numbered(spark, d):
    return trajectories(spark, d).where("track_id % 5 > 0").select("seq", "track_id", (F.col("track_id") % 8).cast("string").alias("number"), "cluster")


@register("j9_seed_pairs", f"SELECT a.seq, a.track_id AS a, b.track_id AS b, a.number FROM {NUM} a JOIN {NUM} b ON a.seq = b.seq AND a.number = b.number AND a.track_id < b.track_id WHERE coalesce(a.cluster = b.cluster, TRUE)")
def _(spark, d):
    return refine.seed_pairs(numbered(spark, d))


@register("j10_seen_together", f"WITH p AS (SELECT a.seq, a.track_id AS a, b.track_id AS b, a.number FROM {NUM} a JOIN {NUM} b ON a.seq = b.seq AND a.number = b.number AND a.track_id < b.track_id WHERE coalesce(a.cluster = b.cluster, TRUE)), c AS (SELECT DISTINCT seq, track_id, frame FROM {D} d WHERE track_id IS NOT NULL AND conf > 0.5) SELECT seq, a, b, EXISTS (SELECT 1 FROM c x JOIN c y ON x.seq = y.seq AND x.frame = y.frame WHERE x.seq = p.seq AND x.track_id = p.a AND y.track_id = p.b) AS together FROM p")
def _(spark, d):
    return refine.seen_together(refine.seed_pairs(numbered(spark, d)), fx.detections(spark, d).withColumn("clean", F.col("conf") > 0.5)).select("seq", "a", "b", "together")


def pairs_by(rule):
    def q(spark, d):
        p, g = pred_gt(spark, d)
        return matching.match(p, g, rule).select("image_id", "pred_id", "gt_id", *r6("iou"))

    return q


#: Pairs of an image in the order in which a rule looks at them; each is taken unless one of its boxes has gone.
def taken_sql(order: str) -> str:
    return f"""(WITH RECURSIVE q AS (SELECT image_id, list(struct_pack(p := pred_id, g := gt_id, v := iou) ORDER BY {order}) AS x FROM {IOU_SQL} z WHERE iou >= 0.5 GROUP BY image_id),
s AS (SELECT image_id, x, 1 AS k, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS gs, CAST([] AS DOUBLE[]) AS vs FROM q
UNION ALL SELECT image_id, x, k + 1, CASE WHEN f THEN list_append(ps, x[k].p) ELSE ps END, CASE WHEN f THEN list_append(gs, x[k].g) ELSE gs END, CASE WHEN f THEN list_append(vs, x[k].v) ELSE vs END
FROM (SELECT *, NOT list_contains(ps, x[k].p) AND NOT list_contains(gs, x[k].g) AS f FROM s WHERE k <= len(x)) t)
SELECT image_id, unnest(ps) AS pred_id, unnest(gs) AS gt_id, unnest(vs) AS iou FROM s WHERE k = len(x) + 1)"""


GREEDY, ORDERLY = taken_sql("iou DESC, pred_id, gt_id"), taken_sql("pred_id, iou DESC, gt_id DESC")
#: The largest total IoU of each image: every prediction in turn goes to each free box that it touches, or to none; a state is the set of boxes taken.
TOTALS = f"""(WITH RECURSIVE p AS (SELECT image_id, pred_id, list(struct_pack(g := gt_id, v := iou)) AS x FROM {IOU_SQL} z WHERE iou > 0 GROUP BY image_id, pred_id),
q AS (SELECT image_id, list(x ORDER BY pred_id) AS xs FROM p GROUP BY image_id),
s AS (SELECT image_id, xs, 1 AS k, CAST([] AS BIGINT[]) AS gs, 0.0E0 AS total FROM q
UNION ALL SELECT image_id, xs, k + 1, CASE WHEN o.v > 0 THEN list_append(gs, o.g) ELSE gs END, total + o.v FROM (SELECT *, unnest(list_append(xs[k], struct_pack(g := CAST(-1 AS BIGINT), v := 0.0E0))) AS o FROM s WHERE k <= len(xs)) t WHERE NOT list_contains(gs, o.g))
SELECT image_id, max(total) AS total FROM s WHERE k = len(xs) + 1 GROUP BY image_id)"""


register("j13_optimal_matches")(pairs_by(matching.optimal))
register("j14_greedy_matches", f"SELECT image_id, pred_id, gt_id, round(iou, 6) AS iou FROM {GREEDY} m")(pairs_by(matching.greedy))
register("j15_matches_in_order", f"SELECT image_id, pred_id, gt_id, round(iou, 6) AS iou FROM {ORDERLY} m")(pairs_by(matching.in_order))


# assignments of one total may differ between engines, their totals do not
@register("j13_optimal_totals", f"SELECT image_id, round(total, 6) AS total FROM {TOTALS} m")
def _(spark, d):
    p, g = pred_gt(spark, d)
    return matching.match(p, g, matching.optimal, 1e-12).groupBy("image_id").agg(F.round(F.sum("iou"), 6).alias("total"))


@register("a25_detection_metrics", f"SELECT tp, n_gt, n_pred, round(m, 6) AS mean_iou, round(tp / CAST(n_pred AS DOUBLE), 6) AS precision, round(tp / CAST(n_gt AS DOUBLE), 6) AS recall, round(2.0 * tp / (n_pred + n_gt), 6) AS f1 FROM (SELECT count(*) AS tp, avg(iou) AS m FROM {GREEDY} x) a, (SELECT count(*) AS n_gt, count(*) FILTER (conf > 0.2) AS n_pred FROM {D} d) b")
def _(spark, d):
    p, g = pred_gt(spark, d)
    return metrics.detection_summary(g, p, matching.match(p, g, matching.greedy)).select("tp", "n_gt", "n_pred", *r6("mean_iou", "precision", "recall", "f1"))


@register("a25_recall_by_height", f"SELECT CASE WHEN h < 40 THEN 0 WHEN h < 80 THEN 40 ELSE 80 END AS bin, count(*) AS n, round(count(gt_id) / CAST(count(*) AS DOUBLE), 6) AS recall FROM {D} d LEFT JOIN {GREEDY} m ON d.det_id = m.gt_id GROUP BY 1")
def _(spark, d):
    p, g = pred_gt(spark, d)
    return metrics.recall_by_height(g, matching.match(p, g, matching.greedy)).select("bin", "n", *r6("recall"))


def jersey_pairs(spark, d):
    p, g = pred_gt(spark, d)
    jn = text.norm_jn(F.col("number"))
    p = p.where("track_id IS NOT NULL").withColumn("jn", F.coalesce(F.when(F.col("det_id") % 10 > 0, jn), F.lit(-1)))
    g = g.where("track_id IS NOT NULL").withColumn("jn", F.coalesce(jn, F.lit(-1)))
    return matching.pairs_of(matching.match(p, g, matching.optimal), p, g), g


@register("a27_jersey_metrics")
def _(spark, d):
    pairs, g = jersey_pairs(spark, d)
    return metrics.jersey_counts(pairs).crossJoin(metrics.jersey_tracks(pairs, g)).select(*r6("det_acc_all"), "tp", "fp", "fn", *r6("precision", "recall", "f1", "trk_acc_all", "trk_acc_numbered"), "n_tracks")  # one row each


APART = f"(SELECT *, CASE WHEN number IS NULL THEN -1 ELSE CAST(number AS BIGINT) END AS g_jn, CASE WHEN det_id % 7 = 0 OR number IS NULL THEN -1 WHEN det_id % 11 = 0 THEN CAST(number AS BIGINT) + 1 ELSE CAST(number AS BIGINT) END AS p_jn, CASE WHEN frame % 50 > 40 THEN track_id + 100 ELSE track_id END AS p_track FROM {TR} t)"


# boxes of a track keep to a strip of their own, so each has one possible match
@register(
    "a27_separate_tracks",
    f"""WITH b AS {APART}, m AS (SELECT * FROM b WHERE det_id % 10 > 0 AND (w - det_id % 5) / (w + det_id % 5) >= 0.5), c AS (SELECT avg(CASE WHEN p_jn = g_jn THEN 1.0 ELSE 0 END) AS acc, count(*) FILTER (g_jn <> -1 AND p_jn = g_jn) AS tp, count(*) FILTER (p_jn <> -1 AND p_jn <> g_jn) AS fp, count(*) FILTER (g_jn <> -1 AND p_jn <> g_jn) AS fn FROM m),
    t AS (SELECT track_id, arg_min(g_jn, (-n, g_jn)) AS number FROM (SELECT track_id, g_jn, count(*) AS n FROM b GROUP BY track_id, g_jn) q GROUP BY track_id), p AS (SELECT p_track, arg_min(p_jn, (-n, p_jn)) AS number FROM (SELECT p_track, p_jn, count(*) AS n FROM m GROUP BY p_track, p_jn) q GROUP BY p_track),
    o AS (SELECT p_track, arg_min(track_id, (-n, track_id)) AS track_id FROM (SELECT p_track, track_id, count(*) AS n FROM m GROUP BY p_track, track_id) q GROUP BY p_track),
    k AS (SELECT avg(CASE WHEN p.number = t.number THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN t.number <> -1 THEN CASE WHEN p.number = t.number THEN 1.0 ELSE 0 END END) AS n, count(*) AS n_tracks FROM p JOIN o USING (p_track) LEFT JOIN t USING (track_id))
    SELECT round(acc, 6) AS det_acc_all, tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(a, 6) AS trk_acc_all, round(n, 6) AS trk_acc_numbered, n_tracks FROM c, k""",
)
def _(spark, d):
    k, jn = F.col("det_id"), F.coalesce(text.norm_jn(F.col("number")), F.lit(-1))
    g = fx.tracked(spark, d).withColumn("l", F.col("track_id") * 70.0).withColumn("jn", jn)
    p = g.where("det_id % 10 > 0").withColumns({"l": F.col("l") + k % 5, "jn": F.when((k % 7 == 0) | (F.col("jn") == -1), -1).when(k % 11 == 0, F.col("jn") + 1).otherwise(F.col("jn")), "track_id": F.when(F.col("frame") % 50 > 40, F.col("track_id") + 100).otherwise(F.col("track_id"))})
    pairs = matching.pairs_of(matching.match(p, g, matching.optimal), p, g)
    return metrics.jersey_counts(pairs).crossJoin(metrics.jersey_tracks(pairs, g)).select(*r6("det_acc_all"), "tp", "fp", "fn", *r6("precision", "recall", "f1", "trk_acc_all", "trk_acc_numbered"), "n_tracks")  # one row each


@register("j17_cache_compare", f"SELECT count(*) FILTER (a.det_id IS NULL OR b.det_id IS NULL) AS one_sided, count(*) FILTER (a.conf IS DISTINCT FROM b.conf) AS differ, count(*) AS n FROM (SELECT det_id, conf FROM {D} d WHERE det_id % 11 > 0) a FULL JOIN (SELECT det_id, CASE WHEN det_id % 17 = 0 THEN conf + 1 ELSE conf END AS conf FROM {D} d WHERE det_id % 13 > 0) b ON a.det_id = b.det_id")
def _(spark, d):
    det = fx.detections(spark, d)
    a = det.where("det_id % 11 > 0").select("det_id", "conf")
    b = det.where("det_id % 13 > 0").select(F.col("det_id").alias("b_id"), F.when(F.col("det_id") % 17 == 0, F.col("conf") + 1).otherwise(F.col("conf")).alias("b_conf"))
    j = a.join(b, F.col("det_id") == F.col("b_id"), "full_outer")
    return j.agg(F.count_if(F.col("det_id").isNull() | F.col("b_id").isNull()).alias("one_sided"), F.count_if(~F.col("conf").eqNullSafe(F.col("b_conf"))).alias("differ"), F.count("*").alias("n"))


@register("j20_line_classes", f"SELECT image_id, count(*) FILTER (p AND g) AS common, count(*) FILTER (p AND NOT g) AS only_pred, count(*) FILTER (NOT p AND g) AS only_gt FROM (SELECT coalesce(a.image_id, b.image_id) AS image_id, a.image_id IS NOT NULL AS p, b.image_id IS NOT NULL AS g FROM (SELECT DISTINCT image_id, l % 5 AS c FROM {D} d WHERE conf > 0.4) a FULL JOIN (SELECT DISTINCT image_id, l % 5 AS c FROM {D} d WHERE conf < 0.7) b ON a.image_id = b.image_id AND a.c = b.c) q GROUP BY image_id")
def _(spark, d):
    det = fx.detections(spark, d).withColumn("c", F.col("l") % 5)
    a = det.where("conf > 0.4").select("image_id", "c").distinct().withColumn("p", F.lit(True))
    b = det.where("conf < 0.7").select("image_id", "c").distinct().withColumn("g", F.lit(True))
    p, g = F.col("p").isNotNull(), F.col("g").isNotNull()
    return a.join(b, ["image_id", "c"], "full_outer").groupBy("image_id").agg(F.count_if(p & g).alias("common"), F.count_if(p & ~g).alias("only_pred"), F.count_if(~p & g).alias("only_gt"))


@register("o1_stable_order", f"SELECT det_id, row_number() OVER (PARTITION BY seq ORDER BY track_id, image_id, det_id) AS place FROM {D} d WHERE track_id IS NOT NULL")
def _(spark, d):
    w = Window.partitionBy("seq").orderBy("track_id", "image_id", "det_id")
    return fx.detections(spark, d).where("track_id IS NOT NULL").select("det_id", F.row_number().over(w).cast("long").alias("place"))


@register("o4_union_by_name", f"SELECT det_id, conf, track_id FROM {D} d WHERE conf > 0.5 UNION ALL SELECT det_id, NULL, track_id FROM {D} d WHERE track_id = 3")
def _(spark, d):
    det = fx.detections(spark, d)
    return det.where("conf > 0.5").select("det_id", "conf", "track_id").unionByName(det.where("track_id = 3").select("track_id", "det_id"), allowMissingColumns=True)


# all sequences; the tracks of a fixture column have no low box
@register("o5_set_operations_whole", f"WITH d AS (SELECT seq, track_id, conf, CASE WHEN track_id % 5 = 0 THEN conf + 1 ELSE conf END AS low FROM {D} d) SELECT 'both' AS kind, seq, track_id FROM (SELECT seq, track_id FROM d WHERE conf > 0.9 INTERSECT SELECT seq, track_id FROM d WHERE low < 0.1) a UNION ALL SELECT 'first', seq, track_id FROM (SELECT seq, track_id FROM d WHERE conf > 0.9 EXCEPT SELECT seq, track_id FROM d WHERE low < 0.1) b")
def _(spark, d):
    det = fx.detections(spark, d).withColumn("low", F.when(F.col("track_id") % 5 == 0, F.col("conf") + 1).otherwise(F.col("conf")))
    a, b = det.where("conf > 0.9").select("seq", "track_id"), det.where("low < 0.1").select("seq", "track_id")
    return a.intersect(b).select(F.lit("both").alias("kind"), "seq", "track_id").unionByName(a.subtract(b).select(F.lit("first").alias("kind"), "seq", "track_id"))


# the order of a seed is that of the MD5 of seed and id, which any engine can make
@register("o6_stratified_sample", f"SELECT det_id, crop_single FROM (SELECT f.det_id, crop_single, row_number() OVER (PARTITION BY crop_single ORDER BY md5(concat('0|', CAST(f.det_id AS STRING))), f.det_id) AS r FROM ({overlap_sql('b.track_id IS NOT NULL')}) f JOIN {D} d ON f.det_id = d.det_id WHERE track_id IS NOT NULL) q WHERE r <= 24")
def _(spark, d):
    det = overlap.crop_filter(fx.detections(spark, d)).where("track_id IS NOT NULL")
    halves = [det.where(F.col("crop_single") == s).orderBy(F.md5(F.concat(F.lit("0|"), F.col("det_id").cast("string"))), "det_id").limit(24) for s in (True, False)]
    return halves[0].unionByName(halves[1]).select("det_id", "crop_single")


# --- aggregates, windows ---------------------------------------------------------------------------------------


def median_with_fallback(r):
    w = Window.partitionBy("seq", "track_id")
    r = r.withColumn("rr", F.round("crop_rt", 6))
    r = r.withColumn("ns", F.sum(F.col("crop_single").cast("int")).over(w)).withColumn("i", F.row_number().over(w.orderBy("rr", "det_id")))
    return r.where(F.when(F.col("ns") >= 3, F.col("crop_single")).otherwise(F.col("i") <= 3)).groupBy("seq", "track_id").agg(F.median("l").alias("m"), (F.max("ns") < 3).alias("fallback"))


# every tracked box; the tracks of a fixture column have no single crops and fall back
@register("a5_median_with_fallback_whole", f"WITH f AS ({overlap_sql('b.track_id IS NOT NULL')}), s AS (SELECT seq, track_id, det_id, crop_rt, l, crop_single AND track_id % 8 > 0 AS single FROM f JOIN {D} d USING (det_id) WHERE track_id IS NOT NULL), r AS (SELECT *, sum(CAST(single AS INTEGER)) OVER (PARTITION BY seq, track_id) AS ns, row_number() OVER (PARTITION BY seq, track_id ORDER BY crop_rt, det_id) AS i FROM s) SELECT seq, track_id, median(l) AS m, max(ns) < 3 AS fallback FROM r WHERE CASE WHEN ns >= 3 THEN single ELSE i <= 3 END GROUP BY seq, track_id")
def _(spark, d):
    r = overlap.crop_filter(fx.detections(spark, d)).where("track_id IS NOT NULL")
    return median_with_fallback(r.withColumn("crop_single", F.col("crop_single") & (F.col("track_id") % 8 > 0)))


@register("a7_mergeable_centroid", f"SELECT seq, round(sum(s) / sum(n), 6) AS mean FROM (SELECT seq, track_id, sum(l) AS s, count(*) AS n FROM {D} d GROUP BY seq, track_id) q GROUP BY seq")
def _(spark, d):
    parts = fx.detections(spark, d).groupBy("seq", "track_id").agg(F.sum("l").alias("s"), F.count("*").alias("n"))
    return parts.groupBy("seq").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean"))


@register("a19_majority_vote", f"WITH c AS (SELECT seq, track_id, number, count(*) AS n FROM {D} d WHERE track_id IS NOT NULL AND number IS NOT NULL GROUP BY seq, track_id, number) SELECT seq, track_id, number AS winner FROM (SELECT *, row_number() OVER (PARTITION BY seq, track_id ORDER BY n DESC, number) AS r FROM c) q WHERE r = 1")
def _(spark, d):
    return fx.detections(spark, d).where("track_id IS NOT NULL AND number IS NOT NULL").groupBy("seq", "track_id").agg(F.mode("number", True).alias("winner"))


@register("a26_metric_matrix", f"SELECT seq, round(avg(conf) FILTER (track_id % 2 = 0), 6) AS even, round(avg(conf) FILTER (track_id % 2 = 1), 6) AS odd, round(avg(conf) FILTER (track_id % 2 = 1) - avg(conf) FILTER (track_id % 2 = 0), 6) AS delta FROM {D} d WHERE track_id IS NOT NULL GROUP BY seq")
def _(spark, d):
    p = fx.detections(spark, d).where("track_id IS NOT NULL").withColumn("arm", F.when(F.col("track_id") % 2 == 0, "even").otherwise("odd")).groupBy("seq").pivot("arm", ["even", "odd"]).agg(F.avg("conf"))
    return p.select("seq", *r6("even", "odd"), F.round(F.col("odd") - F.col("even"), 6).alias("delta"))


@register("a34_track_lengths", f"SELECT seq, count(*) AS tracks, median(n) AS median_len, min(n) AS min_len, round(count(*) FILTER (n < 15) / CAST(count(*) AS DOUBLE), 6) AS short FROM (SELECT seq, track_id, count(*) AS n FROM {D} d WHERE track_id IS NOT NULL GROUP BY seq, track_id) q GROUP BY seq")
def _(spark, d):
    n = fx.detections(spark, d).where("track_id IS NOT NULL").groupBy("seq", "track_id").agg(F.count("*").alias("n"))
    return n.groupBy("seq").agg(F.count("*").alias("tracks"), F.median("n").alias("median_len"), F.min("n").alias("min_len"), F.round(F.try_divide(F.count_if(F.col("n") < 15).cast("double"), F.count("*")), 6).alias("short"))


@register("a35_constancy", f"SELECT seq, track_id FROM {D} d WHERE track_id IS NOT NULL GROUP BY seq, track_id HAVING count(DISTINCT number) > 1")
def _(spark, d):
    return audit.not_constant(fx.detections(spark, d), "number")


@register("a36_histogram", f"SELECT CAST(least(floor(conf * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM {D} d GROUP BY bin")
def _(spark, d):
    return fx.detections(spark, d).groupBy(F.least(F.floor(F.col("conf") * 10), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@register("a37_threshold_sweep", f"WITH g AS (SELECT unnest(range(0, 41)) AS i), s AS (SELECT i, avg(CASE WHEN (conf >= i / 40.0) = (number IS NOT NULL) THEN 1.0 ELSE 0 END) AS acc FROM {D} d, g GROUP BY i) SELECT i, round(acc, 6) AS acc, row_number() OVER (ORDER BY round(acc, 9) DESC, i) = 1 AS best FROM s")
def _(spark, d):
    # forty-one thresholds counted in one pass over the rows
    ok = [F.avg(((F.col("conf") >= i / 40.0) == F.col("number").isNotNull()).cast("double")).alias(f"t{i}") for i in range(41)]
    one = fx.detections(spark, d).agg(*ok).select(F.posexplode(F.array(*[f"t{i}" for i in range(41)])).alias("i", "acc"))
    return one.select(F.col("i").cast("long").alias("i"), F.round("acc", 6).alias("acc"), (F.row_number().over(Window.orderBy(F.round("acc", 9).desc(), "i")) == 1).alias("best"))


@register("a38_score_summary", f"SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(median(score), 6) AS median, round(avg(CASE WHEN listed THEN 1.0 ELSE 0 END) * avg(score), 6) AS final FROM {FR} f")
def _(spark, d):
    return fx.frames(spark, d).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.median("score").alias("median"), (F.avg(F.col("listed").cast("double")) * F.avg("score")).alias("final")).select(*r6("mean", "std", "median", "final"))


@register("w7_extreme_per_half", f"SELECT seq, side, track_id FROM (SELECT seq, CAST(sign(mx) AS INTEGER) AS side, track_id, row_number() OVER (PARTITION BY seq, sign(mx) ORDER BY abs(mx) DESC, track_id) AS r FROM {TRAJ} t WHERE mx <> 0) q WHERE r = 1")
def _(spark, d):
    t = trajectories(spark, d).where("mx <> 0").withColumn("side", F.signum("mx").cast("int"))
    return t.withColumn("r", F.row_number().over(Window.partitionBy("seq", "side").orderBy(F.abs("mx").desc(), "track_id"))).where("r = 1").select("seq", "side", "track_id")


@register("w8_room_capped", f"WITH t AS (SELECT *, count(*) FILTER (track_id % 6 = 0) OVER (PARTITION BY seq) AS used FROM {TRAJ} q), c AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY abs(my) DESC, track_id) AS r FROM t WHERE track_id % 6 > 0 AND sx > 30) SELECT seq, track_id FROM c WHERE r <= 7 - used")
def _(spark, d):
    w = Window.partitionBy("seq")
    t = trajectories(spark, d).withColumn("used", F.count_if(F.col("track_id") % 6 == 0).over(w)).where("track_id % 6 > 0 AND sx > 30")
    return t.withColumn("r", F.row_number().over(w.orderBy(F.abs("my").desc(), "track_id"))).where(F.col("r") <= 7 - F.col("used")).select("seq", "track_id")


@register("w9_kth_neighbour", "WITH p AS (SELECT a.label, a.vec_id, b.vec_id AS o, greatest(0, least(2, 1 - list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i])))) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT label, vec_id, round(d, 5) AS d FROM (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY d, o) AS r FROM p) q WHERE r = 3")
def _(spark, d):
    fx.views(spark, d, "embeddings")
    return metric_space.neighbour_distance(spark.table("embeddings"), "label").select("label", "vec_id", F.round("d", 5).alias("d"))


NEAR = "SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label WHERE greatest(0, least(2, 1 - list_inner_product(a.e, b.e) / (a.n * b.n))) <= 0.75"


@register(
    "a10_density_clusters",
    f"""WITH RECURSIVE v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings), near AS MATERIALIZED ({NEAR}),
    core AS MATERIALIZED (SELECT label, a FROM near GROUP BY label, a HAVING count(*) >= 3), tie AS MATERIALIZED (SELECT n.* FROM near n JOIN core x ON n.a = x.a JOIN core y ON n.b = y.a),
    reach AS (SELECT label, a, a AS b FROM core UNION SELECT r.label, r.a, t.b FROM reach r JOIN tie t ON r.b = t.a), root AS (SELECT label, a, min(b) AS root FROM reach GROUP BY label, a),
    num AS (SELECT label, a, dense_rank() OVER (PARTITION BY label ORDER BY root) - 1 AS k FROM root), fringe AS (SELECT n.a, min(k) AS k FROM near n JOIN num ON n.b = num.a WHERE n.a NOT IN (SELECT a FROM core) GROUP BY n.a)
    SELECT v.label, v.vec_id, coalesce(num.k, fringe.k, -1) AS cluster FROM v LEFT JOIN num ON v.vec_id = num.a LEFT JOIN fringe ON v.vec_id = fringe.a""",
)
def _(spark, d):
    fx.views(spark, d, "embeddings")
    return metric_space.density_clusters(spark.table("embeddings"), "label", 0.75, 3)


@register("a9_team_clusters")
def _(spark, d):
    fx.views(spark, d, "embeddings")
    e = spark.table("embeddings").withColumns({"seq": F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string")), "track_id": F.floor(F.col("vec_id") / 4) % 25})
    m = tracks.median_vectors(e, ["seq", "track_id"], "embedding")
    return cluster.team_clusters(m).select("seq", "track_id", "cluster", "nearest")


def embedded(spark, d) -> DataFrame:
    """Tracked boxes, one a frame and track, with an embedding of their track and box."""
    fx.views(spark, d, "embeddings")
    e = spark.table("embeddings").select("vec_id", "embedding")
    n = e.agg(F.count("*").alias("n"))
    t = fx.tracked(spark, d).withColumn("dup", F.row_number().over(Window.partitionBy("seq", "track_id", "frame").orderBy("det_id"))).where("dup = 1")
    key = (F.col("track_id") * 3 + F.when(F.col("frame") % 40 > 30, 1).otherwise(0)) % F.col("n")
    return t.crossJoin(F.broadcast(n)).withColumn("vec_id", key).join(e, "vec_id").withColumn("clean", F.col("conf") > 0.3)  # one row


@register("x2_split_tracks")
def _(spark, d):
    return cluster.split_tracks(embedded(spark, d)).select("det_id", "track_id", "fragment")


@register("x7_refine_tracks")
def _(spark, d):
    det = embedded(spark, d)
    c = F.array(F.struct((F.col("track_id") % 9).cast("string").alias("label"), F.lit(-0.1).alias("mx"), (1.0 + F.col("track_id")).alias("conf_sum"), F.col("track_id").alias("votes")))
    t = det.groupBy("seq", "track_id").agg(F.count("*").alias("n")).select("seq", "track_id", (F.col("track_id") % 2).cast("int").alias("cluster"), (F.col("track_id") % 9).cast("string").alias("number"), c.alias("candidates"))
    return refine.refine_tracks(det, t, 0.25, 300.0).select("det_id", "track_id_prerefine", "track_id", "number", *r6("confidence"))


# --- scalar functions ---------------------------------------------------------------------------------------------


@register("c10_unit_vectors", "WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings) SELECT vec_id, round(embedding[1] / n, 5) AS first, round(n, 5) AS n FROM n")
def _(spark, d):
    fx.views(spark, d, "embeddings")
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return spark.table("embeddings").select("vec_id", F.round(F.get("embedding", F.lit(0)) / n, 5).alias("first"), F.round(n, 5).alias("n"))


@register("c12_digest", f"SELECT det_id, sha256(concat_ws('|', seq, CAST(det_id AS STRING))) AS h FROM {D} d")
def _(spark, d):
    return fx.detections(spark, d).select("det_id", F.sha2(F.concat_ws("|", "seq", F.col("det_id").cast("string")), 256).alias("h"))


@register("c15_ctc_and_end", f"SELECT image_id, array_to_string(list_filter(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i = 1 OR x[i] <> x[i - 1] THEN x[i] END), lambda v: v IS NOT NULL AND v <> 0), ',') AS ctc, array_to_string(CASE WHEN list_position(x, 2) > 0 THEN x[1:list_position(x, 2) - 1] ELSE x END, ',') AS until_end FROM (SELECT image_id, list(c ORDER BY det_id) AS x FROM (SELECT image_id, det_id, CAST(l % 3 AS BIGINT) AS c FROM {D} d) q GROUP BY image_id) z")
def _(spark, d):
    x = F.transform(F.array_sort(F.collect_list(F.struct("det_id", (F.col("l") % 3).cast("long").alias("c")))), lambda r: r["c"])
    g = fx.detections(spark, d).groupBy("image_id").agg(x.alias("x"))
    return g.select("image_id", F.array_join(text.ctc_collapse(F.col("x")), ",").alias("ctc"), F.array_join(text.until_end(F.col("x"), 2), ",").alias("until_end"))


CODED = f"(SELECT det_id, image_id, number, list_transform(regexp_extract_all(number, '.'), lambda c: CAST(strpos('0123456789', c) AS INTEGER)) AS ids FROM {D} d WHERE number IS NOT NULL)"


# labels of an image are a batch, padded to its longest
@register("c15_token_encode", f"SELECT det_id, array_to_string([11] || ids || [0] || list_transform(range(CAST(max(len(ids)) OVER w AS BIGINT) - len(ids)), lambda i: 12), ',') AS attended, array_to_string(ids || list_transform(range(CAST(max(len(ids)) OVER w AS BIGINT) - len(ids)), lambda i: 0), ',') AS ctc FROM {CODED} c WINDOW w AS (PARTITION BY image_id)")
def _(spark, d):
    rows = fx.detections(spark, d).where("number IS NOT NULL").withColumn("n", F.max(F.length("number")).over(Window.partitionBy("image_id")))
    both = [text.encode(F.col("number"), "0123456789", F.col("n") + more, marked) for more, marked in ((2, True), (0, False))]
    return rows.select("det_id", *[F.array_join(c.cast("array<string>"), ",").alias(k) for k, c in zip(("attended", "ctc"), both, strict=True)])


@register("c17_metric_cells", f"SELECT det_id, CASE WHEN v IS NULL THEN '-' WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS STRING) ELSE printf('%.4f', v) END AS cell FROM (SELECT det_id, px / 4 AS v FROM {D} d) q")
def _(spark, d):
    return fx.detections(spark, d).select("det_id", text.metric_cell(F.col("px") / 4).alias("cell"))


@register("c19_distances", f"SELECT det_id, round(sqrt(px * px + py * py), 6) AS r, CAST(sign(px) AS INTEGER) AS s FROM {D} d WHERE px IS NOT NULL")
def _(spark, d):
    return fx.detections(spark, d).where("px IS NOT NULL").select("det_id", F.round(F.hypot("px", "py"), 6).alias("r"), F.signum("px").cast("int").alias("s"))


@register("c21_pitch_points")
def _(spark, d):
    return spark.createDataFrame(geo.pitch_points(), "class string, i int, x double, y double, z double").select("class", "i", *r6("x", "y", "z"))


@register("s5_camera_json", f"SELECT seq, regexp_extract(file_path, '[^/]+$') AS name, score, pan FROM {FR} f WHERE listed")
def _(spark, d):
    from touchline.sources import camera_json

    cp = F.struct(F.col("pan").alias("panDegrees"))
    one = F.map_from_entries(F.collect_list(F.struct(F.col("file_path"), F.struct(cp.alias("cp"), F.col("score").alias("score"), F.lit(False).alias("reinit")))))
    text_ = fx.frames(spark, d).where("listed").groupBy("seq").agg(F.to_json(one).alias("value"))
    return camera_json.parse(text_).select("seq", "name", "score", F.col("cp.panDegrees").alias("pan"))


# --- audit -----------------------------------------------------------------------------------------------------------


@register("q1_detector_check", f"SELECT seq, 'bbox_detector' AS component, CASE WHEN share < 0.98 THEN 'WARN' ELSE 'PASS' END AS verdict, round(share, 6) AS observed FROM (SELECT f.seq, count(DISTINCT d.image_id) / CAST(count(DISTINCT f.image_id) AS DOUBLE) AS share FROM {FR} f LEFT JOIN {D} d ON f.image_id = d.image_id GROUP BY f.seq) q")
def _(spark, d):
    return audit.detector(fx.detections(spark, d), fx.frames(spark, d)).select("seq", "component", "verdict", F.round(F.col("observed")["share"], 6).alias("observed"))


@register("q2_track_check", f"SELECT seq, round(count(track_id) / CAST(count(*) AS DOUBLE), 6) AS share, CASE WHEN count(track_id) / CAST(count(*) AS DOUBLE) < 0.5 THEN 'WARN' ELSE 'PASS' END AS verdict FROM {D} d GROUP BY seq")
def _(spark, d):
    return audit.tracked_share(fx.detections(spark, d)).select("seq", F.round(F.col("observed")["share"], 6).alias("share"), "verdict")


#: Sequences of which a fixture spoils some rows.
SPOILT = "CAST(substr(seq, 2) AS BIGINT) % 3 = 0"


@register("q5_crop_label_check", f"WITH f AS ({overlap_sql('b.track_id IS NOT NULL')}), x AS (SELECT d.seq, crop_single, crop_trigger, {SPOILT} AND d.det_id % 50 = 0 AS flip, {SPOILT} AND d.det_id % 70 = 0 AS mute FROM f JOIN {D} d ON f.det_id = d.det_id), n AS (SELECT seq, count(*) FILTER (flip) AS wrong, count(*) FILTER (flip <> NOT crop_single AND (crop_trigger IS NULL OR mute)) AS silent, count(*) FILTER (flip <> crop_single AND crop_trigger IS NOT NULL AND NOT mute) AS extra FROM x GROUP BY seq) SELECT seq, wrong, silent, extra, CASE WHEN wrong + silent + extra > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM n")
def _(spark, d):
    bad = F.expr(SPOILT)
    t = overlap.crop_filter(fx.detections(spark, d))
    t = t.withColumn("crop_single", F.col("crop_single") != (bad & (F.col("det_id") % 50 == 0))).withColumn("crop_trigger", F.when(~(bad & (F.col("det_id") % 70 == 0)), F.col("crop_trigger")))
    return audit.crop_labels(t).select("seq", *[F.col("observed")[c].cast("long").alias(c) for c in ("wrong", "silent", "extra")], "verdict")


@register("q7_gate_check", f"WITH m AS (SELECT seq, track_id, avg(px) AS x, avg(py) AS y FROM {D} d WHERE px IS NOT NULL AND py IS NOT NULL AND track_id IS NOT NULL GROUP BY seq, track_id), r AS (SELECT d.seq, d.track_id, det_id, x, {SPOILT.replace('seq', 'd.seq')} AS bad, coalesce(abs(x) > 57.5 OR abs(y) > 39, FALSE) AS off FROM {D} d LEFT JOIN m ON d.seq = m.seq AND d.track_id = m.track_id), n AS (SELECT seq, count(*) FILTER (bad AND track_id % 7 = 1 AND x IS NOT NULL) AS means, count(*) FILTER (bad AND track_id % 7 = 2) AS flags, count(*) FILTER (bad AND (track_id % 7 = 2 OR (track_id % 7 = 3 AND NOT off AND det_id % 2 = 0))) AS ids FROM r GROUP BY seq) SELECT seq, means, flags, ids, CASE WHEN means + flags + ids > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM n")
def _(spark, d):
    bad, k = F.expr(SPOILT), F.col("track_id_pregate") % 7
    t = tracks.pitch_gate(fx.detections(spark, d))
    t = t.withColumn("pitch_mean_x", F.when(bad & (k == 1), F.col("pitch_mean_x") + 1).otherwise(F.col("pitch_mean_x")))
    t = t.withColumn("pitch_gate_offpitch", F.when(bad & (k == 2), ~F.col("pitch_gate_offpitch")).otherwise(F.col("pitch_gate_offpitch")))
    t = t.withColumn("track_id", F.when(bad & (k == 3) & ~F.col("pitch_gate_offpitch") & (F.col("det_id") % 2 == 0), F.lit(None)).otherwise(F.col("track_id")))
    return audit.pitch_gate(t, 5.0).select("seq", *[F.col("observed")[c].cast("long").alias(c) for c in ("means", "flags", "ids")], "verdict")


@register("q14_column_population", f"SELECT seq, 'number' AS col, CASE WHEN count(number) = 0 THEN 'FAIL' WHEN count(number) < count(*) THEN 'WARN' ELSE 'PASS' END AS verdict FROM {D} d GROUP BY seq UNION ALL SELECT seq, 'conf', CASE WHEN count(conf) = 0 THEN 'FAIL' WHEN count(conf) < count(*) THEN 'WARN' ELSE 'PASS' END FROM {D} d GROUP BY seq")
def _(spark, d):
    return audit.population(fx.detections(spark, d), ["number", "conf"]).select("seq", F.col("component").alias("col"), "verdict")


@register("q17_run_gate", f"SELECT bool_or(share < 0.98) AS warned, FALSE AS failed FROM (SELECT f.seq, count(DISTINCT d.image_id) / CAST(count(DISTINCT f.image_id) AS DOUBLE) AS share FROM {FR} f LEFT JOIN {D} d ON f.image_id = d.image_id GROUP BY f.seq) q")
def _(spark, d):
    return audit.run_gate(audit.detector(fx.detections(spark, d), fx.frames(spark, d)))


# --- tracking --------------------------------------------------------------------------------------------------


@register("x15_tracker")
def _(spark, d):
    from touchline.operators import tracker

    cfg = tracker.Config(high=0.3, new=0.3, low=0.05)
    # boxes of one object move little from frame to frame
    det = fx.tracked(spark, d).withColumns({"l": F.col("track_id") * 60.0 + F.col("frame") % 40, "t": F.col("track_id") * 30.0 + F.col("frame") % 20, "w": F.lit(40.0), "h": F.lit(80.0)})
    return tracker.track(det, fx.frames(spark, d), cfg)


@register("a31_tracking_metrics")
def _(spark, d):
    from touchline.operators import tracking_metrics as tm

    gt = fx.tracked(spark, d)
    pred = gt.where("det_id % 10 > 0").withColumns({"l": F.col("l") + 1, "track_id": F.when(F.col("frame") % 50 > 40, F.col("track_id") + 100).otherwise(F.col("track_id"))})
    return tm.tracking_metrics(gt, pred).select("seq", *r6("hota", "deta", "assa", "mota", "idf1"), "idsw", "tp", "fp", "fn")


#: Boxes of a track keep to a strip of their own, so every frame has one possible assignment and SQL can give the figures.
STRIPS = f"(SELECT seq, image_id, frame, track_id AS g, CASE WHEN frame % 50 > 40 THEN track_id + 100 ELSE track_id END AS p, (w - det_id % 5) / (w + det_id % 5) AS s, det_id % 10 > 0 AS has FROM {TR} t)"


@register(
    "a31_separate_tracks",
    f"""WITH b AS {STRIPS}, ng AS (SELECT seq, g, count(*) AS n_g FROM b GROUP BY seq, g), np AS (SELECT seq, p, count(*) AS n_p FROM b WHERE has GROUP BY seq, p), t AS (SELECT seq, count(*) AS gts, count(*) FILTER (has) AS prs FROM b GROUP BY seq),
    m AS (SELECT seq, g, p, i, count(*) AS m FROM b, (SELECT unnest(range(1, 20)) AS i) k WHERE has AND s >= CAST(i AS DOUBLE) / 20 - 1e-9 GROUP BY seq, g, p, i), a AS (SELECT seq, i, sum(m) AS tp, sum(CAST(m AS DOUBLE) * m / greatest(1, n_g + n_p - m)) AS shared FROM m JOIN ng USING (seq, g) JOIN np USING (seq, p) GROUP BY seq, i),
    h AS (SELECT t.seq, coalesce(tp, 0) / CAST(greatest(1, gts + prs - coalesce(tp, 0)) AS DOUBLE) AS deta, coalesce(shared, 0) / greatest(1, coalesce(tp, 0)) AS assa FROM t CROSS JOIN (SELECT unnest(range(1, 20)) AS i) k LEFT JOIN a ON a.seq = t.seq AND a.i = k.i),
    x AS (SELECT seq, count(*) AS tp, count(*) FILTER (p <> q) AS idsw FROM (SELECT seq, p, lag(p) OVER (PARTITION BY seq, g ORDER BY image_id) AS q FROM b WHERE has AND s >= 0.5) z GROUP BY seq),
    y AS (SELECT seq, sum(n) AS idtp FROM (SELECT seq, g, max(n) AS n FROM (SELECT seq, g, p, count(*) AS n FROM b WHERE has AND s >= 0.5 GROUP BY seq, g, p) z GROUP BY seq, g) v GROUP BY seq)
    SELECT t.seq, hota, deta, assa, round((tp - (prs - tp) - idsw) / CAST(gts AS DOUBLE), 6) AS mota, round(2 * idtp / CAST(gts + prs AS DOUBLE), 6) AS idf1, idsw, tp, prs - tp AS fp, gts - tp AS fn
    FROM t JOIN (SELECT seq, round(avg(sqrt(deta * assa)), 6) AS hota, round(avg(deta), 6) AS deta, round(avg(assa), 6) AS assa FROM h GROUP BY seq) q USING (seq) JOIN x USING (seq) JOIN y USING (seq)""",
)
def _(spark, d):
    from touchline.operators import tracking_metrics as tm

    gt = fx.tracked(spark, d).withColumn("l", F.col("track_id") * 70.0)
    pred = gt.where("det_id % 10 > 0").withColumns({"l": F.col("l") + F.col("det_id") % 5, "track_id": F.when(F.col("frame") % 50 > 40, F.col("track_id") + 100).otherwise(F.col("track_id"))})
    return tm.tracking_metrics(gt, pred).select("seq", *r6("hota", "deta", "assa", "mota", "idf1"), "idsw", "tp", "fp", "fn")


@register("ext_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('hour', ts), event_type")
def _(spark, d):
    from touchline.streaming import windows

    fx.views(spark, d, "events")
    return windows.windowed_counts(spark.table("events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@register("x11_rule_chain")
def _(spark, d):
    from touchline.operators import rule_chain

    fx.views(spark, d, "embeddings")
    vec = spark.table("embeddings")
    t = trajectories(spark, d).withColumn("vec_id", F.col("track_id") + 25 * F.substring("seq", 2, 9).cast("long"))
    t = t.crossJoin(F.broadcast(vec.agg(F.count("*").alias("n_vec")))).withColumn("vec_id", F.col("vec_id") % F.col("n_vec"))  # one row
    return rule_chain.rule_chain(t.join(vec.select("vec_id", F.col("embedding").alias("unit")), "vec_id"))


@register("a28_calibration_metrics")
def _(spark, d):
    from touchline.operators import calibration

    f = cameras(fx.frames(spark, d))
    shift = F.col("image_id") % 7
    lines = F.create_map(F.lit("Middle line"), F.array(*[pt(960 + shift + k, F.lit(400.0 + 200 * k)) for k in range(3)]), F.lit("Side line top"), F.array(*[pt(F.lit(300.0 + 600 * k), 500.0 + shift) for k in range(3)]))
    rows = f.select("image_id", F.when(F.col("listed"), F.col("cam")).alias("cam"), lines.alias("lines"))
    return calibration.calibration_metrics(calibration.image_scores(rows)).select(*r6("jac5", "jac10", "cr", "final_score"), F.round("mre", 4).alias("mre"), F.round("medre", 4).alias("medre"), "n_frames", "n_points")


@register("c14_label_preparation", r"WITH w AS (SELECT doc_id, lower(regexp_replace(strip_accents(unnest(string_split_regex(text, '\s+'))), '[^\x00-\x7F]', '', 'g')) AS s FROM documents) SELECT doc_id, regexp_replace(s, '[^a-z0-9]', '', 'g') AS label FROM w WHERE length(s) <= 25 AND regexp_matches(s, '[a-z0-9]')")
def _(spark, d):
    from touchline.functions.labels import prepared

    fx.views(spark, d, "documents")
    words = spark.table("documents").select("doc_id", F.explode(F.split("text", r"\s+")).alias("w"))
    return words.select("doc_id", prepared("abcdefghijklmnopqrstuvwxyz0123456789", 25)(F.col("w")).alias("label")).where("label IS NOT NULL")


# --- remaining predicates, sinks and checks -----------------------------------------------------------------------


@register("p15_radar_colour", f"SELECT seq, track_id, CASE WHEN role = 'referee' THEN 'yellow' WHEN team = 'left' THEN 'red' WHEN team = 'right' THEN 'blue' END AS colour FROM ({ROLE_SQL}) r")
def _(spark, d):
    colour = F.when(F.col("role") == "referee", "yellow").when(F.col("team") == "left", "red").when(F.col("team") == "right", "blue")
    return roles.role_team(trajectories(spark, d)).select("seq", "track_id", colour.alias("colour"))


@register("p18_finite_positions", f"SELECT det_id, px, py FROM {D} d WHERE px IS NOT NULL AND py IS NOT NULL")
def _(spark, d):
    return fx.detections(spark, d).where(tracks.located()).select("det_id", "px", "py")


@register("c5_label_normalised", f"SELECT det_id, coalesce(CAST(TRY_CAST(trim(v) AS INTEGER) AS STRING), '-1') AS label FROM (SELECT det_id, CASE det_id % 3 WHEN 0 THEN '0' || number WHEN 1 THEN ' ' || number ELSE 'n' || number END AS v FROM {D} d) q")
def _(spark, d):
    k, n = F.col("det_id") % 3, F.col("number")
    v = F.when(k == 0, F.concat(F.lit("0"), n)).when(k == 1, F.concat(F.lit(" "), n)).otherwise(F.concat(F.lit("n"), n))
    return fx.detections(spark, d).select("det_id", text.label(v).alias("label"))


@register("a13_pooled_stats", f"SELECT track, label, round(mx, 6) AS mx, round(conf_sum, 6) AS conf_sum, CAST(votes AS BIGINT) AS votes, round(strength, 6) AS strength FROM {POOL} p")
def _(spark, d):
    a, b = both_stats(spark, d)
    return votes.pooled(a.unionByName(b), "track").select("track", "label", *r6("mx", "conf_sum"), "votes", *r6("strength"))


@register("a20_smallest_mode", f"SELECT seq, v AS mode FROM (SELECT seq, v, row_number() OVER (PARTITION BY seq ORDER BY n DESC, v) AS r FROM (SELECT seq, CAST(l AS BIGINT) % 17 AS v, count(*) AS n FROM {D} d GROUP BY seq, v) q) z WHERE r = 1")
def _(spark, d):
    return fx.detections(spark, d).groupBy("seq").agg(F.mode(F.col("l").cast("long") % 17, True).alias("mode"))


@register("a11_knee", "WITH p AS (SELECT a.label, a.vec_id, b.vec_id AS o, greatest(0, least(2, 1 - list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i])))) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), k AS (SELECT label, d FROM (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY d, o) AS r FROM p) q WHERE r = 3), s AS (SELECT label, d, CAST(row_number() OVER (PARTITION BY label ORDER BY d) - 1 AS DOUBLE) / (count(*) OVER (PARTITION BY label) - 1) AS x, (d - min(d) OVER (PARTITION BY label)) / (max(d) OVER (PARTITION BY label) - min(d) OVER (PARTITION BY label) + 1e-9) AS y FROM k), c AS (SELECT *, abs(x * max(y) OVER (PARTITION BY label) - y) AS far FROM s) SELECT label, round(d, 5) AS eps FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(far, 9) DESC, x) AS r FROM c) q WHERE r = 1")
def _(spark, d):
    fx.views(spark, d, "embeddings")
    w = Window.partitionBy("label")
    k = metric_space.neighbour_distance(spark.table("embeddings"), "label")
    k = k.withColumn("x", (F.row_number().over(w.orderBy("d")) - 1) / (F.count("*").over(w) - 1)).withColumn("y", (F.col("d") - F.min("d").over(w)) / (F.max("d").over(w) - F.min("d").over(w) + 1e-9))
    far = F.abs(F.col("x") * F.max("y").over(w) - F.col("y"))
    return k.withColumn("far", far).groupBy("label").agg(F.round(F.max_by("d", F.struct(F.round("far", 9), -F.col("x"))), 5).alias("eps"))


def return_side(t):
    left = F.col("l") + F.col("w") / 2 < 150
    t = t.groupBy("seq", "track_id").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.min_by(left, F.struct("frame", "det_id")).alias("i"), F.max_by(left, F.struct("frame", -F.col("det_id"))).alias("o"))
    a, b = t.alias("a"), t.alias("b")
    ok = F.when(F.col("a.f1") < F.col("b.f0"), F.col("a.o") == F.col("b.i")).when(F.col("b.f1") < F.col("a.f0"), F.col("b.o") == F.col("a.i")).otherwise(True)
    return a.join(b, (F.col("a.seq") == F.col("b.seq")) & (F.col("a.track_id") < F.col("b.track_id"))).select("a.seq", F.col("a.track_id").alias("a"), F.col("b.track_id").alias("b"), ok.alias("ok"))


# every tracked box; a fixture column cuts each track into the quarters of its sequence, so that some end before others begin
FW = f"""(WITH q AS (SELECT seq, frame, det_id, l, w, track_id * 4 + 4 * frame // (max(frame) OVER (PARTITION BY seq) + 1) AS track_id FROM {TR} t),
r AS (SELECT *, row_number() OVER (PARTITION BY seq, track_id ORDER BY frame, det_id) AS a, row_number() OVER (PARTITION BY seq, track_id ORDER BY frame DESC, det_id) AS b FROM q)
SELECT seq, track_id, max(CASE WHEN a = 1 THEN frame END) AS f0, max(CASE WHEN b = 1 THEN frame END) AS f1, bool_or(a = 1 AND l + w / 2 < 150) AS in_left, bool_or(b = 1 AND l + w / 2 < 150) AS out_left FROM r GROUP BY seq, track_id)"""


@register("j11_return_side_whole", f"SELECT a.seq, a.track_id AS a, b.track_id AS b, CASE WHEN a.f1 < b.f0 THEN a.out_left = b.in_left WHEN b.f1 < a.f0 THEN b.out_left = a.in_left ELSE TRUE END AS ok FROM {FW} a JOIN {FW} b ON a.seq = b.seq AND a.track_id < b.track_id")
def _(spark, d):
    t = fx.tracked(spark, d)
    last = t.groupBy("seq").agg(F.max("frame").alias("last"))
    return return_side(t.join(last, "seq").withColumn("track_id", F.expr("track_id * 4 + 4 * frame DIV (last + 1)")))


@register("s14_submission", f"SELECT track, CASE WHEN v = 0 THEN -1 ELSE v END AS value FROM (SELECT CAST(det_id AS STRING) AS track, TRY_CAST(number AS INTEGER) % 7 AS v FROM {D} d) q")
def _(spark, d):
    a = fx.detections(spark, d).select(F.col("det_id").cast("string").alias("track"), (F.col("number").try_cast("int") % 7).cast("string").alias("label"))
    return state.submission(a)[0]


@register("s16_masks", f"SELECT seq, image_id, count(*) AS n, round(sum(l + t + l + w + t + h), 4) AS total FROM {D} d GROUP BY seq, image_id")
def _(spark, d):
    m = state.masks(fx.detections(spark, d))
    return m.select("seq", "image_id", F.size("boxes").cast("long").alias("n"), F.round(F.aggregate(F.flatten("boxes"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@register("s17_summary_table", f"SELECT 'conf' AS block, seq AS metric, printf('%.4f', avg(conf) FILTER (track_id % 2 = 0)) AS even, printf('%.4f', avg(conf) FILTER (track_id % 2 = 1)) AS odd FROM {D} d WHERE track_id IS NOT NULL GROUP BY seq")
def _(spark, d):
    m = fx.detections(spark, d).where("track_id IS NOT NULL").groupBy(F.lit("conf").alias("block"), F.col("seq").alias("metric"), F.when(F.col("track_id") % 2 == 0, "even").otherwise("odd").alias("label")).agg(F.avg("conf").alias("value"))
    return state.summary_table(m, ["even", "odd"])


@register("s19_log_patterns", "SELECT p AS pattern, count(*) AS n FROM conversations, (SELECT unnest(['the', 'and', 'thank']) AS p) x WHERE regexp_matches(text, p) GROUP BY p")
def _(spark, d):
    fx.views(spark, d, "conversations")
    return audit.log_failures(spark.table("conversations").select(F.col("text").alias("value")), ("the", "and", "thank"))


@register("q6_calibration_check", f"WITH r AS (SELECT *, listed AND score >= 0.5 AS ok FROM ({RANKED}) q), s AS (SELECT seq, last_value(CASE WHEN ok THEN rank END IGNORE NULLS) OVER (PARTITION BY seq ORDER BY rank ROWS UNBOUNDED PRECEDING) AS src FROM r) SELECT seq, round(count(src) / CAST(count(*) AS DOUBLE), 6) AS coverage, CASE WHEN count(src) = 0 THEN 'FAIL' WHEN count(src) / CAST(count(*) AS DOUBLE) < 0.9 THEN 'WARN' ELSE 'PASS' END AS verdict FROM s GROUP BY seq")
def _(spark, d):
    return audit.calibration(tracks.carry_forward(fx.frames(spark, d))).select("seq", F.round(F.col("observed")["coverage"], 6).alias("coverage"), "verdict")


@register("q9_role_check", f"SELECT seq, count(*) FILTER (role = 'referee') AS refs, count(*) FILTER (role = 'goalkeeper') AS keepers, CASE WHEN count(*) FILTER (role = 'referee') > 3 OR count(*) FILTER (role = 'goalkeeper') > 2 THEN 'WARN' ELSE 'PASS' END AS verdict FROM ({ROLE_SQL}) r GROUP BY seq")
def _(spark, d):
    q = audit.role_team(roles.role_team(trajectories(spark, d)))
    return q.select("seq", F.col("observed")["refs"].cast("long").alias("refs"), F.col("observed")["keepers"].cast("long").alias("keepers"), "verdict")


@register("q10_jersey_check", f"WITH e AS (SELECT DISTINCT seq, track_id FROM {D} d WHERE track_id IS NOT NULL AND conf > 0.3), a AS (SELECT DISTINCT seq, track_id FROM {D} d WHERE track_id IS NOT NULL AND number IS NOT NULL AND conf > 0.6) SELECT e.seq, count(*) AS n, count(*) FILTER (a.seq IS NULL) AS missing, CASE WHEN count(*) FILTER (a.seq IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM e LEFT JOIN a ON e.seq = a.seq AND e.track_id = a.track_id GROUP BY e.seq")
def _(spark, d):
    t = fx.detections(spark, d).where("track_id IS NOT NULL")
    e, a = (t.where(c).select("seq", "track_id").distinct() for c in ("conf > 0.3", "number IS NOT NULL AND conf > 0.6"))
    return audit.jersey(e, a).select("seq", F.col("observed")["n"].cast("long").alias("n"), F.col("observed")["missing"].cast("long").alias("missing"), "verdict")


@register("q12_voted_check", f"WITH v AS (SELECT seq, track_id, min(number) AS number FROM {D} d WHERE track_id IS NOT NULL GROUP BY seq, track_id), t AS (SELECT d.seq, d.track_id, count(DISTINCT CASE WHEN {SPOILT.replace('seq', 'd.seq')} AND det_id % 40 = 0 THEN 'odd' ELSE v.number END) AS k, count(*) FILTER (CASE WHEN {SPOILT.replace('seq', 'd.seq')} AND det_id % 40 = 0 THEN 'odd' ELSE v.number END IS DISTINCT FROM d.number) AS c FROM {D} d JOIN v ON d.seq = v.seq AND d.track_id = v.track_id GROUP BY d.seq, d.track_id) SELECT seq, count(*) FILTER (k > 1) AS mixed, count(*) FILTER (c > 0) AS changed, CASE WHEN count(*) FILTER (k > 1) > 0 THEN 'FAIL' WHEN count(*) FILTER (c > 0) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM t GROUP BY seq")
def _(spark, d):
    det = fx.detections(spark, d)
    one = F.min("number").over(Window.partitionBy("seq", "track_id"))
    det = det.withColumn("voted", F.when(F.expr(SPOILT) & (F.col("det_id") % 40 == 0), "odd").otherwise(one))
    return audit.voted(det, "number", "voted").select("seq", *[F.col("observed")[c].cast("long").alias(c) for c in ("mixed", "changed")], "verdict")


@register("q13_drawable_check", f"SELECT d.seq, count(*) FILTER (px IS NOT NULL AND coalesce(role, '') <> 'referee' AND team IS NULL) AS blank FROM {D} d LEFT JOIN ({ROLE_SQL}) r ON d.seq = r.seq AND d.track_id = r.track_id GROUP BY d.seq")
def _(spark, d):
    r = roles.role_team(trajectories(spark, d)).select(F.col("seq").alias("_s"), F.col("track_id").alias("_t"), "role", "team")
    det = fx.detections(spark, d).join(r, (F.col("seq") == F.col("_s")) & (F.col("track_id") == F.col("_t")), "left")
    return audit.drawable(det).select("seq", F.col("observed")["blank"].cast("long").alias("blank"))


@register("q15_lineage", f"WITH a AS (SELECT DISTINCT seq, track_id FROM {D} d WHERE track_id IS NOT NULL), b AS (SELECT * FROM a WHERE track_id % 5 > 0), c AS (SELECT * FROM b WHERE track_id % 3 > 0) SELECT seq, track_id, 'cache' AS lost_before FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x UNION ALL SELECT seq, track_id, 'detection' FROM (SELECT * FROM b EXCEPT SELECT * FROM c) y")
def _(spark, d):
    a = fx.detections(spark, d).where("track_id IS NOT NULL").select("seq", "track_id").distinct()
    b = a.where("track_id % 5 > 0")
    c = b.where("track_id % 3 > 0")
    return audit.lineage(a, b, c, c)


@register("q16_sidecar_agreement", f"SELECT seq, track_id FROM ({ROLE_SQL}) r WHERE track_id % 7 = 0 AND role <> 'referee'")
def _(spark, d):
    r = roles.role_team(trajectories(spark, d)).select("seq", "track_id", "role", "team")
    side = r.withColumn("team", F.when((F.col("track_id") % 7 == 0) & F.col("team").isNotNull(), "middle").otherwise(F.col("team")))
    return audit.agreement(side, r).select("seq", "track_id")


@register("q19_slot_collisions", f"SELECT seq, image_id, track_id, count(*) AS n FROM {D} d WHERE track_id IS NOT NULL GROUP BY seq, image_id, track_id HAVING count(*) > 1")
def _(spark, d):
    return audit.collisions(fx.detections(spark, d))
