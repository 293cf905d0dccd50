"""Registered queries of whole stages, of the lens and pose operators, and of checks with spoilt fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import geometry as geo
from touchline.operators import audit, pose, stages, votes
from touchline.operators.groups import spread
from touchline.plans import fixtures as fx
from touchline.plans.more_queries import CAM_SQL, SPOILT, cameras, embedded, ground_sql
from touchline.plans.queries import FR, RANKED, D, r6, reads, reads_sql, register, single_sql, stats_sql, sum_sql
from touchline.sources import labels, state

SPOILT_D, SPOILT_N = SPOILT.replace("seq", "d.seq"), SPOILT.replace("seq", "n.seq")

# --- lens and pose -----------------------------------------------------------------------------

K = (-0.05, 0.01, -0.002, 0.003, -0.001, 0.0005)
P = (0.001, -0.0005)
S = (0.0005, 0.0002, -0.0003, 0.0001)


def doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def with_lens(frames: DataFrame) -> DataFrame:
    c = cameras(frames)
    return c.withColumn("cam", F.col("cam").withField("radial_distortion", doubles(K)).withField("tangential_distortion", doubles(P)).withField("thin_prism_distortion", doubles(S)))


PLANE = "(image_id % 41 - 20) / 40.0E0 AS x, (image_id % 29 - 14) / 40.0E0 AS y"


@register("p21_undistort_round_trip", f"SELECT image_id, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT image_id, {PLANE} FROM {FR} f) q")
def _(spark, d):
    f = with_lens(fx.frames(spark, d)).selectExpr("image_id", "cam", *PLANE.split(", "))
    there = f.select("image_id", "cam", geo.distort(F.col("x"), F.col("y"), *geo.lens(F.col("cam"), True)).alias("p"))
    back = there.select("image_id", geo.undistort(F.col("p.x"), F.col("p.y"), *geo.lens(F.col("cam"), True), rounds=30).alias("q"))
    return back.select("image_id", (F.round("q.x", 6) + 0.0).alias("x"), (F.round("q.y", 6) + 0.0).alias("y"))


def bent_sql(u: str, v: str) -> tuple[str, str]:
    r2 = f"({u} * {u} + {v} * {v})"
    factor = f"((1 + {K[0]} * {r2} + {K[1]} * {r2} * {r2} + {K[2]} * {r2} * {r2} * {r2}) / (1 + {K[3]} * {r2} + {K[4]} * {r2} * {r2} + {K[5]} * {r2} * {r2} * {r2}))"
    x = f"({u} * {factor} + 2 * {P[0]} * {u} * {v} + {P[1]} * ({r2} + 2 * {u} * {u}) + {S[0]} * {r2} + {S[1]} * {r2} * {r2})"
    y = f"({v} * {factor} + 2 * {P[1]} * {u} * {v} + {P[0]} * ({r2} + 2 * {v} * {v}) + {S[2]} * {r2} + {S[3]} * {r2} * {r2})"
    return x, y


@register("p21_distort", f"SELECT image_id, round({bent_sql('x', 'y')[0]}, 6) AS u, round({bent_sql('x', 'y')[1]}, 6) AS v FROM (SELECT image_id, {PLANE} FROM {FR} f) q")
def _(spark, d):
    f = with_lens(fx.frames(spark, d)).selectExpr("image_id", "cam", *PLANE.split(", "))
    there = f.select("image_id", geo.distort(F.col("x"), F.col("y"), *geo.lens(F.col("cam"), True)).alias("p"))
    return there.select("image_id", (F.round("p.x", 6) + 0.0).alias("u"), (F.round("p.y", 6) + 0.0).alias("v"))


#: A ground point of each frame in its camera's frame, as a point of the normalised plane where z is positive.
SEEN = f"(SELECT image_id, f, z, qx / z AS a, qy / z AS b FROM (SELECT image_id, f, cp * x + sp * y AS qx, -sp * ct * x + cp * ct * y + st * 15 AS qy, sp * st * x - cp * st * y + ct * 15 AS z FROM (SELECT *, image_id % 30 - 15.0E0 AS x, image_id % 60 - 30.0E0 - 60 AS y FROM {CAM_SQL} c) q) w)"
BENT = bent_sql("a", "b")


@register("p22_project_whole_lens", f"SELECT image_id, CASE WHEN z > 1e-3 THEN round(f * {BENT[0]} + 960, 4) ELSE 0 END AS u, CASE WHEN z > 1e-3 THEN round(f * {BENT[1]} + 540, 4) ELSE 0 END AS v, CASE WHEN z > 1e-3 THEN 1.0E0 ELSE 0.0E0 END AS w FROM {SEEN} s")
def _(spark, d):
    p = geo.project_homogeneous(F.col("cam"), (F.col("image_id") % 30 - 15).cast("double"), (F.col("image_id") % 60 - 30).cast("double"), F.lit(0.0))
    return with_lens(fx.frames(spark, d)).select("image_id", p.alias("p")).select("image_id", *[F.round(F.get("p", F.lit(i)), 4).alias(n) for i, n in enumerate("uvw")])


def calibrator(k: tuple = ()) -> Column:
    fixed = {"sensorResolutionWidthPixels": 1920.0, "sensorResolutionHeightPixels": 1080.0, "rollDegrees": 0.0, "positionXMeters": 0.0, "positionYMeters": 60.0, "positionZMeters": -15.0}
    series = doubles(k) if k else F.array().cast("array<double>")
    return F.struct(*[F.lit(v).alias(n) for n, v in fixed.items()], F.col("hfov").alias("horizontalFieldOfViewDegrees"), F.col("pan").alias("panDegrees"), F.col("tilt").alias("tiltDegrees"), series.alias("normalizedRadialDistortionCoefficients"))


@register("p26_camera_json", f"SELECT image_id, pan, tilt, round(960 / tan(radians(hfov) / 2), 6) AS focal, 60.0 AS y, 6 AS n_radial FROM {FR} f")
def _(spark, d):
    text = geo.camera_to_json(geo.camera_from_calibrator(calibrator((0.01, 0.002))))
    f = fx.frames(spark, d).select("image_id", geo.camera_from_json(text).alias("c"))
    return f.select("image_id", F.col("c.pan_degrees").alias("pan"), F.col("c.tilt_degrees").alias("tilt"), F.round("c.x_focal_length", 6).alias("focal"), F.get("c.position_meters", F.lit(1)).alias("y"), F.size("c.radial_distortion").alias("n_radial"))


#: The calibrator's own model: the offset from the centre times 1 + 0.01 r2 + 0.002 r2 r2, with r over the image height.
SERIES = "(1 + 0.01 * (a * a + b * b) * f * f / 1166400 + 0.002 * power((a * a + b * b) * f * f / 1166400, 2))"


@register("p29_independent_model", f"SELECT image_id, round(960 + f * a * {SERIES}, 4) AS u, round(540 + f * b * {SERIES}, 4) AS v, 0.0E0 AS apart FROM {SEEN} s WHERE z > 1e-3")
def _(spark, d):
    cp = calibrator((0.01, 0.002))
    at = [(F.col("image_id") % 30 - 15).cast("double"), (F.col("image_id") % 60 - 30).cast("double"), F.lit(0.0)]
    f = fx.frames(spark, d).select("image_id", geo.project_from_calibrator(cp, *at).alias("a"), geo.project(geo.camera_from_calibrator(cp), *at).alias("b")).where("a IS NOT NULL")
    return f.select("image_id", F.round("a.x", 4).alias("u"), F.round("a.y", 4).alias("v"), F.round(F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")), 4).alias("apart"))


@register("p25_solved_pose", f"SELECT image_id, TRUE AS solved, pan, tilt, 0.0E0 AS roll, 0.0E0 AS x, 60.0E0 AS y, -15.0E0 AS z, CASE WHEN image_id % 5 = 0 THEN 19 ELSE 20 END AS inliers FROM {FR} f")
def _(spark, d):
    spots = [(float(x), float(y)) for x in (-16, -8, 0, 8, 16) for y in (-30, -10, 10, 30)]
    f = cameras(spread(fx.frames(spark, d), "image_id"))  # before the matches: they are the larger rows
    places = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.0).alias("z")) for x, y in spots])
    odd = F.when(F.col("image_id") % 5 == 0, 300.0).otherwise(0.0)  # one wrong match in some frames

    def seen(s, i, p):
        return F.struct(*[s[c].alias(c) for c in "xyz"], (p["x"] + F.when(i == 7, odd).otherwise(0.0)).alias("u"), p["y"].alias("v"))

    f = f.select("image_id", F.col("cam.x_focal_length").alias("focal"), F.lit(960.0).alias("centre_x"), F.lit(540.0).alias("centre_y"), geo.project_each(F.col("cam"), places, seen).alias("matches"))
    q = pose.solved(f)
    near = lambda c: F.round(c, 3) + 0.0
    return q.select("image_id", "solved", near(F.col("pan_degrees")).alias("pan"), near(F.col("tilt_degrees")).alias("tilt"), near(F.col("roll_degrees")).alias("roll"), *[near(F.get("position_meters", F.lit(i))).alias(n) for i, n in enumerate("xyz")], "inliers")


# --- stages ---------------------------------------------------------------------------------------


@register("j5_write_back", f"SELECT det_id, count(track_id) OVER (PARTITION BY seq, track_id) AS n FROM {D} d WHERE track_id IS NOT NULL UNION ALL SELECT det_id, NULL FROM {D} d WHERE track_id IS NULL")
def _(spark, d):
    det = fx.detections(spark, d)
    per = det.where("track_id IS NOT NULL").groupBy("seq", "track_id").agg(F.count("*").alias("n"))
    return stages.write_back(det, per, "n").select("det_id", "n")


@register("j6_join_answers", f"WITH a AS (SELECT DISTINCT seq, track_id, track_id * 5 % 111 AS n FROM {D} d WHERE track_id IS NOT NULL AND track_id % 6 > 0) SELECT det_id, CASE WHEN n BETWEEN 1 AND 99 THEN CAST(n AS STRING) END AS jersey_number, CASE WHEN n BETWEEN 1 AND 99 THEN 0.5E0 END AS jersey_confidence, CASE WHEN n BETWEEN 1 AND 99 THEN round(exp(-0.5) * n, 6) END AS jersey_maxconf FROM {D} d LEFT JOIN a ON d.seq = a.seq AND d.track_id = a.track_id")
def _(spark, d):
    det = fx.detections(spark, d)
    n = F.col("track_id") * 5 % 111
    cand = F.array(F.struct(n.cast("string").alias("label"), F.lit(-0.5).alias("mx"), n.cast("double").alias("conf_sum"), F.lit(1).cast("long").alias("votes")))
    key = F.concat(F.col("track_id").cast("string"), F.when(F.col("track_id") % 2 == 0, ".0").otherwise(""))
    a = det.where("track_id IS NOT NULL AND track_id % 6 > 0").select("seq", "track_id").distinct().select("seq", key.alias("track"), n.cast("string").alias("number"), F.lit(0.5).alias("confidence"), cand.alias("candidates"))
    return stages.join_answers(det, a).select("det_id", "jersey_number", "jersey_confidence", *r6("jersey_maxconf"))


@register("s10_calibration_key", f"SELECT seq, left(sha256(concat(seq, '|det-v', CASE WHEN {SPOILT} THEN '2' ELSE '1' END, '|0.5')), 16) AS key, {SPOILT} AS asked_anew FROM (SELECT DISTINCT seq FROM {FR} f) q")
def _(spark, d):
    seqs = fx.frames(spark, d).select("seq").distinct()
    now = state.calibration_key(seqs, F.concat(F.lit("det-v"), F.when(F.expr(SPOILT), "2").otherwise("1")), F.lit("0.5"))
    cached = state.calibration_key(seqs, F.lit("det-v1"), F.lit("0.5"))
    anew = state.to_do(now, cached).select("key").withColumn("asked_anew", F.lit(True))
    return now.join(anew, "key", "left").select("seq", "key", F.coalesce("asked_anew", F.lit(False)).alias("asked_anew"))


CARRIED = f"(SELECT seq, image_id, hfov, pan, tilt, ok FROM (SELECT seq, image_id, ok, last_value(CASE WHEN ok THEN hfov END IGNORE NULLS) OVER w AS hfov, last_value(CASE WHEN ok THEN pan END IGNORE NULLS) OVER w AS pan, last_value(CASE WHEN ok THEN tilt END IGNORE NULLS) OVER w AS tilt FROM (SELECT *, listed AND score >= 0.5 AS ok FROM ({RANKED}) q) r WINDOW w AS (PARTITION BY seq ORDER BY rank ROWS UNBOUNDED PRECEDING)) z WHERE pan IS NOT NULL)"


@register("x14_calibration_stage", f"WITH c AS (SELECT image_id, ok, 960 / tan(radians(hfov) / 2) AS f, cos(radians(pan)) AS cp, sin(radians(pan)) AS sp, cos(radians(tilt)) AS ct, sin(radians(tilt)) AS st FROM {CARRIED} k), g AS (SELECT det_id, ok, {ground_sql('(l + w / 2) * 6', '(t + h) * 3', 'm')} FROM {D} d JOIN c USING (image_id)) SELECT det_id, NOT ok AS carried, CASE WHEN abs(x_m) < 1000 AND abs(y_m) < 1000 THEN round(x_m, 4) END AS x, CASE WHEN abs(x_m) < 1000 AND abs(y_m) < 1000 THEN round(y_m, 4) END AS y, NOT (abs(x_m) < 1000 AND abs(y_m) < 1000) AS far FROM g")
def _(spark, d):
    f = fx.frames(spark, d)
    entries = f.where("listed").select("seq", F.concat(F.lit("/elsewhere/"), F.regexp_extract("file_path", "[^/]+$", 0)).alias("path"), "score", calibrator().alias("cp"))
    det = fx.detections(spark, d).withColumns({"l": F.col("l") * 6, "t": F.col("t") * 3, "w": F.col("w") * 6, "h": F.col("h") * 3})
    rows, cams = stages.calibration(det, f, entries)
    p = F.col("bbox_pitch")
    rows = rows.where(p.isNotNull()).join(cams.select("image_id", "carried"), "image_id")
    x, y = p["x_bottom_middle"], p["y_bottom_middle"]
    near = (F.abs(x) < 1000) & (F.abs(y) < 1000)  # places near the horizon are flagged: their last digits are noise
    return rows.select("det_id", "carried", F.when(near, F.round(x, 4)).alias("x"), F.when(near, F.round(y, 4)).alias("y"), (~near).alias("far"))


GATED = f"legibility > 0.5 AND det_score > 0.52 AND det_id IN (SELECT det_id FROM (SELECT det_id, row_number() OVER (PARTITION BY seq, track_id ORDER BY frame, det_id) AS i FROM {D} d WHERE track_id IS NOT NULL) s WHERE (i - 1) % 3 = 0)"


@register("x12_jersey_stage", f"""WITH p AS (SELECT track, label, max(mx) AS mx, sum(conf_sum) AS cs, sum(votes) AS votes, sum(strength) AS st FROM (SELECT * FROM {stats_sql('a', GATED)} x UNION ALL SELECT * FROM {stats_sql('b', GATED)} y) u GROUP BY track, label),
q AS (SELECT *, sum(votes) OVER (PARTITION BY track) AS total, count(*) OVER (PARTITION BY track) AS n_labels, row_number() OVER (PARTITION BY track ORDER BY votes DESC, round(st, 9) DESC, label DESC) AS r, first_value(label) OVER (PARTITION BY track ORDER BY round(exp(mx) * cs, 9) DESC, votes DESC, round(st, 9) DESC, label DESC) AS top FROM p),
t AS (SELECT DISTINCT concat(seq, '_', CAST(track_id AS STRING)) AS track FROM {D} d WHERE track_id IS NOT NULL)
SELECT t.track, coalesce(label, '-1') AS number, coalesce(round(votes / CAST(total AS DOUBLE), 6), 0) AS confidence, CAST(coalesce(total, 0) / 2 AS BIGINT) AS n_used, coalesce(n_labels, 0) AS n_labels, top FROM t LEFT JOIN q ON t.track = q.track AND r = 1""")
def _(spark, d):
    a, b = (reads(spark, d, x, "track_id", "frame").drop("track") for x in "ab")
    q = stages.jersey_answers(a, b)
    return q.select(F.concat_ws("_", "seq", F.col("track_id").cast("string")).alias("track"), "number", *r6("confidence"), "n_used", F.size("candidates").cast("long").alias("n_labels"), F.get("candidates", F.lit(0))["label"].alias("top"))


@register("x3_team_stage")
def _(spark, d):
    det = embedded(spark, d).withColumn("crop_single", F.col("conf") > 0.3)
    return stages.team_embed(det).select("det_id", "cluster", "nearest")


@register("a18_rule_agreement", f"WITH a AS ({single_sql()}), s AS ({sum_sql()}) SELECT track, vote, wvote, slogconf, maxconf, s.sum, s.sum AS sumexp, s.sum = vote AS agree, s.sum = vote AS agree_sum_vote, vote = wvote AS agree_vote_wvote, s.sum = wvote AS agree_sum_wvote, wvote = slogconf AS agree_wvote_slogconf, wvote = maxconf AS agree_wvote_maxconf, TRUE AS agree_sum_sumexp FROM a JOIN s USING (track)")
def _(spark, d):
    r = reads(spark, d, "a")
    names = ["vote", "wvote", "slogconf", "maxconf", "sum", "sumexp"]
    return votes.rule_agreement(votes.label_stats(votes.decoded(r), "track"), r, "track").select("track", *names, "agree", *[f"agree_{a}_{b}" for a, b in votes.AGREEMENTS])


def sweep_sql(t: float) -> str:
    g = f"legibility > {t} AND det_score > 0.52"
    return f"SELECT {t} AS threshold, track, label FROM (SELECT track, label, row_number() OVER (PARTITION BY track ORDER BY votes DESC, round(st, 9) DESC, label DESC) AS r FROM (SELECT track, label, sum(votes) AS votes, sum(strength) AS st FROM (SELECT * FROM {stats_sql('a', g)} x UNION ALL SELECT * FROM {stats_sql('b', g)} y) u GROUP BY track, label) p) q WHERE r = 1"


TRUTH = f"(SELECT DISTINCT track, CAST(substr(track, strpos(track, '_') + 1) AS BIGINT) AS k FROM {reads_sql('a')} r)"


@register("q18_gate_sweep", f"WITH w AS ({' UNION ALL '.join(sweep_sql(t) for t in (0.25, 0.5, 0.75))}) SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) AS answered, count(*) FILTER (label = concat(CAST(k * 3 % 11 AS STRING), CAST(k * 7 % 11 AS STRING))) AS correct, (SELECT count(*) FROM {TRUTH} n) AS n FROM w JOIN {TRUTH} t USING (track) GROUP BY threshold")
def _(spark, d):
    a, b = (reads(spark, d, x) for x in "ab")
    k = F.substring_index("track", "_", -1).cast("long")
    truth = a.select("track").distinct().withColumn("number", F.concat((k * 3 % 11).cast("string"), (k * 7 % 11).cast("string")))
    return votes.gate_sweep(a, b, truth, "track", [0.25, 0.5, 0.75])


@register("o7_distinct_indices", f"SELECT seq, track_id, array_to_string(list_sort(list_distinct(list(frame % 16))), ',') AS picks FROM {D} d WHERE track_id IS NOT NULL GROUP BY seq, track_id")
def _(spark, d):
    # sixteen values a track at most
    picks = F.array_sort(F.array_distinct(F.collect_set(F.col("frame") % 16)))
    return fx.detections(spark, d).where("track_id IS NOT NULL").groupBy("seq", "track_id").agg(F.concat_ws(",", picks.cast("array<string>")).alias("picks"))


# --- label files --------------------------------------------------------------------------------------


@register("s1_label_boxes", f"SELECT concat_ws('_', seq, CAST(track_id AS STRING)) AS track, coalesce(CAST(TRY_CAST(number AS INTEGER) AS STRING), '-1') AS number, l, t, w, h, concat('/data/game/valid/', seq, '/img1/', lpad(CAST(frame AS STRING), 6, '0'), '.jpg') AS frame_path FROM {D} d WHERE track_id IS NOT NULL AND track_id % 4 < 2")
def _(spark, d):
    det = fx.detections(spark, d).where("track_id IS NOT NULL")
    role = F.when(F.col("track_id") % 4 == 0, "goalkeeper").when(F.col("track_id") % 4 == 1, "player").otherwise("referee")
    odd = F.col("det_id") % 2 == 0  # the two ways in which files name a corner
    box = F.struct(F.when(odd, F.col("l")).alias("x"), F.when(odd, F.col("t")).alias("y"), F.when(~odd, F.col("l")).alias("x_topleft"), F.when(~odd, F.col("t")).alias("y_topleft"), "w", "h")
    note = F.struct(F.col("image_id").cast("string").alias("image_id"), F.col("track_id").cast("string").alias("track_id"), box.alias("bbox_image"), F.struct(role.alias("role"), F.col("number").alias("jersey")).alias("attributes"))
    image = F.struct(F.when(F.col("image_id") % 2 == 0, F.col("image_id").cast("string")).alias("image_id"), F.when(F.col("image_id") % 2 > 0, F.col("image_id").cast("string")).alias("id"), F.concat(F.lpad(F.col("frame").cast("string"), 6, "0"), F.lit(".jpg")).alias("file_name"))
    docs = det.groupBy("seq").agg(F.collect_list(note).alias("annotations"), F.collect_set(image).alias("images")).withColumn("path", F.concat(F.lit("/data/game/valid/"), "seq", F.lit("/Labels-GameState.json")))
    return labels.boxes(docs).select("track", "number", "l", "t", "w", "h", "frame_path")


# --- checks whose fixtures are spoilt in some sequences ---------------------------------------------------


@register("q3_tracker_check", f"WITH s AS (SELECT seq, image_id, NOT ({SPOILT} AND image_id % 101 = 0) AS ran, image_id % 3 > 0 AS ident, image_id % 20 = 0 AS clip, image_id = min(image_id) OVER (PARTITION BY seq) AS first FROM {FR} f WHERE NOT ({SPOILT} AND image_id % 11 = 0)), g AS (SELECT seq, count(*) AS k, count(*) FILTER (NOT ran) AS idle, count(*) FILTER (ident AND NOT first) AS i, count(*) FILTER (clip) AS c FROM s GROUP BY seq), n AS (SELECT seq, count(*) AS n FROM {FR} f GROUP BY seq) SELECT seq, round(k / CAST(n AS DOUBLE), 6) AS coverage, round(i / CAST(greatest(k - 1, 1) AS DOUBLE), 6) AS identity, round(c / CAST(k AS DOUBLE), 6) AS clipped, CASE WHEN k < n OR idle > 0 THEN 'FAIL' WHEN i / CAST(greatest(k - 1, 1) AS DOUBLE) > 0.5 THEN 'WARN' ELSE 'PASS' END AS verdict FROM g JOIN n USING (seq)")
def _(spark, d):
    f = fx.frames(spark, d)
    bad = F.expr(SPOILT)
    side = f.where(~(bad & (F.col("image_id") % 11 == 0))).select("seq", "image_id", (~(bad & (F.col("image_id") % 101 == 0))).alias("ran"), (F.col("image_id") % 3 > 0).alias("identity"), (F.col("image_id") % 20 == 0).alias("clipped"))
    q = audit.tracker_internals(side, f)
    return q.select("seq", *[F.round(F.col("observed")[c], 6).alias(c) for c in ("coverage", "identity", "clipped")], "verdict")


SPLIT = f"(SELECT seq, track_id AS origin, CASE WHEN {SPOILT} AND det_id % 90 = 0 THEN NULL WHEN {SPOILT} AND frame % 97 = 0 THEN track_id % 2 * 2 ELSE track_id * 2 + frame % 2 END AS track_id FROM {D} d)"


@register("q4_split_check", f"WITH s AS {SPLIT}, g AS (SELECT seq, track_id, count(DISTINCT origin) AS o FROM s WHERE track_id IS NOT NULL GROUP BY seq, track_id), a AS (SELECT seq, count(*) FILTER (o > 1) AS merged, count(*) AS fragments FROM g GROUP BY seq), b AS (SELECT seq, count(*) FILTER ((track_id IS NULL) <> (origin IS NULL)) AS lost FROM s GROUP BY seq) SELECT seq, merged, fragments, lost, CASE WHEN merged + lost > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM a JOIN b USING (seq)")
def _(spark, d):
    bad, t = F.expr(SPOILT), F.col("track_id")
    new = F.when(bad & (F.col("det_id") % 90 == 0), None).when(bad & (F.col("frame") % 97 == 0), t % 2 * 2).otherwise(t * 2 + F.col("frame") % 2)
    det = fx.detections(spark, d).withColumn("track_id_presplit", t).withColumn("track_id", new)
    return audit.split(det).select("seq", *[F.col("observed")[c].cast("long").alias(c) for c in ("merged", "fragments", "lost")], "verdict")


TEAMS = f"(SELECT seq, track_id, count(*) FILTER (conf > 0.5) AS n_single, CASE WHEN {SPOILT_D} AND track_id % 7 = 3 THEN 2 WHEN track_id % 5 > 0 THEN CAST(track_id % 2 AS INTEGER) END AS cluster, CASE WHEN track_id % 9 > 0 THEN CAST(track_id % 2 AS INTEGER) WHEN track_id % 5 > 0 AND NOT {SPOILT_D} THEN 0 END AS nearest FROM {D} d WHERE track_id IS NOT NULL GROUP BY seq, track_id)"


@register("q8_team_check", f"SELECT seq, count(*) AS n, count(nearest) AS k, count(*) FILTER (n_single > 0 AND nearest IS NULL) AS gone, count(*) FILTER (coalesce(cluster, 0) NOT IN (0, 1)) AS odd, count(*) FILTER (cluster IS NOT NULL AND nearest IS NULL) AS half, CASE WHEN count(*) FILTER (coalesce(cluster, 0) NOT IN (0, 1) OR (cluster IS NOT NULL AND nearest IS NULL)) > 0 THEN 'FAIL' WHEN count(*) FILTER (n_single > 0 AND nearest IS NULL) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM {TEAMS} t GROUP BY seq")
def _(spark, d):
    bad, t = F.expr(SPOILT), F.col("track_id")
    side = (t % 2).cast("int")
    per = fx.detections(spark, d).where("track_id IS NOT NULL").groupBy("seq", "track_id").agg(F.count_if(F.col("conf") > 0.5).alias("n_single"))
    per = per.withColumn("cluster", F.when(bad & (t % 7 == 3), 2).when(t % 5 > 0, side)).withColumn("nearest", F.when(t % 9 > 0, side).when((t % 5 > 0) & ~bad, 0))
    return audit.team_embed(per).select("seq", *[F.col("observed")[c].cast("long").alias(c) for c in ("n", "k", "gone", "odd", "half")], "verdict")


@register("q11_refine_check", f"WITH r AS (SELECT seq, image_id, CASE WHEN NOT ({SPOILT} AND det_id % 60 = 0) THEN track_id END AS before, track_id, CASE WHEN {SPOILT} AND det_id % 80 = 0 THEN 'x' ELSE CAST(track_id AS STRING) END AS number FROM ({fx.TRACKED}) d), s AS (SELECT seq, count(before) AS before, count(track_id) AS after FROM r GROUP BY seq), m AS (SELECT seq, count(*) FILTER (k > 1) AS mixed FROM (SELECT seq, track_id, count(DISTINCT number) AS k FROM r GROUP BY seq, track_id) q GROUP BY seq) SELECT seq, before, after, 0 AS collisions, mixed, CASE WHEN after > before OR mixed > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM s JOIN m USING (seq)")
def _(spark, d):
    bad = F.expr(SPOILT)
    det = fx.tracked(spark, d)
    det = det.withColumn("track_id_prerefine", F.when(~(bad & (F.col("det_id") % 60 == 0)), F.col("track_id"))).withColumn("number", F.when(bad & (F.col("det_id") % 80 == 0), "x").otherwise(F.col("track_id").cast("string")))
    return audit.refine(det).select("seq", *[F.col("observed")[c].cast("long").alias(c) for c in ("before", "after", "collisions", "mixed")], "verdict")


MERGED = f"""(WITH t AS (SELECT seq, image_id, det_id, track_id AS pre, CASE WHEN track_id % 5 = 4 AND NOT ({SPOILT} AND det_id % 100 = 0) THEN track_id - 1 ELSE track_id END AS f FROM ({fx.TRACKED}) d)
SELECT *, CASE WHEN row_number() OVER (PARTITION BY image_id, f ORDER BY pre) = 1 THEN f END AS final FROM t)"""


@register("q3_tracker_shares", f"WITH s AS (SELECT seq, image_id % 5 AS h, CASE WHEN {SPOILT} THEN image_id % 5 WHEN image_id % 200 = 1 THEN 1 ELSE 0 END AS z, CASE WHEN image_id % 50 = 2 THEN 1 ELSE 0 END AS c FROM {FR} f), g AS (SELECT seq, sum(h) AS h, sum(z) AS z, sum(c) AS c FROM s GROUP BY seq) SELECT seq, round(coalesce(z / CAST(nullif(h, 0) AS DOUBLE), 0), 6) AS zero, round(coalesce(c / CAST(nullif(h, 0) AS DOUBLE), 0), 6) AS clipped_crops, CASE WHEN h > 0 AND z = h THEN 'FAIL' WHEN z > 0.01 * h OR c > 0.001 * h THEN 'WARN' ELSE 'PASS' END AS verdict FROM g")
def _(spark, d):
    i = F.col("image_id")
    f = fx.frames(spark, d)
    side = f.select("seq", "image_id", F.lit(True).alias("ran"), F.lit(False).alias("identity"), F.lit(False).alias("clipped"), (i % 5).alias("n_high"), F.when(F.expr(SPOILT), i % 5).when(i % 200 == 1, 1).otherwise(0).alias("zero_emb"), F.when(i % 50 == 2, 1).otherwise(0).alias("n_clipped"))
    return audit.tracker_internals(side, f).select("seq", *[F.round(F.col("observed")[c], 6).alias(c) for c in ("zero", "clipped_crops")], "verdict")


WHY = f"(SELECT seq, track_id, CASE track_id % 9 WHEN 0 THEN 'player_nearest_centroid' WHEN 1 THEN 'assistant' WHEN 2 THEN 'player_half_fallback' ELSE 'player' END AS why FROM (SELECT DISTINCT seq, track_id FROM {D} d WHERE track_id IS NOT NULL AND NOT ({SPOILT} AND track_id = 11)) q)"


@register("q9_role_reasons", f"WITH w AS (SELECT seq, count(*) AS told, count(*) FILTER (why = 'player_nearest_centroid') AS near, count(*) FILTER (why = 'player_half_fallback') AS half, count(*) FILTER (why = 'assistant') AS assistants FROM {WHY} y GROUP BY seq), n AS (SELECT seq, count(DISTINCT track_id) AS n FROM {D} d GROUP BY seq) SELECT n.seq, told, n, near, half, CASE WHEN {SPOILT_N} AND near > 0 THEN 1 ELSE 0 END AS off, CASE WHEN ({SPOILT_N} AND near > 0) OR told <> n OR assistants > 2 THEN 'FAIL' WHEN half > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM n JOIN w ON w.seq = n.seq")
def _(spark, d):
    det, bad = fx.detections(spark, d).where("track_id IS NOT NULL"), F.expr(SPOILT)
    why = F.when(F.col("track_id") % 9 == 0, "player_nearest_centroid").when(F.col("track_id") % 9 == 1, "assistant").when(F.col("track_id") % 9 == 2, "player_half_fallback").otherwise("player")
    per = det.where(~(bad & (F.col("track_id") == 11))).select("seq", "track_id").distinct().withColumn("why", why)
    level = per.groupBy("seq").agg(F.when(bad, 0).otherwise(F.count_if(F.col("why") == "player_nearest_centroid")).alias("n_fallback_nearest"), F.count_if(F.col("why") == "player_half_fallback").alias("n_fallback_half"))
    return audit.role_reasons(per, level, det).select("seq", *[F.col("observed")[c].cast("long").alias(c) for c in ("told", "n", "near", "half", "off")], "verdict")


CACHED = f"(SELECT seq, track_id, count(*) FILTER (conf > 0.9 AND track_id % 4 > 0) AS crops, bool_or({SPOILT} AND det_id % 900 = 0) AND (bool_or(conf > 0.9 AND track_id % 4 > 0) OR (track_id % 5 = 0 AND bool_or({SPOILT}))) AND count(*) > count(*) FILTER (det_id % 900 = 0) AS mixed FROM {D} d WHERE track_id IS NOT NULL GROUP BY seq, track_id)"


@register(
    "q10_cache_check",
    f"""WITH t AS (SELECT *, crops > 0 AS asked, {SPOILT} AND track_id % 7 = 0 AS gone, {SPOILT} AND track_id % 7 = 1 AS moved FROM {CACHED} c),
    g AS (SELECT seq, count(*) FILTER (asked) AS eligible, count(*) FILTER (asked AND gone) AS missing, count(*) FILTER (mixed) AS mixed, count(*) FILTER (asked AND NOT gone AND moved) AS disagree, count(*) FILTER (NOT asked AND track_id % 5 = 0 AND {SPOILT}) AS unasked FROM t GROUP BY seq)
    SELECT seq, eligible, missing, mixed, disagree, unasked, CASE WHEN {SPOILT} THEN 1 ELSE 0 END AS other_digest, CASE WHEN {SPOILT} OR missing + mixed + disagree + unasked > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM g""",
)
def _(spark, d):
    bad, t = F.expr(SPOILT), F.col("track_id")
    det = fx.detections(spark, d).where("track_id IS NOT NULL").withColumn("crop_single", (F.col("conf") > 0.9) & (t % 4 > 0))
    asked = F.bool_or("crop_single").over(Window.partitionBy("seq", "track_id"))
    number = F.when(asked | ((t % 5 == 0) & bad), F.when(bad & (F.col("det_id") % 900 == 0), F.concat(F.lit("0"), (t + 1).cast("string"))).otherwise((t + 1).cast("string")))
    rows = det.withColumn("number", number)
    per = rows.groupBy("seq", "track_id").agg(F.count_if("crop_single").alias("crops")).where("crops > 0")
    results = per.where(~(bad & (t % 7 == 0))).select("seq", "track_id", F.when(bad & (t % 7 == 1), "-1").otherwise((t + 1).cast("string")).alias("number"), F.col("crops").alias("n_used"))
    digest = F.when(bad, F.repeat(F.lit("b"), F.lit(64))).otherwise(F.repeat(F.lit("a"), F.lit(64)))
    blobs = per.groupBy("seq").agg(F.lit("vote_pool").alias("rule"), F.lit(True).alias("single_crops_only"), F.count("*").alias("manifest_tracklets"), F.sum("crops").alias("manifest_frames"))
    q = audit.jersey_cache(rows, blobs.withColumn("first_sha", digest), results, {"first_sha": "a" * 64}, "vote_pool")
    return q.select("seq", *[F.col("observed")[c].cast("long").alias(c) for c in ("eligible", "missing", "mixed", "disagree", "unasked", "other_digest")], "verdict")


@register(
    "q17_run_integrity",
    f"""WITH f AS (SELECT 'check ' || seq || ': track' AS t FROM {D} d GROUP BY seq HAVING count(track_id) = 0), l AS (SELECT 'log: ' || p || ' (' || count(*) || ')' AS t FROM conversations, (SELECT unnest(['Killed', 'the']) AS p) x WHERE regexp_matches(text, p) GROUP BY p),
    e AS (SELECT 'calibration ' || seq || ': empty' AS t FROM {FR} f GROUP BY seq HAVING count(*) FILTER (listed AND NOT ({SPOILT})) = 0), s AS (SELECT 'jersey covers ' || n || ' of ' || (n + 1) || ' sequences' AS t FROM (SELECT count(DISTINCT seq) AS n FROM {D} d) q)
    SELECT TRUE AS failed, array_to_string(list_sort(list(t)), '|') AS problems FROM (SELECT t FROM f UNION ALL SELECT t FROM l UNION ALL SELECT t FROM e UNION ALL SELECT t FROM s) q""",
)
def _(spark, d):
    fx.views(spark, d, "conversations")
    det, f = fx.detections(spark, d), fx.frames(spark, d)
    cams = f.groupBy("seq").agg(F.count_if(F.col("listed") & ~F.expr(SPOILT)).alias("entries")).select(F.lit("calibration").alias("kind"), "seq", "entries")
    numbers = det.groupBy("seq").agg(F.count("*").alias("entries")).select(F.lit("jersey").alias("kind"), "seq", "entries")
    n = det.select("seq").distinct().count()
    log = spark.table("conversations").select(F.col("text").alias("value"))
    q = audit.run_integrity(audit.tracked_share(det), log, cams.unionByName(numbers), {"calibration": 1, "jersey": n + 1}, ("Killed", "the"))
    return q.select("failed", F.array_join("problems", "|").alias("problems"))


@register(
    "q11_merge_check",
    f"""WITH r AS {MERGED}, m AS (SELECT DISTINCT seq, pre AS absorbed, CASE WHEN {SPOILT} AND pre = 9 THEN 0.9 ELSE 0.1 END AS distance FROM r WHERE pre % 5 = 4 AND NOT ({SPOILT} AND pre = 14)),
    s AS (SELECT seq, count(pre) AS before, count(final) AS after, count(DISTINCT pre) AS parts, count(DISTINCT final) AS whole FROM r GROUP BY seq),
    l AS (SELECT m.seq, count(*) AS merges, count(*) FILTER (distance > 0.25) AS far, count(x.final) AS undead FROM m LEFT JOIN (SELECT DISTINCT seq, final FROM r) x ON x.seq = m.seq AND x.final = m.absorbed GROUP BY m.seq),
    q AS (SELECT s.*, coalesce(merges, 0) AS merges, coalesce(far, 0) AS far, coalesce(undead, 0) AS undead FROM s LEFT JOIN l ON l.seq = s.seq)
    SELECT seq, before, after, merges, far, undead, parts - merges - whole AS unexplained, CASE WHEN far + undead > 0 OR parts - merges <> whole THEN 'FAIL' ELSE 'PASS' END AS verdict FROM q""",
)
def _(spark, d):
    bad, t = F.expr(SPOILT), F.col("track_id")
    det = fx.tracked(spark, d).withColumn("track_id_prerefine", t)
    det = det.withColumn("track_id", F.when((t % 5 == 4) & ~(bad & (F.col("det_id") % 100 == 0)), t - 1).otherwise(t))
    slot = Window.partitionBy("image_id", "track_id").orderBy("track_id_prerefine")
    det = det.withColumn("first", F.row_number().over(slot) == 1).withColumn("track_id", F.when(F.col("first"), F.col("track_id"))).withColumn("number", F.col("track_id").cast("string"))
    merges = det.where("track_id_prerefine % 5 = 4").where(~(bad & (F.col("track_id_prerefine") == 14))).select("seq", F.col("track_id_prerefine").alias("absorbed")).distinct()
    merges = merges.withColumn("distance", F.when(bad & (F.col("absorbed") == 9), 0.9).otherwise(0.1))
    return audit.refine(det, merges).select("seq", *[F.col("observed")[c].cast("long").alias(c) for c in ("before", "after", "merges", "far", "undead", "unexplained")], "verdict")


@register("ext_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def _(spark, d):
    from touchline.streaming import windows

    fx.views(spark, d, "events")
    return windows.sessions(spark.table("events"))
