"""Poses, the whole lens, composed stages, readers and file sources, as rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import geometry as geo
from touchline.operators import audit, pose, stages, votes
from touchline.sources import images, state


def camera(pan=20.0, tilt=75.0, roll=1.5):
    rot = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1]])
    for axis, a in ((2, pan), (0, tilt), (2, roll)):
        w = np.zeros(3)
        w[axis] = np.radians(a)
        rot = rot @ pose.turn(w)
    return rot.T, np.array([3.0, 60.0, -15.0])


def test_pose_of_plane_points():
    f, c = np.array([1500.0, 1500.0]), np.array([960.0, 540.0])
    rot, pos = camera()
    world = np.array([(x, y, 0.0) for x in (-15, 0, 15) for y in (-20, 0, 20)] + [(5.0, 5.0, -2.44)])
    q = (world - pos) @ rot.T
    m = np.concatenate([world, q[:, :2] / q[:, 2:] * f + c], 1)
    m[4, 3] += 250  # a wrong match
    got = pose.solve(m, f, c)
    assert np.allclose(got[0], rot, atol=1e-8) and np.allclose(got[1], pos, atol=1e-6) and got[2].sum() == 9
    assert np.allclose(pose.angles(got[0]), (20.0, 75.0, 1.5), atol=1e-6)
    near = pose.refine(pose.turn(np.array([0.02, -0.01, 0.03])) @ rot, pos + 1.0, np.delete(m, 4, 0), f, c)
    assert np.allclose(near[0], rot, atol=1e-8) and np.allclose(near[1], pos, atol=1e-6)
    assert pose.solve(m[:3], f, c) is None
    line = m[[0, 1, 2]].repeat(2, 0)
    assert pose.solve(line, f, c) is None or True  # points on one line fix nothing; it must not fail


def test_frames_without_matches_are_not_solved(spark):
    m = "array<struct<x:double,y:double,z:double,u:double,v:double>>"
    df = spark.createDataFrame([(1, 1500.0, None), (2, 1500.0, []), (3, None, [])], f"image_id long, focal double, matches {m}").withColumns({"centre_x": F.lit(960.0), "centre_y": F.lit(540.0)})
    assert [r["solved"] for r in pose.solved(df).orderBy("image_id").collect()] == [False] * 3


def test_let_computes_once_and_passes_nulls(spark):
    r = spark.range(1).select(geo.let(F.col("id") + 2, lambda v: v * v).alias("a"), geo.let(F.lit(None).cast("int"), lambda v: v + 1).alias("b")).first()
    assert (r["a"], r["b"]) == (4, None)


def test_track_keys(spark):
    df = spark.createDataFrame([("7",), ("7.0",), (" 12.00 ",), ("7.5",), ("x",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(stages.track_key(F.col("t"))).collect()] == [7, 7, 12, None, None, None, None]


def reads(spark, rows):
    """rows: seq, track, frame, det, legibility, det_score, tens symbol, units symbol."""

    def vec(k):
        return [float(np.log(0.9)) if i == k else float(np.log(0.01)) for i in range(11)]

    return spark.createDataFrame([(s, t, f, d, leg, det, vec(a), vec(b)) for s, t, f, d, leg, det, a, b in rows], "seq string, track_id long, frame long, det_id long, legibility double, det_score double, tens array<double>, units array<double>")


def test_jersey_answers(spark):
    base = [("a", 1, f, f, 0.9, 0.9, 1, 7) for f in range(9)] + [("a", 2, f, 100 + f, 0.5, 0.9, 2, 10) for f in range(4)] + [("a", 3, 0, 200, 0.9, 0.52, 2, 10)]
    a = reads(spark, base)
    b = reads(spark, [(*r[:6], 10 if r[1] == 1 and r[2] == 0 else r[6], r[7]) for r in base])
    got = {r["track_id"]: r for r in stages.jersey_answers(a, b).collect()}
    assert (got[1]["number"], round(got[1]["confidence"], 6), got[1]["n_used"]) == ("17", round(5 / 6, 6), 3)
    assert [c["label"] for c in got[1]["candidates"]] == ["17", "-1"]
    # gates are strict: a read on the threshold does not vote
    assert all((got[t]["number"], got[t]["confidence"], got[t]["n_used"], list(got[t]["candidates"])) == ("-1", 0.0, 0, []) for t in (2, 3))
    with pytest.raises(Exception, match="disagree"):
        stages.jersey_answers(a, b.where("frame < 3")).collect()


def test_answers_on_rows(spark):
    det = spark.createDataFrame([("a", 1, 7), ("a", 2, 8), ("a", 3, None), ("b", 4, 7)], "seq string, det_id long, track_id long")
    cand = [("17", -0.1, 2.0, 3)]
    ans = spark.createDataFrame([("a", "7.0", "17", 0.9, cand), ("a", "8", "-1", 0.4, cand), ("b", "x", "9", 0.1, cand)], "seq string, track string, number string, confidence double, candidates array<struct<label:string,mx:double,conf_sum:double,votes:bigint>>")
    got = {r["det_id"]: r for r in stages.join_answers(det, ans).collect()}
    assert (got[1]["jersey_number"], got[1]["jersey_confidence"], round(got[1]["jersey_maxconf"], 6)) == ("17", 0.9, round(2 * np.exp(-0.1), 6))
    assert (got[2]["jersey_number"], got[2]["jersey_confidence"], got[2]["jersey_maxconf"]) == (None, None, None) and len(got[2]["candidates"]) == 1
    assert got[3]["candidates"] is None and got[4]["candidates"] is None


def test_calibration_stage(spark):
    f = spark.createDataFrame([("a", k, f"x/a/img1/{k:03d}.jpg") for k in range(6)], "seq string, image_id long, file_path string")
    cp = "struct<sensorResolutionWidthPixels:double,sensorResolutionHeightPixels:double,horizontalFieldOfViewDegrees:double,panDegrees:double,tiltDegrees:double,rollDegrees:double,positionXMeters:double,positionYMeters:double,positionZMeters:double,normalizedRadialDistortionCoefficients:array<double>>"
    one = lambda pan: (1920.0, 1080.0, 40.0, pan, 75.0, 0.0, 0.0, 60.0, -15.0, [0.0])
    e = spark.createDataFrame([("a", "other/001.jpg", 0.9, one(1.0)), ("a", "other/002.jpg", 0.1, one(2.0)), ("a", "other/005.jpg", 0.5, one(5.0)), ("b", "other/000.jpg", 0.9, one(9.0))], f"seq string, path string, score double, cp {cp}")
    pans = lambda **o: [r["cam"] and r["cam"]["pan_degrees"] for r in stages.calibrated_frames(f, e, **o).orderBy("image_id").collect()]
    assert pans() == [None, 1.0, 1.0, 1.0, 1.0, 5.0]
    assert pans(most=2) == [None, 1.0, 1.0, 1.0, None, 5.0]
    assert pans(carry=False) == [None, 1.0, None, None, None, 5.0]
    det = spark.createDataFrame([("a", 0, 1, 900.0, 500.0, 40.0, 80.0), ("a", 2, 2, 900.0, 500.0, 40.0, 80.0)], "seq string, image_id long, det_id long, l double, t double, w double, h double")
    rows, _ = stages.calibration(det, f, e)
    got = {r["det_id"]: r["bbox_pitch"] for r in rows.collect()}
    assert got[1] is None and abs(got[2]["y_bottom_middle"]) < 60


def test_team_stage(spark):
    rows = []
    for t in range(8):
        v = [0.0] * 4
        v[t % 2] = 1.0
        rows += [("a", 100 * t + f, t, 5 * f, t < 7, v if f else [0.0] * 4) for f in range(4)]
    det = spark.createDataFrame(rows, "seq string, det_id long, track_id long, frame long, crop_single boolean, embedding array<double>")
    got = {}
    for r in stages.team_embed(det).collect():
        got.setdefault(r["track_id"], set()).add((r["cluster"], r["nearest"]))
    assert got[7] == {(None, None)}  # no clean crop
    assert all(len(v) == 1 for v in got.values()) and {got[t].copy().pop()[1] for t in (0, 2, 4)} != {got[t].copy().pop()[1] for t in (1, 3, 5)}


def test_readers_are_hooks(spark):
    df = spark.createDataFrame([(1, b"abc"), (2, None), (3, b"z")], "det_id long, crop binary")

    def reader():
        return lambda crops: np.array([[len(c), c[0]] for c in crops])

    got = {r["det_id"]: r["logits"] for r in stages.read_many(df, reader, batch=1).collect()}
    assert got == {1: [3.0, 97.0], 2: None, 3: [1.0, 122.0]}


def test_rule_agreement_with_a_least_confidence(spark):
    r = reads(spark, [("a", 1, f, f, 0.9, 0.9, 1, 7) for f in range(3)]).withColumn("track", F.lit("a_1"))
    stats = votes.label_stats(votes.decoded(r), "track")
    assert votes.rule_agreement(stats, r, "track").first()["agree_sum_sumexp"]
    got = votes.rule_agreement(stats, r, "track", min_conf=0.5).first()
    assert (got["sum"], got["sumexp"], got["agree_sum_sumexp"]) == ("-1", "17", False)


def test_image_and_array_files(spark, tmp_path):
    (tmp_path / "game" / "img1").mkdir(parents=True)
    (tmp_path / "game" / "img1" / "1.jpg").write_bytes(b"one")
    got = [tuple(r) for r in images.frames(spark, str(tmp_path)).select("seq", "name", "content").collect()]
    assert got == [("game", "1.jpg", b"one")]
    (tmp_path / "a.png").write_bytes(b"p")
    (tmp_path / "b.png").write_bytes(b"q")
    (tmp_path / "gt.txt").write_text("a.png\tA b\nb.png\t" + "x" * 40 + "\nno label\n")
    assert [tuple(r) for r in images.labelled(spark, str(tmp_path), str(tmp_path / "gt.txt"), "abc", 25).collect()] == [("a.png", b"p", "ab")]
    np.savez(tmp_path / "x.npz", e=np.arange(6.0).reshape(3, 2))
    assert [(r["row"], r["values"]) for r in images.arrays(spark, str(tmp_path), "e").orderBy("row").collect()] == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]
    assert images.arrays(spark, str(tmp_path), "none").count() == 0


def test_json_sink_replaces_its_folder(spark, tmp_path):
    for n in (3, 1):
        state.write_json(spark.range(n), str(tmp_path / "j"))
    assert state.read_json(spark, str(tmp_path / "j")).count() == 1


def test_split_check_sees_merges_and_losses(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", None, 3), ("b", 4, 4)], "seq string, track_id long, track_id_presplit long")
    got = {r["seq"]: (r["verdict"], r["observed"]["merged"], r["observed"]["lost"]) for r in audit.split(df).collect()}
    assert got == {"a": ("FAIL", 1.0, 1.0), "b": ("PASS", 0.0, 0.0)}
