"""Semantics of gates, votes, roles, carry-forward, audit checks and sources, as rows."""

import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators import audit, overlap, roles, tracks, votes
from touchline.plans.stage import ContractError, Stage, compose
from touchline.schemas import nan_to_null
from touchline.sources import camera_json, labels, state


def gate_rows(spark):
    spots = {0: (-30, 0), 1: (45, 0), 2: (0, 40), 3: (60, 5), 4: (0, 35), 5: (10, None), 6: (None, None), 7: (-58, 0)}
    rows = []
    for f in range(40):
        for t, (x, y) in spots.items():
            y = (30 if f % 2 else 36) if t == 5 else y
            rows.append(("a", f * 10 + t, f, t, None if x is None else float(x), None if y is None else float(y)))
        rows.append(("a", f * 10 + 9, f, None, 80.0, 80.0))
    return spark.createDataFrame(rows, "seq string, det_id long, image_id long, track_id long, px double, py double")


@pytest.mark.parametrize("margin, off", [(5.0, {2, 3, 7}), (0.0, {2, 3, 4, 7}), (30.0, set())])
def test_gate(spark, margin, off):
    out = tracks.pitch_gate(gate_rows(spark), margin)
    assert {r[0] for r in out.where("pitch_gate_offpitch").select("track_id_pregate").distinct().collect()} == off
    assert out.where("track_id IS NULL AND track_id_pregate IS NOT NULL").count() == 40 * len(off)
    kept = tracks.pitch_gate(gate_rows(spark), margin, enabled=False)
    assert kept.where("NOT track_id <=> track_id_pregate").count() == 0
    assert {r["verdict"] for r in audit.pitch_gate(out, margin).collect()} == {"PASS"}
    bad = out.withColumn("pitch_mean_x", F.col("pitch_mean_x") + 1)
    assert {r["verdict"] for r in audit.pitch_gate(bad, margin).collect()} == {"FAIL"}


def test_gate_line_is_inside(spark):
    df = spark.createDataFrame([("a", 1, 1, 1, 57.5, 0.0)], "seq string, det_id long, image_id long, track_id long, px double, py double")
    assert not tracks.pitch_gate(df, 5.0).first()["pitch_gate_offpitch"]


def boxes(spark, rows):
    return spark.createDataFrame(rows, "seq string, image_id long, det_id long, l double, t double, w double, h double, conf double, track_id long")


def test_overlap_rules(spark):
    det = boxes(spark, [("a", 1, 1, 0.0, 0.0, 10.0, 10.0, 0.9, 1), ("a", 1, 2, 6.0, 0.0, 10.0, 10.0, 0.2, None), ("a", 2, 3, 0.0, 0.0, 10.0, 10.0, 0.9, 1)])
    got = {r["det_id"]: r for r in overlap.crop_filter(det).collect()}
    assert got[1]["crop_single"] and got[1]["crop_rt"] == 0  # an untracked box does not count as contaminator
    assert not got[2]["crop_single"] and got[2]["crop_trigger"] == 1  # but is labelled itself
    assert got[3]["crop_single"] and got[3]["crop_trigger"] is None
    exact = boxes(spark, [("a", 1, 1, 0.0, 0.0, 10.0, 10.0, 0.9, 1), ("a", 1, 2, 7.5, 0.0, 10.0, 10.0, 0.9, 2), ("a", 2, 3, 0.0, 0.0, 100.0, 10.0, 0.9, 1), ("a", 2, 4, 94.0, 0.0, 15.0, 10.0, 0.9, 2)])
    got = {r["det_id"]: r for r in overlap.crop_filter(exact).collect()}
    assert got[1]["crop_single"]  # 0.25 of itself is still single
    assert not got[3]["crop_single"] and got[3]["crop_trigger"] == 4  # 0.40 of the other is not
    with pytest.raises(ValueError):
        overlap.crop_filter(det, "conf", 0.0)
    assert {r["verdict"] for r in audit.crop_labels(overlap.crop_filter(det)).collect()} == {"PASS"}
    assert {r["verdict"] for r in audit.crop_labels(overlap.crop_filter(det).withColumn("crop_single", ~F.col("crop_single"))).collect()} == {"FAIL"}


def read(label, p):
    """Two 11-vectors with mass p on the label's symbols."""
    out = []
    for k in (0, 1):
        hot = 10 if k >= len(label) or label == "-1" else int(label[k])
        out.append([math.log(p) if i == hot else math.log((1 - p) / 10) for i in range(11)])
    return out


def reader(spark, reads):
    return votes.label_stats(votes.decoded(spark.createDataFrame([("t", *read(lab, p)) for lab, p in reads], "track string, tens array<double>, units array<double>")), "track")


def test_votes(spark):
    a, b = reader(spark, [("7", 0.9), ("10", 0.6), ("10", 0.6)]), reader(spark, [("7", 0.5), ("10", 0.5), ("-1", 0.9)])
    assert votes.vote_pool(a, b, "track").first()["label"] == "10"
    one = reader(spark, [("9", 0.8)]), reader(spark, [("10", 0.8)])
    f = votes.fuse(*one, "track").first()
    assert f["vote_pool"] == "9"  # equal votes and strength: the larger text
    assert f["a_maxconf"] == "9" and f["b_maxconf"] == "10" and f["agree_first"] == f["joint_maxconf"]
    minus = votes.vote_pool(reader(spark, [("-1", 0.9), ("-1", 0.9)]), reader(spark, [("8", 0.9), ("-1", 0.9)]), "track").first()
    assert minus["label"] == "-1" and minus["share"] == 0.75
    first_end = spark.createDataFrame([("t", read("-1", 0.9)[0], read("5", 0.9)[0])], "track string, tens array<double>, units array<double>")
    assert votes.decoded(first_end).first()["label"] == "-1"


def test_carry_forward(spark):
    scores = [None, 0.2, 0.9, 0.1, None, 0.1, 0.8]
    rows = [("a", i, f"x/{i:06d}.jpg", s or 0.0, s is not None, float(i), 0.0, 0.0) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "seq string, image_id long, file_path string, score double, listed boolean, pan double, tilt double, hfov double")
    pans = lambda most: [r["pan"] for r in tracks.carry_forward(df, 0.5, most).orderBy("rank").collect()]
    assert pans(0) == [None, None, 2, 2, 2, 2, 6]
    assert pans(2) == [None, None, 2, 2, 2, None, 6]


def test_roles(spark):
    cols = "seq string, track_id long, n long, mx double, sx double, q75 double, my double, sy double, ymin double, ymax double, cluster int, nearest int"
    rows = [("a", 1, 20, 0.0, 5.0, 5.0, -33.0, 0.5, -34.0, -32.0, None, 0), ("a", 2, 20, 1.0, 5.0, 5.0, 33.0, 0.5, 32.0, 34.0, None, 0), ("a", 3, 20, 2.0, 5.0, 5.0, 32.0, 0.5, 31.0, 33.0, None, 0)]
    rows += [("a", 4, 20, -45.0, 2.0, 46.0, 0.0, 1.0, -2.0, 2.0, None, 1), ("a", 5, 20, -40.0, 2.0, 41.0, 0.0, 1.0, -2.0, 2.0, None, 1), ("a", 6, 20, 5.0, 5.0, 8.0, 1.0, 4.0, -9.0, 9.0, None, 1)]
    rows += [("a", 10 + i, 20, -20.0 - i, 4.0, 24.0, 3.0, 4.0, -5.0, 8.0, 1, 1) for i in range(3)] + [("a", 20 + i, 20, 20.0 + i, 4.0, 24.0, 3.0, 4.0, -5.0, 8.0, 0, 0) for i in range(3)]
    got = {r["track_id"]: (r["role"], r["team"]) for r in roles.role_team(spark.createDataFrame(rows, cols)).collect()}
    assert got[1] == got[2] == ("referee", None)
    assert got[3] != ("referee", None) or got[6] != ("referee", None)  # one assistant a side
    assert got[4] == ("goalkeeper", "left")
    assert got[5][0] == "player"  # the second keeper of a half is none
    assert got[6] == ("referee", None)
    assert got[10] == ("player", "left") and got[20] == ("player", "right")


def test_contract(spark):
    df = spark.createDataFrame([(1, "x")], "det_id long, seq string")
    ok = Stage("one", lambda d, f: d.withColumn("y", F.lit(1.0)), {"det_id": T.LongType()}, {"y": T.DoubleType()})
    assert compose([ok], df, df).columns == ["det_id", "seq", "y"]
    with pytest.raises(ContractError, match="track_id"):
        compose([Stage("two", lambda d, f: d, {"track_id": T.LongType()})], df, df)
    with pytest.raises(ContractError, match="bigint"):
        compose([Stage("three", lambda d, f: d, {"det_id": T.StringType()})], df, df)
    with pytest.raises(ContractError, match="missing"):
        compose([Stage("four", lambda d, f: d, {}, {"z": T.LongType()})], df, df)


def test_nan_is_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"), (float("nan"), 1.0)), (2.0, None)], "a double, b struct<x: double, y: double>"))
    assert [tuple(r) for r in df.collect()] == [(None, (None, 1.0)), (2.0, None)]


def test_sources(spark, tmp_path):
    seq = tmp_path / "valid" / "SEQ-1"
    seq.mkdir(parents=True)
    doc = {
        "info": {"num_tracklets": "12"}, "images": [{"image_id": 1, "file_name": "000001.jpg"}, {"id": "2", "file_name": "000002.jpg"}],
        "annotations": [
            {"image_id": 1, "track_id": 5, "bbox_image": {"x": 1, "y": 2, "w": 3, "h": 4}, "attributes": {"role": "player", "jersey": "07"}},
            {"image_id": 2, "track_id": "5", "bbox_image": {"x_topleft": 1, "y_topleft": 2, "w": 3, "h": 4}, "attributes": {"role": "player", "jersey": "7"}},
            {"image_id": 1, "track_id": 6, "bbox_image": {"x": 1}, "attributes": {"role": "goalkeeper", "jersey": None}}, {"image_id": 1, "track_id": 7, "attributes": {"role": "referee"}},
            {"image_id": 9, "track_id": 8, "bbox_image": {"x": 1, "y": 2, "w": 3, "h": 4}, "attributes": {"role": "player", "jersey": 3}},
        ],
    }
    (seq / labels.FILE).write_text(json.dumps(doc))
    docs = labels.read(spark, str(tmp_path), "valid")
    assert labels.tracklets(docs).first()[0] == 12
    pool = labels.pool(labels.boxes(docs)).collect()
    assert [(r["track"], r["number"], len(r["frames"])) for r in pool] == [("SEQ-1_5", "7", 2)]
    cams = tmp_path / "cams"
    cams.mkdir()
    (cams / "SEQ-1.json").write_text(json.dumps({"/x/000001.jpg": {"cp": {"panDegrees": 1.5}, "score": 0.5, "reinit": True}, "/x/000002.jpg": {"cp": {}}}))
    got = camera_json.read(spark, str(cams)).orderBy("name").collect()
    assert [(r["seq"], r["name"], r["cp"]["panDegrees"], r["score"], r["reinit"]) for r in got] == [("SEQ-1", "000001.jpg", 1.5, 0.5, True), ("SEQ-1", "000002.jpg", None, 0.0, False)]


def test_state_cache_and_sinks(spark, tmp_path):
    det = spark.createDataFrame([("a", 1, float("nan")), ("b", 2, 1.0)], "seq string, det_id long, x double")
    state.write_state(det, det, str(tmp_path / "s"))
    back, _ = state.read_state(spark, str(tmp_path / "s"))
    assert {(r["seq"], r["det_id"], r["x"]) for r in back.collect()} == {("a", 1, None), ("b", 2, 1.0)}
    man = spark.createDataFrame([("t1", [1, 2]), ("t2", [3])], "track string, frames array<int>")
    k1, k2 = state.content_key(man, "track", "v1"), state.content_key(man, "track", "v2")
    assert state.to_do(k1, k1.where("track = 't1'")).select("track").collect()[0][0] == "t2"
    assert state.to_do(k2, k1).count() == 2
    assert state.assert_fingerprint(det, state.fingerprint(F.lit("x")), F.lit("x")).count() == 2
    with pytest.raises(Exception, match="stale cache"):
        state.assert_fingerprint(det, F.lit("no"), F.lit("x")).collect()
    vals, changed = state.submission(spark.createDataFrame([("a", "0"), ("b", "12"), ("c", "-1")], "track string, label string"))
    assert {tuple(r) for r in vals.collect()} == {("a", -1), ("b", 12), ("c", -1)} and [r[0] for r in changed.collect()] == ["a"]
    m = spark.createDataFrame([("j", "acc", "A", 0.5), ("j", "acc", "B", 2.0), ("j", "f1", "A", None)], "block string, metric string, label string, value double")
    assert [tuple(r) for r in state.summary_table(m, ["A", "B"]).orderBy("metric").collect()] == [("j", "acc", "0.5000", "2"), ("j", "f1", "-", "-")]
    log = spark.createDataFrame([("Traceback (most recent call last)",), ("fine",)], "value string")
    assert [tuple(r) for r in audit.log_failures(log).collect()] == [("Traceback", 1)]


def test_audit_negative_controls(spark):
    t = spark.createDataFrame([("a", 1, "referee", None), ("a", 2, "player", "left")], "seq string, track_id long, role string, team string")
    assert audit.role_team(t).first()["verdict"] == "PASS"
    assert audit.role_team(t.withColumn("team", F.lit("left"))).first()["verdict"] == "FAIL"
    assert audit.role_team(t.withColumn("role", F.lit("coach"))).first()["verdict"] == "FAIL"
    el, an = t.select("seq", "track_id"), t.where("track_id = 1").select("seq", "track_id")
    assert audit.jersey(el, el).first()["verdict"] == "PASS" and audit.jersey(el, an).first()["verdict"] == "FAIL"
    assert audit.lineage(el, el, an, an).select("track_id", "lost_before").collect() == [(2, "detection")]
    d = spark.createDataFrame([("a", 1, 1, 1, "7"), ("a", 2, 1, 1, "7")], "seq string, image_id long, track_id long, track_id_prerefine long, number string")
    assert audit.refine(d).first()["verdict"] == "PASS"
    assert audit.refine(d.withColumn("image_id", F.lit(1))).first()["verdict"] == "FAIL"
    s = d.withColumn("track_id_presplit", F.col("track_id"))
    assert audit.split(s).first()["verdict"] == "PASS"
    assert audit.split(s.withColumn("track_id_presplit", F.col("image_id"))).first()["verdict"] == "FAIL"
    p = audit.population(d.withColumn("z", F.lit(None).cast("int")), ["number", "z"])
    assert {r["component"]: r["verdict"] for r in p.collect()} == {"number": "PASS", "z": "FAIL"}
    assert audit.run_gate(p).first()["failed"]

