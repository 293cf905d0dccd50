"""Checks of the tracker's report, cached answers, role reasons and the run, on small spoilt tables; nearest centres."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import audit, metric_space

SHA = {"one": "a" * 64, "two": "b" * 64}


def cached(spark):
    rows = spark.createDataFrame([("s", 1, True, "7"), ("s", 1, False, "7"), ("s", 2, True, None), ("s", 3, False, None), ("s", None, True, "4")], "seq string, track_id long, crop_single boolean, number string")
    blobs = spark.createDataFrame([("s", "pool", True, 2, 2, *SHA.values())], "seq string, rule string, single_crops_only boolean, manifest_tracklets long, manifest_frames long, one string, two string")
    results = spark.createDataFrame([("s", 1, "07", 3), ("s", 2, "-1", 0)], "seq string, track_id long, number string, n_used long")
    return rows, blobs, results


def test_cache_check(spark):
    rows, blobs, results = cached(spark)

    def note(r=rows, b=blobs, a=results, **more):
        return audit.jersey_cache(r, b, a, SHA, "pool", **more).first()["note"]

    assert note() == ""
    assert note(b=blobs.where("false")) == "no cached answers"
    assert note(b=blobs.withColumn("rule", F.lit(None).cast("string"))) == "answered by another rule"
    assert note(b=blobs.withColumn("two", F.lit("stub"))) == "no real digest"
    assert note(b=blobs.withColumn("one", F.lit("c" * 64))) == "answered by other files"
    assert note(b=blobs.withColumn("manifest_frames", F.lit(9))) == "asked about another number of crops"
    assert note(a=results.where("track_id = 1")) == "eligible tracks without an answer"
    assert note(a=results.withColumn("number", F.lit("8"))) == "column differs from the answers"
    assert note(r=rows.withColumn("number", F.when(F.col("track_id") == 3, "5").otherwise(F.col("number")))) == "numbers on tracks that were not asked about"
    assert "numbers differ on a track" in note(r=rows.withColumn("number", F.when(F.col("crop_single"), F.col("number"))).unionByName(rows.where("track_id = 1").withColumn("number", F.lit("9"))))
    assert note(single_only=False, b=blobs.withColumn("single_crops_only", F.lit(False)).withColumn("manifest_tracklets", F.lit(3))) == "eligible tracks without an answer"


def test_role_reasons(spark):
    per = spark.createDataFrame([("s", 1, "player_nearest_centroid"), ("s", 2, "assistant"), ("s", 3, "player")], "seq string, track_id long, why string")
    level = spark.createDataFrame([("s", 1, 0)], "seq string, n_fallback_nearest long, n_fallback_half long")
    note = lambda p=per, n=level, t=per: audit.role_reasons(p, n, t).first()["note"]
    assert note() == ""
    assert note(n=level.withColumn("n_fallback_half", F.lit(2))) == "fallback counts disagree with the reasons"
    assert note(p=per.where("track_id < 3")) == "reasons do not cover the trajectories"
    assert note(p=per.withColumn("why", F.lit("assistant")), n=level.withColumn("n_fallback_nearest", F.lit(0))) == "more than two assistants"


def test_tracker_shares(spark):
    frames = spark.createDataFrame([("s", k) for k in range(4)], "seq string, image_id long")
    side = frames.select("seq", "image_id", F.lit(True).alias("ran"), F.lit(False).alias("identity"), F.lit(False).alias("clipped"), F.lit(3).alias("n_high"), F.lit(0).alias("zero_emb"), F.lit(0).alias("n_clipped"))
    note = lambda s: audit.tracker_internals(s, frames).first()["note"]
    assert note(side) == "" and note(side.drop("n_high")) == ""
    assert note(side.withColumn("zero_emb", F.lit(3))) == "no confident box has an embedding; many zero embeddings"
    assert note(side.withColumn("n_clipped", F.lit(1))) == "many clipped crops"
    assert note(side.withColumn("n_high", F.lit(0))) == ""


def test_run_integrity(spark):
    found = spark.createDataFrame([("s", "track", "PASS"), ("s", "gate", "WARN"), ("t", "gate", "FAIL")], "seq string, component string, verdict string")
    log = spark.createDataFrame([("fine",), ("Traceback (most recent call last)",)], "value string")
    art = spark.createDataFrame([("calibration", "s", 5), ("calibration", "t", 0), ("jersey", "s", None)], "kind string, seq string, entries long")
    r = audit.run_integrity(found, log, art, {"calibration": 2, "jersey": 2, "audit": 1}).first()
    assert r["failed"] and list(r["notes"]) == ["check s: gate"]
    assert list(r["problems"]) == ["audit covers 0 of 1 sequences", "calibration t: empty", "check t: gate", "jersey covers 1 of 2 sequences", "jersey s: unreadable", "log: Traceback (1)"]
    r = audit.run_integrity(found.where("verdict = 'PASS'"), log.where("value = 'fine'"), art.where("entries > 0"), {"calibration": 1}).first()
    assert (r["failed"], list(r["problems"]), list(r["notes"])) == (False, [], [])


@pytest.mark.parametrize("block", [3, 2000])
def test_nearest_centre(spark, monkeypatch, block):
    monkeypatch.setattr(metric_space, "BLOCK", block)
    monkeypatch.setattr(metric_space, "MEET", 10 * block)
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(80, 4)), rng.normal(size=(9, 4))
    c[5] = c[2]  # a tie goes to the lesser label
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    centres = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(c)], "label int, centroid array<double>")
    got = {r["vec_id"]: (r["nearest"], r["distance"]) for r in metric_space.nearest_centre(rows, centres).collect()}
    d = np.round(1 - x @ c.T, 9)
    assert got == {k: (int(d[k].argmin()), pytest.approx(d[k].min(), abs=1e-9)) for k in range(80)}
    assert metric_space.nearest_centre(rows, centres.where("false")).count() == 0
