"""Images and poses are worked on many at a time, in many tasks, and once."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from touchline.functions import geometry as geo
from touchline.functions.geometry import mirrored
from touchline.operators import calibration, pose
from touchline.operators.groups import spread


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_spread_over_a_grouping_by_the_same_key(spark, sf):
    grouped = spark.range(40).groupBy("id").agg(F.count("*").alias("n"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    got = spread(grouped, "id")
    assert "REPARTITION_BY_NUM" in physical(got)
    assert got.select(F.spark_partition_id()).rdd.getNumPartitions() >= n
    for q in ("a28_calibration_metrics", "p25_solved_pose"):
        assert "REPARTITION_BY_NUM" in physical(entry.queries()[q](spark, sf))


def test_scores_are_worked_out_once(spark, sf):
    assert physical(entry.queries()["a28_calibration_metrics"](spark, sf)).count("MapInArrow") == 1


def one_by_one(rows):
    pitch, out = calibration.Pitch(), []
    for image, cam, lines in rows:
        gt = calibration.scaled(dict(lines or {}))
        if not gt:
            continue
        if cam is None:
            out.append((image, False, None, None, []))
            continue
        seen, p = pitch.seen(cam)
        turned = {m: v for k, v in gt.items() if (m := mirrored(k)) is not None}
        pixels = {k: calibration.clipped(p[pitch.at[k]]) for k in {*gt, *turned} & seen}
        plain, other = (calibration.compare(seen, pixels, g, (5.0, 10.0)) for g in (gt, turned))
        out.append((image, True, *(max(a, c) for a, c in zip(plain[0], other[0], strict=True)), (other if other[0][0] > plain[0][0] else plain)[1]))
    return out


def test_images_together_as_each_alone():
    rng = random.Random(1)
    names = [*calibration.Pitch().names, "Goal unknown", "Line unknown"]
    doubles = ("principal_point", "position_meters", "radial_distortion")
    numbers = ("x_focal_length", "y_focal_length", "pan_degrees", "tilt_degrees", "roll_degrees")
    rows = []
    for k in range(400):
        cam = {
            "principal_point": [960.0, 540.0], "position_meters": [rng.uniform(-5, 5), 60.0, -15.0], "radial_distortion": rng.choice([None, [0.0] * 6, [rng.uniform(-0.1, 0.1) for _ in range(3)]]),
            "x_focal_length": rng.uniform(800, 4000), "y_focal_length": rng.uniform(800, 4000), "pan_degrees": rng.uniform(-60, 60), "tilt_degrees": rng.uniform(50, 95), "roll_degrees": rng.uniform(-3, 3),
        }
        wide, high = rng.choice([(1.0, 1.0), (1920.0, 1080.0)])
        lines = [(n, [{"x": rng.uniform(0, wide), "y": rng.uniform(0, high)} for _ in range(rng.randrange(5))]) for n in rng.sample(names, rng.randrange(8))]
        if k % 3 == 0:  # what the camera sees of two lines, as itself and turned
            pitch = calibration.Pitch()
            seen, p = pitch.seen(cam)
            for n in sorted(seen)[:2]:
                inside = [q for q in p[pitch.at[n]] if 0 <= q[0] < calibration.WIDTH and 0 <= q[1] < calibration.HEIGHT]
                said = n if k % 2 else mirrored(n) or n
                lines = [(m, v) for m, v in lines if m != said] + [(said, [{"x": q[0] * 2 + 3, "y": q[1] * 2 + 2} for q in inside])]
        rows.append((k, None if k % 10 == 1 else cam, None if k % 20 == 2 else lines))
    cams = pa.struct([*((c, pa.list_(pa.float64())) for c in doubles), *((c, pa.float64()) for c in numbers)])
    kinds = (pa.int64(), cams, pa.map_(pa.string(), pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["image_id", "cam", "lines"])
    got, expected = calibration.Scorer().scores(batch).to_pylist(), one_by_one(rows)
    assert len(got) == len(expected) and any(r["jac10"] for r in got)
    for r, e in zip(got, expected, strict=True):
        assert (r["image_id"], r["calibrated"], r["jac5"], r["jac10"]) == e[:4]
        assert len(r["errors"]) == len(e[4]) and np.allclose(r["errors"], e[4], atol=1e-6)
    assert calibration.Scorer().scores(batch.slice(0, 0)).num_rows == 0


def test_fours_are_solved_in_closed_form_as_by_the_whole_matrix():
    rng = np.random.default_rng(4)
    f, c = np.tile([1500.0, 1500.0], (50, 1)), np.tile([960.0, 540.0], (50, 1))
    m = np.zeros((50, 4, 5))
    for k in range(50):
        m[k, :, :2] = rng.uniform(-30, 30, (4, 2))
        rot, pos = pose.turn(np.array([np.radians(100 + k % 20), 0, 0.0])) @ pose.turn(np.array([0, 0, k / 100])), np.array([k / 10, 60.0, -15.0])
        q = (m[k, :, :3] - pos) @ rot.T
        m[k, :, 3:] = q[:, :2] / q[:, 2:] * f[k] + c[k] + rng.normal(0, 1, (4, 2))
    m[7, 2] = (m[7, 0] + m[7, 1]) / 2  # three in one line
    m[7, 2, 3:] = (m[7, 0, 3:] + m[7, 1, 3:]) / 2
    a, b = pose.from_fours(m, f, c), pose.from_planes(m, f, c)
    assert (a[2] == b[2]).all() and not a[2][7] and a[2].sum() == 49
    assert np.allclose(a[0][a[2]], b[0][a[2]], atol=1e-6) and np.allclose(a[1][a[2]], b[1][a[2]], atol=1e-4)
    u, _, vt = np.linalg.svd(a[0][a[2]])
    assert np.allclose(u @ vt, a[0][a[2]]) and np.allclose(np.linalg.det(a[0][a[2]]), 1)


def test_a_frame_at_its_least_error_rests():
    f, c = np.array([[1500.0, 1500.0]]), np.array([[960.0, 540.0]])
    rot, pos = pose.turn(np.array([np.radians(100), 0, 0.0])), np.array([1.0, 60.0, -15.0])
    world = np.array([(x, y, 0.0) for x in (-15.0, 0, 15) for y in (-20.0, 0, 20)])
    q = (world - pos) @ rot.T
    m = np.concatenate([world, q[:, :2] / q[:, 2:] * f + c], 1)[None]
    m[0, :, 3:] += np.random.default_rng(0).normal(0, 1, (9, 2))
    steps, own = [], pose.turns
    pose.turns = lambda w: steps.append(len(w)) or own(w)
    try:
        r, p = pose.refine_all(rot[None], pos[None], m, f, c, np.ones((1, 9), bool))
    finally:
        pose.turns = own
    again = pose.refine_all(r, p, m, f, c, np.ones((1, 9), bool))
    assert len(steps) < 15 and np.allclose(again[1], p, atol=1e-7)


def test_poses_of_rows_without_enough_matches(spark):
    rows = [(1, None, None), (2, 1500.0, []), (3, 1500.0, [(0.0, 0.0, 0.0, 1.0, 1.0)] * 3), (4, None, [(0.0, 0.0, 0.0, 1.0, 1.0)] * 5)]
    df = spark.createDataFrame(rows, "image_id long, focal double, matches array<struct<x:double,y:double,z:double,u:double,v:double>>").withColumns({"centre_x": F.lit(960.0), "centre_y": F.lit(540.0)})
    got = pose.solved(df).orderBy("image_id").collect()
    assert [(r["image_id"], r["solved"], r["position_meters"], r["inliers"]) for r in got] == [(k, False, None, 0) for k in (1, 2, 3, 4)]


def test_points_of_a_camera_are_projected_as_each_alone(spark):
    cam = F.struct(F.array(F.lit(960.0), F.lit(540.0)).alias("principal_point"), F.lit(1500.0).alias("x_focal_length"), F.lit(1400.0).alias("y_focal_length"), (F.col("id") * 5.0 - 20).alias("pan_degrees"), F.lit(75.0).alias("tilt_degrees"), F.lit(1.0).alias("roll_degrees"),
                   F.array(F.lit(0.0), F.lit(60.0), F.lit(-15.0)).alias("position_meters"), F.when(F.col("id") < 4, F.array_repeat(F.lit(0.0), 6)).otherwise(F.array(*[F.lit(v) for v in (-0.05, 0.01, -0.002, 0.003, -0.001, 0.0005)])).alias("radial_distortion"))
    places = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.0).alias("z")) for x in (-20.0, 0.0, 20.0) for y in (-30.0, 30.0, 90.0)])
    df = spark.range(8).select(cam.alias("cam"))
    got = df.select(geo.project_each(F.col("cam"), places, lambda s, i, p: p).alias("a"), F.transform(places, lambda s: geo.project(F.col("cam"), s["x"], s["y"], s["z"])).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and any(p is None for r in got for p in r["a"]) and any(p is not None for r in got for p in r["a"])


def test_reads_move_once(spark, sf):
    from touchline.operators import stages
    from touchline.plans import queries

    a, b = (queries.reads(spark, sf, x, "track_id", "frame") for x in "ab")
    text = physical(stages.jersey_answers(a, b))
    assert "Join" not in text
    assert text.count("Exchange hashpartitioning(seq") == 1
