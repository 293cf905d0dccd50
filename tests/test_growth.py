"""Steps that must not grow faster than their input, or that must spread it."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from touchline.functions import geometry as geo
from touchline.operators import calibration, cluster, matching, pose, tracks, votes
from touchline.operators.tracker import Config, Tracker, track
from touchline.plans import more_queries, queries  # noqa: F401
from touchline.plans.more_queries import cameras
from touchline.streaming.ordered import CameraProcessor


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_frames_are_matched_before_all_batches_are_read():
    taken = []

    def batches():
        for k in range(10):
            taken.append(k)
            yield pa.RecordBatch.from_pydict({"seq": ["s"] * 10, "image_id": [k] * 10})

    frames = matching.in_frames(batches(), rows=20)
    next(frames)
    assert len(taken) < 5
    assert sum(t.num_rows for t, _ in frames) + 10 * 1 >= 80


def test_votes_are_decoded_without_interpreted_arrays(spark, sf):
    r = queries.reads(spark, sf, "a")
    assert "lambdafunction" not in plan(r)
    assert "Generate" not in plan(votes.position_sums(r, "track"))


def test_vectors_of_another_length_are_decoded_too(spark):
    df = spark.createDataFrame([([-1.0, -0.5, -3.0], [-0.1, -2.0, -3.0])], "tens array<double>, units array<double>")
    r = votes.decoded(df).first()
    a, b = np.exp([-1.0, -0.5, -3.0]), np.exp([-0.1, -2.0, -3.0])
    assert r["label"] == "10" and abs(r["conf"] - a[1] / a.sum() * b[0] / b.sum()) < 1e-12


def test_ground_points_of_boxes_are_computed_once(spark):
    f = spark.createDataFrame([(1, 20.0, 75.0, 40.0), (2, None, 70.0, 35.0)], "image_id long, pan double, tilt double, hfov double")
    box = [F.lit(v) for v in (700.0, 500.0, 60.0, 120.0)]
    bent = F.array(*[F.lit(v) for v in (-0.05, 0.01, -0.002, 0.003, -0.001, 0.0005)])
    for cam in (F.col("cam"), F.col("cam").withField("radial_distortion", bent)):
        df = cameras(f).select("image_id", geo.bbox_pitch(cam, *box).alias("p"), geo.to_ground(cam, F.lit(760.0), F.lit(620.0)).alias("q"))
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") >= 1
        rows = {r["image_id"]: r for r in df.collect()}
        assert rows[2]["p"] is None
        assert abs(rows[1]["p"]["x_bottom_right"] - rows[1]["q"]["x"]) < 1e-6 and abs(rows[1]["p"]["y_bottom_right"] - rows[1]["q"]["y"]) < 1e-6
    only = cameras(f).select("image_id", geo.bbox_pitch(F.col("cam"), *box).alias("p")).where("p IS NOT NULL").select("image_id", "p.*")
    assert only._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r["image_id"] for r in only.collect()] == [1]


def test_sequences_are_tracked_in_several_tasks(spark):
    det = spark.createDataFrame([("s", 1, 1, 0.0, 0.0, 9.0, 9.0, 0.9)], "seq string, frame long, det_id long, l double, t double, w double, h double, conf double")
    got = track(det, det.select("seq", "frame"))
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("s", 1, 1, 1)]


def test_tracks_move_together_as_each_alone():
    boxes = np.array([[0.0, 0, 40, 80], [300, 0, 40, 80], [600, 50, 30, 60]])
    both, alone = Tracker(Config()), [Tracker(Config()) for _ in boxes]
    for k in range(6):
        at = boxes + [3 * k, k, 0, 0]
        both.update(k, at, np.full(3, 0.9), [None] * 3)
        for t, b in zip(alone, at, strict=True):
            t.update(k, b[None], np.array([0.9]), [None])
    for t, own in zip(both.tracks, alone, strict=True):
        assert np.allclose(t.mean, own.tracks[0].mean) and np.allclose(t.cov, own.tracks[0].cov) and t.mean[4] > 1


def test_images_are_scored_in_several_tasks(spark):
    f = cameras(spark.createDataFrame([(1, 20.0, 75.0, 40.0)], "image_id long, pan double, tilt double, hfov double"))
    point = F.struct(F.lit(960.0).alias("x"), F.lit(400.0).alias("y"))
    got = calibration.image_scores(f.withColumn("lines", F.create_map(F.lit("Middle line"), F.array(point, point))))
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    r = got.first()
    assert r["calibrated"] and len(r["errors"]) == 2


def test_clipping_keeps_runs_and_crossings():
    p = np.array([[-10.0, 5], [10, 5], [20, 5], [np.nan, np.nan], [2000, 5], [30, 5]])
    assert calibration.clipped(p).tolist() == [[0, 5], [10, 5], [20, 5], [959, 5], [959, 5], [30, 5]]
    assert calibration.clipped(p[:1]).shape == calibration.clipped(p[:0]).shape == (0, 2)


def test_frames_are_solved_together_as_each_alone():
    f, c = np.array([1500.0, 1500.0]), np.array([960.0, 540.0])
    world = np.array([(x, y, 0.0) for x in (-15.0, 0, 15) for y in (-20.0, 0, 20)])
    frames = []
    for k in range(5):
        rot, pos = pose.turn(np.array([np.radians(100 + k), 0, 0.0])), np.array([k, 60.0, -15.0])
        q = (world - pos) @ rot.T
        m = np.concatenate([world, q[:, :2] / q[:, 2:] * f + c], 1)
        m[k, 3] += 200 * (k % 2)
        frames.append(m)
    rot, pos, near, good = pose.solve_all(np.array(frames), np.tile(f, (5, 1)), np.tile(c, (5, 1)))
    for k, m in enumerate(frames):
        one = pose.solve(m, f, c)
        assert good[k] == (one is not None)
        if one is not None:
            assert np.allclose(rot[k], one[0], atol=1e-8) and np.allclose(pos[k], one[1], atol=1e-6) and (near[k] == one[2]).all()
    assert good.any()


def test_a_sequence_costs_few_state_calls():
    calls = []

    class State:
        value: list = []

        def __getattr__(self, name):
            def f(*a):
                calls.append(name)
                if name == "appendValue":
                    self.value = [*self.value, a[0]]
                return {"exists": bool(self.value), "get": iter(self.value)}.get(name)

            return f

    own = State()
    own.value = []

    class Handle:
        def getListState(self, *a):
            return State()

        def getMapState(self, *a):
            return State()

        def getValueState(self, *a):
            return own

        def registerTimer(self, at):
            calls.append("registerTimer")

    class Time:
        def getCurrentWatermarkInMs(self):
            return 10**15

    p = CameraProcessor(0.5, 0)
    p.init(Handle())
    n = 200
    ts = pd.to_datetime(np.arange(n) * 40, unit="ms")
    rows = pd.DataFrame({"ts": ts, "image_id": np.arange(n), "file_path": "x", "score": 0.9, "pan": 1.0, "tilt": 2.0, "hfov": 3.0})
    list(p.handleInputRows(("s",), iter([rows]), Time()))
    out = pd.concat(p.handleExpiredTimer(("s",), Time(), None))
    assert len(out) == n and out["rank"].tolist() == list(range(n)) and len(calls) < 15


def test_labels_are_prepared_once(spark):
    from touchline.functions.labels import prepared

    df = spark.createDataFrame([("Été",), ("a1",), ("a1",), ("!!",), (None,)], "w string")
    got = df.select(prepared("abcdefghijklmnopqrstuvwxyz0123456789", 25)("w").alias("label")).where("label IS NOT NULL")
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r["label"] for r in got.collect()) == ["a1", "a1", "ete"]


def test_quantiles_end_in_the_digits_of_the_sql(spark):
    import duckdb

    rng = np.random.default_rng(5)
    rows = [(k, (rng.integers(0, 1300, n) / 10.0 - 65.0).tolist()) for k, n in enumerate(rng.integers(1, 120, 300))]
    long = pd.DataFrame([(k, x) for k, xs in rows for x in xs], columns=["track_id", "px"])
    duck = duckdb.connect()
    duck.register("long", long)
    want = dict(duck.execute("SELECT track_id, quantile_cont(abs(px), 0.75) FROM long GROUP BY track_id").fetchall())
    det = spark.createDataFrame([("s", k, x, None) for k, xs in rows for x in xs] + [("s", 1000, None, None)], "seq string, track_id long, px double, py double")
    got = {r["track_id"]: r["q75"] for r in tracks.position_stats(det).collect()}
    assert got.pop(1000) is None and got == want


def test_interpolated_rows_are_not_shuffled(spark):
    frames = spark.createDataFrame([("s", k, f"{k:03d}.jpg") for k in range(12)], "seq string, image_id long, file_path string")
    boxes = [(0, 1), (1, 1), (5, 1), (6, 1), (9, 1), (2, 2), (9, 2), (3, None), (99, 1)]
    det = spark.createDataFrame([(k, "s", i, t, float(i), 0.0, 4.0, 8.0, 0.5) for k, (i, t) in enumerate(boxes)], "det_id long, seq string, image_id long, track_id long, l double, t double, w double, h double, conf double")
    got = tracks.interpolate(det, frames)
    p = got._jdf.queryExecution().optimizedPlan().toString()
    above = p[: p.index("Generate")]
    assert "Join" not in above and "Repartition" not in above
    rows = sorted((r["image_id"], r["track_id"] or 0, r["l"], r["interpolated"]) for r in got.collect())
    assert [r[:3] for r in rows if not r[3]] == sorted((i, t or 0, float(i)) for i, t in boxes)
    assert [r[:3] for r in rows if r[3]] == [(k, 1, float(k)) for k in (2, 3, 4, 7, 8)]


def test_many_tracks_are_split_in_a_task(spark):
    rng = np.random.default_rng(2)
    rows = []
    for t in range(12):
        for f in range(14):
            x = np.eye(4)[t % 3 if f < 7 else 3] + 0.01 * rng.normal(size=4)
            rows.append((f"s{t % 2}", t * 100 + f, t, f, None if f == 3 else [float(v) for v in x], None if f == 13 else f % 3 > 0))
    det = spark.createDataFrame(rows, "seq string, det_id long, track_id long, frame long, embedding array<double>, clean boolean")
    got = cluster.split_tracks(det)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    found = {r["det_id"]: r["fragment"] for r in got.collect()}
    for t in range(12):
        own = [r for r in rows if r[2] == t]
        want = cluster.split_track(cluster.unit(cluster.vectors(pd.Series([r[4] for r in own]))), np.array([bool(r[5]) for r in own]), 0.2, 5)
        assert [found[r[1]] for r in own] == want.tolist() and len(set(want)) == 2
