"""Streams give the batch result whatever the order of their micro-batches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import tracker, tracks
from touchline.streaming import ordered

END = "2030-01-01 00:00:00"


def replay(spark, tmp_path, rows, schema, batches, build, name):
    """Runs build(stream) over rows cut into files by batches, then a row of another sequence far in the future, and collects the output."""
    folder = tmp_path / name
    parts = [[r for r, b in zip(rows, batches, strict=True) if b == k] for k in range(max(batches) + 1)]
    names = [c.split()[0] for c in schema.split(", ")]
    ends = [tuple({"seq": "~end", "ts": END}.get(c, 0 if c in ("frame", "image_id") else None) for c in names)]
    for part in [*parts, ends, ends]:
        df = spark.createDataFrame([tuple(r) for r in part], schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    with ordered.rocksdb(spark):
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-ck")).start()
        try:
            q.processAllAvailable()
            state = sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"])
        finally:
            q.stop()
    return spark.table(name).where("seq <> '~end'").collect(), state


def stamp(frame):
    return f"2024-01-01 00:{frame // 25 // 60:02d}:{frame // 25 % 60:02d}.{frame % 25 * 40:03d}"


BOX = "seq string, frame long, ts timestamp, det_id long, l double, t double, w double, h double, conf double"


def scene(seq, frames, seed):
    rnd = random.Random(seed)
    rows = []
    for f in frames:
        found = False
        for k in range(4):
            if rnd.random() < 0.2 or (k == 1 and 20 < f < 30) or f % 17 == 3:
                continue
            found = True
            rows.append((seq, f, stamp(f), f * 10 + k, 10.0 + 2 * f + 150 * k + rnd.random(), 10.0, 40.0, 80.0, rnd.choice([0.9, 0.8, 0.3])))
        if not found:
            rows.append((seq, f, stamp(f), None, None, None, None, None, None))
    return rows


def batch_ends(spark, rows, cfg):
    """Confirmed tracks and the frame each was last seen in."""
    out = set()
    for seq in {r[0] for r in rows}:
        t = tracker.Tracker(cfg)
        last = {}
        for f in sorted({r[1] for r in rows if r[0] == seq}):
            own = sorted((r[3], *r[4:9], None) for r in rows if r[0] == seq and r[1] == f and r[3] is not None)
            for _, i in tracker.step_frame(t, f, own):
                last[i] = f
        out |= {(seq, i, f) for i, f in last.items()}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_tracker_stream_with_disorder_and_silence(spark, tmp_path, seed):
    cfg = tracker.Config(keep=8)
    # b falls silent for longer than tracks live, then goes on
    rows = scene("a", range(60), seed) + scene("b", [*range(15), *range(40, 60)], seed + 9)
    rnd = random.Random(seed)
    batches = [min(5, max(0, r[1] // 10 + rnd.choice([0, 0, 0, 1, -1]))) for r in rows]  # up to two batches, 1.2 seconds, out of order
    got, state = replay(spark, tmp_path, rows, BOX, batches, lambda s: ordered.track_stream(s, cfg, 0.04, "2 seconds"), f"tracked{seed}")
    det = spark.createDataFrame([(r[0], r[1], *r[3:]) for r in rows if r[3] is not None], BOX.replace("ts timestamp, ", ""))
    frames = spark.createDataFrame(sorted({(r[0], r[1]) for r in rows}), "seq string, frame long")
    want = {tuple(r) for r in tracker.track(det, frames, cfg).collect()}
    assert {(r["seq"], r["frame"], r["det_id"], r["track_id"]) for r in got if not r["ended"]} == want and len(want) > 60
    assert {(r["seq"], r["track_id"], r["frame"]) for r in got if r["ended"]} == batch_ends(spark, rows, cfg)
    assert state <= 2 * 3 + 4  # counters of three sequences and the last batch's own frame, no buffered frames


def test_tracker_stream_drops_rows_behind_the_watermark_only(spark, tmp_path):
    rows = scene("a", range(50), 3)
    late = [r for r in rows if r[1] == 5]
    batches = [5 if r in late else r[1] // 10 for r in rows]
    got, _ = replay(spark, tmp_path, rows, BOX, batches, lambda s: ordered.track_stream(s, tracker.Config(), 0.04, "100 milliseconds"), "late")
    assert not {r["det_id"] for r in got} & {r[3] for r in late}
    kept = [r for r in rows if r not in late]
    det = spark.createDataFrame([(r[0], r[1], *r[3:]) for r in kept if r[3] is not None], BOX.replace("ts timestamp, ", ""))
    frames = spark.createDataFrame(sorted({(r[0], r[1]) for r in kept}), "seq string, frame long")
    assert {(r["seq"], r["frame"], r["det_id"], r["track_id"]) for r in got if not r["ended"]} == {tuple(r) for r in tracker.track(det, frames).collect()}


CAM = "seq string, image_id long, ts timestamp, file_path string, score double, pan double, tilt double, hfov double"


@pytest.mark.parametrize("most", [0, 2])
def test_camera_stream_equals_batch(spark, tmp_path, most):
    rng = np.random.default_rng(most)
    rows, frames = [], []
    for seq in "ab":
        for f in range(80):
            listed, score = rng.random() < 0.6, float(rng.random())
            path = f"x/{f:06d}.jpg"
            entry = (score, float(f), float(f) + 0.5, 60.0)
            frames.append((seq, f, path, score, listed, *entry[1:]))
            if listed and f % 3 == 0:
                rows.append((seq, f, stamp(f), path, *entry))
            else:
                rows.append((seq, f, stamp(f), path, None, None, None, None))
                if listed:  # the entry comes by itself
                    rows.append((seq, f, stamp(f), None, *entry))
    rows.append(("a", 999, stamp(40), None, 0.9, 1.0, 1.0, 1.0))  # no such frame
    batches = [min(7, max(0, r[1] // 10 + int(rng.integers(-1, 2)))) if r[1] < 900 else 4 for r in rows]
    got, state = replay(spark, tmp_path, rows, CAM, batches, lambda s: ordered.carry_forward_stream(s, 0.5, most, "2 seconds"), f"cams{most}")
    df = spark.createDataFrame(frames, "seq string, image_id long, file_path string, score double, listed boolean, pan double, tilt double, hfov double")
    cols = ["seq", "image_id", "rank", "source_rank", "pan", "tilt", "hfov", "carried"]
    assert sorted(map(tuple, got), key=str) == sorted((tuple(r) for r in tracks.carry_forward(df, 0.5, most).select(*cols).collect()), key=str)
    assert state <= 10
