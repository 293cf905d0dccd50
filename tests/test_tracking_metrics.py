"""The two-pass metrics over tables against the plain form over arrays of one sequence."""

import math

import numpy as np
import pyarrow as pa
import pytest

from touchline.operators import tracking_metrics as tm
from touchline.operators.matching import iou_matrix

COLS = ["hota", "deta", "assa", "mota", "idf1", "idsw", "tp", "fp", "fn"]


def scene(seed, frames=30, crowd=6, reach=60):
    """Crowded boxes whose predictions are shifted, lost, swapped and doubled."""
    rng = np.random.default_rng(seed)
    gt, pred = [], []
    place = rng.uniform(0, reach, (crowd, 2))
    for f in range(frames):
        if rng.random() < 0.15:
            continue
        place += rng.normal(0, 3, place.shape)
        swap = rng.permutation(crowd) if rng.random() < 0.2 else np.arange(crowd)
        for k in range(crowd):
            if rng.random() < 0.9:
                gt.append((f * 3, k, *place[k], 30.0, 40.0))
            if rng.random() < 0.85:
                pred.append((f * 3, int(swap[k]) + 50, *(place[k] + rng.normal(0, 4, 2)), 30.0, 40.0 + rng.normal()))
        if rng.random() < 0.3:
            pred.append((f * 3, 99, *rng.uniform(0, reach, 2), 30.0, 40.0))
    return gt, pred


def plain(gt, pred, similarity):
    ids = [{t: k for k, t in enumerate(sorted({r[1] for r in side}))} for side in (gt, pred)]
    frames = []
    for f in sorted({r[0] for r in gt} | {r[0] for r in pred}):
        g, p = ([r for r in side if r[0] == f] for side in (gt, pred))
        s = similarity(np.array([r[2:] for r in g], float).reshape(len(g), -1), np.array([r[2:] for r in p], float).reshape(len(p), -1)) if g and p else np.zeros((len(g), len(p)))
        frames.append((np.array([ids[0][r[1]] for r in g], int), np.array([ids[1][r[1]] for r in p], int), s))
    return tm.evaluate(frames)


def same(row, want):
    for c in COLS:
        assert row[c] == pytest.approx(want[c], abs=1e-9), c


def test_two_passes_equal_the_plain_form(spark):
    scenes = {f"s{k}": scene(k, crowd=c, reach=r) for k, (c, r) in enumerate([(6, 60), (3, 400), (8, 30), (5, 90), (4, 20)])}
    scenes["only truth"] = (scene(9)[0], [])
    scenes["only tracks"] = ([], scene(9)[1])
    cols = "seq string, image_id long, track_id long, l double, t double, w double, h double"
    gt, pred = (spark.createDataFrame([(s, *map(lambda v: v.item() if hasattr(v, "item") else v, r)) for s, both in scenes.items() for r in both[k]] + [("s0", 0, None, 1.0, 1.0, 1.0, 1.0)], cols) for k in (0, 1))
    got = {r["seq"]: r for r in tm.tracking_metrics(gt, pred).collect()}
    assert set(got) == set(scenes)
    for s, (g, p) in scenes.items():
        same(got[s], plain(g, p, iou_matrix))
    assert got["s0"]["idsw"] > 0 and 0 < got["s2"]["hota"] < 1


def test_pitch_positions_and_labels(spark):
    rng = np.random.default_rng(3)
    gt = [(f, k, float(x), float(y)) for f in range(20) for k, (x, y) in enumerate(rng.uniform(0, 12, (5, 2)))]
    pred = [(f, k + 9, x + float(rng.normal(0, 2)), y) for f, k, x, y in gt if rng.random() < 0.8]

    def near(a, b):
        return np.exp(((a[:, None] - b[None]) ** 2).sum(2) * math.log(0.05) / 25)

    cols = "seq string, image_id long, track_id long, px double, py double, label string"
    g, p = (spark.createDataFrame([("a", f, k, x, y, "ab"[k % 2]) for f, k, x, y in rows], cols) for rows in (gt, pred))
    same(tm.tracking_metrics(g, p, "pitch").first(), plain(gt, pred, near))
    mixed = plain([(*r, r[1] % 2) for r in gt], [(*r, r[1] % 2) for r in pred], lambda a, b: near(a[:, :2], b[:, :2]) * (a[:, 2][:, None] == b[:, 2][None]))
    same(tm.tracking_metrics(g, p, "pitch", attributes=True).first(), mixed)


def test_two_boxes_of_a_track_in_a_frame_are_refused(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.0, 0.0, 5.0, 5.0), ("a", 1, 1, 0.0, 0.0, 5.0, 5.0)], "seq string, image_id long, track_id long, l double, t double, w double, h double")
    with pytest.raises(Exception, match="two boxes in a frame"):
        tm.tracking_metrics(df, df).collect()


def test_no_rows(spark):
    df = spark.createDataFrame([], "seq string, image_id long, track_id long, l double, t double, w double, h double")
    assert tm.tracking_metrics(df, df).count() == 0


def test_identities_are_spread_over_tasks(spark):
    pairs = spark.createDataFrame([(f"s{q}", g, p, 0.9) for q in range(40) for g in range(3) for p in range(g, 4) for _ in range(1 + (g + p) % 3)], "seq string, g long, p long, s double")
    got = tm.identity(pairs)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert {(r["seq"], r["idtp"]) for r in got.collect()} == {(f"s{q}", 9) for q in range(40)}


def test_frames_whose_pairs_share_a_box_need_no_assignment(monkeypatch):
    def refuse(_):
        raise AssertionError("assigned")

    monkeypatch.setattr(tm, "assign", refuse)
    rows = [(1, 7, 3, 0.2), (1, 7, 5, 0.6), (1, 7, 9, 0.6), (2, 4, 3, 0.5), (2, 8, 3, 0.9)]
    cols = {"seq": ["a"] * 5, **{c: [r[k] for r in rows] for k, c in enumerate(["image_id", "g", "p", "s"])}, "gain": [r[3] for r in rows]}
    got = [b.to_pydict() for b in tm._best(iter([pa.RecordBatch.from_pydict(cols)]))]
    assert [(b["image_id"], b["g"], b["p"]) for b in got] == [([1, 2], [7, 8], [5, 3])]


def test_sources_are_worked_out_once_a_side(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    cols = "seq string, image_id long, track_id long, l double, t double, w double, h double"
    rows = [("a", f, k, 10.0 * k, 0.0, 30.0, 30.0) for f in range(5) for k in range(3)]
    gt, pred = (spark.createDataFrame(rows, cols).mapInArrow(counted, cols) for _ in range(2))
    tm.tracking_metrics(gt, pred).collect()
    assert seen.value == 2 * len(rows)
