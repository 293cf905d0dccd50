"""Pivot cells against plain versions that hold everything."""

import random

import numpy as np
import pytest

from touchline.operators import cluster, groups, metric_space


def clustered(seed, n=900, dims=8, centres=12, spread=0.12, noise=0.2):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = np.where(rng.random(n)[:, None] < noise, rng.normal(size=(n, dims)), c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims)))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x, labels):
    order = list(range(len(x)))
    random.Random(0).shuffle(order)
    return spark.createDataFrame([(i, None if x[i] is None else [float(v) for v in x[i]], labels[i], 1, 2.0) for i in order], "vec_id long, embedding array<double>, label int, p long, x double")


def plain_clusters(x, labels, eps, least):
    out = {}
    for la in set(labels):
        at = [i for i in range(len(x)) if labels[i] == la]
        lab = cluster.dbscan(cluster.cosine_distances(cluster.unit(np.array([x[i] for i in at]))), eps, least)
        out |= {i: int(v) for i, v in zip(at, lab, strict=True)}
    return out


@pytest.mark.parametrize(("seed", "eps", "spread"), [(1, 0.02, 0.12), (2, 0.06, 0.2), (3, 0.3, 0.3)])
def test_density_clusters_equal_dbscan(spark, monkeypatch, seed, eps, spread):
    monkeypatch.setattr(metric_space, "BLOCK", 60)
    monkeypatch.setattr(metric_space, "MEET", 200)
    x = clustered(seed, spread=spread)
    labels = [0 if i % 4 else 1 for i in range(len(x))]
    got = {r["vec_id"]: r["cluster"] for r in metric_space.density_clusters(table(spark, x, labels), "label", eps, 4).collect()}
    want = plain_clusters(x, labels, eps, 4)
    assert got == want and len(set(want.values())) > 1


def test_density_clusters_of_5000_rows_hold_no_group_in_a_task(spark, monkeypatch):
    largest = []
    plain = metric_space.each_group

    def watched(df, keys, f, schema, order=()):
        largest.append(df.groupBy(*keys).count().agg({"count": "max"}).first()[0])
        return plain(df, keys, f, schema, order)

    monkeypatch.setattr(metric_space, "each_group", watched)
    monkeypatch.setattr(metric_space, "BLOCK", 300)
    monkeypatch.setattr(metric_space, "MEET", 1000)
    x = clustered(5, n=5000, dims=16, centres=25, spread=0.06)
    got = {r["vec_id"]: r["cluster"] for r in metric_space.density_clusters(table(spark, x, [0] * len(x)), "label", 0.05, 5).collect()}
    assert got == plain_clusters(x, [0] * len(x), 0.05, 5)
    assert max(largest) < 1500


def test_rows_without_structure_meet_a_block_once(spark, monkeypatch):
    sent = []
    plain = metric_space.each_group

    def watched(df, keys, f, schema, order=()):
        if "i" in keys:
            sent.append(df.count())
        return plain(df, keys, f, schema, order)

    monkeypatch.setattr(metric_space, "each_group", watched)
    monkeypatch.setattr(metric_space, "BLOCK", 100)
    x = clustered(9, n=1500, dims=16, noise=1.0)
    got = {r["vec_id"]: r["cluster"] for r in metric_space.density_clusters(table(spark, x, [0] * len(x)), "label", 0.5, 4).collect()}
    assert got == plain_clusters(x, [0] * len(x), 0.5, 4)
    assert len(sent) == 2 and max(sent) <= 1500 * (1500 / 100 + 1)


def test_odd_vectors_are_noise_and_groups_may_be_null(spark):
    x = [[1.0, 0.0], [0.999, 0.01], [0.0, 0.0], None, [0.0, 1.0], [1.0, 0.0], [1.0, 0.001]]
    rows = metric_space.density_clusters(table(spark, x, [None, None, 1, 1, 1, None, 1]), "label", 0.01, 2).collect()
    assert {r["vec_id"]: (r["label"], r["cluster"]) for r in rows} == {0: (None, 0), 1: (None, 0), 5: (None, 0), 2: (1, -1), 3: (1, -1), 4: (1, -1), 6: (1, -1)}
    assert metric_space.density_clusters(table(spark, [], []), "label", 0.1, 2).count() == 0
    with pytest.raises(ValueError):
        metric_space.density_clusters(table(spark, x, [1] * 7), "label", 1.0, 2)


@pytest.mark.parametrize("k", [1, 3])
def test_kth_neighbour_equals_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(metric_space, "BLOCK", 50)
    monkeypatch.setattr(metric_space, "MEET", 150)
    rng = np.random.default_rng(k)
    x = clustered(k, n=500) * rng.uniform(0.98, 1.02, (500, 1))  # lengths near one need no exact one
    labels = [0 if i < 460 else 1 if i < 498 else 2 for i in range(500)]
    got = {r["vec_id"]: r["d"] for r in metric_space.neighbour_distance(table(spark, x, labels), "label", k).collect()}
    want = {}
    for la in (0, 1, 2):
        at = [i for i in range(500) if labels[i] == la]
        d = np.clip(1 - x[at] @ x[at].T, 0, 2)
        np.fill_diagonal(d, np.inf)
        if len(at) > k:
            want |= {i: v for i, v in zip(at, np.sort(d, axis=1)[:, k - 1], strict=True)}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_bounds_spare_pairs_of_clustered_vectors(spark):
    own = metric_space.numbered(table(spark, clustered(7, n=2000, dims=16, centres=8, spread=0.03, noise=0.0), [0] * 2000), "label", False)
    w = metric_space.Neighbours(own, 3).work().first()
    assert w["whole"] == 2000 * 1999 and w["computed"] < 0.5 * w["whole"]


def test_components(spark):
    rnd = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(70)] + [(300, k) for k in range(301, 330)] + [(5, 5)]
    up = {}

    def root(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for v in up}
