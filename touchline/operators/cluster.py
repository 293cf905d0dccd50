"""Clustering kernels in numpy and their grouped forms: density clusters, two means, tracklet splitting. Groups of any size: metric_space."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.groups import each_group

NOISE = -1


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 1e-9)


def cosine_distances(u: np.ndarray) -> np.ndarray:
    return np.clip(1 - u @ u.T, 0, 2)


def dbscan(dist: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Density clusters over a distance matrix; labels in order of their first core row, noise is -1.

    A row is core with min_samples rows within eps, itself included. Border rows
    go to the first cluster, in label order, that has a core row within eps.
    """
    near = dist <= eps
    core = near.sum(1) >= min_samples
    label = np.full(len(dist), NOISE)
    k = 0
    for i in np.flatnonzero(core):
        if label[i] != NOISE:
            continue
        front = np.zeros(len(dist), bool)
        front[i] = True
        seen = front
        while front.any():
            nxt = near[front].any(0) & core & ~seen
            seen, front = seen | nxt, nxt
        border = near[seen].any(0) & ~core & (label == NOISE)
        label[seen | border] = k
        k += 1
    return label


def two_means(x: np.ndarray, starts: int = 10, seed: int = 42, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels of the best of several Lloyd runs with spread-out starts."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        a = int(rng.integers(len(x)))
        d = ((x - x[a]) ** 2).sum(1)
        b = int(rng.choice(len(x), p=d / d.sum())) if d.sum() > 0 else a
        c = np.stack([x[a], x[b]]).astype(float)
        for _ in range(rounds):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            lab = d.argmin(1)
            new = np.stack([x[lab == k].mean(0) if (lab == k).any() else c[k] for k in (0, 1)])
            if np.allclose(new, c, atol=1e-12):
                break
            c = new
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        cost = d.min(1).sum()
        if best is None or cost < best[0] - 1e-12:
            best = (cost, c, d.argmin(1))
    return best[1], best[2]


def knee(values: np.ndarray) -> float:
    """The sorted value farthest from the chord between the first and the last; the median of fewer than four."""
    s = np.sort(values)
    if len(s) < 4:
        return float(np.median(s)) if len(s) else 0.5
    x, y = np.linspace(0, 1, len(s)), (s - s[0]) / (s[-1] - s[0] + 1e-9)
    # twice the area of the triangle with both ends of the chord
    return float(s[int(np.argmax(np.abs(x * (y[-1] - y[0]) - (y - y[0]))))])


def centroid(u: np.ndarray, clean: np.ndarray) -> np.ndarray | None:
    """Mean of clean non-zero rows, else of non-zero rows, else none."""
    nz = np.linalg.norm(u, axis=1) > 1e-6
    pick = nz & clean if (nz & clean).any() else nz
    return u[pick].mean(0) if pick.any() else None


def nearest(u: np.ndarray, centres: dict[int, np.ndarray | None]) -> np.ndarray:
    """Label of the nearest centre of each row; one without a centre is at distance 1; lower labels win within 1e-12."""
    labels = sorted(centres)
    d = np.stack([np.ones(len(u)) if centres[c] is None else 1 - u @ centres[c] for c in labels], 1)
    out, best = np.full(len(u), labels[0]), d[:, 0].copy()
    for k, c in enumerate(labels[1:], 1):
        closer = d[:, k] < best - 1e-12
        out[closer], best[closer] = c, d[closer, k]
    return out


def split_track(u: np.ndarray, clean: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Fragment 0..k-1 of each row: density clusters, noise to the nearest, clusters without a clean row dissolved."""
    whole = np.zeros(len(u), int)
    if len(u) < max(2, min_samples):
        return whole
    lab = dbscan(cosine_distances(u), eps, min_samples)
    if (lab == NOISE).all():
        return whole
    centres = {int(c): centroid(u[lab == c], clean[lab == c]) for c in np.unique(lab) if c != NOISE}
    noise = lab == NOISE
    lab[noise] = nearest(u[noise], centres)
    stay = [c for c in centres if clean[lab == c].any()]
    if stay and len(stay) < len(centres):
        left = {c: centroid(u[lab == c], clean[lab == c]) for c in stay}
        gone = ~np.isin(lab, stay)
        lab[gone] = nearest(u[gone], left)
    return np.unique(lab, return_inverse=True)[1]


def vectors(col: pd.Series, dim: int | None = None) -> np.ndarray:
    """Rows of a column of lists; null is a zero row."""
    dim = dim or next((len(v) for v in col if v is not None), 1)
    return np.stack([np.zeros(dim) if v is None else np.asarray(v, float) for v in col]) if len(col) else np.zeros((0, dim))


def rows_of(col: pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of lists of one length; null is a zero row."""
    col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    there = col.is_valid().to_numpy(zero_copy_only=False)
    n = int(there.sum())
    out = np.zeros((len(col), len(flat) // n if n else 1))
    out[there] = flat.reshape(n, -1) if n else 0
    return out


def split_tracks(det: DataFrame, eps: float = 0.2, min_samples: int = 5) -> DataFrame:
    """det_id and fragment of every tracked row. A track is one unit; many share a task."""

    def one(t: pa.Table) -> pa.RecordBatch:
        frame = t["frame"].to_numpy()
        if (frame[1:] == frame[:-1]).any():
            raise ValueError(f"track {t['track_id'][0]} of {t['seq'][0]} has two rows in a frame")
        fragment = split_track(unit(rows_of(t["embedding"])), t["clean"].to_numpy(zero_copy_only=False).astype(bool), eps, min_samples)
        return pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in ("seq", "det_id", "track_id")), pa.array(fragment, pa.int64())], ["seq", "det_id", "track_id", "fragment"])

    rows = det.where("track_id IS NOT NULL").select("seq", F.col("track_id").cast("long").alias("track_id"), "frame", F.col("det_id").cast("long").alias("det_id"), "embedding", "clean")
    return each_group(rows, ["seq", "track_id"], one, "seq string, det_id long, track_id long, fragment long", ("frame", "det_id"))


def team_clusters(desc: DataFrame, k: float = 3.25) -> DataFrame:
    """cluster and nearest of each descriptor of a sequence: two means, then the robust distance rule clears cluster."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("track_id")
        out = pd.DataFrame({"seq": p.seq, "track_id": p.track_id, "cluster": None, "nearest": None, "distance": np.nan})
        if len(p) >= 2:
            x = vectors(p["unit"])
            c, lab = two_means(x)
            d = np.linalg.norm(x - c[lab], axis=1)
            m = np.median(d)
            s = np.median(np.abs(d - m))
            gone = (d > m + k * s) if s >= 0.05 * m else np.zeros(len(d), bool)
            out["nearest"], out["cluster"], out["distance"] = lab, np.where(gone, None, lab), d
        return out

    return desc.select("seq", "track_id", "unit").groupBy("seq").applyInPandas(one, "seq string, track_id long, cluster int, nearest int, distance double")

