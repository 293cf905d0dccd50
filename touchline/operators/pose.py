"""Camera poses from point matches with known focal lengths: a plane homography as the start, then damped least squares on the pixels.

One row is one frame with its matches, so a frame is solved inside its task and
nothing is grouped. Matches are structs (x, y, z, u, v) in metres and pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Matches of the frames that are solved at once.
TOGETHER = 20_000
#: A step of this many radians and metres is lost in the rounding of the pixels' errors.
NOTHING = 1e-9
SOLVED = "solved boolean, pan_degrees double, tilt_degrees double, roll_degrees double, position_meters array<double>, error double, inliers long"


def turn(w: np.ndarray) -> np.ndarray:
    """Rotation by the vector w (axis times angle)."""
    angle = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    if angle < 1e-12:
        return np.eye(3) + k
    return np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * k @ k


def turns(w: np.ndarray) -> np.ndarray:
    """``turn`` of rows of vectors."""
    angle = np.linalg.norm(w, axis=1)[:, None, None]
    k = np.zeros((len(w), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 0], k[:, 1, 2], k[:, 2, 0], k[:, 2, 1] = -w[:, 2], w[:, 1], w[:, 2], -w[:, 0], -w[:, 1], w[:, 0]
    tiny = angle < 1e-12
    a = np.where(tiny, 1.0, angle)
    return np.eye(3) + np.where(tiny, 1.0, np.sin(a) / a) * k + np.where(tiny, 0.0, (1 - np.cos(a)) / a**2) * (k @ k)


def residual(rot: np.ndarray, pos: np.ndarray, m: np.ndarray, f: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixel errors, a pair a match, and points in the camera's frame; of one frame or of rows of frames."""
    q = (m[..., :3] - pos[..., None, :]) @ np.swapaxes(rot, -1, -2)
    z = np.where(np.abs(q[..., 2:]) < 1e-9, 1e-9, q[..., 2:])
    return q[..., :2] / z * f[..., None, :] + c[..., None, :] - m[..., 3:], q


def refine_all(rot: np.ndarray, pos: np.ndarray, m: np.ndarray, f: np.ndarray, c: np.ndarray, use: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """The poses nearby with the least squared pixel error over the matches in use (Levenberg-Marquardt), a row a frame; a frame that is done rests.

    A step that helps nothing and is shorter than NOTHING ends a frame too: more damping only makes it shorter.
    """
    rot, pos = rot.copy(), pos.copy()
    live, damp = np.arange(len(m)), np.full(len(m), 1e-3)
    for _ in range(rounds):
        if not len(live):
            break
        r, p, mm, ff, cc, on = rot[live], pos[live], m[live], f[live], c[live], use[live][..., None]
        e, q = residual(r, p, mm, ff, cc)
        e = np.where(on, e, 0.0)
        x, y, w = np.moveaxis(q, 2, 0)
        z = np.where(np.abs(w) < 1e-9, 1e-9, w)
        j = np.empty((*q.shape[:2], 2, 6))  # of the pixel by a small turn and by the position
        a, b, d, fx, fy = x / z, y / z, w / z, ff[:, :1], ff[:, 1:]
        j[..., 0, 0], j[..., 0, 1], j[..., 0, 2] = -fx * a * b, fx * (d + a * a), -fx * b
        j[..., 1, 0], j[..., 1, 1], j[..., 1, 2] = -fy * (d + b * b), fy * a * b, fy * a
        for k in range(3):
            r0, r1, r2 = r[:, :1, k], r[:, 1:2, k], r[:, 2:, k]
            j[..., 0, 3 + k], j[..., 1, 3 + k] = fx / z * (a * r2 - r0), fy / z * (b * r2 - r1)
        j *= on[..., None]
        j = j.reshape(len(live), -1, 6)
        jt, flat = np.swapaxes(j, 1, 2), e.reshape(len(live), -1)
        a, g = jt @ j, jt @ flat[..., None]
        d = np.einsum("nii->ni", a)
        left = a + (damp[live][:, None] * (d + 1e-12))[:, :, None] * np.eye(6)
        try:
            step = -np.linalg.solve(left, g)[..., 0]
        except np.linalg.LinAlgError:  # some frame fixes too little: least norm, as for one frame
            step = -(np.linalg.pinv(left) @ g)[..., 0]
        r2, p2 = turns(step[:, :3]) @ r, p + step[:, 3:]
        e2 = np.where(on, residual(r2, p2, mm, ff, cc)[0], 0.0).reshape(len(live), -1)
        before, after = (flat**2).sum(1), (e2**2).sum(1)
        better = after < before
        rot[live[better]], pos[live[better]] = r2[better], p2[better]
        damp[live] = np.where(better, np.maximum(damp[live] / 10, 1e-12), damp[live] * 10)
        size = np.abs(step).max(1)
        done = np.where(better, size < 1e-12, (damp[live] > 1e12) | (size < NOTHING))
        live = live[~done]
    return rot, pos


def refine(rot: np.ndarray, pos: np.ndarray, m: np.ndarray, f: np.ndarray, c: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """``refine_all`` of one frame with all its matches."""
    r, p = refine_all(rot[None], pos[None], m[None], f[None], c[None], np.ones((1, len(m)), bool), rounds)
    return r[0], p[0]


def from_planes(m: np.ndarray, f: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Poses from at least four matches a row on the plane z = 0, by the homography, and whether they are fixed."""
    scale = np.abs(m[..., :2]).max((1, 2))
    scale = np.where(scale > 0, scale, 1.0)
    (x, y), (u, v) = np.moveaxis(m[..., :2] / scale[:, None, None], 2, 0), np.moveaxis((m[..., 3:] - c[:, None]) / f[:, None], 2, 0)
    one, nil = np.ones_like(x), np.zeros_like(x)
    rows = np.stack([np.stack([x, y, one, nil, nil, nil, -u * x, -u * y, -u], 2), np.stack([nil, nil, nil, x, y, one, -v * x, -v * y, -v], 2)], 2).reshape(len(m), -1, 9)
    _, size, vt = np.linalg.svd(rows, full_matrices=rows.shape[1] < 9)
    h = vt[:, 8].reshape(-1, 3, 3) / np.stack([scale, scale, np.ones(len(m))], 1)[:, None]
    return *posed(h, m), (size[:, 7] >= 1e-9) & (lengths(h) >= 1e-12)


def lengths(h: np.ndarray) -> np.ndarray:
    """Mean length of a homography's first two columns."""
    return (np.sqrt((h[:, :, 0] ** 2).sum(1)) + np.sqrt((h[:, :, 1] ** 2).sum(1))) / 2


def posed(h: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Poses from homographies of the plane's points to directions, the matches before the camera. The rotation is the nearest one (polar factor) to the two columns and their cross product."""
    norm = lengths(h)
    h = h / np.where(norm > 0, norm, 1.0)[:, None, None]
    before = (h[:, 2, :2] * m[..., :2].mean(1)).sum(1) + h[:, 2, 2]
    a, b, t = np.moveaxis(np.where((before < 0)[:, None, None], -h, h), 2, 0)
    with np.errstate(divide="ignore", invalid="ignore"):  # columns in one line fix nothing
        n = np.stack([a[:, 1] * b[:, 2] - a[:, 2] * b[:, 1], a[:, 2] * b[:, 0] - a[:, 0] * b[:, 2], a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]], 1)
        aa, ab, bb, s = (a * a).sum(1), (a * b).sum(1), (b * b).sum(1), np.sqrt((n * n).sum(1))
        root = s * np.sqrt(aa + bb + 2 * s)
        rot = np.stack([(a * (bb + s)[:, None] - b * ab[:, None]) / root[:, None], (b * (aa + s)[:, None] - a * ab[:, None]) / root[:, None], n / s[:, None]], 2)
        return rot, -(np.swapaxes(rot, 1, 2) @ t[:, :, None])[..., 0]


def crosses(p: np.ndarray) -> np.ndarray:
    """The triangles' lines (2, 3), (3, 1), (1, 2) of rows of three and more points of the plane (x, y, 1)."""
    x, y = p[:, :3, 0], p[:, :3, 1]
    x1, y1, x2, y2 = x[:, [1, 2, 0]], y[:, [1, 2, 0]], x[:, [2, 0, 1]], y[:, [2, 0, 1]]
    return np.stack([y1 - y2, x2 - x1, x1 * y2 - y1 * x2], 2)


def from_fours(m: np.ndarray, f: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``from_planes`` of exactly four matches a row, in closed form. Three points in one line, on the plane or in the picture, fix nothing."""
    scale = np.abs(m[..., :2]).max((1, 2))
    scale = np.where(scale > 0, scale, 1.0)
    one = np.ones((*m.shape[:2], 1))
    world, seen = np.concatenate([m[..., :2] / scale[:, None, None], one], 2), np.concatenate([(m[..., 3:] - c[:, None]) / f[:, None], one], 2)
    lines, sights = crosses(world), crosses(seen)
    share = [np.concatenate([(k * p[:, 3:]).sum(2), (k[:, :1] * p[:, :1]).sum(2)], 1) for k, p in ((lines, world), (sights, seen))]
    fixed = (np.abs(share[0]).min(1) >= 1e-9) & (np.abs(share[1]).min(1) >= 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = share[1][:, :3] / share[0][:, :3]
        weight /= np.abs(weight).max(1)[:, None]
        h = (np.swapaxes(seen[:, :3], 1, 2) * weight[:, None]) @ lines
    h[~fixed] = 0
    h[:, :, :2] /= scale[:, None, None]
    return *posed(h, m), fixed & (lengths(h) >= 1e-12)


def angles_all(rot: np.ndarray) -> np.ndarray:
    """pan, tilt, roll in degrees, a row a rotation; of the two solutions the one with the smaller roll."""
    o = np.swapaxes(rot, 1, 2)
    tilt = np.arccos(np.clip(o[:, 2, 2], -1, 1))
    both = []
    for t in (tilt, -tilt):
        s = np.where(np.sin(t) > 0, 1.0, -1.0)
        both.append(np.degrees([np.arctan2(s * o[:, 0, 2], -s * o[:, 1, 2]), t, np.arctan2(s * o[:, 2, 0], s * o[:, 2, 1])]).T)
    return np.where((np.abs(both[0][:, 2]) < np.abs(both[1][:, 2]))[:, None], *both)


def angles(rot: np.ndarray) -> tuple[float, float, float]:
    """``angles_all`` of one rotation."""
    return tuple(angles_all(rot[None])[0].tolist())


def fitting(rot: np.ndarray, pos: np.ndarray, m: np.ndarray, f: np.ndarray, c: np.ndarray, tolerance: float) -> np.ndarray:
    return np.linalg.norm(residual(rot, pos, m, f, c)[0], axis=-1) <= tolerance


def solve_all(m: np.ndarray, f: np.ndarray, c: np.ndarray, tolerance: float = 8.0, tries: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``solve`` of rows of frames that have as many matches, of which the same lie on the plane: poses, flags of the fitting matches, and whether a frame is solved."""
    flat = np.flatnonzero(np.abs(m[0, :, 2]) < 1e-9)
    if len(flat) < 4:
        return np.zeros((len(m), 3, 3)), np.zeros((len(m), 3)), np.zeros(m.shape[:2], bool), np.zeros(len(m), bool)
    rot, pos, fixed = from_planes(m[:, flat], f, c)
    near = fitting(rot, pos, m, f, c, tolerance) & fixed[:, None]
    most = np.where(fixed, near.sum(1), -1)
    rng = np.random.default_rng(0)
    for pick in [rng.choice(flat, 4, replace=False) for _ in range(tries - 1)]:
        some = np.flatnonzero(most < m.shape[1])  # the others are fitted by all their matches
        if not len(some):
            break
        r, p, fixed = from_fours(m[some[:, None], pick], f[some], c[some])
        fits = fitting(r, p, m[some], f[some], c[some], tolerance)
        better = fixed & (fits.sum(1) > most[some])
        at = some[better]
        rot[at], pos[at], near[at], most[at] = r[better], p[better], fits[better], fits[better].sum(1)
    ok = np.flatnonzero(most >= 4)
    rot[ok], pos[ok] = refine_all(rot[ok], pos[ok], m[ok], f[ok], c[ok], near[ok])
    fits = fitting(rot[ok], pos[ok], m[ok], f[ok], c[ok], tolerance)
    other = ok[(fits != near[ok]).any(1)]  # the rest lie at the least error of their matches already
    near[ok] = fits
    ok, other = (x[near[x].sum(1) >= 4] for x in (ok, other))
    rot[other], pos[other] = refine_all(rot[other], pos[other], m[other], f[other], c[other], near[other])
    good = np.zeros(len(m), bool)
    good[ok] = True
    return rot, pos, near, good


def solve(m: np.ndarray, f: np.ndarray, c: np.ndarray, tolerance: float = 8.0, tries: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Pose and flags of the matches that fit it, from the sample of four plane matches with which most agree; the samples are drawn alike every time."""
    if len(m) < 4:
        return None
    rot, pos, near, good = solve_all(m[None], f[None], c[None], tolerance, tries)
    return (rot[0], pos[0], near[0]) if good[0] else None


def solved(frames: DataFrame, key: str = "image_id") -> DataFrame:
    """key and the pose of each row of frames(key, focal, centre_x, centre_y, matches); not solved with under four fitting plane matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            focal, cx, cy = (b[c].to_numpy(zero_copy_only=False).astype(float) for c in ("focal", "centre_x", "centre_y"))
            f, c = np.stack([focal, focal], 1), np.stack([cx, cy], 1)
            ends = b["matches"].offsets.to_numpy().astype(np.int64)
            flat = b["matches"].values
            points = np.stack([flat.field(flat.type.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in "xyzuv"], 1)
            plane = np.abs(points[:, 2]) < 1e-9
            able = b["matches"].is_valid().to_numpy(zero_copy_only=False) & ~np.isnan(focal) & (focal != 0)
            alike: dict[tuple, list] = {}  # frames that are solved together
            for i in np.flatnonzero(able & (np.diff(ends) >= 4)).tolist():
                alike.setdefault((ends[i + 1] - ends[i], plane[ends[i] : ends[i + 1]].tobytes()), []).append(i)
            solved, pose, inliers = np.zeros(b.num_rows, bool), np.full((b.num_rows, 7), np.nan), np.zeros(b.num_rows, np.int64)
            for (n, _), every in alike.items():
                most = max(1, TOGETHER // n)
                for rows in (np.array(every[k : k + most]) for k in range(0, len(every), most)):
                    m = points[ends[rows][:, None] + np.arange(n)]
                    rot, pos, near, good = solve_all(m, f[rows], c[rows])
                    rot, pos, near, m, rows = rot[good], pos[good], near[good], m[good], rows[good]
                    away = np.where(near, np.linalg.norm(residual(rot, pos, m, f[rows], c[rows])[0], axis=2), 0.0)
                    solved[rows], inliers[rows] = True, near.sum(1)
                    pose[rows] = np.concatenate([angles_all(rot), pos, (away.sum(1) / near.sum(1))[:, None]], 1)
            gone = ~solved
            place = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(3 * solved)]).astype(np.int32)), pa.array(pose[solved, 3:6].ravel()), mask=pa.array(gone))
            one = [pa.array(pose[:, k], mask=gone) for k in (0, 1, 2, 6)]
            names = ["solved", "pan_degrees", "tilt_degrees", "roll_degrees", "position_meters", "error", "inliers"]
            yield pa.RecordBatch.from_arrays([b[key], pa.array(solved), *one[:3], place, one[3], pa.array(inliers)], [key, *names])

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, "focal", "centre_x", "centre_y", "matches").mapInArrow(run, f"{key} {kind}, {SOLVED}")
