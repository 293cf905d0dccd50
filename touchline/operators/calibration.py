"""Camera quality against annotated pitch lines: projected polylines, their distances, and the accuracy at pixel thresholds.

An image is one group: its camera, its annotated lines and the fixed pitch
model. Uncalibrated images lower the completeness only.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.geometry import mirrored, pitch_points
from touchline.operators.groups import spread

WIDTH, HEIGHT = 960.0, 540.0


def rotation(pan: float, tilt: float, roll: float) -> np.ndarray:
    """World-to-camera rotation from degrees."""
    p, t, r = np.radians([pan, tilt, roll])

    def rz(a):
        return np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])

    rx = np.array([[1, 0, 0], [0, np.cos(t), -np.sin(t)], [0, np.sin(t), np.cos(t)]])
    return (rz(p) @ rx @ rz(r)).T


def project(cam: dict, xyz: np.ndarray) -> np.ndarray:
    """Pixels at WIDTH x HEIGHT; NaN for points behind the camera."""
    rot = rotation(cam["pan_degrees"], cam["tilt_degrees"], cam["roll_degrees"])
    k = [*(cam["radial_distortion"] if cam["radial_distortion"] is not None else []), *[0.0] * 6][:6]
    cx, cy = cam["principal_point"]
    c = (xyz - np.asarray(cam["position_meters"])) @ rot.T
    with np.errstate(divide="ignore", invalid="ignore"):
        n = np.where(c[:, 2:] > 1e-3, c[:, :2] / c[:, 2:], np.nan)
    r2 = (n**2).sum(1)
    if any(k):
        n *= ((1 + k[0] * r2 + k[1] * r2**2 + k[2] * r2**3) / (1 + k[3] * r2 + k[4] * r2**2 + k[5] * r2**3))[:, None]
    return n * [cam["x_focal_length"] * WIDTH / (2 * cx), cam["y_focal_length"] * HEIGHT / (2 * cy)] + [WIDTH / 2, HEIGHT / 2]


def crossing(inside: np.ndarray, outside: np.ndarray) -> np.ndarray | None:
    """Where the segment leaves the frame, by the smallest share of it at which a border is met."""
    step = outside - inside
    hi = np.array([WIDTH - 1, HEIGHT - 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.concatenate([(0 - inside) / step, (hi - inside) / step])
    t = t[np.isfinite(t) & (t >= 0) & (t <= 1)]
    p = inside + step * t.min() if len(t) else None
    return p if p is not None and (p > -1e-9).all() and (p < [WIDTH, HEIGHT]).all() else None


def clipped(pixels: np.ndarray) -> np.ndarray:
    """The part of a projected polyline inside the frame, with its border crossings; points behind the camera are skipped."""
    p = pixels[~np.isnan(pixels).any(1)]
    inside = ((p >= 0) & (p < [WIDTH, HEIGHT])).all(1)
    out, at = [], 0
    for i in np.flatnonzero(inside[1:] != inside[:-1]) + 1:  # a border lies between i - 1 and i
        c = crossing(p[i], p[i - 1]) if inside[i] else crossing(p[i - 1], p[i])
        out += [p[at:i][inside[at:i]], *([c[None]] if c is not None else [])]
        at = i
    return np.concatenate([*out, p[at:][inside[at:]]]).reshape(-1, 2)


def model() -> dict[str, np.ndarray]:
    by: dict[str, list] = {}
    for name, _, *xyz in pitch_points():
        by.setdefault(name, []).append(xyz)
    return {k: np.array(v) for k, v in by.items()}


class Pitch:
    """The model's points in one table, class by class."""

    def __init__(self):
        by = model()
        self.names = list(by)
        self.points = np.concatenate(list(by.values()))
        ends = np.cumsum([len(v) for v in by.values()])
        self.at = {n: slice(e - len(v), e) for (n, v), e in zip(by.items(), ends, strict=True)}
        self.starts = np.array([s.start for s in self.at.values()])

    def seen(self, cam: dict) -> tuple[set[str], np.ndarray]:
        """Classes with a point in the frame, and the pixels of all points."""
        p = project(cam, self.points)
        inside = ((p >= 0) & (p < [WIDTH, HEIGHT])).all(1)
        return {self.names[i] for i in np.flatnonzero(np.logical_or.reduceat(inside, self.starts))}, p


def distances(points: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Distance of each point to a polyline."""
    if len(line) == 1:
        return np.linalg.norm(points - line[0], axis=1)
    a, d = line[:-1], np.diff(line, axis=0)
    rel = points[:, None] - a[None]
    k = np.clip((rel * d).sum(2) / np.maximum((d**2).sum(1), 1e-12), 0, 1)
    return np.linalg.norm(rel - k[..., None] * d, axis=2).min(1)


def compare(seen: set[str], pixels: dict[str, np.ndarray], gt: dict[str, np.ndarray], thresholds: tuple[float, ...]) -> tuple[list[float], list[float]]:
    """Share of line classes that are right (all points nearer than the threshold) at each threshold, and all point distances.

    seen: classes in the frame; pixels: the polylines of those that are annotated.
    """
    apart = [distances(gt[name], pixels[name]) for name in gt if name in seen]
    total = len(seen | set(gt))
    most = [d.max() for d in apart]
    return [sum(m < t for m in most) / total if total else 0.0 for t in thresholds], [x for d in apart for x in d.tolist()]


def scaled(lines: dict) -> dict[str, np.ndarray]:
    """Annotations in pixels of the evaluation size: shares of the frame up to 1.5, else pixels of 1920 x 1080."""
    pts = {k: np.array([[p["x"], p["y"]] for p in v], float).reshape(-1, 2) for k, v in lines.items()}
    top = max((v.max() for v in pts.values() if len(v)), default=0)
    f = np.array([WIDTH, HEIGHT]) if top <= 1.5 else np.array([WIDTH / 1920, HEIGHT / 1080])
    return {k: v * f for k, v in pts.items() if len(v)}


OUT = "image_id long, calibrated boolean, jac5 double, jac10 double, errors array<double>"
THRESHOLDS = (5.0, 10.0)
#: Images whose points are projected at once.
TOGETHER = 128


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1 .. of every range, one after the other."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def lists(a: pa.ListArray | pa.MapArray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the lists in their values; a null list is empty."""
    o = a.offsets.to_numpy().astype(np.int64)
    return o[:-1], np.where(a.is_valid().to_numpy(zero_copy_only=False), np.diff(o), 0)


def numbers(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(float)


def rows_of(a: pa.ListArray, width: int) -> np.ndarray:
    """The first entries of each list, 0 where it is shorter."""
    starts, counts = lists(a)
    counts, out = np.minimum(counts, width), np.zeros((len(a), width))
    out[np.repeat(np.arange(len(a)), counts), ranges(np.zeros(len(a), np.int64), counts)] = numbers(a.values)[ranges(starts, counts)]
    return out


class Cameras:
    """Rows of cameras as arrays."""

    def __init__(self, cam: pa.StructArray):
        part = {f.name: cam.field(k) for k, f in enumerate(cam.type)}
        pan, tilt, roll = (np.radians(numbers(part[n])) for n in ("pan_degrees", "tilt_degrees", "roll_degrees"))
        one, nil = np.ones(len(cam)), np.zeros(len(cam))

        def rz(a):
            return np.stack([np.cos(a), -np.sin(a), nil, np.sin(a), np.cos(a), nil, nil, nil, one], 1).reshape(-1, 3, 3)

        rx = np.stack([one, nil, nil, nil, np.cos(tilt), -np.sin(tilt), nil, np.sin(tilt), np.cos(tilt)], 1).reshape(-1, 3, 3)
        self.rot = np.swapaxes(rz(pan) @ rx @ rz(roll), 1, 2)
        self.pos, self.k = rows_of(part["position_meters"], 3), rows_of(part["radial_distortion"], 6)
        half = rows_of(part["principal_point"], 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.focal = np.stack([numbers(part["x_focal_length"]) * WIDTH / (2 * half[:, 0]), numbers(part["y_focal_length"]) * HEIGHT / (2 * half[:, 1])])

    def project(self, at: np.ndarray, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``project`` of the cameras at these rows: x and y of all points, a row a camera."""
        turned = np.concatenate([self.rot[at], -self.rot[at] @ self.pos[at][:, :, None]], 2)
        x, y, z = np.swapaxes(turned, 0, 1).reshape(-1, 4).dot(np.concatenate([xyz.T, np.ones((1, len(xyz)))])).reshape(3, len(at), -1)
        z[~(z > 1e-3)] = np.nan
        x, y = x / z, y / z
        k = self.k[at].T[:, :, None]
        if k.any():
            r2 = x**2 + y**2
            factor = (1 + k[0] * r2 + k[1] * r2**2 + k[2] * r2**3) / (1 + k[3] * r2 + k[4] * r2**2 + k[5] * r2**3)
            bent = k.any(0)[:, 0]
            x[bent], y[bent] = (x * factor)[bent], (y * factor)[bent]
        fx, fy = self.focal[:, at, None]
        return x * fx + WIDTH / 2, y * fy + HEIGHT / 2


def in_frame(p: np.ndarray) -> np.ndarray:
    return (p[:, 0] >= 0) & (p[:, 0] < WIDTH) & (p[:, 1] >= 0) & (p[:, 1] < HEIGHT)


def clipped_all(p: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``clipped`` of polylines one after the other: owner tells, in rising order, whose a point is. The points left and their owners."""
    there = ~np.isnan(p).any(1)
    p, owner = p[there], owner[there]
    inside = in_frame(p)
    at = np.flatnonzero((inside[1:] != inside[:-1]) & (owner[1:] == owner[:-1])) + 1  # a border lies between at - 1 and at
    came = inside[at][:, None]
    a, b = np.where(came, p[at], p[at - 1]), np.where(came, p[at - 1], p[at])
    step = b - a
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.concatenate([(0 - a) / step, (np.array([WIDTH - 1, HEIGHT - 1]) - a) / step], 1)
        t = np.where((t >= 0) & (t <= 1), t, np.inf).min(1)
        cut = a + step * t[:, None]
    good = np.isfinite(t) & (cut > -1e-9).all(1) & (cut < [WIDTH, HEIGHT]).all(1)
    every = np.insert(p, at[good], cut[good], 0)
    kept = np.insert(inside, at[good], True)
    return every[kept], np.insert(owner, at[good], owner[at[good]])[kept]


def distances_all(points: np.ndarray, counts: np.ndarray, line: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """``distances`` of the points of pair after pair (counts a pair) to the pair's polyline."""
    size = np.bincount(owner, minlength=len(counts))
    first = np.cumsum(size) - size
    last = np.zeros(len(line), bool)
    last[first + size - 1] = True
    d = np.where(last[:, None], 0.0, np.roll(line, -1, 0) - line)
    keep = ~last
    keep[first[size == 1]] = True  # one point is a segment without length
    a, d, size = line[keep], d[keep], np.maximum(size - 1, 1)
    length = np.maximum((d**2).sum(1), 1e-12)
    of = np.repeat(np.arange(len(counts)), counts)
    seg = ranges((np.cumsum(size) - size)[of], size[of])
    (ax, ay), (dx, dy) = a.T, d.T
    x, y = np.repeat(points[:, 0], size[of]) - ax[seg], np.repeat(points[:, 1], size[of]) - ay[seg]
    dx, dy = dx[seg], dy[seg]
    k = np.clip((x * dx + y * dy) / length[seg], 0, 1)
    x -= k * dx
    y -= k * dy
    return np.sqrt(np.minimum.reduceat(x * x + y * y, np.cumsum(size[of]) - size[of]))


def firsts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


class Scorer:
    """Scores of many images at once."""

    def __init__(self):
        self.pitch, self.turn = Pitch(), functools.cache(mirrored)
        self.code = {n: k for k, n in enumerate(self.pitch.names)}
        self.sizes = np.diff([*self.pitch.starts, len(self.pitch.points)])

    def compared(self, n: int, image: np.ndarray, name: np.ndarray, total: np.ndarray, pairs: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``compare`` of n images against their annotated lines: shares at the thresholds, number of distances an image, distances."""
        seen, px, py, starts, counts, points = pairs
        met = np.flatnonzero((name >= 0) & seen[image, np.maximum(name, 0)])
        image, name, starts, counts = image[met], name[met], starts[met], counts[met]
        total = total + seen.sum(1) - np.bincount(image, minlength=n)
        if not len(met):
            return np.zeros((n, len(THRESHOLDS))), np.zeros(n, np.int64), np.zeros(0)
        at = ranges(self.pitch.starts[name], self.sizes[name])
        of = np.repeat(np.arange(len(met)), self.sizes[name])
        line, owner = clipped_all(np.stack([px[image[of], at], py[image[of], at]], 1), of)
        apart = distances_all(points[ranges(starts, counts)], counts, line, owner)
        most = np.maximum.reduceat(apart, firsts(counts))
        right = np.stack([np.bincount(image[most < t], minlength=n) for t in THRESHOLDS], 1)
        return right / np.maximum(total, 1)[:, None], np.bincount(image, counts, n).astype(np.int64), apart

    def scores(self, b: pa.RecordBatch) -> pa.RecordBatch:
        cam, lines = b["cam"], b["lines"]
        starts, counts = lists(lines)
        entry = ranges(starts, counts)
        image = np.repeat(np.arange(b.num_rows), counts)
        p_starts, p_counts = (x[entry] for x in lists(lines.items))
        some = p_counts > 0
        entry, image, p_starts, p_counts = entry[some], image[some], p_starts[some], p_counts[some]
        point = lines.items.values
        points = np.stack([numbers(point.field(point.type.get_field_index(c))) for c in "xy"], 1)
        at, of = ranges(p_starts, p_counts), np.repeat(image, p_counts)
        top = np.full(b.num_rows, -np.inf)
        np.fmax.at(top, of, np.fmax(*points[at].T))
        points, p_starts = points[at] * np.where((top <= 1.5)[of][:, None], [WIDTH, HEIGHT], [WIDTH / 1920, HEIGHT / 1080]), firsts(p_counts)
        words = lines.keys.dictionary_encode()
        names = words.dictionary.to_pylist()
        word = words.indices.to_numpy(zero_copy_only=False)[entry]
        turned = [self.turn(n) for n in names]
        known = [np.array([self.code.get(n, -1) for n in x], int) for x in (names, turned)]
        forms = {n: k for k, n in enumerate(dict.fromkeys(turned))}
        form = np.array([-1 if n is None else forms[n] for n in turned], int)[word]
        back = np.flatnonzero(form >= 0)  # names that turn into the same one: the last counts
        back = np.sort(back[::-1][np.unique((image * (len(forms) + 1) + form)[back][::-1], return_index=True)[1]])

        annotated = np.bincount(image, minlength=b.num_rows) > 0
        calibrated = annotated & cam.is_valid().to_numpy(zero_copy_only=False)
        jac, n_errors, errors = np.full((b.num_rows, len(THRESHOLDS)), np.nan), np.zeros(b.num_rows, np.int64), [np.zeros(0)]
        cams, todo = Cameras(cam), np.flatnonzero(calibrated)
        for k in range(0, len(todo), TOGETHER):
            rows = todo[k : k + TOGETHER]
            px, py = cams.project(rows, self.pitch.points)
            inside = (px >= 0) & (px < WIDTH) & (py >= 0) & (py < HEIGHT)
            seen = np.logical_or.reduceat(inside, self.pitch.starts, axis=1)
            place = np.full(b.num_rows, -1)
            place[rows] = np.arange(len(rows))
            both = []
            for part, code in ((slice(None), known[0]), (back, known[1])):
                here = place[image[part]]
                mine = here >= 0
                here = here[mine]
                both.append(self.compared(len(rows), here, code[word[part][mine]], np.bincount(here, minlength=len(rows)), (seen, px, py, p_starts[part][mine], p_counts[part][mine], points)))
            jac[rows] = np.maximum(both[0][0], both[1][0])
            better = both[1][0][:, 0] > both[0][0][:, 0]
            n = np.where(better, both[1][1], both[0][1])
            first = np.where(better, firsts(both[1][1]) + len(both[0][2]), firsts(both[0][1]))
            n_errors[rows] = n
            errors.append(np.concatenate([both[0][2], both[1][2]])[ranges(first, n)])
        out = np.flatnonzero(annotated)
        ends = pa.array(np.concatenate([[0], np.cumsum(n_errors[out])]).astype(np.int32))
        none = ~calibrated[out]
        columns = [b["image_id"].take(pa.array(out)), pa.array(calibrated[out]), *(pa.array(jac[out, k], mask=none) for k in range(len(THRESHOLDS))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(errors)))]
        return pa.RecordBatch.from_arrays(columns, ["image_id", "calibrated", "jac5", "jac10", "errors"])


def image_scores(frames: DataFrame) -> DataFrame:
    """Scores of each annotated image (image_id, cam, lines). The mirrored annotation is tried too, per threshold; ties keep the plain one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer()
        yield from (scorer.scores(b) for b in batches)

    return spread(frames.select(F.col("image_id").cast("long").alias("image_id"), "cam", "lines"), "image_id").mapInArrow(run, OUT)


def calibration_metrics(scores: DataFrame) -> DataFrame:
    """JaC5, JaC10, mean and median reprojection error, completeness and final score, in one row. The scores are read once: a row an error, of which an image's first also stands for the image."""
    rows = scores.select("calibrated", "jac5", "jac10", F.posexplode_outer("errors").alias("at", "e"))
    image = F.coalesce(F.col("at"), F.lit(0)) == 0
    once = lambda c: F.when(image, F.col(c))
    base = rows.agg(
        F.avg(once("jac5")).alias("jac5"), F.avg(once("jac10")).alias("jac10"), F.avg(once("calibrated").cast("double")).alias("cr"), F.count_if(image).alias("n_frames"),
        F.avg("e").alias("mre"), F.median("e").alias("medre"), F.count("at").alias("n_points"),
    )
    return base.withColumn("final_score", F.col("cr") * F.col("jac5")).select("jac5", "jac10", "cr", "n_frames", "final_score", "mre", "medre", "n_points")
