"""Boxes, cameras and the pitch plane as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- boxes -----------------------------------------------------------------------------


def ltrb(l: Column, t: Column, w: Column, h: Column) -> Column:
    return F.struct(l.alias("l"), t.alias("t"), (l + w).alias("r"), (t + h).alias("b"))


def ltwh(l: Column, t: Column, r: Column, b: Column) -> Column:
    return F.struct(l.alias("l"), t.alias("t"), (r - l).alias("w"), (b - t).alias("h"))


def _clamped(x1, y1, x2, y2, width, height, least):
    a = [F.greatest(F.lit(0), x1), F.greatest(F.lit(0), y1), F.least(lit(width), x2), F.least(lit(height), y2)]
    return F.when((a[2] - a[0] >= least) & (a[3] - a[1] >= least), F.struct(*[c.alias(n) for c, n in zip(a, ("x1", "y1", "x2", "y2"), strict=True)]))


def crop_truncated(l, t, w, h, width, height) -> Column:
    """Pixel box cut to the frame, coordinates truncated; null if empty."""
    return _clamped(l.cast("int"), t.cast("int"), (l + w).cast("int"), (t + h).cast("int"), width, height, 1)


def crop_rounded(l, t, w, h, width, height, least: int = 1) -> Column:
    """Pixel box cut to the frame, coordinates rounded half to even; null under ``least`` pixels a side."""
    return _clamped(*(F.bround(c).cast("int") for c in (l, t, l + w, t + h)), width, height, least)


def pad_box(l, t, w, h, width, height, share: float = 0.18) -> Column:
    """Box widened by a share of its size on every side, rounded half to even and clipped to the frame."""
    px, py = w * share, h * share
    return F.struct(F.greatest(F.lit(0), F.bround(l - px).cast("int")).alias("x0"), F.greatest(F.lit(0), F.bround(t - py).cast("int")).alias("y0"), F.least(lit(width), F.bround(l + w + px).cast("int")).alias("x1"), F.least(lit(height), F.bround(t + h + py).cast("int")).alias("y1"))


def quad_box(quad: Column) -> Column:
    """Axis-aligned box of a list of (x, y) points."""
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def quad_height(quad: Column) -> Column:
    """Length of the edge of a quadrilateral that is closest to vertical."""
    edges = F.transform(F.sequence(F.lit(0), F.size(quad) - 1), lambda i: F.struct((F.get(quad, (i + 1) % F.size(quad))["x"] - F.get(quad, i)["x"]).alias("dx"), (F.get(quad, (i + 1) % F.size(quad))["y"] - F.get(quad, i)["y"]).alias("dy")))
    ranked = F.transform(edges, lambda e: F.struct((F.abs(e["dx"]) / (F.hypot(e["dx"], e["dy"]) + 1e-9)).alias("tilt"), F.hypot(e["dx"], e["dy"]).alias("length")))
    return F.array_min(ranked)["length"]


def edge_side(l: Column, w: Column, width) -> Column:
    """The half of the frame that the centre of the box is in."""
    return F.when(l + w / 2 < lit(width) / 2, "left").otherwise("right")


def letterbox(width, height, to_w: int, to_h: int) -> Column:
    """Scale and centred padding that fit a frame into a canvas."""
    s = F.least(to_w / lit(width), to_h / lit(height))
    w, h = F.bround(lit(width) * s).cast("int"), F.bround(lit(height) * s).cast("int")
    return F.struct(s.alias("scale"), w.alias("w"), h.alias("h"), F.floor((to_w - w) / 2).cast("int").alias("left"), F.floor((to_h - h) / 2).cast("int").alias("top"))


# --- cameras -----------------------------------------------------------------------------


def focal_from_hfov(width: Column, hfov_degrees: Column) -> Column:
    return width / 2 / F.tan(F.radians(hfov_degrees) / 2)


def radial_from_normalised(k: Column, focal: Column, height: Column) -> Column:
    """Six radial coefficients from those normalised by the image height; only the first three are used."""
    used = F.transform(F.slice(F.coalesce(k, F.array().cast("array<double>")), 1, 3), lambda x, i: x * F.pow(focal / height, 2.0 * (i + 1)))
    return F.slice(F.concat(used, F.array_repeat(F.lit(0.0), 6)), 1, 6)


def camera_from_calibrator(cp: Column) -> Column:
    """Camera parameters from the calibrator's JSON object."""
    w, h = cp["sensorResolutionWidthPixels"], cp["sensorResolutionHeightPixels"]
    f = focal_from_hfov(w, cp["horizontalFieldOfViewDegrees"])
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return F.struct(
        F.array(w / 2, h / 2).alias("principal_point"), f.alias("x_focal_length"), f.alias("y_focal_length"), cp["panDegrees"].alias("pan_degrees"), cp["tiltDegrees"].alias("tilt_degrees"), cp["rollDegrees"].alias("roll_degrees"),
        F.array(cp["positionXMeters"], cp["positionYMeters"], cp["positionZMeters"]).alias("position_meters"), radial_from_normalised(cp["normalizedRadialDistortionCoefficients"], f, h).alias("radial_distortion"), zeros(2).alias("tangential_distortion"), zeros(4).alias("thin_prism_distortion"),
    )


def rotation(pan: Column, tilt: Column, roll: Column) -> list[list[Column]]:
    """World-to-camera rotation from angles in degrees: the transpose of Rz(pan) Rx(tilt) Rz(roll)."""
    cp, sp, ct, st, cr, sr = (f(F.radians(a)) for a in (pan, tilt, roll) for f in (F.cos, F.sin))
    o = [[cp * cr - sp * ct * sr, -cp * sr - sp * ct * cr, sp * st], [sp * cr + cp * ct * sr, -sp * sr + cp * ct * cr, -cp * st], [st * sr, st * cr, ct]]
    return [[o[j][i] for j in range(3)] for i in range(3)]


def angles(r: list[list[Column]]) -> Column:
    """pan, tilt and roll in degrees of a rotation; of the two solutions the one with the smaller roll (the second on ties)."""
    o = [[r[j][i] for j in range(3)] for i in range(3)]
    tilt = F.acos(o[2][2])

    def solution(t):
        s = F.when(F.sin(t) > 0, 1.0).otherwise(-1.0)
        return F.struct(F.degrees(F.atan2(s * o[0][2], -s * o[1][2])).alias("pan"), F.degrees(t).alias("tilt"), F.degrees(F.atan2(s * o[2][0], s * o[2][1])).alias("roll"))

    a, b = solution(tilt), solution(-tilt)
    return F.when(F.abs(a["roll"]) < F.abs(b["roll"]), a).otherwise(b)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: plans stay small where a formula needs an intermediate result many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bend(x: Column, y: Column, k: Column, p: Column | None = None, s: Column | None = None) -> tuple[Column, Column, Column]:
    """What a lens does to a point of the normalised image plane: a factor by the six radial coefficients, and a shift by tangential (2) and thin-prism (4) ones."""
    r2 = x * x + y * y
    at = lambda c, i: F.get(c, F.lit(i))
    factor = (1 + sum(at(k, i) * F.pow(r2, i + 1.0) for i in range(3))) / (1 + sum(at(k, i + 3) * F.pow(r2, i + 1.0) for i in range(3)))
    dx = dy = F.lit(0.0)
    if p is not None:
        dx, dy = dx + 2 * at(p, 0) * x * y + at(p, 1) * (r2 + 2 * x * x), dy + 2 * at(p, 1) * x * y + at(p, 0) * (r2 + 2 * y * y)
    if s is not None:
        dx, dy = dx + at(s, 0) * r2 + at(s, 1) * r2 * r2, dy + at(s, 2) * r2 + at(s, 3) * r2 * r2
    return factor, dx, dy


def distort(x: Column, y: Column, k: Column, p: Column | None = None, s: Column | None = None) -> Column:
    """Distorted point of the normalised image plane."""
    factor, dx, dy = bend(x, y, k, p, s)
    return F.struct((x * factor + dx).alias("x"), (y * factor + dy).alias("y"))


def _straightened(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Points without the lens, by fixed-point iteration. c: the coefficients of ``bend``, six, two and four, a row each."""
    k, p, s = c[:6], c[6:8], c[8:]
    u, v = x, y
    with np.errstate(all="ignore"):
        for _ in range(rounds if c.any() else 0):  # NaN counts as something
            r2 = u * u + v * v
            factor = (1 + k[0] * r2 + k[1] * r2**2 + k[2] * r2**3) / (1 + k[3] * r2 + k[4] * r2**2 + k[5] * r2**3)
            dx = 2 * p[0] * u * v + p[1] * (r2 + 2 * u * u) + s[0] * r2 + s[1] * r2 * r2
            dy = 2 * p[1] * u * v + p[0] * (r2 + 2 * v * v) + s[2] * r2 + s[3] * r2 * r2
            u, v = (x - dx) / factor, (y - dy) / factor
    return u, v


def _known(values: np.ndarray) -> pa.Array:
    return pa.array(values, from_pandas=True)


def coefficients(k: Column, p: Column | None, s: Column | None) -> list[Column]:
    """The twelve numbers of a lens; those that are left out are zero."""
    return [F.get(c, F.lit(i)) if c is not None else F.lit(0.0) for c, n in ((k, 6), (p, 2), (s, 4)) for i in range(n)]


def arrays(columns: tuple[pa.Array, ...]) -> np.ndarray:
    """Columns of doubles as rows of a matrix, null as NaN."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])


def undistort(x: Column, y: Column, k: Column, p: Column | None = None, s: Column | None = None, rounds: int = 8) -> Column:
    """Inverse of distort by fixed-point iteration, many points at once; null where a number is missing."""

    @arrow_udf("x double, y double")
    def f(*c: pa.Array) -> pa.Array:
        c = arrays(c)
        return pa.StructArray.from_arrays([_known(v) for v in _straightened(c[0], c[1], c[2:], rounds)], ["x", "y"])

    return f(x, y, *coefficients(k, p, s))


def lens(cam: Column, whole: bool) -> list[Column]:
    """Distortion coefficients of a camera; ``whole`` adds the tangential and thin-prism ones."""
    return [cam["radial_distortion"], *([cam["tangential_distortion"], cam["thin_prism_distortion"]] if whole else [])]


def project(cam: Column, x: Column, y: Column, z: Column, whole: bool = False, r: list[list[Column]] | None = None, straight: Column | None = None) -> Column:
    """Pixel of a world point; null behind the camera. Where many points share a camera: r, its rotation, and straight, whether its lens bends nothing."""
    r = r or rotation(cam["pan_degrees"], cam["tilt_degrees"], cam["roll_degrees"])
    d = [v - F.get(cam["position_meters"], F.lit(i)) for i, v in enumerate((x, y, z))]
    c = F.struct(*[sum(r[i][j] * d[j] for j in range(3)).alias(n) for i, n in enumerate("xyz")])

    def bent(n):
        there = distort(n["x"], n["y"], *lens(cam, whole))
        return there if straight is None else F.when(straight, n).otherwise(there)

    def pixel(q):
        return F.struct((q["x"] * cam["x_focal_length"] + F.get(cam["principal_point"], F.lit(0))).alias("x"), (q["y"] * cam["y_focal_length"] + F.get(cam["principal_point"], F.lit(1))).alias("y"))

    return let(c, lambda q: F.when(q["z"] > 1e-3, let(F.struct((q["x"] / q["z"]).alias("x"), (q["y"] / q["z"]).alias("y")), lambda n: let(bent(n), pixel))))


def project_each(cam: Column, points: Column, use) -> Column:
    """use(point, its index, its pixel) of an array of points (x, y, z), with the camera's rotation worked out once, and no bending where all radial coefficients are 0."""
    turn = F.array(*[v for row in rotation(cam["pan_degrees"], cam["tilt_degrees"], cam["roll_degrees"]) for v in row])
    straight = F.coalesce(F.size(cam["radial_distortion"]) == 6, F.lit(False)) & F.forall(cam["radial_distortion"], lambda k: k == 0)

    def each(t):
        r = [[F.get(t["turn"], F.lit(3 * i + j)) for j in range(3)] for i in range(3)]
        return F.transform(points, lambda s, i: let(project(cam, s["x"], s["y"], s["z"], r=r, straight=t["straight"]), lambda p: use(s, i, p)))

    return let(F.struct(turn.alias("turn"), straight.alias("straight")), each)


def project_homogeneous(cam: Column, x: Column, y: Column, z: Column, whole: bool = True) -> Column:
    """(x, y, 1) of a world point's pixel; the zero vector behind the camera."""
    p = project(cam, x, y, z, whole)
    return F.when(p.isNull(), F.array(*[F.lit(0.0)] * 3)).otherwise(F.array(p["x"], p["y"], F.lit(1.0)))


def project_from_calibrator(cp: Column, x: Column, y: Column, z: Column) -> Column:
    """Pixel by the calibrator's own terms: the offset from the centre is scaled by a series in its length over the image height. Null behind the camera."""
    w, h = cp["sensorResolutionWidthPixels"], cp["sensorResolutionHeightPixels"]
    r = rotation(cp["panDegrees"], cp["tiltDegrees"], cp["rollDegrees"])
    d = [v - cp[f"position{n}Meters"] for n, v in zip("XYZ", (x, y, z), strict=True)]
    f = focal_from_hfov(w, cp["horizontalFieldOfViewDegrees"])
    c = F.struct(*[sum(r[i][j] * d[j] for j in range(3)).alias(n) for i, n in enumerate("xyz")])

    def pixel(q):
        far = (q["u"] * q["u"] + q["v"] * q["v"]) / (h * h)
        series = F.aggregate(F.transform(cp["normalizedRadialDistortionCoefficients"], lambda k, i: k * F.pow(far, i + 1.0)), F.lit(1.0), lambda a, t: a + t)
        return F.struct((w / 2 + q["u"] * series).alias("x"), (h / 2 + q["v"] * series).alias("y"))

    return let(c, lambda q: F.when(q["z"] > 1e-3, let(F.struct((f * q["x"] / q["z"]).alias("u"), (f * q["y"] / q["z"]).alias("v")), pixel)))


# Names of a camera's fields in JSON (fixed values).
CAMERA_FIELDS = ("pan_degrees", "tilt_degrees", "roll_degrees", "position_meters", "x_focal_length", "y_focal_length", "principal_point", "radial_distortion", "tangential_distortion", "thin_prism_distortion")
CAMERA_TYPE = "struct<" + ",".join(f"{n}:{'double' if n.endswith(('degrees', 'length')) else 'array<double>'}" for n in CAMERA_FIELDS) + ">"


def camera_to_json(cam: Column) -> Column:
    return F.to_json(F.struct(*[cam[n].alias(n) for n in CAMERA_FIELDS]))


def camera_from_json(text: Column) -> Column:
    return F.from_json(text, CAMERA_TYPE)


def to_ground(cam: Column, u: Column, v: Column, whole: bool = False) -> Column:
    """Point of the plane z = 0 that is seen at a pixel; null where the ray is level."""
    r = rotation(cam["pan_degrees"], cam["tilt_degrees"], cam["roll_degrees"])
    p = undistort((u - F.get(cam["principal_point"], F.lit(0))) / cam["x_focal_length"], (v - F.get(cam["principal_point"], F.lit(1))) / cam["y_focal_length"], *lens(cam, whole))
    pos = [F.get(cam["position_meters"], F.lit(i)) for i in range(3)]
    ray = let(p, lambda q: F.array(*[r[0][i] * q["x"] + r[1][i] * q["y"] + r[2][i] for i in range(3)]))

    def ground(q):
        s = F.try_divide(-pos[2], F.get(q, F.lit(2)))
        return F.when(s.isNotNull(), F.struct((pos[0] + s * F.get(q, F.lit(0))).alias("x"), (pos[1] + s * F.get(q, F.lit(1))).alias("y")))

    return let(ray, ground)


def bbox_pitch(cam: Column, l: Column, t: Column, w: Column, h: Column) -> Column:
    """Ground points of the lower left, right and middle of a box, as ``to_ground`` gives them; null if any has none."""
    names = [f"{a}_bottom_{n}" for n in ("left", "right", "middle") for a in "xy"]

    def f(*c: pa.Array) -> pa.Array:
        c = arrays(c)
        l, v, w, fx, fy, cx, cy = c[:7]
        r, pos, lens_ = c[7:16].reshape(3, 3, -1), c[16:19], c[19:]
        out = []
        with np.errstate(all="ignore"):
            for u in (l, l + w, l + w / 2):
                x, y = _straightened((u - cx) / fx, (v - cy) / fy, lens_, 8)
                ray = [r[0, i] * x + r[1, i] * y + r[2, i] for i in range(3)]
                far = np.where(ray[2] == 0, np.nan, -pos[2] / ray[2])
                out += [pos[0] + far * ray[0], pos[1] + far * ray[1]]
        return pa.StructArray.from_arrays([pa.array(o) for o in out], names, mask=pa.array(np.isnan(np.stack(out)).any(0)))

    # not to be computed a second time for a filter that asks whether it is null
    g = arrow_udf(f, ", ".join(f"{n} double" for n in names)).asNondeterministic()
    r = rotation(cam["pan_degrees"], cam["tilt_degrees"], cam["roll_degrees"])
    at = lambda c, i: F.get(cam[c], F.lit(i))
    return g(l, t + h, w, cam["x_focal_length"], cam["y_focal_length"], at("principal_point", 0), at("principal_point", 1), *[e for row in r for e in row], *[at("position_meters", i) for i in range(3)], *coefficients(cam["radial_distortion"], None, None))


def rescaled(cam: Column, width: float, height: float) -> Column:
    """Camera at another resolution: principal point and focal lengths scale, distortion stays."""
    sx, sy = width / (2 * F.get(cam["principal_point"], F.lit(0))), height / (2 * F.get(cam["principal_point"], F.lit(1)))
    return cam.withField("x_focal_length", cam["x_focal_length"] * sx).withField("y_focal_length", cam["y_focal_length"] * sy).withField("principal_point", F.array(F.lit(width / 2), F.lit(height / 2)))


def homography(cam: Column) -> list[list[Column]]:
    """3 x 3 matrix from the plane z = 0 to pixels, without distortion."""
    r = rotation(cam["pan_degrees"], cam["tilt_degrees"], cam["roll_degrees"])
    pos = [F.get(cam["position_meters"], F.lit(i)) for i in range(3)]
    m = [[r[i][0], r[i][1], -(r[i][0] * pos[0] + r[i][1] * pos[1] + r[i][2] * pos[2])] for i in range(3)]
    fx, fy, cx, cy = cam["x_focal_length"], cam["y_focal_length"], F.get(cam["principal_point"], F.lit(0)), F.get(cam["principal_point"], F.lit(1))
    return [[fx * m[0][j] + cx * m[2][j] for j in range(3)], [fy * m[1][j] + cy * m[2][j] for j in range(3)], m[2]]


def apply_homography(h: list[list[Column]], x: Column, y: Column) -> Column:
    v = [h[i][0] * x + h[i][1] * y + h[i][2] for i in range(3)]
    return F.when(v[2] != 0, F.struct((v[0] / v[2]).alias("x"), (v[1] / v[2]).alias("y")))


def inverse(m: list[list[Column]]) -> list[list[Column]]:
    """Inverse of a 3 x 3 matrix by cofactors, up to nothing: divided by the determinant."""

    def cof(i, j):
        a, b = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        return (m[a[0]][b[0]] * m[a[1]][b[1]] - m[a[0]][b[1]] * m[a[1]][b[0]]) * (-1) ** (i + j)

    det = sum(m[0][j] * cof(0, j) for j in range(3))
    return [[cof(j, i) / det for j in range(3)] for i in range(3)]


def polyline_distance(x: Column, y: Column, line: Column) -> Column:
    """Distance of a point to a list of (x, y) points joined by segments; of one point, to that point."""

    def to_segment(a, b):
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        k = F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy)
        k = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(k, F.lit(0.0))))
        return F.hypot(x - (a["x"] + k * dx), y - (a["y"] + k * dy))

    one = F.hypot(x - F.get(line, F.lit(0))["x"], y - F.get(line, F.lit(0))["y"])
    many = F.array_min(F.zip_with(F.slice(line, F.lit(1), F.size(line) - 1), F.slice(line, F.lit(2), F.size(line) - 1), to_segment))
    return F.when(F.size(line) == 1, one).when(F.size(line) > 1, many)


def extremity_distances(pred: Column, gt: Column) -> Column:
    """Distances of the two ends of a predicted line to the ends of the true one, the other way round if both are then no farther."""

    def d(a, b):
        return F.hypot(a["x"] - b["x"], a["y"] - b["y"])

    p, g = (F.element_at(pred, 1), F.element_at(pred, -1)), (F.element_at(gt, 1), F.element_at(gt, -1))
    flip = (d(g[1], p[0]) <= d(g[0], p[0])) & (d(g[0], p[1]) <= d(g[1], p[1]))
    return F.when(flip, F.array(d(g[1], p[0]), d(g[0], p[1]))).otherwise(F.array(d(g[0], p[0]), d(g[1], p[1])))


def scaled_lines(lines: Column, width: float, height: float) -> Column:
    """Line annotations in pixels of the evaluation size: values up to 1.5 are shares of the frame, larger ones pixels of a 1920 x 1080 frame."""
    top = F.array_max(F.flatten(F.transform(F.map_values(lines), lambda ps: F.transform(ps, lambda p: F.greatest(p["x"], p["y"])))))
    share = F.coalesce(top, F.lit(0.0)) <= 1.5
    fx, fy = F.when(share, width).otherwise(width / 1920), F.when(share, height).otherwise(height / 1080)
    return F.transform_values(lines, lambda _, ps: F.transform(ps, lambda p: F.struct((p["x"] * fx).alias("x"), (p["y"] * fy).alias("y"))))


# --- the radar -------------------------------------------------------------------------------


def radar_pixel(x: Column, y: Column, scale: float = 8.0, margin: float = 5.0) -> Column:
    """Pixel of a pitch position on a plan of the pitch with a margin, clipped to the plan."""
    cx = F.greatest(F.lit(-52.5 - margin), F.least(F.lit(52.5 + margin), x))
    cy = F.greatest(F.lit(-34.0 - margin), F.least(F.lit(34.0 + margin), y))
    return F.struct(F.bround((cx + 52.5 + margin) * scale).cast("int").alias("u"), F.bround((cy + 34.0 + margin) * scale).cast("int").alias("v"))


def display_label(role: Column, number: Column, track: Column) -> Column:
    """GK, shirt number and id, joined by bars; what is missing is left out."""
    return F.concat_ws(" | ", F.when(role == "goalkeeper", "GK"), F.nullif(number, F.lit("")), F.concat(F.lit("ID "), track.cast("string")))


# --- the pitch model ---------------------------------------------------------------------------

# Measures of the pitch in metres (fixed values).
LENGTH, WIDTH = 105.0, 68.0
PENALTY_LENGTH, PENALTY_WIDTH = 16.5, 40.32
GOAL_AREA_LENGTH, GOAL_AREA_WIDTH = 5.5, 18.32
GOAL_WIDTH, GOAL_HEIGHT = 7.32, 2.44
CIRCLE, SPOT = 9.15, 11.0


def pitch_lines() -> dict[str, tuple]:
    """Ends of the straight lines of the pitch, by class name; x to the right, y down, z up is negative."""
    hl, hw = LENGTH / 2, WIDTH / 2
    out = {"Side line left": ((-hl, -hw, 0), (-hl, hw, 0)), "Side line right": ((hl, -hw, 0), (hl, hw, 0)), "Side line top": ((-hl, -hw, 0), (hl, -hw, 0)), "Side line bottom": ((-hl, hw, 0), (hl, hw, 0)), "Middle line": ((0, -hw, 0), (0, hw, 0))}
    for side, s in (("left", -1), ("right", 1)):
        for name, length, width in (("Big", PENALTY_LENGTH, PENALTY_WIDTH), ("Small", GOAL_AREA_LENGTH, GOAL_AREA_WIDTH)):
            x, y = s * (hl - length), width / 2
            out[f"{name} rect. {side} main"] = ((x, -y, 0), (x, y, 0))
            out[f"{name} rect. {side} top"] = ((s * hl, -y, 0), (x, -y, 0))
            out[f"{name} rect. {side} bottom"] = ((s * hl, y, 0), (x, y, 0))
        g = GOAL_WIDTH / 2
        out[f"Goal {side} crossbar"] = ((s * hl, -g, -GOAL_HEIGHT), (s * hl, g, -GOAL_HEIGHT))
        out[f"Goal {side} post left"] = ((s * hl, s * g, 0), (s * hl, s * g, -GOAL_HEIGHT))
        out[f"Goal {side} post right"] = ((s * hl, -s * g, 0), (s * hl, -s * g, -GOAL_HEIGHT))
    return out


def mirrored(name: str) -> str | None:
    """Class of a line seen after turning the pitch by half a turn; null for classes without a counterpart."""
    if name in ("Middle line", "Circle central"):
        return name
    if "unknown" in name or not any(s in name for s in ("left", "right", "top", "bottom")):
        return None
    swap = {"left": "right", "right": "left", "top": "bottom", "bottom": "top"}
    words = name.split()
    if name.startswith("Goal"):  # the posts keep their side, as seen from the pitch
        return " ".join([words[0], swap[words[1]], *words[2:]])
    return " ".join(swap.get(w, w) for w in words)


def pitch_points(step: float = 0.9, arc_step: float = 0.2) -> list[tuple[str, int, float, float, float]]:
    """(class, index, x, y, z) of points along the lines and arcs of the pitch."""
    out = []
    for name, (a, b) in pitch_lines().items():
        d = math.dist(a, b)
        n = max(1, math.ceil(d / step))
        out += [(name, i, *(p + (q - p) * min(1.0, i * step / d) for p, q in zip(a, b, strict=True))) for i in range(n + 1)]
    for name, cx, keep in (("Circle central", 0.0, lambda x: True), ("Circle left", -LENGTH / 2 + SPOT, lambda x: x > -LENGTH / 2 + PENALTY_LENGTH), ("Circle right", LENGTH / 2 - SPOT, lambda x: x < LENGTH / 2 - PENALTY_LENGTH)):
        n = math.ceil(2 * math.pi * CIRCLE / arc_step)
        start = math.pi if name == "Circle right" else 0.0
        pts = [(cx + CIRCLE * math.cos(t), CIRCLE * math.sin(t)) for t in (start - math.pi + 2 * math.pi * i / n for i in range(n + 1))]
        out += [(name, i, x, y, 0.0) for i, (x, y) in enumerate(p for p in pts if keep(p[0]))]
    return out
