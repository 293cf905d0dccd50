"""Density clusters and k-th neighbours of groups of any size, exactly, by pivots and triangle bounds.

About half the root of a group's size of its rows, picked by hash, are pivots; every row belongs to the
cell of its nearest one. A cell is known by its radius, so the distance of a row to
the pivot tells whether anything in the cell can be as near as needed: if not, no
pair of the two is looked at. Rows meet pivots, and cells their visitors, in
blocks of bounded size, so no task holds a group and nothing is broadcast.

Cells bound Euclidean distances of vectors x and y; with |x|^2 + |y|^2 - 2 x.y that
bounds the cosine distance 1 - x.y. On vectors without any structure the bounds
exclude little and most pairs are computed (``Neighbours.work`` counts them), in
matrix products rather than as joined rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.groups import block_pairs, components, each_group, matrix, written

#: Rows of a group that meet its pivots in one unit, and rows of a cell that meet each other.
MEET, BLOCK = 20_000, 2000
SLACK = 1e-6


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows."""
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)


def batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in schema.split(", ")])


class Cells:
    """Rows with a number p, group g and vector x, dealt to cells."""

    def __init__(self, points: DataFrame):
        self.points = points
        n = F.col("n")
        self.sizes = written(points.groupBy("g").agg(F.count("*").alias("n"), F.min_by("p", F.xxhash64("p")).alias("first"), F.max("sq").alias("most")), "sizes")
        share = F.pmod(F.xxhash64("p", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
        rows = points.join(self.sizes, "g")
        self.pivots = written(rows.where((share < 0.5 * F.sqrt(n) / n) | (F.col("p") == F.col("first"))).select("g", F.col("p").alias("cell"), "x"), "pivots")
        own = self.meet(points.withColumn("radius", F.lit(0.0)), self.pivots.withColumn("reach", F.lit(0.0)), _nearest, "p long, cell long, away double")
        self.rows = written(points.join(own, "p"), "cells")
        self.cells = written(self.rows.groupBy("g", "cell").agg(F.count("*").alias("members"), F.max("away").alias("reach")), "reach")

    def meet(self, rows: DataFrame, pivots: DataFrame, f: Callable, schema: str) -> DataFrame:
        """Rows (p, g, x, radius) in blocks of a group with all pivots (g, cell, x, reach) of it, pivots first."""
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / MEET)).cast("int")
        sizes = self.sizes.select("g", blocks.alias("blocks"))
        a = rows.join(sizes, "g").select("g", F.pmod(F.xxhash64("p", F.lit(2)), F.col("blocks")).cast("int").alias("s"), F.lit(1).alias("side"), "p", "x", "radius")
        b = pivots.join(sizes, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("s"), F.lit(0).alias("side"), F.col("cell").alias("p"), "x", F.col("reach").alias("radius"))
        return each_group(a.unionByName(b), ["g", "s"], f, schema, ("side", "p"))

    def visits(self, rows: DataFrame) -> DataFrame:
        """p and the other cells that may hold something within radius of it. rows: p, g, x, radius."""
        pivots = self.pivots.join(self.cells.select("cell", "reach"), "cell")
        found = self.meet(rows.select("p", "g", "x", "radius"), pivots, _reached, "p long, cell long")
        return found.join(self.rows.select("p", F.col("cell").alias("own")), "p").where("cell <> own").select("p", "cell")


def _split(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k = int((t["side"].to_numpy() == 0).sum())
    x, p, r = matrix(t, "x"), t["p"].to_numpy(), t["radius"].to_numpy()
    return x[:k], p[:k], r[:k], x[k:], p[k:], r[k:]


def _nearest(t: pa.Table) -> pa.RecordBatch:
    pivots, cell, _, x, p, _ = _split(t)
    at, away = np.zeros(len(x), int), np.zeros(len(x))
    for s in range(0, len(x), 1024):
        d = squares(x[s : s + 1024], pivots)
        at[s : s + 1024], away[s : s + 1024] = d.argmin(1), np.sqrt(d.min(1))
    return batch("p long, cell long, away double", p, cell[at], away)


def _reached(t: pa.Table) -> pa.RecordBatch:
    pivots, cell, reach, x, p, radius = _split(t)
    out = []
    for s in range(0, len(x), 1024):
        i, j = np.nonzero(np.sqrt(squares(x[s : s + 1024], pivots)) <= radius[s : s + 1024, None] + reach[None] + SLACK)
        out.append((p[s + i], cell[j]))
    return batch("p long, cell long", *(np.concatenate([o[k] for o in out]) for k in (0, 1)))


# --- k-th neighbour -----------------------------------------------------------------------------------

NEAR = "p long, d double"


def _least(d: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least finite distances of each row of d."""
    k = min(k, d.shape[1])
    low = np.partition(d, k - 1, axis=1)[:, :k] if k else d[:, :0]
    row, col = np.nonzero(np.isfinite(low))
    return p[row], low[row, col]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip(1 - a @ b.T, 0, 2)


class Neighbours:
    """Cosine distance of every row to its k-th nearest other row of the group, for rows with p, g, vec_id, x and sq (x.x)."""

    def __init__(self, points: DataFrame, k: int):
        self.k = k
        self.space = Cells(points)

    @cached_property
    def inside(self) -> DataFrame:
        """The k nearest of each row in its own cell."""
        k = self.k

        def near(t: pa.Table) -> pa.RecordBatch:
            x, p, c = matrix(t, "x"), t["p"].to_numpy(), t["c"].to_numpy()
            i, j = t["i"][0].as_py(), t["j"][0].as_py()
            a, b = np.flatnonzero(c == i), np.flatnonzero(c == j)
            d = cosine(x[a], x[b])
            if i == j:
                np.fill_diagonal(d, np.inf)
                return batch(NEAR, *_least(d, p[a], k))
            one, two = _least(d, p[a], k), _least(d.T, p[b], k)
            return batch(NEAR, *(np.concatenate(z) for z in zip(one, two, strict=True)))

        rows = self.space.rows.join(self.space.cells.select("cell", "members"), "cell").select("cell", "p", "x", "members")
        return written(each_group(block_pairs(rows, F.col("p"), F.ceil(F.col("members") / BLOCK)), ["cell", "i", "j"], near, NEAR), "inside")

    @cached_property
    def visits(self) -> DataFrame:
        """p and the cells beyond its own in which one of its k nearest may be."""
        bound = kth(self.inside, self.k).withColumnRenamed("d", "bound")
        rows = self.space.points.join(bound, "p", "left").join(self.space.sizes.select("g", "most"), "g")
        # 1 - x.y <= bound holds only where |x - y|^2 <= |x|^2 + |y|^2 - 2 + 2 * bound
        far = F.sqrt(F.greatest(F.lit(0.0), F.col("sq") + F.col("most") - 2 + 2 * F.col("bound")))
        return written(self.space.visits(rows.withColumn("radius", F.when(F.col("bound").isNull(), float("inf")).otherwise(far))), "visits")

    @cached_property
    def outside(self) -> DataFrame:
        """The k nearest of each row in each cell that it visits."""
        k = self.k

        def near(t: pa.Table) -> pa.RecordBatch | None:
            members, _, _, x, p, _ = _split(t)
            return batch(NEAR, *_least(cosine(x, members), p, k)) if len(members) and len(x) else None

        cells = self.space.cells.join(self.visits.groupBy("cell").agg(F.count("*").alias("visitors")), "cell").select("cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("b"), F.ceil(F.col("visitors") / BLOCK).cast("int").alias("v"))
        parts = []
        for side, rows, own, other in ((0, self.space.rows.select("cell", "p", "x"), "b", "v"), (1, self.visits.join(self.space.points.select("p", "x"), "p"), "v", "b")):
            r = rows.join(cells, "cell").withColumn(f"at_{own}", F.pmod(F.xxhash64("p"), F.col(own)).cast("int")).withColumn(f"at_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            parts.append(r.select("cell", "at_b", "at_v", F.lit(side).alias("side"), "p", "x", F.lit(0.0).alias("radius")))
        return each_group(parts[0].unionByName(parts[1]), ["cell", "at_b", "at_v"], near, NEAR, ("side", "p"))

    def distances(self) -> DataFrame:
        return kth(self.inside.unionByName(self.outside), self.k)

    def work(self) -> DataFrame:
        """computed and whole: pairs whose distance is computed, and pairs of rows of a group."""
        inside = self.space.cells.agg(F.sum(F.col("members") * (F.col("members") - 1)).alias("a"))
        outside = self.visits.join(self.space.cells, "cell").agg(F.coalesce(F.sum("members"), F.lit(0)).alias("b"))
        whole = self.space.sizes.agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("whole"))
        return inside.crossJoin(outside).crossJoin(whole).select((F.col("a") + F.col("b")).alias("computed"), "whole")  # one row each


def kth(near: DataFrame, k: int) -> DataFrame:
    """The k-th least distance of each p; a p with fewer has none."""
    return near.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("d"))).where(F.col("r") == k).select("p", "d")


def numbered(rows: DataFrame, by: str, scaled: bool) -> DataFrame:
    """Rows with a vector as p, g (the group as text), the group, vec_id, x and sq; scaled: to length one, without zero vectors."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    out = rows.where("embedding IS NOT NULL").select(F.col(by).alias("by"), "vec_id", x.alias("x"))
    out = out.withColumn("sq", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    if scaled:
        out = out.where(F.col("sq") > 1e-18).withColumn("x", F.transform("x", lambda v: v / F.sqrt("sq"))).withColumn("sq", F.lit(1.0))
    return written(out.withColumn("g", F.coalesce(F.col("by").cast("string"), F.lit("\0"))).withColumn("p", F.monotonically_increasing_id()), "points")


def neighbour_distance(points: DataFrame, by: str, k: int = 3) -> DataFrame:
    """Cosine distance (1 - x.y, of vectors of length one) of every row to its k-th nearest other row of the group: ``by``, vec_id, d. Rows without a vector or group, and those of groups of at most k rows, have none."""
    own = numbered(points.where(F.col(by).isNotNull()), by, False)
    return Neighbours(own, k).distances().join(own, "p").select(F.col("by").alias(by), "vec_id", "d")


# --- nearest centre -----------------------------------------------------------------------------------


def nearest_centre(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """vec_id, nearest and distance (1 - x.y to nine places; the lesser label among equal ones) of rows(vec_id, embedding) to centres(label, centroid).

    Blocks of rows meet blocks of centres, so neither has to fit anywhere. Rows without a vector are left out.
    """
    kind = centres.schema["label"].dataType.simpleString()
    own = numbered(rows.withColumn("by", F.lit(0)), "by", False).select("p", "vec_id", "x")
    mine = written(centres.where("centroid IS NOT NULL").select("label", F.transform("centroid", lambda v: v.cast("double")).alias("x")), "centres")
    n, m = -(-own.count() // MEET) or 1, -(-mine.count() // BLOCK) or 1
    a = own.select(F.pmod(F.xxhash64("p"), F.lit(n)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("label"), "p", "x")
    b = mine.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.pmod(F.xxhash64("label"), F.lit(m)).cast("int").alias("j"), F.lit(0).alias("side"), "label", F.lit(None).cast("long").alias("p"), "x")

    def near(t: pa.Table) -> pa.RecordBatch | None:
        k = int((t["side"].to_numpy() == 0).sum())
        if not 0 < k < t.num_rows:
            return None
        x = matrix(t, "x")
        d = np.concatenate([np.round(1 - x[s : s + 1024] @ x[:k].T, 9) for s in range(k, len(x), 1024)])
        at = d.argmin(1)
        return pa.RecordBatch.from_arrays([t["p"].combine_chunks()[k:], t["label"].combine_chunks().take(pa.array(at)), pa.array(d.min(1))], ["p", "label", "d"])

    found = each_group(a.unionByName(b), ["i", "j"], near, f"p long, label {kind}, d double", ("side", "label"))
    best = found.groupBy("p").agg(F.min(F.struct("d", "label")).alias("best"))
    return own.join(best, "p").select("vec_id", F.col("best.label").alias("nearest"), F.col("best.d").alias("distance"))


# --- density clusters ------------------------------------------------------------------------------------


LAYOUT = "g string, cell long, i long, j long"


def _layout(t: pa.Table, far: float, block: int) -> pa.RecordBatch:
    """Blocks of a group's cells, and pairs of blocks that may hold rows within far of each other.

    With a cell: its first block and their number. Without: a pair of blocks. Cells follow each other by nearness and share blocks
    of about ``block`` rows; a larger cell is dealt over blocks of its own.
    """
    x, cell, reach, members = matrix(t, "x"), t["cell"].to_numpy(), t["reach"].to_numpy(), t["members"].to_numpy()
    n, at = len(cell), 0
    left, chain = np.ones(n, bool), [0]
    for _ in range(n - 1):
        left[at] = False
        at = int(np.where(left, squares(x[at : at + 1], x)[0], np.inf).argmin())
        chain.append(at)
    first, parts = np.zeros(n, np.int64), np.maximum(1, -(-members // block)).astype(np.int64)
    k, held = -1, block
    for c in chain:
        alone = parts[c] > 1
        if alone or held >= block:
            k, held = k + 1, 0
        first[c] = k
        k, held = (k + int(parts[c]) - 1, block) if alone else (k, held + int(members[c]))
    near = np.zeros((k + 1, k + 1), bool)
    for c in range(n):
        own = slice(first[c], first[c] + parts[c])
        for o in np.flatnonzero(np.sqrt(squares(x[c : c + 1], x)[0]) <= reach[c] + reach + far + SLACK):
            near[own, first[o] : first[o] + parts[o]] = True
    near |= near.T | np.eye(k + 1, dtype=bool)
    i, j = np.nonzero(np.triu(near))
    g = pa.array([t["g"][0].as_py()] * (n + len(i)))
    return pa.RecordBatch.from_arrays([g, pa.array(cell.tolist() + [None] * len(i), pa.int64()), pa.array(np.concatenate([first, i])), pa.array(np.concatenate([parts, j]))], ["g", "cell", "i", "j"])


def density_clusters(points: DataFrame, by: str, eps: float, min_samples: int) -> DataFrame:
    """Group, vec_id and cluster of density clusters by cosine distance, numbered in each group in the order of their first core rows; noise is -1.

    A row is core with min_samples rows within eps, itself included; core rows within eps are of one
    cluster; another row within eps of core rows goes to the first of their clusters. eps is below
    1. Rows without a vector, or with a zero one, are noise.
    """
    if not 0 <= eps < 1:
        raise ValueError("eps must be at least 0 and below 1")
    own = numbered(points, by, True)
    space = Cells(own)
    layout = written(each_group(space.cells.join(space.pivots.select("cell", "x"), "cell"), ["g"], partial(_layout, far=float(np.sqrt(2 * eps)), block=BLOCK), LAYOUT, ("cell",)), "layout")
    cells = layout.where("cell IS NOT NULL").select("cell", F.col("i").alias("first"), F.col("j").alias("parts"))
    pairs = layout.where("cell IS NULL").select("g", "i", "j")
    ends = pairs.select("g", F.col("i").alias("c"), "i", "j").union(pairs.where("i < j").select("g", F.col("j").alias("c"), "i", "j"))
    dealt = space.rows.join(cells, "cell").select("p", "g", "x", (F.col("first") + F.pmod(F.xxhash64("p"), F.col("parts"))).alias("c"))
    unit = ["g", "i", "j"]

    def sides(t: pa.Table):
        x, p, c = matrix(t, "x"), t["p"].to_numpy(), t["c"].to_numpy()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        a, b = np.flatnonzero(c == i), np.flatnonzero(c == j)
        near = np.clip(1 - x[a] @ x[b].T, 0, 2) <= eps
        return p, ((a, b, near),) if i == j else ((a, b, near), (b, a, near.T))

    def count(t: pa.Table) -> pa.RecordBatch:
        p, both = sides(t)
        got = [(p[a], near.sum(1)) for a, _, near in both]
        return batch("p long, n long", *(np.concatenate([g[k] for g in got]) for k in (0, 1)))

    counts = each_group(dealt.join(ends, ["g", "c"]), unit, count, "p long, n long")
    core = written(counts.groupBy("p").agg((F.sum("n") >= min_samples).alias("core")), "core")

    def tie(t: pa.Table) -> pa.RecordBatch:
        """Core neighbours of every row: one of each local component."""
        p, both = sides(t)
        is_core = t["core"].to_numpy(zero_copy_only=False)
        root = np.arange(len(p))
        for a, b, near in both[:1]:
            m = near[np.ix_(is_core[a], is_core[b])]
            ca, cb = a[is_core[a]], b[is_core[b]]
            moved = True
            while moved and m.size:
                low = np.where(m, root[cb][None], len(p)).min(1)
                new = np.minimum(root[ca], low)
                back = np.where(m, new[:, None], len(p)).min(0)
                newer = np.minimum(root[cb], back)
                moved = bool((new < root[ca]).any() or (newer < root[cb]).any())
                root[ca] = np.minimum(root[ca], new)
                root[cb] = np.minimum(root[cb], newer)
        tied = np.flatnonzero(root != np.arange(len(p)))
        out = [(p[tied], p[root[tied]], np.ones(len(tied), bool))]
        for a, b, near in both:
            fringe = np.flatnonzero(~is_core[a])
            q, r = np.nonzero(near[fringe][:, is_core[b]])
            pairs = np.unique(np.stack([a[fringe[q]], root[b[is_core[b]][r]]], 1), axis=0)
            out.append((p[pairs[:, 0]], p[pairs[:, 1]], np.zeros(len(pairs), bool)))
        return batch("a long, b long, core boolean", *(np.concatenate([o[k] for o in out]) for k in range(3)))

    ties = written(each_group(dealt.join(core, "p").join(ends, ["g", "c"]), unit, tie, "a long, b long, core boolean"), "ties")
    roots = components(ties.where("core").select("a", "b"))
    cores = core.where("core").join(own.select("p", "g", "vec_id"), "p").join(roots.withColumnRenamed("node", "p"), "p", "left").select("p", "g", "vec_id", F.coalesce("root", "p").alias("root"))
    first = cores.groupBy("g", "root").agg(F.min(F.struct("vec_id", "p")).alias("first"))
    labels = written(first.withColumn("cluster", F.row_number().over(Window.partitionBy("g").orderBy("first")).cast("long") - 1).select("root", "cluster"), "labels")
    inside = cores.join(labels, "root").select("p", "cluster")
    fringe = ties.where("NOT core").join(cores.select(F.col("p").alias("b"), "root"), "b").join(labels, "root").groupBy(F.col("a").alias("p")).agg(F.min("cluster").alias("cluster"))
    found = own.join(inside.unionByName(fringe), "p", "left").select(F.col("by").alias(by), "vec_id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))
    zero = ~F.coalesce(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) > 1e-18, F.lit(False))
    return found.unionByName(points.where(zero).select(by, "vec_id", F.lit(-1).cast("long").alias("cluster")))
