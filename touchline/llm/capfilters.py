"""Near-duplicate vectors of one label by spherical-cap filters.

A filter is a direction; a vector falls into all filters whose directions exceed a
threshold in inner product with it, and two vectors meet where a filter holds
both. Directions are those of a random product code: a random rotation cuts the
space into blocks, each block has ``WORDS`` random unit codewords, and a direction
is any choice of one codeword a block. So there are WORDS ** blocks of them, and
the ones that exceed the threshold are decoded as a list block by block, leaving
partial sums that cannot reach it any more (``Code.decode``).

The measure of a cap gives the threshold at which a vector has ``LIST`` filters on
average, over ``TURNS`` independent rotations. The number of blocks grows with
the number of vectors, so a filter holds about as many unrelated vectors at every
size. A vector with few filters in a rotation gets a lower threshold there. Pairs
exactly at the limit of similarity share a filter in all but about one of a thousand
cases or fewer (0 of 6,000 missed with four and with five blocks; a test measures it), nearer pairs more surely.
Filters with a single vector are dropped before vectors move.

Copies of a vector within a label are one point with a weight. Points of a filter
are compared in double precision; a filter of more than ``BLOCK`` points is cut
into blocks that are compared pair by pair of blocks in separate tasks. A pair
counts only in the least filter that both share: points that all have the same
lesser filter are not compared again, and other pairs are looked up. A task
reports counts and a spanning forest, never the pairs.

Cases: a null label, a null, empty or zero vector, and one with null or non-finite
components link with nothing. Vectors of different length never link. Repeated rows
are vectors of their own. A null vec_id keeps its row and is never the least one
unless its component has no other. Extra columns stay out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.components import connected
from touchline.llm.runtime import checkpointed, tidy
from touchline.llm.simhash import Forest
from touchline.llm.textcore import ranges

COSINE = 0.93
#: Codewords a block, rotations, filters a vector on average, and at least.
WORDS, TURNS, LIST, LEAST = 32, 4, 48, 40
#: Directions for each vector, at least.
SPREAD = 16
#: Components of a block at least.
LEAST_WIDTH = 8
#: Points of a filter that are compared in one task.
BLOCK = 2048
#: Lesser filters that are looked up for all pairs of a block at once.
POPULAR = 256


def valid(v: Column) -> Column:
    """Vectors with finite components that are not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def cap(limit: float, dims: int) -> float:
    """Share of the unit sphere whose inner product with a fixed direction is at least limit."""
    if dims < 2:
        return 0.5
    angle = np.linspace(0, np.pi, 40_001)
    density = np.sin(angle) ** (dims - 2)
    below = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return float(np.interp(math.acos(limit), angle, below / below[-1]))


class Code:
    """One rotation and its codewords."""

    def __init__(self, dims: int, blocks: int, turn: int):
        rng = np.random.default_rng([turn, dims, blocks])
        self.blocks = max(1, min(blocks, dims // LEAST_WIDTH))  # narrower blocks would repeat their few directions
        self.width = -(-dims // self.blocks)
        self.size = self.width * self.blocks
        self.rotation = np.linalg.qr(rng.normal(size=(self.size, self.size)))[0][:dims]
        w = rng.normal(size=(self.blocks, WORDS, self.width))
        self.words = w / (np.linalg.norm(w, axis=2, keepdims=True) * math.sqrt(self.blocks))
        low, high, want = 0.0, 1.0, LIST / TURNS / WORDS**self.blocks
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if cap(mid, self.size) > want else (low, mid)
        self.limit = low

    def decode(self, x: np.ndarray, limit: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of every direction that exceeds the limit; rows with fewer than their least number get a lower limit."""
        limit = self.limit if limit is None else limit
        score = np.einsum("nbw,bkw->nbk", (x @ self.rotation).reshape(len(x), self.blocks, self.width), self.words)
        rest = np.cumsum(score.max(2)[:, ::-1], axis=1)[:, ::-1]
        rest = np.concatenate([rest[:, 1:], np.zeros((len(x), 1))], axis=1)
        row, code, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for b in range(self.blocks):
            reach = total[:, None] + score[row, b]
            i, k = np.nonzero(reach >= limit - rest[row, b][:, None])
            row, code, total = row[i], code[i] * WORDS + k, reach[i, k]
        few = np.flatnonzero(np.bincount(row, minlength=len(x)) < min(LEAST // TURNS, WORDS**self.blocks))
        if len(few) and limit > -1.5:
            more_row, more = self.decode(x[few], 0.95 * limit if limit > 0.05 else limit - 0.3)
            stay = ~np.isin(row, few)
            row, code = np.concatenate([row[stay], few[more_row]]), np.concatenate([code[stay], more])
        return row, code


def unit(flat: np.ndarray, dims: int) -> np.ndarray:
    x = flat.reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoded(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[Code]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                size = b["dims"].to_numpy(zero_copy_only=False)
                values = b["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                start = np.cumsum(size) - size
                for dims in np.unique(size).tolist():
                    if dims not in codes:
                        codes[dims] = [Code(dims, blocks, t) for t in range(TURNS)]
                    own = np.flatnonzero(size == dims)
                    x = unit(values[ranges(start[own], size[own])], dims)
                    found = [c.decode(x) for c in codes[dims]]
                    row = np.concatenate([r for r, _ in found])
                    code = np.concatenate([c * TURNS + t for t, (_, c) in enumerate(found)])
                    order = np.argsort(row, kind="stable")
                    ends = np.cumsum(np.bincount(row, minlength=len(own)))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(code[order]))
                    packed = pa.array([r.tobytes() for r in x], pa.binary())
                    take = pa.array(own)
                    yield pa.RecordBatch.from_arrays([b["p"].take(take), b["label"].take(take), b["dims"].take(take), b["n"].take(take), packed, lists], ["p", "label", "dims", "n", "x", "filters"])

    return run


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum((a * b).tolist()) / math.sqrt(math.fsum((a * a).tolist()) * math.fsum((b * b).tolist()))


def links(x: np.ndarray, n: np.ndarray, lists: list[np.ndarray], here: int, side: np.ndarray, i: int, j: int, limit: float = COSINE) -> tuple[np.ndarray, Forest]:
    """Weights of linked points and forest of the links whose least common filter is ``here``, between the points of block i and of block j."""
    size = len(x)
    count, forest = np.zeros(size, np.int64), Forest(size)
    lens = np.array([len(f) for f in lists])
    row, below = np.repeat(np.arange(size), lens), np.concatenate(lists) if size else np.zeros(0, np.int64)
    row, below = row[below < here], below[below < here]
    kinds, column, shared = np.unique(below, return_inverse=True, return_counts=True)
    often = np.argsort(-shared, kind="stable")
    often = often[shared[often] > 1]
    place = np.full(len(kinds), -1)
    place[often] = np.arange(len(often))
    row, column = row[place[column] >= 0], place[column][place[column] >= 0]
    popular = min(POPULAR, len(often))
    held = np.zeros((size, popular), np.float32)
    held[row[column < popular], column[column < popular]] = 1
    # the other shared filters, a padded row a point
    r, c = row[column >= popular], column[column >= popular]
    width = int(np.bincount(r, minlength=1).max()) if len(r) else 0
    rare = np.full((size, width), -1)
    if width:
        first = np.searchsorted(r, np.arange(size))
        rare[r, np.arange(len(r)) - first[r]] = c
    done = held[:, 0] > 0 if popular else np.zeros(size, bool)  # all pairs among these are counted elsewhere
    if done.all():
        return count, forest
    left = np.flatnonzero(side == i)
    right = np.flatnonzero(side == j)
    left, right = left[np.argsort(done[left], kind="stable")], right[np.argsort(done[right], kind="stable")]
    for s in range(0, len(left), 256):
        a = left[s : s + 256]
        for t in range(s if i == j else 0, len(right), 2048):
            b = right[t : t + 2048]
            if done[a].all() and done[b].all():
                continue
            cosine = x[a] @ x[b].T
            near = cosine >= limit
            for p, q in zip(*np.nonzero(np.abs(cosine - limit) < 1e-12), strict=True):
                near[p, q] = exact_cosine(x[a[p]], x[b[q]]) >= limit
            if i == j:
                near &= np.arange(s, s + len(a))[:, None] < np.arange(t, t + len(b))[None, :]
            if popular and near.any():
                near &= held[a] @ held[b].T == 0
            p, q = np.nonzero(near)
            if width and len(p):
                new = np.ones(len(p), bool)
                for u in range(0, len(p), 4096):
                    f, g = rare[a[p[u : u + 4096]]], rare[b[q[u : u + 4096]]]
                    new[u : u + 4096] = ~((f[:, :, None] == g[:, None, :]) & (f[:, :, None] >= 0)).any((1, 2))
                p, q = p[new], q[new]
            if len(p):
                np.add.at(count, a[p], n[b[q]])
                np.add.at(count, b[q], n[a[p]])
                forest.join(a[p], b[q])
    return count, forest


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group (label, dims, f, i, j)."""
    key, held = None, []

    def settle():
        table = pa.Table.from_batches(held)
        p, n, side = (table[c].to_numpy().astype(np.int64) for c in ("p", "n", "c"))
        x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float64).reshape(len(p), -1)
        count, forest = links(x, n, [np.array(f, np.int64) for f in table["live"].to_pylist()], key[2], side, *key[3:])
        seen, tied = np.flatnonzero(count), np.flatnonzero(forest.up != np.arange(len(p)))
        a, b = np.concatenate([p[seen], p[tied]]), np.concatenate([p[seen], p[forest.up[tied]]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([count[seen], np.zeros(len(tied), np.int64)]))], ["a", "b", "n"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b[c] for c in ("g", "dims", "f", "i", "j")]
        new = np.flatnonzero(np.any([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in cols], axis=0)) + 1
        for s, e in zip([0, *new.tolist()], [*new.tolist(), b.num_rows], strict=True):
            this = tuple(c[s].as_py() for c in cols)
            if this != key and held:
                yield settle()
                held = []
            key = this
            held.append(b.slice(s, e - s))
    if held:
        yield settle()


def clusters(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors(vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "label", F.when(valid(F.col("embedding")), F.col("embedding")).alias("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    rows = rows.withColumn("v", F.when(F.col("label").isNotNull(), F.col("v")))
    groups = rows.where("v is not null").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    points = checkpointed(groups.withColumn("p", F.monotonically_increasing_id()))
    blocks = max(2, math.ceil(math.log(SPREAD * max(points.count(), 1), WORDS)))
    wide = points.select("p", F.col("label").cast("string").alias("label"), F.size("v").alias("dims"), "n", "v")
    decoded = checkpointed(wide.mapInArrow(tidy(_decoded(blocks)), "p long, label string, dims int, n long, x binary, filters array<long>"))
    keys = decoded.select("p", "label", "dims", F.explode("filters").alias("f"))
    sizes = keys.groupBy("label", "dims", "f").agg(F.count("*").alias("size")).where("size > 1")
    live = keys.join(sizes, ["label", "dims", "f"]).groupBy("p").agg(F.sort_array(F.collect_list(F.struct("f", "size"))).alias("at"))
    near = decoded.select("p", F.col("label").alias("g"), "dims", "n", "x").join(live, "p").withColumn("live", F.col("at.f")).withColumn("at", F.explode("at"))
    cut = F.ceil(F.col("at.size") / BLOCK).cast("int")
    near = near.select("p", "g", "dims", "n", "x", "live", F.col("at.f").alias("f"), F.pmod(F.xxhash64("p"), cut).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), cut - 1)).alias("o"))
    near = near.select("p", "g", "dims", "n", "x", "live", "f", "c", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    group = ["g", "dims", "f", "i", "j"]
    found = checkpointed(near.repartition(*group).sortWithinPartitions(*group).mapInArrow(tidy(_compared), "a long, b long, n long"))
    degree = found.where("n > 0").groupBy(F.col("a").alias("p")).agg(F.sum("n").alias("others"))
    labels = connected(found.where("n = 0").select("a", "b"))
    own = points.join(degree, "p", "left").join(labels.withColumnRenamed("node", "p").withColumnRenamed("label", "root"), "p", "left").withColumn("root", F.coalesce("root", "p"))
    least = own.groupBy("root").agg(F.min("least").alias("component"))
    known = own.join(least, "root").select(F.col("label").alias("own_label"), F.col("v").alias("own_v"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component")
    out = rows.join(known, (F.col("label") == F.col("own_label")) & (F.col("v") == F.col("own_v")), "left")
    component = F.when(F.col("own_v").isNull(), F.col("vec_id")).otherwise(F.col("component")).cast(kind)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
