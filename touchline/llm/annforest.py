"""Approximate nearest neighbours by a forest of hash-prefix trees.

Each of ``TREES`` trees gives every vector a string of ``SYMBOLS`` symbols and
keeps the vectors in the sorted order of their strings. A symbol is the axis, of
a group of axes of a random rotation, to which the vector lies nearest (which
coordinate is largest, and its sign); near vectors share symbols more often than
by single bits. A query descends by binary search to the longest prefix that it
shares with stored strings, and the trees ascend together, symbol by symbol and
tree by tree, until they offer as many candidates as wanted. So the prefix at
which a query stops depends on how dense its surroundings are. Only the
candidates are scored, by inner products in double precision.

How many candidates are wanted is measured: the first ``PILOT`` queries of a shard
are compared with all its rows, and the number is taken that finds ``TARGET`` of
their true neighbours. ``Stats`` of a search say what share of the rows was scored.

Rows are dealt to shards of about ``SHARD_ROWS`` vectors by a hash; every shard
holds the sorted arrays of its own rows, which therefore never move again, and
the stated queries stream past it in blocks. A query's best of all shards meet in
one sort. What a task holds is a shard, whatever the size of the table.

Equal vectors are one entry with its ``K`` + 1 least ids: of more copies no other
can be among K results. Vectors that are null, zero, or hold null or non-finite
components take no part, as query or candidate; nor do vectors of another length
than the most common one. Repeated vec_ids count once per vector. Fewer than K
candidates are all returned: an ascent with under ``LEAST`` different ones goes on to the root.
Ties go to the smaller vec_id, however many vectors tie. Extra columns stay out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.runtime import checkpointed, tidy

TREES = 64
SYMBOLS = 6
#: Axes of one symbol.
GROUP = 16
K = 20
EVERY = 20
#: Different candidates that a query is offered at the least.
LEAST = 10 * K
PILOT = 64
TARGET = 0.95
SHARD_ROWS = 1 << 14
#: Queries whose ranges are looked up at once.
BLOCK = 256


def axes(dim: int) -> np.ndarray:
    """Axes of all symbols of all trees, one random rotation after another."""
    rng, sets, want = np.random.default_rng(7), [], TREES * SYMBOLS * min(GROUP, dim)
    while sum(s.shape[1] for s in sets) < want:
        sets.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0])
    return np.concatenate(sets, 1)[:, :want].astype(np.float32)


def strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The hash string of every vector in every tree, as a number with the first symbol on top."""
    out = np.empty((len(x), TREES), np.int64)
    group = min(GROUP, x.shape[1])
    bits = symbol_bits(x.shape[1])
    for a in range(0, len(x), 1024):
        y = (x[a : a + 1024].astype(np.float32) @ planes).reshape(-1, TREES, SYMBOLS, group)
        top = np.abs(y).argmax(3)
        sign = np.take_along_axis(y, top[..., None], 3)[..., 0] > 0
        out[a : a + 1024] = (top * 2 + sign) @ (1 << bits * np.arange(SYMBOLS - 1, -1, -1, dtype=np.int64))
    return out


def symbol_bits(dim: int) -> int:
    return (2 * min(GROUP, dim) - 1).bit_length()


class Forest:
    """The sorted arrays of a shard."""

    def __init__(self, x: np.ndarray):
        self.x, self.bits = x, symbol_bits(x.shape[1])
        self.planes = axes(x.shape[1])
        self.h = strings(x, self.planes)
        self.order = np.argsort(self.h, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(self.h.T, self.order.astype(np.int64), 1)

    def ranges(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end place, in each tree, of the strings that share 0..SYMBOLS symbols with each query string."""
        lo = np.empty((len(h), TREES, SYMBOLS + 1), np.int32)
        hi = lo.copy()
        for s in range(SYMBOLS + 1):
            shift = self.bits * (SYMBOLS - s)
            p = h >> shift
            for t in range(TREES):
                lo[:, t, s] = np.searchsorted(self.sorted[t], p[:, t] << shift)
                hi[:, t, s] = np.searchsorted(self.sorted[t], p[:, t] + 1 << shift)
        return lo, hi

    @staticmethod
    def offered(count: np.ndarray) -> np.ndarray:
        """Candidates offered after each step of the common ascent: level SYMBOLS first, tree by tree within a level."""
        deeper = np.concatenate([count[:, :, 1:], np.zeros_like(count[:, :, :1])], 2)
        steps = deeper.sum(1, keepdims=True) + np.cumsum(count - deeper, 1)  # query, tree, level
        return steps[:, :, ::-1].transpose(0, 2, 1).reshape(len(count), -1)

    def wanted(self, q: np.ndarray, k: int) -> int:
        """How many candidates must be offered to find TARGET of the k true neighbours of these queries."""
        h = strings(q, self.planes)
        lo, hi = self.ranges(h)
        steps = self.offered((hi - lo).astype(np.int64))
        need = []
        for i in range(len(q)):
            near = np.argsort(-(self.x @ q[i]), kind="stable")[: k + 1]
            for r in near:
                level = np.zeros(TREES, np.int64)
                for s in range(1, SYMBOLS + 1):
                    shift = self.bits * (SYMBOLS - s)
                    level += h[i] >> shift == self.h[r] >> shift
                tree = int(level.argmax())
                need.append(steps[i, (SYMBOLS - level[tree]) * TREES + tree])
        return int(np.quantile(need, TARGET, method="higher"))

    def candidates(self, q: np.ndarray, want: int) -> Iterator[np.ndarray]:
        """Rows that the ascent offers to each query: as many as wanted, and LEAST different ones at the least (or all)."""
        least = min(LEAST, len(self.x))
        mark = np.zeros(len(self.x), bool)
        for a in range(0, len(q), BLOCK):
            lo, hi = self.ranges(strings(q[a : a + BLOCK], self.planes))
            steps = self.offered((hi - lo).astype(np.int64))
            stop = np.where(steps[:, -1] > want, (steps >= want).argmax(1), steps.shape[1] - 1)
            for i, at in enumerate(stop.tolist()):
                while True:
                    level, tree = SYMBOLS - at // TREES, at % TREES
                    for t in range(TREES):
                        s = level + (t > tree)
                        if s <= SYMBOLS:
                            mark[self.order[t, lo[i, t, s] : hi[i, t, s]]] = True
                    found = np.flatnonzero(mark)
                    mark[found] = False
                    if len(found) >= least:
                        break
                    at = min(at + TREES // 8, steps.shape[1] - 1)
                yield found


def nearest(x: np.ndarray, least_id: np.ndarray, rows: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The K + 1 best of the rows, by falling score and then the least id, with scores summed component by component."""
    near = x[rows] @ q
    if len(rows) > K + 1:
        edge = -np.partition(-near, K)[K]
        rows = rows[near >= edge - 1e-12 * max(1.0, abs(edge))]  # whatever ties with the last place stays
    score = np.zeros(len(rows))
    for j in range(x.shape[1]):
        score += x[rows, j] * q[j]
    best = np.lexsort((least_id[rows], -score))[: K + 1]
    return rows[best], score[best]


def matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """key (of the vector), vec, ids (the K + 1 least). One row per distinct usable vector."""
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = element if element in ("float", "double") else "double"
    # minus zero equals zero
    vec = F.transform(F.col("embedding"), lambda x: (x.cast(kind) + F.lit(0).cast(kind)).cast(kind))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec").isNotNull() & F.col("vec_id").isNotNull()).where(fine)
    rows = rows.withColumn("dim", F.size("vec"))
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    rows = rows.where(F.col("dim") == (dims[0]["dim"] if dims else 0)).drop("dim").withColumn("key", F.xxhash64("vec"))
    # ids are folded in two steps, so a vector with very many copies never meets in one list
    rows = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    rows = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("key", "part").orderBy("vec_id"))).where(F.col("r") <= K + 1)
    return rows.groupBy("key").agg(F.first("vec").alias("vec"), F.slice(F.array_sort(F.collect_set("vec_id")), 1, K + 1).alias("ids"))


FOUND = "qkey long, ids array<long>, score double, shard int, scored long"


def _search(k: int):
    """Rows come sorted by shard, stored vectors before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, forest, want = None, [], None, 0

        def answer(asks: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal forest, want, held
            q, qkey = matrix(asks["vec"]), asks["key"].to_numpy()
            if forest is None:
                stored = pa.Table.from_batches(held).combine_chunks()
                forest, held = Forest(matrix(stored["vec"])), [stored]
                want = forest.wanted(q[:PILOT], k)
            ids = held[0]["ids"].combine_chunks()
            least = np.asarray(ids.values)[np.asarray(ids.offsets)[:-1]]
            out: list[list] = [[], [], [], []]
            for i, rows in enumerate(forest.candidates(q, want)):
                best, score = nearest(forest.x, least, rows, q[i])
                for c, v in zip(out, (np.full(len(best), qkey[i]), best, score, np.full(len(best), len(rows))), strict=True):
                    c.append(v)
            if out[0]:
                qk, best, score, scored = (np.concatenate(c) for c in out)
                yield pa.RecordBatch.from_arrays([pa.array(qk), ids.take(pa.array(best)), pa.array(score), pa.array(np.full(len(qk), shard, np.int32)), pa.array(scored)], ["qkey", "ids", "score", "shard", "scored"])

        for b in batches:
            if not b.num_rows:
                continue
            place = np.stack([b["shard"].to_numpy(), b["query"].to_numpy(zero_copy_only=False)], 1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if place[x, 0] != shard:
                    shard, held, forest = place[x, 0], [], None
                if not place[x, 1]:
                    held.append(b.slice(x, y - x))
                elif held:
                    yield from answer(b.slice(x, y - x))

    return run


def found(rows: DataFrame, shards: int) -> DataFrame:
    """FOUND: the best entries of each shard for each vector that asks. rows: key, vec, ids, asks."""
    stored = rows.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"), "key", "vec", "ids")
    asks = rows.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"), "key", "vec", F.array().cast("array<long>").alias("ids"))
    dealt = stored.unionByName(asks).repartition(shards, "shard").sortWithinPartitions("shard", "query", "key")
    # of the K nearest a shard holds a binomial number: its mean and two deviations
    k = min(K, math.ceil(K / shards + 2 * math.sqrt(K / shards * (1 - 1 / shards))))
    return dealt.mapInArrow(tidy(_search(k)), FOUND)


def prepared(vectors: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Distinct vectors (key, vec, ids, asks), the queries (query_id, qkey) and the number of shards."""
    rows = checkpointed(usable(vectors))
    ids = vectors.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("vec"))
    kind = rows.schema["vec"].dataType.elementType.simpleString()
    key = F.xxhash64(F.transform("vec", lambda x: (x.cast(kind) + F.lit(0).cast(kind)).cast(kind)))
    ask = ids.where(F.col("vec").isNotNull()).select("query_id", key.alias("qkey")).distinct()
    rows = rows.join(ask.select(F.col("qkey").alias("key"), F.lit(True).alias("a")).distinct(), "key", "left").select("key", "vec", "ids", F.coalesce("a", F.lit(False)).alias("asks"))
    return rows, ask, max(1, math.ceil(rows.count() / SHARD_ROWS))


def search(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score for every vec_id divisible by EVERY."""
    rows, ask, shards = prepared(vectors)
    best = found(rows, shards).select("qkey", F.explode("ids").alias("vec_id"), "score")
    out = best.join(ask, "qkey").where("vec_id <> query_id").select("query_id", "vec_id", "score").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def stats(vectors: DataFrame) -> DataFrame:
    """One row: queries, shards, and the mean share of the distinct vectors that a query scored."""
    rows, _, shards = prepared(vectors)
    per = found(rows, shards).select("qkey", "shard", "scored").distinct().groupBy("qkey").agg(F.sum("scored").alias("scored"))
    n = rows.count()
    return per.agg(F.count("*").alias("queries"), F.lit(shards).alias("shards"), (F.avg("scored") / max(1, n)).alias("share"))
