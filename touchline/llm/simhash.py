"""Near duplicates by SimHash fingerprints, linked exactly with vantage-point trees.

Fingerprints within ``RADIUS`` = 4 of 64 bits differ by at most one bit in one of
three bit ranges (21, 21 and 22 bits), for four differing bits cannot put two
into each. Each range with its own Hamming distance is a metric space with a
search radius of one, where the triangle bound prunes well: points whose
distances to a vantage point differ by more than one cannot be neighbours.

Shards are the cells of the top levels of such a tree: per level a fixed vantage
point and rings of three distances. A fingerprint on a ring's outer edge also
goes to the next ring, so any two neighbours meet in some shard. Inside a shard
the tree goes on with vantage points from the data; small cells are compared in
full. A shard reports a spanning forest of its links, never all pairs, and a
shard of more than ``SHARD_ROWS`` rows is cut into blocks that are compared pair
by pair of blocks in separate tasks.

Equal fingerprints are one point from the start, so copies cost nothing.

Cases: null and empty texts and those without words have fingerprint zero and
link as any other. Repeated rows get a row each. A null doc_id keeps its row and
never is the least one unless its group has no other. Extra columns stay out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.components import connected
from touchline.llm.runtime import checkpointed, text_key, tidy
from touchline.llm.textcore import LOWER, SPACE, U, chunks, ranges, word_spans

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Bit ranges, low bit and width; RADIUS // len(RANGES) is the search radius within one.
RANGES = ((0, 21), (21, 21), (42, 22))
RING = 3
SHARD_ROWS = 20_000
#: Shards over SHARD_ROWS (12 bytes each) up to which their list is broadcast.
BROADCAST_SHARDS = 100_000
#: Most levels whose cells a long can number: enough for 7e11 fingerprints.
LEVELS = 18
#: A shard's usual size at which no further level of vantage points is added.
SHARD_GOAL = 2000
LEAF = 192


def fingerprints(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of every row: majority of each bit over XXH64 of its word shingles."""
    import xxhash

    n = len(offs) - 1
    out = np.zeros(n, U)
    lo, hi, doc = word_spans(data, offs)
    if not len(lo):
        return out
    # words of a row joined by one space: the first white byte after a word stays
    keep = ~SPACE[data]
    keep[1:] |= keep[:-1]
    buf = np.where(SPACE[data], np.uint8(32), LOWER[data])[keep].tobytes()
    at = np.cumsum(keep) - 1
    lo, hi = at[lo], at[hi - 1] + 1
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    # shingle of words i .. i+k-1; fewer words: one shingle of all
    size = np.where(count > 0, np.maximum(count - shingle + 1, 1), 0)
    a = ranges(first, size)
    b = np.minimum(a + shingle - 1, np.repeat(first + count - 1, size))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(buf[x:y], SEED) for x, y in zip(lo[a].tolist(), hi[b].tolist(), strict=True)), U, len(a))
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    have = np.flatnonzero(size)
    ends = np.cumsum(size[have])
    sums = np.empty((len(have), 64), np.int64)
    for k, (x, y) in enumerate(zip(ends - size[have], ends, strict=True)):
        sums[k] = bits[x:y].sum(0, dtype=np.int32)
    major = 2 * sums > size[have][:, None]
    out[have] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = np.zeros(b.num_rows, U)
        for i, j, data, offs in chunks(b["text"], 1 << 20):
            f[i:j] = fingerprints(data, offs)
        keep = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(f.view(np.int64))], [*keep, "fingerprint"])


def part(f: np.ndarray, k: int) -> np.ndarray:
    low, width = RANGES[k]
    return f >> U(low) & U((1 << width) - 1)


def vantage(levels: int) -> np.ndarray:
    """Fixed vantage points of the top levels, one a level and range."""
    return np.random.default_rng(5).integers(0, 1 << 21, (levels, len(RANGES)), dtype=np.uint64)


def shards(f: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of every copy of the fingerprints."""
    rows, keys = [], []
    points = vantage(levels)
    for k in range(len(RANGES)):
        row, key = np.arange(len(f)), np.zeros(len(f), np.int64)
        x = part(f, k)
        for v in points[:, k]:
            d = np.bitwise_count(x[row] ^ v).astype(np.int64)
            ring, edge = d // RING, np.flatnonzero(d % RING == RING - 1)
            key = np.concatenate([key * 9 + ring, key[edge] * 9 + ring[edge] + 1])
            row = np.concatenate([row, row[edge]])
        rows.append(row)
        keys.append(key * 4 + k)
    return np.concatenate(rows), np.concatenate(keys)


class Forest:
    """Links of one shard, kept as the least index of each group."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up
        while True:
            x, y = up[a], up[b]
            m = x != y
            if not m.any():
                return
            a, b = a[m], b[m]
            np.minimum.at(up, np.maximum(x[m], y[m]), np.minimum(x[m], y[m]))
            while True:
                nxt = up[up]
                if (nxt == up).all():
                    break
                up[:] = nxt


def compare(f: np.ndarray, a: np.ndarray, b: np.ndarray, forest: Forest, block: int = 512) -> None:
    """All of a against all of b, a block at a time."""
    for i in range(0, len(a), block):
        x = a[i : i + block]
        for j in range(0, len(b), 4 * block):
            y = b[j : j + 4 * block]
            p, q = np.nonzero(np.bitwise_count(f[x][:, None] ^ f[y][None, :]) <= RADIUS)
            if len(p):
                forest.join(x[p], y[q])


def tree(f: np.ndarray, ids: np.ndarray, k: int, forest: Forest, depth: int = 0) -> None:
    """Splits ids by rings around a vantage point of their own until the cells are small, then compares those in full."""
    if len(ids) <= LEAF or depth > 40:
        return compare(f, ids, ids, forest)
    x = part(f[ids], k)
    d = np.bitwise_count(x ^ x[depth * 7919 % len(ids)]).astype(np.int64)
    ring = d // RING
    edge = d % RING == RING - 1
    cells = [np.flatnonzero((ring == r) | (edge & (ring == r - 1))) for r in range(int(ring.max()) + 2)]
    cells = [c for c in cells if len(c) > 1]
    if max(map(len, cells), default=0) > 0.95 * len(ids):
        # a ball of radius RING around the vantage point, or equal parts: nothing to prune by this point
        far = int(d.argmax())
        d2 = np.bitwise_count(x ^ x[far]).astype(np.int64)
        ring, edge = d2 // RING, d2 % RING == RING - 1
        cells = [np.flatnonzero((ring == r) | (edge & (ring == r - 1))) for r in range(int(ring.max()) + 2)]
        cells = [c for c in cells if len(c) > 1]
        if max(map(len, cells), default=0) > 0.95 * len(ids):
            return compare(f, ids, ids, forest)
    for c in cells:
        tree(f, ids[c], k, forest, depth + 1)
    return None


def _copies(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b["fp"].to_numpy(zero_copy_only=False).astype(np.int64).view(U)
            for i in range(0, len(f), 1 << 15):
                row, key = shards(f[i : i + (1 << 15)], levels)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(f[i + row].view(np.int64))], ["shard", "fp"])

    return run


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, i, j): yields the spanning forest of each group."""

    def links(key, fps: np.ndarray, side: np.ndarray):
        f = fps.view(U)
        forest = Forest(len(f))
        shard, i, j = key
        k = shard & 3  # the bit range
        if i == j:
            tree(f, np.arange(len(f)), k, forest)
        else:
            compare(f, np.flatnonzero(side == i), np.flatnonzero(side == j), forest)
        at = np.flatnonzero(forest.up != np.arange(len(f)))
        return pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(fps[forest.up[at]])], ["a", "b"])

    key, fps, side = None, [], []
    for b in batches:
        s, i, j, f, c = (b[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in ("shard", "i", "j", "fp", "c"))
        if not len(s):
            continue
        new = np.flatnonzero((s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        cuts = [0, *new.tolist(), len(s)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            this = (int(s[x]), int(i[x]), int(j[x]))
            if this != key and fps:
                yield links(key, np.concatenate(fps), np.concatenate(side))
                fps, side = [], []
            key = this
            fps.append(f[x:y])
            side.append(c[x:y])
    if fps:
        yield links(key, np.concatenate(fps), np.concatenate(side))


def link(points: DataFrame, n: int) -> DataFrame:
    """Spanning forests (a, b) over the distinct fingerprints in points(fp)."""
    levels = min(LEVELS, max(1, math.ceil(math.log(max(n, 1) / SHARD_GOAL + 1, 3))))
    rows = points.mapInArrow(tidy(_copies(levels)), "shard long, fp long")
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ROWS)
    big = checkpointed(sizes.select(F.col("shard").alias("big"), F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("blocks")))
    few = big.count() <= BROADCAST_SHARDS  # else both sides are shuffled
    rows = rows.join(F.broadcast(big) if few else big, F.col("shard") == F.col("big"), "left")
    c = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks")), F.lit(0)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
    rows = rows.select("shard", "fp", c.alias("c"), other.alias("o")).select("shard", "fp", "c", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    dealt = rows.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    return dealt.mapInArrow(tidy(_links), "a long, b long")


def labelled(points: DataFrame) -> DataFrame:
    """points (a row per fingerprint fp) with node (null: linked to nothing) and the least fingerprint of the group as label."""
    labels = connected(link(points.select("fp"), points.count()))
    return points.join(labels, F.col("fp") == F.col("node"), "left").withColumn("label", F.coalesce("label", "fp"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (its 64 bits as a long) and component_id for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fps = checkpointed(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(tidy(_fingerprint), f"doc_id {kind}, fingerprint long"))
    points = checkpointed(fps.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")))
    own = labelled(points)
    least = own.groupBy("label").agg(F.min("least").alias("component_id"))
    group = own.where("node is not null").select("fp", "label").join(least, "label").select("fp", "component_id")
    named = points.select("fp", "least").join(group, "fp", "left").select(F.col("fp").alias("fingerprint"), F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the least doc_id, null last, and of those the one with the least text hash; all columns stay."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fps = docs.select("doc_id", F.col("text").cast("string"), text_key().alias("h")).mapInArrow(tidy(_fingerprint), f"doc_id {kind}, h binary, fingerprint long")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"), F.col("h").isNull().alias("blank"), "h")
    points = checkpointed(fps.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(first).alias("first")))
    keep = labelled(points).groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.d").alias("least_id"), F.col("first.h").alias("least_text"))
    # columns of docs go by as one struct, so none of their names can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("own_id"), text_key().alias("own_text"))
    kept = rows.join(keep, F.col("own_id").eqNullSafe(F.col("least_id")) & F.col("own_text").eqNullSafe(F.col("least_text")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_text"]).select("doc.*")
