"""Distributed search for repeated windows: content-chosen anchors, blocks of text around them, and verdicts per block.

Every window of W units (bytes or words) picks the K-gram in it with the least
hash, leftmost on ties: its anchor. The choice depends on the window alone, so
equal windows have equal anchors at equal offsets. The windows of a document
that share an anchor are a run; a run and the units its windows cover are a
block. Two windows can only be equal if their blocks have one anchor in common,
so text is compared inside buckets of blocks with one anchor.

1. Count the anchors; one that occurs once in the corpus settles its windows.
2. Keep the runs of repeated anchors, with two independent 64-bit hashes of the
   block. Blocks equal in both form a class: copies are one block with a
   multiplicity from here on.
3. Cut one block a class out of the texts, bring the blocks of a bucket together
   and judge each window there (the suffix array or FM-index of the caller). A
   bucket of one class is settled by its multiplicity.
   A bucket of more than ``HOT`` classes is dealt to smaller ones by what stands
   beside the anchor: windows that cover the next v units by those, the others
   by the v units before, which they cover. What is still together with the
   longest such context is dealt by whole windows: a window's hash is its key
   and counts combine before the shuffle.
4. Give the verdicts to all runs of the class and gather them by document.

Steps 1 and 2 move a few bytes a run, step 3 the distinct repeated blocks, and
the texts move once, for steps 3 and 4 together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.runtime import checkpointed, tidy
from touchline.llm.textcore import Poly, U, mix, ranges, runs

#: Distinct blocks of one anchor up to which they are judged in one task.
HOT = 6000
#: Buckets over HOT (8 bytes each) up to which their list is broadcast.
BROADCAST_BUCKETS = 100_000
#: Stands for a null doc_id inside the search.
NO_ID = -(1 << 63)
#: What names a class: the anchor's hash and two hashes of the block.
KEY = ("a", "f", "g")
VERDICTS = "a long, f long, g long, lo long, n long"
_SEGMENT = 1 << 22
_LOW = (1 << 24) - 1


def least(h: np.ndarray, w: int) -> np.ndarray:
    """For every run of w hashes, the index of the least (leftmost on ties of 40 bits)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    for a in range(0, n, _SEGMENT):
        m = min(_SEGMENT, n - a)
        v = h[a : a + m + w - 1] & U(~_LOW & (1 << 64) - 1) | np.arange(m + w - 1, dtype=U)
        pad = -len(v) % w
        rows = np.concatenate([v, np.full(pad, (1 << 64) - 1, U)]).reshape(-1, w)
        head = np.minimum.accumulate(rows, axis=1).ravel()
        tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        out[a : a + m] = (np.minimum(tail[:m], head[w - 1 : w - 1 + m]) & U(_LOW)).astype(np.int64) + a
    return out


class Runs:
    """The runs of a chunk: unit hashes with row offsets in, columns of runs out."""

    def __init__(self, poly: Poly, window: int, gram: int):
        self.poly, self.window, self.gram = poly, window, gram

    def find(self, prefix: np.ndarray, offs: np.ndarray, second: Callable[[], tuple[Poly, np.ndarray]] | None = None) -> dict[str, np.ndarray]:
        """prefix: prefix sums of the units; offs: unit offsets of the rows; second: other sums of the units, for blocks' hashes."""
        w, g = self.window, self.gram
        n = len(prefix) - 1
        none = np.zeros(0, np.int64)
        if n < w:
            return {k: none for k in ("row", "a", "f", "g", "s", "n", "d")}
        at = np.arange(n - g + 1)
        grams = self.poly.slices(prefix, at, at + g)
        pick = least(grams, w - g + 1)
        sizes = np.maximum(np.diff(offs) - w + 1, 0)
        starts = ranges(offs[:-1], sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        pick = pick[starts]
        # anchors lie inside their windows, so neither two rows nor two anchors share a run
        first, count = runs(pick)
        s, p, r = starts[first], pick[first], row[first]
        out = {"row": r, "a": grams[p].view(np.int64), "s": s - offs[r], "n": count, "d": p - s}
        if second:
            for name, (poly, sums) in (("f", (self.poly, prefix)), ("g", second())):
                block = poly.slices(sums, s, s + count - 1 + w)
                out[name] = mix(block ^ (out["d"].astype(U) << U(32)) ^ count.astype(U)).view(np.int64)
        return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, th, which tells texts of one doc_id apart (0 where doc_id is unique), and row, all columns but the text."""
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    twice = docs.groupBy(ids).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    return docs.select(ids, text, row).withColumn("th", F.xxhash64("text") if twice else F.pmod("doc_id", F.lit(1).cast("long")))


def unpacked(z: pa.Array) -> pa.Array:
    """Texts of a column of compressed texts."""
    d = zstandard.ZstdDecompressor()
    return pa.array([d.decompress(x) for x in z.to_pylist()], pa.binary()).cast(pa.string())


def packed(docs: DataFrame) -> DataFrame:
    """docs with compressed texts (z) in place of text: what the shuffles carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for b in batches:
            z = pa.array([c.compress(t.as_py().encode()) for t in b["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["th"], z, *([b["row"]] if "row" in b.schema.names else [])], ["doc_id", "th", "z", *(["row"] if "row" in b.schema.names else [])])

    row = f", row {docs.schema['row'].dataType.simpleString()}" if "row" in docs.columns else ""
    return docs.mapInArrow(tidy(run), f"doc_id long, th long, z binary{row}")


Finder = Callable[[pa.Array, bool], Iterator[tuple[int, dict]]]


def _emit(find: Finder, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not full:
                for _, m in find(b["text"], False):
                    yield pa.RecordBatch.from_arrays([pa.array(m["a"])], ["a"])
                continue
            doc, th = b["doc_id"], b["th"]
            for i, m in find(b["text"], True):
                row = pa.array(m["row"] + i)
                yield pa.RecordBatch.from_arrays([doc.take(row), th.take(row), *(pa.array(m[c]) for c in KEY), pa.array(m["s"] << 20 | m["n"] << 10 | m["d"])], ["doc_id", "th", *KEY, "p"])

    return run


class Search:
    """find: runs of a text column. With ``sift`` anchors are counted first and runs of single ones never leave their task, for a second pass over the texts.

    Where one side of a join is an aggregate, it is grouped by a further column
    made of its keys: the join then has a shuffle of its own on both sides, which
    adaptive execution can split where one key holds most rows.
    """

    def __init__(self, docs: DataFrame, find: Finder, sift: bool):
        self.docs = keyed(docs)
        # the keys are never null; a join would add this filter to some uses only, and equal uses share one shuffle
        self.texts = packed(self.docs.select("doc_id", "th", "text")).where("doc_id IS NOT NULL AND th IS NOT NULL")
        rows = self.docs.select("doc_id", "th", "text").mapInArrow(tidy(_emit(find, True)), "doc_id long, th long, a long, f long, g long, p long")
        if sift:
            once = self.docs.select("text").mapInArrow(tidy(_emit(find, False)), "a long")
            often = once.groupBy("a", F.bitwise_not("a").alias("x")).agg(F.count("*").alias("c")).where("c > 1").select("a")
            rows = rows.join(often, "a", "left_semi")
        self.rows = checkpointed(rows)
        classes = self.rows.groupBy(*KEY).agg(F.count("*").alias("m"), F.min(F.struct("doc_id", F.shiftright("p", 20).alias("s"), "th", "p")).alias("first"))
        per = classes.groupBy("a", F.bitwise_not("a").alias("x")).agg(F.count("*").alias("c")).drop("x")
        self.classes = checkpointed(classes.join(per, "a").where("m > 1 or c > 1").select(*KEY, "m", "c", "first.*"))

    def blocks(self, hot: bool, cut, schema: str) -> DataFrame:
        """cut applied to each document with the list of its blocks that stand for a class."""
        some = self.classes.where(F.col("c") > HOT if hot else F.col("c").between(2, HOT))
        lists = some.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*KEY, "m", "p")).alias("blocks"))
        return self.texts.join(lists, ["doc_id", "th"]).select("doc_id", "z", "blocks").mapInArrow(tidy(cut), schema)

    def judged(self, cut, schema: str, judge, windows, first_only: bool, gram: int, window: int, unit: int) -> DataFrame:
        """VERDICTS on the windows of all buckets of several classes.

        cut makes block rows of the schema (KEY, b: bucket, base: first window, n, d,
        raw and more); judge turns them, sorted by b, into VERDICTS; windows lists
        the windows of block rows for ``window_counts``.
        """

        def settled(rows: DataFrame) -> DataFrame:
            return rows.repartition("b").sortWithinPartitions("b").mapInArrow(tidy(judge), VERDICTS)

        out = settled(self.blocks(False, cut, schema))
        if not self.classes.where(F.col("c") > HOT).limit(1).count():
            return out
        rows = self.blocks(True, cut, schema)
        longest = (window - gram) // 2
        for v in (longest // 6, longest):
            rows = checkpointed(rows.mapInArrow(tidy(narrowed(v, gram, window, unit)), schema))
            large = checkpointed(rows.groupBy("b").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("b"))
            n = large.count()
            if n <= BROADCAST_BUCKETS:  # else both sides are shuffled
                large = F.broadcast(large)
            out = out.unionByName(settled(rows.join(large, "b", "left_anti")))
            if not n:
                return out
            rows = rows.join(large, "b", "left_semi").select(rows.columns)
        return out.unionByName(window_counts(rows.mapInArrow(tidy(windows), WINDOWS), first_only))

    def alone(self) -> DataFrame:
        """Verdicts of buckets with one distinct block: it equals its copies in every window, and nothing else has its anchor."""
        return self.classes.where("c = 1").select(*KEY, F.lit(0).cast("long").alias("lo"), F.shiftright("p", 10).bitwiseAND(1023).alias("n"))

    def spread(self, verdicts: DataFrame, first_only: bool) -> DataFrame:
        """Covered windows of every document: doc_id, th, spans (start, count of windows).

        verdicts: VERDICTS (windows of the class's block). With first_only the
        verdict holds for the first run of the class, and the others are covered
        entirely.
        """
        hit = verdicts.groupBy(*KEY, F.col("a").bitwiseXOR(F.col("f")).alias("x")).agg(F.collect_list(F.struct("lo", "n")).alias("spans")).drop("x")
        rows = self.rows.select("doc_id", "th", *KEY, F.shiftright("p", 20).alias("s"), F.shiftright("p", 10).bitwiseAND(1023).alias("k"))
        if first_only:
            cls = self.classes.select(*KEY, "m", F.struct("doc_id", "s").alias("first")).join(hit, list(KEY), "left").where("m > 1 or spans is not null")
            rows = rows.join(checkpointed(cls), list(KEY))  # written first: a class that holds most rows is split in a join of two plain shuffles
            whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("k").alias("n")))
            rows = rows.withColumn("spans", F.when(F.struct("doc_id", "s") > F.col("first"), whole).otherwise(F.col("spans"))).where("spans is not null")
        else:
            rows = rows.join(hit, list(KEY))
        spans = F.transform("spans", lambda x: F.struct((F.col("s") + x["lo"]).alias("s"), x["n"].alias("n")))
        return rows.groupBy("doc_id", "th").agg(F.flatten(F.collect_list(spans)).alias("spans"))

    def annotated(self, spans: DataFrame, rows: bool = False) -> DataFrame:
        """doc_id, z (the compressed text), spans (null: none) and with ``rows`` the other columns as row, for every document."""
        texts = packed(self.docs.select("doc_id", "th", "text", "row")) if rows else self.texts
        return texts.join(spans, ["doc_id", "th"], "left").withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def narrowed(v: int, gram: int, window: int, unit: int):
    """Block rows dealt to buckets by v units beside the anchor; a block becomes one row or two. unit: bytes of raw a unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            index, cols = [], {c: [] for c in ("b", "base", "n", "d", "raw")}

            def add(i, key, raw, first, n, d, base, index=index, cols=cols):
                index.append(i)
                for c, x in zip(cols, ((key + (1 << 63)) % (1 << 64) - (1 << 63), base + first, n, d - first, raw[first * unit : (first + n - 1 + window) * unit]), strict=True):
                    cols[c].append(x)

            for i, (base, n, d, raw) in enumerate(zip(*(b[c].to_pylist() for c in ("base", "n", "d", "raw")), strict=True)):
                k = max(0, min(n, d + gram + v - window))  # so many windows end before the v units after the anchor do
                if k:
                    add(i, digest(raw[(d - v) * unit : (d + gram) * unit], 1), raw, 0, k, d, base)
                if k < n:
                    add(i, digest(raw[d * unit : (d + gram + v) * unit], 2), raw, k, n - k, d, base)
            at = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else b[f.name].take(at) for f in b.schema], b.schema.names)

    return run


WINDOWS = "a long, f long, g long, m long, doc_id long, s long, lo long, key long"


def window_counts(windows: DataFrame, first_only: bool) -> DataFrame:
    """VERDICTS (n=1) of windows (WINDOWS): a row per window of a class.

    A window counts as often as its class; with first_only it is covered if the
    least (doc_id, start) among equal windows is not its own.
    """
    windows = checkpointed(windows)
    least_ = F.min(F.struct("doc_id", "s")) if first_only else F.sum("m")
    per = windows.groupBy("a", "key").agg(F.sum("m").alias("t"), least_.alias("x")).where("t > 1")
    hit = windows.join(per, ["a", "key"])
    if first_only:
        hit = hit.where(F.col("x") < F.struct("doc_id", "s"))
    return hit.select(*KEY, "lo", F.lit(1).cast("long").alias("n"))


def covered(spans: list, window: int, total: int) -> list[tuple[int, int]]:
    """Maximal covered runs [from, to) of units under windows given as (start, count)."""
    got = sorted((x["s"], x["s"] + x["n"] - 1 + window) for x in spans)
    out: list[list[int]] = []
    for a, b in got:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, total)) for a, b in out]
