"""HOTA, CLEAR and Identity metrics from their published definitions.

``tracking_metrics`` works on tables in two passes: how well two tracks align over
all frames is an aggregate, and frames are assigned in parallel with it joined in.
``evaluate`` gives the same for one sequence held in arrays. Only frames in which
boxes compete are assigned one at a time. Similarity is the IoU of boxes, or for pitch positions
exp(-d^2 / (2 * sigma^2)) with the tolerance in metres set so that it is 0.05.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.matching import assign, in_frames
from touchline.sources.scratch import scratch

ALPHAS = np.arange(0.05, 0.99, 0.05)
#: Metres at which two positions have a similarity of 0.05.
TOLERANCE = 5.0


class Pairs:
    """Similar pairs of a sequence: frame, ground-truth row and track, predicted row and track, similarity. Sorted by frame."""

    def __init__(self, frame, g_row, p_row, g, p, s):
        self.frame, self.g_row, self.p_row, self.g, self.p, self.s = frame, g_row, p_row, g, p, s

    def where(self, some: np.ndarray) -> Pairs:
        return Pairs(*(getattr(self, c)[some] for c in ("frame", "g_row", "p_row", "g", "p", "s")))

    def contested(self) -> np.ndarray:
        """Pairs of which a box has another pair."""
        return (np.bincount(self.g_row)[self.g_row] > 1) | (np.bincount(self.p_row)[self.p_row] > 1) if len(self.s) else np.zeros(0, bool)

    def frames(self) -> list[tuple[int, int]]:
        cuts = np.flatnonzero(np.diff(self.frame)) + 1
        return [x for x in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.s)], strict=True) if x[0] < x[1]]


def best_of_frame(q: Pairs, a: int, b: int, gain: np.ndarray) -> np.ndarray:
    """Indices, among a..b, of the one-to-one pairs with the largest total gain."""
    gs, x = np.unique(q.g_row[a:b], return_inverse=True)
    ps, y = np.unique(q.p_row[a:b], return_inverse=True)
    m, at = np.zeros((len(gs), len(ps))), np.full((len(gs), len(ps)), -1)
    m[x, y], at[x, y] = gain[a:b], np.arange(a, b)
    got = at[assign(-m)]
    return got[got >= 0]


def chosen(q: Pairs, gain: np.ndarray) -> np.ndarray:
    """Flags of the pairs of the best assignment of every frame."""
    keep = ~q.contested()
    hard = np.flatnonzero(~keep)
    h = q.where(hard)
    for a, b in h.frames():
        keep[hard[best_of_frame(h, a, b, gain[hard])]] = True
    return keep


def switches_of(q: Pairs) -> tuple[int, int]:
    """Matches and identity switches when each frame keeps the pairs of the one before where they still match."""
    last: dict[int, int] = {}
    before: dict[int, int] = {}
    at, matched, switches = -2, 0, 0
    contested = q.contested()
    for a, b in q.frames():
        frame = int(q.frame[a])
        if frame != at + 1:
            before = {}
        pick = np.arange(a, b)
        if contested[a:b].any():
            stay = np.array([before.get(int(g)) == int(p) for g, p in zip(q.g[a:b], q.p[a:b], strict=True)])
            gain = np.zeros(len(q.s))
            gain[a:b] = 1000 * stay + q.s[a:b]
            pick = best_of_frame(q, a, b, gain)
        now = dict(zip(q.g[pick].tolist(), q.p[pick].tolist(), strict=True))
        switches += sum(last.get(g, p) != p for g, p in now.items())
        last.update(now)
        matched += len(now)
        before, at = now, frame
    return matched, switches


def measures(q: Pairs, gts: np.ndarray, prs: np.ndarray) -> dict[str, float]:
    """q: pairs with a similarity above 0; gts, prs: number of boxes of each track."""
    shape = (len(gts), len(prs))
    cell = q.g * shape[1] + q.p

    def table(weight=None, some=slice(None)) -> np.ndarray:
        return np.bincount(cell[some], None if weight is None else weight[some], shape[0] * shape[1]).reshape(shape).astype(float)

    n = max(int(q.g_row.max(initial=-1)), int(q.p_row.max(initial=-1))) + 1
    by_g, by_p = np.bincount(q.g_row, q.s, n), np.bincount(q.p_row, q.s, n)
    total = by_g[q.g_row] + by_p[q.p_row] - q.s
    together = table(np.divide(q.s, total, out=np.zeros_like(q.s), where=total > 1e-12))
    align = together / np.maximum(1e-12, gts[:, None] + prs[None] - together)
    keep = chosen(q, align.ravel()[cell] * q.s if shape[0] * shape[1] else q.s)
    hota = []
    for alpha in ALPHAS:
        m = table(some=keep & (q.s >= alpha - 1e-12))
        tp = m.sum()
        fn, fp = gts.sum() - tp, prs.sum() - tp
        shared = m / np.maximum(1, gts[:, None] + prs[None] - m)
        hota.append((tp / max(1, tp + fn + fp), (m * shared).sum() / max(1, tp)))
    deta, assa = np.array(hota).T
    matched, switches = switches_of(q.where(q.s >= 0.5))
    over = table(some=q.s >= 0.5)
    idtp = over[assign(-over)].sum() if over.size else 0.0
    fn, fp = gts.sum() - matched, prs.sum() - matched
    return {
        "hota": float(np.sqrt(deta * assa).mean()), "deta": float(deta.mean()), "assa": float(assa.mean()), "mota": float((matched - fp - switches) / max(1, gts.sum())),
        "idf1": float(2 * idtp / max(1, gts.sum() + prs.sum())), "idsw": int(switches), "tp": int(matched), "fp": int(fp), "fn": int(fn),
    }


def evaluate(frames: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[str, float]:
    """frames: (ground-truth ids, predicted ids, similarity) of each frame, ids from 0."""
    rows, at_g, at_p = [], 0, 0
    for k, (g, p, s) in enumerate(frames):
        i, j = np.nonzero(np.asarray(s) > 0) if len(g) and len(p) else (np.zeros(0, int), np.zeros(0, int))
        rows.append((np.full(len(i), k), at_g + i, at_p + j, np.asarray(g, int)[i], np.asarray(p, int)[j], np.asarray(s, float)[i, j] if len(i) else np.zeros(0)))
        at_g, at_p = at_g + len(g), at_p + len(p)
    q = Pairs(*(np.concatenate([r[c] for r in rows]) if rows else np.zeros(0, int if c < 5 else float) for c in range(6)))
    gts, prs = (np.bincount(np.concatenate([np.asarray(f[c], int) for f in frames] or [np.zeros(0, int)])).astype(float) for c in (0, 1))
    return measures(q, gts, prs)


# --- over tables, parallel by frame -------------------------------------------------------------------


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as written to a scratch folder: several steps read it, and what it comes from is worked out once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def columns(space: str, attributes: bool) -> list[str]:
    return (["l", "t", "w", "h"] if space == "image" else ["px", "py"]) + (["label"] if attributes else [])


def similar(gt: DataFrame, pred: DataFrame, space: str, attributes: bool) -> DataFrame:
    """seq, image_id, g, p, s of the boxes of a frame that are similar at all, with the sums of s of either box, and whether a box has another pair."""

    def side(df, name):
        return df.select("seq", "image_id", F.col("track_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns(space, attributes)])

    g, p = (lambda c: F.col(f"g_{c}")), (lambda c: F.col(f"p_{c}"))
    if space == "image":

        def along(at, size):
            return F.greatest(F.lit(0.0), F.least(g(at) + g(size), p(at) + p(size)) - F.greatest(g(at), p(at)))

        inter = along("l", "w") * along("t", "h")
        union = g("w") * g("h") + p("w") * p("h") - inter
        s = F.when(union > 0, inter / union)
    else:
        apart = (g("px") - p("px")) * (g("px") - p("px")) + (g("py") - p("py")) * (g("py") - p("py"))
        s = F.exp(apart * (math.log(0.05) / TOLERANCE**2))
    if attributes:
        s = F.when(g("label") == p("label"), s)
    rows = side(gt, "g").join(side(pred, "p"), ["seq", "image_id"]).select("seq", "image_id", "g", "p", s.alias("s")).where("s > 0")
    sums = [F.sum("s").over(Window.partitionBy("seq", "image_id", k)).alias(f"sum_{k}") for k in "gp"]
    return rows.select("*", *sums, contested().alias("hard"))


def contested() -> Column:
    return F.greatest(*[F.count("*").over(Window.partitionBy("seq", "image_id", k)) for k in "gp"]) > 1


def boxes_of(frame: np.ndarray, track: np.ndarray) -> np.ndarray:
    """The number of each row's (frame, track), in their order."""
    names, code = np.unique(track, return_inverse=True)
    return np.unique(frame * len(names) + code, return_inverse=True)[1]


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contested pairs sorted by frame, those of the largest total gain."""
    for t, frame in in_frames(batches):
        g, p, s, gain = (t[c].to_numpy() for c in ("g", "p", "s", "gain"))
        rows = [boxes_of(frame, x) for x in (g, p)]
        if len(np.unique(boxes_of(*rows))) < len(s):
            raise ValueError("a track has two boxes in a frame")
        # where all pairs of a frame share a box, the largest gain is the assignment
        one = np.logical_or(*(np.bincount(frame[np.unique(x, return_index=True)[1]])[frame] == 1 for x in rows))
        easy, hard = np.flatnonzero(one), np.flatnonzero(~one)
        easy = easy[np.lexsort([rows[1][easy], rows[0][easy], -gain[easy], frame[easy]])]
        easy = easy[np.unique(frame[easy], return_index=True)[1]]
        q = Pairs(frame, *rows, g, p, s).where(hard)
        pick = np.concatenate([easy, *(hard[best_of_frame(q, a, b, gain[hard])] for a, b in q.frames())])
        yield pa.RecordBatch.from_arrays([t[c].combine_chunks().take(pa.array(pick)) for c in ("seq", "image_id", "g", "p", "s")], ["seq", "image_id", "g", "p", "s"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of runs of frames, sorted by (seq, run, rank): the pairs each frame keeps, given those of the one before."""
    for t, run in in_frames(batches):
        g, p, s, rank = (t[c].to_numpy() for c in ("g", "p", "s", "rank"))
        frame = np.concatenate([[0], np.cumsum((rank[1:] != rank[:-1]) | (run[1:] != run[:-1]))])
        rows = [boxes_of(frame, x) for x in (g, p)]
        q, out, before, last = Pairs(frame, *rows, g, p, s), [], {}, -1
        hard = q.contested()
        for a, b in q.frames():
            before = before if run[a] == last else {}
            pick = np.arange(a, b)
            if hard[a:b].any():
                stay = np.array([before.get(x) == y for x, y in zip(g[a:b].tolist(), p[a:b].tolist(), strict=True)])
                gain = np.zeros(len(s))
                gain[a:b] = 1000 * stay + s[a:b]
                pick = best_of_frame(q, a, b, gain)
            before, last = dict(zip(g[pick].tolist(), p[pick].tolist(), strict=True)), run[a]
            out.append(pick)
        pick = pa.array(np.concatenate(out))
        yield pa.RecordBatch.from_arrays([t[c].combine_chunks().take(pick) for c in ("seq", "rank", "g", "p")], ["seq", "rank", "g", "p"])


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per sequence the boxes that the best one-to-one assignment of its tracks shares."""
    for t, number in in_frames(batches):
        first = np.flatnonzero(np.diff(number, prepend=-1))
        g, p, n = (t[c].to_numpy() for c in ("g", "p", "n"))
        shared = []
        for a, b in zip(first, [*first[1:], len(n)], strict=True):
            x, y = (np.unique(c[a:b], return_inverse=True)[1] for c in (g, p))
            over = np.zeros((x.max() + 1, y.max() + 1))
            over[x, y] = n[a:b]
            shared.append(int(over[assign(-over)].sum()))
        yield pa.RecordBatch.from_arrays([t["seq"].combine_chunks().take(pa.array(first)), pa.array(shared, pa.int64())], ["seq", "idtp"])


def over_alphas(pairs: DataFrame, gts: DataFrame, prs: DataFrame) -> DataFrame:
    """seq, hota, deta, assa. First pass: how well each two tracks align over all frames. Second: frames are assigned with that table joined in, and matches are counted by level."""
    together = pairs.groupBy("seq", "g", "p").agg(F.sum(F.when(total_of() > 1e-12, F.col("s") / total_of()).otherwise(0.0)).alias("together"))
    tracks = together.join(gts, ["seq", "g"]).join(prs, ["seq", "p"])
    align = tracks.select("seq", "g", "p", "n_g", "n_p", (F.col("together") / F.greatest(F.lit(1e-12), F.col("n_g") + F.col("n_p") - F.col("together"))).alias("align"))
    hard = pairs.where("hard").join(align, ["seq", "g", "p"]).select("seq", "image_id", "g", "p", "s", (F.col("align") * F.col("s")).alias("gain"))
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    best = hard.repartition("seq", "image_id").sortWithinPartitions("seq", "image_id", "g", "p").mapInArrow(_best, ", ".join(f"{c} {kinds[c]}" for c in ("seq", "image_id", "g", "p", "s")))
    chosen = pairs.where("NOT hard").select("seq", "g", "p", "s").unionByName(best.select("seq", "g", "p", "s"))
    levels = chosen.groupBy("seq", "g", "p").agg(*[F.count_if(F.col("s") >= float(a) - 1e-12).alias(f"m{k}") for k, a in enumerate(ALPHAS)]).join(align, ["seq", "g", "p"])
    m = [F.col(f"m{k}") for k in range(len(ALPHAS))]
    sums = levels.groupBy("seq").agg(*[F.sum(c).alias(f"tp{k}") for k, c in enumerate(m)], *[F.sum(c * (c / F.greatest(F.lit(1), F.col("n_g") + F.col("n_p") - c))).alias(f"shared{k}") for k, c in enumerate(m)])
    sizes = sizes_of(gts, prs).join(sums, "seq", "left")
    deta, assa = [], []
    for k in range(len(ALPHAS)):
        tp = F.coalesce(f"tp{k}", F.lit(0))
        deta.append(tp / F.greatest(F.lit(1), F.col("gts") + F.col("prs") - tp))
        assa.append(F.coalesce(f"shared{k}", F.lit(0.0)) / F.greatest(F.lit(1), tp))

    def mean(cs):
        return sum(cs[1:], cs[0]) / len(cs)

    return sizes.select("seq", mean([F.sqrt(d * a) for d, a in zip(deta, assa, strict=True)]).alias("hota"), mean(deta).alias("deta"), mean(assa).alias("assa"))


def total_of() -> Column:
    return F.col("sum_g") + F.col("sum_p") - F.col("s")


def sizes_of(gts: DataFrame, prs: DataFrame) -> DataFrame:
    """Boxes of a sequence on either side."""
    g, p = gts.groupBy("seq").agg(F.sum("n_g").alias("gts")), prs.groupBy("seq").agg(F.sum("n_p").alias("prs"))
    return g.join(p, "seq", "full_outer").na.fill(0, ["gts", "prs"])


def kept_matches(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """seq, rank, g, p of the matches when each frame keeps the pairs of the one before where they still match.

    Only a frame in which boxes compete looks back, so a run is such frames in a row
    and the one before them; runs are independent, and a run is one unit of a task.
    """
    close = pairs.where("s >= 0.5").select("seq", "image_id", "g", "p", "s").withColumn("hard", contested()).join(frames, ["seq", "image_id"])
    order = Window.partitionBy("seq").orderBy("rank")
    own = close.groupBy("seq", "rank").agg(F.bool_or("hard").alias("frame_hard"))
    starts = own.withColumn("new", (~F.col("frame_hard") | ~F.coalesce(F.lag("rank").over(order) == F.col("rank") - 1, F.lit(False))).cast("long"))
    runs = starts.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("run_hard", F.bool_or("frame_hard").over(Window.partitionBy("seq", "run")))
    close = close.drop("image_id").join(runs.select("seq", "rank", "run", "run_hard"), ["seq", "rank"])
    kinds = {f.name: f.dataType.simpleString() for f in close.schema}
    hard = close.where("run_hard").select("seq", F.col("run").alias("image_id"), "rank", "g", "p", "s")
    kept = hard.repartition("seq", "image_id").sortWithinPartitions("seq", "image_id", "rank", "g", "p").mapInArrow(_kept, ", ".join(f"{c} {kinds[c]}" for c in ("seq", "rank", "g", "p")))
    return close.where("NOT run_hard").select("seq", "rank", "g", "p").unionByName(kept)


def identity(pairs: DataFrame) -> DataFrame:
    """seq and the boxes of the best one-to-one assignment of whole tracks, from a table of a row per two tracks."""
    cells = pairs.where("s >= 0.5").groupBy("seq", "g", "p").agg(F.count("*").alias("n")).select("seq", F.lit(0).alias("image_id"), "g", "p", "n")
    # a fixed number of partitions: so small a table would else be put into one task
    spread = cells.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq").sortWithinPartitions("seq")
    return spread.mapInArrow(_identities, f"seq {cells.schema['seq'].dataType.simpleString()}, idtp long")


def tracking_metrics(gt: DataFrame, pred: DataFrame, space: str = "image", attributes: bool = False) -> DataFrame:
    """One row per sequence. gt and pred: seq, image_id, track_id, l, t, w, h or px, py; with attributes also ``label``, which must agree.

    Rows without a track are left out. A track has one box a frame. No step holds a
    sequence's boxes together: frames are joined, assigned and counted in parallel,
    and only a table of a row per two similar tracks is assigned by sequence.
    """
    cols = ["seq", "image_id", "track_id", *columns(space, attributes)]
    gt, pred = (stored(df.where("track_id IS NOT NULL").select(*cols), name) for df, name in ((gt, "truth"), (pred, "predicted")))
    gts = gt.groupBy("seq", F.col("track_id").alias("g")).agg(F.count("*").alias("n_g"))
    prs = pred.groupBy("seq", F.col("track_id").alias("p")).agg(F.count("*").alias("n_p"))
    pairs = stored(similar(gt, pred, space, attributes), "pairs")
    frames = gt.select("seq", "image_id").union(pred.select("seq", "image_id")).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("seq").orderBy("image_id")))
    matches = kept_matches(pairs, frames)
    before = F.lag("p").over(Window.partitionBy("seq", "g").orderBy("rank"))
    clear = matches.withColumn("switch", before != F.col("p")).groupBy("seq").agg(F.count("*").alias("tp"), F.count_if("switch").alias("idsw"))
    out = sizes_of(gts, prs).join(over_alphas(pairs, gts, prs), "seq").join(clear, "seq", "left").join(identity(pairs), "seq", "left").na.fill(0, ["tp", "idsw", "idtp"])
    fp, fn = F.col("prs") - F.col("tp"), F.col("gts") - F.col("tp")
    mota = (F.col("tp") - fp - F.col("idsw")) / F.greatest(F.lit(1), F.col("gts"))
    return out.select(F.col("seq").cast("string").alias("seq"), "hota", "deta", "assa", mota.alias("mota"), (2 * F.col("idtp") / F.greatest(F.lit(1), F.col("gts") + F.col("prs"))).alias("idf1"), *[c.cast("long").alias(n) for n, c in (("idsw", F.col("idsw")), ("tp", F.col("tp")), ("fp", fp), ("fn", fn))])
