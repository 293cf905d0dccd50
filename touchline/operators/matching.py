"""One-to-one matching of boxes inside frames: optimal, greedy by overlap, and greedy in detector order.

Matching is decided one frame at a time, but few frames need a decision: boxes
are dealt by frame, a task looks at many frames at once, and a box that overlaps
one box that overlaps no other is matched without more ado. Only what is left of
a frame goes through the rule. No group function is called per frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHES = "seq string, image_id long, pred_id long, gt_id long, iou double"


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of (l, t, w, h) rows; 0 where the union is empty."""
    side = [np.maximum(0, np.minimum(a[:, None, k] + a[:, None, k + 2], b[None, :, k] + b[None, :, k + 2]) - np.maximum(a[:, None, k], b[None, :, k])) for k in (0, 1)]
    inter = side[0] * side[1]
    union = (a[:, 2] * a[:, 3])[:, None] + (b[:, 2] * b[:, 3])[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a least-cost one-to-one assignment: shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        dist = np.full(m, np.inf)
        back = np.full(m, -1)  # previous column on the path
        done = np.zeros(m, bool)
        at, col, reach = i, -1, 0.0
        while True:
            slack = reach + c[at] - u[at] - v
            better = ~done & (slack < dist - 1e-15)
            dist[better], back[better] = slack[better], col
            col = int(np.argmin(np.where(done, np.inf, dist)))
            reach = dist[col]
            done[col] = True
            if row_of[col] < 0:
                break
            at = row_of[col]
        u[i] += reach
        for j in np.flatnonzero(done):
            if j != col:
                u[row_of[j]] += reach - dist[j]
                v[j] -= reach - dist[j]
        while col >= 0:
            prev = back[col]
            row_of[col] = i if prev < 0 else row_of[prev]
            col = prev
    cols = np.flatnonzero(row_of >= 0)
    rows = row_of[cols]
    order = np.argsort(cols if flip else rows)
    return (cols[order], rows[order]) if flip else (rows[order], cols[order])


def optimal(iou: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """The assignment of the largest total IoU; the threshold is applied afterwards and may lose a pair."""
    if not iou.size:
        return []
    return [(i, j) for i, j in zip(*assign(-iou), strict=True) if iou[i, j] >= threshold]


def greedy(iou: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs by falling IoU; ties by prediction, then ground truth."""
    p, g = np.nonzero(iou >= threshold)
    out, used_p, used_g = [], set(), set()
    for k in np.lexsort((g, p, -iou[p, g])):
        i, j = int(p[k]), int(g[k])
        if i not in used_p and j not in used_g:
            used_p.add(i)
            used_g.add(j)
            out.append((i, j))
    return out


def in_order(iou: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Each prediction in turn takes the best ground truth that is left; ties go to the later one."""
    out, left = [], np.ones(iou.shape[1], bool)
    for i in range(len(iou)):
        v = np.where(left, iou[i], -1)
        if len(v) and v.max() >= threshold:
            j = len(v) - 1 - int(np.argmax(v[::-1]))
            left[j] = False
            out.append((i, j))
    return out


BOX = ["l", "t", "w", "h"]


def box_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of rows of boxes with rows of boxes, one to one."""
    side = [np.maximum(0, np.minimum(a[:, k] + a[:, k + 2], b[:, k] + b[:, k + 2]) - np.maximum(a[:, k], b[:, k])) for k in (0, 1)]
    inter = side[0] * side[1]
    union = a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def frame_pairs(frame: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of every prediction (side 0) and ground truth (side 1) of one frame. Rows are sorted by frame and side."""
    n = int(frame[-1]) + 1 if len(frame) else 0
    truths = np.bincount(frame[side == 1], minlength=n)
    first = np.searchsorted(frame * 2 + side, np.arange(n) * 2 + 1)
    p = np.flatnonzero(side == 0)
    many = truths[frame[p]]
    ends = np.cumsum(many)
    return np.repeat(p, many), np.arange(int(many.sum())) - np.repeat(ends - many - first[frame[p]], many)


def paired(frame: np.ndarray, side: np.ndarray, box: np.ndarray, rule: Callable, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prediction row, ground-truth row, IoU) of the matches of many frames."""
    i, j = frame_pairs(frame, side)
    iou = box_iou(box[i], box[j])
    if threshold > 0:  # pairs that do not count for the rule
        some = iou > 0 if rule is optimal else iou >= threshold
        i, j, iou = i[some], j[some], iou[some]
    n = len(frame)
    alone = (np.bincount(i, minlength=n)[i] == 1) & (np.bincount(j, minlength=n)[j] == 1)
    done = alone & (iou >= threshold)
    out = [(i[done], j[done], iou[done])]
    i, j, iou = i[~alone], j[~alone], iou[~alone]
    cuts = np.flatnonzero(np.diff(frame[i])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)], strict=True):
        if a == b:
            continue
        ps, x = np.unique(i[a:b], return_inverse=True)
        gs, y = np.unique(j[a:b], return_inverse=True)
        m = np.zeros((len(ps), len(gs)))
        m[x, y] = iou[a:b]
        at = np.array(rule(m, threshold), np.int64).reshape(-1, 2)
        out.append((ps[at[:, 0]], gs[at[:, 1]], m[at[:, 0], at[:, 1]]))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def in_frames(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole frames of batches sorted by (seq, image_id), some thousands of rows at a time, with the number of each row's frame."""
    held: list[pa.Table] = []
    for b in chain(batches, [None]):  # one batch at a time: a tuple of them would hold the whole partition
        if b is not None and b.num_rows:
            held.append(pa.Table.from_batches([b]))
        size = sum(t.num_rows for t in held)
        if not size or (b is not None and size < rows):
            continue
        t = pa.concat_tables(held).combine_chunks()
        seq, image = t["seq"].to_numpy(zero_copy_only=False), t["image_id"].to_numpy(zero_copy_only=False)
        new = np.concatenate([[False], (image[1:] != image[:-1]) | (seq[1:] != seq[:-1])])
        number = np.cumsum(new)
        cut = t.num_rows if b is None else int(np.searchsorted(number, number[-1]))
        held = [t.slice(cut)] if cut < t.num_rows else []
        if cut:
            yield t.slice(0, cut), number[:cut]


def match(pred: DataFrame, gt: DataFrame, rule: Callable = optimal, threshold: float = 0.5) -> DataFrame:
    """Matched pairs of the frames, by the rule. Boxes go in order of det_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, frame in in_frames(batches):
            box = np.stack([t[c].to_numpy(zero_copy_only=False) for c in BOX], 1).astype(float)
            i, j, iou = paired(frame, t["side"].to_numpy(), box, rule, threshold)
            at, to = pa.array(i), pa.array(j)
            yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks().take(at) for c in ("seq", "image_id", "det_id")), t["det_id"].combine_chunks().take(to), pa.array(iou)], ["seq", "image_id", "pred_id", "gt_id", "iou"])

    cols = [F.col("seq").cast("string").alias("seq"), *(F.col(c).cast("long").alias(c) for c in ("image_id", "det_id")), *(F.col(c).cast("double").alias(c) for c in BOX)]
    both = pred.select(F.lit(0).alias("side"), *cols).unionByName(gt.select(F.lit(1).alias("side"), *cols))
    return both.repartition("seq", "image_id").sortWithinPartitions("seq", "image_id", "side", "det_id").mapInArrow(run, MATCHES)


def renewed(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns under new identities: both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in cols])


def pairs_of(matches: DataFrame, pred: DataFrame, gt: DataFrame) -> DataFrame:
    """pred_jn, gt_jn, pred_track, gt_track of matched boxes."""
    p = pred.select(F.col("det_id").alias("pred_id"), F.col("jn").alias("pred_jn"), F.col("track_id").alias("pred_track"))
    g = gt.select(F.col("det_id").alias("gt_id"), F.col("jn").alias("gt_jn"), F.col("track_id").alias("gt_track"))
    return matches.join(p, "pred_id").join(g, "gt_id")
