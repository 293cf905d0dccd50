"""Stateful streams over frames that arrive in any order: the tracker, and the last accepted camera.

Rows of a sequence wait in a buffer, one entry a micro-batch, until the watermark has
passed their event time. Spark drops what comes later than the watermark, so a
frame whose time has passed is complete, and frames are handed on in order
whatever the micro-batches were. A timer at the first waiting frame's time wakes the
sequence when no more of its rows arrive, and hands on all frames that have passed:
a sequence costs some calls to the state store a micro-batch, not a frame.

State of a sequence: the frames between the newest and the watermark, the live
tracks (or one camera), and some counters. Tracks end after ``Config.keep``
frames without a box; where a sequence falls silent, a timer that many frames
after its last one ends them, and only the counters stay.

Both streams give what their batch forms give on the same rows, less rows that
are later than the watermark. They need the RocksDB state store (``rocksdb``).
Event time must grow with the frame of a sequence; each frame has one time.
Null times and null frames are left out.
"""

from __future__ import annotations

import contextlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from touchline.operators.tracker import Config, Tracker, step_frame

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class InOrder(StatefulProcessor):
    """Buffers rows a frame and hands frames on in order of event time; subclasses say what happens then."""

    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "rows binary")
        self.own = handle.getValueState("own", "state binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for p in rows:
            at = p["ts"].astype("datetime64[us]").astype(np.int64) // 1000
            held += zip(at.tolist(), p[self.inputs].itertuples(index=False, name=None), strict=True)
        if held:
            self.buffer.appendValue((pickle.dumps(held),))
            self.handle.registerTimer(min(h[0] for h in held))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = [h for (c,) in (self.buffer.get() if self.buffer.exists() else ()) for h in pickle.loads(c)]
        ready: dict[int, list[tuple]] = {}
        for at, r in held:
            if at <= mark:
                ready.setdefault(at, []).append(r)
        rest = [h for h in held if h[0] > mark]
        state = pickle.loads(self.own.get()[0]) if self.own.exists() else self.fresh()
        out: list[tuple] = []
        for at in sorted(ready):
            out += self.frame(state, at, ready[at])
        if ready:
            if rest:
                self.buffer.put([(pickle.dumps(rest),)])
                self.handle.registerTimer(min(h[0] for h in rest))
            else:
                self.buffer.clear()
            quiet = self.quiet(max(ready))
            if quiet is not None and quiet > mark:
                self.handle.registerTimer(quiet)
        out += self.silence(state, mark)
        self.own.update((pickle.dumps(state),))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=self.columns)

    def fresh(self):
        raise NotImplementedError

    def frame(self, state, at: int, rows: list[tuple]) -> list[tuple]:
        """Output of one complete frame."""
        raise NotImplementedError

    def quiet(self, at: int) -> int | None:
        """When to look again if nothing more comes after a frame at this time."""
        return None

    def silence(self, state, mark: int) -> list[tuple]:
        """Output due because the watermark has come so far."""
        return []

    def close(self) -> None:
        pass


class TrackerProcessor(InOrder):
    inputs = ["frame", "det_id", "l", "t", "w", "h", "conf", "embedding", "warp"]
    columns = ["seq", "frame", "det_id", "track_id", "ended"]

    def __init__(self, cfg: Config, period: float):
        self.cfg, self.period = cfg, period

    def fresh(self):
        return {"tracker": Tracker(self.cfg), "last": None}

    def frame(self, state, at, rows):
        if rows[0][0] is None or rows[0][0] != rows[0][0]:
            return []
        tracker, frame = state["tracker"], int(rows[0][0])
        boxes = {}
        for r in rows:  # a replayed box counts once
            if r[1] is not None and r[1] == r[1]:
                boxes.setdefault(int(r[1]), r)
        warp = next((r[8] for r in rows if r[8] is not None), None)
        before = {t.tid: t.seen for t in tracker.tracks if t.confirmed}
        got = step_frame(tracker, frame, [(d, *r[2:7], r[7]) for d, r in sorted(boxes.items())], warp)
        alive = {t.tid for t in tracker.tracks}
        state["last"] = at
        return [(frame, d, i, False) for d, i in got] + [(seen, None, tid, True) for tid, seen in sorted(before.items()) if tid not in alive]

    def quiet(self, at):
        return at + int((self.cfg.keep + 1) * self.period * 1000) + 1

    def silence(self, state, mark):
        if state["last"] is None or self.quiet(state["last"]) > mark:
            return []
        gone = [(t.seen, None, t.tid, True) for t in state["tracker"].tracks if t.confirmed]
        state["tracker"].tracks, state["last"] = [], None
        return gone


def track_stream(rows: DataFrame, cfg: Config = Config(), period: float = 0.04, delay: str = "10 seconds") -> DataFrame:
    """seq, frame, det_id, track_id of tracked boxes, and with ``ended`` a row per ended track and the frame it was last seen in.

    rows: seq, frame, ts, det_id, l, t, w, h, conf, one row a box and one per empty
    frame (``tracker.driven`` with the frames' times), embedding and warp if there are any.
    period: seconds between frames. delay: how late a row may be.
    """
    for c, kind in (("embedding", "array<double>"), ("warp", "array<double>")):
        rows = rows.withColumn(c, F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind))
    keyed = rows.where("seq IS NOT NULL AND ts IS NOT NULL AND frame IS NOT NULL").withWatermark("ts", delay).select("seq", "ts", *TrackerProcessor.inputs)
    return keyed.groupBy("seq").transformWithStateInPandas(TrackerProcessor(cfg, period), "seq string, frame long, det_id long, track_id long, ended boolean", "append", "eventTime")


class CameraProcessor(InOrder):
    inputs = ["image_id", "file_path", "score", "pan", "tilt", "hfov"]
    columns = ["seq", "image_id", "rank", "source_rank", "pan", "tilt", "hfov", "carried"]

    def __init__(self, min_score: float, most: int):
        self.min_score, self.most = min_score, most

    def fresh(self):
        return {"rank": 0, "source": None, "camera": (None, None, None)}

    def frame(self, state, at, rows):
        def there(v):
            return v is not None and v == v

        out = []
        for image in sorted({int(r[0]) for r in rows if there(r[0]) and r[1] is not None}):
            entry = max((r for r in rows if there(r[0]) and int(r[0]) == image and there(r[2])), key=lambda r: r[2], default=None)
            ok = entry is not None and entry[2] >= self.min_score
            if ok:
                state["source"], state["camera"] = state["rank"], tuple(float(v) if there(v) else None for v in entry[3:6])
            source = state["source"]
            if source is not None and self.most and state["rank"] - source > self.most:
                source = None
            camera = state["camera"] if source is not None else (None, None, None)
            out.append((image, state["rank"], source, *camera, source is not None and not ok))
            state["rank"] += 1
        return out


def carry_forward_stream(rows: DataFrame, min_score: float = 0.5, most: int = 0, delay: str = "10 seconds") -> DataFrame:
    """The last accepted camera at or before each frame, as ``tracks.carry_forward`` gives it in a batch.

    rows: seq, image_id, ts, and either file_path (the frame exists) or score, pan,
    tilt, hfov (a calibrator's entry for it), or both in one row. A frame whose entry
    has not come when the watermark passes it is served from the state; ``most`` bounds
    how many frames in a row are (0: no bound). An entry without its frame gives no row.
    """
    keyed = rows.where("seq IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay).select("seq", "ts", *CameraProcessor.inputs)
    out = "seq string, image_id long, rank long, source_rank long, pan double, tilt double, hfov double, carried boolean"
    return keyed.groupBy("seq").transformWithStateInPandas(CameraProcessor(min_score, most), out, "append", "eventTime")
