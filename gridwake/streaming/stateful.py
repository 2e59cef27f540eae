"""Framing and tracking as Structured Streaming operators.

They share their step functions with the batch operators. A stream's rows are taken in order within a micro-batch;
state is small (a few numbers, or the live tracks, which die after a number of misses) and is kept for `keep` of event or processing time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridwake.config import TrackConfig
from gridwake.operators.framing import SequenceSplitter
from gridwake.operators.tracking import BOX, COLUMNS, OUT, Track, Tracker, found_in, rows_of


def split_by_sequence(packets: DataFrame, order: str = "arrival", band: int = 10) -> DataFrame:
    """F3, F4 over a stream of (stream_id, arrival, seq): the same rows with frame and complete."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous, largest, looped, frame = state.get if state.exists else (0, 0, False, 0)
        splitter = SequenceSplitter(previous, largest, looped, band)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        frames, complete = [], []
        for q in rows["seq"]:
            begins, whole = splitter.take(int(q))
            frame += begins
            frames.append(frame)
            complete.append(whole)
        state.update((splitter.previous, splitter.largest, splitter.looped, frame))
        yield rows.assign(frame=pd.Series(frames, index=rows.index, dtype="int32"), complete=pd.Series(complete, index=rows.index, dtype="bool"))[["stream_id", order, "seq", "frame", "complete"]]

    narrow = packets.select("stream_id", order, "seq")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields)
    return narrow.groupBy("stream_id").applyInPandasWithState(run, f"{fields}, frame int, complete boolean", "previous int, largest int, looped boolean, frame int", "append", GroupStateTimeout.NoTimeout)


def split_by_angle(blocks: DataFrame, split: int = 0, order: str = "seq") -> DataFrame:
    """F1 over a stream of (stream_id, seq, azimuth)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, frame = state.get if state.exists else (split, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        frames = []
        for a in rows["azimuth"].astype(int):
            low = before - 36000 if a < before else before
            frame += int(low < split <= a)
            before = a
            frames.append(frame)
        state.update((int(before), int(frame)))
        yield rows.assign(frame=pd.Series(frames, index=rows.index, dtype="int64"))[["stream_id", order, "azimuth", "frame"]]

    narrow = blocks.select("stream_id", order, "azimuth")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields)
    return narrow.groupBy("stream_id").applyInPandasWithState(run, f"{fields}, frame bigint", "azimuth int, frame bigint", "append", GroupStateTimeout.NoTimeout)


def track(frames: DataFrame, method: str = "greedy", cfg: TrackConfig = TrackConfig(), keep_ms: int | None = None) -> DataFrame:
    """K11, K12 over a stream of frames (stream_id, ts_ms, detections).

    With keep_ms a stream without frames for so long is forgotten; such a query has a batch for each trigger, data or not.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sizes = {c: float for c in BOX[1:]}
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=COLUMNS).astype(sizes)
            return
        tracker = Tracker(cfg, method)
        if state.exists:
            previous, tracker.next_id, *arrays, boxes = state.get
            tracker.previous_ms = None if previous < 0 else previous
            for row, box in zip(zip(*arrays), boxes):  # a box is its size and then its corners, one number behind another
                size = tuple(None if v is None or v != v else v for v in box[:3])
                tracker.tracks.append(Track(*row, corners=list(zip(box[3::2], box[4::2])) or None, size=size))
        out = []
        for row in pd.concat(list(batches)).sort_values("ts_ms", kind="stable").itertuples():
            out += rows_of(key[0], row.ts_ms, tracker.step(int(row.ts_ms), found_in(row.detections)))
        live = tracker.tracks
        boxes = [[*(float("nan") if v is None else float(v) for v in t.size), *(v for c in t.corners or [] for v in c)] for t in live]
        state.update((-1 if tracker.previous_ms is None else tracker.previous_ms, tracker.next_id, *([getattr(t, c) for t in live] for c in ("track_id", "x", "y", "vx", "vy", "age", "last_seen")), boxes))
        if keep_ms:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=COLUMNS).astype(sizes)

    kept = "previous bigint, next_id bigint, track_id array<bigint>, x array<double>, y array<double>, vx array<double>, vy array<double>, age array<int>, last_seen array<int>, boxes array<array<double>>"
    return frames.select("stream_id", "ts_ms", "detections").groupBy("stream_id").applyInPandasWithState(run, OUT, kept, "append", GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout)
