"""Operators with state of their own over streams, on transformWithState.

The batch operators' step functions run here as well. `fold` keeps a small value for each key and takes a micro-batch's rows in
their order; rows that come in later batches come later in that order. `asof` needs no order at all: rows and poses wait until the watermark has
passed them, so a stream gives what the batch join gives, however its rows are dealt into batches, but for what comes behind the watermark.

A session needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass set to STORE. With `keep_ms` a key's state is
forgotten so long, in processing time, after its last row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridwake.operators.curbs import ChosenLine, LineFilter
from gridwake.operators.tracking import FilterConfig, VelocityFilter

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Fold:
    """What is kept for a key: its columns, what a key begins with, the step from a row to the next value and the rows that come out, and what comes out when a key falls silent."""

    kept: str
    start: tuple
    step: Callable[[tuple, tuple], tuple[tuple, list[tuple]]]
    end: Callable[[tuple], list[tuple]] = lambda value: []


def _plain(v):
    """A value for the state store: numpy numbers as Python's, NaN in a nullable column as null."""
    v = v.item() if isinstance(v, np.generic) else v
    return None if isinstance(v, float) and v != v else v


def _typed(values: tuple, schema: T.StructType) -> tuple:
    """Values as their columns' own types: pandas makes floats of whole numbers beside nulls."""
    make = {T.LongType: int, T.IntegerType: int, T.ShortType: int, T.ByteType: int, T.DoubleType: float, T.FloatType: float, T.BooleanType: bool}
    plain = map(_plain, values)
    return tuple(v if v is None else make.get(type(f.dataType), lambda x: x)(v) for v, f in zip(plain, schema.fields))


class _Processor(StatefulProcessor):
    def __init__(self, fold: Fold, order: str, columns: list[str], keys: int, out: T.StructType, silence_ms: int | None):
        self.fold, self.order, self.columns, self.keys, self.out, self.silence = fold, order, columns, keys, out, silence_ms
        self.kept = T.StructType.fromDDL(fold.kept)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.fold.kept)

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        names = self.out.fieldNames()
        frame = pd.DataFrame([(*key, *r) for r in rows], columns=names)
        for f in self.out.fields:
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                frame[f.name] = frame[f.name].astype(float)
        return frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        value = tuple(self.value.get()) if self.value.exists() else self.fold.start
        out: list[tuple] = []
        for row in pd.concat(list(rows)).sort_values(self.order, kind="stable")[self.columns].itertuples(index=False):
            value, more = self.fold.step(value, tuple(map(_plain, row)))
            out += more
        self.value.update(_typed(value, self.kept))
        if self.silence:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.fold.end(tuple(self.value.get())) if self.value.exists() else []
        self.value.clear()
        yield self._rows(key, out)

    def close(self) -> None:
        pass


def fold(rows: DataFrame, keys: tuple[str, ...], order: str, columns: list[str], what: Fold, out: str, keep_ms: int | None = None) -> DataFrame:
    """rows (keys, order, columns) folded along the order of each key; out has the columns that `what` gives, behind the keys. With keep_ms a key without rows for so long ends and is forgotten."""
    narrow = rows.select(*keys, *dict.fromkeys([order, *columns]))
    schema = T.StructType([narrow.schema[k] for k in keys] + T.StructType.fromDDL(out).fields)
    processor = _Processor(what, order, columns, len(keys), schema, keep_ms)
    return narrow.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "processingTime" if keep_ms else "none")


def by_count(blocks: DataFrame, most: int, order: str = "seq", keep_ms: int | None = None) -> DataFrame:
    """(stream_id, order, frame) as framing.by_count gives."""
    kind = blocks.schema[order].dataType.simpleString()
    step = lambda s, r: ((s[0] + 1,), [(r[0], (s[0] + 1) // most)])
    return fold(blocks, ("stream_id",), order, [order], Fold("n bigint", (0,), step), f"{order} {kind}, frame bigint", keep_ms)


def by_marker(rows: DataFrame, marker: str = "marker", order: str = "seq", keep_ms: int | None = None) -> DataFrame:
    """(stream_id, order, frame) of the rows that are no markers."""
    kind = rows.schema[order].dataType.simpleString()
    step = lambda s, r: ((s[0] + 1,), []) if r[1] else (s, [(r[0], s[0])])
    return fold(rows, ("stream_id",), order, [order, marker], Fold("frame bigint", (0,), step), f"{order} {kind}, frame bigint", keep_ms)


def count_windows(lines: DataFrame, every: int, key: str = "side", keep_ms: int | None = None) -> DataFrame:
    """(key, run, last_frame, x0, x1) as lines.sliding_average gives; a window that is not full when its key falls silent comes out of nothing."""

    def step(s: tuple, r: tuple) -> tuple[tuple, list[tuple]]:
        run, n, valid, x0, x1 = s
        frame, good, a, b = r
        n, valid, x0, x1 = n + 1, valid + bool(good), x0 + (a if good else 0.0), x1 + (b if good else 0.0)
        if n < every:
            return (run, n, valid, x0, x1), []
        return (run + 1, 0, 0, 0.0, 0.0), [(run, frame, x0 / valid if valid else 0.0, x1 / valid if valid else 0.0)]

    kind = lines.schema["frame_id"].dataType.simpleString()
    what = Fold("run bigint, n int, valid int, x0 double, x1 double", (0, 0, 0, 0.0, 0.0), step)
    return fold(lines, (key,), "frame_id", ["frame_id", "valid", "x0", "x1"], what, f"run bigint, last_frame {kind}, x0 double, x1 double", keep_ms)


def smooth_lines(measured: DataFrame, k_min: float, k_max: float, keys: tuple[str, ...] = ("stream_id", "side"), keep_ms: int | None = None, **options: float) -> DataFrame:
    """(keys, ts_ms, fk, fb, rk, rb) as curbs.smooth_lines gives."""

    def step(s: tuple, r: tuple) -> tuple[tuple, list[tuple]]:
        line = LineFilter(k_min, k_max, **options)
        before, *numbers = s
        if before is not None:
            line.x, line.p = np.array(numbers[:4]).reshape(2, 2), np.array(numbers[4:]).reshape(2, 2)
        ts, k, b = r
        out = line.step(k, b, (ts - (ts - 1000 if before is None else before)) / 1000.0)
        return (ts, *line.x.ravel().tolist(), *line.p.ravel().tolist()), [(ts, *map(float, out))]

    kept = "ts_ms bigint, " + ", ".join(f"n{k} double" for k in range(8))
    good = measured.where("k IS NOT NULL AND b IS NOT NULL").withColumns({c: F.col(c).cast("double") for c in "kb"})
    return fold(good, keys, "ts_ms", ["ts_ms", "k", "b"], Fold(kept, (None,) * 9, step), "ts_ms bigint, fk double, fb double, rk double, rb double", keep_ms)


def smooth(measured: DataFrame, keys: tuple[str, ...] = ("stream_id", "track_id"), cfg: FilterConfig = FilterConfig(), keep_ms: int | None = None) -> DataFrame:
    """(keys, ts_ms, fx, fy, fvx, fvy) as tracking.smooth gives."""

    def step(s: tuple, r: tuple) -> tuple[tuple, list[tuple]]:
        before, *numbers = s
        ts, x, y = r
        axes = [VelocityFilter(z, cfg) for z in (x, y)]
        if before is None:
            got = [(x, 0.0), (y, 0.0)]
        else:
            for f, own in zip(axes, (numbers[:4], numbers[4:])):
                f.p, f.v, f.pp, f.pv = own
            got = [f.step(z, (ts - before) / 1000.0) for f, z in zip(axes, (x, y))]
        return (ts, *(v for f in axes for v in (f.p, f.v, f.pp, f.pv))), [(ts, got[0][0], got[1][0], got[0][1], got[1][1])]

    kept = "ts_ms bigint, " + ", ".join(f"n{k} double" for k in range(8))
    good = measured.where("x IS NOT NULL AND y IS NOT NULL").withColumns({c: F.col(c).cast("double") for c in "xy"})
    return fold(good, keys, "ts_ms", ["ts_ms", "x", "y"], Fold(kept, (None,) * 9, step), "ts_ms bigint, fx double, fy double, fvx double, fvy double", keep_ms)


_LINE = ("ax", "ay", "bx", "by", "angle", "range")


def choose_lines(frames: DataFrame, share: float = 1.0, keys: tuple[str, ...] = ("stream_id", "side"), keep_ms: int | None = None) -> DataFrame:
    """(keys, frame_id, ax, ay, bx, by, angle, range) of each frame's main line as curbs.choose_lines gives, from rows (keys, frame_id, clusters), clusters being arrays of arrays of lines, the main line first."""

    def step(s: tuple, r: tuple) -> tuple[tuple, list[tuple]]:
        chooser = ChosenLine(share, None if s[0] is None else s)
        chosen = chooser.step([[tuple(line[c] for c in _LINE) for line in cluster] for cluster in r[1]])
        return chooser.last or s, [(r[0], *chosen)] if chosen else []

    kind = frames.schema["frame_id"].dataType.simpleString()
    kept = "ax double, ay double, bx double, by double, angle double, range int"
    return fold(frames, keys, "frame_id", ["frame_id", "clusters"], Fold(kept, (None,) * 6, step), f"frame_id {kind}, {kept}", keep_ms)


class _AsOf(StatefulProcessor):
    """Rows wait for the watermark; of poses only those that a row can still meet are kept."""

    def __init__(self, ts: str, left: list[str], pose: list[str], state: T.StructType, out: T.StructType):
        self.ts, self.left, self.pose, self.state, self.out = ts, left, pose, state, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.state)

    def _settled(self, key: tuple, rows: list[tuple], mark: int) -> tuple[list[tuple], list[tuple]]:
        """(rows that come out, what still waits) once no row at or before the mark can come any more."""
        rows.sort(key=lambda r: (r[0], r[1]))
        out, last, keep = [], None, []
        for r in rows:
            if r[0] > mark:
                keep.append(r)
            elif r[1] == 0:
                last = r
            else:
                out.append((*key, *r[2 : 2 + len(self.left)], *(last[2 + len(self.left) :] if last else [None] * len(self.pose))))
        return out, ([last] if last else []) + keep

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=self.out.fieldNames(), dtype=object)
        for f in self.out.fields:
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                frame[f.name] = frame[f.name].astype(float)
        return frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [_typed(r, self.state) for batch in rows for r in batch[self.state.fieldNames()].itertuples(index=False)]
        self.waiting.appendList(new)
        for at in {r[0] for r in new if r[1] == 1}:
            self.handle.registerTimer(at)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        out, keep = self._settled(key, [tuple(r) for r in self.waiting.get()], mark)
        self.waiting.put(keep)
        yield self._frame(out)

    def close(self) -> None:
        pass


def asof(left: DataFrame, poses: DataFrame, key: str = "stream_id", ts: str = "ts_ms", late: str = "10 seconds") -> DataFrame:
    """M1 over streams: left rows with the columns of the latest pose at or before them, prefixed by pose_, as poses.asof gives.

    A row comes out once the watermark, `late` behind the largest time seen, has passed it; rows and poses further behind are dropped. Of the poses that the
    watermark has passed only the last one stays in the state of a key.
    """
    own, pose = [c for c in left.columns if c != key], [c for c in poses.columns if c != key]
    named = {f"l_{c}": left.schema[c].dataType for c in own} | {f"p_{c}": poses.schema[c].dataType for c in pose}

    def side(df: DataFrame, kind: int, prefix: str) -> DataFrame:
        columns = [F.col(n[2:]).alias(n) if n.startswith(prefix) else F.lit(None).cast(t).alias(n) for n, t in named.items()]
        return df.select(F.col(key), F.col(ts).cast("bigint").alias("at_ms"), F.lit(kind).alias("is_row"), *columns, F.timestamp_millis(F.col(ts).cast("bigint")).alias("event_time"))

    both = side(left, 1, "l_").unionByName(side(poses, 0, "p_")).withWatermark("event_time", late)
    state = T.StructType([T.StructField("at_ms", T.LongType()), T.StructField("is_row", T.IntegerType())] + [T.StructField(n, t) for n, t in named.items()])
    out = T.StructType([left.schema[key]] + [T.StructField(c, left.schema[c].dataType) for c in own] + [T.StructField(f"pose_{c}", poses.schema[c].dataType) for c in pose])
    processor = _AsOf(ts, own, pose, state, out)
    return both.groupBy(key).transformWithStateInPandas(processor, out, "append", "eventTime").select(*left.columns, *(f"pose_{c}" for c in pose))
