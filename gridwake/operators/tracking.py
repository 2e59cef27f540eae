"""Obstacle tracks across frames (K10 to K14): order-dependent, hence stateful.

One step function serves the batch operator and the streaming one (gridwake.streaming.tracks), so both give the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwake.config import TrackConfig

OUT = "stream_id bigint, ts_ms bigint, track_id bigint, x double, y double, vx double, vy double, age int, last_seen int, corners array<struct<x:double,y:double>>, depth double, width double, height double"
COLUMNS = ["stream_id", "ts_ms", "track_id", "x", "y", "vx", "vy", "age", "last_seen", "corners", "depth", "width", "height"]
#: What a detection may have beside x and y; a track takes it over from its last detection.
BOX = ("corners", "depth", "width", "height")


@dataclass
class Track:
    track_id: int
    x: float
    y: float
    vx: float = 0.0
    vy: float = 0.0
    age: int = 0
    last_seen: int = 0
    corners: list[tuple[float, float]] | None = None
    size: tuple = (None, None, None)  # depth, width, height

    def move(self, dt: float) -> None:
        dx, dy = self.vx * dt, self.vy * dt
        self.x, self.y = self.x + dx, self.y + dy
        self.corners = self.corners and [(x + dx, y + dy) for x, y in self.corners]


def found_in(detections) -> list[tuple]:
    """(x, y, corners or None, size) of each of a frame's detection structs."""
    out = []
    for d in detections:
        corners = d["corners"] if "corners" in d else None
        out.append((d["x"], d["y"], None if corners is None else [(c["x"], c["y"]) for c in corners], tuple(d[c] if c in d else None for c in BOX[1:])))
    return out


@dataclass
class Tracker:
    """The live tracks of a stream, in order of creation."""

    cfg: TrackConfig = field(default_factory=TrackConfig)
    method: str = "greedy"
    tracks: list[Track] = field(default_factory=list)
    next_id: int = 0
    previous_ms: int | None = None

    def __post_init__(self):
        self.next_id = self.next_id or self.cfg.first_id

    def step(self, ts_ms: int, detections: list[tuple]) -> list[Track]:
        """One frame of (x, y) or of found_in(). Without an earlier frame, or at the same time, nothing moves and velocities are 0."""
        found = [(d[0], d[1]) for d in detections]
        dt = 0.0 if self.previous_ms is None else (ts_ms - self.previous_ms) / 1000.0
        self.previous_ms = ts_ms
        match = self._optimal(found, dt) if self.method == "optimal" else self._greedy(found, dt)
        for t, d in zip(self.tracks, match):
            if d is None:
                t.last_seen += 1
                if not found or self.method == "optimal":
                    t.move(dt)
                continue
            x, y = found[d]
            t.vx, t.vy = ((x - t.x) / dt, (y - t.y) / dt) if dt else (0.0, 0.0)
            t.x, t.y, t.age, t.last_seen = x, y, t.age + 1, 0
            t.corners, t.size = self._box(detections[d])
        taken = {d for d in match if d is not None}
        for d, (x, y) in enumerate(found):
            if d not in taken:
                corners, size = self._box(detections[d])
                self.tracks.append(Track(self.next_id, x, y, corners=corners, size=size))
                self.next_id += 1
        self.tracks = [t for t in self.tracks if t.last_seen <= self.cfg.max_missed]
        if self.next_id > self.cfg.wrap_above and all(t.track_id > self.cfg.wrap_above for t in self.tracks):
            self.next_id = self.cfg.first_id
        return self.tracks

    @staticmethod
    def _box(detection: tuple) -> tuple:
        return (detection[2], detection[3]) if len(detection) > 2 else (None, (None, None, None))

    def _costs(self, found, dt) -> np.ndarray:
        p = np.array([(t.x + t.vx * dt, t.y + t.vy * dt) for t in self.tracks], float).reshape(-1, 2)
        q = np.array(found, float).reshape(-1, 2)
        return np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])

    def _greedy(self, found, dt) -> list[int | None]:
        """Each track in turn takes the nearest free detection below the gate; the first of equals."""
        cost, free, out = self._costs(found, dt), np.ones(len(found), bool), []
        for row in cost:
            open_ = np.where(free & (row < self.cfg.gate), row, np.inf)
            d = int(np.argmin(open_)) if len(open_) else -1
            ok = d >= 0 and np.isfinite(open_[d])
            if ok:
                free[d] = False
            out.append(d if ok else None)
        return out

    def _optimal(self, found, dt) -> list[int | None]:
        """The assignment of least total cost; a pair at or above the gate is as good as none."""
        n = max(len(self.tracks), len(found))
        if not n:
            return []
        square = np.full((n, n), self.cfg.gate)
        cost = self._costs(found, dt)
        square[: len(self.tracks), : len(found)] = np.where(cost < self.cfg.gate, cost, 1e6)
        chosen = assignment(square)
        return [int(d) if d < len(found) and cost[k, d] < self.cfg.gate else None for k, d in enumerate(chosen[: len(self.tracks)])]


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a cheapest assignment of a square matrix: shortest augmenting paths with potentials."""
    n = len(cost)
    owner, u, v = np.full(n, -1), np.zeros(n), np.zeros(n)
    for row in range(n):
        dist, via, done = cost[row] - u[row] - v, np.full(n, row), np.zeros(n, bool)
        tree, total = [row], 0.0
        dist = dist.copy()
        while True:
            j = int(np.argmin(np.where(done, np.inf, dist)))
            total = dist[j]
            done[j] = True
            if owner[j] < 0:
                break
            i = owner[j]
            tree.append(i)
            through = total + cost[i] - u[i] - v
            better = ~done & (through < dist)
            dist[better], via[better] = through[better], i
        reached = done.copy()
        reached[j] = False
        for c in np.flatnonzero(reached):
            u[owner[c]] += total - dist[c]
            v[c] -= total - dist[c]
        u[row] += total
        while True:
            i = via[j]
            owner[j], j = i, int(np.flatnonzero(owner == i)[0]) if i != row else -1
            if i == row:
                break
    out = np.empty(n, np.int64)
    out[owner] = np.arange(n)
    return out


def rows_of(stream, ts_ms: int, tracks: list[Track]) -> list[tuple]:
    return [(stream, ts_ms, t.track_id, t.x, t.y, t.vx, t.vy, t.age, t.last_seen, t.corners and [{"x": x, "y": y} for x, y in t.corners], *t.size) for t in tracks]


def track(frames: DataFrame, method: str = "greedy", cfg: TrackConfig = TrackConfig()) -> DataFrame:
    """The tracks after each frame of each stream.

    frames has (stream_id, ts_ms, detections), one row for each frame, detections being an array of (x, y), with BOX fields
    or without, in the order of their cluster ids. Streams are dealt to tasks and sorted there; a task holds one stream's live tracks at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, tracker = object(), None
        for batch in batches:
            out = []
            for s, ts, found in zip(batch["stream_id"], batch["ts_ms"], batch["detections"]):
                if s != stream:
                    stream, tracker = s, Tracker(cfg, method)
                out += rows_of(s, ts, tracker.step(int(ts), found_in(found)))
            yield pd.DataFrame(out, columns=COLUMNS).astype({c: float for c in BOX[1:]})

    return frames.select("stream_id", "ts_ms", "detections").repartition("stream_id").sortWithinPartitions("stream_id", "ts_ms").mapInPandas(run, OUT)


def frames_of(detections: DataFrame) -> DataFrame:
    """(stream_id, ts_ms, detections) from (stream_id, ts_ms, cluster_id, x, y) and BOX columns, if there; a frame's detections are few."""
    names = ["x", "y", *(c for c in BOX if c in detections.columns)]
    own = F.array_sort(F.collect_list(F.struct("cluster_id", *names)))
    return detections.groupBy("stream_id", "ts_ms").agg(F.transform(own, lambda d: F.struct(*(d[c].alias(c) for c in names))).alias("detections"))


def frame_intervals(frames: DataFrame) -> DataFrame:
    """(stream_id, ts_ms, dt, first): milliseconds since the stream's frame before, 0 and first for the first one."""
    before = F.lag("ts_ms").over(Window.partitionBy("stream_id").orderBy("ts_ms"))
    return frames.select("stream_id", "ts_ms", F.coalesce(F.col("ts_ms") - before, F.lit(0)).alias("dt"), before.isNull().alias("first"))


def latest(rows: DataFrame, value: str, order: tuple[str, ...] = ("ts_ms", "seq"), key: str = "stream_id") -> DataFrame:
    """K6: (key, first column of order, value) of each key's latest row."""
    return rows.groupBy(key).agg(F.max(order[0]).alias(order[0]), F.max_by(value, F.struct(*order)).alias(value))


def output_records(tracks: DataFrame, limit: int = 20) -> DataFrame:
    """Up to `limit` tracks of each frame, in order of creation, of any age."""
    own = F.struct("track_id", "x", "y", "vx", "vy", "age")
    rows = tracks.groupBy("stream_id", "ts_ms").agg(F.slice(F.array_sort(F.collect_list(own)), 1, limit).alias("obstacles"))
    return rows.select("stream_id", "ts_ms", (F.size("obstacles") > 0).cast("int").alias("return_val"), F.size("obstacles").alias("obs_num"), "obstacles")


def confirmed(tracks: DataFrame, least_age: int = 3) -> DataFrame:
    """Tracks seen often enough, as clusters: with the box that their corners span, null without corners."""
    old = tracks.where(F.col("age") >= least_age)
    along = {"x": F.transform("corners", lambda c: c["x"]), "y": F.transform("corners", lambda c: c["y"])}
    edge = {f"{name}_{a}": f(v) for a, v in along.items() for name, f in (("min", F.array_min), ("max", F.array_max))}
    out = old.withColumns(edge).withColumn("cluster_id", F.col("track_id"))
    return out.withColumns({f"size_{a}": F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xy"})


@dataclass(frozen=True)
class FilterConfig:
    """Variances at the start, added by each prediction, and of measurements; velocities move by the residual over the position's variance, `least` at least."""

    position: float = 1.0
    velocity: float = 10.0
    position_noise: float = 0.01
    velocity_noise: float = 0.1
    measured: float = 0.5
    least: float = 0.001


class VelocityFilter:
    """Constant-velocity filter of one axis with diagonal covariance.

    The position follows the measurement by its gain; the velocity then takes gain times the residual that is left over the
    position's variance as predicted. The velocity's variance only grows and is not used.
    """

    def __init__(self, p: float, cfg: FilterConfig = FilterConfig()):
        self.p, self.v, self.cfg = p, 0.0, cfg
        self.pp, self.pv = cfg.position, cfg.velocity

    def step(self, z: float, dt: float) -> tuple[float, float]:
        self.p += self.v * dt
        self.pp += self.cfg.position_noise
        self.pv += self.cfg.velocity_noise
        k = self.pp / (self.pp + self.cfg.measured)
        self.p += k * (z - self.p)
        self.v += k * (z - self.p) / max(self.pp, self.cfg.least)
        self.pp *= 1 - k
        return self.p, self.v


def smooth(measured: DataFrame, keys: tuple[str, ...] = ("stream_id", "track_id"), cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """Measured (keys, ts_ms, x, y) with fx, fy, fvx, fvy, filtered along the time of each key; its first row is the start.

    Keys are dealt to tasks and sorted there; a task holds two filters at a time. Rows without a coordinate are left out.
    """
    narrow = measured.select(*keys, "ts_ms", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields) + ", fx double, fy double, fvx double, fvy double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, axes, before = object(), (), 0
        for batch in batches:
            out = []
            for *key, ts, x, y in batch.itertuples(index=False):
                if key != own:
                    own, axes = key, (VelocityFilter(x, cfg), VelocityFilter(y, cfg))
                    out.append((x, y, 0.0, 0.0))
                else:
                    (px, vx), (py, vy) = (f.step(z, (ts - before) / 1000.0) for f, z in zip(axes, (x, y)))
                    out.append((px, py, vx, vy))
                before = ts
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(out, columns=["fx", "fy", "fvx", "fvy"])], axis=1)

    return narrow.repartition(*keys).sortWithinPartitions(*keys, "ts_ms").mapInPandas(run, schema)
