"""Curb lines across segments and frames (L4 to L6, L9, L10, L15, L17): merging, temporal choice, sampling and filtering.

A frame has few segments; what looks at one frame is a join or an aggregation, and what remembers the frame before is a
step function that tasks apply along each side's time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from gridwake.operators import lines as L
from gridwake.operators import transform as T
from gridwake.plans.materialize import materialize


@F.pandas_udf(BooleanType())
def _goes_on(angle: pd.Series, ends: pd.DataFrame, fit_angle: pd.Series, apart: pd.Series) -> pd.Series:
    """Whether the line of least orthogonal distances through four ends (x, y, x, y, ...) turns by less than fit_angle from the angle, with a mean distance below apart."""
    xy = ends.to_numpy(float).T
    off_x, off_y = (p - (p[0] + p[1] + p[2] + p[3]) / 4 for p in (xy[0::2], xy[1::2]))
    theta = 0.5 * np.arctan2(2.0 * (off_x * off_y).sum(0), (off_x * off_x).sum(0) - (off_y * off_y).sum(0))
    mean = np.abs(np.sin(theta) * off_x - np.cos(theta) * off_y).sum(0) / 4
    return pd.Series((np.abs(np.degrees(theta) % 180.0 - angle.to_numpy()) < fit_angle.to_numpy()) & (mean < apart.to_numpy()))


def merge_lines(lines: DataFrame, angle: float = 2.0, fit_angle: float = 1.0, apart: float = 0.5, least_length: float = 63.0, key: str = "line_id", last_range: DataFrame | None = None) -> DataFrame:
    """L4: (frame_id, cluster_id, line_id): each long line of a frame is a cluster of itself and of those that go on in it.

    A line goes on in another if their angles differ by less than angle, and a line through all four ends by less than
    fit_angle from the first one's with a mean distance below apart. last_range (frame_id, last_range), if given, is the
    direction that was chosen before; lines more than two ranges away take no part. Lines that are equal are compared once.
    """
    long = lines.where(F.col("length") > least_length)
    if last_range is not None:
        long = long.join(last_range, "frame_id", "left").where(F.col("last_range").isNull() | (F.abs(F.col("range") - F.col("last_range")) <= 2)).drop("last_range")
    ends = ("ax", "ay", "bx", "by")
    met = L.of_one_direction(long, angle, key, ends, ends, wrap=False)
    four = F.struct(*(F.col(f"{line}_{c}").cast("double") for line in "pq" for c in ends))
    met = met.where(_goes_on(F.col("p_angle").cast("double"), four, F.lit(float(fit_angle)), F.lit(float(apart))))
    met = L.each_pair(met, "cluster_id", "line_id").where("cluster_id <> line_id")
    return long.select("frame_id", F.col(key).alias("cluster_id"), F.col(key).alias("line_id")).unionByName(met)


def first_fit(lines: DataFrame, by: str = "slope", within: float = 0.1, key: str = "line_id", least_angle: float | None = None, middle: float | None = None) -> DataFrame:
    """(frame_id, line_id, cluster_id): lines in the order of their ids join the first cluster whose first line is near by the column `by`, or open one; clusters count from 0.

    With `middle` the x of the middles must be as near; with least_angle flatter lines take no part. A frame's lines make one group.
    """
    chosen = lines.where(F.col("angle") >= least_angle) if least_angle is not None else lines
    narrow = chosen.select("frame_id", F.col(key).alias("line_id"), F.col(by).cast("double").alias("v"), ((F.col("ax") + F.col("bx")) / 2).cast("double").alias("m"))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("line_id", kind="stable")
        heads, out = [], []
        for v, m in zip(frame["v"], frame["m"]):
            near = (k for k, (w, n) in enumerate(heads) if abs(w - v) < within and (middle is None or abs(n - m) < middle))
            k = next(near, len(heads))
            if k == len(heads):
                heads.append((v, m))
            out.append(k)
        return pd.DataFrame({"frame_id": frame["frame_id"], "line_id": frame["line_id"], "cluster_id": np.array(out, np.int64)})

    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    return narrow.groupBy("frame_id").applyInPandas(fold, f"frame_id {kinds['frame_id']}, line_id {kinds['line_id']}, cluster_id bigint")


@dataclass
class ChosenLine:
    """The curb line of one side from frame to frame.

    A frame's clusters are lists of lines (ax, ay, bx, by, angle, range), the main line first. The first frame takes the
    longest cluster. In later frames lines more than two ranges of direction away from the line before take no part. They
    take, of the clusters in the order of their main line's start, the one whose main line and the line before fit one line
    best: angles apart by less than 2 degrees, the joint line by less than 1, with a mean distance below 1; without such a
    cluster the first one. Its ends are mixed with those before by `share`; at 1 they stay.
    """

    share: float = 1.0
    last: tuple | None = None

    @staticmethod
    def _extent(cluster: list[tuple]) -> float:
        ends = [p for ax, ay, bx, by, *_ in cluster for p in ((ax, ay), (bx, by))]
        if abs(cluster[0][4] - 180) <= 1:  # along x
            xs = [x for x, _ in ends]
            return max(xs) - min(xs)
        top, low = max(ends, key=lambda p: p[1]), min(ends, key=lambda p: p[1])
        return math.dist(top, low)

    @staticmethod
    def _fit(p: tuple, q: tuple) -> tuple[float, float]:
        xy = np.array([p[:2], p[2:4], q[:2], q[2:4]], float)
        off = xy - xy.mean(axis=0)
        theta = 0.5 * math.atan2(2 * (off[:, 0] @ off[:, 1]), off[:, 0] @ off[:, 0] - off[:, 1] @ off[:, 1])
        return math.degrees(theta) % 180, float(np.abs(math.sin(theta) * off[:, 0] - math.cos(theta) * off[:, 1]).mean())

    def step(self, clusters: list[list[tuple]], extents: list[float] | None = None) -> tuple | None:
        """The main line of this frame; None, and nothing changes, without clusters. Where the clusters' extents are given, main lines will do."""
        if self.last is None and extents is not None and clusters:
            at = min(range(len(clusters)), key=lambda k: (-extents[k], clusters[k][0][1], clusters[k][0][3], clusters[k][0][0]))
            self.last = clusters[at][0]
            return self.last
        if self.last is not None:
            near = lambda line: abs(line[5] - self.last[5]) <= 2
            clusters = [[line for line in c if near(line)] for c in clusters if near(c[0])]
        if not clusters:
            return None
        clusters = sorted(clusters, key=lambda c: (c[0][1], c[0][3], c[0][0]))
        if self.last is None:
            self.last = max(clusters, key=self._extent)[0]
            return self.last
        best = None
        for main in (c[0] for c in clusters):
            if abs(self.last[4] - main[4]) < 2.0:
                turned, apart = self._fit(self.last, main)
                if abs(turned - self.last[4]) < 1.0 and apart < 1.0 and (best is None or apart < best[0]):
                    best = (apart, main)
        if best is None:
            self.last = clusters[0][0]
        else:
            ends = tuple(self.share * new + (1 - self.share) * old for new, old in zip(best[1][:4], self.last[:4]))
            self.last = (*ends, *best[1][4:])
        return self.last


def choose_lines(lines: DataFrame, merged: DataFrame, share: float = 1.0, key: str = "line_id", keys: tuple[str, ...] = ("stream_id", "side"), at: str = "frame_id") -> DataFrame:
    """(keys, at, ax, ay, bx, by, angle, range) of each frame's main line along each side's frames, which stand in the order of `at`; frames without a line have no row.

    lines are L3's with keys and `at`, merged is L4's. Of a cluster only its main line and its extent travel: a frame's, a row for each cluster, are
    one row; keys are dealt to tasks and sorted there.
    """
    own = ["ax", "ay", "bx", "by", "angle", "range"]
    rows = merged.join(lines.select(*dict.fromkeys([*keys, "frame_id", at]), F.col(key).alias("line_id"), *own), ["frame_id", "line_id"])
    rows = rows.withColumn("rest", F.col("cluster_id") != F.col("line_id"))
    # The highest and lowest end, the first of equals: of the main line, then by line.
    end = lambda y, x, k, sign: F.struct((sign * F.col(y)).alias("h"), "rest", "line_id", F.lit(k).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))
    ends = lambda sign: F.min(F.least(end("ay", "ax", 0, sign), end("by", "bx", 1, sign)))
    clusters = rows.groupBy(*keys, at, "cluster_id").agg(
        F.min(F.struct("rest", "line_id", *own)).alias("main"), ends(-1).alias("top"), ends(1).alias("low"), (F.max(F.greatest("ax", "bx")) - F.min(F.least("ax", "bx"))).alias("wide"),
    )
    frames = clusters.groupBy(*keys, at).agg(F.array_sort(F.collect_list(F.struct("cluster_id", "main", "top", "low", "wide"))).alias("clusters"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*keys, at).schema.fields)
    names = [*keys, at, *own]

    def extent(c) -> float:
        return c["wide"] if abs(c["main"]["angle"] - 180) <= 1 else math.dist((c["top"]["x"], c["top"]["y"]), (c["low"]["x"], c["low"]["y"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, chooser = object(), None
        for batch in batches:
            out = []
            for *k, frame, found in batch.itertuples(index=False):
                k = [None if x != x else x for x in k]  # a null key is not a number
                if k != before:
                    before, chooser = k, ChosenLine(share)
                if chosen := chooser.step([[tuple(c["main"][x] for x in own)] for c in found], [extent(c) for c in found]):
                    out.append((*k, frame, *chosen))
            yield pd.DataFrame(out, columns=names)

    dealt = frames.select(*keys, at, "clusters").repartition(*keys).sortWithinPartitions(*keys, at)
    return dealt.mapInPandas(run, f"{kinds}, ax double, ay double, bx double, by double, angle double, range int")


def one_of_equals(lines: DataFrame, key: str = "line_id", keys: tuple[str, ...] = ("stream_id", "side"), at: str = "frame_id") -> DataFrame:
    """L3's lines without those that equal, in keys, `at`, ends, angle, length and range, one with a smaller id. L6 chooses the same from them: a copy adds a cluster of its original's extent, behind it."""
    same = [*dict.fromkeys([*keys, "frame_id", at]), "ax", "ay", "bx", "by", "angle", "length", "range"]
    return lines.groupBy(*same).agg(F.min(key).alias(key))


def ransac_line(points: DataFrame, threshold: float, keys: tuple[str, ...] = ("frame_id",), rounds: int = 200, least_angle: float = 40.0, enough: float = 0.9, seed: int = 7) -> DataFrame:
    """(keys, vx, vy, x0, y0, inliers): of lines through two points drawn with a fixed seed, steeper than least_angle degrees, the one with the most points nearer than threshold; the search ends early when enough of them are.

    A group's points (a contour's, bounded by its image) are one task's; a group without such a line has no row.
    """
    narrow = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.select(*keys).schema.fields)

    def find(group: pd.DataFrame) -> pd.DataFrame:
        p = group[["x", "y"]].sort_values(["x", "y"]).to_numpy()
        rng, best = np.random.default_rng(seed), (0, None)
        for i, j in rng.integers(0, len(p), (rounds, 2)):
            v = p[j] - p[i]
            size = math.hypot(*v)
            if not size or math.degrees(math.atan2(abs(v[1]), abs(v[0]))) <= least_angle:
                continue
            v = v / size
            n = int((np.abs(v[0] * (p[:, 1] - p[i, 1]) - v[1] * (p[:, 0] - p[i, 0])) < threshold).sum())
            if n > best[0]:
                best = (n, (*v, *p[i]))
                if n > enough * len(p):
                    break
        row = [[*(group[k].iloc[0] for k in keys), *best[1], best[0]]] if best[0] else []
        return pd.DataFrame(row, columns=[*keys, "vx", "vy", "x0", "y0", "inliers"])

    return narrow.groupBy(*keys).applyInPandas(find, f"{kinds}, vx double, vy double, x0 double, y0 double, inliers bigint")


def keep_contours(points: DataFrame, least: int = 25, least_angle: float = 40.0, keys: tuple[str, ...] = ("frame_id", "contour_id")) -> DataFrame:
    """The points of contours of more than `least` points whose line of least orthogonal distances is as steep as least_angle degrees."""
    fits = L.orthogonal_fit(points, list(keys))
    steep = F.degrees(F.abs("theta")) >= least_angle
    return points.join(fits.where((F.col("n") > least) & steep).select(*keys), list(keys), "left_semi")


def side_of_centroid(points: DataFrame, side: str, keys: tuple[str, ...] = ("frame_id", "contour_id")) -> DataFrame:
    """Of each contour the half that faces the road: of the 'right' side the points left of its centroid, of the 'left' side the others."""
    centre = points.groupBy(*keys).agg((F.sum("x") / F.count(F.lit(1))).alias("cx"))
    left = F.col("x") < F.col("cx")
    return points.join(centre, list(keys)).where(left if side == "right" else ~left).drop("cx")


class LineFilter:
    """Kalman filter of a line's slope and intercept with their rates; both are measured, the slope is held between two limits.

    Slope and intercept do not mix and start with equal covariances, so one 2x2 covariance serves both.
    """

    def __init__(self, k_min: float, k_max: float, start: float = 1000.0, noise: float = 0.001, measured: float = 1.0):
        self.limits, self.noise, self.measured = (k_min, k_max), noise, measured
        self.x = np.zeros((2, 2))  # rows slope and intercept, columns value and rate
        self.p = np.eye(2) * start

    def step(self, k: float, b: float, dt: float) -> tuple[float, float, float, float]:
        f = np.array([[1.0, dt], [0.0, 1.0]])
        self.x = self.x @ f.T
        self.p = f @ self.p @ f.T + np.eye(2) * self.noise
        gain = self.p[:, 0] / (self.p[0, 0] + self.measured)
        self.x = self.x + np.outer(np.array([k, b]) - self.x[:, 0], gain)
        self.p = self.p - np.outer(gain, self.p[0])
        self.x[0, 0] = min(max(self.x[0, 0], self.limits[0]), self.limits[1])
        return (*self.x[:, 0], *self.x[:, 1])


def smooth_lines(measured: DataFrame, k_min: float, k_max: float, keys: tuple[str, ...] = ("stream_id", "side"), **options: float) -> DataFrame:
    """Measured (keys, ts_ms, k, b) with fk, fb, rk, rb filtered along the time of each key; the time step of a first row is 1 s. Rows without k or b are left out."""
    narrow = measured.select(*keys, "ts_ms", F.col("k").cast("double").alias("k"), F.col("b").cast("double").alias("b")).where("k IS NOT NULL AND b IS NOT NULL")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields) + ", fk double, fb double, rk double, rb double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, line, before = object(), None, 0
        for batch in batches:
            out = []
            for *key, ts, k, b in batch.itertuples(index=False):
                if key != at:
                    at, line, before = key, LineFilter(k_min, k_max, **options), ts - 1000
                out.append(line.step(k, b, (ts - before) / 1000.0))
                before = ts
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(out, columns=["fk", "fb", "rk", "rb"])], axis=1)

    return narrow.repartition(*keys).sortWithinPartitions(*keys, "ts_ms").mapInPandas(run, schema)


@dataclass(frozen=True)
class EdgeConfig:
    """Sides of the vehicle in points' units, raster, votes of lines and what merges."""

    x_min: float = -15_000
    x_max: float = 15_000
    y_left: float = 30_000
    y_right: float = 30_000
    scale: float = 0.02
    off_x: int = 700
    off_y: int = 400
    votes: int = 50
    least_length: int = 50
    most_gap: int = 15
    long: float = 63.0
    ahead: tuple[float, float] = (0.0, 30_000.0)
    share: float = 1.0
    size: tuple[int, int] | None = None  # height and width of the image; pixels outside are left out


def _image(stream: Column, frame: Column, side: Column) -> Column:
    """The key of an image: a frame's side of a stream."""
    return F.concat(frame.cast("string"), F.lit("/"), side, F.lit("/"), F.coalesce(F.concat(F.lit("="), stream.cast("string")), F.lit("")))


def _sides(points: DataFrame, cfg: EdgeConfig) -> DataFrame:
    """Points with the key of their image as frame_id."""
    sided = T.sides(points, cfg.x_min, cfg.x_max, cfg.y_left, cfg.y_right)
    return sided.select(_image(F.col("stream_id"), F.col("frame_id"), F.col("side")).alias("frame_id"), "x", "y")


def edges(points: DataFrame, cfg: EdgeConfig = EdgeConfig()) -> DataFrame:
    """(stream_id, side, frame_id, k, b, x0, y0, x1, y1): the curb line of each side and frame of points (stream_id, frame_id, x, y), y ahead.

    Sides (T7), raster (L1), segments (L2, L3), merging (L4), choice over time (L6), line (L12): the chosen main line in
    points' units as x = k y + b, with its ends at the two distances ahead. A side without a segment has no row in a frame. Every
    stream's frames are images of their own; a null stream is one of them.
    """
    kinds = {c: points.schema[c].dataType for c in ("stream_id", "frame_id")}
    pixels = L.raster(_sides(points, cfg), cfg.scale, cfg.off_x, cfg.off_y)
    if cfg.size:
        pixels = pixels.where((F.col("v") >= 0) & (F.col("v") < cfg.size[0]) & (F.col("u") >= 0) & (F.col("u") < cfg.size[1]))
    segments = L.describe(L.hough(pixels, cfg.votes, cfg.least_length, cfg.most_gap))
    part = lambda k: F.split_part(F.col("frame_id"), F.lit("/"), F.lit(k))
    stream = F.regexp_extract("frame_id", "(?s)^[^/]*/[^/]*/(?:=(.*))?$", 1)
    named = F.regexp_like("frame_id", F.lit("^[^/]*/[^/]*/="))
    segments = segments.select("*", F.xxhash64("frame_id", "ax", "ay", "bx", "by").alias("line_id"), F.when(named, stream).cast(kinds["stream_id"]).alias("stream_id"), part(2).alias("side"), part(1).cast(kinds["frame_id"]).alias("frame"))
    segments = materialize(segments, "segments")
    chosen = choose_lines(segments, merge_lines(segments, least_length=cfg.long), cfg.share, at="frame")
    # Pixels back to points: v = off_x - scale y, u = off_y + scale x, and segments are (u, v).
    place = lambda u, v: ((F.col(u) - cfg.off_y) / cfg.scale, (cfg.off_x - F.col(v)) / cfg.scale)
    (xa, ya), (xb, yb) = place("ax", "ay"), place("bx", "by")
    near, far = cfg.ahead
    out = chosen.withColumn("k", F.try_divide(xb - xa, yb - ya)).withColumn("b", xa - F.col("k") * ya)
    at = lambda y: F.col("k") * y + F.col("b")
    return out.select("stream_id", "side", F.col("frame").alias("frame_id"), "k", "b", at(near).alias("x0"), F.lit(near).alias("y0"), at(far).alias("x1"), F.lit(far).alias("y1"))


def edge_averages(points: DataFrame, every: int, cfg: EdgeConfig = EdgeConfig()) -> DataFrame:
    """(stream_id, side, ts, x0, y0, x1, y1): the mean curb line of every `every` frames in which a side has points, at the last of them; a frame without a line counts as one that is not valid, a window without any gives zeros.

    packets.curb_messages makes the messages of these rows, or of those of edges() with frame_id as ts.
    """
    kinds = {c: points.schema[c].dataType for c in ("stream_id", "frame_id")}
    sided = T.sides(points, cfg.x_min, cfg.x_max, cfg.y_left, cfg.y_right)
    frames = sided.select("stream_id", "side", "frame_id").distinct()
    lines = edges(points, cfg).select(F.col("stream_id").alias("_s"), F.col("side").alias("_side"), F.col("frame_id").alias("_f"), "x0", "x1")
    met = frames.join(lines, F.col("stream_id").eqNullSafe(F.col("_s")) & (F.col("side") == F.col("_side")) & (F.col("frame_id") == F.col("_f")), "left")
    keyed = met.select(F.concat(F.col("side"), F.lit("/"), F.coalesce(F.concat(F.lit("="), F.col("stream_id").cast("string")), F.lit(""))).alias("key"), "frame_id", F.col("x0").isNotNull().alias("valid"), "x0", "x1")
    out = L.sliding_average(keyed, every, "key")
    stream = F.when(F.regexp_like("key", F.lit("^[^/]*/=")), F.regexp_extract("key", "(?s)^[^/]*/=(.*)$", 1)).cast(kinds["stream_id"])
    return out.select(stream.alias("stream_id"), F.split_part("key", F.lit("/"), F.lit(1)).alias("side"), F.col("last_frame").alias("ts"), "x0", F.lit(cfg.ahead[0]).alias("y0"), "x1", F.lit(cfg.ahead[1]).alias("y1"))
