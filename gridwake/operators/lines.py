"""Curb lines (L rows): raster, line segments, merging, choice of sides, fits and averages."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.functions import geometry as geo
from gridwake.operators import ranges
from gridwake.plans.materialize import materialize


def raster(points: DataFrame, scale: float, off_x: int, off_y: int) -> DataFrame:
    """L1: the distinct pixels of a frame's points; fractions are cut towards 0."""
    v, u = (F.col("y") * -scale + off_x).cast("int"), (F.col("x") * scale + off_y).cast("int")
    return points.select("frame_id", v.alias("v"), u.alias("u")).distinct()


def hough(pixels: DataFrame, votes: int = 50, least_length: int = 50, most_gap: int = 15, step_deg: int = 1) -> DataFrame:
    """L2: segments (frame_id, x0, y0, x1, y1) of a frame's raster by a deterministic Hough transform.

    Lines are taken in the order of their votes; a line's pixels are cut at gaps, long enough runs are segments, and
    their pixels vote no more. A frame's distinct pixels, which its image size bounds, make one group.
    """
    angles = np.radians(np.arange(0, 180, step_deg))
    cos, sin = np.cos(angles), np.sin(angles)

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        u, v = frame["u"].to_numpy(float), frame["v"].to_numpy(float)
        out = []
        while len(u) >= votes:
            rho = np.rint(np.outer(u, cos) + np.outer(v, sin)).astype(np.int64)
            low = rho.min()
            code = (rho - low) * len(angles) + np.arange(len(angles))
            count = np.bincount(code.ravel())
            best = int(count.argmax())
            if count[best] < votes:
                break
            k = best % len(angles)
            on = np.flatnonzero(rho[:, k] == best // len(angles) + low)
            along = -u[on] * sin[k] + v[on] * cos[k]
            on, along = on[np.argsort(along, kind="stable")], np.sort(along)
            cut = np.flatnonzero(np.diff(along) > most_gap) + 1
            for run in np.split(np.arange(len(on)), cut):
                if along[run[-1]] - along[run[0]] >= least_length:
                    a, b = on[run[0]], on[run[-1]]
                    out.append((u[a], v[a], u[b], v[b]))
            gone = np.zeros(len(u), bool)
            gone[on] = True
            u, v = u[~gone], v[~gone]
        rows = pd.DataFrame(out, columns=["x0", "y0", "x1", "y1"])
        rows.insert(0, "frame_id", frame["frame_id"].iloc[0])
        return rows

    return pixels.groupBy("frame_id").applyInPandas(find, f"frame_id {pixels.schema['frame_id'].dataType.simpleString()}, x0 double, y0 double, x1 double, y1 double")


def describe(segments: DataFrame, snap: float = 1e-3) -> DataFrame:
    """L3: segments ordered by y, with angle (degrees in [0, 180)), length, range of 10 degrees (17 at most) and A, B, C."""
    turned = F.col("y0") > F.col("y1")
    a = segments.select(
        "*", *(F.when(turned, F.col(p)).otherwise(F.col(q)).alias(n) for n, p, q in (("ax", "x1", "x0"), ("ay", "y1", "y0"), ("bx", "x0", "x1"), ("by", "y0", "y1"))),
    )
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    angle = F.when(F.abs(dx) < snap, F.lit(90.0)).otherwise(F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0)))
    la, lb, lc = geo.line_abc(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return a.select("*", angle.alias("angle"), F.hypot(dx, dy).alias("length"), la.alias("a"), lb.alias("b"), lc.alias("c")).withColumn("range", F.least(F.lit(17), F.floor(F.col("angle") / 10).cast("int")))


def of_one_direction(long: DataFrame, angle: float, key: str, left: tuple[str, ...], right: tuple[str, ...], wrap: bool) -> DataFrame:
    """(frame_id, p, q, angle and left columns of p, angle and right columns of q with p_ and q_ before their names) of a frame's lines whose angles differ by less than `angle`; p and q are arrays of the keys of lines that are equal in all those columns.

    Equal lines meet others once, in slices of direction as wide as `angle`; across 180 degrees if wrap. A class meets itself too. As few
    rows become many pairs, the slices are dealt over all tasks and not by their size.
    """
    width, beside = max(angle, 1e-3) * (1 + 1e-9), [-1, 0, 1]
    if wrap:
        n = max(1, int(180 // width))
        width, beside = 180.0 / n, sorted({k % n for k in beside})
    place = lambda k: F.floor(F.col("angle") / width) + k
    slices = lambda k: F.pmod(place(k), F.lit(n)) if wrap else place(k)
    classes = long.groupBy("frame_id", *dict.fromkeys(("angle", *left, *right))).agg(F.collect_list(key).alias("_keys"))
    spark = long.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    ps = classes.select("frame_id", F.explode(F.array(*(slices(k) for k in beside))).alias("_slice"), F.col("_keys").alias("p"), *(F.col(c).alias(f"p_{c}") for c in ("angle", *left)))
    qs = classes.select("frame_id", slices(0).alias("_slice"), F.col("_keys").alias("q"), *(F.col(c).alias(f"q_{c}") for c in ("angle", *right)))
    met = ps.repartition(parts, "frame_id", "_slice").join(qs.repartition(parts, "frame_id", "_slice").hint("merge"), ["frame_id", "_slice"])
    apart = geo.angle_between_deg(F.col("p_angle"), F.col("q_angle")) if wrap else F.abs(F.col("p_angle") - F.col("q_angle"))
    return met.where(apart < angle).drop("_slice")


def each_pair(classes: DataFrame, p: str, q: str) -> DataFrame:
    """(frame_id, p, q) of the lines of classes (frame_id, p, q) that have met, equal keys included."""
    return classes.select("frame_id", F.explode("p").alias(p), "q").select("frame_id", p, F.explode("q").alias(q))


def collinear(lines: DataFrame, angle: float = 2.0, apart: float = 0.5, least_length: float = 63.0, key: str = "line_id") -> DataFrame:
    """L4: (frame_id, a, b) pairs of long lines with nearly one direction and mean distance. Lines that are equal are compared once; slices of direction keep the join an equi-join."""
    met = of_one_direction(lines.where(F.col("length") > least_length), angle, key, ("a", "b", "c"), ("ax", "ay", "bx", "by"), wrap=True)
    far = lambda x, y: geo.line_distance(F.col("p_a"), F.col("p_b"), F.col("p_c"), F.col(x), F.col(y))
    near = met.where((far("q_ax", "q_ay") + far("q_bx", "q_by")) / 2 < apart)
    return each_pair(near, "a", "b").where(F.col("a") < F.col("b"))


def longest_cluster(lines: DataFrame) -> DataFrame:
    """The cluster of each frame with the greatest total length; the smaller id of equals."""
    total = lines.groupBy("frame_id", "cluster_id").agg(F.sum("length").alias("total"))
    return total.groupBy("frame_id").agg(F.max_by(F.struct("cluster_id", "total"), F.struct("total", -F.col("cluster_id"))).alias("m")).select("frame_id", "m.*")


def closest_side(clusters: DataFrame, share: float = 0.25) -> DataFrame:
    """Of (frame_id, cluster_id, mean_x, n) the nearest cluster, or the second if the nearest has too few points."""
    along = Window.partitionBy("frame_id").orderBy("mean_x", "cluster_id")
    two = clusters.select("*", F.row_number().over(along).alias("r"), F.lead("n").over(along).alias("n2"), F.lead("cluster_id").over(along).alias("c2")).where("r = 1")
    return two.select("frame_id", F.when(F.col("n2").isNull() | (F.col("n") >= share * F.col("n2")), F.col("cluster_id")).otherwise(F.col("c2")).alias("cluster_id"))


def orthogonal_fit(points: DataFrame, keys: list[str], unit: float = 1.0) -> DataFrame:
    """y = k x + b of least orthogonal distances for each group, from exact sums of coordinates in whole units; k is null for an upright line.

    Coordinates that are no multiples of the unit (0.001 for metres in millimetres) are rounded to it.
    """
    x, y = ((F.col(c) if unit == 1.0 else F.round(F.col(c) / unit)).cast("decimal(38,0)") for c in "xy")
    s = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    d = lambda e: F.expr(e).cast("double")
    s = s.select(*keys, "n", "sx", "sy", d("n * sxx - sx * sx").alias("vx"), d("n * syy - sy * sy").alias("vy"), d("n * sxy - sx * sy").alias("vxy"))
    s = s.withColumn("theta", 0.5 * F.atan2(2.0 * F.col("vxy"), F.col("vx") - F.col("vy")))
    upright = F.abs(F.cos("theta")) < 1e-12
    k = F.when(~upright, F.tan("theta"))
    mx, my = (F.col(c).cast("double") / F.col("n") for c in ("sx", "sy"))
    mx, my = (mx, my) if unit == 1.0 else (mx * unit, my * unit)
    return s.withColumn("k", k).withColumn("b", my - F.col("k") * mx).select(*keys, "n", "theta", "k", "b", mx.alias("mean_x"))


def line_ends(fits: DataFrame, start: float = 0.0, stop: float = 30.0, step: float = 0.1) -> DataFrame:
    """Fits (k, b, mean_x) with the first and last of the points that y in steps from start to stop gives: x0, y0, x1, y1. An upright line has x = mean_x, a level one no ends."""
    last = start + math.floor((stop - start) / step + 1e-9) * step
    x = lambda y: F.when(F.col("k").isNull(), F.col("mean_x")).otherwise(F.try_divide(F.lit(y) - F.col("b"), F.col("k")))
    return fits.withColumns({"x0": x(start), "y0": F.lit(start), "x1": x(last), "y1": F.lit(last)})


def linear_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """L13 for order 1: ordinary least squares."""
    return points.groupBy(*keys).agg(F.regr_slope("y", "x").alias("k"), F.regr_intercept("y", "x").alias("b"))


def polynomial_fit(points: DataFrame, keys: list[str], order: int) -> DataFrame:
    """Coefficients, lowest power first, of least squares.

    x is moved to the group's mean and scaled by its spread, so that the powers' sums keep their digits; the coefficients are turned back to x itself. Only sums of a group meet.
    """
    own = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    middle = own.groupBy(*keys).agg(F.avg("x").alias("_m"), F.greatest(F.stddev_pop("x"), F.lit(1e-300)).alias("_s"))
    own = own.join(middle, keys) if keys else own.withColumns({"_m": F.lit(0.0), "_s": F.lit(1.0)})
    t = (F.col("x") - F.col("_m")) / F.col("_s")
    sums = [F.sum(F.pow(t, F.lit(k))).alias(f"p{k}") for k in range(2 * order + 1)] + [F.sum(F.pow(t, F.lit(k)) * F.col("y")).alias(f"q{k}") for k in range(order + 1)]

    @F.pandas_udf("array<double>")
    def solve(p: pd.Series, q: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for a, b, mean, spread in zip(p, q, m, s):
            own = np.linalg.lstsq(np.array([[a[i + j] for j in range(order + 1)] for i in range(order + 1)]), np.array(b), rcond=None)[0]
            back, power = np.zeros(order + 1), np.array([1.0])
            for c in own:
                back[: len(power)] += c * power
                power = np.convolve(power, [-mean / spread, 1 / spread])
            out.append(back.tolist())
        return pd.Series(out)

    s = own.groupBy(*keys).agg(F.max("_m").alias("_m"), F.max("_s").alias("_s"), *sums)
    return s.select(*keys, solve(F.array(*(f"p{k}" for k in range(2 * order + 1))), F.array(*(f"q{k}" for k in range(order + 1))), F.col("_m"), F.col("_s")).alias("coefficients"))


def sample_curve(fits: DataFrame, start: float, stop: float, step: float) -> DataFrame:
    """Fits evaluated along x: lines (k, b), or polynomials (coefficients, lowest power first)."""
    n = int(math.floor((stop - start) / step + 1e-9))
    xs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.lit(start) + i * step)).alias("x")
    y = F.col("k") * F.col("x") + F.col("b")
    if "coefficients" in fits.columns:
        y = F.aggregate(F.reverse("coefficients"), F.lit(0.0), lambda a, c: a * F.col("x") + c)
    return fits.select("*", xs).withColumn("y", y)


def sliding_average(lines: DataFrame, every: int, key: str = "side") -> DataFrame:
    """For each full window of `every` frames of a key the means of the first and last x of its valid lines, zeros without any, and the window's last frame."""
    placed = ranges.numbered(lines.select(key, "frame_id", "valid", "x0", "x1"), key, "frame_id", "place")
    mean = lambda c: F.avg(F.when(F.col("valid"), F.col(c))).alias(c)
    out = placed.withColumn("run", F.floor(F.col("place") / every)).groupBy(key, "run").agg(F.count(F.lit(1)).alias("n"), F.max("frame_id").alias("last_frame"), mean("x0"), mean("x1")).where(F.col("n") == every)
    return out.select(key, "run", "last_frame", F.coalesce("x0", F.lit(0.0)).alias("x0"), F.coalesce("x1", F.lit(0.0)).alias("x1"))


_BLOCK = 20_000


def plane_ransac(points: DataFrame, threshold: float, rounds: int = 800, seed: int = 7) -> DataFrame:
    """(frame_id, a, b, c, d, inliers): the best of `rounds` planes through three of a frame's points, drawn with a fixed seed and fitted to its inliers.

    Points of finite coordinates are drawn from a frame's distinct ones: the 3 * rounds of the smallest hashes are a random sample
    of them, and its rows in turn are the rounds; a smaller frame, and rounds whose points lie on a line, draw anew from the sample.
    Inliers are counted over all points, in blocks of a frame's distinct ones, and again for the fitted plane. A frame without a
    plane (fewer than three distinct points, or all on a line) has nulls and no inliers.
    """
    finite = F.lit(True)
    for c in "xyz":
        finite = finite & (F.abs(F.col(c).cast("double")) < float("inf"))  # NaN is greater
    single = points.where(finite).groupBy("frame_id", *(F.col(c).cast("double").alias(c) for c in "xyz")).agg(F.count(F.lit(1)).alias("n"))
    single = materialize(single, "distinct_points")
    order = F.xxhash64(F.lit(seed), "x", "y", "z")
    ranked = single.withColumn("r", F.row_number().over(Window.partitionBy("frame_id").orderBy(order, "x", "y", "z"))).where(F.col("r") <= 3 * rounds)
    sample = ranked.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("r", "x", "y", "z"))).alias("s"))

    @F.pandas_udf("array<struct<a:double,b:double,c:double,d:double,px:double,py:double,pz:double>>")
    def planes(s: pd.Series) -> pd.Series:
        out = []
        for rows in s:
            p = np.array([(q["x"], q["y"], q["z"]) for q in rows], float)
            rng = np.random.default_rng(seed)
            triples = np.arange(3 * rounds).reshape(-1, 3) if len(p) == 3 * rounds else np.zeros((0, 3), int)
            found = []
            for _ in range(20 if len(p) >= 3 else 0):  # degenerate rounds are drawn again so often
                i, j, k = (p[triples[:, c]] for c in range(3))
                n = np.cross(j - i, k - i)
                size = np.linalg.norm(n, axis=1)
                good = size > 1e-9 * np.linalg.norm(j - i, axis=1) * np.linalg.norm(k - i, axis=1)
                n = n[good] / size[good, None] * np.where(n[good, 2:] >= 0, 1, -1)
                found += [(*m, -m @ q, *q) for m, q in zip(n, i[good])]
                if len(found) >= rounds:
                    break
                triples = rng.integers(0, len(p), (rounds - len(found), 3))
            if len(p) >= 3 and not found:  # all but a few on one line: through the line's ends and the point farthest from it
                away = np.linalg.norm(p - p[0], axis=1)
                j = p[away.argmax()]
                side = np.cross(j - p[0], p - p[0])
                far = np.linalg.norm(side, axis=1)
                k = far.argmax()
                if far[k] > 1e-9 * away.max() * away[k]:
                    m = side[k] / far[k] * (1 if side[k][2] >= 0 else -1)
                    found.append((*m, -m @ p[0], *p[0]))
            out.append([dict(zip(("a", "b", "c", "d", "px", "py", "pz"), map(float, f))) for f in sorted(set(found))])
        return pd.Series(out)

    models = materialize(sample.select("frame_id", planes("s").alias("m")), "planes")

    def count(key: tuple, own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        m = np.array([[q[c] for c in "abcd"] for q in model["m"].iloc[0]], float).reshape(-1, 4) if len(model) else np.zeros((0, 4))
        votes = np.zeros(len(m), np.int64)
        xyz, n = own[["x", "y", "z"]].to_numpy(float), own["n"].to_numpy()
        for at in range(0, len(xyz), 2000):
            votes += (np.abs(xyz[at : at + 2000] @ m[:, :3].T + m[:, 3]) <= threshold).T @ n[at : at + 2000]
        return pd.DataFrame({"frame_id": key[0], "k": np.arange(len(m)), "votes": votes})

    blocks = single.groupBy("frame_id").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("blocks"))
    dealt = single.join(blocks, "frame_id").withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "x", "y", "z"), F.col("blocks")))
    sent = models.join(blocks, "frame_id").select("frame_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "m")
    votes = dealt.select("frame_id", "block", "x", "y", "z", "n").groupBy("frame_id", "block").cogroup(sent.groupBy("frame_id", "block")).applyInPandas(count, "frame_id bigint, k bigint, votes bigint")
    best = votes.groupBy("frame_id", "k").agg(F.sum("votes").alias("votes")).groupBy("frame_id").agg(F.max_by("k", F.struct("votes", -F.col("k"))).alias("k"))
    drawn = materialize(models.join(best, "frame_id").select("frame_id", F.expr("m[int(k)]").alias("m")).select("frame_id", "m.*"), "best_planes")

    # The fit: sums of the inliers' coordinates from a point of the plane, and the direction in which they spread least.
    inside = F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d")) <= threshold
    u = {c: F.col(c) - F.col(f"p{c}") for c in "xyz"}
    n = F.col("n")
    near = single.join(drawn, "frame_id").where(inside)
    sums = near.groupBy("frame_id").agg(F.array(F.sum(n).cast("double"), *(F.sum(n * u[c]) for c in "xyz"), *(F.sum(n * u[c] * u[e]) for c in "xyz" for e in "xyz")).alias("s"))

    @F.pandas_udf("struct<a:double,b:double,c:double,d:double>")
    def refit(s: pd.Series, px: pd.Series, py: pd.Series, pz: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        out = []
        for q, *rest in zip(s, px, py, pz, a, b, c, d):
            q, at = np.array(q, float), np.array(rest[:3], float)
            mean = q[1:4] / q[0]
            value, vector = np.linalg.eigh(q[4:].reshape(3, 3) / q[0] - np.outer(mean, mean))
            m = vector[:, 0] * (1 if vector[2, 0] >= 0 else -1)
            # Three points, or points on a line, do not fix another plane.
            out.append((*m, -m @ (at + mean)) if q[0] > 3 and value[1] > 1e-12 * max(value[2], 1e-300) else tuple(rest[3:]))
        return pd.DataFrame(out, columns=list("abcd"))

    fitted = materialize(drawn.join(sums, "frame_id").select("frame_id", refit("s", "px", "py", "pz", "a", "b", "c", "d").alias("m")).select("frame_id", "m.*"), "fitted_planes")
    inliers = single.join(fitted, "frame_id").where(inside).groupBy("frame_id").agg(F.sum("n").alias("inliers"))
    frames = points.select("frame_id").distinct()
    return frames.join(fitted, "frame_id", "left").join(inliers, "frame_id", "left").select("frame_id", "a", "b", "c", "d", F.coalesce("inliers", F.lit(0).cast("long")).alias("inliers"))


def morphological_ground(points: DataFrame, cell: float, windows: tuple[int, ...] = (1, 2, 4), slope: float = 1.0, initial: float = 0.15, most: float = 2.5) -> DataFrame:
    """Points with is_ground by a progressive morphological filter on the grid of lowest points (published PMF).

    Each window opens the surface (erosion, then dilation) along rows and then columns by range windows; a point is
    ground while it lies no more than that window's height threshold above the opened surface.
    """
    placed = points.withColumn("gr", F.floor(F.col("y") / cell).cast("long")).withColumn("gc", F.floor(F.col("x") / cell).cast("long"))
    surface = placed.groupBy("frame_id", "gr", "gc").agg(F.min("z").cast("double").alias("s"))
    steps, before = [], 0
    for k, w in enumerate(windows):
        rows, cols = (Window.partitionBy("frame_id", a).orderBy(b).rangeBetween(-w, w) for a, b in (("gr", "gc"), ("gc", "gr")))
        for f in (F.min, F.max):
            surface = surface.withColumn("s", f("s").over(rows)).withColumn("s", f("s").over(cols))
        limit = initial if k == 0 else min(most, slope * (w - before) * cell + initial)
        surface = surface.withColumn(f"s{k}", F.col("s"))
        steps.append((f"s{k}", limit))
        before = w
    joined = placed.join(surface.drop("s"), ["frame_id", "gr", "gc"])
    ok = F.lit(True)
    for name, limit in steps:
        ok = ok & (F.col("z") - F.col(name) <= limit)
    return joined.withColumn("is_ground", ok).drop("gr", "gc", *(n for n, _ in steps))


def direction_similarity(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Cosine of the angle between two directions, null for a null vector."""
    return F.try_divide(ax * bx + ay * by, F.hypot(ax, ay) * F.hypot(bx, by))
