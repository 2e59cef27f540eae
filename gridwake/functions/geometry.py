"""Scalar geometry as column expressions: transforms, frames of reference, polygons, lines and geodesy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# --- rigid transforms -------------------------------------------------------------------------------------------


def rigid(matrix, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """p' = R p + t for a 3x4 or 4x4 matrix; the elements are literals."""
    m = np.asarray(matrix, float)
    return tuple(float(a) * x + float(b) * y + float(c) * z + float(t) for a, b, c, t in m[:3])


def flip(install_type: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Axes of an upside-down (> 0) or sideways (-3) sensor."""
    over, side = install_type > 0, install_type == -3
    return F.when(side, z).otherwise(x), F.when(over, -y).otherwise(y), F.when(over, -z).when(side, -x).otherwise(z)


def compose(to_main, yaw_deg: float, offset_x: float, offset_y: float, swap_xy: bool = True, negate_row: int | None = 2) -> np.ndarray:
    """Swap . to-car . to-main as one 4x4 matrix; to-main has one row negated, to-car turns by yaw and moves."""
    main = np.array(to_main, float)
    main = np.vstack([main, [0, 0, 0, 1]]) if main.shape[0] == 3 else main.copy()
    if negate_row is not None:
        main[negate_row] = -main[negate_row]
    a = math.radians(yaw_deg)
    car = np.array([[math.cos(a), -math.sin(a), 0, offset_x], [math.sin(a), math.cos(a), 0, offset_y], [0, 0, 1, 0], [0, 0, 0, 1]])
    swap = np.array([[0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], float) if swap_xy else np.eye(4)
    return swap @ car @ main


def euler(roll: float, pitch: float, yaw: float, t=(0, 0, 0)) -> np.ndarray:
    """Turns about x, then y, then z, and a translation."""
    cx, sx, cy, sy, cz, sz = (f(v) for v in (roll, pitch, yaw) for f in (math.cos, math.sin))
    rx = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    ry = np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]])
    rz = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    return np.column_stack([rz @ ry @ rx, np.array(t, float)])


# --- vehicle and map --------------------------------------------------------------------------------------------


def vehicle_to_map(vx: Column, vy: Column, px: Column, py: Column, heading_deg: Column, offset_deg: float = 0.0) -> tuple[Column, Column]:
    """M4: vehicle (x forward, y left) to map (x east, y north); headings are clockwise from north."""
    a = F.radians(heading_deg + offset_deg)
    right, ahead = -vy, vx
    return F.cos(a) * right + F.sin(a) * ahead + px, F.cos(a) * ahead - F.sin(a) * right + py


def map_to_vehicle(x: Column, y: Column, px: Column, py: Column, heading_deg: Column, offset_deg: float = 0.0) -> tuple[Column, Column]:
    """M5: the inverse of vehicle_to_map."""
    a = F.radians(heading_deg + offset_deg)
    dx, dy = x - px, y - py
    return F.sin(a) * dx + F.cos(a) * dy, F.sin(a) * dy - F.cos(a) * dx


A, E2 = 6378137.0, 6.69437999014e-3  # WGS84


def _ecef(lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return (n + h) * F.cos(lat) * F.cos(lon), (n + h) * F.cos(lat) * F.sin(lon), (n * (1 - E2) + h) * F.sin(lat)


def lonlat_to_enu(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """M7: east and north of an anchor, through earth-centred coordinates; degrees in, metres out."""
    zero = F.lit(0.0)
    x, y, z = _ecef(F.radians(lon), F.radians(lat), zero)
    n0 = A / math.sqrt(1 - E2 * math.sin(math.radians(lat0)) ** 2)
    l0, p0 = math.radians(lon0), math.radians(lat0)
    dx, dy, dz = x - n0 * math.cos(p0) * math.cos(l0), y - n0 * math.cos(p0) * math.sin(l0), z - n0 * (1 - E2) * math.sin(p0)
    return -math.sin(l0) * dx + math.cos(l0) * dy, -math.sin(p0) * math.cos(l0) * dx - math.sin(p0) * math.sin(l0) * dy + math.cos(p0) * dz


def enu_to_lonlat(east: Column, north: Column, lon0: float, lat0: float, rounds: int = 6) -> tuple[Column, Column]:
    """M7: the inverse, for points on the ellipsoid, by a fixed number of Newton-like corrections."""
    p0 = math.radians(lat0)
    w = 1 - E2 * math.sin(p0) ** 2
    per_lat, per_lon = math.radians(1) * A * (1 - E2) / w**1.5, math.radians(1) * A * math.cos(p0) / math.sqrt(w)
    step = F.struct((F.lit(lon0) + east / per_lon).alias("lon"), (F.lit(lat0) + north / per_lat).alias("lat"))

    def turn(s: Column, _: Column) -> Column:
        e, n = lonlat_to_enu(s["lon"], s["lat"], lon0, lat0)
        return F.struct((s["lon"] + (east - e) / per_lon).alias("lon"), (s["lat"] + (north - n) / per_lat).alias("lat"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), step, turn)
    return out["lon"], out["lat"]


# --- polygons: ARRAY<STRUCT<x, y>> ------------------------------------------------------------------------------


def _edges(polygon: Column) -> Column:
    ahead = F.concat(F.slice(polygon, F.lit(2), F.greatest(F.lit(0), F.size(polygon) - 1)), F.slice(polygon, 1, 1))
    return F.zip_with(polygon, ahead, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def in_polygon(polygon: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; fewer than three corners hold nothing."""
    crossed = F.filter(_edges(polygon), lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < F.try_divide((e["bx"] - e["ax"]) * (y - e["ay"]), e["by"] - e["ay"]) + e["ax"]))
    return (F.size(polygon) >= 3) & (F.size(crossed) % 2 == 1)


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.hypot(x - ax - t * dx, y - ay - t * dy)


def polygon_distance(polygon: Column, x: Column, y: Column) -> Column:
    """Distance from a closed ring."""
    return F.array_min(F.transform(_edges(polygon), lambda e: segment_distance(x, y, e["ax"], e["ay"], e["bx"], e["by"])))


def drivable(polygon: Column, x: Column, y: Column, margin: float = 0.5) -> Column:
    """Inside, or no farther than the margin."""
    return in_polygon(polygon, x, y) | F.coalesce(polygon_distance(polygon, x, y) <= margin, F.lit(False))


# --- lines ------------------------------------------------------------------------------------------------------


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def angle_between_deg(a: Column, b: Column) -> Column:
    """Angle between two undirected directions in degrees, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def line_abc(ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """A x + B y + C = 0 through two points, with A^2 + B^2 = 1; null for one point."""
    n = F.hypot(by - ay, ax - bx)
    return F.try_divide(by - ay, n), F.try_divide(ax - bx, n), F.try_divide(bx * ay - ax * by, n)


def line_distance(a: Column, b: Column, c: Column, x: Column, y: Column) -> Column:
    return F.abs(a * x + b * y + c)


def slope_intercept(ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    k = F.try_divide(by - ay, bx - ax)
    return k, ay - k * ax


def boxes_overlap(a: tuple, b: tuple) -> Column:
    """Whether two (min x, min y, max x, max y) boxes share a point."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def polar_line(k: Column, b: Column) -> tuple[Column, Column]:
    """y = k x + b as (theta in [0, pi), d >= 0): the direction of the normal and the distance from the origin, without its side."""
    return F.atan(k) + math.pi / 2, F.abs(b) / F.sqrt(k * k + 1)


def normal_polar(theta: Column, d: Column) -> tuple[Column, Column]:
    """Theta brought to [0, pi), d without its sign."""
    return F.pmod(theta, F.lit(math.pi)), F.abs(d)


def polar_to_slope(theta: Column, d: Column, steepest: float = 10_000.0) -> tuple[Column, Column]:
    """(k, b) of x cos theta + y sin theta = d; a normal along y gives the steepest slope, one along x nulls."""
    flat = F.abs(F.cos(theta)) < 1e-10
    k = F.when(flat, F.lit(steepest)).otherwise(F.try_divide(-F.cos(theta), F.sin(theta)))
    return k, F.when(flat, d).otherwise(F.try_divide(d, F.sin(theta)))


def register(spark: SparkSession) -> None:
    """SQL functions of the same names, for use in spark.sql()."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION point_segment_distance(x DOUBLE, y DOUBLE, ax DOUBLE, ay DOUBLE, bx DOUBLE, by_ DOUBLE) RETURNS DOUBLE RETURN hypot(x - ax - least(1D, greatest(0D, coalesce(try_divide((x - ax) * (bx - ax) + (y - ay) * (by_ - ay), (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 0D))) * (bx - ax), y - ay - least(1D, greatest(0D, coalesce(try_divide((x - ax) * (bx - ax) + (y - ay) * (by_ - ay), (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 0D))) * (by_ - ay))")
    for name, body in (("vehicle_to_map_x", "sin(radians(h)) * vx - cos(radians(h)) * vy + px"), ("vehicle_to_map_y", "cos(radians(h)) * vx + sin(radians(h)) * vy + py")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(vx DOUBLE, vy DOUBLE, px DOUBLE, py DOUBLE, h DOUBLE) RETURNS DOUBLE RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION line_angle_deg(ax DOUBLE, ay DOUBLE, bx DOUBLE, by_ DOUBLE) RETURNS DOUBLE RETURN pmod(degrees(atan2(by_ - ay, bx - ax)), 180D)")
