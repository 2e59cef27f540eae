"""M8: transverse Mercator on WGS84 as column expressions, its inverse, UTM zones, and the matrix from an inertial unit to the map.

The series are Krüger's in the third flattening, to the sixth order, as published by Karney (2011): below a nanometre within some
3,000 km of the central meridian.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLATTENING = 6378137.0, 1 / 298.257223563  # WGS84
_N = FLATTENING / (2 - FLATTENING)
_ECC = 2 * math.sqrt(_N) / (1 + _N)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
#: Published coefficients: of each multiple of the angle those of the powers of n, from the multiple itself on. Fixed values.
_FORWARD = ((1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800), (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360), (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440), (49561 / 161280, -179 / 168, 6601661 / 7257600), (34729 / 80640, -3418889 / 1995840), (212378941 / 319334400,))
_INVERSE = ((1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800), (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720), (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720), (4397 / 161280, -11 / 504, -830251 / 7257600), (4583 / 161280, -108847 / 3991680), (20648693 / 638668800,))
_LATITUDE = ((2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675), (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945), (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835), (4279 / 630, -332 / 35, -399572 / 14175), (4174 / 315, -144838 / 6237), (601676 / 22275,))


def _sums(rows: tuple[tuple[float, ...], ...]) -> list[float]:
    return [sum(c * _N ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(rows, 1)]


FORWARD, INVERSE, LATITUDE = _sums(_FORWARD), _sums(_INVERSE), _sums(_LATITUDE)


@dataclass(frozen=True)
class Mercator:
    """A transverse Mercator grid: central meridian, latitude of origin, scale and false coordinates."""

    lon0: float
    lat0: float = 0.0
    scale: float = 1.0
    east0: float = 0.0
    north0: float = 0.0

    @property
    def start(self) -> float:
        """North of the origin's latitude from the equator, unscaled."""
        s = math.sin(math.radians(self.lat0))
        xi = math.atan(math.sinh(math.atanh(s) - _ECC * math.atanh(_ECC * s)))
        return _RADIUS * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(FORWARD, 1)))


def utm(zone: int, south: bool = False) -> Mercator:
    """The grid of a UTM zone."""
    return Mercator(zone * 6 - 183, 0.0, 0.9996, 500_000.0, 10_000_000.0 if south else 0.0)


def _total(parts) -> Column:
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def project(lon: Column, lat: Column, grid: Mercator) -> tuple[Column, Column]:
    """(east, north) in metres of longitudes and latitudes in degrees."""
    s, away = F.sin(F.radians(lat)), F.radians(lon - grid.lon0)
    t = F.sinh(F.atanh(s) - _ECC * F.atanh(_ECC * s))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    north = xi + _total(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(FORWARD, 1))
    east = eta + _total(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(FORWARD, 1))
    return grid.east0 + east * (grid.scale * _RADIUS), grid.north0 + (north * _RADIUS - grid.start) * grid.scale


def unproject(east: Column, north: Column, grid: Mercator) -> tuple[Column, Column]:
    """(lon, lat) in degrees: the inverse of project."""
    xi, eta = ((north - grid.north0) / grid.scale + grid.start) / _RADIUS, (east - grid.east0) / (grid.scale * _RADIUS)
    x = xi - _total(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(INVERSE, 1))
    e = eta - _total(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(INVERSE, 1))
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi + _total(d * F.sin(2 * j * chi) for j, d in enumerate(LATITUDE, 1))
    return F.degrees(F.atan2(F.sinh(e), F.cos(x))) + grid.lon0, F.degrees(lat)


def imu_to_map(x: float, y: float, z: float, heading_deg: float, pitch_deg: float, roll_deg: float) -> np.ndarray:
    """The 4x4 matrix from an inertial unit (x right, y ahead, z up) to the map: roll about y, pitch about x, then the heading, clockwise from north."""
    h, p, r = -math.radians(heading_deg), math.radians(pitch_deg), math.radians(roll_deg)
    about_z = np.array([[math.cos(h), -math.sin(h), 0], [math.sin(h), math.cos(h), 0], [0, 0, 1]])
    about_x = np.array([[1, 0, 0], [0, math.cos(p), -math.sin(p)], [0, math.sin(p), math.cos(p)]])
    about_y = np.array([[math.cos(r), 0, math.sin(r)], [0, 1, 0], [-math.sin(r), 0, math.cos(r)]])
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = about_z @ about_x @ about_y, (x, y, z)
    return out
