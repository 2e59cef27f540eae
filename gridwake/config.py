"""Parameters of the sensor operators. Lengths are in the unit of the points; `metre` says how many of them make one."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class GridConfig:
    """An elevation grid: rows run along y, columns along x."""

    x_min: float = 900
    x_max: float = 8000
    y_min: float = -3000
    y_max: float = 3000
    resolution: float = 200
    metre: float = 1000
    min_points: int = 1
    seed_columns: int = 3
    slope: float = 0.35
    height: float = 0.35  # metres, as the next three
    far_slope: float = 0.80
    far_height: float = 0.60
    near_x: float = 3.5
    fallback_ground: float = -1390
    layer: float = 50
    max_layers: int = 200
    near_boundary: float = 4000
    top_near: tuple[float, float] = (50, 400)
    top_far: tuple[float, float] = (100, 500)
    min_range: float = 20
    min_layers: int = 1
    vertical_range: float = 500
    vertical_layers: int = 3
    veto_neighbours: int = 2
    min_cluster_cells: int = 2

    @property
    def rows(self) -> int:
        return math.ceil((self.y_max - self.y_min) / self.resolution)

    @property
    def cols(self) -> int:
        return math.ceil((self.x_max - self.x_min) / self.resolution)


@dataclass(frozen=True)
class TrackConfig:
    gate: float = 0.5
    max_missed: int = 10
    first_id: int = 9999
    wrap_above: int = 50000


@dataclass(frozen=True)
class PoseConfig:
    timeout_ms: int = 1000
