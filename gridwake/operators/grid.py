"""Elevation grid: points to cells, slope, ground, reference height, occupancy and obstacle candidates.

`frame_id` is the unit of parallelism. Every step but region growing is a projection, an aggregation, an equi-join of
cells with their neighbours or a window inside a frame; region growing works on a frame's cells, not its points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.config import GridConfig
from gridwake.plans.materialize import join_checked, materialize

KEY = ["frame_id", "row", "col"]
_OFFSETS = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c]


def finite(points: DataFrame, *columns: str) -> DataFrame:
    """T5: rows whose coordinates are numbers."""
    for c in columns or ("x", "y", "z"):
        v = F.col(c).cast("double")
        points = points.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return points


def to_cells(points: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """G1: the points inside the grid's half-open bounds with their row and column."""
    x, y = F.col("x"), F.col("y")
    inside = (x >= cfg.x_min) & (x < cfg.x_max) & (y >= cfg.y_min) & (y < cfg.y_max)
    row = F.least(F.floor((y - cfg.y_min) / cfg.resolution).cast("int"), F.lit(cfg.rows - 1))
    col = F.least(F.floor((x - cfg.x_min) / cfg.resolution).cast("int"), F.lit(cfg.cols - 1))
    return points.where(inside).withColumn("row", row).withColumn("col", col)


def build(points: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """(frame_id, row, col, min_z, max_z, sum_z, point_num) of the cells with enough points; partial sums meet before the shuffle."""
    cells = to_cells(points, cfg).groupBy(*KEY).agg(F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.sum("z").alias("sum_z"), F.count(F.lit(1)).alias("point_num"))
    return cells.where(F.col("point_num") >= cfg.min_points)


def centre_x(cfg: GridConfig, col: Column | None = None) -> Column:
    return F.lit(float(cfg.x_min)) + ((F.col("col") if col is None else col) + 0.5) * cfg.resolution


def neighbours(cells: DataFrame, columns: list[str]) -> DataFrame:
    """(key of a cell, dr, dc, columns of one of its 8 neighbours prefixed by n_): a hash join on moved keys."""
    moves = F.explode(F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in _OFFSETS)))
    moved = cells.select("frame_id", "row", "col", *(F.col(c).alias(f"n_{c}") for c in columns), moves.alias("m"))
    return moved.select("frame_id", (F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col"), F.col("m.dr").alias("dr"), F.col("m.dc").alias("dc"), *(f"n_{c}" for c in columns))


def slope(cells: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """Cells with the steepest rise of min_z to a neighbour over the distance of the centres; 0 without one."""
    step = F.when(F.col("dr") * F.col("dc") != 0, F.lit(float(cfg.resolution)) * F.sqrt(F.lit(2.0))).otherwise(F.lit(float(cfg.resolution)))
    rises = neighbours(cells, ["min_z"]).join(cells.select(*KEY, "min_z"), KEY).groupBy(*KEY).agg(F.max(F.abs(F.col("n_min_z") - F.col("min_z")) / step).alias("slope"))
    return cells.join(rises, KEY, "left").withColumn("slope", F.coalesce("slope", F.lit(0.0)))


def seeds(cells: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """The cells of the first columns."""
    return cells.where(F.col("col") < cfg.seed_columns)


def thresholds(cfg: GridConfig = GridConfig(), col: Column | None = None) -> tuple[Column, Column]:
    """(slope, height in points' units) limits at a column's centre; the slope term starts from its base, not from near_x."""
    x = centre_x(cfg, col) / cfg.metre
    s = F.when(x < cfg.near_x, F.lit(cfg.slope)).when(x > cfg.x_max / cfg.metre, F.lit(cfg.far_slope)).otherwise(cfg.slope + (x - cfg.slope) * 0.1)
    h = F.when(x < cfg.near_x, F.lit(cfg.height)).when(x > cfg.x_max / cfg.metre, F.lit(cfg.far_height)).otherwise(cfg.height + (x - cfg.near_x) * (cfg.far_height - cfg.height) / (cfg.x_max / cfg.metre - cfg.near_x))
    return s, h * cfg.metre


def _flood(rows: int, cols: int, r: np.ndarray, c: np.ndarray, z: np.ndarray, open_: np.ndarray, limit: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Cells reached from start; a step into a cell needs it open and the rise within its limit. Order plays no part."""
    at = np.full((rows + 2, cols + 2), -1, np.int64)
    at[r + 1, c + 1] = np.arange(len(r))
    seen = start.copy()
    front = np.flatnonzero(start)
    while len(front):
        found = []
        for dr, dc in _OFFSETS:
            to = at[r[front] + 1 + dr, c[front] + 1 + dc]
            ok = to >= 0
            src, to = front[ok], to[ok]
            ok = ~seen[to] & open_[to] & (np.abs(z[src] - z[to]) <= limit[to])
            found.append(to[ok])
        front = np.unique(np.concatenate(found))
        seen[front] = True
    return seen


def grow_ground(cells: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """Cells (with slope) and is_ground, the cells reachable from the seeds. A frame's cells make one group."""
    s, h = thresholds(cfg)
    ready = cells.select(*KEY, F.col("min_z").cast("double").alias("z"), (F.col("slope") <= s).alias("open"), h.alias("limit"), (F.col("col") < cfg.seed_columns).alias("seed"))
    rows, cols = cfg.rows, cfg.cols

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        ok = _flood(rows, cols, *(frame[c].to_numpy() for c in ("row", "col", "z", "open", "limit", "seed")))
        return frame.loc[ok, KEY]

    ground = ready.groupBy("frame_id").applyInPandas(grow, cells.select(*KEY).schema)
    return cells.join(ground.withColumn("is_ground", F.lit(True)), KEY, "left").withColumn("is_ground", F.coalesce("is_ground", F.lit(False)))


def grow_ground_rounds(cells: DataFrame, cfg: GridConfig = GridConfig(), max_rounds: int = 10_000) -> DataFrame:
    """G6 by joins: the frontier meets the edges until no new cell is found. For grids too large for a group."""
    s, h = thresholds(cfg)
    into = cells.where(F.col("slope") <= s).select(*KEY, "min_z", h.alias("limit"))
    edges = neighbours(cells, ["min_z", "row", "col"]).join(into, KEY).where(F.abs(F.col("n_min_z") - F.col("min_z")) <= F.col("limit"))
    edges = materialize(edges.select("frame_id", F.col("n_row").alias("r0"), F.col("n_col").alias("c0"), "row", "col"), "edges")
    seen = front = materialize(seeds(cells, cfg).select(*KEY), "seeds")
    for _ in range(max_rounds):
        step = front.withColumnsRenamed({"row": "r0", "col": "c0"}).join(edges, ["frame_id", "r0", "c0"]).select(*KEY).distinct()
        front = materialize(step.join(seen, KEY, "left_anti"), "front")
        if front.isEmpty():
            break
        seen = materialize(seen.union(front), "seen")
    else:
        raise RuntimeError(f"the ground still grows after {max_rounds} rounds")
    return cells.join(seen.withColumn("is_ground", F.lit(True)), KEY, "left").withColumn("is_ground", F.coalesce("is_ground", F.lit(False)))


def column_reference(cells: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """G10, first half: (frame_id, col, ground_reference_z) of all columns.

    The exact median of the ground cells' min_z; columns without any are filled on a line between their neighbours or
    like the nearest one at the edges; a frame without ground gets the fallback; inner columns are means of three.
    """
    medians = cells.where("is_ground").groupBy("frame_id", "col").agg(F.median("min_z").alias("raw"))
    spine = cells.select("frame_id").distinct().select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(cfg.cols - 1))).alias("col"))
    along = Window.partitionBy("frame_id").orderBy("col")
    back, ahead = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("raw").isNotNull(), F.struct("col", "raw"))
    both = spine.join(medians, ["frame_id", "col"], "left").select("*", F.last(known, True).over(back).alias("p"), F.first(known, True).over(ahead).alias("n"))
    line = F.col("p.raw") + (F.col("n.raw") - F.col("p.raw")) * ((F.col("col") - F.col("p.col")) / (F.col("n.col") - F.col("p.col")))
    filled = F.coalesce("raw", F.when(F.col("p").isNotNull() & F.col("n").isNotNull(), line), "p.raw", "n.raw", F.lit(float(cfg.fallback_ground)))
    flat = both.select("frame_id", "col", filled.alias("z"))
    inner = F.col("col").between(1, cfg.cols - 2)
    smooth = F.when(inner, (F.lag("z").over(along) + F.col("z") + F.lead("z").over(along)) / 3).otherwise(F.col("z"))
    return flat.select("frame_id", "col", smooth.alias("ground_reference_z"))


def ground_reference(cells: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """Cells with ground_reference_z and top_height."""
    return cells.join(column_reference(cells, cfg), ["frame_id", "col"]).withColumn("top_height", F.col("max_z") - F.col("ground_reference_z"))


def layers(points: DataFrame, cells: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """Cells with height_range and occupied_layers."""
    n = F.greatest(F.lit(1), F.least(F.lit(cfg.max_layers), F.ceil((F.col("max_z") - F.col("min_z")) / cfg.layer))).cast("int")
    placed = to_cells(points, cfg).join(cells.select(*KEY, "min_z", "max_z"), KEY)
    layer = F.greatest(F.lit(0), F.least(n - 1, F.floor((F.col("z") - F.col("min_z")) / cfg.layer).cast("int")))
    counted = placed.groupBy(*KEY).agg(F.count_distinct(layer).cast("int").alias("occupied_layers"))
    return cells.join(counted, KEY, "left").withColumn("height_range", F.col("max_z") - F.col("min_z"))


def layer_histogram(points: DataFrame, cells: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """(frame_id, row, col, layer, n) of the non-empty layers; counts stop at 255."""
    n = F.greatest(F.lit(1), F.least(F.lit(cfg.max_layers), F.ceil((F.col("max_z") - F.col("min_z")) / cfg.layer))).cast("int")
    placed = to_cells(points, cfg).join(cells.select(*KEY, "min_z", "max_z"), KEY)
    layer = F.greatest(F.lit(0), F.least(n - 1, F.floor((F.col("z") - F.col("min_z")) / cfg.layer).cast("int")))
    return placed.groupBy(*KEY, layer.alias("layer")).agg(F.least(F.count(F.lit(1)), F.lit(255)).alias("n"))


def candidates(cells: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """Cells with is_vertical_structure and is_obstacle_candidate.

    Cells below the reference are skipped; high ranges in few layers are structures and no candidates; the others are
    candidates by their top, range and layers, unless enough neighbours are ground and taller than any candidate.
    """
    top = F.col("top_height")
    vertical = (top >= 0) & (F.col("height_range") > cfg.vertical_range) & (F.col("occupied_layers") <= cfg.vertical_layers)
    near = centre_x(cfg) < cfg.near_boundary
    fits = F.when(near, top.between(*cfg.top_near)).otherwise(top.between(*cfg.top_far))
    ruled = (top >= 0) & ~vertical & fits & (F.col("height_range") >= cfg.min_range) & (F.col("occupied_layers") >= cfg.min_layers)
    tall = cells.where(F.col("is_ground") & (top > cfg.top_far[1]))
    vetoed = neighbours(tall, []).groupBy(*KEY).agg(F.count(F.lit(1)).alias("tall")).where(F.col("tall") >= cfg.veto_neighbours).select(*KEY, F.lit(True).alias("veto"))
    out = cells.join(vetoed, KEY, "left")
    return out.withColumn("is_vertical_structure", vertical).withColumn("is_obstacle_candidate", ruled & F.col("veto").isNull()).drop("veto")


def ground_split(points: DataFrame, ground: DataFrame) -> DataFrame:
    """Placed points with label 1 in a ground cell and 0 elsewhere; ground holds the keys of the ground cells."""
    return join_checked(points, ground.select(*KEY, F.lit(1).alias("g")), KEY).withColumn("label", F.coalesce("g", F.lit(0))).drop("g")


#: Ground cells that are broadcast at most.
MOST_CELLS = 100_000


def reclassify(points: DataFrame, cells: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """Every finite point with row, col and is_obstacle; ground is what lies in a ground cell no more than a layer above the reference. Points outside the grid look nothing up."""
    x, y = F.col("x"), F.col("y")
    row = F.when((y >= cfg.y_min) & (y < cfg.y_max), F.least(F.floor((y - cfg.y_min) / cfg.resolution).cast("int"), F.lit(cfg.rows - 1)))
    col = F.when((x >= cfg.x_min) & (x < cfg.x_max), F.least(F.floor((x - cfg.x_min) / cfg.resolution).cast("int"), F.lit(cfg.cols - 1)))
    placed = finite(points).withColumn("row", row).withColumn("col", col)
    ground = cells.where("is_ground").select(*KEY, F.col("ground_reference_z").alias("ref"))
    obstacle = F.col("ref").isNull() | (F.col("z") > F.col("ref") + cfg.layer)
    if ground.limit(MOST_CELLS + 1).count() <= MOST_CELLS:  # one scan; nothing outside the grid meets a cell
        return placed.join(F.broadcast(ground), KEY, "left").withColumn("is_obstacle", obstacle).drop("ref")
    inside = placed.where("row IS NOT NULL AND col IS NOT NULL").join(ground.hint("merge"), KEY, "left").withColumn("is_obstacle", obstacle).drop("ref")
    outside = placed.where("row IS NULL OR col IS NULL").withColumn("is_obstacle", F.lit(True))
    return inside.unionByName(outside)


def ground(points: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """Cells with slope and is_ground. Cells are few against points and have many readers, so they are written once."""
    cells = materialize(build(points, cfg), "cells")
    return materialize(grow_ground(materialize(slope(cells, cfg), "slopes"), cfg), "ground")


def detect(points: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """Points to cells with all columns of the steps above."""
    return candidates(layers(points, ground_reference(ground(points, cfg), cfg), cfg), cfg)
