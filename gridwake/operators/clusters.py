"""Connected obstacle cells, their summaries, oriented boxes and output records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.config import GridConfig
from gridwake.operators.grid import KEY, centre_x, neighbours
from gridwake.plans.materialize import materialize


def _components(rows: int, cols: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The smallest linear index of each cell's 8-connected component."""
    at = np.full((rows + 2, cols + 2), np.iinfo(np.int64).max)
    own = r * cols + c
    at[r + 1, c + 1] = own
    while True:
        low = own
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                low = np.minimum(low, at[r + 1 + dr, c + 1 + dc])
        # Pointer step: take over the label of the cell that the label names.
        low = at[low // cols + 1, low % cols + 1]
        if (low == own).all():
            return own
        own = np.minimum(own, low)
        at[r + 1, c + 1] = own


def connect(cells: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """Candidate cells with cluster_id, counted over all components by their smallest cell; small ones are left out."""
    rows, cols = cfg.rows, cfg.cols
    schema = cells.select(*KEY).schema.add("label", T.LongType())

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[KEY].copy()
        frame["label"] = _components(rows, cols, frame["row"].to_numpy().astype(np.int64), frame["col"].to_numpy().astype(np.int64))
        return frame

    labelled = cells.where("is_obstacle_candidate").select(*KEY).groupBy("frame_id").applyInPandas(label, schema)
    frame = Window.partitionBy("frame_id")
    named = labelled.withColumn("cluster_id", F.dense_rank().over(frame.orderBy("label")) - 1).withColumn("cells", F.count(F.lit(1)).over(Window.partitionBy("frame_id", "label")))
    return cells.join(named.where(F.col("cells") >= cfg.min_cluster_cells).select(*KEY, "cluster_id"), KEY)


def connect_rounds(cells: DataFrame, cfg: GridConfig = GridConfig(), max_rounds: int = 10_000) -> DataFrame:
    """G13 by joins: smallest labels spread until nothing changes. For grids too large for a group."""
    own = materialize(cells.where("is_obstacle_candidate").select(*KEY, (F.col("row") * cfg.cols + F.col("col")).cast("bigint").alias("label")), "labels")
    for _ in range(max_rounds):
        around = neighbours(own, ["label"]).select(*KEY, F.col("n_label").alias("label")).join(own.select(*KEY), KEY, "left_semi")
        new = materialize(own.unionByName(around).groupBy(*KEY).agg(F.min("label").alias("label")), "labels")
        if new.join(own, [*KEY, "label"], "left_anti").isEmpty():
            break
        own = new
    else:
        raise RuntimeError(f"labels still spread after {max_rounds} rounds")
    frame = Window.partitionBy("frame_id")
    named = own.withColumn("cluster_id", F.dense_rank().over(frame.orderBy("label")) - 1).withColumn("cells", F.count(F.lit(1)).over(Window.partitionBy("frame_id", "label")))
    return cells.join(named.where(F.col("cells") >= cfg.min_cluster_cells).select(*KEY, "cluster_id"), KEY)


def centre_y(cfg: GridConfig) -> Column:
    return F.lit(float(cfg.y_min)) + (F.col("row") + 0.5) * cfg.resolution


def summarise(clustered: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """Points, cells and axis-aligned box of each cluster."""
    half = cfg.resolution / 2
    x, y = centre_x(cfg), centre_y(cfg)
    box = clustered.groupBy("frame_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("point_num").alias("point_num"),
        (F.min(x) - half).alias("min_x"), (F.max(x) + half).alias("max_x"), (F.min(y) - half).alias("min_y"), (F.max(y) + half).alias("max_y"),
        F.min("min_z").alias("min_z"), F.max("max_z").alias("max_z"),
    )
    for a in "xyz":
        box = box.withColumn(f"centre_{a}", (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2).withColumn(f"size_{a}", F.col(f"max_{a}") - F.col(f"min_{a}"))
    return box


def oriented_boxes(clustered: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """Main axis, length and width of clusters of 3 cells or more; angles are in (-pi/2, pi/2], 0 without a main axis.

    Covariances come from whole-number sums of row and column, so that the order of rows plays no part.
    """
    n, r, c = F.count(F.lit(1)), F.col("row").cast("long"), F.col("col").cast("long")
    moments = clustered.groupBy("frame_id", "cluster_id").agg(n.alias("n"), F.sum(c).alias("sx"), F.sum(r).alias("sy"), F.sum(c * c).alias("sxx"), F.sum(r * r).alias("syy"), F.sum(c * r).alias("sxy")).where("n >= 3")
    # n^2 times the covariances, exact.
    moments = moments.select("frame_id", "cluster_id", "n", "sx", "sy", F.expr("n * sxx - sx * sx").alias("vx"), F.expr("n * syy - sy * sy").alias("vy"), F.expr("n * sxy - sx * sy").alias("vxy"))
    moments = moments.withColumn("angle", F.when((F.col("vxy") == 0) & (F.col("vx") >= F.col("vy")), F.lit(0.0)).otherwise(0.5 * F.atan2(2.0 * F.col("vxy"), (F.col("vx") - F.col("vy")).cast("double"))))
    on = clustered.join(moments, ["frame_id", "cluster_id"])
    dx, dy = F.col("col") - F.col("sx") / F.col("n"), F.col("row") - F.col("sy") / F.col("n")
    u, v = dx * F.cos("angle") + dy * F.sin("angle"), dy * F.cos("angle") - dx * F.sin("angle")
    out = on.groupBy("frame_id", "cluster_id", "n", "sx", "sy", "angle").agg(F.min(u).alias("u0"), F.max(u).alias("u1"), F.min(v).alias("v0"), F.max(v).alias("v1"))
    res = float(cfg.resolution)
    cx = F.lit(float(cfg.x_min)) + (F.col("sx") / F.col("n") + 0.5) * res
    cy = F.lit(float(cfg.y_min)) + (F.col("sy") / F.col("n") + 0.5) * res
    out = out.select("frame_id", "cluster_id", cx.alias("cx"), cy.alias("cy"), "angle", ((F.col("u1") - F.col("u0")) * res).alias("length"), ((F.col("v1") - F.col("v0")) * res).alias("width"))
    corner = lambda s, t: F.struct((F.col("cx") + s * F.col("length") / 2 * F.cos("angle") - t * F.col("width") / 2 * F.sin("angle")).alias("x"), (F.col("cy") + s * F.col("length") / 2 * F.sin("angle") + t * F.col("width") / 2 * F.cos("angle")).alias("y"))
    return out.withColumn("corners", F.array(corner(1, 1), corner(1, -1), corner(-1, -1), corner(-1, 1)))


def records(clusters: DataFrame, limit: int = 20) -> DataFrame:
    """One output record for each frame: up to `limit` obstacles in the order of their ids."""
    own = F.struct("cluster_id", "centre_x", "centre_y", "size_x", "size_y")
    return clusters.groupBy("frame_id").agg(F.slice(F.array_sort(F.collect_list(own)), 1, limit).alias("obstacles")).select("frame_id", (F.size("obstacles") > 0).cast("int").alias("return_val"), F.size("obstacles").alias("obs_num"), "obstacles")


def rotation_form(clusters: DataFrame, boxes: DataFrame) -> DataFrame:
    """Translation (3) and Rotation (9, about z, row by row) of each cluster."""
    both = clusters.join(boxes.select("frame_id", "cluster_id", "cx", "cy", "angle"), ["frame_id", "cluster_id"], "left")
    a = F.coalesce("angle", F.lit(0.0))
    zero, one = F.lit(0.0), F.lit(1.0)
    return both.select("frame_id", "cluster_id", F.array(F.coalesce("cx", "centre_x"), F.coalesce("cy", "centre_y"), F.col("centre_z").cast("double")).alias("translation"), F.array(F.cos(a), zero - F.sin(a), zero, F.sin(a), F.cos(a), zero, zero, zero, one).alias("rotation"))


def detections(clusters: DataFrame, boxes: DataFrame, map_enabled: bool = False) -> DataFrame:
    """One detection for each cluster, in the road or all of them without a map; the oriented box goes before the aligned one."""
    both = clusters.join(boxes.select("frame_id", "cluster_id", "cx", "cy", "length", "width", "angle"), ["frame_id", "cluster_id"], "left")
    if map_enabled:
        both = both.where("in_road")
    return both.select(
        "frame_id", "cluster_id", F.coalesce("cx", "centre_x").alias("x"), F.coalesce("cy", "centre_y").alias("y"), F.col("centre_z").cast("double").alias("z"),
        F.coalesce("length", "size_x").cast("double").alias("depth"), F.coalesce("width", "size_y").cast("double").alias("width"), F.col("size_z").cast("double").alias("height"), F.coalesce("angle", F.lit(0.0)).alias("angle"),
    )
