"""The analytic content of debug layers (V rows): classes, ramps and counts for each cell or frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.config import GridConfig
from gridwake.plans.materialize import materialize


def height_ramp(cells: DataFrame) -> DataFrame:
    """V1: cells with ramp, 0 to 3, the quarter of their frame's span of min_z that they lie in."""
    frame = Window.partitionBy("frame_id")
    low, high = F.min("min_z").over(frame), F.max("min_z").over(frame)
    return cells.withColumn("ramp", F.coalesce(F.least(F.lit(3), F.floor(F.try_divide((F.col("min_z") - low) * 4, high - low)).cast("int")), F.lit(0)))


def ground_classes(cells: DataFrame, cfg: GridConfig | None = None) -> DataFrame:
    """V2: how many cells of each class a frame has: interpolated (if cells say so), ground and other; with a grid, also the invalid rest of it."""
    kind = F.when(F.col("is_ground"), "ground").otherwise("other")
    if "is_interpolated_ground" in cells.columns:
        kind = F.when(F.col("is_interpolated_ground"), "interpolated").otherwise(kind)
    out = cells.groupBy("frame_id", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    if cfg is None:
        return out
    rest = cells.groupBy("frame_id").agg((F.lit(cfg.rows * cfg.cols) - F.count(F.lit(1))).alias("n"))
    return out.unionByName(rest.select("frame_id", F.lit("invalid").alias("class"), "n"))


def reference_ramp(cells: DataFrame) -> DataFrame:
    """V4: cells with ramp, 0 to 3, the quarter of their frame's span of the ground reference that they lie in."""
    frame = Window.partitionBy("frame_id")
    low, high = F.min("ground_reference_z").over(frame), F.max("ground_reference_z").over(frame)
    return cells.withColumn("ramp", F.coalesce(F.least(F.lit(3), F.floor(F.try_divide((F.col("ground_reference_z") - low) * 4, high - low)).cast("int")), F.lit(0)))


def slope_ramp(slope: Column, limit: float) -> Column:
    """V3: 0 flat, 1 below half the limit, 2 below it, 3 above."""
    return F.when(slope == 0, 0).when(slope < limit / 2, 1).when(slope <= limit, 2).otherwise(3)


def candidate_counts(cells: DataFrame) -> DataFrame:
    """V5: candidates, vertical structures and other cells of each frame."""
    return cells.groupBy("frame_id").agg(F.count_if("is_obstacle_candidate").alias("candidates"), F.count_if("is_vertical_structure").alias("vertical"), F.count(F.lit(1)).alias("cells"))


def hue(cluster_id: Column) -> Column:
    """V6: golden-ratio hue in [0, 1)."""
    h = cluster_id * 0.618033988749895
    return h - F.floor(h)


def pixel(x: Column, y: Column, x_min: float, y_min: float, per_pixel: float, height: int) -> tuple[Column, Column]:
    """Column and row of an image with y upwards."""
    return F.floor((x - x_min) / per_pixel).cast("int"), (height - 1 - F.floor((y - y_min) / per_pixel)).cast("int")


def _outline(corners: Column, x_min: float, y_min: float, per_pixel: float, height: int) -> Column:
    def place(c: Column) -> Column:
        u, v = pixel(c["x"], c["y"], x_min, y_min, per_pixel, height)
        return F.struct(u.alias("u"), v.alias("v"))

    return F.transform(corners, place)


def box_outlines(boxes: DataFrame, x_min: float, y_min: float, per_pixel: float, height: int) -> DataFrame:
    """V7: (frame_id, shape 'box', id, outline, hue) of oriented boxes, in pixels."""
    return boxes.select("frame_id", F.lit("box").alias("shape"), F.col("cluster_id").cast("long").alias("id"), _outline(F.col("corners"), x_min, y_min, per_pixel, height).alias("outline"), hue(F.col("cluster_id")).alias("hue"))


def cluster_overlay(points: DataFrame, boxes: DataFrame, x_min: float, y_min: float, per_pixel: float, height: int, polygons: DataFrame | None = None) -> DataFrame:
    """V8: one table of shapes: points (with is_obstacle) as one pixel each that any of them covers, boxes as outlines, and polygons (frame_id, section_id, polygon in vehicle coordinates), if given."""
    return _points_layer(points, x_min, y_min, per_pixel, height).unionByName(box_outlines(boxes, x_min, y_min, per_pixel, height)).unionByName(_polygon_layer(polygons, boxes, x_min, y_min, per_pixel, height))


def track_overlay(points: DataFrame, tracks: DataFrame, x_min: float, y_min: float, per_pixel: float, height: int, seconds: float = 1.0) -> DataFrame:
    """V9: points as in V8, tracks (frame_id, track_id, x, y, vx, vy, corners or null) as outlines, and as arrows from where they are to where they will be after so many seconds."""
    tip = F.array(F.struct("x", "y"), F.struct((F.col("x") + F.col("vx") * seconds).alias("x"), (F.col("y") + F.col("vy") * seconds).alias("y")))
    shapes = [tracks.select("frame_id", F.lit("arrow").alias("shape"), F.col("track_id").alias("id"), tip.alias("corners")), tracks.where("corners IS NOT NULL").select("frame_id", F.lit("track").alias("shape"), F.col("track_id").alias("id"), "corners")]
    rows = shapes[0].unionByName(shapes[1])
    rows = rows.select("frame_id", "shape", "id", _outline(F.col("corners"), x_min, y_min, per_pixel, height).alias("outline"), hue(F.col("id")).alias("hue"))
    return _points_layer(points, x_min, y_min, per_pixel, height).unionByName(rows)


def _points_layer(points: DataFrame, x_min: float, y_min: float, per_pixel: float, height: int) -> DataFrame:
    u, v = pixel(F.col("x"), F.col("y"), x_min, y_min, per_pixel, height)
    # Obstacles are drawn over ground.
    dots = points.groupBy("frame_id", u.alias("u"), v.alias("v")).agg(F.max(F.col("is_obstacle").cast("int")).alias("top"))
    return dots.select("frame_id", F.when(F.col("top") == 1, "obstacle").otherwise("ground").alias("shape"), F.lit(None).cast("long").alias("id"), F.array(F.struct("u", "v")).alias("outline"), F.lit(None).cast("double").alias("hue"))


def _polygon_layer(polygons: DataFrame | None, boxes: DataFrame, x_min: float, y_min: float, per_pixel: float, height: int) -> DataFrame:
    if polygons is None:
        return box_outlines(boxes.where("false"), x_min, y_min, per_pixel, height)
    return polygons.select("frame_id", F.lit("polygon").alias("shape"), F.col("section_id").cast("long").alias("id"), _outline(F.col("polygon"), x_min, y_min, per_pixel, height).alias("outline"), F.lit(None).cast("double").alias("hue"))


def bird_eye(x: Column, y: Column, scale: float, off_x: float, off_y: float) -> tuple[Column, Column]:
    """Pixel (u, v) of a point or of a lane's end, x forward and y left, with fractions cut towards 0."""
    return (-y * scale + off_x).cast("int"), (x * scale + off_y).cast("int")


def bird_eye_points(points: DataFrame, scale: float, off_x: float, off_y: float, width: int, height: int) -> DataFrame:
    """(frame_id, u, v, n) of the pixels inside the image that points fall on."""
    u, v = bird_eye(F.col("x"), F.col("y"), scale, off_x, off_y)
    return points.select("frame_id", u.alias("u"), v.alias("v")).where((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height)).groupBy("frame_id", "u", "v").agg(F.count(F.lit(1)).alias("n"))


def lane_pixels(lanes: DataFrame, scale: float, off_x: float, off_y: float) -> DataFrame:
    """Lanes (any keys, x0, y0, x1, y1) with the pixels u0, v0, u1, v1 of their ends."""
    (u0, v0), (u1, v1) = (bird_eye(F.col(f"x{k}"), F.col(f"y{k}"), scale, off_x, off_y) for k in (0, 1))
    return lanes.withColumns({"u0": u0, "v0": v0, "u1": u1, "v1": v1})


def nearest_vertex(points: DataFrame, vertices: DataFrame, cell: float, key: str) -> DataFrame:
    """(key, vertex_id, distance): the nearest vertex of each point, at any distance; the smaller id of equals.

    Points meet the vertices of their own and the eight squares around; one whose nearest lies within a square's width is
    settled, the others look again in squares twice as wide, so the edge changes the work and not the result. Without
    vertices there are no rows; points without finite coordinates have none.
    """
    known = vertices.where(F.abs("x").between(0, 1e300) & F.abs("y").between(0, 1e300)).select("vertex_id", F.col("x").alias("vx"), F.col("y").alias("vy"))
    left = points.where(F.abs("x").between(0, 1e300) & F.abs("y").between(0, 1e300)).select(key, "x", "y")
    moves = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    d = F.hypot(F.col("x") - F.col("vx"), F.col("y") - F.col("vy"))
    done = left.limit(0).select(key, F.lit(None).cast(vertices.schema["vertex_id"].dataType).alias("vertex_id"), F.lit(0.0).alias("distance"))
    if known.isEmpty():
        return done
    while not left.isEmpty():
        a = left.select(key, "x", "y", moves.alias("m")).select(key, "x", "y", (F.floor(F.col("x") / cell) + F.col("m.i")).alias("qx"), (F.floor(F.col("y") / cell) + F.col("m.j")).alias("qy"))
        b = known.withColumn("qx", F.floor(F.col("vx") / cell)).withColumn("qy", F.floor(F.col("vy") / cell))
        best = a.join(b, ["qx", "qy"]).where(d <= cell).groupBy(key).agg(F.min_by("vertex_id", F.struct(d, "vertex_id")).alias("vertex_id"), F.min(d).alias("distance"))
        found = materialize(left.join(best, key, "left"), "vertices")
        done = done.unionByName(found.where("vertex_id IS NOT NULL").select(key, "vertex_id", "distance"))
        left, cell = found.where("vertex_id IS NULL").select(key, "x", "y"), 2 * cell
    return done


def box_edges(corners: Column) -> dict[str, Column]:
    """Extent of corner structs."""
    xs, ys = F.transform(corners, lambda c: c["x"]), F.transform(corners, lambda c: c["y"])
    return {"min_x": F.array_min(xs), "max_x": F.array_max(xs), "min_y": F.array_min(ys), "max_y": F.array_max(ys)}
