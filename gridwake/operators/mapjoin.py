"""Road map joins: lanes near poses, sections, drivable polygons and the labels of obstacles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwake.functions import geometry as geo


def lanes_near(poses: DataFrame, lane_points: DataFrame, radius: float = 18.0, key: str = "pose_id") -> DataFrame:
    """M9: (pose, lane) with any centre point of the lane within the radius: an equi-join on squares of that edge, then the distance."""
    square = lambda c: F.floor(F.col(c) / radius)
    moves = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = poses.select(key, F.col("x").alias("px"), F.col("y").alias("py"), moves.alias("m"))
    a = a.select(key, "px", "py", (F.floor(F.col("px") / radius) + F.col("m.i")).alias("qx"), (F.floor(F.col("py") / radius) + F.col("m.j")).alias("qy"))
    b = lane_points.select("lane_id", "x", "y", square("x").alias("qx"), square("y").alias("qy"))
    return a.join(b, ["qx", "qy"]).where(geo.distance(F.col("px"), F.col("py"), F.col("x"), F.col("y")) <= radius).select(key, "lane_id").distinct()


def lane_sections(sections: DataFrame) -> DataFrame:
    """(lane_id, section_id); the last section that names a lane has it."""
    return sections.select("section_id", F.explode("lane_ids").alias("lane_id")).groupBy("lane_id").agg(F.max("section_id").alias("section_id"))


def section_roads(sections: DataFrame) -> DataFrame:
    """(section_id, road_id)."""
    return sections.groupBy("section_id").agg(F.max("road_id").alias("road_id"))


def road_junctions(roads: DataFrame, junctions: DataFrame) -> DataFrame:
    """(road_id, junction_id): the last junction, in the order of ids, that names the road among its connections; 0 is none."""
    named = junctions.select("junction_id", F.explode("connect").alias("road_id")).groupBy("road_id").agg(F.max("junction_id").alias("junction_id"))
    return roads.select("road_id").join(named, "road_id", "left").select("road_id", F.coalesce("junction_id", F.lit(0)).alias("junction_id"))


def current_section(near: DataFrame, sections: DataFrame, key: str = "pose_id") -> DataFrame:
    """The section of the first near lane that has one; lanes in the order of their ids."""
    return near.join(lane_sections(sections), "lane_id").where("section_id > 0").groupBy(key).agg(F.min_by("section_id", "lane_id").alias("section_id"))


def drivable_sections(current: DataFrame, edges: DataFrame, key: str = "pose_id") -> DataFrame:
    """The current section, the ones that lead to it and the ones it leads to."""
    into = current.join(edges, F.col("section_id") == F.col("dst")).select(key, F.col("src").alias("section_id"))
    onward = current.join(edges, F.col("section_id") == F.col("src")).select(key, F.col("dst").alias("section_id"))
    return current.select(key, "section_id").unionByName(into).unionByName(onward).distinct()


def polygons(sections: DataFrame) -> DataFrame:
    """(section_id, polygon): the left line and the right one backwards; rings of fewer than three corners are left out."""
    return sections.select("section_id", F.concat("left_line", F.reverse("right_line")).alias("polygon")).where(F.size("polygon") >= 3)


def label_clusters(clusters: DataFrame, sections_of_pose: DataFrame, rings: DataFrame, margin: float = 0.5, key: str = "pose_id", heading_offset: float = 0.0) -> DataFrame:
    """Clusters (with a pose as px, py, heading_deg, pose_valid and vx, vy in metres) with in_road, map_valid and confidence.

    A cluster meets the few polygons of its pose's sections by an equi-join; without a valid pose or polygons the map says nothing.
    """
    mx, my = geo.vehicle_to_map(F.col("vx"), F.col("vy"), F.col("px"), F.col("py"), F.col("heading_deg"), heading_offset)
    placed = clusters.withColumn("map_x", mx).withColumn("map_y", my)
    ids = [key, "cluster_id"]
    met = placed.where("pose_valid").select(*ids, "map_x", "map_y").join(sections_of_pose, key).join(rings, "section_id")
    found = met.groupBy(*ids).agg(F.max(geo.drivable(F.col("polygon"), F.col("map_x"), F.col("map_y"), margin)).alias("in_road"))
    out = placed.join(found, ids, "left")
    valid = F.col("in_road").isNotNull()
    return out.withColumn("map_valid", valid).withColumn("in_road", F.coalesce("in_road", F.lit(False))).withColumn("confidence", F.when(~F.col("map_valid"), F.lit(0.0)).when(F.col("in_road"), F.lit(1.0)).otherwise(F.lit(0.3)))


def keep_on_road(labelled: DataFrame, off_road: str = "drop", on_invalid_pose: str = "drop") -> DataFrame:
    """What follows from the labels: 'drop' or 'label' clusters off the road, 'drop' or 'keep' those the map says nothing about."""
    keep = F.col("in_road") | (F.lit(off_road == "label") & F.col("map_valid")) | (F.lit(on_invalid_pose == "keep") & ~F.col("map_valid"))
    return labelled.where(keep)


def boundary(lane_points: DataFrame, width: float) -> DataFrame:
    """Left and right border points of a lane whose points have a heading (theta, degrees clockwise from north)."""
    a = F.radians(90 - F.col("theta"))
    h = width / 2
    return lane_points.select("lane_id", "ord", (F.col("x") - h * F.sin(a)).alias("left_x"), (F.col("y") + h * F.cos(a)).alias("left_y"), (F.col("x") + h * F.sin(a)).alias("right_x"), (F.col("y") - h * F.cos(a)).alias("right_y"))


def headings(lane_points: DataFrame) -> DataFrame:
    """Lane points with theta, the heading towards the next point (the last has that of the one before)."""
    along = Window.partitionBy("lane_id").orderBy("ord")
    ahead = F.degrees(F.atan2(F.lead("x").over(along) - F.col("x"), F.lead("y").over(along) - F.col("y")))
    back = F.degrees(F.atan2(F.col("x") - F.lag("x").over(along), F.col("y") - F.lag("y").over(along)))
    return lane_points.withColumn("theta", F.coalesce(ahead, back))


def road_boundaries(sections: DataFrame) -> DataFrame:
    """(road_id, left_line, right_line): the lines of a road's sections one behind another."""
    rows = F.array_sort(F.collect_list(F.struct("section_id", "left_line", "right_line")))
    return sections.groupBy("road_id").agg(rows.alias("s")).select("road_id", F.flatten(F.col("s.left_line")).alias("left_line"), F.flatten(F.col("s.right_line")).alias("right_line"))


def statistics(sections: DataFrame, lane_points: DataFrame, edges: DataFrame) -> DataFrame:
    """How much the map holds."""
    n = F.count(F.lit(1)).alias("n")
    tables = (("sections", sections), ("lanes", lane_points.select("lane_id").distinct()), ("lane_points", lane_points), ("edges", edges))
    out = None
    for name, df in tables:
        row = df.agg(n).select(F.lit(name).alias("what"), "n")
        out = row if out is None else out.unionByName(row)
    return out
