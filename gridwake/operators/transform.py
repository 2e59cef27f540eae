"""Transforms, filters and samplings of points (T rows): projections, filters and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.functions import geometry as geo
from gridwake.operators import tiles
from gridwake.plans.materialize import materialize


def rigid(points: DataFrame, matrix) -> DataFrame:
    """Points moved by a 3x4 or 4x4 matrix."""
    return points.withColumns(dict(zip("xyz", geo.rigid(matrix, F.col("x"), F.col("y"), F.col("z")))))


def install(points: DataFrame, install_type: Column) -> DataFrame:
    """Points with the axes of their sensor's mounting."""
    return points.withColumns(dict(zip("xyz", geo.flip(install_type, F.col("x"), F.col("y"), F.col("z")))))


def region(points: DataFrame, x_min: float, x_max: float, y_min: float, y_max: float) -> DataFrame:
    """T4: points strictly inside."""
    return points.where((F.col("x") > x_min) & (F.col("x") < x_max) & (F.col("y") > y_min) & (F.col("y") < y_max))


def height_band(points: DataFrame, low: float, high: float) -> DataFrame:
    """Points strictly between two heights."""
    return points.where((F.col("z") > low) & (F.col("z") < high))


def sides(points: DataFrame, x_min: float, x_max: float, y_left: float, y_right: float) -> DataFrame:
    """Points with side 'right' (x in [0, x_max]) or 'left' (x in [x_min, 0)), each within its own |y|."""
    x, y = F.col("x"), F.abs(F.col("y"))
    side = F.when((x >= 0) & (x <= x_max) & (y < y_right), "right").when((x >= x_min) & (x < 0) & (y < y_left), "left")
    return points.withColumn("side", side).where("side IS NOT NULL")


def voxels(points: DataFrame, leaf: float) -> DataFrame:
    """One centroid for each cube of the given edge."""
    keys = [F.floor(F.col(c) / leaf).alias(f"v{c}") for c in "xyz"]
    return points.groupBy("frame_id", *keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{c}") for c in "xyz")).select("frame_id", "vx", "vy", "vz", "n", *((F.col(f"s{c}") / F.col("n")).alias(c) for c in "xyz"))


def radius_outliers(points: DataFrame, radius: float, least: int, key: str = "point_id") -> DataFrame:
    """Points with at least so many others within the radius; keys tell the points of a frame apart."""
    enough = tiles.nearest(tiles.narrow(points, key), radius, least, key).where(F.size("near") >= least)
    return points.join(enough.select("frame_id", key), ["frame_id", key], "left_semi")


def _mean_distance(k: Column | int) -> Column:
    """Of an array of k squares, in order."""
    return F.aggregate("near", F.lit(0.0), lambda x, d2: x + F.sqrt(d2)) / k


def statistical_outliers_within(points: DataFrame, reach: float, k: int, factor: float, key: str = "point_id") -> DataFrame:
    """T10 with a bounded search: as statistical_outliers, but a point with fewer than k others within reach has no mean and goes."""
    near = tiles.nearest(tiles.narrow(points, key), reach, k, key).where(F.size("near") == k)
    means = materialize(near.select("frame_id", key, _mean_distance(k).alias("d")), "outlier_means")
    limits = means.groupBy("frame_id").agg((F.avg("d") + factor * F.stddev_samp("d")).alias("limit"))
    return points.join(means.join(limits, "frame_id").where("d <= limit").select("frame_id", key), ["frame_id", key], "left_semi")


def statistical_outliers(points: DataFrame, edge: float, k: int, factor: float, key: str = "point_id") -> DataFrame:
    """Points whose mean distance to their k nearest others is within mean + factor * deviation of their frame's.

    The others are looked for within the edge; points that have fewer than k there go to the next round, where the edge
    is doubled, so a round's points meet the whole frame and the result does not depend on the edge. In a frame of k points or
    fewer the mean is over all others, and a lone point stays. Points without finite coordinates go.
    """
    own = tiles.narrow(points, key)
    left = own.join(own.groupBy("frame_id").agg(F.least(F.count(F.lit(1)) - 1, F.lit(k)).alias("need")), "frame_id").select("frame_id", key, "need")
    done, some = left.where("need = 0").select("frame_id", key, F.lit(0.0).alias("d")), None
    left = left.where("need > 0")
    while left.limit(1).count():
        near = tiles.nearest(own, edge, k, key, some)
        found = materialize(left.join(near, ["frame_id", key]), "outlier_means")
        full = F.size("near") >= F.col("need")
        done = done.unionByName(found.where(full).select("frame_id", key, _mean_distance(F.col("need")).alias("d")))
        left = some = found.where(~full).select("frame_id", key, "need")
        edge *= 2
    limits = done.groupBy("frame_id").agg((F.avg("d") + factor * F.coalesce(F.stddev_samp("d"), F.lit(0.0))).alias("limit"))
    return points.join(done.join(limits, "frame_id").where("d <= limit").select("frame_id", key), ["frame_id", key], "left_semi")


def euclidean_links(points: DataFrame, tolerance: float, key: str = "point_id") -> DataFrame:
    """C4: (frame_id, a, b) pairs of points that touch, a < b."""
    return tiles.links(tiles.narrow(points, key), tolerance, key)


def euclidean_clusters(points: DataFrame, tolerance: float, least: int = 1, most: int | None = None, key: str = "point_id", max_rounds: int = 100) -> DataFrame:
    """C4: points with cluster_id, the smallest key of those that chains of touching points reach; clusters of fewer than least or more than most points are left out.

    Chains are followed inside tiles first. Labels of what is left then spread by joins: a tile's part takes the smallest label of
    those that go on in it, then the label of that label's part, so chains of tiles shorten by half each round.
    """
    found = materialize(tiles.parts(tiles.narrow(points, key), tolerance, key), "parts")
    here, around = found.where("here").select("frame_id", key, "part"), found.where("NOT here").select("frame_id", key, F.col("part").alias("other"))
    links = materialize(here.join(around, ["frame_id", key]).where("part <> other").select("frame_id", "part", "other").distinct(), "touching")
    both = links.unionByName(links.select("frame_id", F.col("other").alias("part"), F.col("part").alias("other")))
    own = materialize(both.select("frame_id", "part", F.col("part").alias("label")).distinct(), "labels")
    for _ in range(max_rounds):
        met = both.join(own.withColumnRenamed("part", "other"), ["frame_id", "other"]).select("frame_id", "part", "label")
        low = own.unionByName(met).groupBy("frame_id", "part").agg(F.min("label").alias("label"))
        jump = low.select("frame_id", F.col("label").alias("further"), F.col("part").alias("label"))
        new = materialize(low.join(jump, ["frame_id", "label"]).select("frame_id", "part", F.least("label", "further").alias("label")), "labels")
        if new.join(own, ["frame_id", "part", "label"], "left_anti").isEmpty():
            break
        own = new
    else:
        raise RuntimeError(f"clusters still grow after {max_rounds} rounds")
    # Points without finite coordinates are clusters of themselves.
    every = points.where(F.col("frame_id").isNotNull() & F.col(key).isNotNull()).select("frame_id", key).join(here, ["frame_id", key], "left").join(own, ["frame_id", "part"], "left")
    labels = materialize(every.select("frame_id", key, F.coalesce("label", "part", key).alias("label")), "labels")
    sizes = labels.groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & (F.col("n") <= most if most else F.lit(True)))
    named = labels.join(sizes.select("frame_id", "label"), ["frame_id", "label"], "left_semi").withColumnRenamed("label", "cluster_id")
    return points.join(named, ["frame_id", key])


def extract(points: DataFrame, indices: DataFrame, negative: bool = False, keys: tuple[str, ...] = ("frame_id", "point_id")) -> DataFrame:
    """The points that indices name, or with negative all others."""
    return points.join(indices.select(*keys).distinct(), list(keys), "left_anti" if negative else "left_semi")


def ring_id(elevation_deg: Column, lower: float, factor: float, rings: int) -> Column:
    """Ring number, null outside."""
    r = F.floor((elevation_deg - lower) * factor + 0.5).cast("int")
    return F.when((r >= 0) & (r < rings), r)


def image_column(azimuth_deg: Column, resolution: float, width: int) -> Column:
    """Column of a range image."""
    return F.greatest(F.lit(0), F.least(F.floor(azimuth_deg / resolution).cast("int"), F.lit(width - 1)))


def bright_low(points: DataFrame, intensity: float) -> DataFrame:
    """Bright points below the sensor."""
    return points.where((F.col("intensity") > intensity) & (F.col("z") < 0))


def conditional(points: DataFrame, conditions: list[Column], any_of: bool = True) -> DataFrame:
    """Points that meet one or all of the conditions."""
    test = conditions[0]
    for c in conditions[1:]:
        test = (test | c) if any_of else (test & c)
    return points.where(test)
