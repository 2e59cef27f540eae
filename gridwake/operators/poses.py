"""Poses as a time series: as-of lookup and freshness (M1 to M3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, poses: DataFrame, key: str = "stream_id", ts: str = "ts_ms", tie: str | None = None, slices_ms: int | None = 3_600_000) -> DataFrame:
    """M1: left rows with the columns of the latest pose at or before them, prefixed by pose_.

    Union and a running last: one shuffle, no range join. With slices_ms a stream is dealt over time slices, and each
    slice starts with the last pose of the slices before it, so a long stream is not one task.
    """
    columns = [c for c in poses.columns if c != key]
    pose = F.struct(*columns)
    a = left.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(poses.select(pose).schema[0].dataType).alias("_pose"))
    b = poses.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"), pose.alias("_pose"))
    order = ["_ts", "_side", F.col(f"_pose.{tie}") if tie else F.col("_side")]
    both = a.unionByName(b)
    if slices_ms is None:
        along = Window.partitionBy("_key").orderBy(*order)
        found = both.withColumn("_pose", F.last("_pose", True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        both = both.withColumn("_slice", F.floor(F.col("_ts") / slices_ms))
        rank = F.struct(F.col("_ts"), F.col(f"_pose.{tie}") if tie else F.lit(0))
        ends = both.where("_side = 0").groupBy("_key", "_slice").agg(F.max_by("_pose", rank).alias("_end"))
        spans = both.select("_key", "_slice").distinct().join(ends, ["_key", "_slice"], "left")
        before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = spans.select("_key", "_slice", F.last("_end", True).over(before).alias("_carried"))
        along = Window.partitionBy("_key", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_pose", F.last("_pose", True).over(along)).where("_side = 1").join(carried, ["_key", "_slice"], "left").withColumn("_side", F.lit(1)).withColumn("_pose", F.coalesce("_pose", "_carried"))
    return found.where("_side = 1").select("_row.*", *(F.col(f"_pose.{c}").alias(f"pose_{c}") for c in columns))


def freshness(joined: DataFrame, timeout_ms: int = 1000, ts: str = "ts_ms") -> DataFrame:
    """M2: joined rows with pose_age and pose_valid; a timeout of 0 stands for 1000."""
    limit = timeout_ms or 1000
    age = F.col(ts) - F.col(f"pose_{ts}")
    return joined.withColumn("pose_age", age).withColumn("pose_valid", F.coalesce((F.col(f"pose_{ts}") > 0) & (age <= limit), F.lit(False)))


def statistics(poses: DataFrame, key: str = "stream_id", ts: str = "ts_ms") -> DataFrame:
    """M3: number of poses and the last one of each stream."""
    return poses.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_ts"), F.max_by(F.struct("x", "y", "heading_deg"), F.struct(ts, "event_id") if "event_id" in poses.columns else F.col(ts)).alias("last_pose"))
