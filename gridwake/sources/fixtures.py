"""Sensor tables derived from the star-schema tables: deterministic, in whole millimetres; times are UTC sessions' times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, ring, x, y, z, intensity) of eight frames from lineitem."""
    e = F.expr
    return (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity")
        .select(
            e("l_orderkey % 8").alias("frame_id"),
            e("l_partkey % 16").cast("int").alias("ring"),
            e("900 + (l_partkey * 131 + l_linenumber * 1709 + l_orderkey * 37) % 7100").alias("x"),
            e("-3000 + (l_suppkey * 977 + l_orderkey * 613 + l_linenumber * 53) % 6000").alias("y"),
            "l_linenumber", "l_partkey", "l_returnflag",
            F.col("l_quantity").cast("int").alias("intensity"),
        )
        .withColumn("bx", e("(x div 800) % 4"))
        .withColumn("by", e("((y + 3000) div 700) % 4"))
        .withColumn(
            "z",
            e("""-1390 + (l_linenumber * 7 + l_partkey) % 40 + CASE
                WHEN bx = 2 AND by = 1 AND l_returnflag = 'R' THEN 130 + l_partkey % 200
                WHEN bx = 3 AND by = 3 AND l_returnflag = 'A' THEN 700 + l_partkey % 500
                WHEN bx = 1 AND by = 2 THEN 300 ELSE 0 END"""),
        )
        .select("frame_id", "ring", "x", "y", "z", "intensity")
    )


POINTS_SQL = """raw AS (SELECT l_orderkey % 8 AS frame_id, (l_partkey % 16)::INT AS ring,
  900 + (l_partkey * 131 + l_linenumber * 1709 + l_orderkey * 37) % 7100 AS x,
  -3000 + (l_suppkey * 977 + l_orderkey * 613 + l_linenumber * 53) % 6000 AS y,
  l_linenumber, l_partkey, l_returnflag, l_quantity::INT AS intensity FROM lineitem),
pts AS (SELECT frame_id, ring, x, y, -1390 + (l_linenumber * 7 + l_partkey) % 40 + CASE
  WHEN (x // 800) % 4 = 2 AND ((y + 3000) // 700) % 4 = 1 AND l_returnflag = 'R' THEN 130 + l_partkey % 200
  WHEN (x // 800) % 4 = 3 AND ((y + 3000) // 700) % 4 = 3 AND l_returnflag = 'A' THEN 700 + l_partkey % 500
  WHEN (x // 800) % 4 = 1 AND ((y + 3000) // 700) % 4 = 2 THEN 300 ELSE 0 END AS z, intensity FROM raw)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, seq, azimuth, ts_ms): azimuth blocks of one stream for each user of events."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.expr("(CAST(round(value * 100) AS BIGINT) * 7) % 36000").alias("azimuth"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))


BLOCKS_SQL = """blocks AS (SELECT user_id AS stream_id, event_id AS seq, (CAST(round(value * 100) AS BIGINT) * 7) % 36000 AS azimuth, epoch_us(ts) // 1000 AS ts_ms FROM events)"""


def packet_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, arrival, seq): packet numbers 1 to 60 of each user in order of arrival, every fifth pair swapped."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ranked = ev.selectExpr("user_id AS stream_id", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS arrival")
    return ranked.selectExpr("stream_id", "arrival", "1 + (CASE WHEN arrival % 10 = 3 THEN arrival + 1 WHEN arrival % 10 = 4 THEN arrival - 1 ELSE arrival END) % 60 AS seq")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, ts_ms, x, y, heading_deg) from the view events; positions in metres."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'view'")
    return ev.selectExpr("user_id % 8 AS stream_id", "unix_millis(CAST(ts AS TIMESTAMP)) AS ts_ms", "event_id", "CAST(user_id % 100 AS DOUBLE) AS x", "CAST(event_id % 50 AS DOUBLE) AS y", "CAST(event_id * 37 % 360 AS DOUBLE) AS heading_deg")


POSES_SQL = """poses AS (SELECT user_id % 8 AS stream_id, epoch_us(ts) // 1000 AS ts_ms, event_id, (user_id % 100)::DOUBLE AS x, (event_id % 50)::DOUBLE AS y, (event_id * 37 % 360)::DOUBLE AS heading_deg FROM events WHERE event_type = 'view')"""


def road_map(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Map tables from nation: a section and a lane for each nation, edges along the keys inside a region."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("CAST(n_nationkey AS BIGINT) + 1 AS id", "CAST(n_regionkey AS BIGINT) + 1 AS region")
    sections = n.selectExpr(
        "id AS section_id", "region AS road_id",
        "array(struct(CAST((id - 1) * 4 AS DOUBLE) AS x, 0D AS y), struct(CAST((id - 1) * 4 + 4 AS DOUBLE) AS x, 0D AS y)) AS left_line",
        "array(struct(CAST((id - 1) * 4 AS DOUBLE) AS x, 50D AS y), struct(CAST((id - 1) * 4 + 4 AS DOUBLE) AS x, 50D AS y)) AS right_line",
        "array(id) AS lane_ids",
    )
    lane_points = n.selectExpr("id AS lane_id", "explode(sequence(0, 10)) AS ord").selectExpr("lane_id", "ord", "CAST((lane_id - 1) * 4 + 2 AS DOUBLE) AS x", "CAST(ord * 5 AS DOUBLE) AS y")
    a, b = n.alias("a"), n.alias("b")
    edges = a.join(b, F.expr("a.region = b.region AND b.id = a.id + 1")).selectExpr("a.id AS src", "b.id AS dst")
    return {"sections": sections, "lane_points": lane_points, "edges": edges}
