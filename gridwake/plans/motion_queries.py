"""Queries of transforms, decoding, framing, poses, map joins, lines, tracks and layers, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.config import GridConfig
from gridwake.functions import geometry as geo
from gridwake.operators import clusters as C
from gridwake.operators import decode as D
from gridwake.operators import framing, lines, mapjoin, poses, tracking
from gridwake.operators import grid as G
from gridwake.operators import layers as V
from gridwake.operators import transform as T
from gridwake.plans.grid_queries import BOX_SQL, CAND_SQL, CFG, CELLS_SQL, GROUND_SQL, SLOPE_SQL, _clustered, _detected, _ground, _with
from gridwake.sources import fixtures
from gridwake.sources.fixtures import BLOCKS_SQL, POINTS_SQL, POSES_SQL

#: Whole-number matrix: a quarter turn about z and a shift, so that both engines agree to the last bit.
TURN = [[0, -1, 0, 150], [1, 0, 0, -40], [0, 0, 1, 7]]
Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _each(df: DataFrame, *by: str) -> DataFrame:
    """Every point, in whole millimetres."""
    return df.select("frame_id", *by, *(F.col(c).cast("long").alias(c) for c in "xyz"))


_S = "x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z"
P = POINTS_SQL


@query("t01_rigid_transform", f"WITH {P}, m AS (SELECT frame_id, 150 - y AS x, x - 40 AS y, z + 7 AS z FROM pts) SELECT frame_id, {_S} FROM m")
def t01(spark: SparkSession, sf: str) -> DataFrame:
    return _each(T.rigid(fixtures.points(spark, sf), TURN))


@query("t02_install_flip", f"WITH {P}, m AS (SELECT frame_id, CASE WHEN frame_id = 3 THEN z ELSE x END AS x, CASE WHEN frame_id % 2 = 0 THEN -y ELSE y END AS y, CASE WHEN frame_id % 2 = 0 THEN -z WHEN frame_id = 3 THEN -x ELSE z END AS z FROM pts) SELECT frame_id, {_S} FROM m")
def t02(spark, sf):
    kind = F.when(F.col("frame_id") % 2 == 0, 1).when(F.col("frame_id") == 3, -3).otherwise(0)
    return _each(T.install(fixtures.points(spark, sf), kind))


@query("t03_composed_transform", f"WITH {P}, m AS (SELECT frame_id, y + 20 AS x, x + 10 AS y, -z AS z FROM pts) SELECT frame_id, {_S} FROM m")
def t03(spark, sf):
    identity = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]]
    return _each(T.rigid(fixtures.points(spark, sf), geo.compose(identity, 0.0, 10, 20)))


@query("t04_region_filter", f"WITH {P} SELECT frame_id, {_S} FROM pts WHERE x > 1200 AND x < 6000 AND y > -2000 AND y < 2000")
def t04(spark, sf):
    return _each(T.region(fixtures.points(spark, sf), 1200, 6000, -2000, 2000))


@query("t05_finite_filter", f"WITH {P} SELECT frame_id, {_S} FROM pts WHERE intensity <> 7")
def t05(spark, sf):
    p = fixtures.points(spark, sf).withColumn("w", F.when(F.col("intensity") == 7, F.lit(float("nan"))).otherwise(F.col("x").cast("double")))
    return _each(G.finite(p, "w", "y", "z"))


@query("t06_height_band", f"WITH {P} SELECT frame_id, {_S} FROM pts WHERE z > -1380 AND z < -1200")
def t06(spark, sf):
    return _each(T.height_band(fixtures.points(spark, sf), -1380, -1200))


@query("t07_sides", f"WITH {P}, m AS (SELECT frame_id, x - 4000 AS x, y, z FROM pts), s AS (SELECT *, CASE WHEN x >= 0 AND x <= 3000 AND abs(y) < 2000 THEN 'right' WHEN x >= -2500 AND x < 0 AND abs(y) < 2500 THEN 'left' END AS side FROM m) SELECT frame_id, side, {_S} FROM s WHERE side IS NOT NULL")
def t07(spark, sf):
    return _each(T.sides(fixtures.points(spark, sf).withColumn("x", F.col("x") - 4000), -2500, 3000, 2500, 2000), "side")


@query("t08_voxels", f"WITH {P} SELECT frame_id, floor(x / 400.0)::BIGINT AS vx, floor(y / 400.0)::BIGINT AS vy, floor(z / 400.0)::BIGINT AS vz, count(*) AS n, round(sum(x) / count(*), 6) AS x, round(sum(y) / count(*), 6) AS y, round(sum(z) / count(*), 6) AS z FROM pts GROUP BY 1, 2, 3, 4")
def t08(spark, sf):
    return T.voxels(fixtures.points(spark, sf), 400.0).select("frame_id", "vx", "vy", "vz", "n", *(F.round(c, 6).alias(c) for c in "xyz"))


def _numbered(spark, sf):
    """The points of small parts, numbered by order and line."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.selectExpr("l_orderkey % 8 AS frame_id", "l_orderkey * 10 + l_linenumber AS point_id", "(l_partkey * 131 + l_orderkey * 37) % 7100 AS x", "(l_suppkey * 977 + l_orderkey * 613) % 6000 AS y", "l_partkey % 40 AS z").groupBy("frame_id", "point_id").agg(*(F.min(c).alias(c) for c in "xyz"))


NUM = "num AS (SELECT l_orderkey % 8 AS frame_id, l_orderkey * 10 + l_linenumber AS point_id, min((l_partkey * 131 + l_orderkey * 37) % 7100) AS x, min((l_suppkey * 977 + l_orderkey * 613) % 6000) AS y, min(l_partkey % 40) AS z FROM lineitem GROUP BY 1, 2)"
NEAR = f"{NUM}, near AS (SELECT a.frame_id, a.point_id, b.point_id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM num a JOIN num b ON a.frame_id = b.frame_id AND b.x BETWEEN a.x - 60 AND a.x + 60 AND b.y BETWEEN a.y - 60 AND a.y + 60 AND a.point_id <> b.point_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 3600)"


@query("t09_radius_outliers", f"WITH {NEAR} SELECT frame_id, point_id FROM near GROUP BY 1, 2 HAVING count(*) >= 3")
def t09(spark, sf):
    return T.radius_outliers(_numbered(spark, sf), 60, 3).select("frame_id", "point_id")


@query("t10_statistical_outliers", f"WITH {NEAR}, k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, point_id ORDER BY d2, other) AS r FROM near), m AS (SELECT frame_id, point_id, avg(sqrt(d2)) AS d FROM k WHERE r <= 2 GROUP BY 1, 2 HAVING count(*) = 2), l AS (SELECT frame_id, avg(d) + stddev_samp(d) AS lim FROM m GROUP BY 1) SELECT frame_id, point_id FROM m JOIN l USING (frame_id) WHERE d <= lim")
def t10(spark, sf):
    return T.statistical_outliers_within(_numbered(spark, sf), 60, 2, 1.0).select("frame_id", "point_id")


@query("t10_statistical_outliers_all", f"WITH {NUM}, p AS (SELECT a.frame_id, a.point_id, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 2) AS near FROM num a JOIN num b ON a.frame_id = b.frame_id AND a.point_id <> b.point_id GROUP BY 1, 2), m AS (SELECT frame_id, point_id, (sqrt(near[1]) + sqrt(near[2])) / 2 AS d FROM p), l AS (SELECT frame_id, avg(d) + stddev_samp(d) AS lim FROM m GROUP BY 1) SELECT frame_id, point_id FROM m JOIN l USING (frame_id) WHERE d <= lim")
def t10_all(spark, sf):
    return T.statistical_outliers(_numbered(spark, sf), 60, 2, 1.0).select("frame_id", "point_id")


@query("c04_euclidean_links", f"WITH {NEAR} SELECT frame_id, point_id AS a, other AS b FROM near WHERE point_id < other")
def c04(spark, sf):
    return T.euclidean_links(_numbered(spark, sf), 60)


@query("t11_ring_id", f"WITH {P}, r AS (SELECT frame_id, floor((intensity - 10) * 0.5 + 0.5)::INT AS q FROM pts) SELECT frame_id, CASE WHEN q >= 0 AND q < 16 THEN q ELSE -1 END AS ring_id, count(*) AS n FROM r GROUP BY 1, 2")
def t11(spark, sf):
    return fixtures.points(spark, sf).groupBy("frame_id", F.coalesce(T.ring_id(F.col("intensity"), 10, 0.5, 16), F.lit(-1)).alias("ring_id")).agg(F.count(F.lit(1)).alias("n"))


@query("t12_range_image", f"WITH {P} SELECT frame_id, ring, greatest(0, least(floor((((x + y) % 360 + 360) % 360) / 0.5)::INT, 699)) AS col, count(*) AS n FROM pts GROUP BY 1, 2, 3")
def t12(spark, sf):
    p = fixtures.points(spark, sf)
    return p.groupBy("frame_id", "ring", T.image_column(F.expr("pmod(x + y, 360)"), 0.5, 700).alias("col")).agg(F.count(F.lit(1)).alias("n"))


@query("t13_bright_low", f"WITH {P} SELECT frame_id, {_S} FROM pts WHERE intensity > 30 AND z < 0")
def t13(spark, sf):
    return _each(T.bright_low(fixtures.points(spark, sf), 30))


@query("t14_conditional", f"WITH {P} SELECT frame_id, {_S} FROM pts WHERE x < 1500 OR y > 2500 OR z > -1000")
def t14(spark, sf):
    return _each(T.conditional(fixtures.points(spark, sf), [F.col("x") < 1500, F.col("y") > 2500, F.col("z") > -1000]))


# --- decoding -----------------------------------------------------------------------------------------------------

ANG = "ang AS (SELECT s_nationkey AS sensor_id, s_suppkey AS channel, (s_acctbal * 100)::BIGINT % 90 AS vert FROM supplier)"


@query("d01_packet_router", "SELECT CASE event_id % 4 WHEN 0 THEN 'msop' WHEN 1 THEN 'difop' WHEN 2 THEN 'imu' ELSE 'none' END AS kind, count(*) AS n FROM events GROUP BY 1")
def d01(spark, sf):
    head = F.element_at(F.array(*(F.unhex(F.lit(h)) for h in ("55AA", "A5FF", "AA55", "0000"))), (F.col("event_id") % 4 + 1).cast("int"))
    packets = spark.read.parquet(f"{sf}/events.parquet").select(F.concat(head, F.lit("x").cast("binary")).alias("payload"))
    return D.route(packets).groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("d02_packet_gate", "SELECT CASE WHEN event_id % 5 = 0 THEN 'wrong_length' WHEN event_id % 3 = 0 THEN 'wrong_id' ELSE 'ok' END AS reject_reason, count(*) AS n FROM events GROUP BY 1")
def d02(spark, sf):
    good, short, other = F.unhex(F.lit("55AA0102")), F.unhex(F.lit("55AA01")), F.unhex(F.lit("55AB0102"))
    packets = spark.read.parquet(f"{sf}/events.parquet").select(F.when(F.col("event_id") % 5 == 0, short).when(F.col("event_id") % 3 == 0, other).otherwise(good).alias("payload"))
    return D.gate(packets, 4, "55AA").groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reject_reason")).agg(F.count(F.lit(1)).alias("n"))


@query("d05_timestamps", "SELECT event_id, round(epoch_us(ts) / 1000000.0::DOUBLE, 3) AS seconds FROM events")
def d05(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    hexed = lambda c, n: F.unhex(F.lpad(F.hex(c), n, "0"))
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.concat(hexed(F.floor(us / 1_000_000), 12), hexed(us % 1_000_000, 8)).alias("payload"))
    return ev.select("event_id", F.round(D.utc_seconds(F.col("payload"), 0), 3).alias("seconds"))


@query("d06_temperature", "SELECT event_id, CASE WHEN (event_id // 256) % 256 >= 128 THEN -1 ELSE 1 END * (((event_id // 256) % 128) * 32 + (event_id % 256) // 8) * 0.0625::DOUBLE AS celsius FROM events")
def d06(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", D.temperature(F.col("event_id") % 256, F.expr("(event_id div 256) % 256")).cast("double").alias("celsius"))


@query("d07_calibration_angles", "SELECT event_id, CASE WHEN event_id % 3 <> 2 AND a >= -9000 AND a < 18000 THEN a ELSE 99999 END AS angle FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id * 7 % 30000 ELSE -(event_id * 7 % 30000) END AS a FROM events)")
def d07(spark, sf):
    sign = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(255)), (F.col("event_id") % 3 + 1).cast("int"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.coalesce(D.calibration_angle(sign, F.col("event_id") * 7 % 30000), F.lit(99999)).alias("angle"))


@query("d08_channel_rank", f"WITH {ANG} SELECT sensor_id, channel, vert, rank() OVER (PARTITION BY sensor_id ORDER BY vert) - 1 AS user_channel FROM ang")
def d08(spark, sf):
    ang = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_nationkey AS sensor_id", "s_suppkey AS channel", "CAST(round(s_acctbal * 100) AS BIGINT) % 90 AS vert")
    return D.channel_rank(ang).select("sensor_id", "channel", "vert", F.col("user_channel").cast("long").alias("user_channel"))


BLK = f"{BLOCKS_SQL}, blk AS (SELECT stream_id, r // 12 AS seq, (r % 12)::INT AS blk, azimuth FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) - 1 AS r FROM blocks))"


def _blk(spark, sf):
    b = fixtures.blocks(spark, sf).selectExpr("stream_id", "azimuth", "row_number() OVER (PARTITION BY stream_id ORDER BY seq) - 1 AS r")
    return b.selectExpr("stream_id", "CAST(r div 12 AS BIGINT) AS seq", "CAST(r % 12 AS INT) AS blk", "azimuth")


def _steps_sql(group: int) -> str:
    return f"""WITH {BLK}, h AS (SELECT stream_id, seq, blk // {group} AS g, arg_min(azimuth, blk) AS a FROM blk GROUP BY 1, 2, 3),
d AS (SELECT *, lead(a) OVER w - a AS q FROM h WINDOW w AS (PARTITION BY stream_id, seq ORDER BY g)), e AS (SELECT *, CASE WHEN q < 0 THEN q + 36000 ELSE q END AS raw FROM d),
s AS (SELECT *, CASE WHEN raw IS NULL OR raw > 10000 THEN 20 ELSE raw END AS az_step, coalesce(sum(CASE WHEN raw > 10000 THEN 7.5::DOUBLE ELSE 55.5::DOUBLE END) OVER (PARTITION BY stream_id, seq ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS off FROM e)
SELECT b.stream_id, b.seq, b.blk, b.azimuth, s.az_step, round(s.off, 3) AS "offset" FROM blk b JOIN s ON b.stream_id = s.stream_id AND b.seq = s.seq AND b.blk // {group} = s.g"""


@query("d10_block_steps", _steps_sql(1))
def d10(spark, sf):
    return D.block_steps(_blk(spark, sf), "single", 20, 55.5, 7.5, 10000).select("stream_id", "seq", "blk", "azimuth", F.col("az_step").cast("long").alias("az_step"), F.round("offset", 3).alias("offset"))


@query("d10_block_steps_dual", _steps_sql(2))
def d10_dual(spark, sf):
    return D.block_steps(_blk(spark, sf), "dual", 20, 55.5, 7.5, 10000).select("stream_id", "seq", "blk", "azimuth", F.col("az_step").cast("long").alias("az_step"), F.round("offset", 3).alias("offset"))


@query("d11_trig_table", f"WITH {BLOCKS_SQL}, a AS (SELECT DISTINCT azimuth * 2 - 9500 AS a FROM blocks) SELECT a AS angle, round(sin(radians(CASE WHEN a >= -9000 AND a < 45000 THEN a ELSE 0 END / 100.0)), 6) + 0.0 AS s FROM a")
def d11(spark, sf):
    a = fixtures.blocks(spark, sf).select((F.col("azimuth") * 2 - 9500).alias("angle")).distinct()
    return a.select("angle", (F.round(D.trig(F.col("angle")), 6) + 0.0).alias("s"))


@query("d12_distance_section", "SELECT event_id FROM events WHERE value BETWEEN 10 AND 50")
def d12(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").where(D.in_range(F.col("value"), 0.4, 230, 10, 50)).select("event_id")


@query("d13_azimuth_section", f"WITH {BLOCKS_SQL} SELECT stream_id, seq FROM blocks WHERE azimuth >= 30000 OR azimuth < 6000")
def d13(spark, sf):
    return fixtures.blocks(spark, sf).where(D.in_section(F.col("azimuth"), 30000, 42000)).select("stream_id", "seq")


@query("d14_polar_points", """WITH p AS (SELECT event_id, event_id % 360 AS az, event_id % 30 - 15 AS v, event_id % 200 + 1 AS d FROM events)
SELECT event_id, round(d * cos(radians(v)) * cos(radians(az)) + 0.03 * cos(radians(az)), 6) + 0.0 AS x, round(-(d * cos(radians(v)) * sin(radians(az)) + 0.03 * sin(radians(az))), 6) + 0.0 AS y, round(d * sin(radians(v)) + 0.01, 6) + 0.0 AS z FROM p""")
def d14(spark, sf):
    az, v, d = F.col("event_id") % 360 * 100, (F.col("event_id") % 30 - 15) * 100, F.col("event_id") % 200 + 1
    x, y, z = D.polar_xyz(d, v, az, az, 0.03, 0.01)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", *((F.round(c, 6) + 0.0).alias(n) for n, c in zip("xyz", (x, y, z))))


@query("d15_yaw_pitch_points", """WITH p AS (SELECT event_id, event_id % 120 - 60 AS yaw, event_id % 25 - 12 AS pitch, event_id % 200 + 1 AS d FROM events)
SELECT event_id, round(d * cos(radians(pitch)) * cos(radians(yaw)), 6) + 0.0 AS x, round(d * cos(radians(pitch)) * sin(radians(yaw)), 6) + 0.0 AS y, round(d * sin(radians(pitch)), 6) + 0.0 AS z FROM p""")
def d15(spark, sf):
    x, y, z = D.yaw_pitch_xyz(F.col("event_id") % 200 + 1, (F.col("event_id") % 120 - 60) * 100, (F.col("event_id") % 25 - 12) * 100)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", *((F.round(c, 6) + 0.0).alias(n) for n, c in zip("xyz", (x, y, z))))


@query("d16_vector_points", "SELECT event_id, (event_id % 1000) * (event_id % 50) / 32768.0::DOUBLE AS x, (event_id % 700) * (event_id % 50) / 32768.0::DOUBLE AS y, -(event_id % 300) * (event_id % 50) / 32768.0::DOUBLE AS z FROM events")
def d16(spark, sf):
    e = F.col("event_id")
    x, y, z = D.vector_xyz(e % 50, e % 1000, e % 700, -(e % 300))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", x.alias("x"), y.alias("y"), z.alias("z"))


@query("d18_feature_split", "SELECT event_id, (event_id * 97) % 65536 & 16383 AS distance, ((event_id * 97) % 65536) >> 14 AS feature FROM events")
def d18(spark, sf):
    d, f = D.split_feature(F.col("event_id") * 97 % 65536)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", d.alias("distance"), f.cast("long").alias("feature"))


@query("d25_echoes", "SELECT 1 + event_id % 2 AS echo, count(*) AS n FROM events WHERE 1 + event_id % 2 = 2 GROUP BY 1")
def d25(spark, sf):
    return D.echoes(spark.read.parquet(f"{sf}/events.parquet").selectExpr("1 + event_id % 2 AS echo"), 2).groupBy("echo").agg(F.count(F.lit(1)).alias("n"))


# --- framing ------------------------------------------------------------------------------------------------------

F1 = f"""{BLOCKS_SQL}, b AS (SELECT *, lag(azimuth, 1, 9000) OVER (PARTITION BY stream_id ORDER BY seq) AS p FROM blocks),
c AS (SELECT *, CASE WHEN azimuth < p THEN p - 36000 ELSE p END AS q FROM b), framed AS (SELECT *, sum(CASE WHEN q < 9000 AND 9000 <= azimuth THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq)::BIGINT AS frame FROM c)"""


@query("f01_split_by_angle", f"WITH {F1} SELECT stream_id, seq, frame FROM framed")
def f01(spark, sf):
    return framing.by_angle(fixtures.blocks(spark, sf), 9000).select("stream_id", "seq", "frame")


@query("f02_split_by_count", f"WITH {BLOCKS_SQL} SELECT stream_id, seq, row_number() OVER (PARTITION BY stream_id ORDER BY seq) // 5 AS frame FROM blocks")
def f02(spark, sf):
    return framing.by_count(fixtures.blocks(spark, sf), 5).select("stream_id", "seq", "frame")


@query("f03_split_by_sequence")
def f03(spark, sf):
    return framing.by_sequence(fixtures.packet_sequence(spark, sf))


@query("f05_frame_emit", f"WITH {F1} SELECT stream_id, frame, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts, count(*) AS width, row_number() OVER (PARTITION BY stream_id ORDER BY frame) - 1 AS number, 1 AS height FROM framed GROUP BY 1, 2")
def f05(spark, sf):
    return framing.emit(framing.by_angle(fixtures.blocks(spark, sf), 9000))


@query("f06_split_by_marker", f"WITH {BLOCKS_SQL}, m AS (SELECT *, sum(CASE WHEN azimuth % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq)::BIGINT AS frame FROM blocks) SELECT stream_id, seq, frame FROM m WHERE azimuth % 5 <> 0")
def f06(spark, sf):
    return framing.by_marker(fixtures.blocks(spark, sf).withColumn("marker", F.col("azimuth") % 5 == 0)).select("stream_id", "seq", "frame")


# --- poses and map ------------------------------------------------------------------------------------------------

M1 = f"""{POSES_SQL}, probe AS (SELECT event_id AS probe_id, user_id % 8 AS stream_id, epoch_us(ts) // 1000 AS ts_ms FROM events WHERE event_type <> 'view'),
j AS (SELECT p.*, q.event_id AS pose_event_id, q.ts_ms AS pose_ts_ms FROM probe p LEFT JOIN LATERAL (SELECT event_id, ts_ms FROM poses WHERE poses.stream_id = p.stream_id AND poses.ts_ms <= p.ts_ms ORDER BY poses.ts_ms DESC, event_id DESC LIMIT 1) q ON true)"""


def _asof(spark, sf):
    probe = spark.read.parquet(f"{sf}/events.parquet").where("event_type <> 'view'").selectExpr("event_id AS probe_id", "user_id % 8 AS stream_id", "unix_millis(CAST(ts AS TIMESTAMP)) AS ts_ms")
    return poses.asof(probe, fixtures.poses(spark, sf), tie="event_id")


@query("m01_pose_asof", f"WITH {M1} SELECT probe_id, stream_id, coalesce(pose_event_id, -1) AS pose_event_id FROM j")
def m01(spark, sf):
    return _asof(spark, sf).select("probe_id", "stream_id", F.coalesce("pose_event_id", F.lit(-1)).alias("pose_event_id"))


@query("m02_pose_freshness", f"WITH {M1} SELECT probe_id, coalesce(ts_ms - pose_ts_ms, -1) AS pose_age, coalesce(pose_ts_ms > 0 AND ts_ms - pose_ts_ms <= 600000, false) AS pose_valid FROM j")
def m02(spark, sf):
    return poses.freshness(_asof(spark, sf), 600_000).select("probe_id", F.coalesce("pose_age", F.lit(-1)).alias("pose_age"), "pose_valid")


@query("m03_pose_statistics", f"WITH {POSES_SQL} SELECT stream_id, count(*) AS n, max(ts_ms) AS last_ts, arg_max(heading_deg, ts_ms::HUGEINT * 1000000 + event_id) AS last_heading FROM poses GROUP BY 1")
def m03(spark, sf):
    return poses.statistics(fixtures.poses(spark, sf)).select("stream_id", "n", "last_ts", F.col("last_pose.heading_deg").alias("last_heading"))


@query("m04_vehicle_to_map", f"WITH {POSES_SQL} SELECT event_id, round(cos(radians(heading_deg)) * -1.5::DOUBLE + sin(radians(heading_deg)) * 4 + x, 6) + 0.0 AS mx, round(cos(radians(heading_deg)) * 4 - sin(radians(heading_deg)) * -1.5::DOUBLE + y, 6) + 0.0 AS my FROM poses")
def m04(spark, sf):
    mx, my = geo.vehicle_to_map(F.lit(4.0), F.lit(1.5), F.col("x"), F.col("y"), F.col("heading_deg"))
    return fixtures.poses(spark, sf).select("event_id", (F.round(mx, 6) + 0.0).alias("mx"), (F.round(my, 6) + 0.0).alias("my"))


@query("m05_map_to_vehicle", f"WITH {POSES_SQL} SELECT event_id, round(sin(radians(heading_deg)) * (30 - x) + cos(radians(heading_deg)) * (20 - y), 6) + 0.0 AS vx, round(sin(radians(heading_deg)) * (20 - y) - cos(radians(heading_deg)) * (30 - x), 6) + 0.0 AS vy FROM poses")
def m05(spark, sf):
    vx, vy = geo.map_to_vehicle(F.lit(30.0), F.lit(20.0), F.col("x"), F.col("y"), F.col("heading_deg"))
    return fixtures.poses(spark, sf).select("event_id", (F.round(vx, 6) + 0.0).alias("vx"), (F.round(vy, 6) + 0.0).alias("vy"))


MAP = f"""{POSES_SQL}, lp AS (SELECT n_nationkey::BIGINT + 1 AS lane_id, o.o AS ord, (n_nationkey * 4 + 2)::DOUBLE AS x, (o.o * 5)::DOUBLE AS y FROM nation, (SELECT unnest(range(0, 11)) AS o) o),
near AS (SELECT DISTINCT event_id AS pose_id, lane_id FROM poses p JOIN lp ON sqrt((p.x - lp.x) * (p.x - lp.x) + (p.y - lp.y) * (p.y - lp.y)) <= 18),
cur AS (SELECT pose_id, min(lane_id) AS section_id FROM near GROUP BY 1), edge AS (SELECT a.n_nationkey::BIGINT + 1 AS src, b.n_nationkey::BIGINT + 1 AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey = a.n_nationkey + 1),
dr AS (SELECT pose_id, section_id FROM cur UNION SELECT pose_id, src FROM cur JOIN edge ON dst = section_id UNION SELECT pose_id, dst FROM cur JOIN edge ON src = section_id)"""


def _map(spark, sf):
    m = fixtures.road_map(spark, sf)
    p = fixtures.poses(spark, sf).withColumnRenamed("event_id", "pose_id")
    near = mapjoin.lanes_near(p, m["lane_points"])
    return m, p, near


@query("m09_lanes_near", f"WITH {MAP} SELECT pose_id, lane_id FROM near")
def m09(spark, sf):
    return _map(spark, sf)[2].select("pose_id", "lane_id")


@query("m10_lane_sections", "SELECT n_nationkey::BIGINT + 1 AS lane_id, n_nationkey::BIGINT + 1 AS section_id, n_regionkey::BIGINT + 1 AS road_id FROM nation")
def m10(spark, sf):
    s = fixtures.road_map(spark, sf)["sections"]
    return mapjoin.lane_sections(s).join(mapjoin.section_roads(s), "section_id").select("lane_id", "section_id", "road_id")


@query("m11_current_section", f"WITH {MAP} SELECT pose_id, section_id FROM cur")
def m11(spark, sf):
    m, _, near = _map(spark, sf)
    return mapjoin.current_section(near, m["sections"])


@query("m12_drivable_sections", f"WITH {MAP} SELECT pose_id, section_id FROM dr")
def m12(spark, sf):
    m, _, near = _map(spark, sf)
    return mapjoin.drivable_sections(mapjoin.current_section(near, m["sections"]), m["edges"])


RECT = "rect AS (SELECT n_nationkey::BIGINT + 1 AS section_id, n_nationkey * 4.0 AS x0, n_nationkey * 4.0 + 4 AS x1 FROM nation)"


@query("m13_point_in_polygon", f"WITH {POSES_SQL}, {RECT} SELECT event_id, section_id FROM poses JOIN rect ON x >= x0 AND x < x1 AND y >= 0 AND y < 50")
def m13(spark, sf):
    p = fixtures.poses(spark, sf)
    rings = mapjoin.polygons(fixtures.road_map(spark, sf)["sections"]).withColumn("q", F.explode(F.expr("sequence(CAST(section_id - 1 AS BIGINT), section_id)")))
    return p.withColumn("q", F.floor(F.col("x") / 4)).join(rings, "q").where(geo.in_polygon(F.col("polygon"), F.col("x"), F.col("y"))).select("event_id", "section_id")


@query("m14_polygon_distance", f"WITH {POSES_SQL}, {RECT} SELECT event_id, section_id, round(CASE WHEN x BETWEEN x0 AND x1 AND y BETWEEN 0 AND 50 THEN least(x - x0, x1 - x, y, 50 - y) ELSE sqrt(power(greatest(x0 - x, x - x1, 0), 2) + power(greatest(-y, y - 50, 0), 2)) END, 6) AS d FROM poses JOIN rect ON section_id = 1 + event_id % 25")
def m14(spark, sf):
    rings = mapjoin.polygons(fixtures.road_map(spark, sf)["sections"])
    p = fixtures.poses(spark, sf).withColumn("section_id", F.col("event_id") % 25 + 1)
    return p.join(rings, "section_id").select("event_id", "section_id", F.round(geo.polygon_distance(F.col("polygon"), F.col("x"), F.col("y")), 6).alias("d"))


@query("m15_drivable_margin", f"WITH {POSES_SQL}, {RECT} SELECT event_id FROM poses JOIN rect ON section_id = 1 + event_id % 25 WHERE x BETWEEN x0 - 3 AND x1 + 3 AND y BETWEEN -3 AND 53 AND sqrt(power(greatest(x0 - x, x - x1, 0), 2) + power(greatest(-y, y - 50, 0), 2)) <= 3")
def m15(spark, sf):
    rings = mapjoin.polygons(fixtures.road_map(spark, sf)["sections"])
    p = fixtures.poses(spark, sf).withColumn("section_id", F.col("event_id") % 25 + 1)
    return p.join(rings, "section_id").where(geo.drivable(F.col("polygon"), F.col("x"), F.col("y"), 3.0)).select("event_id")


@query("m16_cluster_labels", f"WITH {MAP}, {RECT}, k AS (SELECT event_id AS pose_id, event_id % 3 AS cluster_id, event_id % 7 <> 0 AS pose_valid, x + 2 AS mx, y + 4 AS my FROM poses), lab AS (SELECT pose_id, max(CASE WHEN sqrt(power(greatest(x0 - mx, mx - x1, 0), 2) + power(greatest(-my, my - 50, 0), 2)) <= 0.5 THEN 1 ELSE 0 END) AS road FROM k JOIN dr USING (pose_id) JOIN rect USING (section_id) WHERE pose_valid GROUP BY 1) SELECT pose_id, cluster_id, coalesce(road, 0) = 1 AS in_road, road IS NOT NULL AS map_valid, CASE WHEN road IS NULL THEN 0.0 WHEN road = 1 THEN 1.0 ELSE 0.3 END::DOUBLE AS confidence FROM k LEFT JOIN lab USING (pose_id)")
def m16(spark, sf):
    m, p, near = _map(spark, sf)
    sections = mapjoin.drivable_sections(mapjoin.current_section(near, m["sections"]), m["edges"])
    k = p.select("pose_id", (F.col("pose_id") % 3).alias("cluster_id"), (F.col("pose_id") % 7 != 0).alias("pose_valid"), F.col("x").alias("px"), F.col("y").alias("py"), F.lit(0.0).alias("heading_deg"), F.lit(4.0).alias("vx"), F.lit(-2.0).alias("vy"))
    return mapjoin.label_clusters(k, sections, mapjoin.polygons(m["sections"])).select("pose_id", "cluster_id", "in_road", "map_valid", "confidence")


@query("m17_lane_boundary", f"WITH {MAP} SELECT lane_id, ord::INT AS ord, round(x - 1.75, 6) AS left_x, round(y, 6) AS left_y, round(x + 1.75, 6) AS right_x, round(y, 6) AS right_y FROM lp")
def m17(spark, sf):
    out = mapjoin.boundary(mapjoin.headings(fixtures.road_map(spark, sf)["lane_points"]), 3.5)
    return out.select("lane_id", "ord", *((F.round(c, 6) + 0.0).alias(c) for c in ("left_x", "left_y", "right_x", "right_y")))


@query("m18_road_boundary", "SELECT n_regionkey::BIGINT + 1 AS road_id, (count(*) * 2)::INT AS n, round(sum(n_nationkey * 8 + 4)::DOUBLE, 3) AS sum_x FROM nation GROUP BY 1")
def m18(spark, sf):
    out = mapjoin.road_boundaries(fixtures.road_map(spark, sf)["sections"])
    return out.select("road_id", F.size("left_line").alias("n"), F.round(F.aggregate("left_line", F.lit(0.0), lambda a, p: a + p["x"]), 3).alias("sum_x"))


@query("m19_map_statistics", f"WITH {MAP} SELECT 'sections' AS what, count(*) AS n FROM nation UNION ALL SELECT 'lanes', count(DISTINCT lane_id) FROM lp UNION ALL SELECT 'lane_points', count(*) FROM lp UNION ALL SELECT 'edges', count(*) FROM edge")
def m19(spark, sf):
    m = fixtures.road_map(spark, sf)
    return mapjoin.statistics(m["sections"], m["lane_points"], m["edges"])


# --- lines --------------------------------------------------------------------------------------------------------

SEG = "seg AS (SELECT o_orderkey % 50 AS frame_id, o_orderkey AS line_id, o_orderkey % 9 AS cluster_id, (o_orderkey * 7 % 400)::DOUBLE AS x0, (o_custkey * 3 % 400)::DOUBLE AS y0, (o_orderkey * 7 % 400 + o_custkey % 80 - 40)::DOUBLE AS x1, (o_custkey * 3 % 400 + o_orderkey % 160 - 60)::DOUBLE AS y1 FROM orders)"
DESC = f"""{SEG}, ord AS (SELECT *, CASE WHEN y0 > y1 THEN x1 ELSE x0 END AS ax, CASE WHEN y0 > y1 THEN y1 ELSE y0 END AS ay, CASE WHEN y0 > y1 THEN x0 ELSE x1 END AS bx, CASE WHEN y0 > y1 THEN y0 ELSE y1 END AS by_ FROM seg),
an AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS length, CASE WHEN abs(bx - ax) < 0.001 THEN 90.0 ELSE CASE WHEN degrees(atan2(by_ - ay, bx - ax)) >= 180 THEN degrees(atan2(by_ - ay, bx - ax)) - 180 ELSE degrees(atan2(by_ - ay, bx - ax)) END END AS angle FROM ord)"""


def _seg(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey % 50 AS frame_id", "o_orderkey AS line_id", "o_orderkey % 9 AS cluster_id", "CAST(o_orderkey * 7 % 400 AS DOUBLE) AS x0", "CAST(o_custkey * 3 % 400 AS DOUBLE) AS y0", "CAST(o_orderkey * 7 % 400 + o_custkey % 80 - 40 AS DOUBLE) AS x1", "CAST(o_custkey * 3 % 400 + o_orderkey % 160 - 60 AS DOUBLE) AS y1")


@query("l01_raster", f"WITH {P} SELECT DISTINCT frame_id, trunc(y * -0.01::DOUBLE + 300)::INT AS v, trunc(x * 0.01::DOUBLE + 5)::INT AS u FROM pts")
def l01(spark, sf):
    return lines.raster(fixtures.points(spark, sf), 0.01, 300, 5)


@query("l02_hough")
def l02(spark, sf):
    return lines.hough(lines.raster(fixtures.points(spark, sf), 0.02, 300, 5), 12, 20, 12)


@query("l03_line_struct", f'WITH {DESC} SELECT line_id, ax, ay, bx, by_ AS "by", round(angle, 6) AS angle, round(length, 6) AS length, least(17, floor(angle / 10))::INT AS "range" FROM an')
def l03(spark, sf):
    return lines.describe(_seg(spark, sf)).select("line_id", "ax", "ay", "bx", "by", F.round("angle", 6).alias("angle"), F.round("length", 6).alias("length"), "range")


@query("l04_collinear", f"""WITH {DESC}, lg AS (SELECT *, CASE WHEN length > 0 THEN (by_ - ay) / length END AS la, CASE WHEN length > 0 THEN (ax - bx) / length END AS lb, CASE WHEN length > 0 THEN (bx * ay - ax * by_) / length END AS lc FROM an WHERE length > 63)
SELECT p.frame_id, p.line_id AS a, q.line_id AS b FROM lg p JOIN lg q ON p.frame_id = q.frame_id AND p.line_id < q.line_id
WHERE least(abs(p.angle - q.angle), 180 - abs(p.angle - q.angle)) < 6 AND (abs(p.la * q.ax + p.lb * q.ay + p.lc) + abs(p.la * q.bx + p.lb * q.by_ + p.lc)) / 2 < 12""")
def l04(spark, sf):
    return lines.collinear(lines.describe(_seg(spark, sf)), 6.0, 12.0)


@query("l07_longest_cluster", f"WITH {DESC}, t AS (SELECT frame_id, cluster_id, sum(round(length * 1000)::BIGINT)::BIGINT AS total FROM an GROUP BY 1, 2) SELECT frame_id, arg_max(cluster_id, total * 100 - cluster_id) AS cluster_id, max(total) AS total FROM t GROUP BY 1")
def l07(spark, sf):
    d = lines.describe(_seg(spark, sf)).withColumn("length", F.round(F.col("length") * 1000).cast("long"))
    return lines.longest_cluster(d).select("frame_id", "cluster_id", "total")


@query("l08_closest_side", f"WITH {SEG}, c AS (SELECT frame_id, cluster_id, sum(x0) / count(*) AS mean_x, count(*) AS n FROM seg GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS n2, lead(cluster_id) OVER w AS c2 FROM c WINDOW w AS (PARTITION BY frame_id ORDER BY mean_x, cluster_id)) SELECT frame_id, CASE WHEN n2 IS NULL OR n >= 0.9 * n2 THEN cluster_id ELSE c2 END AS cluster_id FROM r WHERE r = 1")
def l08(spark, sf):
    c = _seg(spark, sf).groupBy("frame_id", "cluster_id").agg((F.sum("x0") / F.count(F.lit(1))).alias("mean_x"), F.count(F.lit(1)).alias("n"))
    return lines.closest_side(c, 0.9)


@query("l11_line_scalars", f"WITH {DESC} SELECT line_id, CASE WHEN length > 0 THEN round((by_ - ay) / length, 6) + 0.0 END AS a, CASE WHEN length > 0 THEN round((ax - bx) / length, 6) + 0.0 END AS b, CASE WHEN bx <> ax THEN round((by_ - ay) / (bx - ax), 6) + 0.0 END AS k FROM an")
def l11(spark, sf):
    d = lines.describe(_seg(spark, sf))
    k, _ = geo.slope_intercept(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return d.select("line_id", (F.round("a", 6) + 0.0).alias("a"), (F.round("b", 6) + 0.0).alias("b"), (F.round(k, 6) + 0.0).alias("k"))


FIT = f"{P}, s AS (SELECT frame_id, ring, count(*) AS n, sum(x)::HUGEINT AS sx, sum(y)::HUGEINT AS sy, sum(x * x)::HUGEINT AS sxx, sum(y * y)::HUGEINT AS syy, sum(x * y)::HUGEINT AS sxy FROM pts GROUP BY 1, 2), v AS (SELECT *, (n * sxx - sx * sx)::DOUBLE AS vx, (n * syy - sy * sy)::DOUBLE AS vy, (n * sxy - sx * sy)::DOUBLE AS vxy FROM s)"


@query("l12_orthogonal_fit", f"WITH {FIT}, t AS (SELECT *, 0.5::DOUBLE * atan2(2 * vxy, vx - vy) AS th FROM v) SELECT frame_id, ring, n, round(th, 6) AS theta, round(tan(th), 4) AS k FROM t")
def l12(spark, sf):
    return lines.orthogonal_fit(fixtures.points(spark, sf), ["frame_id", "ring"]).select("frame_id", "ring", "n", F.round("theta", 6).alias("theta"), F.round("k", 4).alias("k"))


@query("l13_linear_fit", f"WITH {FIT} SELECT frame_id, ring, round(vxy / vx, 6) AS k FROM v")
def l13(spark, sf):
    return lines.linear_fit(fixtures.points(spark, sf), ["frame_id", "ring"]).select("frame_id", "ring", F.round("k", 6).alias("k"))


@query("l16_sliding_average", f"WITH {SEG}, r AS (SELECT cluster_id AS side, (row_number() OVER (PARTITION BY cluster_id ORDER BY line_id) - 1) // 5 AS run, x0, x1, line_id % 3 <> 0 AS valid FROM seg) SELECT side, run, round(coalesce(avg(CASE WHEN valid THEN x0 END), 0), 6) AS x0, round(coalesce(avg(CASE WHEN valid THEN x1 END), 0), 6) AS x1 FROM r GROUP BY 1, 2 HAVING count(*) = 5")
def l16(spark, sf):
    rows = _seg(spark, sf).select(F.col("cluster_id").alias("side"), F.col("line_id").alias("frame_id"), "x0", "x1", (F.col("line_id") % 3 != 0).alias("valid"))
    return lines.sliding_average(rows, 5).select("side", "run", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query("l18_curve_sampling", f"WITH {FIT}, k AS (SELECT frame_id, ring, vxy / vx AS k FROM v), x AS (SELECT unnest(range(0, 11)) * 0.5::DOUBLE AS x) SELECT frame_id, ring, x, round(k * x, 6) + 0.0 AS y FROM k, x")
def l18(spark, sf):
    fit = lines.linear_fit(fixtures.points(spark, sf), ["frame_id", "ring"]).withColumn("b", F.lit(0.0))
    return lines.sample_curve(fit, 0.0, 5.0, 0.5).select("frame_id", "ring", "x", (F.round("y", 6) + 0.0).alias("y"))


@query("c01_morphological_ground")
def c01(spark, sf):
    return lines.morphological_ground(fixtures.points(spark, sf), 200.0, initial=100.0, most=600.0).groupBy("frame_id", "is_ground").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("sum_z"))


@query("c02_plane_ransac")
def c02(spark, sf):
    return lines.plane_ransac(fixtures.points(spark, sf), 60.0, 800)


# --- tracks -------------------------------------------------------------------------------------------------------


def _frames(spark, sf):
    """Detections of eight streams from the view events: a few in each second that has any."""
    p = fixtures.poses(spark, sf).select("stream_id", (F.floor(F.col("ts_ms") / 600_000) * 600_000).alias("ts_ms"), F.col("event_id").alias("cluster_id"), (F.col("x") / 100).alias("x"), (F.col("y") / 50).alias("y"))
    return tracking.frames_of(p)


@query("k11_greedy_tracker")
def k11(spark, sf):
    return tracking.track(_frames(spark, sf))


@query("k12_optimal_tracker")
def k12(spark, sf):
    return tracking.track(_frames(spark, sf), "optimal")


@query("k14_frame_intervals", f"WITH {POSES_SQL}, f AS (SELECT DISTINCT stream_id, (ts_ms // 600000) * 600000 AS ts_ms FROM poses) SELECT stream_id, ts_ms, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY stream_id ORDER BY ts_ms), 0) AS dt FROM f")
def k14(spark, sf):
    return tracking.frame_intervals(_frames(spark, sf)).drop("first")


@query("g18_track_records")
def g18(spark, sf):
    return tracking.output_records(tracking.track(_frames(spark, sf))).select("stream_id", "ts_ms", "return_val", "obs_num")


@query("g20_confirmed_tracks")
def g20(spark, sf):
    return tracking.confirmed(tracking.track(_frames(spark, sf)), 2)


@query("k06_latest_frame", f"WITH {BLOCKS_SQL} SELECT stream_id, max(ts_ms) AS ts_ms, arg_max(azimuth, ts_ms::HUGEINT * 10000000 + seq) AS azimuth FROM blocks GROUP BY 1")
def k06(spark, sf):
    return tracking.latest(fixtures.blocks(spark, sf), "azimuth")


# --- layers -------------------------------------------------------------------------------------------------------


@query("v01_height_ramp", f'WITH {CELLS_SQL}, f AS (SELECT *, min(min_z) OVER (PARTITION BY frame_id) AS lo, max(min_z) OVER (PARTITION BY frame_id) AS hi FROM cells) SELECT frame_id, coalesce(least(3, floor((min_z - lo) * 4 / nullif(hi - lo, 0))::INT), 0) AS ramp, count(*) AS n FROM f GROUP BY 1, 2')
def v01(spark, sf):
    return V.height_ramp(G.build(fixtures.points(spark, sf), CFG)).groupBy("frame_id", "ramp").agg(F.count(F.lit(1)).alias("n"))


@query("v02_ground_classes", _with(GROUND_SQL, "SELECT frame_id, CASE WHEN is_ground THEN 'ground' ELSE 'other' END AS class, count(*) AS n FROM gcells GROUP BY 1, 2"))
def v02(spark, sf):
    return V.ground_classes(_ground(spark, sf))


@query("v03_slope_ramp", _with(SLOPE_SQL, "SELECT frame_id, CASE WHEN slope = 0 THEN 0 WHEN slope < 0.175 THEN 1 WHEN slope <= 0.35 THEN 2 ELSE 3 END AS ramp, count(*) AS n FROM sloped GROUP BY 1, 2"))
def v03(spark, sf):
    return G.slope(G.build(fixtures.points(spark, sf), CFG), CFG).groupBy("frame_id", V.slope_ramp(F.col("slope"), 0.35).alias("ramp")).agg(F.count(F.lit(1)).alias("n"))


@query("v05_candidate_counts", _with(CAND_SQL, "SELECT frame_id, count_if(is_obstacle_candidate)::BIGINT AS candidates, count_if(is_vertical_structure)::BIGINT AS vertical, count(*) AS cells FROM cand GROUP BY 1"))
def v05(spark, sf):
    return V.candidate_counts(_detected(spark, sf))


@query("v06_cluster_hues", _with(BOX_SQL, "SELECT frame_id, cluster_id, round(cluster_id * 0.618033988749895::DOUBLE - floor(cluster_id * 0.618033988749895::DOUBLE), 6) AS hue FROM aabb"))
def v06(spark, sf):
    return C.summarise(_clustered(spark, sf), CFG).select("frame_id", F.col("cluster_id").cast("long").alias("cluster_id"), F.round(V.hue(F.col("cluster_id")), 6).alias("hue"))


@query("v10_pixels", f"WITH {P} SELECT frame_id, floor((x - 900) / 50.0)::INT AS u, (119 - floor((y + 3000) / 50.0))::INT AS v, count(*) AS n FROM pts GROUP BY 1, 2, 3")
def v10(spark, sf):
    u, v = V.pixel(F.col("x"), F.col("y"), 900, -3000, 50.0, 120)
    return fixtures.points(spark, sf).groupBy("frame_id", u.alias("u"), v.alias("v")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = Q
__all__ = ["QUERIES", "SQL", "GridConfig"]
