"""Queries that pack device packets from tables and decode them, and of curbs, filters, clusters and overlays; the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.functions import geometry as geo
from gridwake.functions import projection
from gridwake.operators import calibration, curbs, lines, mapjoin, rejects, sweeps, tracking
from gridwake.operators import clusters as C
from gridwake.operators import decode as D
from gridwake.operators import layers as V
from gridwake.operators import transform as T
from gridwake.plans.grid_queries import CAND_SQL, CFG, OBB_SQL, REF_SQL, _clustered, _detected, _with
from gridwake.plans.materialize import materialize
from gridwake.plans.motion_queries import BLK, DESC, FIT, NEAR, P, _blk, _numbered, _seg
from gridwake.sources import binary_sinks, fixtures, packets
from gridwake.sources.fixtures import BLOCKS_SQL, POSES_SQL

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _bytes(value: Column, size: int, little: bool = False) -> Column:
    """Hex digits of an integer, signed ones as two's complement."""
    digits = F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(1 << (8 * size)))), 2 * size, "0")
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in range(size - 1, -1, -1))) if little else digits


def _each(count: int, f) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), f), "")


def _r(df: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], digits: int = 4) -> DataFrame:
    return df.select(*keys, *((F.round(c, digits) + 0.0).alias(c) for c in values))


def _xyz(digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in "xyz")


# --- packets of the models ----------------------------------------------------------------------------------------

FULL = f"{BLK}, full_ AS (SELECT * FROM blk WHERE (stream_id, seq) IN (SELECT (stream_id, seq) FROM blk GROUP BY stream_id, seq HAVING count(*) = 12))"
RAW = "(seq * 7 + blk * 4001 + ch * 1700) % 60000"


def _full(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of packets that have all twelve."""
    b = _blk(spark, sf)
    return b.join(b.groupBy("stream_id", "seq").agg(F.count(F.lit(1)).alias("n")).where("n = 12").select("stream_id", "seq"), ["stream_id", "seq"], "left_semi")


def _polar_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Packets of the layout spin16 from blocks; in every fifth the eighth block has another id."""
    c = F.col
    channel = lambda ch: F.concat(_bytes((c("seq") * 7 + c("blk") * 4001 + ch * 1700) % 60000, 2), _bytes((c("blk") + ch) % 256, 1))
    ident = F.when((c("seq") % 5 == 0) & (c("blk") == 7), "FFEF").otherwise("FFEE")
    rows = _full(spark, sf).select("stream_id", "seq", F.struct("blk", F.concat(ident, _bytes(c("azimuth"), 2), _each(32, channel)).alias("h")).alias("b"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["h"]), "")
    return rows.groupBy("stream_id", "seq").agg(F.unhex(F.concat(F.lit("55AA" + "00" * 40), body, F.lit("00" * 6))).alias("payload"))


def _lasers(spark: SparkSession) -> DataFrame:
    return spark.range(16).selectExpr("CAST(id AS INT) AS channel", "CAST(id * 200 - 1500 AS INT) AS vert", "CAST(id * 10 - 75 AS INT) AS horiz")


POLAR = f"""WITH {FULL}, nx AS (SELECT *, lead(azimuth) OVER (PARTITION BY stream_id, seq ORDER BY blk) - azimuth AS q FROM full_), d AS (SELECT *, CASE WHEN q < 0 THEN q + 36000 ELSE q END AS raw FROM nx),
s AS (SELECT *, CASE WHEN raw IS NULL OR raw > 100 THEN 20 ELSE raw END AS st FROM d WHERE NOT (seq % 5 = 0 AND blk >= 7)),
c AS (SELECT stream_id, seq, blk, ch, azimuth + (st * ch) // 32 AS az, {RAW} * 0.005::DOUBLE AS d, (blk + ch) % 256 AS i, (ch % 16) * 200 - 1500 AS v, (ch % 16) * 10 - 75 AS h FROM s, (SELECT unnest(range(0, 32)) AS ch)),
a AS (SELECT *, d BETWEEN 0.4 AND 230 AND (az + h + 36000) % 36000 < 27000 AND (az + h + 36000) % 36000 >= 1000 AS ok, cos(radians(v / 100.0)) AS cv, sin(radians(v / 100.0)) AS sv, radians((az + h) / 100.0) AS t, radians(az / 100.0) AS u FROM c)"""


@query("d17_polar_packets", f"""{POLAR} SELECT stream_id, seq, blk, ch AS channel, CASE WHEN ok THEN round(d * cv * cos(t) + 0.03825 * cos(u), 4) + 0.0 END AS x,
CASE WHEN ok THEN round(-(d * cv * sin(t) + 0.03825 * sin(u)), 4) + 0.0 END AS y, CASE WHEN ok THEN round(d * sv, 4) + 0.0 END AS z, CASE WHEN ok THEN i ELSE 0 END AS intensity FROM a""")
def d17(spark, sf):
    """decode() over packets of a spinning sensor: sections, ranges, null returns and packets that end early."""
    got = D.decode(_polar_packets(spark, sf), D.MODELS["spin16"], _lasers(spark), start_deg=10, end_deg=270)
    return _r(got, ("stream_id", "seq", "blk", "channel", "intensity"), ("x", "y", "z"))


# --- calibration by stream and time -------------------------------------------------------------------------------


def _device_payload(packed: bool) -> Column:
    """A device packet of the version v: speed, field of view, echo mode and angles change with it, and every fourth one's angles are not ready."""
    c, v = F.col, F.col("seq").cast("long") - 1
    v = F.floor(v / 3)
    head = F.concat(F.lit("A5FF" + "00" * 6), _bytes(F.when(v % 2 == 0, 600).otherwise(1200), 2), F.lit("00" * 22 + "0000"), _bytes(F.when(v % 3 == 0, 36000).otherwise(27000), 2), F.lit("00" * 264), _bytes((c("stream_id") + v) % 2, 1), F.lit("00" * 167))
    if packed:
        return F.unhex(F.concat(head, F.lit("00" * (1165 - 468)), _each(16, lambda i: _bytes(i * 20000 + v * 777 + 55, 3)), F.lit("00" * 35)))
    sign = lambda i: F.when((i == 0) & ((c("stream_id") + v) % 4 == 0), "FF").when(i < 16, "01").otherwise("00")
    vert = _each(32, lambda i: F.concat(sign(i), _bytes(i * 1000 + v * 37 + 4, 2)))
    horiz = _each(32, lambda i: F.concat(_bytes(i % 2, 1), _bytes(i * 70 + v * 13, 2)))
    return F.unhex(F.concat(head, vert, horiz, F.lit("00" * 588)))


def _streams(spark: SparkSession, sf: str, packed: bool) -> DataFrame:
    """Point packets at odd places of their streams and a device packet before every third one."""
    points = materialize(_polar_packets(spark, sf), "packets").repartition(4 * spark.sparkContext.defaultParallelism)
    devices = points.where("seq % 3 = 1").select("stream_id", F.col("seq") * 2, _device_payload(packed))
    return points.select("stream_id", F.col("seq") * 2 + 1, "payload").union(devices).toDF("stream_id", "seq", "payload")


def _streams_sql(model: str, which: str, dual: str, times: int) -> str:
    """Points of _streams: versions by joins on order, steps and offsets by windows."""
    own = calibration.DEVICES[model]
    lasers, block = own.lasers, own.block_us
    ready = "TRUE" if own.packed else "(stream_id + v) % 4 <> 0"
    if own.packed:
        vert, horiz = f"CASE WHEN l < 8 THEN -1 ELSE 1 END * ((l * 20000 + a * 777 + 55) // 100)", "0"
    else:
        vert, horiz = "CASE WHEN l < 16 THEN -1 ELSE 1 END * ((l * 1000 + a * 37 + 9) // 10)", "CASE WHEN l % 2 = 1 THEN -1 ELSE 1 END * ((l * 70 + a * 13 + 5) // 10)"
    fire = "[" + ", ".join(map(str, own.firings)) + "]"
    half = len(own.firings) // 2
    share = f"CASE WHEN dual THEN {fire}[{f'ch % {half}' if dual == 'two_firings_dual' else 'ch'} + 1]::FLOAT / {block}::FLOAT ELSE {fire}[ch + 1]::FLOAT / ({block}::FLOAT * {times}::FLOAT) END"
    size = "CASE WHEN dual THEN 2 ELSE 1 END" if dual == "dual" else "1"
    return f"""WITH {FULL}, dif AS (SELECT *, {ready} AS ready FROM (SELECT DISTINCT stream_id, seq AS k, (seq - 1) // 3 AS v FROM full_ WHERE seq % 3 = 1)),
pk AS (SELECT p.stream_id, p.seq, max(d.v) AS s, {'min' if which == 'first' else 'max'}(CASE WHEN ready THEN d.v END) AS a FROM (SELECT DISTINCT stream_id, seq FROM full_) p LEFT JOIN dif d ON d.stream_id = p.stream_id AND d.k <= p.seq GROUP BY 1, 2),
m AS (SELECT *, coalesce((stream_id + s) % 2 = 0, FALSE) AS dual, CASE WHEN s % 2 = 1 THEN 20 ELSE 10 END AS rps, CASE WHEN s % 3 <> 0 THEN 250000.0::DOUBLE ELSE 0.0::DOUBLE END AS gap FROM pk),
g AS (SELECT f.*, m.* EXCLUDE (stream_id, seq), CASE WHEN dual THEN 1 ELSE {times} END AS times, {size} AS size, blk // {size} AS grp, CASE WHEN s IS NULL THEN 20 ELSE round(rps * {36000 * block / 1e6}) END AS nom FROM full_ f JOIN m USING (stream_id, seq)),
h AS (SELECT stream_id, seq, grp, arg_min(azimuth, blk) AS az, any_value(nom) AS nom, any_value(times) AS times, any_value(gap / rps) AS blind FROM g GROUP BY 1, 2, 3),
d AS (SELECT *, lead(az) OVER (PARTITION BY stream_id, seq ORDER BY grp) - az AS q FROM h), r AS (SELECT *, CASE WHEN q < 0 THEN q + 36000 ELSE q END AS raw FROM d),
st AS (SELECT stream_id, seq, grp, CASE WHEN raw <= 100 THEN raw ELSE nom * times END AS st, coalesce(sum(CASE WHEN raw > 100 THEN blind ELSE {block}::DOUBLE * times END) OVER (PARTITION BY stream_id, seq ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM r),
c AS (SELECT g.*, st.st, st.off, ch, ch % {lasers} AS l, {share} AS sh, {RAW} * 0.005::DOUBLE AS dist, (blk + ch) % 256 AS i FROM g JOIN st USING (stream_id, seq, grp), (SELECT unnest(range(0, 32)) AS ch) WHERE NOT (seq % 5 = 0 AND blk >= 7)),
e AS (SELECT *, azimuth + floor(st::FLOAT * sh)::BIGINT AS az, {vert} AS v, {horiz} AS h FROM c), o AS (SELECT *, a IS NOT NULL AND dist BETWEEN 0.4 AND 230 AS ok, radians((az + h) / 100.0) AS t, radians(az / 100.0) AS u, radians(v / 100.0) AS w FROM e)
SELECT stream_id, 2 * seq + 1 AS seq, blk, ch AS channel, CASE WHEN dual THEN 1 + blk % size ELSE 1 END AS echo, CASE WHEN a IS NULL THEN 'no_calibration' END AS fault, round(off + sh::DOUBLE * {block} * times, 3) AS offset_us,
(CASE WHEN a IS NOT NULL THEN (SELECT count(*) FROM (SELECT l AS l2, a AS a2 FROM (SELECT unnest(range(0, {lasers})) AS l)) q WHERE {vert.replace('l ', 'l2 ').replace('(l2', '(l2')} < v) END)::INT AS ring,
CASE WHEN ok THEN round(dist * cos(w) * cos(t) + {{radius}} * cos(u), 4) + 0.0 END AS x, CASE WHEN ok THEN round(-(dist * cos(w) * sin(t) + {{radius}} * sin(u)), 4) + 0.0 END AS y, CASE WHEN ok THEN round(dist * sin(w), 4) + 0.0 END AS z, CASE WHEN ok THEN i ELSE 0 END AS intensity FROM o""".replace("{radius}", str(D.MODELS[model].radius))


def _stream_points(spark: SparkSession, sf: str, model: str, which: str) -> DataFrame:
    got = calibration.decode_streams(_streams(spark, sf, calibration.DEVICES[model].packed), model, which)
    return _r(got.withColumn("offset_us", F.round("offset_us", 3)), ("stream_id", "seq", "blk", "channel", "echo", "fault", "offset_us", "ring", "intensity"), ("x", "y", "z"))


@query("d07_first_angles", _streams_sql("spin32", "first", "dual", 1))
def d07(spark, sf):
    """Streams whose speed, field of view and echo mode change on the way, read with their first good angles; points before them have a fault."""
    return _stream_points(spark, sf, "spin32", "first")


@query("d19_latest_angles", _streams_sql("spin16", "latest", "two_firings_dual", 2))
def d19_latest(spark, sf):
    """The same for two firings in a block and packed angles that change on the way."""
    return _stream_points(spark, sf, "spin16", "latest")


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """A packet each, dealt over all cores: a file that is one task's becomes a thousand times as large as packets and points."""
    rows = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_nationkey AS stream_id", "s_suppkey AS seq")
    return rows.repartition(4 * spark.sparkContext.defaultParallelism)


@query("d15_angle_packets", f"""WITH c AS (SELECT s_nationkey AS stream_id, s_suppkey AS seq, blk, ch, (s_suppkey * 31 + blk * 997 + ch * 211) % 45000 * 0.005::DOUBLE AS d, (s_suppkey + blk * 13) % 2400 - 1200 AS p, (ch * 37 + blk * 101) % 12000 - 6000 AS w, (s_suppkey + ch) % 256 AS i FROM supplier, (SELECT unnest(range(0, 25)) AS blk), (SELECT unnest(range(0, 5)) AS ch)),
k AS (SELECT *, d BETWEEN 0.2 AND 200 AS ok, d * cos(radians(p / 100.0)) * cos(radians(w / 100.0)) AS x, d * cos(radians(p / 100.0)) * sin(radians(w / 100.0)) AS y, d * sin(radians(p / 100.0)) AS z FROM c) SELECT stream_id, seq, blk, ch AS channel, i AS intensity, {_xyz()} FROM k WHERE ok""")
def d15(spark, sf):
    """decode() over packets whose channels have angles."""
    c = F.col
    s = c("seq")
    channel = lambda b, ch: F.concat(_bytes((s * 31 + b * 997 + ch * 211) % 45000, 2), _bytes((s + b * 13) % 2400 - 1200 + 32768, 2), _bytes((ch * 37 + b * 101) % 12000 - 6000 + 32768, 2), _bytes((s + ch) % 256, 1), F.lit("0000"))
    body = _each(25, lambda b: F.concat(F.lit("0000"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda ch: channel(b, ch)), "")))
    rows = _suppliers(spark, sf).select("stream_id", "seq", F.unhex(F.concat(F.lit("55AA5AA5" + "00" * 28), body, F.lit("000000"))).alias("payload"))
    return _r(D.decode(rows, D.MODELS["mirror5_angles"], dense=True), ("stream_id", "seq", "blk", "channel", "intensity"), ("x", "y", "z"))


@query("d16_vector_packets", f"""WITH c AS (SELECT s_nationkey AS stream_id, s_suppkey AS seq, blk, ch, e AS echo, (s_suppkey * 31 + blk * 997 + ch * 211 + e * 5000) % 45000 * 0.005::DOUBLE AS d, (s_suppkey * 3 + blk) % 30000 AS vx, -((ch * 977 + blk * 11) % 30000) AS vy, (blk * 501) % 20000 - 10000 AS vz, (s_suppkey + ch + e) % 256 AS i FROM supplier, (SELECT unnest(range(0, 50)) AS blk), (SELECT unnest(range(0, 2)) AS ch), (SELECT unnest(range(1, 3)) AS e)),
k AS (SELECT *, vx * d / 32768 AS x, vy * d / 32768 AS y, vz * d / 32768 AS z FROM c WHERE d BETWEEN 0.2 AND 200) SELECT stream_id, seq, blk, ch AS channel, echo, i AS intensity, {_xyz()} FROM k""")
def d16(spark, sf):
    """decode() over packets with unit vectors and two returns for each channel."""
    s = F.col("seq")
    raw = lambda b, ch, e: _bytes((s * 31 + b * 997 + ch * 211 + e * 5000) % 45000, 2)
    channel = lambda b, ch: F.concat(raw(b, ch, 1), raw(b, ch, 2), _bytes((s * 3 + b) % 30000, 2), _bytes(-((ch * 977 + b * 11) % 30000), 2), _bytes(b * 501 % 20000 - 10000, 2), _bytes((s + ch + 1) % 256, 1), _bytes((s + ch + 2) % 256, 1), F.lit("00"))
    body = _each(50, lambda b: F.concat(F.lit("00"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda ch: channel(b, ch)), "")))
    rows = _suppliers(spark, sf).select("stream_id", "seq", F.unhex(F.concat(F.lit("55AA5AA5" + "00" * 28), body, F.lit("00" * 22))).alias("payload"))
    return _r(D.decode(rows, D.MODELS["mirror2_vectors"], dense=True), ("stream_id", "seq", "blk", "channel", "echo", "intensity"), ("x", "y", "z"))


@query("d19_column_packets", f"""WITH c AS (SELECT s_nationkey AS stream_id, s_suppkey AS seq, ch, ch + ((s_suppkey + 1) % 2) * 192 AS px, (s_suppkey * 31 + ch * 211) % 45000 * 0.005::DOUBLE AS d, (s_suppkey * 7) % 8000 - 4000 AS yb, s_suppkey % 3 AS sf, (s_suppkey + ch) % 256 AS i FROM supplier, (SELECT unnest(range(0, 192)) AS ch)),
a AS (SELECT *, trunc((yb + px % 9) * (1 / 5.12::DOUBLE))::BIGINT AS w, px * 5 - 900 + CASE sf WHEN 0 THEN 0 WHEN 1 THEN 12 ELSE -12 END AS p FROM c WHERE d BETWEEN 0.2 AND 300),
k AS (SELECT *, d * cos(radians(p / 100.0)) * cos(radians(w / 100.0)) AS x, d * cos(radians(p / 100.0)) * sin(radians(w / 100.0)) AS y, d * sin(radians(p / 100.0)) AS z FROM a) SELECT stream_id, seq, ch AS channel, i AS intensity, {_xyz()} FROM k""")
def d19(spark, sf):
    """decode() over columns whose two halves come in turn."""
    s = F.col("seq")
    body = _each(192, lambda ch: F.concat(_bytes((s * 31 + ch * 211) % 45000, 2), _bytes((s + ch) % 256, 1), F.lit("00")))
    head = F.concat(F.lit("55AA5AA5"), _bytes(s, 2), F.lit("00" * 18), _bytes(s * 7 % 8000 - 4000, 2), F.lit("00"), _bytes(s % 3, 1), F.lit("00" * 4))
    rows = _suppliers(spark, sf).select("stream_id", "seq", F.unhex(F.concat(head, body, F.lit("00" * 12))).alias("payload"))
    pixels = spark.range(384).selectExpr("CAST(id AS INT) AS channel", "CAST(id * 5 - 900 AS INT) AS vert", "CAST(id % 9 AS INT) AS horiz")
    return _r(D.decode(rows, D.MODELS["column192"], pixels, dense=True, surfaces=(0, 12, -12), parts=2), ("stream_id", "seq", "channel", "intensity"), ("x", "y", "z"))


@query("d22_device_info", "SELECT user_id AS stream_id, max(event_id) AS seq, lpad(to_hex(max(event_id)), 12, '0') AS serial, lpad(to_hex(user_id), 12, '0') AS mac, '0102030405' AS version, max(event_id) % 3000 / 100.0::DOUBLE AS volts FROM events GROUP BY user_id")
def d22(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    payload = F.unhex(F.concat(F.lit("A5FF"), _bytes(F.col("event_id"), 6), _bytes(F.col("user_id"), 6), F.lit("0102030405"), _bytes(F.col("event_id") % 3000, 2)))
    rows = ev.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), payload.alias("payload"))
    return D.device_info(rows, (2, 6), (8, 6), (14, 5), voltage_at=19).drop("celsius")


@query("d10_two_firings", f"""WITH {BLK}, d AS (SELECT *, lead(azimuth) OVER (PARTITION BY stream_id, seq ORDER BY blk) - azimuth AS q FROM blk), e AS (SELECT *, CASE WHEN q < 0 THEN q + 36000 ELSE q END AS raw FROM d),
s AS (SELECT *, CASE WHEN raw IS NULL OR raw > 10000 THEN 40 ELSE raw END AS az_step, coalesce(sum(CASE WHEN raw > 10000 THEN 7.5::DOUBLE ELSE 111::DOUBLE END) OVER (PARTITION BY stream_id, seq ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS off FROM e) SELECT stream_id, seq, blk, azimuth, az_step, round(off, 3) AS "offset" FROM s""")
def d10(spark, sf):
    return D.block_steps(_blk(spark, sf), "two_firings", 20, 55.5, 7.5, 10000).select("stream_id", "seq", "blk", "azimuth", F.col("az_step").cast("long").alias("az_step"), F.round("offset", 3).alias("offset"))


@query("d24_faults", "SELECT code, CASE WHEN code < 64 THEN 'info' ELSE 'warning' END AS level, count(*) AS n FROM (SELECT CASE event_id % 9 WHEN 1 THEN 66 WHEN 2 THEN 67 WHEN 3 THEN 68 WHEN 5 THEN 69 WHEN 6 THEN 76 ELSE 0 END AS code FROM events WHERE event_id % 9 <> 8) GROUP BY 1")
def d24(spark, sf):
    kinds = ("55AA01FFEE", "55AA01", "55AA02FFEE", "55AA01FFEF", "A5FF01", "A5FF0101", "AA5502", "AA5501", "0000")
    payload = F.unhex(F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.col("event_id") % 9 + 1).cast("int")))
    packets_ = spark.read.parquet(f"{sf}/events.parquet").select(payload.alias("payload"))
    got = D.faults(packets_, {"msop": 5, "difop": 3, "imu": 3}, {"msop": "55AA01", "difop": "A5FF01", "imu": "AA5501"}, (3, "FFEE"))
    return got.groupBy("code", D.level(F.col("code")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("d24_silences", f"WITH {BLOCKS_SQL}, l AS (SELECT *, lag(ts_ms) OVER (PARTITION BY stream_id ORDER BY ts_ms) AS pv FROM blocks) SELECT stream_id, pv AS \"from\", ts_ms AS \"to\", 'no_packets' AS fault, 64 AS code FROM l WHERE ts_ms - pv > 3600000")
def d24_silences(spark, sf):
    """Hours in which a stream has no packet."""
    return rejects.silences(fixtures.blocks(spark, sf), 3_600_000, "ts_ms")


@query("d24_frame_faults", f"WITH {P}, f AS (SELECT range AS frame_id FROM range(0, 10)), n AS (SELECT frame_id, count(*) AS n FROM pts GROUP BY 1) SELECT frame_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no_points' WHEN n > (SELECT avg(n) FROM n) THEN 'cloud_overflow' END AS fault, CASE WHEN n IS NULL THEN 71 WHEN n > (SELECT avg(n) FROM n) THEN 73 ELSE 0 END AS code FROM f LEFT JOIN n USING (frame_id)")
def d24_frames(spark, sf):
    """Ten frames, of which two have no points, against a limit at the mean."""
    pts = fixtures.points(spark, sf)
    mean = pts.count() / 8
    return rejects.frame_faults(spark.range(10).withColumnRenamed("id", "frame_id"), pts, most=mean)


# --- scanners with mirrors ----------------------------------------------------------------------------------------

_FRAMED = "sum(CASE WHEN mark THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq, rec)::BIGINT"
_REFLECT = "2 * dot * n1 - i1 AS ux, 2 * dot * n2 - i2 AS uy, i3 - 2 * dot * n3 AS uz"


@query("d26_prism_points", f"""WITH c AS (SELECT s_nationkey AS stream_id, s_suppkey AS seq, rec, (s_suppkey * 3 + rec * 5) % 140 AS ch, (s_suppkey * 97 + rec * 211) % 20000 AS az, ((s_suppkey * 1009 + rec * 7919) % 3000000) / 256.0::DOUBLE / 100 AS d, (s_suppkey + rec) % 256 AS i, (s_suppkey + rec) % 60 = 0 AS mark FROM supplier, (SELECT unnest(range(0, 171)) AS rec)),
f AS (SELECT *, {_FRAMED} AS frame FROM c), k AS (SELECT *, (ch // 4) % 2 = 0 AS rgt, radians((ch % 4) * 0.5 - 1) AS t1, radians((ch // 16) * 0.3 - 1.2) AS t2 FROM f WHERE NOT mark AND ch < 128 AND az <= 18000),
n AS (SELECT *, radians(CASE WHEN rgt THEN az / 200.0 + 22.5 ELSE 112.5 - az / 200.0 END) AS u, cos(t1) AS i1, 0.0::DOUBLE AS i2, sin(t1) AS i3 FROM k),
v AS (SELECT *, cos(t2) * cos(u) AS n1, cos(t2) * sin(u) AS n2, -sin(t2) AS n3 FROM n), w AS (SELECT *, i1 * n1 + i2 * n2 + i3 * n3 AS dot FROM v), r AS (SELECT *, {_REFLECT} FROM w),
q AS (SELECT *, sqrt(1 - uz * uz) AS fl FROM r), p AS (SELECT *, degrees(acos(least(1.0, greatest(-1.0, (ux + uy) / fl * sqrt(0.5) * CASE WHEN rgt THEN 1 ELSE -1 END)))) AS a FROM q),
g AS (SELECT *, radians(CASE WHEN rgt THEN 0.5894 + 0.9885 * a + 5.2766e-05 * a * a - 3.6636e-07 * a * a * a ELSE 1.9003 + 0.9719 * a + 1.4507e-04 * a * a - 3.6636e-07 * a * a * a END) AS h FROM p),
z AS (SELECT stream_id, frame, seq, rec AS record, ch AS channel, i AS intensity, d * fl * cos(h) + CASE WHEN rgt THEN 0.017 ELSE -0.017 END AS x, d * fl * sin(h) AS y, d * uz AS z FROM g) SELECT stream_id, frame, seq, record, channel, intensity, {_xyz(3)} FROM z""")
def d26(spark, sf):
    s = F.col("seq")
    one = lambda r: F.when((s + r) % 60 == 0, F.lit(sweeps.MARKER + "0000")).otherwise(F.concat(_bytes((s * 3 + r * 5) % 140, 1), _bytes((s * 97 + r * 211) % 20000, 2), _bytes((s * 1009 + r * 7919) % 3000000, 3), _bytes((s + r) % 256, 1)))
    rows = _suppliers(spark, sf).select("stream_id", "seq", F.unhex(F.concat(_each(171, one), F.lit("00" * 9))).alias("payload"))
    tilts = spark.range(128).selectExpr("CAST(id AS INT) AS channel", "(id % 4) * 0.5D - 1 AS tilt_in_deg", "(id div 16) * 0.3D - 1.2 AS tilt_deg")
    return _r(sweeps.prism_points(rows, tilts), ("stream_id", "frame", "seq", "record", "channel", "intensity"), ("x", "y", "z"), 3)


def _turn_packets(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    channel = lambda ch: F.concat(_bytes((c("seq") * 7 + c("blk") * 4001 + ch * 1700) % 60000, 2, True), _bytes((c("blk") + ch) % 256, 1))
    rows = _full(spark, sf).select("stream_id", "seq", F.struct("blk", F.concat(F.lit("FFEE"), _bytes(c("azimuth"), 2, True), _each(32, channel)).alias("h")).alias("b"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["h"]), "")
    return rows.groupBy("stream_id", "seq").agg(F.unhex(F.concat(body, F.lit("00" * 6))).alias("payload"))


@query("d27_turn_points", f"""WITH {FULL}, l AS (SELECT *, lead(azimuth) OVER w AS nx, lag(azimuth) OVER w AS pv FROM full_ WINDOW w AS (PARTITION BY stream_id, seq ORDER BY blk)), s AS (SELECT *, (CASE WHEN blk < 11 THEN nx - azimuth ELSE azimuth - pv END + 36000) % 36000 AS st FROM l),
c AS (SELECT stream_id, seq, blk, ch, azimuth / 100.0::DOUBLE + st / 3200.0::DOUBLE * ch AS a0, {RAW} * 0.0025::DOUBLE AS d, (blk + ch) % 256 AS i, radians((ch % 16) * 2 - 15) AS v FROM s, (SELECT unnest(range(0, 32)) AS ch)), k AS (SELECT *, CASE WHEN a0 >= 360 THEN a0 - 360 ELSE a0 END AS a FROM c),
p AS (SELECT *, d * cos(v) * sin(radians(a)) + 0.03 * sin(radians(a - 12)) AS x, d * cos(v) * cos(radians(a)) + 0.03 * cos(radians(a - 12)) AS y, d * sin(v) AS z FROM k) SELECT stream_id, seq, blk, ch AS channel, i AS intensity, round(a, 7) + 0.0 AS azimuth_deg, {_xyz(3)} FROM p""")
def d27(spark, sf):
    tilts = spark.range(16).selectExpr("CAST(id AS INT) AS channel", "id * 2D - 15 AS vert_deg")
    got = sweeps.turn_points(_turn_packets(spark, sf), tilts, sweeps.TurnSpec(radius=0.03, lag_deg=12.0))
    return _r(got.withColumn("azimuth_deg", F.round("azimuth_deg", 7)), ("stream_id", "seq", "blk", "channel", "intensity", "azimuth_deg"), ("x", "y", "z"), 3)


@query("d28_galvo_points", f"""WITH c AS (SELECT s_nationkey AS stream_id, s_suppkey AS seq, rec, (s_suppkey + rec) % 4 AS ch, (s_suppkey * 97 + rec * 211) % 12000 - 6000 AS az, (s_suppkey * 41 + rec * 389) % 9000 - 4500 AS tl, (s_suppkey * 1009 + rec * 7919) % 20000 * 0.004::DOUBLE AS d, (s_suppkey + rec) % 256 AS i, (s_suppkey + rec) % 50 = 0 AS mark FROM supplier, (SELECT unnest(range(0, 149)) AS rec)),
f AS (SELECT *, {_FRAMED} AS frame FROM c), k AS (SELECT *, radians(CASE ch WHEN 0 THEN 0 WHEN 1 THEN -2 WHEN 2 THEN -1 ELSE -3 END) AS t1, radians(((floor((((tl * 0.0025::DOUBLE + 7.26) + 360) % 360) * 100 + 1e-6)) % 36000) / 100) AS t2, radians(((az + 36000) % 36000) / 100.0) AS h FROM f WHERE NOT mark),
n AS (SELECT *, cos(t1) * cos(radians(60)) AS i1, cos(t1) * sin(radians(60)) AS i2, sin(t1) AS i3, cos(t2) * cos(radians(30)) AS n1, cos(t2) * sin(radians(30)) AS n2, -sin(t2) AS n3 FROM k), w AS (SELECT *, i1 * n1 + i2 * n2 + i3 * n3 AS dot FROM n), r AS (SELECT *, {_REFLECT} FROM w),
q AS (SELECT *, sqrt(1 - uz * uz) AS fl FROM r), t AS (SELECT *, h + asin(least(1.0, greatest(-1.0, uy / fl))) AS b FROM q), p AS (SELECT stream_id, frame, seq, rec AS record, ch AS channel, i AS intensity, d * fl * sin(b) AS x, d * fl * cos(b) AS y, d * uz AS z FROM t)
SELECT stream_id, frame, seq, record, channel, intensity, {_xyz(3)} FROM p WHERE y >= 1.8 AND abs(x) <= 60 AND abs(y) <= 60 AND z <= 2.5""")
def d28(spark, sf):
    s = F.col("seq")
    tilt = lambda r: (s * 41 + r * 389) % 9000 - 4500
    low = lambda r: F.pmod(tilt(r), F.lit(16384)) + (s + r) % 4 * 16384
    one = lambda r: F.when((s + r) % 50 == 0, F.lit(sweeps.MARKER + "000000")).otherwise(F.concat(_bytes((s * 97 + r * 211) % 12000 - 6000, 2), _bytes(low(r), 2), _bytes((s * 1009 + r * 7919) % 20000, 3), _bytes((s + r) % 256, 1)))
    rows = _suppliers(spark, sf).select("stream_id", "seq", F.unhex(F.concat(_each(149, one), F.lit("00" * 14))).alias("payload"))
    return _r(sweeps.galvo_points(rows), ("stream_id", "frame", "seq", "record", "channel", "intensity"), ("x", "y", "z"), 3)


@query("d29_flat_scan", f"""WITH c AS (SELECT user_id AS stream_id, event_id AS seq, (CAST(round(value * 100) AS BIGINT) * 7) % 36000 / 100.0::DOUBLE AS st FROM events), l AS (SELECT *, lag(st) OVER (PARTITION BY stream_id ORDER BY seq) AS pv FROM c),
f AS (SELECT *, sum(CASE WHEN pv - st > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq)::BIGINT AS frame FROM l), p AS (SELECT stream_id, frame, seq, pt AS point, (seq + pt) % 256 AS intensity, CASE WHEN (seq + pt) % 11 <> 0 THEN (seq * 13 + pt * 100) % 30000 / 1000.0::DOUBLE END AS d, CASE WHEN st + pt * (15 / 42.0::DOUBLE) >= 360 THEN st + pt * (15 / 42.0::DOUBLE) - 360 ELSE st + pt * (15 / 42.0::DOUBLE) END AS a FROM f, (SELECT unnest(range(0, 42)) AS pt))
SELECT stream_id, frame, seq, point, intensity, round(d * sin(radians(a)), 4) + 0.0 AS x, round(d * cos(radians(a)), 4) + 0.0 AS y FROM p""")
def d29(spark, sf):
    s = F.col("seq")
    one = lambda k: F.concat(F.when((s + k) % 11 == 0, F.lit("FFFF")).otherwise(_bytes((s * 13 + k * 100) % 30000, 2)), _bytes((s + k) % 256, 1))
    dealt = fixtures.blocks(spark, sf).repartition(4 * spark.sparkContext.defaultParallelism)  # a file that is one task's becomes packets
    rows = dealt.select("stream_id", "seq", F.unhex(F.concat(F.lit("00" * 4), _bytes(F.col("azimuth"), 2), _each(42, one))).alias("payload"))
    return _r(sweeps.flat_scan(materialize(rows, "packets")), ("stream_id", "frame", "seq", "point", "intensity"), ("x", "y"))


# --- framing ------------------------------------------------------------------------------------------------------

SEQ = "ranked AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS arrival FROM events), pk AS (SELECT stream_id, arrival, 1 + (CASE WHEN arrival % 10 = 3 THEN arrival + 1 WHEN arrival % 10 = 4 THEN arrival - 1 ELSE arrival END) % 60 AS seq FROM ranked)"
SQL["f03_split_by_sequence"] = f"""WITH RECURSIVE {SEQ}, run AS (SELECT stream_id, arrival, seq, CASE WHEN seq > 0 THEN seq ELSE 0 END AS prev, 0 AS frame FROM pk WHERE arrival = 1
UNION ALL SELECT p.stream_id, p.arrival, p.seq, CASE WHEN p.seq < greatest(0, r.prev - 10) OR p.seq BETWEEN r.prev AND r.prev + 10 OR (r.prev = 0 AND p.seq > 0) THEN p.seq ELSE r.prev END, r.frame + CASE WHEN p.seq < greatest(0, r.prev - 10) THEN 1 ELSE 0 END
FROM run r JOIN pk p ON p.stream_id = r.stream_id AND p.arrival = r.arrival + 1) SELECT stream_id, arrival, seq, frame, frame > 0 AND seq = max(seq) OVER (PARTITION BY stream_id ORDER BY arrival) AS complete FROM run"""


# --- ground, clusters, indices ------------------------------------------------------------------------------------


def _open_sql() -> str:
    """The opened surfaces of the windows 1, 2 and 4, one behind another."""
    ctes, last = ['gr0 AS (SELECT frame_id, floor(y / 200.0)::BIGINT AS gr, floor(x / 200.0)::BIGINT AS gc, min(z)::DOUBLE AS s FROM pts GROUP BY 1, 2, 3)'], "gr0"
    for k, w in enumerate((1, 2, 4)):
        for f in ("min", "max"):
            for a, b in (("gr", "gc"), ("gc", "gr")):
                name = f"o{k}{f}{a}"
                ctes.append(f"{name} AS (SELECT * EXCLUDE (s), {f}(s) OVER (PARTITION BY frame_id, {a} ORDER BY {b} RANGE BETWEEN {w} PRECEDING AND {w} FOLLOWING) AS s FROM {last})")
                last = name
        ctes.append(f"s{k} AS (SELECT *, s AS s{k} FROM {last})")
        last = f"s{k}"
    return ", ".join(ctes)


SQL["c01_morphological_ground"] = f"""WITH {P}, {_open_sql()}, j AS (SELECT p.frame_id, p.z, p.z - s0 <= 100 AND p.z - s1 <= 300 AND p.z - s2 <= 500 AS is_ground FROM pts p JOIN s2 g ON g.frame_id = p.frame_id AND g.gr = floor(p.y / 200.0)::BIGINT AND g.gc = floor(p.x / 200.0)::BIGINT)
SELECT frame_id, is_ground, count(*) AS n, sum(z)::BIGINT AS sum_z FROM j GROUP BY 1, 2"""


@query("c03_extract_rest", f"WITH {NEAR} SELECT frame_id, point_id FROM num WHERE (frame_id, point_id) NOT IN (SELECT (frame_id, point_id) FROM near)")
def c03(spark, sf):
    """The points that touch no other one."""
    pts = _numbered(spark, sf)
    return T.extract(pts, T.radius_outliers(pts, 60, 1), negative=True).select("frame_id", "point_id")


@query("c04_euclidean_clusters", f"""WITH RECURSIVE {NEAR}, reach AS (SELECT frame_id, point_id, point_id AS label FROM num UNION SELECT n.frame_id, n.other, r.label FROM reach r JOIN near n ON n.frame_id = r.frame_id AND n.point_id = r.point_id WHERE r.label < n.other),
lab AS (SELECT frame_id, point_id, min(label) AS cluster_id FROM reach GROUP BY 1, 2) SELECT frame_id, point_id, cluster_id FROM lab WHERE (frame_id, cluster_id) IN (SELECT (frame_id, cluster_id) FROM lab GROUP BY frame_id, cluster_id HAVING count(*) BETWEEN 2 AND 40)""")
def c04(spark, sf):
    return T.euclidean_clusters(_numbered(spark, sf), 60, 2, 40).select("frame_id", "point_id", "cluster_id")


# --- curbs --------------------------------------------------------------------------------------------------------

MERGED = f"""{DESC}, lg AS (SELECT *, least(17, floor(angle / 10)) AS rg FROM an WHERE length > 63), pr AS (SELECT p.frame_id, p.line_id AS cluster_id, q.line_id, p.angle AS pa, [p.ax, p.bx, q.ax, q.bx] AS xs, [p.ay, p.by_, q.ay, q.by_] AS ys FROM lg p JOIN lg q ON p.frame_id = q.frame_id AND p.line_id <> q.line_id WHERE abs(p.angle - q.angle) < 6),
mm AS (SELECT *, list_sum(xs) / 4 AS mx, list_sum(ys) / 4 AS my FROM pr), mo AS (SELECT *, list_transform(xs, lambda x: x - mx) AS u, list_transform(ys, lambda y: y - my) AS v FROM mm),
th AS (SELECT *, 0.5 * atan2(2 * list_dot_product(u, v), list_dot_product(u, u) - list_dot_product(v, v)) AS t FROM mo),
ok AS (SELECT *, CASE WHEN degrees(t) < 0 THEN degrees(t) + 180 ELSE degrees(t) END AS fa, (abs(sin(t) * u[1] - cos(t) * v[1]) + abs(sin(t) * u[2] - cos(t) * v[2]) + abs(sin(t) * u[3] - cos(t) * v[3]) + abs(sin(t) * u[4] - cos(t) * v[4])) / 4 AS d FROM th)"""


@query("l04_merged_lines", f"WITH {MERGED} SELECT frame_id, line_id AS cluster_id, line_id FROM lg UNION ALL SELECT frame_id, cluster_id, line_id FROM ok WHERE abs(fa - pa) < 4 AND d < 8")
def l04(spark, sf):
    return curbs.merge_lines(lines.describe(_seg(spark, sf)), 6.0, 4.0, 8.0)


@query("l05_first_fit", f"""WITH RECURSIVE {DESC}, nm AS (SELECT frame_id, line_id, angle::DOUBLE AS v, ((ax + bx) / 2)::DOUBLE AS m, row_number() OVER (PARTITION BY frame_id ORDER BY line_id) AS k FROM an WHERE angle >= 60),
run AS (SELECT frame_id, line_id, k, [v] AS vs, [m] AS ms, 0::BIGINT AS cluster_id FROM nm WHERE k = 1
UNION ALL SELECT frame_id, line_id, k, CASE WHEN hit > 0 THEN vs ELSE list_append(vs, v) END, CASE WHEN hit > 0 THEN ms ELSE list_append(ms, m) END, CASE WHEN hit > 0 THEN hit - 1 ELSE len(vs) END
 FROM (SELECT n.*, r.vs, r.ms, coalesce(list_position(list_transform(list_zip(r.vs, r.ms), lambda h: abs(h[1] - n.v) < 8 AND abs(h[2] - n.m) < 40), TRUE), 0) AS hit FROM run r JOIN nm n ON n.frame_id = r.frame_id AND n.k = r.k + 1))
SELECT frame_id, line_id, cluster_id FROM run""")
def l05(spark, sf):
    return curbs.first_fit(lines.describe(_seg(spark, sf)), "angle", 8.0, least_angle=60.0, middle=40.0)


@query("l06_chosen_lines")
def l06(spark, sf):
    d = lines.describe(_seg(spark, sf)).withColumn("stream_id", F.lit(1)).withColumn("side", F.when(F.col("ax") < 200, "left").otherwise("right"))
    one = curbs.one_of_equals(d)
    return curbs.choose_lines(one, curbs.merge_lines(one, 6.0, 4.0, 8.0))


@query("l09_ransac_lines")
def l09(spark, sf):
    return curbs.ransac_line(fixtures.points(spark, sf), 60.0, ("frame_id", "ring"))


@query("l10_contours", f"WITH {FIT}, t AS (SELECT *, abs(degrees(0.5::DOUBLE * atan2(2 * vxy, vx - vy))) AS a, sx::DOUBLE / n AS cx FROM v) SELECT p.frame_id, p.ring, p.x, p.y FROM pts p JOIN t USING (frame_id, ring) WHERE t.n > 25 AND t.a >= 1 AND p.x < t.cx")
def l10(spark, sf):
    """The points left of the centroids of the rings that slope by a degree or more."""
    keys = ("frame_id", "ring")
    return curbs.side_of_centroid(curbs.keep_contours(fixtures.points(spark, sf), least_angle=1.0, keys=keys), "right", keys).select(*keys, "x", "y")


@query("l12_line_ends", f"WITH {FIT}, t AS (SELECT *, tan(0.5::DOUBLE * atan2(2 * vxy, vx - vy)) AS k FROM v), b AS (SELECT *, sy::DOUBLE / n - k * (sx::DOUBLE / n) AS b FROM t) SELECT frame_id, ring, round(b / 100, 3) + 0.0 AS b, round((0 - b) / k / 1000, 3) + 0.0 AS x0, round((30 - b) / k / 1000, 3) + 0.0 AS x1 FROM b")
def l12(spark, sf):
    fit = lines.line_ends(lines.orthogonal_fit(fixtures.points(spark, sf), ["frame_id", "ring"]))
    return fit.select("frame_id", "ring", (F.round(F.col("b") / 100, 3) + 0.0).alias("b"), *((F.round(F.col(c) / 1000, 3) + 0.0).alias(c) for c in ("x0", "x1")))


@query("l14_polar_lines", f"WITH {DESC}, k AS (SELECT line_id, (by_ - ay) / (bx - ax) AS k, ay - (by_ - ay) / (bx - ax) * ax AS b FROM an WHERE bx <> ax), p AS (SELECT *, atan(k) + pi() / 2 AS theta, abs(b) / sqrt(k * k + 1) AS d FROM k) SELECT line_id, round(theta, 6) AS theta, round(d, 4) AS d, round(CASE WHEN abs(cos(theta)) < 1e-10 THEN 10000 ELSE -cos(theta) / sin(theta) END, 9) + 0.0 AS k FROM p")
def l14(spark, sf):
    s = lines.describe(_seg(spark, sf)).where("bx <> ax")
    k, b = geo.slope_intercept(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    theta, d = geo.polar_line(k, b)
    back, _ = geo.polar_to_slope(F.col("theta"), F.col("d"))
    return s.select("line_id", theta.alias("theta"), d.alias("d")).select("line_id", F.round("theta", 6).alias("theta"), F.round("d", 4).alias("d"), (F.round(back, 9) + 0.0).alias("k"))


def _orders(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Each customer's orders, one every tenth of a second."""
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey AS stream_id", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 100 AS ts_ms", *more)


KAL = """WITH RECURSIVE m AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) / 10.0::DOUBLE AS t, {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM orders),"""


@query("l15_line_filter", KAL.format(x="(o_orderkey % 40) / 10.0", y="o_orderkey % 300") + """ f AS (SELECT c, r, t, 0.001 + 2000::DOUBLE AS p00, 1000::DOUBLE AS p01, 1000.001::DOUBLE AS p11, 0::DOUBLE AS k, 0::DOUBLE AS kr, 0::DOUBLE AS b, 0::DOUBLE AS br, 0 AS done FROM m WHERE r = 1
UNION ALL SELECT c, r + 1, t, p00, p01, p11, k, kr, b, br, done FROM (SELECT u.c, u.r, n.t AS t, u.done + 1 AS done, dt, a00 + dt * a01 + dt * (a01 + dt * a11) + 0.001 AS p00, a01 + dt * a11 AS p01, a11 + 0.001 AS p11, k2 + dt * kr2 AS k, kr2 AS kr, b2 + dt * br2 AS b, br2 AS br
 FROM (SELECT f.c, f.r, f.done, (f.p00 - f.p00 / (f.p00 + 1) * f.p00) AS a00, f.p01 - f.p00 / (f.p00 + 1) * f.p01 AS a01, f.p11 - f.p01 / (f.p00 + 1) * f.p01 AS a11, least(3, greatest(1, f.k + f.p00 / (f.p00 + 1) * (m.x - f.k))) AS k2, f.kr + f.p01 / (f.p00 + 1) * (m.x - f.k) AS kr2, f.b + f.p00 / (f.p00 + 1) * (m.y - f.b) AS b2, f.br + f.p01 / (f.p00 + 1) * (m.y - f.b) AS br2, f.t AS t0 FROM f JOIN m ON m.c = f.c AND m.r = f.r) u JOIN m n ON n.c = u.c AND n.r = u.r + 1, LATERAL (SELECT (n.t - u.t0)::DOUBLE AS dt)))
SELECT f.c AS stream_id, f.r AS step, round(least(3, greatest(1, f.k + f.p00 / (f.p00 + 1) * (m.x - f.k))), 4) + 0.0 AS fk, round(f.b + f.p00 / (f.p00 + 1) * (m.y - f.b), 3) + 0.0 AS fb FROM f JOIN m ON m.c = f.c AND m.r = f.r""")
def l15(spark, sf):
    rows = _orders(spark, sf, "'x' AS side", "(o_orderkey % 40) / 10D AS k", "CAST(o_orderkey % 300 AS DOUBLE) AS b")
    got = curbs.smooth_lines(rows, 1.0, 3.0)
    return got.select("stream_id", F.expr("ts_ms div 100").alias("step"), (F.round("fk", 4) + 0.0).alias("fk"), (F.round("fb", 3) + 0.0).alias("fb"))


_EDGES = curbs.EdgeConfig(-4000, 4000, 7000, 7000, 0.02, 200, 100, 8, 20, 30, 20.0, (0.0, 6000.0))


def _edge_points(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams of frames whose x lies around 0, y ahead."""
    return fixtures.points(spark, sf).select((F.col("ring") % 2).alias("stream_id"), "frame_id", (F.col("x") - 4500).alias("x"), (F.col("y") + 3000).alias("y"))


@query("l17_edges")
def l17(spark, sf):
    """Both sides of each stream's frames."""
    return curbs.edges(_edge_points(spark, sf), _EDGES)


@query("l17_edge_messages")
def l17_messages(spark, sf):
    """Messages of the mean lines of every second frame."""
    return packets.curb_messages(curbs.edge_averages(_edge_points(spark, sf), 2, _EDGES))


@query("l18_polynomials", f"""WITH {P}, s AS (SELECT frame_id, ring, (x - 4500) / 1000.0::DOUBLE AS t, y / 1000.0::DOUBLE AS y FROM pts),
m AS (SELECT frame_id, ring, sum(1.0::DOUBLE) AS p0, sum(t) AS p1, sum(t * t) AS p2, sum(t * t * t) AS p3, sum(t * t * t * t) AS p4, sum(y) AS q0, sum(y * t) AS q1, sum(y * t * t) AS q2 FROM s GROUP BY 1, 2 HAVING count(DISTINCT t) > 2),
d AS (SELECT *, p0 * (p2 * p4 - p3 * p3) - p1 * (p1 * p4 - p3 * p2) + p2 * (p1 * p3 - p2 * p2) AS det FROM m),
c AS (SELECT frame_id, ring, (q0 * (p2 * p4 - p3 * p3) - p1 * (q1 * p4 - p3 * q2) + p2 * (q1 * p3 - p2 * q2)) / det AS c0, (p0 * (q1 * p4 - q2 * p3) - q0 * (p1 * p4 - p3 * p2) + p2 * (p1 * q2 - q1 * p2)) / det AS c1, (p0 * (p2 * q2 - p3 * q1) - p1 * (p1 * q2 - q1 * p2) + q0 * (p1 * p3 - p2 * p2)) / det AS c2 FROM d)
SELECT frame_id, ring, x, round(c0 + c1 * (x - 4500) / 1000 + c2 * (x - 4500) / 1000 * (x - 4500) / 1000, 5) + 0.0 AS y FROM c, (SELECT unnest(range(0, 8)) * 1000.0::DOUBLE + 1000 AS x)""")
def l18(spark, sf):
    """Parabolas fitted to each ring's points, whose x lies far from 0, and sampled along it."""
    pts = fixtures.points(spark, sf).select("frame_id", "ring", "x", (F.col("y") / 1000.0).alias("y"))
    enough = pts.groupBy("frame_id", "ring").agg(F.count_distinct("x").alias("n")).where("n > 2").select("frame_id", "ring")
    fit = lines.polynomial_fit(pts.join(enough, ["frame_id", "ring"], "left_semi"), ["frame_id", "ring"], 2).withColumns({"k": F.lit(0.0), "b": F.lit(0.0)})
    return lines.sample_curve(fit, 1000.0, 8000.0, 1000.0).select("frame_id", "ring", "x", (F.round("y", 5) + 0.0).alias("y"))


@query("k05_curb_messages", "WITH n AS (SELECT o_custkey AS stream_id, o_orderkey // 8 AS ts, string_agg(o_orderkey::VARCHAR || ':' || (o_custkey % 100) || ':' || (o_orderkey % 77), ',' ORDER BY o_orderkey::VARCHAR) AS lanes FROM orders GROUP BY 1, 2) SELECT stream_id, ts, row_number() OVER (PARTITION BY stream_id ORDER BY ts) - 1 AS counter, lanes FROM n")
def k05(spark, sf):
    """Messages with the two points of each of their lanes."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey AS stream_id", "CAST(o_orderkey AS STRING) AS side", "o_orderkey div 8 AS ts", "CAST(o_custkey % 100 AS DOUBLE) AS x0", "0D AS y0", "CAST(o_orderkey % 77 AS DOUBLE) AS x1", "30D AS y1")
    lane = lambda l: F.concat_ws(":", l["side"], *(l["points"][k]["x"].cast("long").cast("string") for k in (0, 1)))
    return packets.curb_messages(rows).select("stream_id", "ts", "counter", F.array_join(F.transform("lanes", lane), ",").alias("lanes"))


@query("k01_packed_records", _with(OBB_SQL, "SELECT frame_id * 100 AS ts_ms, 1 AS return_val, least(n, 20)::INT AS obs_num, cluster_id::INT AS id, floor(x + 0.25)::BIGINT AS x, floor(y + 0.25)::BIGINT AS y, floor(depth + 0.25)::BIGINT AS depth, floor(height + 0.25)::BIGINT AS height FROM (SELECT a.frame_id, a.cluster_id, count(*) OVER (PARTITION BY a.frame_id) AS n, row_number() OVER (PARTITION BY a.frame_id ORDER BY a.cluster_id) AS r, coalesce(cx, centre_x) AS x, coalesce(cy, centre_y) AS y, coalesce(length, size_x) AS depth, size_z::DOUBLE AS height FROM aabb a LEFT JOIN obb b USING (frame_id, cluster_id)) WHERE r <= 20"))
def k01(spark, sf):
    """Detections packed into records of 1216 bytes and read back."""
    clustered = _clustered(spark, sf)
    found = C.detections(C.summarise(clustered, CFG), C.oriented_boxes(clustered, CFG))
    boxes = found.select("frame_id", (F.col("frame_id") * 100).alias("ts_ms"), F.col("cluster_id").alias("id"), "depth", "width", "height", "x", "y", "z", F.lit(None).cast("array<struct<x:double,y:double>>").alias("corners"))
    back = binary_sinks.unpacked_obstacles(binary_sinks.obstacle_records(boxes)).select("ts_ms", "return_val", "obs_num", F.explode("obstacles").alias("o"))
    whole = lambda c: F.floor(F.col(f"o.{c}").cast("double") + 0.25).alias(c)
    return back.select("ts_ms", "return_val", "obs_num", "o.id", *(whole(c) for c in ("x", "y", "depth", "height")))


# --- tracks -------------------------------------------------------------------------------------------------------


@query("k13_smoothed", KAL.format(x="o_orderkey % 50", y="o_orderkey % 7") + """ f AS (SELECT c, r, t, x AS px, y AS py, 0::DOUBLE AS vx, 0::DOUBLE AS vy, 1::DOUBLE AS p FROM m WHERE r = 1
UNION ALL SELECT c, r, t, px + k * (x - px), py + k * (y - py), vx + k * (x - (px + k * (x - px))) / greatest(p, 0.001), vy + k * (y - (py + k * (y - py))) / greatest(p, 0.001), (1 - k) * p FROM (SELECT n.c, n.r, n.t, n.x, n.y, f.px + f.vx * (n.t - f.t) AS px, f.py + f.vy * (n.t - f.t) AS py, f.vx, f.vy, f.p + 0.01 AS p, (f.p + 0.01) / (f.p + 0.01 + 0.5) AS k FROM f JOIN m n ON n.c = f.c AND n.r = f.r + 1))
SELECT c AS stream_id, r AS step, round(px, 4) + 0.0 AS fx, round(py, 4) + 0.0 AS fy FROM f""")
def k13(spark, sf):
    rows = _orders(spark, sf, "0 AS track_id", "o_orderkey % 50 AS x", "o_orderkey % 7 AS y")
    return tracking.smooth(rows).select("stream_id", F.expr("ts_ms div 100").alias("step"), (F.round("fx", 4) + 0.0).alias("fx"), (F.round("fy", 4) + 0.0).alias("fy"))


# --- map ----------------------------------------------------------------------------------------------------------


@query("m10_road_junctions", "SELECT r_regionkey::BIGINT + 1 AS road_id, coalesce((SELECT max(n_nationkey::BIGINT + 1) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 2 = 0), 0) AS junction_id FROM region")
def m10(spark, sf):
    roads = spark.read.parquet(f"{sf}/region.parquet").selectExpr("CAST(r_regionkey AS BIGINT) + 1 AS road_id")
    junctions = spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey % 2 = 0").selectExpr("CAST(n_nationkey AS BIGINT) + 1 AS junction_id", "array(CAST(n_regionkey AS BIGINT) + 1) AS connect")
    return mapjoin.road_junctions(roads, junctions)


# --- geodesy ------------------------------------------------------------------------------------------------------

#: Places within three degrees of 13.5 E, 47.25 N, one for each event.
_PLACES_SQL = "pl AS (SELECT event_id, 13.5 + (event_id * 37 % 6001 - 3000) / 1000.0::DOUBLE AS lon, 47.25 + (event_id * 53 % 6001 - 3000) / 1000.0::DOUBLE AS lat FROM events)"


def _places(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "13.5D + (event_id * 37 % 6001 - 3000) / 1000D AS lon", "47.25D + (event_id * 53 % 6001 - 3000) / 1000D AS lat")


@query("m06_heading_offset", f"WITH {POSES_SQL} SELECT event_id, round(cos(radians(heading_deg + 93.5::DOUBLE)) * -1.5::DOUBLE + sin(radians(heading_deg + 93.5::DOUBLE)) * 4 + x, 6) + 0.0 AS mx, round(cos(radians(heading_deg + 93.5::DOUBLE)) * 4 - sin(radians(heading_deg + 93.5::DOUBLE)) * -1.5::DOUBLE + y, 6) + 0.0 AS my FROM poses")
def m06(spark, sf):
    """Vehicle to map with the offset between the sensor's heading and the pose's."""
    mx, my = geo.vehicle_to_map(F.lit(4.0), F.lit(1.5), F.col("x"), F.col("y"), F.col("heading_deg"), 93.5)
    return fixtures.poses(spark, sf).select("event_id", (F.round(mx, 6) + 0.0).alias("mx"), (F.round(my, 6) + 0.0).alias("my"))


@query("m07_east_north", f"""WITH {_PLACES_SQL}, r AS (SELECT *, radians(lon) AS l, radians(lat) AS p, radians(13.5::DOUBLE) AS l0, radians(47.25::DOUBLE) AS p0, {geo.E2}::DOUBLE AS e2, {geo.A}::DOUBLE AS a FROM pl), n AS (SELECT *, a / sqrt(1 - e2 * sin(p) * sin(p)) AS nn, a / sqrt(1 - e2 * sin(p0) * sin(p0)) AS n0 FROM r),
d AS (SELECT *, nn * cos(p) * cos(l) - n0 * cos(p0) * cos(l0) AS dx, nn * cos(p) * sin(l) - n0 * cos(p0) * sin(l0) AS dy, (1 - e2) * (nn * sin(p) - n0 * sin(p0)) AS dz FROM n)
SELECT event_id, round(cos(l0) * dy - sin(l0) * dx, 3) + 0.0 AS east, round(cos(p0) * dz - sin(p0) * (cos(l0) * dx + sin(l0) * dy), 3) + 0.0 AS north FROM d""")
def m07(spark, sf):
    east, north = geo.lonlat_to_enu(F.col("lon"), F.col("lat"), 13.5, 47.25)
    return _places(spark, sf).select("event_id", (F.round(east, 3) + 0.0).alias("east"), (F.round(north, 3) + 0.0).alias("north"))


_KRUEGER = " + ".join("{a}::DOUBLE * {{f}}({k} * xi) * {{g}}({k} * eta)".format(a=repr(a), k=2 * j) for j, a in enumerate(projection.FORWARD, 1))


@query("m08_transverse_mercator", f"""WITH {_PLACES_SQL}, r AS (SELECT *, sin(radians(lat)) AS s, radians(lon - 15) AS away, {repr(projection._ECC)}::DOUBLE AS e FROM pl), t AS (SELECT *, sinh(atanh(s) - e * atanh(e * s)) AS t FROM r),
x AS (SELECT *, atan2(t, cos(away)) AS xi, atanh(sin(away) / sqrt(1 + t * t)) AS eta FROM t)
SELECT event_id, round(500000 + {repr(0.9996 * projection._RADIUS)}::DOUBLE * (eta + {_KRUEGER.format(f='cos', g='sinh')}), 4) + 0.0 AS east, round({repr(0.9996 * projection._RADIUS)}::DOUBLE * (xi + {_KRUEGER.format(f='sin', g='cosh')}), 4) + 0.0 AS north, round(lon, 9) + 0.0 AS lon, round(lat, 9) + 0.0 AS lat FROM x""")
def m08(spark, sf):
    """Places to UTM and back again."""
    grid = projection.utm(33)
    east, north = projection.project(F.col("lon"), F.col("lat"), grid)
    there = _places(spark, sf).select("event_id", east.alias("east"), north.alias("north"))
    lon, lat = projection.unproject(F.col("east"), F.col("north"), grid)
    return there.select("event_id", (F.round("east", 4) + 0.0).alias("east"), (F.round("north", 4) + 0.0).alias("north"), (F.round(lon, 9) + 0.0).alias("lon"), (F.round(lat, 9) + 0.0).alias("lat"))


@query("d20_imu_samples", "SELECT event_id, round(((event_id * 131) % 65536 - CASE WHEN (event_id * 131) % 65536 >= 32768 THEN 65536 ELSE 0 END) / 32768.0::DOUBLE * 4, 6) + 0.0 AS ax, round(radians(((event_id * 977) % 65536 - CASE WHEN (event_id * 977) % 65536 >= 32768 THEN 65536 ELSE 0 END) / 32768.0::DOUBLE * 500), 6) + 0.0 AS gz FROM events")
def d20(spark, sf):
    payload = F.unhex(F.concat(F.lit("AA55"), _bytes(F.col("event_id") * 131 % 65536, 2), F.lit("0000" * 4), _bytes(F.col("event_id") * 977 % 65536, 2)))
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", payload.alias("payload"))
    got = D.imu(F.col("payload"), 2)
    return rows.select("event_id", (F.round(got["ax"], 6) + 0.0).alias("ax"), (F.round(got["gz"], 6) + 0.0).alias("gz"))


@query("d31_jumbo_parts", "SELECT s_suppkey AS seq, part, (s_suppkey * 7 + part) % 65536 AS value FROM supplier, (SELECT unnest(range(0, 63)) AS part) WHERE (s_suppkey + part) % 9 <> 4")
def d31(spark, sf):
    """The 63 packets of a datagram, some with another id."""
    s = F.col("seq")
    part = lambda k: F.concat(F.when((s + k) % 9 == 4, "55AB").otherwise("55AA"), _bytes((s * 7 + k) % 65536, 2), F.lit("00" * 980))
    rows = _suppliers(spark, sf).select("seq", F.unhex(F.concat(F.lit("00" * 160), _each(63, part), F.lit("00" * 10))).alias("payload"))
    return D.jumbo_parts(rows).select("seq", "part", D.unsigned(F.col("payload"), 2, 2).alias("value"))


# --- layers -------------------------------------------------------------------------------------------------------


@query("v02_all_classes", _with(REF_SQL, "SELECT frame_id, CASE WHEN is_ground THEN 'ground' ELSE 'other' END AS class, count(*) AS n FROM gcells GROUP BY 1, 2 UNION ALL SELECT frame_id, 'invalid', 30 * 36 - count(*) FROM gcells GROUP BY 1"))
def v02(spark, sf):
    return V.ground_classes(_detected(spark, sf), CFG)


@query("v04_reference_ramp", _with(CAND_SQL, "SELECT frame_id, ramp, count(*) AS n FROM (SELECT frame_id, coalesce(least(3, floor((ref - lo) * 4 / nullif(hi - lo, 0))::INT), 0) AS ramp FROM (SELECT *, min(ref) OVER (PARTITION BY frame_id) AS lo, max(ref) OVER (PARTITION BY frame_id) AS hi FROM cand)) GROUP BY 1, 2"))
def v04(spark, sf):
    return V.reference_ramp(_detected(spark, sf)).groupBy("frame_id", "ramp").agg(F.count(F.lit(1)).alias("n"))


def _drawn(shapes: DataFrame) -> DataFrame:
    """Shapes with their pixels written one behind another."""
    return shapes.withColumn("outline", F.array_join(F.transform("outline", lambda p: F.concat_ws(":", p["u"].cast("string"), p["v"].cast("string"))), ","))


def _corner_sql(s: int, t: int, per: float) -> str:
    """A corner of an oriented box in pixels, moved by a thousandth of one so that corners on a pixel's edge fall to one side."""
    x = f"cx + {s} * length / 2 * cos(angle) - {t} * width / 2 * sin(angle)"
    y = f"cy + {s} * length / 2 * sin(angle) + {t} * width / 2 * cos(angle)"
    return f"floor(({x} - 900) / {per} + 0.001)::INT || ':' || (239 - floor(({y} + 3000) / {per} + 0.001)::INT)"


_BOX_SQL = " || ',' || ".join(_corner_sql(s, t, 25.0) for s, t in ((1, 1), (1, -1), (-1, -1), (-1, 1)))


@query("v07_box_outlines", _with(OBB_SQL, f"SELECT frame_id, cluster_id, round(cluster_id * 0.618033988749895::DOUBLE - floor(cluster_id * 0.618033988749895::DOUBLE), 6) AS hue, {_BOX_SQL} AS outline FROM obb"))
def v07(spark, sf):
    """All four corners of each box."""
    out = V.box_outlines(C.oriented_boxes(_clustered(spark, sf), CFG), 900 - 0.025, -3000 - 0.025, 25.0, 240)
    return _drawn(out).select("frame_id", F.col("id").alias("cluster_id"), F.round("hue", 6).alias("hue"), "outline")


@query("v08_cluster_overlay", _with(OBB_SQL, f"""SELECT frame_id, CASE WHEN max(CASE WHEN z > -1200 THEN 1 ELSE 0 END) = 1 THEN 'obstacle' ELSE 'ground' END AS shape, NULL::BIGINT AS id, u || ':' || v AS outline FROM (SELECT frame_id, z, floor((x - 900) / 25.0 + 0.001)::INT AS u, 239 - floor((y + 3000) / 25.0 + 0.001)::INT AS v FROM pts) GROUP BY frame_id, u, v
UNION ALL SELECT frame_id, 'box', cluster_id, {_BOX_SQL} FROM obb
UNION ALL SELECT frame_id, 'polygon', n_nationkey, floor((a - 900) / 25.0 + 0.001)::INT || ':' || 239 || ',' || floor((a + 250 - 900) / 25.0 + 0.001)::INT || ':' || 239 || ',' || floor((a + 250 - 900) / 25.0 + 0.001)::INT || ':' || 199 FROM (SELECT frame_id, n_nationkey, n_nationkey * 250 AS a FROM nation, (SELECT DISTINCT frame_id FROM pts))"""))
def v08(spark, sf):
    """Every pixel that points cover, every box and the sections of a road."""
    pts = fixtures.points(spark, sf).withColumn("is_obstacle", F.col("z") > -1200)
    corner = lambda x, y: F.struct((F.col("n_nationkey") * 250 + x).cast("double").alias("x"), F.lit(float(y)).alias("y"))
    frames = pts.select("frame_id").distinct()
    sections = spark.read.parquet(f"{sf}/nation.parquet").withColumn("frame_id", F.explode(F.sequence(F.lit(0), F.lit(7)))).join(frames, "frame_id", "left_semi")
    polygons = sections.select("frame_id", F.col("n_nationkey").alias("section_id"), F.array(corner(0, -3000), corner(250, -3000), corner(250, -2000)).alias("polygon"))
    out = V.cluster_overlay(pts, C.oriented_boxes(_clustered(spark, sf), CFG), 900 - 0.025, -3000 - 0.025, 25.0, 240, polygons)
    return _drawn(out).select("frame_id", "shape", "id", "outline")


_AT = "floor(({x}) / 50.0)::INT || ':' || (239 - floor((({y}) + 3000) / 50.0)::INT)"


@query("v09_track_overlay", f"""WITH {P}, {POSES_SQL}, t AS (SELECT event_id % 8 AS frame_id, event_id AS track_id, x * 80 AS x, y * 100 - 2500 AS y FROM poses)
SELECT frame_id, CASE WHEN max(CASE WHEN z > -1200 THEN 1 ELSE 0 END) = 1 THEN 'obstacle' ELSE 'ground' END AS shape, NULL::BIGINT AS id, u || ':' || v AS outline FROM (SELECT frame_id, z, floor(x / 50.0)::INT AS u, 239 - floor((y + 3000) / 50.0)::INT AS v FROM pts) GROUP BY frame_id, u, v
UNION ALL SELECT frame_id, 'arrow', track_id, {_AT.format(x='x', y='y')} || ',' || {_AT.format(x='x + 150', y='y - 70')} FROM t
UNION ALL SELECT frame_id, 'track', track_id, {_AT.format(x='x - 200', y='y - 110')} || ',' || {_AT.format(x='x + 200', y='y - 110')} || ',' || {_AT.format(x='x + 200', y='y + 110')} || ',' || {_AT.format(x='x - 200', y='y + 110')} FROM t WHERE track_id % 3 <> 0""")
def v09(spark, sf):
    """Points, tracks with arrows, and the outlines of those that have corners."""
    x, y = F.col("x"), F.col("y")
    corners = F.array(*(F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((-200, -110), (200, -110), (200, 110), (-200, 110))))
    tracks = fixtures.poses(spark, sf).select((F.col("event_id") % 8).alias("frame_id"), F.col("event_id").alias("track_id"), (x * 80).alias("x"), (y * 100 - 2500).alias("y"), F.lit(150.0).alias("vx"), F.lit(-70.0).alias("vy"))
    tracks = tracks.withColumn("corners", F.when(F.col("track_id") % 3 != 0, corners))
    pts = fixtures.points(spark, sf).withColumn("is_obstacle", F.col("z") > -1200)
    return _drawn(V.track_overlay(pts, tracks, 0, -3000, 50.0, 240)).select("frame_id", "shape", "id", "outline")


@query("v11_nearest_vertex", f"WITH {POSES_SQL}, l AS (SELECT n_nationkey * 11 + o AS vertex_id, (n_nationkey * 40 + 2)::DOUBLE AS vx, (o * 50)::DOUBLE AS vy FROM nation, (SELECT unnest(range(0, 11)) AS o)) SELECT event_id, arg_min(vertex_id, [((x - vx) * (x - vx) + (y - vy) * (y - vy)), vertex_id]) AS vertex_id, round(sqrt(min((x - vx) * (x - vx) + (y - vy) * (y - vy))), 6) AS distance FROM poses, l GROUP BY 1")
def v11(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    vertices = n.selectExpr("n_nationkey", "explode(sequence(0, 10)) AS o").selectExpr("CAST(n_nationkey * 11 + o AS BIGINT) AS vertex_id", "CAST(n_nationkey * 40 + 2 AS DOUBLE) AS x", "CAST(o * 50 AS DOUBLE) AS y")
    return V.nearest_vertex(fixtures.poses(spark, sf), vertices, 5.0, "event_id").select("event_id", "vertex_id", F.round("distance", 6).alias("distance"))


@query("v12_bird_eye", f"WITH {P}, q AS (SELECT frame_id, trunc(y * -0.05::DOUBLE + 160)::INT AS u, trunc(x * 0.05::DOUBLE - 30)::INT AS v FROM pts) SELECT frame_id, u, v, count(*) AS n FROM q WHERE u >= 0 AND u < 300 AND v >= 0 AND v < 360 GROUP BY 1, 2, 3")
def v12(spark, sf):
    return V.bird_eye_points(fixtures.points(spark, sf), 0.05, 160, -30, 300, 360)


@query("v12_lane_pixels", "SELECT o_orderkey AS lane, trunc(-(o_orderkey % 30) * 2.0 + 50)::INT AS u0, trunc((o_custkey % 40) * 2.0 + 7)::INT AS v0 FROM orders")
def v12_lanes(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS lane", "CAST(o_custkey % 40 AS DOUBLE) AS x0", "CAST(o_orderkey % 30 AS DOUBLE) AS y0", "0D AS x1", "0D AS y1")
    return V.lane_pixels(rows, 2.0, 50, 7).select("lane", "u0", "v0")


QUERIES = Q
