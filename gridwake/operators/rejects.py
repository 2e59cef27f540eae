"""What goes wrong beyond a packet's own bytes, and counters beside the data.

`counted` puts a counter for each code of decode.CODES beside a DataFrame with a column `fault`: one action gives data and counts.
The other functions give rows (keys, fault, code) of what decode.faults, which looks at single packets, can't see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gridwake.operators import ranges
from gridwake.operators.decode import CODES

#: Points of a cloud at most.
MOST_POINTS = 5_000_000


def code_of(fault: Column) -> Column:
    """The number of a fault's name, 0 for none."""
    return F.coalesce(F.create_map(*(F.lit(v) for pair in CODES.items() for v in pair))[fault], F.lit(0))


def counted(rows: DataFrame, name: str = "faults", column: str = "fault") -> tuple[DataFrame, Observation]:
    """rows as they are, and an observation that has, once an action over them has ended, rows, those without a fault (success), and the number of each fault of CODES."""
    seen = Observation(name)
    each = [F.count_if(F.col(column) == fault).alias(fault) for fault in CODES if fault != "success"]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(column).isNull()).alias("success"), *each), seen


def silences(packets: DataFrame, timeout_us: int = 1_000_000, time: str = "ts_us", order: str | None = None) -> DataFrame:
    """(stream_id, from, to, fault, code): stretches of more than the timeout in which a stream has no packet: 'no_packets'. Packets stand in the order of their time, or of another column."""
    own = packets.select("stream_id", F.col(time).alias("to"), *([F.col(order).alias("_order")] if order else []))
    own = ranges.with_previous(own, "stream_id", "_order" if order else "to", "to", "from")
    return own.where(F.col("to") - F.col("from") > timeout_us).select("stream_id", "from", "to", F.lit("no_packets").alias("fault"), F.lit(CODES["no_packets"]).alias("code"))


def frame_faults(frames: DataFrame, points: DataFrame, keys: tuple[str, ...] = ("frame_id",), most: int = MOST_POINTS) -> DataFrame:
    """(keys, n, fault, code) of each frame: 'no_points' without a point, 'cloud_overflow' with more than `most`, null and 0 otherwise. Points without coordinates count as they do in a cloud that is not dense."""
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = frames.select(*keys).distinct().join(n, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fault = F.when(F.col("n") == 0, "no_points").when(F.col("n") > most, "cloud_overflow")
    return out.withColumn("fault", fault).withColumn("code", code_of(F.col("fault")))


def within_limit(points: DataFrame, keys: tuple[str, ...] = ("frame_id",), most: int = MOST_POINTS) -> DataFrame:
    """Points of frames that do not overflow, if overflowing ones are to be dropped whole; frame_faults names those."""
    full = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return points.join(full.select(*keys), list(keys), "left_anti")


def device_faults(readings: DataFrame) -> DataFrame:
    """(stream_id, seq, fault, code): device packets whose angles are not ready or out of range, from calibration.readings: 'difop_not_parsed'."""
    return readings.where(~F.col("ready")).select("stream_id", "seq", F.lit("difop_not_parsed").alias("fault"), F.lit(CODES["difop_not_parsed"]).alias("code"))


def starts_early(packets: DataFrame, first_device: DataFrame) -> DataFrame:
    """(stream_id, seq, fault, code): point packets before their stream's first device packet (stream_id, seq): 'no_calibration'; all of a stream without one."""
    own = first_device.groupBy(F.col("stream_id").alias("_stream")).agg(F.min("seq").alias("_first"))
    early = packets.join(own, F.col("stream_id").eqNullSafe(F.col("_stream")), "left").where(F.col("_first").isNull() | (F.col("seq") < F.col("_first")))
    return early.select("stream_id", "seq", F.lit("no_calibration").alias("fault"), F.lit(CODES["no_calibration"]).alias("code"))


def replay_events(frames: DataFrame) -> DataFrame:
    """(file, pass, fault, code) of the format 'capture' replayed: 'file_repeats' for each pass over a file but its first, 'file_ends' for the last one."""
    passes = frames.groupBy("file", "pass").agg(F.count(F.lit(1)).alias("n")).select("file", "pass")
    again = passes.where("pass > 0").withColumn("fault", F.lit("file_repeats"))
    ends = passes.groupBy("file").agg(F.max("pass").alias("pass")).withColumn("fault", F.lit("file_ends"))
    out = again.unionByName(ends)
    return out.withColumn("code", code_of(F.col("fault")))
