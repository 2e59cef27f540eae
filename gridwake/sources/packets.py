"""Captures, point clouds and records as DataFrames.

Files are read by Spark's own readers, so any store that Spark reaches will do; a task parses whole files of a capture,
since the length of each of its records stands in the record before. Headers are cut by column expressions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwake.operators.decode import signed, unsigned

#: Magic numbers of capture files: byte order and ticks of a second; fixed values of the format.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000), b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000)}


def _frames(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(number, time in us, bytes) of each record; a record cut off by the file's end is left out."""
    order, ticks = MAGICS.get(content[:4], (None, 0))
    at, number = 24, 0
    while order and at + 16 <= len(content):
        sec, part, size, _ = struct.unpack_from(order + "IIII", content, at)
        if at + 16 + size > len(content):
            break
        yield number, sec * 1_000_000 + part * 1_000_000 // ticks, content[at + 16 : at + 16 + size]
        at, number = at + 16 + size, number + 1


def read_pcap(spark: SparkSession, path: str, rows_each: int = 4096) -> DataFrame:
    """(file, number, ts_us, frame) of the records of capture files, in batches of rows_each. A file is one row of Spark's reader, 2 GB at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                frames = _frames(content.as_buffer().to_pybytes())
                while rows := list(islice(frames, rows_each)):
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary())))], names=["file", "number", "ts_us", "frame"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, number bigint, ts_us bigint, frame binary")


def read_packets(spark: SparkSession, path: str, fmt: str = "pcap", ports: list[int] | None = None, user_layer: int = 0, tail: int = 0) -> DataFrame:
    """(file, number, port, payload) of UDP packets: 'pcap' takes unfragmented ones, 'jumbo' puts fragments together as well, 'raw' reads rows (file, number, frame) of a table."""
    frames = spark.read.parquet(path) if fmt == "raw" else read_pcap(spark, path)
    if fmt == "jumbo":
        d = F.col("datagram")
        out = reassemble(frames).select("file", "number", unsigned(d, 2, 2).cast("int").alias("port"), F.substr(d, F.lit(9 + user_layer), F.length(d) - 8 - user_layer - tail).alias("payload"))
        return out.where(F.col("port").isin(ports)) if ports else out
    if fmt not in ("pcap", "raw"):
        raise ValueError(f"no packets in the format {fmt}")
    return udp(frames, ports, user_layer, tail).select("file", "number", "port", "payload")


@dataclass(frozen=True)
class PoseLayout:
    """Where a pose message has its fields, as offsets in bytes; numbers are little-endian. The message's own layout is not part of the capture and must be given."""

    message_id: int = 0x0A
    id_at: int = 0
    length_at: int = 2
    head: int = 8
    body: int = 120
    ts_ms: int = 0  # 8 bytes; this and what follows counts from behind the head
    x_mm: int = 8  # 4 bytes, signed, as the next
    y_mm: int = 12
    heading_cdeg: int = 16


def pose_feed(packets: DataFrame, layout: PoseLayout = PoseLayout()) -> DataFrame:
    """(file, number, ts_ms, x, y, heading_deg) of the packets (payload) that are pose messages by their id, length and said length."""
    p, at = F.col("payload"), layout.head
    good = packets.where((F.length(p) >= layout.head + layout.body) & (unsigned(p, layout.id_at, 1) == layout.message_id) & (unsigned(p, layout.length_at, 2, True) >= layout.body))
    fields = {"x": (layout.x_mm, 1000.0), "y": (layout.y_mm, 1000.0), "heading_deg": (layout.heading_cdeg, 100.0)}
    time = unsigned(p, at + layout.ts_ms, 4, True) + unsigned(p, at + layout.ts_ms + 4, 4, True) * (1 << 32)
    return good.select("file", "number", time.alias("ts_ms"), *((signed(p, at + k, 4, True) / unit).alias(n) for n, (k, unit) in fields.items()))


def udp(frames: DataFrame, ports: list[int] | None = None, user_layer: int = 0, tail: int = 0) -> DataFrame:
    """Ethernet frames (with or without a VLAN tag) of IPv4 and UDP with port and payload; others are left out."""
    f = F.col("frame")
    vlan = F.when(unsigned(f, 12, 2) == 0x8100, 4).otherwise(0)
    out = frames.withColumn("_ip", vlan + 14).where(unsigned(f, F.col("_ip") - 2, 2) == 0x0800)
    out = out.withColumn("_udp", F.col("_ip") + unsigned(f, F.col("_ip"), 1).bitwiseAND(15) * 4)
    out = out.where((unsigned(f, F.col("_ip") + 9, 1) == 17) & (unsigned(f, F.col("_ip") + 6, 2).bitwiseAND(0x1FFF) == 0))
    out = out.withColumn("port", unsigned(f, F.col("_udp") + 2, 2).cast("int"))
    if ports:
        out = out.where(F.col("port").isin(ports))
    size = unsigned(f, F.col("_udp") + 4, 2) - 8 - user_layer - tail
    return out.withColumn("payload", F.substr("frame", (F.col("_udp") + 9 + user_layer).cast("int"), size.cast("int"))).drop("_ip", "_udp", "frame")


def reassemble(frames: DataFrame) -> DataFrame:
    """(file, number, ip_id, datagram) of UDP datagrams over IPv4, whole ones and those whose fragments are all there and fit together.

    The 16-bit id of a datagram comes again and again, so fragments belong to the datagram whose first fragment came last
    among those of their file, addresses and id; one that comes before the first is left out, as is an incomplete datagram.
    A repeated fragment counts once. number is that of the first fragment. The fragments of a datagram are a small group: 64 KB at most.
    """
    f = F.col("frame")
    ip = F.when(unsigned(f, 12, 2) == 0x8100, 18).otherwise(14)
    parts = frames.withColumn("ip", ip).where((unsigned(f, F.col("ip") - 2, 2) == 0x0800) & (unsigned(f, F.col("ip") + 9, 1) == 17))
    head, flags = unsigned(f, F.col("ip"), 1).bitwiseAND(15) * 4, unsigned(f, F.col("ip") + 6, 2)
    body = F.substr(f, (F.col("ip") + 1 + head).cast("int"), (unsigned(f, F.col("ip") + 2, 2) - head).cast("int"))
    hosts = F.substr(f, (F.col("ip") + 13).cast("int"), F.lit(8))
    parts = parts.select("file", "number", hosts.alias("hosts"), unsigned(f, F.col("ip") + 4, 2).alias("ip_id"), (flags.bitwiseAND(0x1FFF) * 8).alias("off"), (flags.bitwiseAND(0x2000) != 0).alias("more"), body.alias("body"))
    whole = parts.where("off = 0 AND NOT more").select("file", "number", "ip_id", F.col("body").alias("datagram"))
    same = Window.partitionBy("file", "hosts", "ip_id").orderBy("number")
    cut = parts.where("off > 0 OR more").withColumn("first", F.max(F.when(F.col("off") == 0, F.col("number"))).over(same)).where("first IS NOT NULL")
    cut = cut.groupBy("file", "ip_id", F.col("first").alias("number"), "off").agg(F.min_by(F.struct("more", "body"), "number").alias("p"))
    cut = cut.groupBy("file", "number", "ip_id").agg(F.array_sort(F.collect_list(F.struct("off", "p.more", "p.body"))).alias("p"))
    ends = F.aggregate("p", F.lit(0).cast("bigint"), lambda at, p: F.when(at == p["off"], at + F.length(p["body"])).otherwise(-1))
    cut = cut.where((ends >= 0) & ~F.element_at(F.col("p.more"), -1) & (F.size(F.filter("p", lambda p: ~p["more"])) == 1))
    joined = F.unhex(F.array_join(F.transform("p", lambda p: F.hex(p["body"])), ""))
    return whole.unionByName(cut.select("file", "number", "ip_id", joined.alias("datagram")))


def fixed_records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(file, number, record): files cut into records of a fixed size; a rest is left out."""
    whole = spark.read.format("binaryFile").load(path)
    n = F.floor(F.col("length") / size).cast("int")
    return whole.where(n > 0).select(F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("number")).select("file", "number", F.substr("content", F.col("number") * size + 1, F.lit(size)).alias("record"))


_TYPES = {("F", 4): "<f4", ("F", 8): "<f8", ("U", 1): "<u1", ("U", 2): "<u2", ("U", 4): "<u4", ("I", 1): "<i1", ("I", 2): "<i2", ("I", 4): "<i4"}


def _cloud(content: bytes) -> dict[str, np.ndarray]:
    head, at = {}, 0
    while "DATA" not in head:
        end = content.index(b"\n", at)
        line = content[at:end].decode().split()
        at = end + 1
        if line and not line[0].startswith("#"):
            head[line[0]] = line[1:]
    names, n = head["FIELDS"], int(head["POINTS"][0])
    if head["DATA"][0] == "ascii":
        table = np.array(content[at:].split(), float).reshape(-1, len(names))[:n]
        return {c: table[:, k] for k, c in enumerate(names)}
    layout = np.dtype([(c, _TYPES[t, int(s)]) for c, t, s in zip(names, head["TYPE"], head["SIZE"])])
    table = np.frombuffer(content, layout, n, at)
    return {c: table[c].astype(float) for c in names}


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """(file, x, y, z, intensity) of point cloud files, ascii or binary; a field that a file lacks is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                cloud = _cloud(content.as_buffer().to_pybytes())
                n = len(cloud["x"])
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n), *(pa.array(cloud[c]) if c in cloud else pa.nulls(n, pa.float64()) for c in ("x", "y", "z", "intensity"))], names=["file", "x", "y", "z", "intensity"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, x double, y double, z double, intensity double")


def write_pcd(points: DataFrame, folder: str, order: str | None = None) -> None:
    """K2: one ascii cloud file for each frame_id, written by Spark under folder/frame_id=...; a frame is one file and so one group.

    Points stand in the order of the column given, or else in that of the rows. Spark has no writer of binary files, so there is no binary form.
    """
    line = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("double").cast("string"), F.lit("nan")) for c in ("x", "y", "z", "intensity")))
    place = F.col(order) if order else F.monotonically_increasing_id()
    lines = points.select("frame_id", place.alias("place"), line.alias("line")).groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("p"))
    body = lines.select("frame_id", F.size("p").alias("n"), F.array_join(F.col("p.line"), "\n").alias("body"))
    n = F.col("n").cast("string")
    head = F.concat(F.lit("# .PCD v0.7\nVERSION 0.7\nFIELDS x y z intensity\nSIZE 8 8 8 8\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH "), n, F.lit("\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS "), n, F.lit("\nDATA ascii\n"))
    body.select("frame_id", F.concat(head, "body").alias("value")).write.partitionBy("frame_id").option("maxRecordsPerFile", 1).text(folder)


def append_records(records: DataFrame, folder: str) -> None:
    """K1, K7: output records or results appended as rows; what sends them on reads the table."""
    records.write.mode("append").parquet(folder)


def curb_messages(curbs: DataFrame, first: int = 0) -> DataFrame:
    """K5: (stream_id, counter, ts, lanes): a message for each time of curb lines (stream_id, side, ts, x0, y0, x1, y1), lanes being the sides' two points and counter a running number of the stream."""
    lane = F.struct("side", F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))).alias("points"))
    rows = curbs.groupBy("stream_id", "ts").agg(F.array_sort(F.collect_list(lane)).alias("lanes"))
    return rows.select("stream_id", (F.row_number().over(Window.partitionBy("stream_id").orderBy("ts")) - 1 + first).cast("long").alias("counter"), "ts", "lanes")


def append_curbs(curbs: DataFrame, folder: str) -> None:
    """K4: ts, x0, y0, x1, y1 rows appended as CSV, a folder for each side."""
    curbs.select("side", "ts", "x0", "y0", "x1", "y1").write.mode("append").partitionBy("side").csv(folder)


def read_angles(spark: SparkSession, path: str) -> DataFrame:
    """(channel, vert, horiz) in hundredths of a degree from CSV lines of degrees; a missing second value is 0."""
    rows = spark.read.schema("vert_deg double, horiz_deg double").csv(path).withColumn("order", F.monotonically_increasing_id())
    files = rows.withColumn("file", F.input_file_name())
    channel = F.expr("row_number() OVER (PARTITION BY file ORDER BY order) - 1")
    cents = lambda c: F.round(F.coalesce(c, F.lit(0.0)) * 100).cast("int")
    return files.withColumn("channel", channel).select("file", "channel", cents(F.col("vert_deg")).alias("vert"), cents(F.col("horiz_deg")).alias("horiz"))


def packet_rows(payloads: DataFrame, payload: Column) -> DataFrame:
    """Rows whose payload is given by a column, in the packets' schema."""
    return payloads.select(F.col("stream_id"), F.col("seq"), payload.cast("binary").alias("payload"))
