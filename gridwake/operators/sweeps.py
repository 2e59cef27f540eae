"""Decoders of scanners with mirrors and of spinning ones with little-endian blocks (D26 to D29): fixed records, explode and column maths."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwake.operators import framing, ranges
from gridwake.operators.decode import signed, unsigned

#: First bytes of a record that closes a frame, and of a block; fixed values of the wire formats.
MARKER = "FFAABBCCDD"
BLOCK = "FFEE"


def records(packets: DataFrame, size: int, count: int) -> DataFrame:
    """packets (stream_id, seq, payload) as (stream_id, seq, record, marker, body): `count` records of `size` bytes each from the payload's start."""
    each = packets.select("stream_id", "seq", "payload", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("record"))
    each = each.select("stream_id", "seq", "record", F.substr("payload", F.col("record") * size + 1, F.lit(size)).alias("body"))
    return each.select("stream_id", "seq", "record", (F.hex(F.substr("body", F.lit(1), F.lit(5))) == MARKER).alias("marker"), "body")


def marked_frames(rows: DataFrame) -> DataFrame:
    """Records with frame, by F6: a marker closes a frame, in the order of seq and record; markers are left out."""
    placed = rows.withColumn("place", F.col("seq") * 1024 + F.col("record"))
    return framing.by_marker(placed, "marker", "place").drop("place", "marker")


def reflected(tilt_in: Column, turn_in: Column, tilt: Column, turn: Column) -> tuple[Column, Column, Column]:
    """Unit direction of a beam, seen from the sensor, after a mirror: 2 (i n) n - i with its height turned up again.

    The beam comes from the elevation tilt_in at the azimuth turn_in, the mirror's normal has the elevation -tilt at the azimuth turn; all in radians.
    """
    i = (F.cos(tilt_in) * F.cos(turn_in), F.cos(tilt_in) * F.sin(turn_in), F.sin(tilt_in))
    n = (F.cos(tilt) * F.cos(turn), F.cos(tilt) * F.sin(turn), -F.sin(tilt))
    dot = i[0] * n[0] + i[1] * n[1] + i[2] * n[2]
    return 2 * dot * n[0] - i[0], 2 * dot * n[1] - i[1], i[2] - 2 * dot * n[2]


@dataclass(frozen=True)
class PrismSpec:
    """A scanner with a turning prism. Polynomials (lowest power first) correct the azimuth in degrees on either side; fixed values of a device."""

    unit: float = 100.0  # 256 steps of distance make one unit, of which so many make a metre
    right: tuple[float, ...] = (0.5894, 0.9885, 5.2766e-05, -3.6636e-07)
    left: tuple[float, ...] = (1.9003, 0.9719, 1.4507e-04, -3.6636e-07)
    shift: float = 0.017  # of the optical centre to the right and to the left
    start_deg: float = 22.5
    section: tuple[int, int] = (0, 18_000)  # hundredths of a degree kept with one return


def prism_points(packets: DataFrame, tilts: DataFrame, spec: PrismSpec = PrismSpec(), echoes: int = 1) -> DataFrame:
    """(stream_id, frame, seq, record, echo, channel, x, y, z, intensity) of 171 records of 7 bytes, or with two returns of 109 of 11.

    tilts has (channel, tilt_in_deg, tilt_deg) for the channels of the model, a row for each; channels in groups of four look to the
    right and to the left in turn. Records of channel 128 and above are none. With one return azimuths outside the section are left out.
    """
    size, count = (7, 171) if echoes == 1 else (11, 109)
    rows = marked_frames(records(packets, size, count))
    b = F.col("body")
    rows = rows.withColumn("channel", unsigned(b, 0, 1).cast("int")).withColumn("azimuth", unsigned(b, 1, 2)).where("channel < 128")
    returns = [(3, 6)] + ([(7, 10)] if echoes == 2 else [])
    each = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("echo"), (unsigned(b, d, 3) / 256.0 / spec.unit).alias("d"), unsigned(b, i, 1).cast("smallint").alias("intensity")) for k, (d, i) in enumerate(returns)))).alias("e")
    rows = rows.select("stream_id", "frame", "seq", "record", "channel", "azimuth", each).select("stream_id", "frame", "seq", "record", "channel", "azimuth", "e.*")
    if echoes == 1:
        rows = rows.where(F.col("azimuth").between(*spec.section))
    rows = rows.join(F.broadcast(tilts.where(F.col("channel") < 128)), "channel")  # 128 channels at most
    right = F.floor(F.col("channel") / 4) % 2 == 0
    half = F.col("azimuth") / 200.0
    turn = F.radians(F.when(right, half + spec.start_deg).otherwise(spec.start_deg + 90 - half))
    x, y, z = reflected(F.radians("tilt_in_deg"), F.lit(0.0), F.radians("tilt_deg"), turn)
    rows = rows.withColumns({"ux": x, "uy": y, "uz": z, "right": right})
    flat = F.sqrt(1 - F.col("uz") * F.col("uz"))
    # The sensor's axes are turned by 45 degrees against the prism's, the left side's x also mirrored.
    ahead = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.col("ux") + F.col("uy")) / flat * math.sqrt(0.5) * F.when(F.col("right"), 1.0).otherwise(-1.0)))
    azimuth = F.degrees(F.acos(ahead))
    poly = lambda c: sum((v * F.pow(azimuth, F.lit(k)) for k, v in enumerate(c[1:], 1)), F.lit(c[0]))
    fixed = F.radians(F.when(F.col("right"), poly(spec.right)).otherwise(poly(spec.left)))
    shift = F.when(F.col("right"), spec.shift).otherwise(-spec.shift)
    d = F.col("d")
    return rows.select("stream_id", "frame", "seq", "record", "echo", "channel", (d * flat * F.cos(fixed) + shift).alias("x"), (d * flat * F.sin(fixed)).alias("y"), (d * F.col("uz")).alias("z"), "intensity")


@dataclass(frozen=True)
class TurnSpec:
    """A spinning scanner whose packets have 12 blocks of 32 returns, little-endian."""

    lasers: int = 16
    step: float = 0.0025
    radius: float = 0.0
    lag_deg: float = 0.0
    near_deg: float = 10.0
    least_blocks: int = 100


def turn_points(packets: DataFrame, tilts: DataFrame, spec: TurnSpec = TurnSpec()) -> DataFrame:
    """(stream_id, frame, seq, blk, channel, azimuth_deg, x, y, z, intensity) of packets that begin with a block; others are left out.

    Azimuths run on a line from block to block, the last block on the line before; tilts has (channel, vert_deg), a row for
    each laser. A frame closes with the packet in which, more than least_blocks blocks after the last closing, a return lies up to near_deg
    beyond the stream's first azimuth; those returns open the next frame. A packet's blocks are taken in order by
    one task for each stream, which holds a few numbers.
    """
    own = packets.where(F.hex(F.substr("payload", F.lit(1), F.lit(2))) == BLOCK).select("stream_id", "seq", "payload")
    angle = lambda k: F.pmod(unsigned(F.col("payload"), k * 100 + 2, 2, True), F.lit(36000)).cast("int")
    heads = own.select("stream_id", "seq", F.array(*(angle(k) for k in range(12))).alias("azimuths"))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, first, frame, blocks = object(), 0.0, 0, 0
        for batch in batches:
            out = []
            for s, seq, az in batch.itertuples(index=False):
                if s != stream:
                    stream, first, frame, blocks = s, az[0] / 100.0, 0, 0
                closes = False
                for k in range(12):
                    if blocks + min(k + 2, 12) > spec.least_blocks:
                        j = min(k, 10)
                        step = (az[j + 1] - az[j]) % 36000 / 3200.0
                        closes = closes or any(0 < (az[k] / 100.0 + step * c) % 360 - first < spec.near_deg for c in range(32))
                out.append((s, seq, frame, blocks, first, closes))
                frame, blocks = (frame + 1, 0) if closes else (frame, blocks + 12)
            yield pd.DataFrame(out, columns=["stream_id", "seq", "frame", "blocks", "first", "closes"])

    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    frames = heads.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInPandas(close, f"stream_id {kinds['stream_id']}, seq {kinds['seq']}, frame bigint, blocks bigint, first double, closes boolean")
    blk = own.join(frames, ["stream_id", "seq"]).select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("blk"))
    start = lambda k: F.pmod(unsigned(F.col("payload"), k * 100 + 2, 2, True), F.lit(36000))
    j = F.least(F.col("blk"), F.lit(10))
    blk = blk.withColumn("az", start(F.col("blk"))).withColumn("step", F.pmod(start(j + 1) - start(j), F.lit(36000)))
    each = blk.select("stream_id", "seq", "frame", "blocks", "first", "closes", "blk", "az", "step", F.substr("payload", F.col("blk") * 100 + 5, F.lit(96)).alias("body"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("r"))
    azimuth = F.pmod(F.col("az") / 100.0 + F.col("step") / 3200.0 * F.col("r"), F.lit(360.0))
    each = each.withColumns({"azimuth_deg": azimuth, "channel": F.col("r") % spec.lasers, "d": unsigned(F.col("body"), F.col("r") * 3, 2, True) * spec.step, "intensity": unsigned(F.col("body"), F.col("r") * 3 + 2, 1).cast("smallint")})
    beyond = F.col("azimuth_deg") - F.col("first")
    opens = F.col("closes") & (beyond > 0) & (beyond < spec.near_deg) & (F.col("blocks") + F.least(F.col("blk") + 2, F.lit(12)) > spec.least_blocks)
    each = each.withColumn("frame", F.col("frame") + opens.cast("int")).join(F.broadcast(tilts.where(F.col("channel") < spec.lasers)), "channel")  # a row for each laser
    a, v, late = F.radians("azimuth_deg"), F.radians("vert_deg"), F.radians(F.col("azimuth_deg") - spec.lag_deg)
    flat = F.col("d") * F.cos(v)
    return each.select("stream_id", "frame", "seq", "blk", F.col("r").alias("channel"), "azimuth_deg", (flat * F.sin(a) + spec.radius * F.sin(late)).alias("x"), (flat * F.cos(a) + spec.radius * F.cos(late)).alias("y"), (F.col("d") * F.sin(v)).alias("z"), "intensity")


@dataclass(frozen=True)
class GalvoSpec:
    """A scanner with a galvanometer mirror and four beams; angles in degrees, lengths in metres. Fixed values of a device, but for ranges and the region."""

    beams: tuple[float, ...] = (0.0, -2.0, -1.0, -3.0)
    offset: float = 7.26
    turn_in: float = 60.0
    turn: float = 30.0
    step: float = 0.004
    angle_step: float = 0.0025
    min_range: float = 0.0
    max_range: float = 500.0
    disabled: tuple[float, float] = (0.0, 0.0)  # azimuths strictly inside are left out
    ahead: float = 1.8
    side: float = 60.0
    top: float = 2.5


def galvo_points(packets: DataFrame, spec: GalvoSpec = GalvoSpec(), echoes: int = 1) -> DataFrame:
    """(stream_id, frame, seq, record, echo, channel, x, y, z, intensity) of 149 records of 8 bytes, or with two returns of 99 of 12.

    A record has an azimuth, two bits of channel, a signed 14-bit elevation, distance and intensity. Angles of the tables are cut to hundredths
    of a degree. Points outside the range, in the disabled azimuths, nearer than `ahead`, or beyond `side` or `top` are left out.
    """
    size, count = (8, 149) if echoes == 1 else (12, 99)
    rows = marked_frames(records(packets, size, count))
    b = F.col("body")
    low = unsigned(b, 2, 2)
    tilt = F.when(low.bitwiseAND(0x2000) != 0, low.bitwiseOR(0xC000) - 65536).otherwise(low.bitwiseAND(0x3FFF))
    returns = [(4, 7)] + ([(8, 11)] if echoes == 2 else [])
    each = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("echo"), (unsigned(b, d, 3) * spec.step).alias("d"), unsigned(b, i, 1).cast("smallint").alias("intensity")) for k, (d, i) in enumerate(returns)))).alias("e")
    names = ["stream_id", "frame", "seq", "record", "azimuth", "tilt", "channel"]
    rows = rows.withColumns({"azimuth": signed(b, 0, 2) / 100.0, "tilt": tilt * spec.angle_step, "channel": F.shiftright(low.cast("int"), 14)}).select(*names, each).select(*names, "e.*")
    rows = rows.where(F.col("d").between(spec.min_range, spec.max_range) & ~((F.col("azimuth") > spec.disabled[0]) & (F.col("azimuth") < spec.disabled[1])))
    # Fractions beyond a hundredth are cut; the small term keeps whole hundredths from falling below themselves.
    cut = lambda a: F.radians(F.pmod(F.floor(F.pmod(a, F.lit(360.0)) * 100 + 1e-6), F.lit(36000)) / 100.0)
    beam = F.radians(F.element_at(F.array(*(F.lit(v) for v in spec.beams)), F.col("channel") % len(spec.beams) + 1))
    _, y, z = reflected(beam, F.lit(math.radians(spec.turn_in)), cut(F.col("tilt") + spec.offset), F.lit(math.radians(spec.turn)))
    rows = rows.withColumns({"uy": y, "uz": z})
    flat = F.sqrt(1 - F.col("uz") * F.col("uz"))
    turned = cut(F.col("azimuth")) + F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("uy") / flat)))
    d = F.col("d")
    out = rows.select("stream_id", "frame", "seq", "record", "echo", "channel", (d * flat * F.sin(turned)).alias("x"), (d * flat * F.cos(turned)).alias("y"), (d * F.col("uz")).alias("z"), "intensity")
    return out.where((F.col("y") >= spec.ahead) & (F.abs("x") <= spec.side) & (F.abs("y") <= spec.side) & (F.col("z") <= spec.top))


def flat_scan(packets: DataFrame, header: int = 6, points: int = 42, spread_deg: float = 15.0) -> DataFrame:
    """(stream_id, frame, seq, point, azimuth_deg, x, y, intensity) of a flat scanner: a start azimuth in the two bytes before the points, points of two bytes of distance in mm and one of intensity, over a spread; 0xFFFF is no return.

    A frame begins where the azimuth falls by more than the spread from one packet to the next.
    """
    p = F.col("payload")
    rows = packets.withColumn("start", unsigned(p, header - 2, 2) / 100.0)
    rows = ranges.scan(rows, "stream_id", "seq", F.coalesce("start", F.lit(0.0)), "frame", lambda now, before, first: ~first & (before - now > spread_deg))
    rows = rows.select("stream_id", "frame", "seq", "start", "payload")
    size = 3 * points
    kinds = [*(f for f in rows.schema.fields if f.name in ("stream_id", "frame", "seq")), T.StructField("point", T.IntegerType()), T.StructField("azimuth_deg", T.DoubleType())]
    kinds += [T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("intensity", T.ShortType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2000):
                batch = whole.slice(first, 2000)
                n = batch.num_rows
                # Points that a packet has no bytes for are null, and the last one's intensity if only its distance is there.
                bodies = [(v or b"")[header : header + size] for v in batch["payload"].to_pylist()]
                length = np.array([len(v) for v in bodies])[:, None]
                byte = np.frombuffer(b"".join(v.ljust(size, b"\0") for v in bodies), np.uint8).reshape(n, points, 3).astype(np.int64)
                at = 3 * np.arange(points)
                raw = np.where(length >= at + 2, byte[:, :, 0] * 256 + byte[:, :, 1], byte[:, :, 0])
                start = batch["start"].to_numpy(zero_copy_only=False).astype(float)
                azimuth = np.mod(start[:, None] + np.arange(points) * spread_deg / points, 360.0)
                gone, none = np.isnan(azimuth), length <= at
                d = raw / 1000.0
                lost = (gone | none | (raw == 0xFFFF)).ravel()
                turn = np.radians(azimuth)
                back = pa.array(np.repeat(np.arange(n), points))
                columns = [batch[c].take(back) for c in ("stream_id", "frame", "seq")]
                columns += [pa.array(np.tile(np.arange(points, dtype=np.int32), n)), pa.array(azimuth.ravel(), mask=gone.ravel())]
                columns += [pa.array((d * f(turn)).ravel(), mask=lost) for f in (np.sin, np.cos)]
                columns.append(pa.array(byte[:, :, 2].ravel().astype(np.int16), mask=(length <= at + 2).ravel()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kinds])

    return rows.mapInArrow(run, T.StructType(kinds))
