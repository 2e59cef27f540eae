"""Packets to points: one data-driven decoder for many sensor models.

A payload is a BINARY column. Fields are read by position with built-in functions, blocks and channels are exploded, and
the geometry is column arithmetic; nothing leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwake.plans.materialize import join_checked

# --- field readers ----------------------------------------------------------------------------------------------


def unsigned(payload: Column, at, size: int, little: bool = False) -> Column:
    """An unsigned integer of 1 to 7 bytes at an offset from 0."""
    at = at if isinstance(at, Column) else F.lit(at)
    raw = F.substr(payload, (at + 1).cast("int"), F.lit(size))
    digits = F.hex(F.reverse(raw)) if little and size == 1 else F.hex(raw)
    if little and size > 1:
        digits = F.concat(*(F.hex(F.substr(payload, (at + 1 + k).cast("int"), F.lit(1))) for k in range(size - 1, -1, -1)))
    return F.conv(digits, 16, 10).cast("long")


def signed(payload: Column, at, size: int, little: bool = False) -> Column:
    u = unsigned(payload, at, size, little)
    return F.when(u >= 1 << (8 * size - 1), u - (1 << 8 * size)).otherwise(u)


def utc_seconds(payload: Column, at, per_second: int = 1_000_000) -> Column:
    """6 bytes of seconds and 4 of a fraction, as a double."""
    at = at if isinstance(at, Column) else F.lit(at)
    return unsigned(payload, at, 6).cast("double") + unsigned(payload, at + 6, 4).cast("double") / per_second


def calendar_seconds(payload: Column, at) -> Column:
    """Year from 2000, month, day, hour, minute, second and 2 + 2 bytes of ms and us, in UTC."""
    at = at if isinstance(at, Column) else F.lit(at)
    part = [unsigned(payload, at + k, 1) for k in range(6)]
    moment = F.try_make_timestamp(part[0].cast("int") + 2000, *(p.cast("int") for p in part[1:5]), part[5].cast("decimal(8,6)"))
    return F.unix_micros(moment) / 1_000_000.0 + unsigned(payload, at + 6, 2) / 1000.0 + unsigned(payload, at + 8, 2) / 1_000_000.0


def temperature(low: Column, high: Column) -> Column:
    """Sign and magnitude in 12 bits, a step is 1/16 degree: the sign is the top bit of `high`, its 7 others lead 5 of `low`."""
    size = F.shiftleft(high.bitwiseAND(0x7F).cast("int"), 5).bitwiseOR(F.shiftright(low.cast("int"), 3))
    return F.when(high.bitwiseAND(0x80) != 0, -size).otherwise(size) * 0.0625


def crc32_holds(payload: Column, trailer: int = 6) -> Column:
    """CRC-32 of all but the trailer, continued over the last two bytes, against the four before them (big-endian)."""
    n = F.length(payload)
    body = F.concat(F.substr(payload, F.lit(1), n - trailer), F.substr(payload, n - 1, F.lit(2)))
    return F.crc32(body) == unsigned(payload, n - trailer, 4)


def calibration_angle(sign: Column, value: Column) -> Column:
    """Hundredths of a degree, null if not ready (sign 0xFF) or outside [-9000, 18000)."""
    a = F.when(sign == 0, value).otherwise(-value)
    return F.when((sign != 255) & (a >= -9000) & (a < 18000), a)


def split_feature(raw: Column) -> tuple[Column, Column]:
    """14 bits of distance and 2 of a feature."""
    return raw.bitwiseAND(16383), F.shiftright(raw.cast("int"), 14)


# --- routing and gates ------------------------------------------------------------------------------------------

#: First bytes of the packet kinds; fixed values of the wire format.
KINDS = {"55AA": "msop", "A5FF": "difop", "AA55": "imu"}
#: Reject reasons of packets; the first that applies is given.
REASONS = ("no_calibration", "wrong_length", "wrong_id", "wrong_crc")


def route(packets: DataFrame) -> DataFrame:
    """Packets with their kind, null for others."""
    head = F.hex(F.substr("payload", F.lit(1), F.lit(2)))
    kind = F.lit(None).cast("string")
    for code, name in KINDS.items():
        kind = F.when(head == code, name).otherwise(kind)
    return packets.withColumn("kind", kind)


def gate(packets: DataFrame, length: int, ident: str, check_crc: bool = False, wait_for_difop: bool = False) -> DataFrame:
    """Packets with reject_reason, null for those that pass. Waiting is per stream, in the order of seq."""
    reason = F.when(F.length("payload") != length, "wrong_length").when(F.hex(F.substr("payload", F.lit(1), F.lit(len(ident) // 2))) != ident, "wrong_id")
    if check_crc:
        reason = reason.when(~crc32_holds(F.col("payload")), "wrong_crc")
    if wait_for_difop:
        packets = route(packets)
        first = packets.where("kind = 'difop'").groupBy(F.col("stream_id").alias("_stream")).agg(F.min("seq").alias("_first"))
        packets = join_checked(packets, first, F.col("stream_id").eqNullSafe(F.col("_stream"))).drop("_stream")
        reason = F.when((F.col("kind") == "msop") & ~F.coalesce(F.col("seq") >= F.col("_first"), F.lit(False)), "no_calibration").otherwise(reason)
        return packets.withColumn("reject_reason", reason).drop("_first")
    return packets.withColumn("reject_reason", reason)


#: What can go wrong, by code: below 64 information, below 128 warnings, above errors. Fixed values.
CODES = {
    "success": 0x00, "file_repeats": 0x01, "file_ends": 0x02, "no_packets": 0x40, "no_calibration": 0x41, "wrong_msop_length": 0x42, "wrong_msop_id": 0x43, "wrong_block_id": 0x44,
    "wrong_difop_length": 0x45, "wrong_difop_id": 0x46, "no_points": 0x47, "packet_overflow": 0x48, "cloud_overflow": 0x49, "wrong_crc": 0x4A, "wrong_imu_length": 0x4B, "wrong_imu_id": 0x4C,
    "msop_not_parsed": 0x4D, "difop_not_parsed": 0x4E, "imu_not_parsed": 0x4F, "started_early": 0x80, "no_file": 0x81, "no_cloud": 0x82, "no_imu": 0x83,
}


def level(code: Column) -> Column:
    """D24: 'info', 'warning' or 'error'."""
    return F.when(code < 0x40, "info").when(code < 0x80, "warning").otherwise("error")


def faults(packets: DataFrame, lengths: dict[str, int], idents: dict[str, str], block: tuple[int, str] | None = None, check_crc: bool = False) -> DataFrame:
    """Packets with kind, fault (a name of CODES, null for those that pass) and code, by the length and id of each kind; block is the offset and id of a point packet's first block. Packets of no kind pass no gate and are left out."""
    p, fault = F.col("payload"), F.lit(None).cast("string")
    for kind in lengths:
        own = F.col("kind") == kind
        here = F.when(F.length(p) != lengths[kind], f"wrong_{kind}_length").when(F.hex(F.substr(p, F.lit(1), F.lit(len(idents[kind]) // 2))) != idents[kind], f"wrong_{kind}_id")
        if kind == "msop" and block:
            here = here.when(F.hex(F.substr(p, F.lit(block[0] + 1), F.lit(len(block[1]) // 2))) != block[1], "wrong_block_id")
        if kind == "msop" and check_crc:
            here = here.when(~crc32_holds(p), "wrong_crc")
        fault = F.when(own, here).otherwise(fault)
    out = route(packets).where(F.col("kind").isin(list(lengths))).withColumn("fault", fault)
    return out.withColumn("code", F.coalesce(F.create_map(*(F.lit(v) for pair in CODES.items() for v in pair))[F.col("fault")], F.lit(0)))


# --- sections and angles ----------------------------------------------------------------------------------------


def trig(angle: Column, f=F.sin) -> Column:
    """F of hundredths of a degree in [-9000, 45000); any other angle counts as 0."""
    return f(F.radians(F.when((angle >= -9000) & (angle < 45000), angle).otherwise(F.lit(0)) / 100.0))


def in_range(distance: Column, low: float, high: float, user_low: float = 0, user_high: float = 0) -> Column:
    """Closed; the user's pair goes before the sensor's if either is not 0."""
    low, high = (user_low, user_high) if user_low or user_high else (low, high)
    return distance.between(low, high)


def in_section(azimuth: Column, start: int, end: int) -> Column:
    """Half-open in hundredths of a degree, across 0 if start is behind end; equal bounds are the full round."""
    start, end = start % 36000, end % 36000
    if start == end:
        return F.lit(True)
    inside = (azimuth >= start) & (azimuth < end)
    return inside if start < end else (azimuth >= start) | (azimuth < end)


def channel_rank(angles: DataFrame) -> DataFrame:
    """(channel, vert, user_channel): how many channels lie lower."""
    return angles.withColumn("user_channel", F.rank().over(Window.partitionBy("sensor_id").orderBy("vert")) - 1)


#: Block iterators: how many blocks make a firing group.
GROUPS = {"single": 1, "dual": 2, "two_in_one": 2, "four_in_one": 4, "two_firings": 1, "two_firings_dual": 1}


def block_steps(blocks: DataFrame, mode: str = "single", nominal: int = 20, duration: float = 55.5, blind: float = 0.0, max_step: int = 100) -> DataFrame:
    """Blocks (packet, blk, azimuth) with az_step, the azimuth to the next group, and offset, the time since the packet's first block.

    Steps wrap at 36000; a step over max_step is a blind zone, which counts as the nominal step and takes the blind time;
    a packet's last group has the nominal step. ab_dual groups by two or three as its first two blocks tell; a block of
    two_firings has two of them, so nominal step and duration count twice.
    """
    if mode == "two_firings":
        nominal, duration = 2 * nominal, 2 * duration
    packet = Window.partitionBy("stream_id", "seq")
    if mode == "ab_dual":
        first = lambda k: F.max(F.when(F.col("blk") == k, F.col("azimuth"))).over(packet)
        # A pair that shares an azimuth is followed by a single block, or the other way round.
        group = F.when(first(0) == first(1), F.floor(F.col("blk") / 3) * 2 + (F.col("blk") % 3 == 2).cast("int")).otherwise(F.floor(F.col("blk") / 3) * 2 + (F.col("blk") % 3 >= 1).cast("int"))
    else:
        group = F.floor(F.col("blk") / GROUPS[mode])
    blocks = blocks.withColumn("grp", group.cast("int"))
    heads = blocks.groupBy("stream_id", "seq", "grp").agg(F.min_by("azimuth", "blk").alias("a"))
    along = packet.orderBy("grp")
    raw = F.lead("a").over(along) - F.col("a")
    raw = F.when(raw < 0, raw + 36000).otherwise(raw)
    steps = heads.withColumn("raw", raw).withColumn("gap", F.col("raw") > max_step)
    steps = steps.withColumn("az_step", F.when(F.col("raw").isNull() | F.col("gap"), F.lit(nominal)).otherwise(F.col("raw")))
    took = F.when(F.col("gap"), F.lit(float(blind))).otherwise(F.lit(float(duration)))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("offset", F.coalesce(F.sum(took).over(before), F.lit(0.0)))
    return blocks.join(steps.select("stream_id", "seq", "grp", "az_step", "offset"), ["stream_id", "seq", "grp"]).drop("grp")


def _groups(mode: str, blocks: int, doubled_first: bool = True) -> list[tuple[int, int, int]]:
    """Of each block: the first one of its firing group, the one whose azimuth ends the group's step, and its place in the group."""
    if mode == "ab_dual":
        heads = (0, 0, 2) if doubled_first else (0, 1, 1)
        nexts = (2, 2, 3) if doubled_first else (2, 3, 3)
        return [(k - k % 3 + heads[k % 3], k - k % 3 + nexts[k % 3], k % 3 - heads[k % 3]) for k in range(blocks)]
    size = GROUPS[mode]
    return [(k - k % size, k - k % size + size, k % size) for k in range(blocks)]


def block_plan(azimuths: Column, blocks: int, mode: str, nominal: Column, duration: float, blind: Column, max_step: int = 100) -> Column:
    """D10 inside a packet's row: an array with (azimuth, az_step, offset, place) of each block, from the array of azimuths; place counts the returns of a firing group.

    The rules are those of block_steps, but that a step may end at a block with another id, and that of ab_dual at the last of three blocks.
    """
    if mode == "two_firings":
        nominal, duration = nominal * 2, duration * 2

    def planned(groups: list[tuple[int, int, int]]) -> Column:
        ends = sorted({(head, after) for head, after, _ in groups})
        of = {head: k for k, (head, _) in enumerate(ends)}
        ints = lambda values: F.array(*(F.lit(v) for v in values))
        apart = F.zip_with(ints(h for h, _ in ends), ints(a for _, a in ends), lambda h, a: F.get(azimuths, a) - F.get(azimuths, h))
        raw = F.transform(apart, lambda d: F.when(d < 0, d + 36000).otherwise(d))
        steps = F.transform(raw, lambda r: F.when(r <= max_step, r).otherwise(nominal.cast("bigint")))
        took = F.transform(raw, lambda r: F.when(r > max_step, blind.cast("double")).otherwise(F.lit(float(duration))))
        offsets = F.transform(ints(range(len(ends))), lambda k: F.aggregate(F.slice(took, 1, k), F.lit(0.0), lambda x, y: x + y))
        rows = F.arrays_zip(azimuths.alias("azimuth"), ints(of[head] for head, _, _ in groups).alias("group"), ints(place for *_, place in groups).alias("place"))
        return F.transform(rows, lambda x: F.struct(x["azimuth"].alias("azimuth"), F.get(steps, x["group"]).alias("az_step"), F.get(offsets, x["group"]).alias("offset"), x["place"].alias("place")))

    if mode == "ab_dual":
        return F.when(azimuths[0] == azimuths[1], planned(_groups(mode, blocks))).otherwise(planned(_groups(mode, blocks, False)))
    return planned(_groups(mode, blocks))


# --- sensor models ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class PacketSpec:
    """Layout of a model's point packet, in bytes from 0.

    Behind the header lie blocks, each with a header of its own and channels. A channel begins with a distance of two bytes in
    steps of `step` metres; what else it has, it has at the offsets given. Polar blocks have an azimuth, and begin with
    block_id: a packet's blocks end at the first one that doesn't. A column is one block of pixels for each channel,
    under the yaw and surface in the packet's header.
    """

    name: str
    length: int
    lasers: int
    blocks: int
    channels: int
    min_range: float
    max_range: float
    step: float = 0.005
    geometry: str = "polar"  # polar, yaw_pitch, vector or column
    ident: str = "55AA"
    header: int = 42
    block_header: int = 4
    block_id: str = ""
    azimuth_at: int | None = 2
    channel_size: int = 3
    intensity_at: int = 2
    second_at: tuple[int, int] | None = None  # distance and intensity of a second return in the same channel
    angles_at: tuple[int, int] | None = None  # pitch and yaw, from 32768 in hundredths of a degree
    vector_at: int | None = None  # three signed numbers of length 32768
    seq_at: int = 4
    yaw_at: int = 24
    surface_at: int = 27
    yaw_scale: float = 1.0
    radius: float = 0.0  # of the optical centre around the axis, with its height
    lift: float = 0.0
    has_imu: bool = False
    halves: bool = False  # odd blocks have the second half of the lasers
    feature: bool = False  # a distance of 14 bits below two of a feature

    @property
    def block_size(self) -> int:
        return self.block_header + self.channels * self.channel_size


def _turning(name: str, lasers: int, blocks: int, channels: int, low: float, high: float, length: int = 1248, **more) -> PacketSpec:
    return PacketSpec(name, length, lasers, blocks, channels, low, high, **({"block_id": "FFEE"} | more))


def _fixed(name: str, length: int, lasers: int, blocks: int, channels: int, low: float, high: float, **more) -> PacketSpec:
    return PacketSpec(name, length, lasers, blocks, channels, low, high, header=32, azimuth_at=None, **more)


_FINE = {"header": 80, "block_id": "FE"}
_ANGLES = {"geometry": "yaw_pitch", "block_header": 2, "channel_size": 9, "intensity_at": 6, "angles_at": (2, 4)}
_VECTOR = {"geometry": "vector", "block_header": 2, "channel_size": 10, "intensity_at": 8, "vector_at": 2}
_COLUMN = {"geometry": "column", "block_header": 0, "channel_size": 4}
#: Layouts by their physical form. Fixed values of the wire formats: lasers, blocks, channels, range in metres, packet bytes and offsets.
MODELS = {
    s.name: s
    for s in (
        # Spinning, header of 42 bytes.
        _turning("spin16", 16, 12, 32, 0.4, 230, radius=0.03825), _turning("spin32", 32, 12, 32, 0.4, 230, radius=0.03997), _turning("spin32_hemisphere", 32, 12, 32, 0.1, 150, radius=0.01473, lift=0.09427),
        _turning("spin32_fine", 32, 12, 32, 0.1, 180, step=0.0025, radius=0.03498), _turning("spin16_fine", 16, 12, 32, 0.1, 180, step=0.0025, radius=0.03498),
        _turning("dome96", 96, 8, 48, 0.1, 60, has_imu=True, halves=True, feature=True), _turning("dome48", 48, 8, 48, 0.1, 150, radius=0.01952, lift=0.045, has_imu=True),
        # Spinning, header of 80 bytes.
        _turning("spin48", 48, 8, 48, 0.4, 250, 1268, **_FINE), _turning("spin80", 80, 4, 80, 0.4, 250, radius=0.03615, **_FINE), _turning("spin128", 128, 3, 128, 0.4, 250, radius=0.03615, **_FINE),
        _turning("spin48_plus", 48, 8, 48, 0.4, 250, 1268, **_FINE), _turning("spin80_plus", 80, 4, 80, 0.4, 250, radius=0.02892, **_FINE), _turning("spin128_plus", 128, 3, 128, 0.4, 250, radius=0.02892, **_FINE),
        # Without a spinning head, header of 32 bytes.
        _fixed("mirror5_angles", 1210, 5, 25, 5, 0.2, 200, **_ANGLES), _fixed("mirror5_angles_jumbo", 62152, 5, 25, 5, 0.2, 200, **_ANGLES),
        _fixed("mirror5_vectors", 1342, 5, 25, 5, 0.2, 250, **_VECTOR), _fixed("mirror28_vectors", 1448, 28, 5, 28, 0.1, 300, **_VECTOR), _fixed("flash1_vectors", 1200, 1, 96, 1, 0, 200, **_VECTOR),
        _fixed("mirror2_vectors", 1404, 2, 50, 2, 0.2, 200, geometry="vector", block_header=1, channel_size=13, intensity_at=10, second_at=(2, 11), vector_at=4),
        _fixed("column260", 1084, 260, 1, 260, 0.5, 350, **_COLUMN), _fixed("column192", 812, 192, 1, 192, 0.2, 300, yaw_scale=1 / 5.12, **_COLUMN),
    )
}


def azimuths(spec: PacketSpec) -> Column:
    """The azimuths of a payload's blocks."""
    return F.transform(F.sequence(F.lit(0), F.lit(spec.blocks - 1)), lambda k: unsigned(F.col("payload"), k * spec.block_size + (spec.header + spec.azimuth_at), 2))


def unpack(packets: DataFrame, spec: PacketSpec, plan: str | None = None) -> DataFrame:
    """(packets' columns without payload, blk, azimuth, channel, echo, raw, intensity and what the layout has): a row for each return of each channel. plan is a column of block_plan, whose fields the rows of its blocks get."""
    keep = [c for c in packets.columns if c not in ("payload", plan)]
    head, steps = [], F.sequence(F.lit(0), F.lit(spec.blocks - 1))
    if spec.geometry == "column":
        p = F.col("payload")
        head = [(unsigned(p, spec.seq_at, 2) - 1).alias("column_seq"), signed(p, spec.yaw_at, 2).alias("yaw_base"), unsigned(p, spec.surface_at, 1).cast("int").alias("surface")]
    size = len(spec.block_id) // 2
    if size:
        ident = lambda k: F.hex(F.substr("payload", F.lit(spec.header + 1) + k * spec.block_size, F.lit(size)))
        good = F.aggregate(steps, F.lit(0), lambda n, k: F.when((n == k) & (ident(k) == spec.block_id), n + 1).otherwise(n))
        steps = F.slice(steps, F.lit(1), good)
    planned = [plan] if plan else []
    blk = packets.select(*keep, *head, "payload", *planned, F.explode(steps).alias("blk"))
    names = [*keep, *(c for c in ("column_seq", "yaw_base", "surface") if head), "blk"]
    if plan:
        blk = blk.select(*names, "payload", F.col(plan)[F.col("blk")].alias(plan)).select(*names, "payload", *(f"{plan}.{c}" for c in ("az_step", "offset", "place")))
        names += ["az_step", "offset", "place"]
    at = F.lit(spec.header) + F.col("blk") * spec.block_size
    azimuth = F.lit(None).cast("bigint") if spec.azimuth_at is None else unsigned(F.col("payload"), at + spec.azimuth_at, 2)
    blk = blk.select(*names, azimuth.alias("azimuth"), F.substr("payload", at + spec.block_header + 1, F.lit(spec.channels * spec.channel_size)).alias("body"))
    each = blk.select(*names, "azimuth", "body", F.explode(F.sequence(F.lit(0), F.lit(spec.channels - 1))).alias("channel"))
    at, body = F.col("channel") * spec.channel_size, F.col("body")
    # `echo` is a struct until the returns of a channel have rows of their own.
    returns = [(0, spec.intensity_at)] + ([spec.second_at] if spec.second_at else [])
    echo = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("echo"), unsigned(body, at + d, 2).alias("raw"), unsigned(body, at + i, 1).alias("intensity")) for k, (d, i) in enumerate(returns)))).alias("e")
    fields = []
    if spec.angles_at:
        fields += [(unsigned(body, at + k, 2) - 32768).alias(n) for n, k in zip(("pitch", "yaw"), spec.angles_at)]
    if spec.vector_at is not None:
        fields += [signed(body, at + spec.vector_at + 2 * k, 2).alias(f"v{c}") for k, c in enumerate("xyz")]
    return each.select(*names, "azimuth", "channel", *fields, echo).select(*names, "azimuth", "channel", "e.*", *(c for c, has in (("pitch", spec.angles_at), ("yaw", spec.angles_at), ("vx", spec.vector_at), ("vy", spec.vector_at), ("vz", spec.vector_at)) if has is not None))


def column_pixel(channel: Column, seq: Column, pixels: int, parts: int = 1) -> Column:
    """The pixel of a column that is sent in parts, each packet (counted from 0) having the next part; a dual return sends two."""
    return channel + F.pmod(seq, F.lit(parts)) * pixels


def polar_xyz(d: Column, vert: Column, azimuth: Column, turned: Column, radius: float = 0.0, lift: float = 0.0) -> tuple[Column, Column, Column]:
    """x = d cos V cos H' + R cos H, y = -(d cos V sin H' + R sin H), z = d sin V + lift; angles in hundredths of a degree."""
    flat = d * trig(vert, F.cos)
    return flat * trig(turned, F.cos) + radius * trig(azimuth, F.cos), -(flat * trig(turned, F.sin) + radius * trig(azimuth, F.sin)), d * trig(vert, F.sin) + lift


def yaw_pitch_xyz(d: Column, yaw: Column, pitch: Column) -> tuple[Column, Column, Column]:
    """Solid-state angles in hundredths of a degree."""
    flat = d * trig(pitch, F.cos)
    return flat * trig(yaw, F.cos), flat * trig(yaw, F.sin), d * trig(pitch, F.sin)


def vector_xyz(d: Column, vx: Column, vy: Column, vz: Column, base: float = 32768.0) -> tuple[Column, Column, Column]:
    """A direction given by a vector of length base."""
    return vx * d / base, vy * d / base, vz * d / base


#: Rows of a static table of angles at most; it becomes part of the plan.
MOST_LASERS = 4096


def rings(verts: Column) -> Column:
    """Of each laser how many lie lower; null where the angle is."""
    return F.transform(verts, lambda v: F.when(v.isNotNull(), F.size(F.filter(verts, lambda w: w < v))))


def _angle_arrays(calibration: DataFrame) -> tuple[Column, Column, Column]:
    """Arrays of vertical and horizontal angles and of rings by laser, null for those without a row, of a table (channel, vert, horiz)."""
    rows = calibration.select("channel", "vert", "horiz").limit(MOST_LASERS + 1).collect()
    if len(rows) > MOST_LASERS:
        raise ValueError(f"a table of angles has more than {MOST_LASERS} rows")
    by = {r["channel"]: r for r in rows}
    size, known = max(by, default=-1) + 1, [r["vert"] for r in by.values() if r["vert"] is not None]
    of = {c: [by[k][c] if k in by else None for k in range(size)] for c in ("vert", "horiz")}
    of["ring"] = [None if v is None else sum(w < v for w in known) for v in of["vert"]]
    return tuple(F.array(*map(F.lit, of[c])).cast("array<int>") for c in ("vert", "horiz", "ring"))


def decode(packets: DataFrame, spec: PacketSpec, calibration: DataFrame | tuple[Column, Column, Column] | None = None, start_deg: float = 0, end_deg: float = 360, min_range: float = 0, max_range: float = 0, dense: bool = False, nominal: int | Column = 20, mode: str = "single", shares: tuple[float, ...] | None = None, surfaces: tuple[int, ...] = (0,), parts: int = 1, duration: float = 55.5, blind: float | Column = 0.0, dual: tuple[Column, str, tuple[float, ...] | None] | None = None) -> DataFrame:
    """(stream_id, seq, blk, channel, echo, x, y, z, intensity, ring, offset_us, feature, fault) of packets (stream_id, seq, payload) of one model, in metres.

    calibration is a table (channel, vert, horiz) in hundredths of a degree or three array columns of the packets (vert, horiz, ring), by laser: for polar models an
    angle for each laser, channels beyond the lasers beginning anew; for columns one for each pixel. A laser without angles has null points with
    the fault 'no_calibration', also where null points are left out. mode is that of block_steps, nominal, duration and blind are its parameters,
    the first and last also as columns of the packets; shares say which part of a block's step each channel has behind it, evenly if not given.
    dual (a condition, mode, shares) tells packets whose blocks hold two returns; those count as echoes 1 and 2.
    surfaces are the pitches that a column's mirror surfaces add. Returns outside the section or range are null points, or left out if dense. ring is the
    laser's place by vertical angle, offset_us the time since the packet's first block. Everything is computed inside a packet's row: no exchange.
    """
    polar = spec.geometry == "polar"
    arrays = (F.array().cast("array<int>"),) * 3 if calibration is None else calibration if isinstance(calibration, tuple) else _angle_arrays(calibration)
    plain = calibration is None
    own = ["stream_id", "seq", "payload", *(c.alias(n) for n, c in zip(("_verts", "_horizs", "_rings"), arrays)), (F.coalesce(dual[0], F.lit(False)) if dual else F.lit(False)).alias("_dual")]
    if polar:
        nominal, blind = (v if isinstance(v, Column) else F.lit(v) for v in (nominal, blind))
        packets = packets.select(*own, azimuths(spec).alias("_az"), nominal.alias("_nominal"), blind.alias("_blind"))
        plan = lambda m: block_plan(F.col("_az"), spec.blocks, m, F.col("_nominal"), duration, F.col("_blind"))
        packets = packets.withColumn("_plan", F.when(F.col("_dual"), plan(dual[1])).otherwise(plan(mode)) if dual else plan(mode)).drop("_az", "_nominal", "_blind")
    else:
        packets = packets.select(*own)
    rows = unpack(packets, spec, "_plan" if polar else None)
    raw = F.col("raw")
    distance, feature = split_feature(raw) if spec.feature else (raw, F.lit(None).cast("int"))
    d = distance * spec.step
    ok = in_range(d, spec.min_range, spec.max_range, min_range, max_range)
    vert = horiz = ring = fault = F.lit(None).cast("int")
    if spec.geometry in ("polar", "column"):
        laser = column_pixel(F.col("channel"), F.col("column_seq"), spec.channels, parts) if not polar else F.col("channel") + F.col("blk") % 2 * spec.channels if spec.halves else F.col("channel") % spec.lasers
        laser = laser.cast("int")
        vert, horiz = (F.lit(0), F.lit(0)) if plain else (F.get("_verts", laser), F.get("_horizs", laser))
        ring = F.get("_rings", laser)
        fault = F.when(vert.isNull() | horiz.isNull(), "no_calibration")
    offset = F.lit(None).cast("double")
    if polar:
        def share(own):
            return F.col("channel") / spec.channels if own is None else F.element_at(F.array(*(F.lit(float(np.float32(v))).cast("float") for v in own)), F.col("channel") + 1)

        turn = lambda own: F.floor((F.col("az_step") if own is None else F.col("az_step").cast("float")) * share(own))
        az = F.col("azimuth") + (F.when(F.col("_dual"), turn(dual[2])).otherwise(turn(shares)) if dual else turn(shares))
        turned = az + horiz
        fired = lambda own, times: share(own).cast("double") * duration * times
        twice = lambda m: 2 if m == "two_firings" else 1
        offset = F.col("offset") + (F.when(F.col("_dual"), fired(dual[2], twice(dual[1]))).otherwise(fired(shares, twice(mode))) if dual else fired(shares, twice(mode)))
        ok = ok & in_section(F.pmod(turned, F.lit(36000)), round(start_deg * 100), round(end_deg * 100))
        xyz = polar_xyz(d, vert, az, turned, spec.radius, spec.lift)
        rows = rows.withColumn("echo", F.when(F.col("_dual"), F.col("place") + 1).otherwise(F.col("echo")) if dual else F.col("echo"))
    elif spec.geometry == "column":
        turned = ((F.col("yaw_base") + horiz) * spec.yaw_scale).cast("int")
        surface = F.element_at(F.array(*(F.lit(v) for v in surfaces)), F.least(F.col("surface"), F.lit(len(surfaces) - 1)) + 1)
        xyz = yaw_pitch_xyz(d, turned, vert + surface)
    elif spec.geometry == "yaw_pitch":
        xyz = yaw_pitch_xyz(d, F.col("yaw"), F.col("pitch"))
    else:
        xyz = vector_xyz(d, *(F.col(f"v{c}") for c in "xyz"))
    ok = ok & fault.isNull()
    out = rows.select(
        "stream_id", "seq", "blk", "channel", "echo", *(F.when(ok, v).alias(c) for v, c in zip(xyz, "xyz")), F.when(ok, F.col("intensity")).otherwise(0).cast("smallint").alias("intensity"),
        ring.alias("ring"), offset.alias("offset_us"), feature.alias("feature"), fault.cast("string").alias("fault"),
    )
    return out.where("x IS NOT NULL OR fault IS NOT NULL") if dense else out


def device_info(packets: DataFrame, serial_at: tuple[int, int], mac_at: tuple[int, int], version_at: tuple[int, int], voltage_at: int | None = None, temperature_at: int | None = None) -> DataFrame:
    """(stream_id, seq, serial, mac, version, volts, celsius): what a stream's last device packet (stream_id, seq, payload) says, from places (offset, bytes) of its layout."""
    last = packets.groupBy("stream_id").agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"))
    part = lambda at: F.hex(F.substr("payload", F.lit(at[0] + 1), F.lit(at[1])))
    p = F.col("payload")
    volts = F.lit(None).cast("double") if voltage_at is None else unsigned(p, voltage_at, 2) / 100.0
    celsius = F.lit(None).cast("double") if temperature_at is None else temperature(unsigned(p, temperature_at, 1), unsigned(p, temperature_at + 1, 1)).cast("double")
    return last.select("stream_id", "seq", part(serial_at).alias("serial"), part(mac_at).alias("mac"), part(version_at).alias("version"), volts.alias("volts"), celsius.alias("celsius"))


def jumbo_parts(packets: DataFrame, parts: int = 63, size: int = 984, header: int = 160) -> DataFrame:
    """The sub-packets of a jumbo datagram whose id fits."""
    each = packets.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return each.withColumn("payload", F.substr("payload", F.col("part") * size + header + 1, F.lit(size))).where(F.hex(F.substr("payload", F.lit(1), F.lit(2))) == "55AA")


def difop_common(rpm: Column, block_us: float, blocks_per_frame_hint: int = 0, fov_start: Column | None = None, fov_end: Column | None = None) -> dict[str, Column]:
    """Rps, blocks of a turn, nominal azimuth step and the time that the blind part of a turn takes."""
    rps = F.floor(rpm / 60).cast("int")
    rps = F.when(rps == 0, 10).otherwise(rps)
    blocks = F.floor(1_000_000.0 / (rps * block_us)).cast("int")
    step = F.round(rps * (36000.0 * block_us / 1_000_000.0)).cast("int")
    start, end = fov_start if fov_start is not None else F.lit(0), fov_end if fov_end is not None else F.lit(36000)
    seen = F.when(start < end, end - start).otherwise(end + 36000 - start)
    return {"rps": rps, "blocks_per_frame": blocks, "az_step": step, "blind_us": (36000 - seen) / 36000.0 * 1_000_000.0 / rps}


def imu(payload: Column, at: int = 0, accel_range_g: float = 4.0, gyro_range_dps: float = 500.0) -> dict[str, Column]:
    """Three accelerations in g and three rates in rad/s, from 16-bit counts of a full scale."""
    names = ("ax", "ay", "az", "gx", "gy", "gz")
    raw = {n: signed(payload, at + 2 * k, 2) for k, n in enumerate(names)}
    return {n: v / 32768.0 * accel_range_g if n[0] == "a" else F.radians(v / 32768.0 * gyro_range_dps) for n, v in raw.items()}


def echoes(points: DataFrame, mode: int) -> DataFrame:
    """Mode 0 keeps all echoes, 1 the first and 2 the second."""
    return points if mode == 0 else points.where(F.col("echo") == mode)


def scan2d_xy(d: Column, azimuth_deg: Column) -> tuple[Column, Column]:
    """A flat scanner, x = d sin, y = d cos; 0xFFFF is no return."""
    ok = d != 0xFFFF
    return F.when(ok, d * F.sin(F.radians(azimuth_deg))), F.when(ok, d * F.cos(F.radians(azimuth_deg)))
