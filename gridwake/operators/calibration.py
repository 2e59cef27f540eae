"""What a sensor says about itself, by stream and time (D2, D7, D9, D19): angles, speed and echo mode as of each point packet.

Device packets are read into a narrow table of versions: a version begins with a device packet that says something new.
Few versions are kept as one array for each stream and looked up inside the packet's row, so the packets, which are wide,
are not shuffled; the array is broadcast only after its rows have been counted. Beyond that count, packets meet their version by an
as-of join over slices of the order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwake.operators import decode as D
from gridwake.operators import poses, ranges
from gridwake.plans.materialize import materialize

#: Versions that are broadcast at most; each has some hundred bytes.
MOST_VERSIONS = 50_000


@dataclass(frozen=True)
class DeviceSpec:
    """Layout of a model's device packet, in bytes from 0, and how its point packets are to be read.

    Angles have a sign byte and two bytes, in hundredths of a degree or, if `tenths`, in thousandths; packed ones have three
    bytes in ten-thousandths without a sign, the first half of the lasers looking down, and no horizontal angles.
    """

    lasers: int
    block_us: float
    single: str = "single"
    double: str = "dual"
    doubled: tuple[int, ...] = (3,)  # codes of the echo mode for two returns
    alone: tuple[int, ...] = ()  # if given, all other codes mean two returns
    vert_at: int = 468
    slots: int = 32
    tenths: bool = False
    packed: bool = False
    length: int = 1248
    ident: str = "A5FF"
    rpm_at: int = 8
    fov_at: int = 32
    mode_at: int = 300
    #: Microseconds from a block's start to each channel's firing, if they are not even.
    firings: tuple[float, ...] = ()

    @property
    def shares(self) -> tuple[float, ...] | None:
        """The part of a block's step that each channel has behind it, in single precision."""
        block = np.float32(self.block_us) * np.float32(2 if self.single == "two_firings" else 1)
        return tuple(float(np.float32(f) / block) for f in self.firings) or None

    @property
    def double_shares(self) -> tuple[float, ...] | None:
        """The same for packets with two returns."""
        if self.double != "two_firings_dual":
            return self.shares
        half = len(self.firings) // 2
        return tuple(float(np.float32(self.firings[k % half]) / np.float32(self.block_us)) for k in range(len(self.firings))) or None


def _evenly(step: float, n: int, start: float = 0.0) -> tuple[float, ...]:
    return tuple(round(start + step * k, 2) for k in range(n))


_TWO = {"single": "two_firings", "double": "two_firings_dual"}
#: Device packets by the names of decode.MODELS. Fixed values of the wire formats.
DEVICES = {
    "spin16": DeviceSpec(16, 55.5, doubled=(0,), vert_at=1165, packed=True, firings=_evenly(2.8, 16) + _evenly(2.8, 16, 55.5), **_TWO),
    "spin32": DeviceSpec(32, 55.52, doubled=(0,), tenths=True, firings=(*_evenly(2.88, 15), 44.64, *_evenly(2.88, 15, 1.44), 46.08)),
    "spin32_hemisphere": DeviceSpec(32, 55.52, doubled=(0,), firings=(*_evenly(2.56, 8), *_evenly(2.56, 8, 25.68), *_evenly(2.56, 8, 1.28), *_evenly(2.56, 8, 26.96))),
    "spin32_fine": DeviceSpec(32, 55.56, doubled=(0,), firings=_evenly(1.73, 32)),
    "spin16_fine": DeviceSpec(16, 55.56, doubled=(0,), firings=_evenly(1.73, 32), **_TWO),
    "dome96": DeviceSpec(96, 111.08, "two_in_one", "four_in_one", slots=96), "dome48": DeviceSpec(48, 69.462, slots=96),
    "spin48": DeviceSpec(48, 55.552, slots=128), "spin80": DeviceSpec(80, 55.552, slots=128), "spin128": DeviceSpec(128, 55.55, double="ab_dual", slots=128),
    "spin48_plus": DeviceSpec(48, 55.56, alone=(0, 1, 2), slots=128), "spin80_plus": DeviceSpec(80, 55.56, alone=(0, 1, 2), slots=128),
    "spin128_plus": DeviceSpec(128, 55.56, double="ab_dual", alone=(0, 1, 2), slots=128),
}


#: What a device packet says about its sensor's running, and of its angles.
SPEED, ANGLES = ("rps", "az_step", "blocks_per_frame", "blind_us", "dual"), ("verts", "horizs", "rings")


def angle_arrays(payload: Column, spec: DeviceSpec) -> tuple[Column, Column]:
    """Arrays of vertical and horizontal angles by laser in hundredths of a degree, null where an angle is not ready or out of range."""
    lasers = F.sequence(F.lit(0), F.lit(spec.lasers - 1))
    if spec.packed:
        low = lambda i: F.floor(D.unsigned(payload, i * 3 + spec.vert_at, 3) / 100).cast("int")
        return F.transform(lasers, lambda i: D.calibration_angle((i < spec.lasers // 2).cast("int"), low(i))), F.transform(lasers, lambda i: F.lit(0))

    def read(at: int) -> Column:
        def angle(i: Column) -> Column:
            value = D.unsigned(payload, i * 3 + (at + 1), 2)
            value = F.floor((value + 5) / 10) if spec.tenths else value
            return D.calibration_angle(D.unsigned(payload, i * 3 + at, 1), value.cast("int"))

        return F.transform(lasers, angle)

    return read(spec.vert_at), read(spec.vert_at + 3 * spec.slots)


def readings(packets: DataFrame, spec: DeviceSpec) -> DataFrame:
    """(stream_id, seq, rps, az_step, blocks_per_frame, blind_us, dual, verts, horizs, ready, rings) of the device packets among (stream_id, seq, payload); others, and those of a wrong length, are left out.

    Angles count only if all are ready and in range; else they are null and ready is false.
    """
    p = F.col("payload")
    own = packets.where((F.length(p) == spec.length) & (F.hex(F.substr(p, F.lit(1), F.lit(len(spec.ident) // 2))) == spec.ident))
    common = D.difop_common(D.unsigned(p, spec.rpm_at, 2), spec.block_us, fov_start=D.unsigned(p, spec.fov_at, 2), fov_end=D.unsigned(p, spec.fov_at + 2, 2))
    mode = D.unsigned(p, spec.mode_at, 1)
    dual = ~mode.isin(*spec.alone) if spec.alone else mode.isin(*spec.doubled)
    verts, horizs = angle_arrays(p, spec)
    own = own.select("stream_id", "seq", *(common[c].alias(c) for c in ("rps", "az_step", "blocks_per_frame", "blind_us")), dual.alias("dual"), verts.alias("verts"), horizs.alias("horizs"))
    ready = F.forall("verts", lambda v: v.isNotNull()) & F.forall("horizs", lambda v: v.isNotNull())
    own = own.withColumn("ready", ready)
    own = own.withColumn("rings", D.rings(F.col("verts")))
    return own.withColumns({c: F.when(F.col("ready"), F.col(c)) for c in ANGLES})


def speed_versions(found: DataFrame) -> DataFrame:
    """(stream_id, seq, columns of SPEED) of the readings that differ from the one before in their stream."""
    return ranges.changes(found.select("stream_id", "seq", *SPEED), "stream_id", "seq", list(SPEED))


def angle_versions(found: DataFrame, which: str = "first") -> DataFrame:
    """(stream_id, seq, columns of ANGLES) of the readings with good angles: a stream's 'first' one, which holds from then on, or all that say something new ('latest')."""
    if which not in ("first", "latest"):
        raise ValueError("angles are those of the 'first' or the 'latest' device packet")
    good = found.where("ready").select("stream_id", "seq", *ANGLES)
    if which == "latest":
        return ranges.changes(good, "stream_id", "seq", list(ANGLES))
    return good.groupBy("stream_id").agg(F.min_by(F.struct("seq", *ANGLES), "seq").alias("g")).select("stream_id", "g.*")


def as_of(packets: DataFrame, found: DataFrame, columns: tuple[str, ...], most: int = MOST_VERSIONS, slices: int = 100_000) -> DataFrame:
    """Packets with the columns of the last version (stream_id, seq, ...) at or before them in their stream, null without one."""
    found = materialize(found, "versions")
    if found.limit(most + 1).count() <= most:
        own = found.groupBy(F.col("stream_id").alias("_stream")).agg(F.array_sort(F.collect_list(F.struct("seq", *columns))).alias("_versions"))
        joined = packets.join(F.broadcast(own), F.col("stream_id").eqNullSafe(F.col("_stream")), "left")
        behind = F.size(F.filter(F.col("_versions.seq"), lambda at: at <= F.col("seq")))
        return joined.withColumn("_version", F.get("_versions", behind - 1)).select(*packets.columns, *(F.col(f"_version.{c}").alias(c) for c in columns))
    got = poses.asof(packets, found.select("stream_id", "seq", *columns), "stream_id", "seq", slices_ms=slices)
    return got.select(*packets.columns, *(F.col(f"pose_{c}").alias(c) for c in columns))


def decode_streams(packets: DataFrame, model: str, angles: str = "first", wait: bool = True, device: DeviceSpec | None = None, most: int = MOST_VERSIONS, **options) -> DataFrame:
    """The points of decode() from streams of point and device packets (stream_id, seq, payload) of one spinning model.

    Every point packet is read with the angles, nominal step, blind time and echo mode that hold at its place in its stream.
    Before them, points are null with the fault 'no_calibration'; without `wait` they have angles of 0 and the speed of ten turns a second.
    Point packets of a wrong length or id are left out (decode.faults counts them).
    """
    spec, own = D.MODELS[model], device or DEVICES[model]
    p = F.col("payload")
    points = packets.where((F.length(p) == spec.length) & (F.hex(F.substr(p, F.lit(1), F.lit(len(spec.ident) // 2))) == spec.ident))
    found = materialize(readings(packets, own), "readings")
    points = as_of(points.select("stream_id", "seq", "payload"), speed_versions(found), SPEED, most)
    points = as_of(points, angle_versions(found, angles), ANGLES, most)
    flat = F.array(*(F.lit(0) for _ in range(spec.lasers)))
    arrays = tuple(F.col(c) if wait else F.coalesce(c, flat) for c in ANGLES)
    arrays = tuple(F.coalesce(c, F.array().cast("array<int>")) for c in arrays)
    return D.decode(
        points, spec, arrays, nominal=F.coalesce("az_step", F.lit(20)), blind=F.coalesce("blind_us", F.lit(0.0)), duration=own.block_us,
        mode=own.single, shares=own.shares, dual=(F.col("dual"), own.double, own.double_shares), **options,
    )
