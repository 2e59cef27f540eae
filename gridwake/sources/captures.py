"""Captures cut into byte ranges: a data source for batches and for replays as a stream.

    captures.register(spark)
    spark.read.format("capture").load("/data/drive").where("port IN (6699, 7788)")   # file, pass, offset, ts_us, port, frame

A record's length stands in the record before it, so a task that begins in the middle of a file must find a record. It looks for a
place from which plausible headers follow one another for longer than a record can be; two chains of records that hold for so
long are one. Each task proves its end: the record at which its own chain crosses the range's end must be the one that the next
task finds by itself, else the job fails. The first task begins at the file's first record, so all records that come out
are those a reader from the start gives, whatever payloads look like.

Filters on port and ts_us are taken over by the source, which skips the bytes of other frames. Files are opened with Arrow's
file systems: local paths and those of hdfs, s3, gs and abfs. packets.read_pcap reads whole files from any store of Spark's.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Magic numbers of capture files: byte order and ticks of a second; fixed values of the format.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000), b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000)}
HEAD, RECORD = 24, 16
#: Bytes of a range, of a window that a task holds at once, and of a record at most.
RANGE, WINDOW, LONGEST = 64 << 20, 4 << 20, 1 << 18
#: Seconds that a record's time may lie from the file's first one's: ten years.
SPAN = 10 * 366 * 86_400
SCHEMA = "file string, pass int, offset bigint, ts_us bigint, port int, frame binary"
_ARROW = pa.schema([("file", pa.string()), ("pass", pa.int32()), ("offset", pa.int64()), ("ts_us", pa.int64()), ("port", pa.int32()), ("frame", pa.binary())])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a path or URI."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files below a folder; names of files and folders that begin with '_' or '.' are passed over."""
    fs, own = opened(path)
    info = fs.get_file_info(own)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    scheme = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    found = [info] if info.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(own, recursive=True)) if f.type == pafs.FileType.File]
    below = lambda f: f.base_name if f.path == info.path else f.path[len(info.path) :].strip("/")
    return sorted((scheme + f.path, f.size) for f in found if not any(part[:1] in ("_", ".") for part in below(f).split("/")))


class CaptureFile:
    """One capture file, read in stretches."""

    def __init__(self, path: str, longest: int = LONGEST):
        fs, own = opened(path)
        self.path, self.longest = path, longest
        self.file = fs.open_input_file(own)
        self.size = self.file.size()
        head = self.read(0, HEAD + RECORD)
        self.order, self.ticks = MAGICS.get(head[:4], (None, 0))
        self.first = struct.unpack_from(self.order + "I", head, HEAD)[0] if self.order and len(head) >= HEAD + 4 else 0

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, max(0, self.size - at)))

    def close(self) -> None:
        self.file.close()

    def _plausible(self, data: bytes) -> np.ndarray:
        """Places in data at which a record's header can stand."""
        if len(data) < RECORD:
            return np.zeros(0, np.int64)
        raw = np.frombuffer(data, np.uint8)
        n = len(raw) - RECORD + 1
        order = range(4) if self.order == "<" else range(3, -1, -1)
        field = lambda k: sum(raw[4 * k + j : 4 * k + j + n].astype(np.uint32) << np.uint32(8 * o) for j, o in zip(range(4), order))
        size = field(2)
        good = (size <= self.longest) & (field(1) < self.ticks)
        at = np.flatnonzero(good & (size <= field(3)))
        seconds = field(0)[at].astype(np.int64)
        return at[np.abs(seconds - self.first) <= SPAN]

    def _holds(self, data: bytes, at: int, plausible: set[int]) -> bool:
        """Whether plausible headers follow one another from a place in data to its end."""
        while at + RECORD <= len(data):
            if at not in plausible:
                return False
            at += RECORD + struct.unpack_from(self.order + "I", data, at + 8)[0]
        return True

    def record_from(self, place: int) -> int:
        """The first record at or behind a place, by the chains around it alone; the file's size if there is none."""
        low = max(HEAD, place - 2 * self.longest)
        data = self.read(low, place - low + 3 * self.longest)
        if low == HEAD:
            at = 0
        else:
            found = self._plausible(data)
            known = set(found.tolist())
            at = next((k for k in found.tolist() if self._holds(data, k, known)), None)
        while at is not None and low + at < place:
            if at + RECORD > len(data):
                at = None
            else:
                at += RECORD + struct.unpack_from(self.order + "I", data, at + 8)[0]
        return self.size if at is None or low + at + RECORD > self.size else low + at

    def windows(self, start: int, end: int) -> Iterator[tuple[int, bytes, list[tuple[int, int]]]]:
        """(offset, bytes, (place, size) of each record) of the stretches of the records that begin from start, which is one, to end. The last one's successor is proven."""
        at = start
        while at < end and at + RECORD <= self.size:
            data, own, low = self.read(at, min(WINDOW, end - at) + self.longest + RECORD), [], at
            stop = min(low + WINDOW, end)
            while at < stop and at + RECORD <= self.size:
                size = struct.unpack_from(self.order + "I", data, at - low + 8)[0]
                if at + RECORD + size > self.size:  # cut off by the file's end
                    if self.size - at > self.longest + RECORD:
                        raise ValueError(f"{self.path}: the record at byte {at} is longer than the file")
                    at = self.size
                    break
                if size > self.longest:
                    raise ValueError(f"{self.path}: the record at byte {at} has {size} bytes, more than {self.longest}")
                own.append((at - low, size))
                at += RECORD + size
            yield low, data, own
        if end < self.size and (found := self.record_from(end)) != (at if at + RECORD <= self.size else self.size):
            raise ValueError(f"{self.path}: records from byte {start} on lead to byte {at}, but the first one behind byte {end} is at {found}")


def udp_ports(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The port that unfragmented UDP packets over IPv4 and Ethernet, with a VLAN tag or without, go to; -1 for other frames."""
    last = len(data) - 1
    byte = lambda at: data[np.minimum(at, last)].astype(np.int64)
    two = lambda at: byte(at) << 8 | byte(at + 1)
    ip = start + 14 + 4 * (two(start + 12) == 0x8100)
    udp = ip + (byte(ip) & 15) * 4
    ok = (two(ip - 2) == 0x0800) & (byte(ip + 9) == 17) & (two(ip + 6) & 0x1FFF == 0) & (udp + 8 <= start + size)
    return np.where(ok, two(udp + 2), -1)


@dataclass
class Wanted:
    """What frames a query asks for."""

    ports: frozenset[int] | None = None
    low: int | None = None
    high: int | None = None

    def take(self, f: Filter) -> bool:
        """Whether the source sees to a filter itself."""
        name = getattr(f, "attribute", None)
        if name == ("port",) and isinstance(f, (EqualTo, In)):
            values = frozenset(f.value if isinstance(f, In) else [f.value])
            self.ports = values if self.ports is None else self.ports & values
        elif name == ("ts_us",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            least = f.value + isinstance(f, GreaterThan)
            self.low = least if self.low is None else max(self.low, least)
        elif name == ("ts_us",) and isinstance(f, (LessThan, LessThanOrEqual)):
            most = f.value - isinstance(f, LessThan)
            self.high = most if self.high is None else min(self.high, most)
        else:
            return False
        return True

    def rows(self, file: CaptureFile, turn: int, low: int, data: bytes, records: list[tuple[int, int]]) -> pa.RecordBatch | None:
        """The frames asked for among the records of a window."""
        if not records:
            return None
        raw = np.frombuffer(data, np.uint8)
        at, size = (np.array(x, np.int64) for x in zip(*records))
        fields = np.array([struct.unpack_from(file.order + "II", data, k) for k in at.tolist()], np.int64)
        ts = fields[:, 0] * 1_000_000 + fields[:, 1] * 1_000_000 // file.ticks
        port = udp_ports(raw, at + RECORD, size)
        keep = np.ones(len(at), bool)
        if self.ports is not None:
            keep &= np.isin(port, list(self.ports))
        if self.low is not None:
            keep &= ts >= self.low
        if self.high is not None:
            keep &= ts <= self.high
        k = np.flatnonzero(keep)
        frames = pa.array([data[a : a + n] for a, n in zip((at[k] + RECORD).tolist(), size[k].tolist())], pa.binary())
        columns = [pa.array([file.path] * len(k), pa.string()), pa.array(np.full(len(k), turn, np.int32)), pa.array(at[k] + low), pa.array(ts[k]), pa.array(port[k].astype(np.int32), mask=port[k] < 0), frames]
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


@dataclass
class Stretch(InputPartition):
    """A byte range of a file; proven ranges begin at a record."""

    path: str
    start: int
    end: int
    turn: int = 0
    proven: bool = False


def _read(part: Stretch, wanted: Wanted, longest: int) -> Iterator[pa.RecordBatch]:
    file = CaptureFile(part.path, longest)
    try:
        if file.order:
            start = part.start if part.proven else HEAD if part.start <= HEAD else file.record_from(part.start)
            for low, data, records in file.windows(start, part.end) if start < part.end else ():
                if (batch := wanted.rows(file, part.turn, low, data, records)) is not None and batch.num_rows:
                    yield batch
    finally:
        file.close()


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.range, self.longest = options["path"], int(options.get("range", RANGE)), int(options.get("longest", LONGEST))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Stretch]:
        return [Stretch(path, at, min(size, at + self.range)) for path, size in files_of(self.path) for at in range(0, max(size, 1), self.range)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.wanted, self.longest)


class CaptureStream(DataSourceStreamReader):
    """A replay: files in the order of their names, over and over for `passes`; a batch takes what the records' own times put into `seconds`, and `records` at most.

    An offset is (pass, file, byte), so a query that starts again goes on at the very record. Trigger intervals pace it; nothing sleeps.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.longest = options["path"], int(options.get("longest", LONGEST))
        self.passes, self.us, self.most = int(options.get("passes", 1)), float(options.get("seconds", 1.0)) * 1e6, int(options.get("records", 10_000))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"pass": 0, "file": 0, "byte": HEAD}

    def latestOffset(self) -> dict:
        at = dict(self.at or self.initialOffset())
        files, left, began = files_of(self.path), self.most, None
        while left and at["pass"] < self.passes and files:
            if at["file"] >= len(files):
                at = {"pass": at["pass"] + 1, "file": 0, "byte": HEAD}
                if left < self.most:  # times begin anew
                    break
                continue
            file = CaptureFile(files[at["file"]][0], self.longest)
            while file.order and left and at["byte"] + RECORD <= file.size:
                sec, part, size = struct.unpack(file.order + "III", file.read(at["byte"], 12))
                if at["byte"] + RECORD + size > file.size:
                    break
                ts = sec * 1_000_000 + part * 1_000_000 // file.ticks
                began = ts if began is None else began
                if ts - began >= self.us:
                    file.close()
                    self.at = at
                    return at
                at["byte"] += RECORD + size
                left -= 1
            else:
                if not left:
                    file.close()
                    break
            file.close()
            at = {"pass": at["pass"], "file": at["file"] + 1, "byte": HEAD}
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        if self.at is None:  # a query that goes on plans its last batch first
            self.at = dict(end)
        out, files, at = [], files_of(self.path), dict(start)
        while (at["pass"], at["file"], at["byte"]) < (end["pass"], end["file"], end["byte"]):
            if at["file"] >= len(files):
                at = {"pass": at["pass"] + 1, "file": 0, "byte": HEAD}
                continue
            path, size = files[at["file"]]
            last = (at["pass"], at["file"]) == (end["pass"], end["file"])
            out.append(Stretch(path, at["byte"], end["byte"] if last else size, at["pass"], True))
            at = dict(end) if last else {"pass": at["pass"], "file": at["file"] + 1, "byte": HEAD}
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return _read(partition, Wanted(), self.longest)

    def commit(self, end: dict) -> None:
        pass


class Capture(DataSource):
    """Options: path, range (bytes of a task's range), longest (bytes of a record); for streams passes, seconds and records."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)

    def streamReader(self, schema) -> CaptureStream:
        return CaptureStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format 'capture' known to the session, with filters handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Capture)
