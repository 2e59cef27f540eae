"""Plain binary files as a sink: packed records (K1, K5, K7) and binary point clouds (K2).

    binary_sinks.register(spark)
    records.write.format("binary").mode("append").save(folder)          # column record: files of records one behind another
    clouds.write.format("binary").option("each", "file").mode("append").save(folder)   # columns name, record: a file for each row

Spark has no writer of plain binary files; a Python data source is one. A task writes into files of its own in a folder that
readers pass over, and the driver moves them into place once all tasks have ended: a failed job or task leaves no file behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gridwake.sources.captures import files_of, opened


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written, as (where they are, where they belong)."""

    files: list[tuple[str, str]]


class BinaryWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.each, self.suffix, self.overwrite = options["path"].rstrip("/"), options.get("each", "task"), options.get("suffix", ".bin"), overwrite
        self.job = uuid.uuid4().hex
        if self.each not in ("task", "file"):
            raise ValueError("each is 'task' or 'file'")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, own = opened(self.path)
        folder = f"{own}/_temporary/{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        done: list[tuple[str, str]] = []

        def new(name: str) -> pa.NativeFile:
            done.append((f"{folder}/{len(done)}", f"{own}/{name}"))
            return fs.open_output_stream(done[-1][0])

        out = None
        for batch in iterator:
            records = batch.column(batch.schema.get_field_index("record"))
            if self.each == "file":
                for name, record in zip(batch.column(batch.schema.get_field_index("name")), records):
                    with new(name.as_py() + self.suffix) as f:
                        f.write(record.as_buffer())
            else:
                out = out or new(f"part-{uuid.uuid4().hex}{self.suffix}")
                for record in records:
                    if record.is_valid:
                        out.write(record.as_buffer())
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, own = opened(self.path)
        named = [to for m in messages if m for _, to in m.files]
        if len(set(named)) < len(named):
            self.abort(messages)
            raise ValueError("two rows have one name")
        if self.overwrite:
            for path, _ in files_of(self.path):
                fs.delete_file(opened(path)[1])
        for m in messages:
            for now, to in m.files if m else ():
                fs.move(now, to)
        self._clear(fs, own)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, fs: pafs.FileSystem, own: str) -> None:
        if fs.get_file_info(f"{own}/_temporary/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{own}/_temporary/{self.job}")
        if fs.get_file_info(f"{own}/_temporary").type != pafs.FileType.NotFound and not fs.get_file_info(pafs.FileSelector(f"{own}/_temporary")):
            fs.delete_dir(f"{own}/_temporary")


class Binary(DataSource):
    """Options: path, each ('task': a file of a task's records; 'file': one for each row, named by the column name), suffix."""

    @classmethod
    def name(cls) -> str:
        return "binary"

    def schema(self) -> str:
        return "name string, record binary"

    def writer(self, schema, overwrite: bool) -> BinaryWriter:
        return BinaryWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format 'binary' known to the session."""
    spark.dataSource.register(Binary)


# --- records --------------------------------------------------------------------------------------------------------

#: K1: a packed obstacle and the record of a frame; fixed layouts of the wire format, little-endian.
BOX = np.dtype([("id", "<i4"), ("depth", "<f4"), ("width", "<f4"), ("height", "<f4"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("corners", "<f4", (4, 2))])
MOST = 20
OBSTACLES = np.dtype([("timestamp", "<u8"), ("return_val", "<i4"), ("obs_num", "<i4"), ("obstacle", BOX, (MOST,))])
_PARTS = ("depth", "width", "height", "x", "y", "z")


def obstacle_records(boxes: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """(frame_id, record): a packed record of OBSTACLES for each frame of boxes (frame_id, ts_ms, id, depth, width, height, x, y, z, corners), its first 20 in the order of their ids.

    corners are four structs of x and y. Frames (frame_id, ts_ms), if given, have a record also without boxes, with return_val 0. Nulls are zeros.
    """
    one = F.struct(F.col("id").cast("int").alias("id"), *(F.coalesce(F.col(c).cast("float"), F.lit(0.0)).alias(c) for c in _PARTS), F.transform(F.coalesce("corners", F.array().cast("array<struct<x:double,y:double>>")), lambda p: F.struct(p["x"].cast("float").alias("x"), p["y"].cast("float").alias("y"))).alias("corners"))
    rows = boxes.groupBy("frame_id").agg(F.max("ts_ms").alias("ts_ms"), F.slice(F.array_sort(F.collect_list(one)), 1, MOST).alias("boxes"))
    if frames is not None:
        rows = frames.select("frame_id", "ts_ms").join(rows.select("frame_id", "boxes"), "frame_id", "left")
    rows = rows.withColumn("boxes", F.coalesce("boxes", F.array().cast(rows.schema["boxes"].dataType)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, OBSTACLES)
            out["timestamp"] = pc.fill_null(batch["ts_ms"], 0).to_numpy(zero_copy_only=False)
            lists = batch["boxes"]
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            out["obs_num"], out["return_val"] = n, n > 0
            owner = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            flat = lists.flatten()
            for c in ("id", *_PARTS):
                out["obstacle"][c][owner, place] = flat.field(c).to_numpy(zero_copy_only=False)
            corners = flat.field("corners")
            k = pc.list_value_length(corners).to_numpy(zero_copy_only=False).astype(np.int64)
            of, at = np.repeat(np.arange(len(k)), k), np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            points, use = corners.flatten(), at < 4
            for j, c in enumerate("xy"):
                values = np.nan_to_num(points.field(c).to_numpy(zero_copy_only=False))
                out["obstacle"]["corners"][owner[of[use]], place[of[use]], at[use], j] = values[use]
            yield pa.RecordBatch.from_arrays([batch["frame_id"], pa.array([r.tobytes() for r in out], pa.binary())], names=["frame_id", "record"])

    return rows.select("frame_id", "ts_ms", "boxes").mapInArrow(pack, f"frame_id {rows.schema['frame_id'].dataType.simpleString()}, record binary")


def unpacked_obstacles(records: DataFrame) -> DataFrame:
    """K1: (number of the record's row, ts_ms, return_val, obs_num, obstacles) of packed records (record)."""
    schema = "ts_ms bigint, return_val int, obs_num int, obstacles array<struct<id:int,depth:float,width:float,height:float,x:float,y:float,z:float,corners:array<struct<x:float,y:float>>>>"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("id", pa.int32()), *((c, pa.float32()) for c in _PARTS), ("corners", pa.list_(pa.struct([("x", pa.float32()), ("y", pa.float32())])))]))
        for batch in batches:
            rows = np.frombuffer(b"".join(r.as_py() for r in batch["record"]), OBSTACLES)
            lists = [[{"id": int(b["id"]), **{c: float(b[c]) for c in _PARTS}, "corners": [{"x": float(x), "y": float(y)} for x, y in b["corners"]]} for b in r["obstacle"][: r["obs_num"]]] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(rows["timestamp"].astype(np.int64)), pa.array(rows["return_val"]), pa.array(rows["obs_num"]), pa.array(lists, kind)], names=["ts_ms", "return_val", "obs_num", "obstacles"])

    return records.select("record").mapInArrow(unpack, schema)


def cloud_files(points: DataFrame, order: str | None = None, name: str = "frame-") -> DataFrame:
    """K2: (name, record): a binary cloud file of 32-bit x, y, z and intensity for each frame_id of points, for the format 'binary' with a file for each row.

    Frames are dealt to tasks and sorted there, so a task holds one frame's bytes at a time. Points stand in the order of the column given.
    """
    own = points.select(F.col("frame_id").cast("string").alias("frame_id"), F.col(order).alias("place") if order else F.monotonically_increasing_id().alias("place"), *(F.coalesce(F.col(c).cast("float"), F.lit(float("nan")).cast("float")).alias(c) for c in ("x", "y", "z", "intensity")))
    layout = np.dtype([(c, "<f4") for c in ("x", "y", "z", "intensity")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(frame: str, parts: list[bytes]) -> pa.RecordBatch:
            body = b"".join(parts)
            n = len(body) // layout.itemsize
            head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n"
            return pa.RecordBatch.from_arrays([pa.array([name + frame]), pa.array([head.encode() + body], pa.binary())], names=["name", "record"])

        at, parts = None, []
        for batch in batches:
            frames = batch["frame_id"].to_pylist()
            table = np.empty(batch.num_rows, layout)
            for c in layout.names:
                table[c] = batch[c].to_numpy(zero_copy_only=False)
            cuts = [0, *(k for k in range(1, len(frames)) if frames[k] != frames[k - 1]), len(frames)]
            for a, b in zip(cuts, cuts[1:]):
                if frames[a] != at and parts:
                    yield made(at, parts)
                    parts = []
                at = frames[a]
                parts.append(table[a:b].tobytes())
        if parts:
            yield made(at, parts)

    dealt = own.where("frame_id IS NOT NULL").repartition("frame_id").sortWithinPartitions("frame_id", "place")
    return dealt.mapInArrow(pack, "name string, record binary")
