"""Binary road maps as tables.

A map is a sequence of little-endian records whose lengths stand in them, so a file is read by one task: a version of 6
bytes, longitude and latitude of the anchor, then ten counted sections. The layout is declared; one reader follows it.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT = (("x", "f"), ("y", "f"))
_IDS = ["i"]


def _fields(names: str, kind: str = "i") -> tuple:
    return tuple((n, kind) for n in names.split())


#: The sections in their order, with the fields of a record. "i" and "f" are 4 bytes; a list is counted; (n, fields) stands n times, where n may
#: name a field whose count holds here too. Fixed values of the format.
LAYOUT = {
    "stations": (("id", "i"), *_POINT, ("polygon", [_POINT]), ("spaces", [(("theta", "f"), ("corners", (4, _POINT)))])),
    "lanes": (
        ("id", "i"), ("centre", [_fields("x y s theta kappa", "f")]), *_fields("length width", "f"),
        *_fields("type turn direction limit_speed station_id reverse_id left_id right_id"), ("income", _IDS), ("outgo", _IDS),
    ),
    "stop_lines": (("id", "i"), ("points", (2, _POINT))),
    "crosswalks": (("id", "i"), ("points", (4, _POINT))),
    "signals": (("id", "i"), *_fields("x y z", "f"), ("lights", [_fields("shape arrow")])),
    "clear_areas": (("id", "i"), ("points", (4, _POINT))),
    "traffic_signs": (("id", "i"), *_fields("x y z", "f"), ("types", _IDS)),
    "sections": (
        ("id", "i"), ("lane_ids", _IDS), ("left_line", [_POINT]), ("right_line", ("left_line", _POINT)),
        *_fields("left_median right_median stop_line_id crosswalk_id signal_id clear_area_id left_id right_id reverse_id"), ("sign_ids", _IDS), ("income", _IDS), ("outgo", _IDS),
    ),
    "roads": (("id", "i"), ("reverse_id", "i"), ("section_ids", _IDS), ("income", _IDS), ("outgo", _IDS), ("outgo_junction_id", "i")),
    "junctions": (("id", "i"), ("polygon", [_POINT]), ("income", _IDS), ("outgo", _IDS), ("connect", _IDS)),
}
VERSION = 6


class _Reader:
    def __init__(self, content: bytes, name: str):
        self.content, self.name, self.at = content, name, 0

    def take(self, kind: str):
        if self.at + struct.calcsize(kind) > len(self.content):
            raise ValueError(f"{self.name}: the map ends within a record at byte {self.at}")
        value = struct.unpack_from("<" + kind, self.content, self.at)[0]
        self.at += struct.calcsize("<" + kind)
        return value

    def value(self, kind, seen: dict):
        if isinstance(kind, str):
            return self.take(kind)
        inner, n = (kind[0], self.take("i")) if isinstance(kind, list) else (kind[1], len(seen[kind[0]]) if isinstance(kind[0], str) else kind[0])
        if n < 0:
            raise ValueError(f"{self.name}: a count below 0 at byte {self.at}")
        return [self.take(inner) if isinstance(inner, str) else self.record(inner) for _ in range(n)]

    def record(self, fields: tuple) -> dict:
        out: dict = {}
        for name, kind in fields:
            out[name] = self.value(kind, out)
        return out


def parse_map(content: bytes, name: str = "map") -> Iterator[tuple[str, int, dict]]:
    """(section, place, record) of a map file; the head is the section 'head'. A file that ends early is an error."""
    r = _Reader(content, name)
    version = content[:VERSION].split(b"\0")[0].decode("latin-1")
    r.at = VERSION
    yield "head", 0, {"version": version, "lon": r.take("d"), "lat": r.take("d")}
    for section, fields in LAYOUT.items():
        for k in range(r.take("i")):
            yield section, k, r.record(fields)


def _type(kind) -> str:
    if isinstance(kind, str):
        return {"i": "int", "f": "double"}[kind]
    return f"array<{_type(kind[0] if isinstance(kind, list) else kind[1])}>" if not _is_record(kind) else "struct<" + ", ".join(f"{n}: {_type(k)}" for n, k in kind) + ">"


def _is_record(kind) -> bool:
    return isinstance(kind, tuple) and all(isinstance(k, tuple) and isinstance(k[0], str) for k in kind) and not isinstance(kind[0], (int, str))


def read_map(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of map files by the names of LAYOUT, and head; each has file and ord beside the record's fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = [(name.as_py(), part, k, json.dumps(record)) for part, k, record in parse_map(content.as_buffer().to_pybytes(), name.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["file", "part", "ord", "record"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, part string, ord bigint, record string")
    kinds = {"head": "struct<version: string, lon: double, lat: double>"} | {name: _type(fields) for name, fields in LAYOUT.items()}
    return {name: rows.where(F.col("part") == name).select("file", "ord", F.from_json("record", kind).alias("r")).select("file", "ord", "r.*") for name, kind in kinds.items()}


def map_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """sections, lane_points, edges, roads and junctions of one map, as gridwake.operators.mapjoin takes them."""
    road = tables["roads"].select(F.col("id").alias("road_id"), F.explode("section_ids").alias("id"))
    sections = tables["sections"].join(road.groupBy("id").agg(F.max("road_id").alias("road_id")), "id", "left")
    links = [tables["sections"].select(F.explode("income").alias("src"), F.col("id").alias("dst")), tables["sections"].select(F.col("id").alias("src"), F.explode("outgo").alias("dst"))]
    points = tables["lanes"].select(F.col("id").alias("lane_id"), "width", F.posexplode("centre").alias("ord", "p")).select("lane_id", "ord", "p.x", "p.y", "p.s", "p.theta", "p.kappa", "width")
    return {
        "sections": sections.select(F.col("id").alias("section_id"), F.coalesce("road_id", F.lit(0)).alias("road_id"), "left_line", "right_line", "lane_ids"),
        "lane_points": points,
        "edges": links[0].unionByName(links[1]).distinct(),
        "roads": tables["roads"].select(F.col("id").alias("road_id"), "section_ids", "outgo_junction_id"),
        "junctions": tables["junctions"].select(F.col("id").alias("junction_id"), "income", "outgo", "connect", "polygon"),
    }
