"""Configuration files as checked dataclasses.

Settings are small and belong to the driver; they are read through Spark, so that they may lie in any store that it reaches.
Two forms are known: sections of `key: value` lines (a YAML subset: two levels, comments, quotes, a first line with a
version directive) and nested groups `name : { key = value; }` with lists.
"""

from __future__ import annotations

import re
from dataclasses import MISSING, dataclass, fields

from pyspark.sql import SparkSession

from gridwake.config import GridConfig, PoseConfig


class ConfigError(ValueError):
    """A file that can't be read (code -1), a section that is missing (-2), or a parameter that is missing or of another type (-3)."""

    def __init__(self, code: int, what: str):
        super().__init__(what)
        self.code = code


def _text(spark: SparkSession, path: str) -> str:
    try:
        return spark.read.text(path, wholetext=True).head()["value"]  # one file
    except Exception as e:
        raise ConfigError(-1, f"{path} can't be read: {e}") from None


def _scalar(raw: str):
    raw = raw.strip()
    if raw[:1] in ("'", '"') and raw[-1:] == raw[:1] and len(raw) > 1:
        return raw[1:-1]
    if raw.lower() in ("true", "false"):
        return raw.lower() == "true"
    if re.fullmatch(r"[+-]?\d+[lL]?", raw):
        return int(raw.rstrip("lL"))
    if re.fullmatch(r"0[xX][0-9a-fA-F]+", raw):
        return int(raw, 16)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", raw):
        return float(raw)
    return raw


def parse_sections(text: str) -> dict[str, dict]:
    """Sections of `key: value` lines, indented below `Section:`; nested ones have names joined by a dot."""
    out: dict[str, dict] = {"": {}}
    above: list[tuple[int, str]] = []
    for line in text.splitlines():
        body = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not body.strip() or body.startswith(("%", "---", "...")):
            continue
        indent = len(body) - len(body.lstrip())
        name, sep, value = body.strip().partition(":")
        if not sep:
            raise ConfigError(-1, f"no key in the line {line!r}")
        while above and above[-1][0] >= indent:
            above.pop()
        section = ".".join(n for _, n in above)
        if value.strip():
            out.setdefault(section, {})[name.strip()] = _scalar(value)
        else:
            above.append((indent, name.strip()))
            out.setdefault(".".join(n for _, n in above), {})
    return out


_TOKEN = re.compile(r"""\s*(?:(?://|\#)[^\n]*|/\*.*?\*/|("(?:[^"\\]|\\.)*")|([A-Za-z*][\w*-]*)|([+-]?(?:0[xX][0-9a-fA-F]+|[\d.]+(?:[eE][+-]?\d+)?)[lL]?)|([{}()\[\]:=;,]))""", re.DOTALL)


def parse_groups(text: str) -> dict:
    """Nested groups `name : { key = value; }`; values are numbers, strings, booleans, groups and lists."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ConfigError(-1, f"not understood: {text[at : at + 30]!r}")
        if m.lastindex:
            tokens.append(m[m.lastindex])
        at = m.end()

    def value(k: int):
        if tokens[k] == "{":
            return group(k + 1, "}")
        if tokens[k] in "([":
            close, items, k = {"(": ")", "[": "]"}[tokens[k]], [], k + 1
            while tokens[k] != close:
                item, k = value(k)
                items.append(item)
                k += tokens[k] == ","
            return items, k + 1
        return _scalar(tokens[k]), k + 1

    def group(k: int, close: str | None):
        out = {}
        while k < len(tokens) and tokens[k] != close:
            name = tokens[k]
            if tokens[k + 1] not in ":=":
                raise ConfigError(-1, f"no value for {name}")
            out[name], k = value(k + 2)
            k += k < len(tokens) and tokens[k] in ";,"
        return out, k + 1

    try:
        return group(0, None)[0]
    except IndexError:
        raise ConfigError(-1, "the file ends within a group") from None


def required(section: dict, key: str, kind: type, at: str = ""):
    """section[key], which must be of the kind; whole numbers serve as floats."""
    if key not in section:
        raise ConfigError(-3, f"{at}{key} is missing")
    value = section[key]
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise ConfigError(-3, f"{at}{key} is a {type(value).__name__} and not a {kind.__name__}")
    return value


@dataclass(frozen=True)
class SensorConfig:
    """Where packets come from and how a sensor sees; ports are 1 to 65535, angles -90 to 90 degrees with the upper above the lower, rings 1 to 1024."""

    model: str
    msop_port: int
    difop_port: int
    upper_angle: float = 15.0
    lower_angle: float = -15.0
    rings: int = 16

    def __post_init__(self):
        for port in (self.msop_port, self.difop_port):
            if not 1 <= port <= 65535:
                raise ConfigError(-3, f"{port} is no port")
        if not self.model:
            raise ConfigError(-3, "no sensor model is named")
        if not all(-90 <= a <= 90 for a in (self.upper_angle, self.lower_angle)) or self.upper_angle <= self.lower_angle:
            raise ConfigError(-3, f"{self.lower_angle} to {self.upper_angle} is no range of elevations")
        if not 1 <= self.rings <= 1024:
            raise ConfigError(-3, f"{self.rings} rings")


@dataclass(frozen=True)
class MapConfig:
    """Whether and how obstacles are judged by a road map."""

    enabled: bool = False
    path: str = ""
    off_road: str = "drop"
    margin: float = 0.5


@dataclass(frozen=True)
class Calibration:
    """A sensor's place on the vehicle: a 3x4 matrix row by row, yaw in degrees and offset in metres, ground height and mounting."""

    matrix: tuple[float, ...]
    yaw_deg: float = 0.0
    offset_x: float = 0.0
    offset_y: float = 0.0
    ground_height: float = 0.0
    install_type: int = 0

    def __post_init__(self):
        if len(self.matrix) != 12:
            raise ConfigError(-3, f"a matrix of {len(self.matrix)} numbers and not of 12")

    @property
    def rows(self) -> list[list[float]]:
        return [list(self.matrix[k : k + 4]) for k in (0, 4, 8)]


def fill(kind: type, section: dict | None, names: dict[str, str] | None = None, at: str = ""):
    """A dataclass of the kind from a section, whose keys are the fields' names or those in names; fields with a default may be missing, others not. Without a section all fields must have defaults."""
    if section is None and any(f.default is MISSING for f in fields(kind)):
        raise ConfigError(-2, f"the section {at or kind.__name__} is missing")
    own, values = section or {}, {}
    for f in fields(kind):
        key = (names or {}).get(f.name, f.name)
        if key in own or f.default is MISSING:
            want = type(f.default) if f.default is not MISSING else {"str": str, "int": int, "float": float, "bool": bool}.get(str(f.type), tuple)
            if want is tuple:
                raw = required(own, key, list, f"{at}.")
                values[f.name] = tuple(float(x) for x in raw)
            else:
                wide = float if want is int and isinstance(f.default, int) and isinstance(own.get(key), float) else want
                values[f.name] = required(own, key, wide, f"{at}.")
    return kind(**values)


#: Keys of the sections, by field.
SENSOR_KEYS = {"model": "type", "msop_port": "msopPort", "difop_port": "difopPort", "upper_angle": "verticalUpperAngle", "lower_angle": "verticalLowerAngle", "rings": "scanRings"}
GRID_KEYS = {
    "x_min": "roi_x_min", "x_max": "roi_x_max", "y_min": "roi_y_min", "y_max": "roi_y_max", "resolution": "grid_resolution", "slope": "slope_threshold",
    "height": "height_diff_threshold", "min_points": "min_points_per_cell", "near_boundary": "near_range_boundary",
}


def read_settings(spark: SparkSession, path: str) -> dict:
    """Sensor, grid, poses and map settings of a file of sections: the first two sections are required, the others have defaults."""
    s = parse_sections(_text(spark, path))
    return {
        "sensor": fill(SensorConfig, s.get("Lidar"), SENSOR_KEYS, "Lidar"),
        "grid": fill(GridConfig, _present(s, "MapGroundFilter"), GRID_KEYS, "MapGroundFilter"),
        "poses": fill(PoseConfig, s.get("Localization"), {"timeout_ms": "timeout_ms"}, "Localization"),
        "map": fill(MapConfig, s.get("HdmapFilter"), {"enabled": "mapFilterModel", "path": "mapPath", "off_road": "filterMode", "margin": "expandDistance"}, "HdmapFilter"),
    }


def _present(sections: dict, name: str) -> dict:
    if name not in sections:
        raise ConfigError(-2, f"the section {name} is missing")
    return sections[name]


def read_calibration(spark: SparkSession, path: str, group: str = "lidar") -> Calibration:
    """The calibration in application.<group> of a file of groups."""
    own = parse_groups(_text(spark, path)).get("application", {}).get(group)
    if not isinstance(own, dict):
        raise ConfigError(-2, f"application.{group} is missing")
    keys = {"matrix": "fComBinePara", "yaw_deg": "fLidar2Vehicle_Heading", "offset_x": "fLidar2Vehicle_X", "offset_y": "fLidar2Vehicle_Y", "ground_height": "fGroundHeight", "install_type": "iInstallType"}
    return fill(Calibration, own, keys, f"application.{group}")
