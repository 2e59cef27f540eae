"""Lines of one direction, equal ones met once, against plain loops."""

import math

import numpy as np
from pyspark.sql import functions as F

from gridwake.operators import curbs, lines


def _lines(spark, rows):
    """Described lines of rows (frame_id, line_id, (x0, y0, x1, y1))."""
    flat = [(f, k, *map(float, xy)) for f, k, xy in rows]
    return lines.describe(spark.createDataFrame(flat, "frame_id long, line_id long, x0 double, y0 double, x1 double, y1 double"))


def _random(n=60, copies=4, seed=3):
    xy = np.random.default_rng(seed).integers(0, 150, (n, 4))
    return [(k % 2, c * n + k, tuple(xy[k])) for k in range(n) for c in range(copies)]


def _pairs(df, a, b):
    got = [(r[a], r[b]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equal_lines_meet_once(spark):
    """Two lines, each a thousand times: five rows of classes at most and not a row for each of the million pairs that are tested."""
    d = _lines(spark, [(0, k, (0, k % 2, 100, 100)) for k in range(2000)])
    met = lines.of_one_direction(d, 6.0, "line_id", ("ax",), ("ax", "ay"), wrap=False)
    assert met.count() == 4 and met.select(F.sum(F.size("p") * F.size("q"))).first()[0] == 2000 * 2000
    assert curbs.merge_lines(d, 6.0, 4.0, 8.0).count() == 2000 * 2000
    assert lines.collinear(d, 6.0, 12.0).count() == 2000 * 1999 // 2


def test_collinear_at_any_angle(spark):
    """Also beyond ten degrees, and across 180."""
    d = _lines(spark, _random())
    rows = [r.asDict() for r in d.collect() if r.length > 63]
    for angle in (6.0, 25.0, 70.0, 100.0):
        want = set()
        for p in rows:
            for q in rows:
                apart = abs(p["angle"] - q["angle"]) % 180
                mean = sum(abs(p["a"] * q[f"{e}x"] + p["b"] * q[f"{e}y"] + p["c"]) for e in "ab") / 2
                if p["frame_id"] == q["frame_id"] and p["line_id"] < q["line_id"] and min(apart, 180 - apart) < angle and mean < 30:
                    want.add((p["line_id"], q["line_id"]))
        assert _pairs(lines.collinear(d, angle, 30.0), "a", "b") == want


def test_lines_are_merged_with_their_copies(spark):
    d = _lines(spark, _random())
    rows = [r.asDict() for r in d.collect() if r.length > 63]
    want = {(p["line_id"], p["line_id"]) for p in rows}
    for p in rows:
        for q in rows:
            xy = np.array([[r[f"{e}x"], r[f"{e}y"]] for r in (p, q) for e in "ab"])
            u, v = (xy - xy.mean(0)).T
            t = 0.5 * math.atan2(2 * (u @ v), u @ u - v @ v)
            if p["frame_id"] == q["frame_id"] and abs(p["angle"] - q["angle"]) < 12 and abs(math.degrees(t) % 180 - p["angle"]) < 8 and np.abs(math.sin(t) * u - math.cos(t) * v).mean() < 8:
                want.add((p["line_id"], q["line_id"]))
    assert _pairs(curbs.merge_lines(d, 12.0, 8.0, 8.0), "cluster_id", "line_id") == want and len(want) > len(rows)


def test_lines_are_chosen_without_their_copies(spark):
    """As the step function chooses from whole clusters of all lines, equal ones included; no cluster's lines travel."""
    d = _lines(spark, _random(40, 3)).withColumn("stream_id", F.lit(1)).withColumn("side", F.when(F.col("ax") < 75, "left").otherwise("right"))
    own = ["ax", "ay", "bx", "by", "angle", "range"]
    rows = {r.line_id: r.asDict() for r in d.collect()}
    members = {}
    for r in curbs.merge_lines(d, 12.0, 8.0, 8.0).collect():
        line = rows[r.line_id]
        members.setdefault((line["side"], r.frame_id, r.cluster_id), []).append((r.cluster_id != r.line_id, r.line_id, tuple(line[c] for c in own)))
    want = {}
    for side in ("left", "right"):
        chooser = curbs.ChosenLine()
        for frame in (0, 1):
            found = [[x[2] for x in sorted(members[k])] for k in sorted(members) if k[:2] == (side, frame)]
            want[side, frame] = chooser.step(found)
    one = curbs.one_of_equals(d)
    assert one.count() < d.count()
    for some in (d, one):
        got = {(r.side, r.frame_id): tuple(r[c] for c in own) for r in curbs.choose_lines(some, curbs.merge_lines(some, 12.0, 8.0, 8.0)).collect()}
        assert got == {k: v for k, v in want.items() if v}
