"""Golden values, hand grids, traces and properties of the sensor operators."""

from __future__ import annotations

import math
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.config import GridConfig, TrackConfig
from gridwake.functions import geometry as geo
from gridwake.operators import clusters, decode, framing, grid, lines, mapjoin, poses, tracking, transform
from gridwake.sources import fixtures, packets
from gridwake.streaming import stateful

SMALL = GridConfig(x_min=0, x_max=600, y_min=0, y_max=600, resolution=100, min_cluster_cells=1)


def _cells(spark, rows, cfg=SMALL):
    """Cells (row, col, min_z, max_z) of frame 1."""
    return spark.createDataFrame([(1, r, c, lo, hi, lo, 1) for r, c, lo, hi in rows], "frame_id long, row int, col int, min_z long, max_z long, sum_z long, point_num long")


@pytest.mark.parametrize(("heading", "vehicle", "there"), [(0, (1, 0), (0, 1)), (90, (1, 0), (1, 0)), (180, (1, 0), (0, -1)), (-90, (1, 0), (-1, 0)), (0, (0, 1), (-1, 0))])
def test_golden_directions(spark, heading, vehicle, there):
    x, y = geo.vehicle_to_map(F.lit(float(vehicle[0])), F.lit(float(vehicle[1])), F.lit(0.0), F.lit(0.0), F.lit(float(heading)))
    got = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(got.x - there[0]) < 1e-6 and abs(got.y - there[1]) < 1e-6


def test_vehicle_map_round_trip(spark):
    rows = [(float(h), x, y) for h in (0, 45, 90, 135, 180, -90, -45, 273) for x in (-2.0, 0.0, 1.5, 8.0) for y in (-3.0, -0.5, 0.0, 2.7)]
    df = spark.createDataFrame(rows, "h double, x double, y double")
    mx, my = geo.vehicle_to_map(F.col("x"), F.col("y"), F.lit(100.0), F.lit(-50.0), F.col("h"))
    df = df.withColumn("mx", mx).withColumn("my", my)
    bx, by = geo.map_to_vehicle(F.col("mx"), F.col("my"), F.lit(100.0), F.lit(-50.0), F.col("h"))
    assert df.select(F.max(F.hypot(bx - F.col("x"), by - F.col("y")))).first()[0] < 1e-3


def test_geodesy(spark):
    lon0, lat0 = 11.0, 47.0
    df = spark.createDataFrame([(lon0, lat0), (lon0, lat0 + 1e-4), (lon0 + 1e-4, lat0), (lon0 + 0.01, lat0 - 0.02)], "lon double, lat double")
    e, n = geo.lonlat_to_enu(F.col("lon"), F.col("lat"), lon0, lat0)
    df = df.withColumn("e", e).withColumn("n", n)
    lon, lat = geo.enu_to_lonlat(F.col("e"), F.col("n"), lon0, lat0)
    got = df.select("e", "n", (lon - F.col("lon")).alias("dlon"), (lat - F.col("lat")).alias("dlat")).collect()
    assert abs(got[0].e) < 1e-6 and abs(got[0].n) < 1e-6 and 10 < got[1].n < 12 and abs(got[1].e) < 0.5 and 7 < got[2].e < 8
    assert all(abs(r.dlon) < 1e-9 and abs(r.dlat) < 1e-9 for r in got)


def test_polygons(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))))
    df = spark.createDataFrame([(2.0, 2.0), (5.0, 2.0), (4.4, 2.0)], "x double, y double").withColumn("ring", ring)
    got = df.select(geo.in_polygon(F.col("ring"), F.col("x"), F.col("y")).alias("i"), geo.polygon_distance(F.col("ring"), F.col("x"), F.col("y")).alias("d"), geo.drivable(F.col("ring"), F.col("x"), F.col("y")).alias("o"), geo.in_polygon(F.slice("ring", 1, 2), F.col("x"), F.col("y")).alias("two")).collect()
    assert [r.i for r in got] == [True, False, False] and [round(r.d, 6) for r in got] == [2, 1, 0.4] and [r.o for r in got] == [True, False, True]
    assert not any(r.two for r in got)


def test_points_on_the_bounds_and_without_numbers(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (1, 600.0, 0.0, 1.0), (1, 599.9, 599.9, 2.0), (1, -0.1, 5.0, 1.0), (1, nan, 1.0, 1.0), (1, 1.0, inf, 1.0), (1, 1.0, 1.0, None)], "frame_id long, x double, y double, z double")
    assert sorted((r.row, r.col) for r in grid.to_cells(grid.finite(df), SMALL).collect()) == [(0, 0), (5, 5)]
    assert grid.build(df.where("false"), SMALL).count() == 0 and grid.detect(df.where("false"), SMALL).count() == 0


def test_slope_by_hand(spark):
    got = {(r.row, r.col): r.slope for r in grid.slope(_cells(spark, [(0, 0, 0, 0), (0, 1, 50, 50), (1, 1, 90, 90), (4, 4, 7, 7)]), SMALL).collect()}
    assert got[0, 0] == pytest.approx(90 / (100 * math.sqrt(2))) and got[0, 1] == pytest.approx(0.5) and got[4, 4] == 0


def test_region_growing_both_ways(spark, sf):
    cells = grid.slope(grid.build(fixtures.points(spark, sf), GridConfig(resolution=500)), GridConfig(resolution=500))
    cfg = GridConfig(resolution=500)
    one = {tuple(r) for r in grid.grow_ground(cells, cfg).where("is_ground").select(*grid.KEY).collect()}
    two = {tuple(r) for r in grid.grow_ground_rounds(cells, cfg).where("is_ground").select(*grid.KEY).collect()}
    start = {tuple(r) for r in grid.seeds(cells, cfg).select(*grid.KEY).collect()}
    assert one == two and start <= one


def test_a_gap_stops_growth(spark):
    rows = [(0, c, 0, 0) for c in range(6) if c != 4]
    got = {r.col for r in grid.grow_ground(grid.slope(_cells(spark, rows), SMALL), SMALL).where("is_ground").collect()}
    assert got == {0, 1, 2, 3}


def test_reference_fills_columns(spark):
    rows = [(0, 1, 10, 0, True), (1, 1, 30, 0, True), (0, 4, 50, 0, True), (0, 5, 999, 0, False)]
    df = spark.createDataFrame([(1, *r) for r in rows] + [(2, 0, 0, 5, 5, False)], "frame_id long, row int, col int, min_z long, max_z long, is_ground boolean")
    got = {(r.frame_id, r.col): r.ground_reference_z for r in grid.column_reference(df, SMALL).collect()}
    flat = [20, 20, 30, 40, 50, 50]
    assert [got[1, c] for c in range(6)] == pytest.approx([20, *(sum(flat[c - 1 : c + 2]) / 3 for c in range(1, 5)), 50])
    assert all(got[2, c] == SMALL.fallback_ground for c in range(6))


def test_candidates_and_veto(spark):
    def run(tall):
        rows = [(2, 2, 80, 200, True, 2)] + [(1, 1 + k, 0, 900, True, 9) for k in range(tall)]
        df = spark.createDataFrame([(1, r, c, float(t), float(h), float(h), g, n) for r, c, t, h, g, n in rows], "frame_id long, row int, col int, top_height double, height_range double, max_z double, is_ground boolean, occupied_layers int")
        df = df.withColumn("top_height", F.when(F.col("height_range") == 900, 900.0).otherwise(F.col("top_height")))
        return {(r.row, r.col): (r.is_obstacle_candidate, r.is_vertical_structure) for r in grid.candidates(df, SMALL).collect()}

    assert run(1)[2, 2] == (True, False) and run(2)[2, 2] == (False, False)


def test_components_touch_by_corners(spark):
    rows = [(0, 0), (1, 1), (3, 3), (5, 0), (5, 1)]
    df = spark.createDataFrame([(1, r, c, True, 1, 0, 0) for r, c in rows], "frame_id long, row int, col int, is_obstacle_candidate boolean, point_num long, min_z long, max_z long")
    for connect in (clusters.connect, clusters.connect_rounds):
        got = {(r.row, r.col): r.cluster_id for r in connect(df, SMALL).collect()}
        assert got == {(0, 0): 0, (1, 1): 0, (3, 3): 1, (5, 0): 2, (5, 1): 2}
        assert {r.cluster_id for r in connect(df, GridConfig(x_min=0, x_max=600, y_min=0, y_max=600, resolution=100, min_cluster_cells=2)).collect()} == {0, 2}


def test_oriented_boxes(spark):
    shapes = {0: [(0, 0), (0, 1), (0, 2)], 1: [(0, 0), (1, 1), (2, 2)], 2: [(0, 0), (0, 1), (1, 0), (1, 1)], 3: [(0, 0), (1, 0)]}
    df = spark.createDataFrame([(1, k, r, c) for k, cells in shapes.items() for r, c in cells], "frame_id long, cluster_id int, row int, col int")
    got = {r.cluster_id: r for r in clusters.oriented_boxes(df, SMALL).collect()}
    assert 3 not in got and (got[0].length, got[0].width, got[0].angle) == pytest.approx((200, 0, 0))
    assert (got[1].length, got[1].angle) == pytest.approx((200 * math.sqrt(2), math.pi / 4)) and got[2].angle == 0
    assert len(got[1].corners) == 4


def test_grid_does_not_depend_on_row_order(spark, sf):
    p = fixtures.points(spark, sf)
    key = lambda df: sorted(map(str, df.select(*grid.KEY, "top_height", "is_ground", "is_obstacle_candidate").collect()))
    assert key(grid.detect(p, GridConfig(resolution=500))) == key(grid.detect(p.orderBy(F.rand(3)), GridConfig(resolution=500)))


# --- tracks -------------------------------------------------------------------------------------------------------


def test_track_birth_match_and_gate():
    t = tracking.Tracker()
    t.step(0, [(0.0, 0.0)])
    assert [(x.track_id, x.age) for x in t.tracks] == [(9999, 0)]
    t.step(1000, [(0.499, 0.0)])
    assert [(x.track_id, x.age, x.vx) for x in t.tracks] == [(9999, 1, 0.499)]
    t = tracking.Tracker()
    t.step(0, [(0.0, 0.0)])
    t.step(1000, [(0.5, 0.0)])
    assert [(x.track_id, x.last_seen) for x in t.tracks] == [(9999, 1), (10000, 0)]


def test_tracks_move_only_in_empty_frames():
    t = tracking.Tracker()
    for ts, found in ((0, [(0.0, 0.0)]), (1000, [(0.3, 0.0)]), (2000, [])):
        t.step(ts, found)
    assert t.tracks[0].x == pytest.approx(0.6)
    t.step(3000, [(50.0, 0.0)])
    assert t.tracks[0].x == pytest.approx(0.6) and t.tracks[0].last_seen == 2


def test_tracks_die_and_ids_wrap():
    t = tracking.Tracker()
    t.step(0, [(0.0, 0.0)])
    for k in range(1, 11):
        t.step(k, [])
    assert len(t.tracks) == 1
    t.step(11, [])
    assert not t.tracks
    t = tracking.Tracker(TrackConfig(first_id=1, wrap_above=3), next_id=4)
    t.step(0, [(0.0, 0.0)])
    assert t.next_id == 1


def test_same_time_gives_no_velocity():
    t = tracking.Tracker()
    t.step(5, [(0.0, 0.0)])
    t.step(5, [(0.1, 0.0)])
    assert t.tracks[0].vx == 0.0


def test_greedy_is_not_optimal():
    found = [(0.0, 0.0), (0.4, 0.0)]
    for method, ages in (("greedy", [1, 0, 0]), ("optimal", [1, 1])):
        t = tracking.Tracker(method=method)
        t.step(0, found)
        t.step(1000, [(0.25, 0.0), (-0.45, 0.0)])
        assert [x.age for x in t.tracks] == ages
        # Greedy gives the first track what is nearest to it; then nothing is left for the second.
        assert [x.x for x in t.tracks] == ([0.25, 0.4, -0.45] if method == "greedy" else [-0.45, 0.25])


def test_assignment_is_cheapest():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 6):
        for _ in range(20):
            c = rng.integers(0, 20, (n, n)).astype(float)
            got = tracking.assignment(c)
            assert sorted(got) == list(range(n)) and c[np.arange(n), got].sum() == min(sum(c[k, p[k]] for k in range(n)) for p in permutations(range(n)))


def test_velocity_filter_step_by_step():
    """Worked by hand: variances 1 and 10, noises 0.01 and 0.1, measurements 0.5; the velocity takes the residual left."""
    f = tracking.VelocityFilter(0.0)
    p, v = f.step(1.0, 1.0)
    gain = 1.01 / 1.51
    assert p == pytest.approx(gain) and v == pytest.approx(gain * (1 - gain) / 1.01) and f.pp == pytest.approx((1 - gain) * 1.01) and f.pv == pytest.approx(10.1)
    p2, _ = f.step(p + v, 1.0)
    assert p2 == pytest.approx(p + v)


def test_smoothing_starts_anew_for_each_track(spark):
    rows = [(1, 1, 1000 * k, float(k), 0.0) for k in range(5)] + [(1, 2, 1000 * k, 9.0, -1.0) for k in range(5)] + [(1, 2, 9000, None, 0.0)]
    got = tracking.smooth(spark.createDataFrame(rows, "stream_id long, track_id long, ts_ms long, x double, y double")).orderBy("track_id", "ts_ms").collect()
    f = tracking.VelocityFilter(0.0)
    want = [0.0] + [f.step(float(k), 1.0)[0] for k in range(1, 5)]
    assert [r.fx for r in got[:5]] == pytest.approx(want) and [r.fx for r in got[5:]] == [9.0] * 5 and [r.fy for r in got[5:]] == [-1.0] * 5


def _brute_tracks(frames, method):
    """Tracks by plain loops: (ts, id, x, y, age, missed) after each frame."""
    live, fresh, before, out = [], 9999, None, []

    def cheapest(cost, rows, columns):
        """The cheapest way to give each row a column of the square of rows and columns, those beyond either costing 0.5: by sets of columns taken."""
        n = max(rows, columns)
        price = lambda k, d: 0.5 if k >= rows else (cost[k][d] if cost[k][d] < 0.5 else 1e6)
        states = {(0, n - columns): (0.0, ())}  # columns taken, columns beyond that are left
        for k in range(n):
            after = {}
            for (taken, spare), (total, way) in states.items():
                steps = [((taken | 1 << d, spare), total + price(k, d), (*way, d)) for d in range(columns) if not taken >> d & 1]
                steps += [((taken, spare - 1), total + 0.5, (*way, None))] if spare else []
                for state, c, w in steps:
                    if state not in after or c < after[state][0]:
                        after[state] = (c, w)
            states = after
        return min(states.values())[1]
    for ts, found in frames:
        dt = 0.0 if before is None else (ts - before) / 1000.0
        before = ts
        cost = [[math.hypot(t["x"] + t["vx"] * dt - x, t["y"] + t["vy"] * dt - y) for x, y in found] for t in live]
        match = {}
        if method == "greedy":
            for k in range(len(live)):
                free = [d for d in range(len(found)) if d not in match.values() and cost[k][d] < 0.5]
                if free:
                    match[k] = min(free, key=lambda d: cost[k][d])
        else:
            match = {k: d for k, d in enumerate(cheapest(cost, len(live), len(found))) if k < len(live) and d is not None and cost[k][d] < 0.5}
        for k, t in enumerate(live):
            if k in match:
                x, y = found[match[k]]
                t["vx"], t["vy"] = ((x - t["x"]) / dt, (y - t["y"]) / dt) if dt else (0.0, 0.0)
                t.update(x=x, y=y, age=t["age"] + 1, missed=0)
            else:
                t["missed"] += 1
                if not found or method == "optimal":
                    t["x"], t["y"] = t["x"] + t["vx"] * dt, t["y"] + t["vy"] * dt
        for d, (x, y) in enumerate(found):
            if d not in match.values():
                live.append(dict(id=fresh, x=x, y=y, vx=0.0, vy=0.0, age=0, missed=0))
                fresh += 1
        live = [t for t in live if t["missed"] <= 10]
        out += [(ts, t["id"], round(t["x"], 9), round(t["y"], 9), t["age"], t["missed"]) for t in live]
    return out


@pytest.mark.parametrize("method", ["greedy", "optimal"])
def test_trackers_against_plain_loops(spark, method):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for stream in range(4):
        spots, frames = rng.uniform(0, 3, (4, 2)), []
        for k in range(25):
            spots = spots + rng.uniform(-0.3, 0.3, spots.shape)
            found = [(float(x), float(y)) for x, y in spots[rng.random(4) < 0.8]] if k % 9 else []
            frames.append((1000 * k, found))
            rows.append((stream, 1000 * k, [{"x": x, "y": y} for x, y in found]))
        want += [(stream, *r) for r in _brute_tracks(frames, method)]
    got = tracking.track(spark.createDataFrame(rows, "stream_id long, ts_ms long, detections array<struct<x:double,y:double>>"), method).collect()
    assert sorted((r.stream_id, r.ts_ms, r.track_id, round(r.x, 9), round(r.y, 9), r.age, r.last_seen) for r in got) == sorted(want)


def test_tracks_carry_boxes(spark):
    box = lambda x: [{"x": x + dx, "y": dy} for dx, dy in ((0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0))]
    rows = [(1, 1000 * k, 0, 0.1 * k, 0.0, box(0.1 * k), 2.0, 1.0, 0.5) for k in range(5)]
    found = spark.createDataFrame(rows, "stream_id long, ts_ms long, cluster_id long, x double, y double, corners array<struct<x:double,y:double>>, depth double, width double, height double")
    frames = tracking.frames_of(found).unionByName(spark.createDataFrame([(1, 5000, [])], tracking.frames_of(found).schema))
    got = tracking.track(frames).orderBy("ts_ms").collect()
    assert (got[-2].depth, got[-2].width, got[-2].height) == (2.0, 1.0, 0.5)
    assert got[-1].corners[0].x == pytest.approx(0.5) and got[-1].x == pytest.approx(0.5)  # without a detection box and track move on
    old = tracking.confirmed(tracking.track(frames)).orderBy("ts_ms").first()
    assert old.age == 3 and (old.min_x, old.max_x, old.size_x, old.size_y) == pytest.approx((0.3, 2.3, 2.0, 1.0))


def test_tracks_are_alike_in_a_stream(spark, sf, tmp_path):
    p = fixtures.poses(spark, sf).select("stream_id", "ts_ms", F.col("event_id").alias("cluster_id"), (F.col("x") / 100).alias("x"), (F.col("y") / 50).alias("y"))
    frames = tracking.frames_of(p.where("stream_id < 3"))
    path = str(tmp_path / "frames")
    frames.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(frames.schema).parquet(path)
    q = stateful.track(stream).writeStream.format("memory").queryName("tracked").outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    key = lambda df: sorted((r.stream_id, r.ts_ms, r.track_id, round(r.x, 6), round(r.y, 6), r.age, r.last_seen) for r in df.collect())
    assert key(spark.table("tracked")) == key(tracking.track(frames))


def test_frames_are_alike_in_a_stream(spark, sf, tmp_path):
    rows = fixtures.packet_sequence(spark, sf).where("stream_id < 20")
    path = str(tmp_path / "packets")
    rows.coalesce(1).write.parquet(path)
    q = stateful.split_by_sequence(spark.readStream.schema(rows.schema).parquet(path)).writeStream.format("memory").queryName("framed").outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    key = lambda df: sorted((r.stream_id, r.arrival, r.frame) for r in df.collect())
    assert key(spark.table("framed")) == key(framing.by_sequence(rows))


def test_angles_are_alike_in_a_stream(spark, sf, tmp_path):
    rows = fixtures.blocks(spark, sf).select("stream_id", "seq", F.col("azimuth").cast("int").alias("azimuth")).where("stream_id < 20")
    path = str(tmp_path / "blocks")
    rows.coalesce(1).write.parquet(path)
    q = stateful.split_by_angle(spark.readStream.schema(rows.schema).parquet(path), 9000).writeStream.format("memory").queryName("turned").outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    key = lambda df: sorted((r.stream_id, r.seq, r.frame) for r in df.collect())
    assert key(spark.table("turned")) == key(framing.by_angle(rows, 9000))


def test_sequence_splitter():
    s = framing.SequenceSplitter()
    begins = [s.take(q)[0] for q in (1, 2, 4, 3, 5, 15, 14, 40, 16, 1, 2, 1)]
    assert begins == [False] * 9 + [True, False, False]
    assert s.previous == 2 and s.largest == 40


# --- packets and points -------------------------------------------------------------------------------------------


def _frame(port: int, payload: bytes, vlan: bool = False, ident: int = 1, off: int = 0, more: bool = False, raw: bytes | None = None) -> bytes:
    udp = raw if raw is not None else struct.pack(">HHHH", 1000, port, 8 + len(payload), 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), ident, (0x2000 if more else 0) | off // 8, 64, 17, 0, b"\x0a\0\0\1", b"\x0a\0\0\2")
    return b"\0" * 12 + (b"\x81\x00\0\5" if vlan else b"") + b"\x08\x00" + ip + udp


def _capture(path, frames):
    body = b"".join(struct.pack("<IIII", 10 + k, 500_000, len(f), len(f)) + f for k, f in enumerate(frames))
    path.write_bytes(b"\xd4\xc3\xb2\xa1" + struct.pack("<HHIIII", 2, 4, 0, 0, 65535, 1) + body + b"\1\2\3")


def test_captures(spark, tmp_path):
    _capture(tmp_path / "a.pcap", [_frame(6699, b"\x55\xaahello"), _frame(7788, b"\xa5\xffx", vlan=True), b"\0" * 30, _frame(1, b"z")])
    rows = packets.read_pcap(spark, str(tmp_path / "a.pcap"))
    got = packets.udp(rows, [6699, 7788]).orderBy("number").collect()
    assert rows.count() == 4 and [(r.ts_us, r.port, bytes(r.payload)) for r in got] == [(10_500_000, 6699, b"\x55\xaahello"), (11_500_000, 7788, b"\xa5\xffx")]
    assert [r.kind for r in decode.route(packets.udp(rows)).orderBy("number").collect()] == ["msop", "difop", None]


def test_fragments(spark, tmp_path):
    body = bytes(range(48))
    parts = [_frame(0, b"", ident=7, off=24, raw=body[24:]), _frame(0, b"", ident=7, off=0, more=True, raw=body[:24]), _frame(0, b"", ident=8, off=8, raw=body[8:])]
    order = [parts[1], parts[0], parts[2]]
    _capture(tmp_path / "o.pcap", order)
    got = packets.reassemble(packets.read_pcap(spark, str(tmp_path / "o.pcap"))).collect()
    assert [(r.ip_id, bytes(r.datagram)) for r in got] == [(7, body)]
    _capture(tmp_path / "j.pcap", parts)
    got = packets.reassemble(packets.read_pcap(spark, str(tmp_path / "j.pcap"))).collect()
    assert [(r.ip_id, bytes(r.datagram)) for r in got] == []  # the fragment behind came first


def test_datagrams_whose_ids_come_again(spark, tmp_path):
    a, b, c = (bytes([k]) * 48 for k in (1, 2, 3))
    first = lambda body, ident=7: _frame(0, b"", ident=ident, off=0, more=True, raw=body[:24])
    rest = lambda body, ident=7: _frame(0, b"", ident=ident, off=24, raw=body[24:])
    whole = [_frame(5, b"x", ident=5), _frame(5, b"y", ident=5), _frame(5, b"z", ident=6, vlan=True)]
    other = bytearray(_frame(5, b"tcp", ident=5))
    other[23] = 6
    frames = [*whole, bytes(other), first(a), rest(a), first(b), first(c, 8), rest(b), rest(b), rest(c, 8), first(a)]
    _capture(tmp_path / "j.pcap", frames)
    rows = packets.read_pcap(spark, str(tmp_path / "j.pcap"), rows_each=2)
    got = packets.reassemble(rows).orderBy("number").collect()
    assert [(r.number, r.ip_id, bytes(r.datagram)[-1:]) for r in got] == [(0, 5, b"x"), (1, 5, b"y"), (2, 6, b"z"), (4, 7, b"\1"), (6, 7, b"\2"), (7, 8, b"\3")]
    assert [bytes(r.datagram) for r in got[3:]] == [a, b, c]


def test_packets_by_format(spark, tmp_path):
    body = struct.pack(">HHHH", 1, 6699, 48, 0) + bytes(range(40))
    _capture(tmp_path / "p.pcap", [_frame(6699, b"one"), _frame(0, b"", ident=9, off=0, more=True, raw=body[:24]), _frame(0, b"", ident=9, off=24, raw=body[24:]), _frame(7, b"no")])
    path = str(tmp_path / "p.pcap")
    got = lambda *a: [(r.port, bytes(r.payload)) for r in packets.read_packets(spark, *a, ports=[6699]).orderBy("number").collect()]
    assert got(path, "jumbo") == [(6699, b"one"), (6699, bytes(range(40)))]
    assert (6699, b"one") in got(path, "pcap")
    packets.read_pcap(spark, path).write.parquet(str(tmp_path / "raw"))
    assert (6699, b"one") in got(str(tmp_path / "raw"), "raw")
    with pytest.raises(ValueError):
        packets.read_packets(spark, path, "tape")


def test_pose_feed(spark):
    good = struct.pack("<BBH4s", 10, 0, 120, b"") + struct.pack("<Qiii", 1_700_000_000_123, 1500, -2500, 9010).ljust(120, b"\0")
    rows = [("f", 0, bytearray(good)), ("f", 1, bytearray(b"\x0b" + good[1:])), ("f", 2, bytearray(good[:100])), ("f", 3, bytearray(good[:2] + b"\x05\0" + good[4:]))]
    got = packets.pose_feed(spark.createDataFrame(rows, "file string, number long, payload binary")).collect()
    assert [(r.number, r.ts_ms, r.x, r.y, r.heading_deg) for r in got] == [(0, 1_700_000_000_123, 1.5, -2.5, 90.1)]


def test_road_maps(spark, tmp_path):
    from gridwake.sources import roadmap

    i, f = (lambda *v: struct.pack(f"<{len(v)}i", *v)), (lambda *v: struct.pack(f"<{len(v)}f", *v))
    ids = lambda *v: i(len(v), *v)
    body = b"v1.0\0\0" + struct.pack("<dd", 114.5, 22.25)
    body += i(1) + i(3) + f(1, 2) + i(3) + f(0, 0, 1, 0, 1, 1) + i(1) + f(0.5) + f(*range(8))
    body += i(2) + b"".join(i(n, 2) + f(0, 0, 0, 90, 0, 5, 0, 5, 90, 0) + f(5, 3.5) + i(1, 2, 3, 40, 0, 0, 0, 0) + ids(*back) + ids(*on) for n, back, on in ((1, [], [2]), (2, [1], [])))
    body += i(1) + i(1) + f(0, 0, 1, 1) + i(0) + i(1) + i(4) + f(1, 2, 3) + i(1) + i(1, 2) + i(0) + i(1) + i(6) + f(1, 2, 3) + ids(7, 8)
    section = lambda n, lane, back, on: i(n) + ids(lane) + i(2) + f(0, 0, 5, 0) + f(0, 4, 5, 4) + i(*range(9)) + ids(6) + ids(*back) + ids(*on)
    body += i(2) + section(11, 1, [], [12]) + section(12, 2, [11], [])
    body += i(1) + i(21, 0) + ids(11, 12) + ids() + ids() + i(31)
    body += i(1) + i(31) + i(3) + f(0, 0, 1, 0, 1, 1) + ids(21) + ids() + ids(21)
    (tmp_path / "m.bin").write_bytes(body)
    t = roadmap.read_map(spark, str(tmp_path / "m.bin"))
    head = t["head"].first()
    assert (head.version, head.lon, head.lat) == ("v1.0", 114.5, 22.25)
    assert {k: df.count() for k, df in t.items()} == {"head": 1, "stations": 1, "lanes": 2, "stop_lines": 1, "crosswalks": 0, "signals": 1, "clear_areas": 0, "traffic_signs": 1, "sections": 2, "roads": 1, "junctions": 1}
    assert t["stations"].first().spaces[0].corners[3].y == 7 and t["lanes"].orderBy("id").first().centre[1].x == 5 and list(t["traffic_signs"].first().types) == [7, 8]
    m = roadmap.map_tables(t)
    assert [tuple(r) for r in m["edges"].collect()] == [(11, 12)] and {r.road_id for r in m["sections"].collect()} == {21}
    near = mapjoin.lanes_near(spark.createDataFrame([(1, 1.0, 1.0)], "pose_id long, x double, y double"), m["lane_points"])
    current = mapjoin.current_section(near, m["sections"])
    assert current.first().section_id == 11 and sorted(r.section_id for r in mapjoin.drivable_sections(current, m["edges"]).collect()) == [11, 12]
    assert [tuple(r) for r in mapjoin.road_junctions(m["roads"], m["junctions"]).collect()] == [(21, 31)]
    (tmp_path / "short.bin").write_bytes(body[:-2])
    with pytest.raises(Exception, match="ends within a record"):
        roadmap.read_map(spark, str(tmp_path / "short.bin"))["roads"].count()


def test_settings(spark, tmp_path):
    from gridwake.sources import settings

    text = """%YAML:1.0
---
Lidar:
  type: "spin16"   # a comment
  msopPort: 6699
  difopPort: 7788
MapGroundFilter:
  roi_x_min: 0.5
  grid_resolution: 0.2
Localization:
  timeout_ms: 500
"""
    path = tmp_path / "c.yaml"
    path.write_text(text)
    got = settings.read_settings(spark, str(path))
    assert got["sensor"].msop_port == 6699 and got["sensor"].rings == 16 and got["grid"].resolution == 0.2 and got["poses"].timeout_ms == 500 and got["map"] == settings.MapConfig()
    for wrong, code in (("type", -3), ("Lidar:", -2), ("MapGroundFilter:", -2)):
        path.write_text(text.replace(wrong, "other" + wrong))
        with pytest.raises(settings.ConfigError) as e:
            settings.read_settings(spark, str(path))
        assert e.value.code == code, wrong
    for old, new in (("6699", "66990"), ("6699", "x"), ('"spin16"', '""')):
        path.write_text(text.replace(old, new))
        with pytest.raises(settings.ConfigError) as e:
            settings.read_settings(spark, str(path))
        assert e.value.code == -3
    with pytest.raises(settings.ConfigError) as e:
        settings.read_settings(spark, str(tmp_path / "none.yaml"))
    assert e.value.code == -1


def test_calibration_files(spark, tmp_path):
    from gridwake.sources import settings

    path = tmp_path / "c.cfg"
    path.write_text("application : { // top\n lidar : { fComBinePara = [1.0, 0, 0, 0.5, 0, 1, 0, 0, 0, 0, 1, 2]; fLidar2Vehicle_Heading = 90.0; iInstallType = -3L; name = \"a;b\"; };\n other = 0x10; };")
    got = settings.read_calibration(spark, str(path))
    assert got.rows[2] == [0, 0, 1, 2] and (got.yaw_deg, got.install_type, got.offset_x) == (90.0, -3, 0.0)
    with pytest.raises(settings.ConfigError) as e:
        settings.read_calibration(spark, str(path), "radar")
    assert e.value.code == -2
    path.write_text("application : { lidar : { fComBinePara = [1.0]; }; };")
    with pytest.raises(settings.ConfigError) as e:
        settings.read_calibration(spark, str(path))
    assert e.value.code == -3


def test_clouds_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, 2.0, -3.25, 7.0), (1, 0.0, 0.0, 0.0, None), (2, 9.0, 8.0, 7.0, 6.0)], "frame_id long, x double, y double, z double, intensity double")
    packets.write_pcd(df, str(tmp_path / "pcd"))
    got = packets.read_pcd(spark, str(tmp_path / "pcd/*/part-*"))
    assert sorted((r.x, r.y, r.z) for r in got.collect()) == sorted((r.x, r.y, r.z) for r in df.collect())
    many = spark.createDataFrame([(1, k, float(k * 37 % 101), 0.0, 0.0, 1.0) for k in range(60)], "frame_id long, n long, x double, y double, z double, intensity double")
    packets.write_pcd(many.orderBy("x"), str(tmp_path / "kept"), order="n")
    assert [r.x for r in packets.read_pcd(spark, str(tmp_path / "kept/*/part-*")).collect()] == [float(k * 37 % 101) for k in range(60)]
    head = b"FIELDS x y z intensity\nSIZE 4 4 4 1\nTYPE F F F U\nCOUNT 1 1 1 1\nPOINTS 2\nDATA binary\n"
    (tmp_path / "b.pcd").write_bytes(head + struct.pack("<fffB", 1, 2, 3, 200) + struct.pack("<fffB", 4, 5, 6, 1))
    assert [tuple(r)[1:] for r in packets.read_pcd(spark, str(tmp_path / "b.pcd")).orderBy("x").collect()] == [(1.0, 2.0, 3.0, 200.0), (4.0, 5.0, 6.0, 1.0)]


def test_fixed_records_and_angles(spark, tmp_path):
    (tmp_path / "r.bin").write_bytes(b"aabbccd")
    assert [bytes(r.record) for r in packets.fixed_records(spark, str(tmp_path / "r.bin"), 2).orderBy("number").collect()] == [b"aa", b"bb", b"cc"]
    (tmp_path / "a.csv").write_text("1.25,0.5\n-3\n")
    assert [(r.channel, r.vert, r.horiz) for r in packets.read_angles(spark, str(tmp_path / "a.csv")).orderBy("channel").collect()] == [(0, 125, 50), (1, -300, 0)]


def test_decode_a_polar_packet(spark):
    spec = decode.PacketSpec("toy", 2 + 2 * (4 + 2 * 3), 2, 2, 2, 0.1, 100, 0.005, header=2)
    payload = b"\x55\xaa" + b"".join(b"\xff\xee" + struct.pack(">H", az) + struct.pack(">HBHB", d, i, 0, 0) for az, d, i in ((0, 2000, 9), (100, 4000, 8)))
    df = spark.createDataFrame([("s", 1, bytearray(payload))], "stream_id string, seq long, payload binary")
    got = {(r.blk, r.channel): r for r in decode.decode(df, spec, nominal=100).collect()}
    assert (got[0, 0].x, got[0, 0].y, got[0, 0].z, got[0, 0].intensity) == pytest.approx((10, 0, 0, 9))
    assert got[1, 0].x == pytest.approx(20 * math.cos(math.radians(1))) and got[1, 0].y == pytest.approx(-20 * math.sin(math.radians(1)))
    assert got[0, 1].x is None and decode.decode(df, spec, dense=True).count() == 2


def test_crc_and_calendar(spark):
    import zlib

    body, rest = b"\x55\xaa" + b"data", b"\x01\x02"
    good = body + struct.pack(">I", zlib.crc32(body + rest)) + rest
    bad = body + struct.pack(">I", 5) + rest
    df = spark.createDataFrame([(bytearray(good),), (bytearray(bad),)], "payload binary")
    assert [r[0] for r in df.select(decode.crc32_holds(F.col("payload"))).collect()] == [True, False]
    when = bytes([24, 2, 29, 12, 30, 15]) + struct.pack(">HH", 250, 500)
    got = spark.createDataFrame([(bytearray(when),)], "payload binary").select(decode.calendar_seconds(F.col("payload"), 0)).first()[0]
    assert got == pytest.approx(1709209815.2505, abs=1e-4)


def test_models_and_device_values(spark):
    assert len(decode.MODELS) == 21 and decode.MODELS["spin16"].blocks * decode.MODELS["spin16"].block_size == 1200
    assert all(m.header + m.blocks * m.block_size <= m.length for m in decode.MODELS.values())
    row = spark.range(1).select(*(c.alias(n) for n, c in decode.difop_common(F.lit(600), 55.56).items())).first()
    assert (row.rps, row.blocks_per_frame, row.az_step, row.blind_us) == (10, 1799, 20, 0)
    raw = struct.pack(">hhhhhh", 16384, -16384, 0, 32767, 0, -32768)
    got = spark.createDataFrame([(bytearray(raw),)], "payload binary").select(*(c.alias(n) for n, c in decode.imu(F.col("payload")).items())).first()
    assert (got.ax, got.ay) == (2.0, -2.0) and got.gz == pytest.approx(-math.radians(500))


def test_waiting_for_calibration(spark):
    df = spark.createDataFrame([("s", 1, bytearray(b"\x55\xaa")), ("s", 2, bytearray(b"\xa5\xff")), ("s", 3, bytearray(b"\x55\xaa"))], "stream_id string, seq long, payload binary")
    got = decode.gate(df, 2, "55AA", wait_for_difop=True).orderBy("seq").collect()
    assert [r.reject_reason for r in got] == ["no_calibration", "wrong_id", None]


# --- map, poses, lines ---------------------------------------------------------------------------------------------


def test_asof_with_and_without_slices(spark):
    left = spark.createDataFrame([(1, t) for t in (5, 10, 15, 7_200_005, 20_000_000)] + [(2, 9)], "stream_id long, ts_ms long")
    right = spark.createDataFrame([(1, 10, 1.0), (1, 12, 2.0), (1, 7_200_000, 3.0), (3, 1, 9.0)], "stream_id long, ts_ms long, x double")
    key = lambda df: sorted((r.stream_id, r.ts_ms, r.pose_x or -1) for r in df.collect())
    want = [(1, 5, -1), (1, 10, 1.0), (1, 15, 2.0), (1, 7_200_005, 3.0), (1, 20_000_000, 3.0), (2, 9, -1)]
    assert key(poses.asof(left, right)) == want and key(poses.asof(left, right, slices_ms=None)) == want
    fresh = poses.freshness(poses.asof(left, right), 0).orderBy("stream_id", "ts_ms").collect()
    assert [r.pose_valid for r in fresh] == [False, True, True, True, False, False]


def test_off_road_and_invalid_poses(spark):
    rows = [(1, True, True), (2, False, True), (3, False, False)]
    df = spark.createDataFrame(rows, "cluster_id long, in_road boolean, map_valid boolean")
    keep = lambda **k: sorted(r.cluster_id for r in mapjoin.keep_on_road(df, **k).collect())
    assert keep() == [1] and keep(off_road="label") == [1, 2] and keep(on_invalid_pose="keep") == [1, 3]


def test_hough_finds_a_line(spark):
    px = [(1, v, 2 * v) for v in range(60)] + [(1, 7, 90), (1, 50, 3)]
    got = lines.hough(spark.createDataFrame(px, "frame_id long, v int, u int"), 20, 20, 5).collect()
    assert got and abs(abs((got[0].y1 - got[0].y0) / (got[0].x1 - got[0].x0)) - 0.5) < 0.05


def test_fits(spark):
    df = spark.createDataFrame([(1, x, 2 * x + 3) for x in range(10)] + [(2, 5, y) for y in range(10)], "g long, x long, y long")
    got = {r.g: r for r in lines.orthogonal_fit(df, ["g"]).collect()}
    assert got[1].k == pytest.approx(2) and got[1].b == pytest.approx(3) and got[2].k is None
    c = lines.polynomial_fit(spark.createDataFrame([(1, float(x), float(1 - 2 * x + x * x)) for x in range(6)], "g long, x double, y double"), ["g"], 2).first().coefficients
    assert c == pytest.approx([1, -2, 1], abs=1e-6)
    # An angle in [0, pi) and a distance without a side.
    theta, d = geo.polar_line(F.lit(0.0), F.lit(-2.0))
    again, _ = geo.normal_polar(F.lit(3 * math.pi / 2), F.lit(-2.0))
    k, b = geo.polar_to_slope(F.lit(math.pi / 4), F.lit(1.0))
    r = spark.range(1).select(theta.alias("t"), d.alias("d"), again.alias("a"), k.alias("k"), b.alias("b")).first()
    assert r.d == 2 and r.t == pytest.approx(math.pi / 2) and r.a == pytest.approx(math.pi / 2) and (r.k, r.b) == pytest.approx((-1, math.sqrt(2)))


def test_planes_and_morphology(spark):
    flat = [(1, float(x * 100), float(y * 100), float((x * y) % 3)) for x in range(12) for y in range(12)] + [(1, 550.0, 550.0, 900.0)]
    df = spark.createDataFrame(flat, "frame_id long, x double, y double, z double")
    plane = lines.plane_ransac(df, 5.0, 100).first()
    assert plane.c > 0.99 and plane.inliers >= 140
    tall = lines.morphological_ground(df, 100.0, initial=50.0, most=300.0).where("NOT is_ground").collect()
    assert [r.z for r in tall] == [900.0]


def test_planes_of_frames_with_repeats_and_without_any(spark):
    rng = np.random.default_rng(1)
    ground = [(1, float(x), float(y), float(0.1 * x + 3.0 + e)) for x, y, e in zip(rng.uniform(0, 900, 300), rng.uniform(0, 900, 300), rng.uniform(-1, 1, 300))]
    zero = [(1, 0.0, 0.0, 0.0)] * 150 + [(1, float("nan"), 0.0, 0.0)]
    line = [(2, float(k), 2.0 * k, 0.0) for k in range(50)]
    few = [(3, 1.0, 1.0, 1.0)] * 40 + [(3, 2.0, 1.0, 1.0)]
    df = spark.createDataFrame(ground + zero + line + few, "frame_id long, x double, y double, z double")
    one, two, three = lines.plane_ransac(df, 2.0).orderBy("frame_id").collect()
    xyz, normal = np.array([g[1:] for g in ground]), np.array([one.a, one.b, one.c])
    assert one.inliers == (np.abs(xyz @ normal + one.d) <= 2.0).sum() + 150 * (abs(one.d) <= 2.0) and one.inliers >= 300
    centred = xyz - xyz.mean(axis=0)
    assert abs(normal @ np.linalg.svd(centred)[2][2]) > 0.99999
    assert [tuple(two), tuple(three)] == [(2, None, None, None, None, 0), (3, None, None, None, None, 0)]


def test_outliers_are_judged_by_the_nearest_at_any_distance(spark):
    line = [(1, k, 1000.0 * k, 0.0, 0.0) for k in range(20)] + [(1, 99, 90_000.0, 0.0, 0.0), (2, 1, 5.0, 5.0, 5.0), (3, 1, 0.0, 0.0, 0.0), (3, 2, 500.0, 0.0, 0.0), (1, 98, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(line, "frame_id long, point_id long, x double, y double, z double")
    for edge in (60.0, 5000.0):
        kept = sorted((r.frame_id, r.point_id) for r in transform.statistical_outliers(df, edge, 2, 1.0).collect())
        assert kept == [(1, k) for k in range(20)] + [(2, 1), (3, 1), (3, 2)]


def test_transforms(spark):
    m = geo.compose([[1, 0, 0, 1], [0, 1, 0, 2], [0, 0, 1, 3]], 90, 10, 20)
    df = transform.rigid(spark.createDataFrame([(1.0, 0.0, 4.0)], "x double, y double, z double"), m).first()
    assert (df.x, df.y, df.z) == pytest.approx((22, 8, -7))
    assert geo.euler(0, 0, math.pi / 2)[:, :3] == pytest.approx(np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]]))


def test_sql_functions(spark):
    geo.register(spark)
    r = spark.sql("SELECT vehicle_to_map_x(1D, 0D, 0D, 0D, 90D) AS x, point_segment_distance(0D, 3D, -1D, 0D, 1D, 0D) AS d, line_angle_deg(0D, 0D, -1D, 0D) AS a").first()
    assert (r.x, r.d, r.a) == pytest.approx((1, 3, 0))


# --- curbs, clusters, scanners -------------------------------------------------------------------------------------


def _segments(spark, rows):
    df = spark.createDataFrame([(f, k, *map(float, xy)) for f, k, xy in rows], "frame_id long, line_id long, x0 double, y0 double, x1 double, y1 double")
    return lines.describe(df)


def test_first_fit_against_a_loop(spark, sf):
    from gridwake.operators import curbs
    from gridwake.plans.motion_queries import _seg

    d = lines.describe(_seg(spark, sf))
    got = {(r.frame_id, r.line_id): r.cluster_id for r in curbs.first_fit(d, "angle", 8.0, least_angle=60.0, middle=40.0).collect()}
    heads, want = {}, {}
    for r in sorted(d.collect(), key=lambda r: (r.frame_id, r.line_id)):
        if r.angle < 60:
            continue
        own = heads.setdefault(r.frame_id, [])
        m = (r.ax + r.bx) / 2
        k = next((k for k, (a, n) in enumerate(own) if abs(a - r.angle) < 8 and abs(n - m) < 40), len(own))
        if k == len(own):
            own.append((r.angle, m))
        want[r.frame_id, r.line_id] = k
    assert got == want and len(want) > 50


def test_lines_are_chosen_along_time(spark):
    from gridwake.operators import curbs

    rows = [(1, 1, (10, 0, 10, 100)), (1, 2, (10, 110, 10, 200)), (1, 3, (200, 0, 200, 150)), (2, 4, (11, 0, 11, 100)), (2, 5, (100, 0, 190, 90)), (3, 6, (100, 5, 190, 95)), (3, 7, (150, 3, 240, 93))]
    d = _segments(spark, rows).withColumn("stream_id", F.lit(1)).withColumn("side", F.lit("left"))
    merged = curbs.merge_lines(d)
    pairs = {(r.cluster_id, r.line_id) for r in merged.where("cluster_id <> line_id").collect()}
    assert pairs == {(1, 2), (2, 1)}
    # The longest cluster first; then its continuation, smoothed if asked for; the third frame has only lines of quite another direction.
    for share, x in ((1.0, 11.0), (0.3, 10.3)):
        got = curbs.choose_lines(d, merged, share).orderBy("frame_id").collect()
        assert [(r.frame_id, round(r.ax, 6), round(r.bx, 6)) for r in got] == [(1, 10.0, 10.0), (2, x, x)]
    ranges = spark.createDataFrame([(1, 4)], "frame_id long, last_range int")
    assert curbs.merge_lines(d, last_range=ranges).where("frame_id = 1").count() == 0


def test_ransac_lines(spark):
    from gridwake.operators import curbs

    rng = np.random.default_rng(3)
    steep = [(1, 2.0 * k + float(e), 5.0 * k) for k, e in zip(range(80), rng.uniform(-0.2, 0.2, 80))] + [(1, float(x), float(y)) for x, y in rng.uniform(0, 400, (20, 2))]
    flat = [(2, float(k), 1.0) for k in range(50)]
    got = curbs.ransac_line(spark.createDataFrame(steep + flat + [(3, 1.0, 1.0)], "frame_id long, x double, y double"), 2.0).collect()
    assert [r.frame_id for r in got] == [1] and abs(got[0].vy / got[0].vx) == pytest.approx(2.5, abs=0.1)
    xy = np.array([p[1:] for p in steep])
    assert got[0].inliers == (np.abs(got[0].vx * (xy[:, 1] - got[0].y0) - got[0].vy * (xy[:, 0] - got[0].x0)) < 2.0).sum() >= 75


def test_edges_find_planted_curbs(spark):
    from gridwake.operators import curbs

    rng = np.random.default_rng(4)
    rows = []
    for frame in (1, 2):
        for x0, k in ((2000.0, 0.02), (-3000.0, -0.05)):
            y = rng.uniform(0, 6000, 3000)
            rows += [(7, frame, float(x0 + k * v), float(v)) for v in y]
    cfg = curbs.EdgeConfig(-4000, 4000, 7000, 7000, 0.05, 350, 250, 40, 40, 15, 40.0, (0.0, 6000.0))
    got = curbs.edges(spark.createDataFrame(rows, "stream_id long, frame_id long, x double, y double"), cfg).orderBy("frame_id", "side").collect()
    assert [(r.frame_id, r.side) for r in got] == [(1, "left"), (1, "right"), (2, "left"), (2, "right")]
    for r in got:
        x0, x1 = (-3000, -3300) if r.side == "left" else (2000, 2120)
        assert abs(r.x0 - x0) < 60 and abs(r.x1 - x1) < 60


def test_edges_of_two_streams_stay_apart(spark):
    """Curbs at other places in frames of one number, and a null stream; alone and together each stream has its own."""
    from gridwake.operators import curbs

    rng = np.random.default_rng(9)
    cfg = curbs.EdgeConfig(-10_000, 10_000, 7000, 7000, 0.05, 350, 550, 40, 40, 15, 40.0, (0.0, 6000.0))
    schema = "stream_id long, frame_id long, x double, y double"
    place = {1: (3000.0, -2000.0), 2: (9000.0, -6000.0), None: (5000.0, -8000.0)}
    rows = [(s, f, x0, float(v)) for s, (right, left) in place.items() for f in (9, 10, 100) for x0 in (right, left) for v in rng.uniform(0, 6000, 1500)]
    df = spark.createDataFrame(rows, schema)
    got = curbs.edges(df, cfg).collect()
    assert sorted((r.stream_id or 0, r.frame_id, r.side) for r in got) == sorted((s or 0, f, side) for s in place for f in (9, 10, 100) for side in ("left", "right"))
    for r in got:
        assert abs(r.x0 - place[r.stream_id][r.side == "left"]) < 30 and abs(r.x1 - place[r.stream_id][r.side == "left"]) < 30
    alone = [tuple(r) for s in (1, 2) for r in curbs.edges(df.where(f"stream_id = {s}"), cfg).collect()]
    assert sorted(alone) == sorted(tuple(r) for r in got if r.stream_id is not None)
    averages = {(r.stream_id, r.side): r for r in curbs.edge_averages(df, 3, cfg).collect()}
    assert len(averages) == 6 and all(r.ts == 100 for r in averages.values())
    for (s, side), r in averages.items():
        own = [g.x0 for g in got if (g.stream_id, g.side) == (s, side)]
        assert r.x0 == pytest.approx(np.mean(own)) and (r.y0, r.y1) == (0.0, 6000.0)
    messages = packets.curb_messages(curbs.edge_averages(df, 1, cfg)).collect()
    assert len(messages) == 9 and all(len(m.lanes) == 2 and m.lanes[0].points[1].y == 6000.0 for m in messages)


def test_a_line_follows_the_one_before():
    """Lines more than two ranges away take no part, a frame without others changes nothing, and ends are not smoothed unless asked for."""
    from gridwake.operators.curbs import ChosenLine

    line = lambda x, angle: (x, 0.0, x, 100.0, angle, int(angle / 10))
    chooser = ChosenLine()
    assert chooser.step([[line(5.0, 90.0)], [(9.0, 0.0, 9.0, 300.0, 90.0, 9)]])[0] == 9.0  # the longest
    assert chooser.step([[line(9.5, 90.5)], [line(1.0, 90.0)]])[0] == 9.5  # the nearest, as it is
    assert chooser.step([[line(9.5, 40.0)]]) is None and chooser.last[0] == 9.5
    assert chooser.step([]) is None
    assert chooser.step([[line(60.0, 75.0), line(9.5, 40.0)]])[0] == 60.0  # none fits, so the first one
    smooth = ChosenLine(0.3)
    smooth.step([[line(10.0, 90.0)]])
    assert smooth.step([[line(11.0, 90.0)]])[0] == pytest.approx(10.3)


def test_fits_far_from_zero(spark):
    """A polynomial of order 5 at x of some thousands, and a line of metres by millimetres."""
    x = np.linspace(5000, 5100, 400)
    t = (x - 5050) / 50
    y = 3 - t + 2 * t**2 + 0.5 * t**3 - t**4 + 0.25 * t**5
    c = lines.polynomial_fit(spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "g long, x double, y double"), ["g"], 5)
    got = lines.sample_curve(c.withColumns({"k": F.lit(0.0), "b": F.lit(0.0)}), 5000.0, 5100.0, 25.0).collect()
    assert all(abs(r.y - np.interp(r.x, x, y)) < 0.05 for r in got)
    metres = spark.createDataFrame([(1, 2.0 + 0.001 * k, 0.5 + 0.002 * k) for k in range(100)], "g long, x double, y double")
    fit = lines.orthogonal_fit(metres, ["g"], 0.001).first()
    assert fit.k == pytest.approx(2.0) and fit.b == pytest.approx(-3.5) and fit.mean_x == pytest.approx(2.0495)


def test_clusters_of_touching_points(spark):
    rows = [(1, k, 3.0 * k, 0.0, 0.0) for k in range(40)] + [(1, 100 + k, 0.0, 50.0 + 10 * k, 0.0) for k in range(5)] + [(2, 1, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double, z double")
    got = {(r.frame_id, r.point_id): r.cluster_id for r in transform.euclidean_clusters(df, 4.0).collect()}
    assert {got[1, k] for k in range(40)} == {0} and [got[1, 100 + k] for k in range(5)] == [100 + k for k in range(5)] and len(got) == 46
    assert {r.point_id for r in transform.euclidean_clusters(df, 4.0, 2).collect()} == set(range(40)) and transform.euclidean_clusters(df, 4.0, 2, 39).count() == 0


def test_radius_outliers_against_brute_force(spark):
    rng = np.random.default_rng(6)
    xyz = rng.uniform(0, 40, (400, 3))
    rows = [(k % 2, k, *map(float, p)) for k, p in enumerate(xyz)]
    got = {r.point_id for r in transform.radius_outliers(spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double, z double"), 6.0, 4).collect()}
    near = (np.linalg.norm(xyz[:, None] - xyz[None], axis=2) <= 6.0) & (np.arange(400)[:, None] % 2 == np.arange(400)[None] % 2)
    assert got == set(np.flatnonzero(near.sum(axis=1) - 1 >= 4).tolist()) and 0 < len(got) < 400


def test_rounds_that_do_not_end_are_an_error(spark):
    df = spark.createDataFrame([(1, k, 3.0 * k, 0.0, 0.0) for k in range(40)], "frame_id long, point_id long, x double, y double, z double")
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        transform.euclidean_clusters(df, 4.0, max_rounds=1)
    cells = spark.createDataFrame([(1, 0, c, 0.0, 1, 0.0, True) for c in range(30)], "frame_id long, row int, col int, min_z double, point_num long, slope double, is_obstacle_candidate boolean")
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        grid.grow_ground_rounds(cells, max_rounds=1)
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        clusters.connect_rounds(cells, max_rounds=1)


def test_nearest_vertex_at_any_distance(spark):
    rng = np.random.default_rng(7)
    p, v = rng.uniform(-50, 50, (60, 2)), np.concatenate([rng.uniform(-50, 50, (15, 2)), [[900.0, 0.0]]])
    points = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(p)] + [(98, 5000.0, 0.0), (99, float("nan"), 0.0)], "k long, x double, y double")
    vertices = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(v)], "vertex_id long, x double, y double")
    from gridwake.operators import layers

    want = {k: int(np.linalg.norm(v - q, axis=1).argmin()) for k, q in enumerate(p)} | {98: 15}
    for cell in (1.0, 300.0):
        got = layers.nearest_vertex(points, vertices, cell, "k").collect()
        assert {r.k: r.vertex_id for r in got} == want and all(r.distance == pytest.approx(np.linalg.norm(v[r.vertex_id] - p[r.k])) for r in got if r.k < 60)
    assert layers.nearest_vertex(points, vertices.where("false"), 1.0, "k").count() == 0


def test_frames_of_a_turning_scanner(spark):
    """A frame closes with the packet that passes the first azimuth after more than a hundred blocks; what lies beyond opens the next."""
    from gridwake.operators import sweeps

    def packet(first):
        return b"".join(b"\xff\xee" + struct.pack("<H", (first + 200 * k) % 36000) + b"\x10\x27\x09" * 32 for k in range(12)).ljust(1206, b"\0")

    rows = [("s", n, bytearray(packet(9000 + 2400 * n))) for n in range(34)] + [("s", 99, bytearray(b"\0" * 1206))]
    tilts = spark.createDataFrame([(c, 0.0) for c in range(16)], "channel int, vert_deg double")
    got = sweeps.turn_points(spark.createDataFrame(rows, "stream_id string, seq long, payload binary"), tilts).collect()
    assert len(got) == 34 * 12 * 32
    first, frame, blocks, want = 90.0, 0, 0, {}
    for n in range(34):
        az = [(9000 + 2400 * n + 200 * k) % 36000 / 100 for k in range(12)]
        opens, closes = {}, False
        for k in range(12):
            for c in range(32):
                a = (az[k] + 2.0 / 32 * c) % 360
                opens[k, c] = blocks + min(k + 2, 12) > 100 and 0 < a - first < 10
                closes = closes or opens[k, c]
        want.update({(n, k, c): frame + opens[k, c] for k, c in opens})
        frame, blocks = (frame + 1, 0) if closes else (frame, blocks + 12)
    assert {(r.seq, r.blk, r.channel): r.frame for r in got} == want and frame == 2


def test_reflection_is_the_mirror_law(spark):
    from gridwake.operators import sweeps

    x, y, z = sweeps.reflected(F.lit(0.3), F.lit(0.5), F.lit(0.2), F.lit(1.1))
    r = spark.range(1).select(x.alias("x"), y.alias("y"), z.alias("z")).first()
    i = np.array([math.cos(0.3) * math.cos(0.5), math.cos(0.3) * math.sin(0.5), math.sin(0.3)])
    n = np.array([math.cos(0.2) * math.cos(1.1), math.cos(0.2) * math.sin(1.1), -math.sin(0.2)])
    out = 2 * (i @ n) * n - i
    assert (r.x, r.y, -r.z) == pytest.approx(tuple(out)) and np.hypot(np.hypot(r.x, r.y), r.z) == pytest.approx(1)


# --- calibration by stream and time, ranges -----------------------------------------------------------------------


def test_running_sums_over_ranges(spark):
    """A hot stream, a null one, one of one row, orders close together and far apart, and ties, over few and many partitions."""
    from gridwake.operators import ranges

    rng = np.random.default_rng(5)
    rows = [(1, int(v), int(v) % 7) for v in rng.permutation(600)] + [(2, 10**15 * k, k) for k in range(5)] + [(9, 5, 1)] + [(None, k, 1) for k in range(4)]
    df = spark.createDataFrame(rows, "s long, o long, v long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 7, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = ranges.with_previous(ranges.running_sum(ranges.numbered(df, "s", "o", "place"), "s", "o", F.col("v"), "total"), "s", "o", "v", "before").collect()
            assert len(out) == len(rows)
            for s in (1, 2, 9, None):
                own = sorted((r.o, r.place, r.v, r.total, r.before) for r in out if r.s == s)
                assert [p for _, p, *_ in own] == list(range(len(own)))
                assert [t for *_, t, _ in own] == np.cumsum([v for _, _, v, *_ in own]).tolist()
                assert [b for *_, b in own] == [None, *(v for _, _, v, *_ in own[:-1])]
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        hot = spark.range(20_000).selectExpr("1L AS s", "id AS o", "1L AS v").unionByName(spark.range(10).selectExpr("2L AS s", "id * 1000000000 AS o", "1L AS v"))
        spread = ranges.numbered(hot, "s", "o", "place").withColumn("file", F.input_file_name())
        sizes = sorted(r["count"] for r in spread.where("s = 1").groupBy("file").count().collect())
        assert len(sizes) >= 6 and sizes[-1] < 8_000  # a hot stream in a narrow span spreads over the tasks
        ties = spark.range(1000).selectExpr("1L AS s", "7L AS o")
        assert sorted(r.place for r in ranges.numbered(ties, "s", "o", "place").collect()) == list(range(1000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert ranges.numbered(df.where("false"), "s", "o", "place").count() == 0
    kept = ranges.changes(spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, 5), (1, 4, 5), (1, 5, None), (2, 1, 5)], "s long, o long, v long"), "s", "o", ["v"])
    assert sorted((r.s, r.o) for r in kept.collect()) == [(1, 1), (1, 3), (1, 5), (2, 1)]


def _device(spec, rpm, mode, verts, horizs, fov=(0, 36000)):
    body = bytearray(spec.length)
    body[:2] = b"\xa5\xff"
    struct.pack_into(">H", body, spec.rpm_at, rpm)
    struct.pack_into(">HH", body, spec.fov_at, *fov)
    body[spec.mode_at] = mode
    for at, values in ((spec.vert_at, verts), (spec.vert_at + 3 * spec.slots, horizs)):
        for k, v in enumerate(values):
            struct.pack_into(">BH", body, at + 3 * k, 255 if v is None else int(v < 0), 0 if v is None else abs(v))
    return body


def _points(spec, azimuths, raw=2000):
    body = bytearray(spec.length)
    body[:2] = b"\x55\xaa"
    for k, a in enumerate(azimuths):
        at = spec.header + k * spec.block_size
        ident = bytes.fromhex(spec.block_id)
        body[at : at + len(ident)] = ident
        struct.pack_into(">H", body, at + 2, a)
        for c in range(spec.channels):
            struct.pack_into(">HB", body, at + spec.block_header + c * spec.channel_size, raw, 9)
    return body


@pytest.mark.parametrize("most", [50_000, 0])
def test_calibration_changes_along_streams(spark, most):
    """Three streams with versions of their own, looked up in the packet's row or by an as-of join; nothing is lost."""
    from gridwake.operators import calibration as K

    model = "spin32_fine"
    spec, dev = decode.MODELS[model], K.DEVICES[model]
    verts = lambda v: [100 * k + v for k in range(32)]
    rows = []
    for stream in (1, 2, None):
        shift = stream or 0
        rows += [(stream, 0, _points(spec, range(0, 240, 20)))]  # before any device packet
        rows += [(stream, 1, _device(dev, 600, 4, [None, *verts(0)[1:]], [0] * 32))]  # angles not ready, speed known
        rows += [(stream, 2, _points(spec, range(0, 240, 20)))]
        rows += [(stream, 3, _device(dev, 1200, 4, verts(shift), [shift] * 32))]
        rows += [(stream, 4, _points(spec, range(0, 240, 20)))]
        rows += [(stream, 5, _device(dev, 1200, 0, verts(50), [7] * 32))]
        rows += [(stream, 6, _points(spec, [a for a in range(0, 240, 40) for _ in (1, 2)]))]
    df = spark.createDataFrame(rows, "stream_id long, seq long, payload binary")
    for which, horiz in (("first", None), ("latest", 7)):
        got = K.decode_streams(df, model, which, most=most).collect()
        assert len(got) == 3 * 4 * 12 * 32
        for r in got:
            assert (r.fault == "no_calibration") == (r.seq < 3) and (r.x is None) == (r.seq < 3)
            assert r.echo == (1 + r.blk % 2 if r.seq == 6 else 1)
        for stream in (1, 2, None):
            last = {(r.blk, r.channel): r for r in got if r.stream_id == stream and r.seq == 6}
            own = horiz if horiz is not None else stream or 0
            share = np.float32(np.float32(1.73 * 5) / np.float32(55.56))
            az = 40 + math.floor(np.float32(40) * share)  # two returns: a step from group to group
            v = math.radians((500 + (50 if which == "latest" else stream or 0)) / 100)
            r = last[2, 5]
            d = 2000 * 0.0025
            assert r.x == pytest.approx(d * math.cos(v) * math.cos(math.radians((az + own) / 100)) + spec.radius * math.cos(math.radians(az / 100)), abs=1e-9)
            assert r.ring == 5 and r.offset_us == pytest.approx(55.56 + 55.56 * float(share), abs=1e-6)
    free = K.decode_streams(df, model, wait=False, most=most)
    assert free.where("fault IS NOT NULL OR x IS NULL").count() == 0


def test_a_laser_without_angles_is_a_fault_and_not_a_loss(spark):
    spec = decode.MODELS["spin16"]
    df = spark.createDataFrame([(1, 1, _points(spec, range(0, 240, 20)))], "stream_id long, seq long, payload binary")
    lasers = spark.range(15).selectExpr("CAST(id AS INT) AS channel", "CAST(id * 100 AS INT) AS vert", "0 AS horiz")
    got = decode.decode(df, spec, lasers).collect()
    assert len(got) == 384 and {r.channel % 16 for r in got if r.fault == "no_calibration" and r.x is None} == {15}
    assert sum(r.fault is not None for r in got) == 24 == decode.decode(df, spec, lasers, dense=True).where("fault IS NOT NULL").count()
    assert "Exchange" not in decode.decode(df, spec, lasers)._jdf.queryExecution().executedPlan().toString()


def test_steps_inside_a_packet_are_those_of_blocks(spark):
    """block_plan against block_steps for every way of firing, with wraps and blind zones."""
    for mode, n in (("single", 12), ("dual", 12), ("two_in_one", 8), ("four_in_one", 8), ("two_firings", 12), ("two_firings_dual", 12), ("ab_dual", 3)):
        rows = []
        for p in range(6):
            az = [(35_900 + p * 7 + 20 * (k // 2 if p % 2 else k) + (3000 if p == 4 and k > 5 else 0)) % 36000 for k in range(n)]
            if mode == "ab_dual":
                az = [az[0], az[0] if p % 2 else az[2], az[2]]
            rows += [(1, p, k, a) for k, a in enumerate(az)]
        df = spark.createDataFrame(rows, "stream_id long, seq long, blk int, azimuth long")
        want = {(r.seq, r.blk): (r.az_step, r.offset) for r in decode.block_steps(df, mode, 20, 55.5, 7.5).collect()}
        packets = df.groupBy("stream_id", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("blk", "azimuth"))), lambda x: x["azimuth"]).alias("az"))
        plan = packets.select("seq", F.posexplode(decode.block_plan(F.col("az"), n, mode, F.lit(20), 55.5, F.lit(7.5))).alias("blk", "p")).select("seq", "blk", "p.*").collect()
        for r in plan:
            assert (r.az_step, pytest.approx(r.offset)) == want[r.seq, r.blk], (mode, r)


# --- captures in byte ranges, binary files --------------------------------------------------------------------------


def _write_capture(path, frames, order="<", nano=False, tail=b"", first=1_600_000_000):
    magic = {("<", False): b"\xd4\xc3\xb2\xa1", (">", False): b"\xa1\xb2\xc3\xd4", ("<", True): b"\x4d\x3c\xb2\xa1", (">", True): b"\xa1\xb2\x3c\x4d"}[order, nano]
    body = [struct.pack(order + "IIII", first + k // 100, (k % 100) * (10_000_000 if nano else 10_000), len(f), len(f)) + f for k, f in enumerate(frames)]
    path.write_bytes(magic + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65535, 1) + b"".join(body) + tail)
    return body


@pytest.mark.parametrize("order,nano", [("<", False), (">", True)])
def test_captures_in_ranges_equal_the_whole(spark, tmp_path, order, nano):
    """Ranges shorter than some records, payloads that hold captures and records of their own, and a record cut off at the end."""
    from gridwake.sources import captures

    captures.register(spark)
    rng = np.random.default_rng(3)
    fake = lambda n: struct.pack(order + "IIII", 1_600_000_005, 5, n, n) + bytes(rng.integers(0, 256, n, np.uint8))
    frames = []
    for k in range(3000):
        kind = k % 10
        payload = b"\x55\xaa" + bytes(rng.integers(0, 256, int(rng.integers(0, 900)), np.uint8))
        if kind == 3:
            payload = b"".join(fake(int(rng.integers(0, 60))) for _ in range(8))  # ends with the frame, at the next record
        if kind == 5:
            payload = b"\0" * 700
        frames.append(_frame(6699 if kind < 6 else 7788, payload, vlan=k % 4 == 0) if kind < 9 else bytes(rng.integers(0, 256, 40, np.uint8)))
    _write_capture(tmp_path / "a.pcap", frames, order, nano, tail=b"\1" * 9)
    _write_capture(tmp_path / "b.pcap", frames[:40], order, nano)
    (tmp_path / "c.pcap").write_bytes(b"")
    (tmp_path / "_d.pcap").write_bytes(b"no")
    want = sorted((r.file.split("/")[-1], r.ts_us, bytes(r.frame)) for r in packets.read_pcap(spark, str(tmp_path / "[ab].pcap")).collect())
    ports = sorted((r.file.split("/")[-1], r.ts_us, r.port) for r in packets.udp(packets.read_pcap(spark, str(tmp_path / "[ab].pcap"))).collect())
    for size in (1_000, 20_000, 1 << 26):
        df = spark.read.format("capture").option("range", size).option("longest", 2000).load(str(tmp_path))
        got = df.collect()
        assert sorted((r.file.split("/")[-1], r.ts_us, bytes(r.frame)) for r in got) == want
        assert sorted((r.file.split("/")[-1], r.ts_us, r.port) for r in got if r.port is not None) == ports
        assert len({(r.file, r.offset) for r in got}) == len(want) and (size > 1 << 20 or df.rdd.getNumPartitions() > 30)
    some = spark.read.format("capture").option("range", 20_000).option("longest", 2000).load(str(tmp_path)).where("port IN (7788) AND ts_us < 1600000009000000 AND length(frame) > 100")
    assert sorted((r.ts_us, r.port) for r in some.collect()) == sorted((t, p) for (f, t, p), (_, _, frame) in zip(ports, [w for w in want if (w[0], w[1]) in {x[:2] for x in ports}]) if p == 7788 and t < 1600000009000000 and len(frame) > 100)
    assert "7788" not in some._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]  # the source has taken the port over


def test_a_capture_whose_chains_break_is_an_error(spark, tmp_path):
    from gridwake.sources import captures

    captures.register(spark)
    body = _write_capture(tmp_path / "a.pcap", [_frame(1, bytes([k % 251]) * 300) for k in range(500)])
    data = bytearray((tmp_path / "a.pcap").read_bytes())
    at = 24 + sum(map(len, body[:200])) + 8
    struct.pack_into("<I", data, at, 999)  # a wrong length leads into the middle of a later record
    (tmp_path / "a.pcap").write_bytes(data)
    with pytest.raises(Exception, match="lead to byte|longer than"):
        spark.read.format("capture").option("range", 10_000).option("longest", 2000).load(str(tmp_path / "a.pcap")).count()


def test_a_replay_goes_on_where_it_stopped(spark, tmp_path):
    """Two passes over two files in batches of a second of record time; stopped twice, no record is lost or comes again."""
    from gridwake.sources import captures

    captures.register(spark)
    (tmp_path / "in").mkdir()
    frames = [_frame(6699, struct.pack(">I", k)) for k in range(450)]
    _write_capture(tmp_path / "in" / "a.pcap", frames[:250])
    _write_capture(tmp_path / "in" / "b.pcap", frames[250:], first=1_600_000_100)
    options = {"passes": 2, "seconds": 1, "longest": 2000}
    seen = []
    for stop in (2, 3, None):
        q = spark.readStream.format("capture").options(**options).load(str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out"))
        q = q.trigger(processingTime="0 seconds").start()
        if stop is None:
            q.processAllAvailable()
        until = time.time() + 60
        while stop and len(q.recentProgress) < stop and time.time() < until:
            time.sleep(0.1)
        seen += [p["numInputRows"] for p in q.recentProgress]
        q.stop()
    got = [(r["pass"], r["file"].split("/")[-1], r["offset"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) == 900
    assert max(seen) <= 100


def test_packed_records_and_clouds_are_read_back(spark, tmp_path):
    from gridwake.sources import binary_sinks

    binary_sinks.register(spark)
    corner = lambda x: [(x + 0.25 * k, -x - 0.5 * k) for k in range(4)]
    rows = [(f, 1000 * f, k, 0.5 + k, 1.5, None if k == 3 else 2.25, 10.0 * k, -k * 1.0, 0.125, corner(float(k))) for f in range(6) for k in range(f * 5)]
    boxes = spark.createDataFrame(rows, "frame_id long, ts_ms long, id int, depth double, width double, height double, x double, y double, z double, corners array<struct<x:double,y:double>>")
    frames = spark.range(7).selectExpr("id AS frame_id", "id * 1000 AS ts_ms")
    records = binary_sinks.obstacle_records(boxes, frames)
    folder = str(tmp_path / "records")
    records.orderBy("frame_id").coalesce(3).write.format("binary").mode("append").save(folder)
    written = b"".join(f.read_bytes() for f in sorted((tmp_path / "records").iterdir()))
    assert len(written) == 7 * 1216 and all(len(r.record) == 1216 for r in records.collect())
    # By the wire's own layout, byte by byte.
    by_ts = {struct.unpack_from("<Q", written, k)[0]: written[k : k + 1216] for k in range(0, len(written), 1216)}
    for f in range(7):
        own = [r for r in rows if r[0] == f][:20]
        want = struct.pack("<Qii", 1000 * f, bool(own), len(own)) + b"".join(struct.pack("<i6f8f", r[2], *(v or 0.0 for v in r[3:9]), *(x for p in r[9] for x in p)) for r in own)
        assert by_ts[1000 * f] == want.ljust(1216, b"\0")
    back = {r.ts_ms: r for r in binary_sinks.unpacked_obstacles(packets.fixed_records(spark, folder, 1216)).collect()}
    assert back[5000].obs_num == 20 == len(back[5000].obstacles) and back[2000].obstacles[3].corners[1].y == -3.5 and back[6000].return_val == 0
    # Clouds.
    points = spark.createDataFrame([(k % 3, k, k * 0.5, -k * 0.25, 1.0, float(k % 7)) for k in range(300)], "frame_id long, n long, x double, y double, z double, intensity double")
    out = str(tmp_path / "clouds")
    binary_sinks.cloud_files(points, "n").write.format("binary").option("each", "file").option("suffix", ".pcd").mode("append").save(out)
    assert sorted(f.name for f in (tmp_path / "clouds").iterdir()) == ["frame-0.pcd", "frame-1.pcd", "frame-2.pcd"]
    got = packets.read_pcd(spark, out).collect()
    assert sorted((r.x, r.y, r.z, r.intensity) for r in got) == sorted((r.x, r.y, r.z, r.intensity) for r in points.collect())
    # Overwriting replaces, and a job that fails leaves what was there and nothing else.
    binary_sinks.cloud_files(points.where("frame_id = 1")).write.format("binary").option("each", "file").option("suffix", ".pcd").mode("overwrite").save(out)
    assert [f.name for f in (tmp_path / "clouds").iterdir()] == ["frame-1.pcd"]
    bad = spark.range(0, 100, 1, 4).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).cast("binary").alias("record"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("binary").option("each", "file").mode("append").save(out)
    assert [f.name for f in (tmp_path / "clouds").iterdir()] == ["frame-1.pcd"]


def test_transverse_mercator(spark):
    """The meridian's arc by integration, a round trip within three degrees, and the southern hemisphere."""
    from gridwake.functions import projection as pr

    e2 = pr.FLATTENING * (2 - pr.FLATTENING)
    arc = lambda lat: np.trapezoid(pr.A * (1 - e2) / (1 - e2 * np.sin(p := np.linspace(0, math.radians(lat), 200_001)) ** 2) ** 1.5, p)
    rows = [(float(lon), float(lat)) for lon in np.linspace(12.0, 18.0, 25) for lat in np.linspace(-80, 84, 42)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    for grid in (pr.utm(33), pr.utm(33, True), pr.Mercator(14.0, 47.0, 1.0, 7.0, 9.0)):
        e, n = pr.project(F.col("lon"), F.col("lat"), grid)
        there = df.select("lon", "lat", e.alias("e"), n.alias("n"))
        lon, lat = pr.unproject(F.col("e"), F.col("n"), grid)
        for r in there.withColumns({"lon2": lon, "lat2": lat}).collect():
            assert abs(r.lon2 - r.lon) < 1e-9 and abs(r.lat2 - r.lat) < 1e-9  # a tenth of a millimetre
            if r.lon == grid.lon0:
                assert abs((r.n - grid.north0) / grid.scale - (arc(r.lat) - arc(grid.lat0))) < 1e-4 and abs(r.e - grid.east0) < 1e-6
    # Lengths along a parallel near the central meridian are those of its radius.
    e = [r.e for r in spark.createDataFrame([(15.0, 45.0), (15.001, 45.0)], "lon double, lat double").select(pr.project(F.col("lon"), F.col("lat"), pr.Mercator(15.0))[0].alias("e")).collect()]
    assert abs(e[1] - e[0]) == pytest.approx(math.radians(0.001) * pr.A * math.cos(math.radians(45)) / math.sqrt(1 - e2 * 0.5), rel=1e-9)
    m = pr.imu_to_map(1.0, 2.0, 3.0, 90.0, 0.0, 0.0)
    assert m @ [0, 1, 0, 1] == pytest.approx([2.0, 2.0, 3.0, 1.0]) and m[:3, :3] @ m[:3, :3].T == pytest.approx(np.eye(3))
    assert pr.imu_to_map(0, 0, 0, 0, 90.0, 0)[:3, :3] @ [0, 1, 0] == pytest.approx([0, 0, 1]) and pr.imu_to_map(0, 0, 0, 0, 0, 90.0)[:3, :3] @ [0, 0, 1] == pytest.approx([1, 0, 0])


def test_faults_are_counted_beside_the_data(spark):
    """One action gives data and counts; each further code has its rows."""
    from gridwake.operators import calibration as K
    from gridwake.operators import rejects

    rows = [b"\x55\xaa\x01\xff\xee", b"\x55\xaa\x01", b"\x55\xaa\x02\xff\xee", b"\x55\xaa\x01\xff\xef", b"\xa5\xff\x01", b"\xa5\xff\x01\x01", b"\xaa\x55\x02", b"\xaa\x55\x01"]
    df = spark.createDataFrame([(bytearray(r),) for r in rows * 3], "payload binary")
    faults = decode.faults(df, {"msop": 5, "difop": 3, "imu": 3}, {"msop": "55AA01", "difop": "A5FF01", "imu": "AA5501"}, (3, "FFEE"))
    out, seen = rejects.counted(faults)
    assert len(out.collect()) == 24
    got = seen.get
    assert got["rows"] == 24 and got["success"] == 9 and {k for k, v in got.items() if v == 3} == {"wrong_msop_length", "wrong_msop_id", "wrong_block_id", "wrong_difop_length", "wrong_imu_id"}
    assert set(got) == {"rows", *decode.CODES}
    packets_ = spark.createDataFrame([(1, 0), (1, 5), (1, 2_000_000), (2, 9), (None, 1), (None, 1_500_000)], "stream_id long, ts_us long")
    assert sorted((r.stream_id or 0, r["from"], r["to"], r.code) for r in rejects.silences(packets_).collect()) == [(0, 1, 1_500_000, 0x40), (1, 5, 2_000_000, 0x40)]
    points = spark.createDataFrame([(1, 0.0)] * 3 + [(2, 0.0)] * 2, "frame_id long, x double")
    frames = spark.createDataFrame([(1,), (2,), (3,)], "frame_id long")
    assert {r.frame_id: (r.n, r.fault) for r in rejects.frame_faults(frames, points, most=2).collect()} == {1: (3, "cloud_overflow"), 2: (2, None), 3: (0, "no_points")}
    assert {r.frame_id for r in rejects.within_limit(points, most=2).collect()} == {2}
    dev = K.DEVICES["spin32_fine"]
    devices = spark.createDataFrame([(1, 1, _device(dev, 600, 4, [None] * 32, [0] * 32)), (1, 2, _device(dev, 600, 4, [5] * 32, [0] * 32))], "stream_id long, seq long, payload binary")
    read = K.readings(devices, dev)
    assert [(r.seq, r.code) for r in rejects.device_faults(read).collect()] == [(1, decode.CODES["difop_not_parsed"])]
    early = spark.createDataFrame([(1, 0), (1, 3), (2, 7)], "stream_id long, seq long")
    assert sorted((r.stream_id, r.seq) for r in rejects.starts_early(early, read).collect()) == [(1, 0), (2, 7)]
    replayed = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("a", 2), ("b", 0)], "file string, pass int")
    assert sorted((r.file, r["pass"], r.fault) for r in rejects.replay_events(replayed).collect()) == [("a", 1, "file_repeats"), ("a", 2, "file_ends"), ("a", 2, "file_repeats"), ("b", 0, "file_ends")]
