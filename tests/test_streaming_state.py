"""Operators with state over streams give what their batch forms give, over shuffled micro-batches and a restart."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwake.operators import curbs, framing, lines, poses, tracking
from gridwake.streaming import state


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, state.STORE)
    yield spark
    spark.conf.unset(name)


def _batches(spark, df, folder, cut, n):
    """df as n files, ascending in `cut`, shuffled inside; and the streaming table."""
    rows = sorted(df.collect(), key=lambda r: r[cut])
    rng = np.random.default_rng(1)
    for k, part in enumerate(np.array_split(np.arange(len(rows)), n)):
        own = [rows[j] for j in rng.permutation(part)]
        spark.createDataFrame(own, df.schema).coalesce(1).write.parquet(f"{folder}/{k:03d}.parquet")
    return lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*.parquet")


def _run(made, folder, restart=True):
    """The rows that a query gives, stopped once on the way and started again."""
    for stop in (2, None) if restart else (None,):
        q = made().writeStream.format("parquet").option("checkpointLocation", f"{folder}/ck").option("path", f"{folder}/out").trigger(processingTime="0 seconds").start()
        if stop:
            for _ in range(300):
                if len(q.recentProgress) >= stop or not q.isActive:
                    break
                q.awaitTermination(0.1)
        else:
            q.processAllAvailable()
        q.stop()
    return made().sparkSession.read.parquet(f"{folder}/out")


def _equal(got, want):
    columns = sorted(want.columns)
    value = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = lambda df: sorted(tuple(value(r[c]) for c in columns) for r in df.select(*columns).collect())
    assert rows(got) == rows(want)


def test_counts_and_markers(rocks, tmp_path):
    df = rocks.range(400).selectExpr("id % 3 AS stream_id", "id AS seq", "id % 17 = 5 AS marker")
    stream = _batches(rocks, df, tmp_path / "in", "seq", 5)
    _equal(_run(lambda: state.by_count(stream(), 10), tmp_path / "a"), framing.by_count(df.select("stream_id", "seq"), 10))
    _equal(_run(lambda: state.by_marker(stream()), tmp_path / "b"), framing.by_marker(df).select("stream_id", "seq", "frame"))


def test_filters_and_windows(rocks, tmp_path):
    df = rocks.range(240).selectExpr("id % 2 AS stream_id", "IF(id % 4 < 2, 'left', 'right') AS side", "id * 37 AS ts_ms", "CAST(id % 13 AS DOUBLE) / 4 AS k", "CAST(id % 29 AS DOUBLE) AS b", "id AS frame_id", "id % 5 <> 0 AS valid", "CAST(id % 7 AS DOUBLE) AS x0", "CAST(id % 9 AS DOUBLE) AS x1", "id % 3 AS track_id", "CAST(id AS DOUBLE) * 0.5 AS x", "CAST(id % 11 AS DOUBLE) AS y")
    stream = _batches(rocks, df, tmp_path / "in", "ts_ms", 4)
    _equal(_run(lambda: state.smooth_lines(stream(), 1.0, 3.0), tmp_path / "a"), curbs.smooth_lines(df, 1.0, 3.0).select("stream_id", "side", "ts_ms", "fk", "fb", "rk", "rb"))
    _equal(_run(lambda: state.count_windows(stream(), 7), tmp_path / "b"), lines.sliding_average(df, 7))
    _equal(_run(lambda: state.smooth(stream()), tmp_path / "c"), tracking.smooth(df).select("stream_id", "track_id", "ts_ms", "fx", "fy", "fvx", "fvy"))


def test_chosen_lines(rocks, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(s, side, f, [[(x, 0.0, x + d, 100.0, 90.0 + float(d), 9) for d in rng.uniform(-1, 1, 2).tolist()] for x in rng.uniform(0, 30, 3).tolist()]) for s in (1, 2) for side in ("left", "right") for f in range(20)]
    df = rocks.createDataFrame(rows, "stream_id long, side string, frame_id long, clusters array<array<struct<ax:double,ay:double,bx:double,by:double,angle:double,range:int>>>")
    stream = _batches(rocks, df, tmp_path / "in", "frame_id", 4)
    want = []
    for s in (1, 2):
        for side in ("left", "right"):
            chooser = curbs.ChosenLine()
            for r in (r for r in rows if r[:2] == (s, side)):
                if chosen := chooser.step(r[3]):
                    want.append((s, side, r[2], *map(float, chosen[:5]), chosen[5]))
    want = rocks.createDataFrame(want, "stream_id long, side string, frame_id long, ax double, ay double, bx double, by double, angle double, range int")
    _equal(_run(lambda: state.choose_lines(stream()), tmp_path / "a"), want)


def test_poses_as_of(rocks, tmp_path):
    """Rows and poses in any order within ten seconds; what lies behind the watermark at the end has come out."""
    left = rocks.range(300).selectExpr("id % 3 AS stream_id", "id * 100 + 1000 AS ts_ms", "id AS n")
    pose = rocks.range(90).selectExpr("id % 3 AS stream_id", "id * 310 + 1055 AS ts_ms", "CAST(id AS DOUBLE) AS x", "'p' AS name")
    # A last row and pose far ahead move the watermark on.
    end = rocks.range(3).selectExpr("id AS stream_id", "1000000L AS ts_ms", "-1L AS n")
    shaken = lambda df: df.withColumn("cut", F.col("ts_ms") + F.pmod(F.xxhash64("ts_ms"), F.lit(8000)))
    a = _batches(rocks, shaken(left.unionByName(end)), tmp_path / "l", "cut", 6)
    b = _batches(rocks, shaken(pose), tmp_path / "p", "cut", 5)
    got = _run(lambda: state.asof(a().drop("cut"), b().drop("cut"), late="30 seconds"), tmp_path / "a")
    _equal(got.where("n >= 0"), poses.asof(left, pose))


def test_silent_streams_are_forgotten(rocks, tmp_path):
    """A key whose timer runs out begins anew."""
    df = rocks.createDataFrame([(1, 1), (1, 2)], "stream_id long, seq long")
    stream = _batches(rocks, df, tmp_path / "in", "seq", 1)
    made = lambda: state.by_count(stream(), 1, keep_ms=1)
    q = made().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").trigger(processingTime="200 milliseconds").start()
    kept = lambda: sorted((r.seq, r.frame) for r in rocks.read.schema("stream_id long, seq long, frame long").parquet(f"{tmp_path}/out").collect())

    def wait(n: int) -> None:  # such a query has a batch for each trigger, so it is never idle
        for _ in range(150):
            if q.awaitTermination(0.3) or (tmp_path / "out" / "_spark_metadata").exists() and len(kept()) >= n:
                break

    wait(2)
    q.awaitTermination(4)
    rocks.createDataFrame([(1, 3)], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/009.parquet")
    wait(3)
    q.stop()
    assert kept() == [(1, 1), (2, 2), (3, 1)]
