"""Neighbours by tiles, against brute force and on points that lie so densely that their pairs can't be made."""

import numpy as np
from pyspark.sql import functions as F

from gridwake.operators import transform

COLUMNS = "frame_id long, point_id long, x double, y double, z double"


def _pile(spark, n=60_000):
    """n points at one place, some in a corner of four tiles, a pair and a lone one."""
    pile = spark.range(n).selectExpr("0L AS frame_id", "id AS point_id", "100D AS x", "100D AS y", "5D AS z")
    rest = [(0, n, 479.0, 481.0, -1.0), (0, n + 1, 481.0, 479.0, 1.0), (0, n + 2, 481.0, 481.0, 0.0), (0, n + 3, 900.0, 0.0, 0.0), (0, n + 4, 950.0, 0.0, 0.0), (0, n + 5, 5000.0, 0.0, 0.0)]
    return pile.union(spark.createDataFrame(rest, COLUMNS)), n


def _ids(df, n):
    """How many of the pile there are, and which of the rest."""
    rest = sorted(r.point_id - n for r in df.where(F.col("point_id") >= n).collect())
    return df.where(F.col("point_id") < n).count(), rest


def _cloud(spark, seed=5, n=700):
    rng = np.random.default_rng(seed)
    xyz = np.floor(rng.uniform(-700, 700, (n, 3)) * [1, 1, 0.05])
    rows = [(k % 2, k, *map(float, p)) for k, p in enumerate(xyz)] + [(0, n, float("nan"), 0.0, 0.0)]
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    d[(np.arange(n)[:, None] % 2 != np.arange(n)[None] % 2) | np.eye(n, dtype=bool)] = np.inf
    return spark.createDataFrame(rows, COLUMNS), d


def test_bounded_outliers(spark):
    pts, n = _pile(spark)
    assert _ids(transform.statistical_outliers_within(pts, 60.0, 2, 1.0), n) == (n, [])
    cloud, d = _cloud(spark)
    two = np.sort(d, 1)[:, :2]
    full, want = two[:, 1] <= 60, set()
    for frame in (0, 1):
        own = np.flatnonzero(full & (np.arange(len(d)) % 2 == frame))
        m = two[own].mean(1)
        want |= set(own[m <= m.mean() + m.std(ddof=1)].tolist())
    assert {r.point_id for r in transform.statistical_outliers_within(cloud, 60.0, 2, 1.0).collect()} == want and 0 < len(want) < full.sum()


def test_outliers_at_any_distance(spark):
    pts, n = _pile(spark)
    count, rest = _ids(transform.statistical_outliers(pts, 60.0, 2, 1.0), n)
    assert count == n and rest[:3] == [0, 1, 2] and 5 not in rest
    cloud, d = _cloud(spark)
    two = np.sort(d, 1)[:, :2].mean(1)
    want = set()
    for frame in (0, 1):
        own = np.arange(frame, len(d), 2)
        want |= set(own[two[own] <= two[own].mean() + two[own].std(ddof=1)].tolist())
    assert {r.point_id for r in transform.statistical_outliers(cloud, 20.0, 2, 1.0).collect()} == want and 0 < len(want) < len(d)


def test_links_are_all_made_once(spark):
    cloud, d = _cloud(spark)
    got = [(r.a, r.b) for r in transform.euclidean_links(cloud, 60.0).collect()]
    want = {(int(a), int(b)) for a, b in np.argwhere(d <= 60) if a < b}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    # Points travel to the tiles around them, not to 14 cubes each.
    dense = spark.range(20_000).selectExpr("0L AS frame_id", "id AS point_id", "id * 7919 % 480 + 0D AS x", "id * 104729 % 480 + 0D AS y", "id % 40 + 0D AS z")
    plan = transform.euclidean_links(dense, 1.0)._jdf.queryExecution().toString()
    assert "Join" not in plan.replace("LeftSemi", "").split("MapInArrow")[0]


def _crowd(spark, n, wide, high=40.0):
    """n points at random around a corner of four tiles, as whole numbers, so that some are at one place; keys tell nothing of places."""
    rng = np.random.default_rng(7)
    xyz = np.floor(rng.uniform(0, 1, (n, 3)) * [wide, wide, high]) + [480 - wide / 2, 480 - wide / 2, 0]
    rows = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(xyz)], COLUMNS)
    return rows, xyz


def test_links_of_a_crowded_cloud(spark):
    for wide, high in ((150, 40.0), (100, 100.0), (1, 1.0)):  # flat, as high as wide, at one place
        cloud, xyz = _crowd(spark, 1000, wide, high)
        cloud = cloud.unionByName(spark.createDataFrame([(0, 5000, 2000.0, 0.0, 0.0), (0, 1_000_000, 2060.0, 0.0, 0.0), (1, 0, 480.0, 480.0, 0.0)], COLUMNS))
        got = [(r.frame_id, r.a, r.b) for r in transform.euclidean_links(cloud, 60.0).collect()]
        d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
        want = {(0, int(a), int(b)) for a, b in np.argwhere(np.triu(d2 <= 3600, 1))} | {(0, 5000, 1_000_000)}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100_000


def test_links_are_written_in_little_room(spark, tmp_path):
    """Neighbours have most others in common, and their pairs stand so that a file's bytes repeat."""
    cloud, _ = _crowd(spark, 6000, 240)
    pairs = transform.euclidean_links(cloud, 60.0)
    pairs.write.parquet(f"{tmp_path}/pairs")
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    rows = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert rows > 2_000_000 and size < 1.2 * rows


def test_clusters_of_many_touching_points(spark):
    pts, n = _pile(spark)
    got = transform.euclidean_clusters(pts, 60.0).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.cluster_id: r.n for r in got} == {0: n, n: 3, n + 3: 2, n + 5: 1}
    cloud, d = _cloud(spark)
    label, new = None, np.arange(len(d))
    while label is None or (new != label).any():
        label, new = new, np.minimum(new, np.where(d <= 60, new[None], len(d)).min(1))
    got = {r.point_id: r.cluster_id for r in transform.euclidean_clusters(cloud, 60.0).collect()}
    assert got == dict(enumerate(label.tolist())) | {len(d): len(d)}


def test_points_with_enough_others(spark):
    pts, n = _pile(spark)
    assert _ids(transform.radius_outliers(pts, 60.0, 2), n) == (n, [0, 1, 2])
    cloud, d = _cloud(spark)
    assert {r.point_id for r in transform.radius_outliers(cloud, 60.0, 3).collect()} == set(np.flatnonzero((d <= 60).sum(1) >= 3).tolist())


def test_the_rest_of_a_dense_cloud(spark, tmp_path):
    """Lines of 60,000 orders at one place and a lone one."""
    from gridwake.plans import device_queries

    every = spark.range(60_000).selectExpr("id * 8 * 7100 * 6000 AS l_orderkey", "1 AS l_linenumber", "40L AS l_partkey", "7L AS l_suppkey")
    lone = spark.sql("SELECT 8L AS l_orderkey, 1 AS l_linenumber, 60L AS l_partkey, 9L AS l_suppkey")
    every.union(lone).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in device_queries.Q["c03_extract_rest"](spark, str(tmp_path)).collect()] == [(0, 81)]
