"""Queries of the elevation grid, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.config import GridConfig
from gridwake.operators import clusters as C
from gridwake.operators import grid as G
from gridwake.plans.materialize import materialize
from gridwake.sources import fixtures
from gridwake.sources.fixtures import POINTS_SQL

CFG = GridConfig()
#: A finer layer for the layer queries, so that they have several.
R = 6


def _points(spark, sf):
    return fixtures.points(spark, sf)


def _cells(spark, sf):
    return G.build(_points(spark, sf), CFG)


def _ground(spark, sf):
    return G.ground(_points(spark, sf), CFG)


def _detected(spark, sf):
    return materialize(G.detect(_points(spark, sf), CFG), "detected")


def _clustered(spark, sf):
    return materialize(C.connect(_detected(spark, sf), CFG), "clustered")


def g01(spark: SparkSession, sf: str) -> DataFrame:
    return G.to_cells(_points(spark, sf), CFG).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum_x"), F.sum("z").alias("sum_z"))


def g02(spark, sf):
    return _cells(spark, sf).select(*G.KEY, "min_z", "max_z", F.round(F.col("sum_z") / F.col("point_num"), R).alias("mean_z"), "point_num")


def g03(spark, sf):
    return _cells(spark, sf).select(*G.KEY, F.col("min_z").alias("ground_z"))


def g04(spark, sf):
    return G.slope(_cells(spark, sf), CFG).select(*G.KEY, F.round("slope", R).alias("slope"))


def g05(spark, sf):
    return G.seeds(_cells(spark, sf), CFG).select(*G.KEY, "min_z")


def g06(spark, sf):
    return _ground(spark, sf).where("is_ground").select(*G.KEY)


def g07(spark, sf):
    s, h = G.thresholds(CFG)
    return _cells(spark, sf).select("col").distinct().select("col", F.round(s, R).alias("slope_limit"), F.round(h, R).alias("height_limit"))


def g08(spark, sf):
    return _ground(spark, sf).groupBy("frame_id").agg(F.count_if("is_ground").alias("ground"), F.count_if(~F.col("is_ground")).alias("other"), F.max(F.when(F.col("is_ground"), F.col("col"))).alias("farthest"))


def g09(spark, sf):
    placed = G.to_cells(_points(spark, sf), CFG)
    return G.ground_split(placed, _ground(spark, sf).where("is_ground")).groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("sum_z"))


def g10(spark, sf):
    return G.column_reference(_ground(spark, sf), CFG).select("frame_id", F.col("col").cast("long").alias("col"), F.round("ground_reference_z", R).alias("ground_reference_z"))


def g11(spark, sf):
    return G.layers(_points(spark, sf), _cells(spark, sf), CFG).select(*G.KEY, "height_range", "occupied_layers")


def g11_histogram(spark, sf):
    return G.layer_histogram(_points(spark, sf), _cells(spark, sf), CFG)


def g12(spark, sf):
    return _detected(spark, sf).select(*G.KEY, F.round("top_height", R).alias("top_height"), "is_ground", "is_vertical_structure", "is_obstacle_candidate")


def g13(spark, sf):
    return _clustered(spark, sf).select(*G.KEY, F.col("cluster_id").cast("long").alias("cluster_id"))


def g14(spark, sf):
    return C.summarise(_clustered(spark, sf), CFG).select("frame_id", F.col("cluster_id").cast("long").alias("cluster_id"), "n_cells", "point_num", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z", "centre_x", "centre_y", "size_x", "size_y")


def g15(spark, sf):
    return C.oriented_boxes(_clustered(spark, sf), CFG).select("frame_id", F.col("cluster_id").cast("long").alias("cluster_id"), *(F.round(c, 4).alias(c) for c in ("cx", "cy", "angle", "length", "width")))


def g16(spark, sf):
    out = G.reclassify(_points(spark, sf), _detected(spark, sf), CFG)
    return out.groupBy("frame_id", "is_obstacle").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("sum_z"), F.sum("x").alias("sum_x"))


def g17(spark, sf):
    out = C.records(C.summarise(_clustered(spark, sf), CFG))
    return out.select("frame_id", "return_val", "obs_num", F.array_join(F.transform("obstacles", lambda o: F.concat_ws(":", o["cluster_id"].cast("string"), o["centre_x"].cast("long").cast("string"), o["centre_y"].cast("long").cast("string"))), ";").alias("obstacles"))


def g19(spark, sf):
    clustered = _clustered(spark, sf)
    out = C.rotation_form(C.summarise(clustered, CFG), C.oriented_boxes(clustered, CFG))
    return out.select("frame_id", F.col("cluster_id").cast("long").alias("cluster_id"), *(F.round(F.col("translation")[k], 4).alias(f"t{k}") for k in range(3)), *(F.round(F.col("rotation")[k], 4).alias(f"r{k}") for k in (0, 1, 3, 4)))


def k10(spark, sf):
    clustered = _clustered(spark, sf)
    out = C.detections(C.summarise(clustered, CFG), C.oriented_boxes(clustered, CFG))
    return out.select("frame_id", F.col("cluster_id").cast("long").alias("cluster_id"), *(F.round(c, 4).alias(c) for c in ("x", "y", "z", "depth", "width", "height")))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """What obstacles are in each frame?"""
    return g14(spark, sf)


QUERIES = {
    "g01_world_to_grid": g01, "g02_build_grid": g02, "g03_ground_height": g03, "g04_cell_slope": g04, "g05_seeds": g05, "g06_region_growing": g06,
    "g07_dynamic_thresholds": g07, "g08_ground_mask": g08, "g09_ground_split": g09, "g10_ground_reference": g10, "g11_layers": g11, "g11_layer_histogram": g11_histogram,
    "g12_candidates": g12, "g13_components": g13, "g14_cluster_summary": g14, "g15_oriented_boxes": g15, "g16_reclassify": g16, "g17_output_records": g17,
    "g19_rotation_form": g19, "k10_detections": k10,
}

CELLS_SQL = POINTS_SQL + """,
placed AS (SELECT *, LEAST(CAST(floor((y + 3000) / 200.0) AS INT), 29) AS "row", LEAST(CAST(floor((x - 900) / 200.0) AS INT), 35) AS col FROM pts WHERE x >= 900 AND x < 8000 AND y >= -3000 AND y < 3000),
cells AS (SELECT frame_id, "row", col, min(z) AS min_z, max(z) AS max_z, sum(z)::BIGINT AS sum_z, count(*) AS point_num FROM placed GROUP BY 1, 2, 3)"""
OFF_SQL = "off AS (SELECT a.v AS dr, b.v AS dc FROM (VALUES (-1), (0), (1)) AS a(v), (VALUES (-1), (0), (1)) AS b(v) WHERE a.v <> 0 OR b.v <> 0)"
SLOPE_SQL = CELLS_SQL + f""",
{OFF_SQL},
rise AS (SELECT c.frame_id, c."row", c.col, max(abs(n.min_z - c.min_z) / CASE WHEN dr * dc <> 0 THEN 200.0::DOUBLE * sqrt(2.0::DOUBLE) ELSE 200.0::DOUBLE END) AS slope
  FROM cells c, off JOIN cells n ON n.frame_id = c.frame_id AND n."row" = c."row" + dr AND n.col = c.col + dc GROUP BY 1, 2, 3),
sloped AS (SELECT c.*, coalesce(r.slope, 0.0) AS slope FROM cells c LEFT JOIN rise r USING (frame_id, "row", col)),
lim AS (SELECT *, CASE WHEN xm < 3.5 THEN 0.35 WHEN xm > 8.0 THEN 0.80 ELSE 0.35 + (xm - 0.35) * 0.1 END AS s_lim,
  1000 * CASE WHEN xm < 3.5 THEN 0.35 WHEN xm > 8.0 THEN 0.60 ELSE 0.35 + (xm - 3.5) * (0.60 - 0.35) / (8.0 - 3.5) END AS h_lim
  FROM (SELECT *, ((900.0::DOUBLE + (col + 0.5::DOUBLE) * 200) / 1000) AS xm FROM sloped))"""
GROUND_SQL = SLOPE_SQL + """,
reach AS (SELECT frame_id, "row", col, min_z FROM lim WHERE col < 3
  UNION SELECT v.frame_id, v."row", v.col, v.min_z FROM reach u, off JOIN lim v ON v.frame_id = u.frame_id AND v."row" = u."row" + dr AND v.col = u.col + dc WHERE v.slope <= v.s_lim AND abs(u.min_z - v.min_z) <= v.h_lim),
gcells AS (SELECT l.*, r.min_z IS NOT NULL AS is_ground FROM lim l LEFT JOIN reach r USING (frame_id, "row", col))"""
REF_SQL = GROUND_SQL + """,
med AS (SELECT frame_id, col, median(min_z) AS z FROM gcells WHERE is_ground GROUP BY 1, 2),
spine AS (SELECT f.frame_id, c.col, med.z FROM (SELECT DISTINCT frame_id FROM cells) f CROSS JOIN (SELECT unnest(range(0, 36)) AS col) c LEFT JOIN med ON med.frame_id = f.frame_id AND med.col = c.col),
fill AS (SELECT *, last_value(z IGNORE NULLS) OVER b AS pz, last_value(CASE WHEN z IS NOT NULL THEN col END IGNORE NULLS) OVER b AS pc, first_value(z IGNORE NULLS) OVER a AS nz, first_value(CASE WHEN z IS NOT NULL THEN col END IGNORE NULLS) OVER a AS nc
  FROM spine WINDOW b AS (PARTITION BY frame_id ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY frame_id ORDER BY col ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
flat AS (SELECT frame_id, col, coalesce(z, pz + (nz - pz) * ((col - pc) / (nc - pc)), pz, nz, -1390.0) AS z FROM fill),
ref AS (SELECT frame_id, col, CASE WHEN col BETWEEN 1 AND 34 THEN (lag(z) OVER w + z + lead(z) OVER w) / 3 ELSE z END AS ref FROM flat WINDOW w AS (PARTITION BY frame_id ORDER BY col))"""
LAYER_SQL = """lay AS (SELECT p.frame_id, p."row", p.col, greatest(0, least(greatest(1, least(200, ceil((c.max_z - c.min_z) / 50.0)::INT)) - 1, floor((p.z - c.min_z) / 50.0)::INT)) AS layer
  FROM placed p JOIN cells c USING (frame_id, "row", col)),
occ AS (SELECT frame_id, "row", col, count(DISTINCT layer)::INT AS occupied_layers FROM lay GROUP BY 1, 2, 3)"""
CAND_SQL = REF_SQL + f""",
{LAYER_SQL},
top AS (SELECT g.*, o.occupied_layers, g.max_z - g.min_z AS height_range, g.max_z - r.ref AS top_height, r.ref FROM gcells g JOIN ref r USING (frame_id, col) JOIN occ o USING (frame_id, "row", col)),
tall AS (SELECT frame_id, "row" + dr AS "row", col + dc AS col, count(*) AS n FROM top, off WHERE is_ground AND top_height > 500 GROUP BY 1, 2, 3),
cand AS (SELECT t.*, top_height >= 0 AND height_range > 500 AND occupied_layers <= 3 AS is_vertical_structure,
  top_height >= 0 AND NOT (height_range > 500 AND occupied_layers <= 3) AND height_range >= 20 AND occupied_layers >= 1
  AND CASE WHEN 900 + (col + 0.5) * 200 < 4000 THEN top_height BETWEEN 50 AND 400 ELSE top_height BETWEEN 100 AND 500 END AND coalesce(k.n, 0) < 2 AS is_obstacle_candidate
  FROM top t LEFT JOIN tall k USING (frame_id, "row", col))"""
COMP_SQL = CAND_SQL + """,
path AS (SELECT frame_id, "row", col, ("row" * 36 + col)::BIGINT AS label FROM cand WHERE is_obstacle_candidate
  UNION SELECT v.frame_id, v."row", v.col, u.label FROM path u, off JOIN cand v ON v.frame_id = u.frame_id AND v."row" = u."row" + dr AND v.col = u.col + dc WHERE v.is_obstacle_candidate),
lab AS (SELECT frame_id, "row", col, min(label) AS label FROM path GROUP BY 1, 2, 3),
num AS (SELECT *, dense_rank() OVER (PARTITION BY frame_id ORDER BY label) - 1 AS cluster_id, count(*) OVER (PARTITION BY frame_id, label) AS k FROM lab),
clu AS (SELECT c.*, n.cluster_id FROM cand c JOIN num n USING (frame_id, "row", col) WHERE n.k >= 2)"""
BOX_SQL = COMP_SQL + """,
box AS (SELECT frame_id, cluster_id, count(*) AS n_cells, sum(point_num)::BIGINT AS point_num, min(900.0::DOUBLE + (col + 0.5::DOUBLE) * 200) - 100 AS min_x, max(900.0::DOUBLE + (col + 0.5::DOUBLE) * 200) + 100 AS max_x,
  min(-3000.0::DOUBLE + ("row" + 0.5::DOUBLE) * 200) - 100 AS min_y, max(-3000.0::DOUBLE + ("row" + 0.5::DOUBLE) * 200) + 100 AS max_y, min(min_z) AS min_z, max(max_z) AS max_z FROM clu GROUP BY 1, 2),
aabb AS (SELECT *, (min_x + max_x) / 2 AS centre_x, (min_y + max_y) / 2 AS centre_y, (min_z + max_z) / 2 AS centre_z, max_x - min_x AS size_x, max_y - min_y AS size_y, max_z - min_z AS size_z FROM box)"""
OBB_SQL = BOX_SQL + """,
mom AS (SELECT frame_id, cluster_id, count(*) AS n, sum(col)::BIGINT AS sx, sum("row")::BIGINT AS sy, (count(*) * sum(col * col) - sum(col) * sum(col))::BIGINT AS vx, (count(*) * sum("row" * "row") - sum("row") * sum("row"))::BIGINT AS vy, (count(*) * sum(col * "row") - sum(col) * sum("row"))::BIGINT AS vxy FROM clu GROUP BY 1, 2 HAVING count(*) >= 3),
ang AS (SELECT *, CASE WHEN vxy = 0 AND vx >= vy THEN 0.0 ELSE 0.5::DOUBLE * atan2(2.0::DOUBLE * vxy, (vx - vy)::DOUBLE) END AS angle FROM mom),
uv AS (SELECT c.frame_id, c.cluster_id, a.n, a.sx, a.sy, a.angle, (c.col - a.sx / a.n) * cos(angle) + (c."row" - a.sy / a.n) * sin(angle) AS u, (c."row" - a.sy / a.n) * cos(angle) - (c.col - a.sx / a.n) * sin(angle) AS v FROM clu c JOIN ang a USING (frame_id, cluster_id)),
obb AS (SELECT frame_id, cluster_id, 900.0 + (sx / n + 0.5) * 200.0 AS cx, -3000.0 + (sy / n + 0.5) * 200.0 AS cy, angle, (max(u) - min(u)) * 200 AS length, (max(v) - min(v)) * 200 AS width FROM uv GROUP BY frame_id, cluster_id, n, sx, sy, angle)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


K = 'frame_id, "row", col'
SQL = {
    "g01_world_to_grid": _with(CELLS_SQL, 'SELECT "row", col, count(*) AS n, sum(x)::BIGINT AS sum_x, sum(z)::BIGINT AS sum_z FROM placed GROUP BY 1, 2'),
    "g02_build_grid": _with(CELLS_SQL, f"SELECT {K}, min_z, max_z, round(sum_z / point_num, 6) AS mean_z, point_num FROM cells"),
    "g03_ground_height": _with(CELLS_SQL, f"SELECT {K}, min_z AS ground_z FROM cells"),
    "g04_cell_slope": _with(SLOPE_SQL, f"SELECT {K}, round(slope, 6) AS slope FROM sloped"),
    "g05_seeds": _with(CELLS_SQL, f"SELECT {K}, min_z FROM cells WHERE col < 3"),
    "g06_region_growing": _with(GROUND_SQL, f"SELECT {K} FROM reach"),
    "g07_dynamic_thresholds": _with(SLOPE_SQL, "SELECT DISTINCT col, round(s_lim::DOUBLE, 6) AS slope_limit, round(h_lim::DOUBLE, 6) AS height_limit FROM lim"),
    "g08_ground_mask": _with(GROUND_SQL, "SELECT frame_id, count_if(is_ground)::BIGINT AS ground, count_if(NOT is_ground)::BIGINT AS other, max(CASE WHEN is_ground THEN col END) AS farthest FROM gcells GROUP BY frame_id"),
    "g09_ground_split": _with(GROUND_SQL, 'SELECT p.frame_id, CASE WHEN r.min_z IS NULL THEN 0 ELSE 1 END AS label, count(*) AS n, sum(z)::BIGINT AS sum_z FROM placed p LEFT JOIN reach r USING (frame_id, "row", col) GROUP BY 1, 2'),
    "g10_ground_reference": _with(REF_SQL, "SELECT frame_id, col, round(ref, 6) AS ground_reference_z FROM ref"),
    "g11_layers": _with(CELLS_SQL + ",\n" + LAYER_SQL, f"SELECT {K}, max_z - min_z AS height_range, occupied_layers FROM cells JOIN occ USING ({K})"),
    "g11_layer_histogram": _with(CELLS_SQL + ",\n" + LAYER_SQL, f"SELECT {K}, layer, least(count(*), 255) AS n FROM lay GROUP BY 1, 2, 3, 4"),
    "g12_candidates": _with(CAND_SQL, f"SELECT {K}, round(top_height, 6) AS top_height, is_ground, is_vertical_structure, is_obstacle_candidate FROM cand"),
    "g13_components": _with(COMP_SQL, f"SELECT {K}, cluster_id FROM clu"),
    "g14_cluster_summary": _with(BOX_SQL, "SELECT frame_id, cluster_id, n_cells, point_num, min_x, max_x, min_y, max_y, min_z, max_z, centre_x, centre_y, size_x, size_y FROM aabb"),
    "g15_oriented_boxes": _with(OBB_SQL, "SELECT frame_id, cluster_id, round(cx, 4) AS cx, round(cy, 4) AS cy, round(angle, 4) AS angle, round(length, 4) AS length, round(width, 4) AS width FROM obb"),
    "g16_reclassify": _with(CAND_SQL, 'SELECT p.frame_id, CASE WHEN c.is_ground THEN p.z > c.ref + 50 ELSE true END AS is_obstacle, count(*) AS n, sum(p.z)::BIGINT AS sum_z, sum(p.x)::BIGINT AS sum_x FROM placed p LEFT JOIN cand c USING (frame_id, "row", col) GROUP BY 1, 2'),
    "g17_output_records": _with(BOX_SQL, "SELECT frame_id, 1 AS return_val, least(count(*), 20)::INT AS obs_num, array_to_string(list_slice(list(cluster_id || ':' || centre_x::BIGINT || ':' || centre_y::BIGINT ORDER BY cluster_id), 1, 20), ';') AS obstacles FROM aabb GROUP BY frame_id"),
    "g19_rotation_form": _with(OBB_SQL, "SELECT a.frame_id, a.cluster_id, round(coalesce(cx, centre_x), 4) AS t0, round(coalesce(cy, centre_y), 4) AS t1, round(centre_z::DOUBLE, 4) AS t2, round(cos(coalesce(angle, 0.0)), 4) AS r0, round(0.0 - sin(coalesce(angle, 0.0)), 4) AS r1, round(sin(coalesce(angle, 0.0)), 4) AS r3, round(cos(coalesce(angle, 0.0)), 4) AS r4 FROM aabb a LEFT JOIN obb b USING (frame_id, cluster_id)"),
    "k10_detections": _with(OBB_SQL, "SELECT a.frame_id, a.cluster_id, round(coalesce(cx, centre_x), 4) AS x, round(coalesce(cy, centre_y), 4) AS y, round(centre_z::DOUBLE, 4) AS z, round(coalesce(length, size_x), 4) AS depth, round(coalesce(width, size_y), 4) AS width, round(size_z::DOUBLE, 4) AS height FROM aabb a LEFT JOIN obb b USING (frame_id, cluster_id)"),
}
