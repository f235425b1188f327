"""Queries over the laser cloud, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import points as P
from plumbline.operators.counters import Counters
from plumbline.operators.spatial import interpolate, nearest
from plumbline.plans.scratch import Scratch
from plumbline.sources import fixtures as fx


def reclassify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reclassify(fx.points(spark, sf_dir)).groupBy("Classification").agg(F.count("*").alias("n"))


def reclassify_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reclassify(fx.points(spark, sf_dir), ((1, 2), (2, 9), (5, 1))).select("point_id", "Classification")


def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.points(spark, sf_dir).where(F.col("Classification").isin(*P.KEPT_CLASSES)).select("point_id", "Classification")


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.points(spark, sf_dir).groupBy("PointSourceId").agg(F.count("*").alias("n"))


def merge_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = fx.points(spark, sf_dir)
    strips = [cloud.where(F.col("PointSourceId") == i).select("point_id", "X", *(["Z"] if i % 2 else [])) for i in range(4)]
    return P.merge(*strips).select("point_id", "X", "Z")


def las_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bounds(fx.points(spark, sf_dir).withColumns({"X": F.col("X") - 20.5, "Y": F.col("Y") - 20.5}))


def inward_roof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.inward_roof(fx.points(spark, sf_dir))


def inward_facade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.inward_facade(fx.points(spark, sf_dir))


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rays(fx.points(spark, sf_dir)).select("GpsTime", "point_ids", "n_returns", "z_last", F.col("top.Z").alias("z_top"), "flag", "angle")


def return_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.return_numbers(fx.points(spark, sf_dir)).select("point_id", "return_rank", "return_index")


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scan_lines(P.rays(fx.points(spark, sf_dir)))


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolate(_lined(spark, sf_dir), "GpsTime", fx.trajectory(spark, sf_dir), 1.0)


def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lined(spark, sf_dir).select("GpsTime", "line")


def trajectory_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(f"scanner_{c}", 6).alias(f"scanner_{c}") for c in "xyz"]
    return _located(spark, sf_dir).select("GpsTime", *rounded)


def ray_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ray_neighbours(_located(spark, sf_dir)).select("GpsTime", "side", "other")


def multi_echo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.multi_echo(fx.points(spark, sf_dir)).select("point_id", "gain", "is_edge")


def facade_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.multi_echo(fx.points(spark, sf_dir)).where("is_facade").select("point_id")


def single_echo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lined = _located(spark, sf_dir)
    return P.single_echo(fx.points(spark, sf_dir), lined, P.ray_neighbours(lined))


def ray_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays by their echoes, points on edges and façades, counted while the points are written."""
    counters, scratch = Counters(), Scratch(spark, "ray-counters")
    rays_ = counters.watch(P.rays(fx.points(spark, sf_dir)), rays=F.count("*"), rays_single=F.count_if(F.col("n_returns") == 1), rays_multi=F.count_if(F.col("n_returns") > 1))
    scratch.keep(rays_, "rays")
    marked = counters.watch(P.multi_echo(fx.points(spark, sf_dir)), points=F.count("*"), points_edge=F.count_if("is_edge"), points_facade=F.count_if("is_facade"))
    scratch.keep(marked, "points")
    return counters.table(spark)


def point_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.points(spark, sf_dir).select("point_id", F.round(P.weight(F.col("point_id") % 3, F.col("Classification")), 6).alias("weight"))


def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gap_runs(fx.points(spark, sf_dir), "PointSourceId", "GpsTime", "point_id", 0.5)


def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = fx.points(spark, sf_dir)
    p = cloud.where("Classification = 5").select(F.col("point_id").alias("a"), F.col("X").alias("ax"), F.col("Y").alias("ay"))
    q = cloud.where("Classification = 6").select(F.col("point_id").alias("b"), F.col("X").alias("bx"), F.col("Y").alias("by"))
    return nearest(p, q, 3, 4.0, "a", ("ax", "ay"), "b", ("bx", "by")).select("a", "b", "rank")


def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.principal_axes(fx.points(spark, sf_dir), "Classification", "X", "Y")


_PTS = fx.with_views("pts")
_ROOF = """, near AS (SELECT p.point_id, (q.X - p.X) / nullif(sqrt((q.X - p.X) * (q.X - p.X) + (q.Y - p.Y) * (q.Y - p.Y)), 0) AS ux, (q.Y - p.Y) / nullif(sqrt((q.X - p.X) * (q.X - p.X) + (q.Y - p.Y) * (q.Y - p.Y)), 0) AS uy
  FROM pts p JOIN pts q ON p.point_id <> q.point_id AND q.X BETWEEN p.X - 2 AND p.X + 2 AND abs(q.Y - p.Y) <= 2 AND (q.X - p.X) * (q.X - p.X) + (q.Y - p.Y) * (q.Y - p.Y) + (q.Z - p.Z) * (q.Z - p.Z) <= 4 AND abs(q.Z - p.Z) <= 1),
inward AS (SELECT point_id, coalesce(ix, 0) + 0.0 AS inward_x, coalesce(iy, 0) + 0.0 AS inward_y FROM pts LEFT JOIN (SELECT point_id, round(avg(coalesce(ux, 0)), 6) AS ix, round(avg(coalesce(uy, 0)), 6) AS iy FROM near GROUP BY point_id) USING (point_id))"""
_FACADE = """, near AS (SELECT p.point_id, p.Z - q.Z AS dz, (p.X - q.X) / nullif(sqrt((q.X - p.X) * (q.X - p.X) + (q.Y - p.Y) * (q.Y - p.Y)), 0) AS ux, (p.Y - q.Y) / nullif(sqrt((q.X - p.X) * (q.X - p.X) + (q.Y - p.Y) * (q.Y - p.Y)), 0) AS uy
  FROM pts p JOIN pts q ON p.point_id <> q.point_id AND q.X BETWEEN p.X - 2 AND p.X + 2 AND (q.X - p.X) * (q.X - p.X) + (q.Y - p.Y) * (q.Y - p.Y) <= 4)
SELECT point_id, coalesce(ix, 0) + 0.0 AS inward_x, coalesce(iy, 0) + 0.0 AS inward_y FROM pts LEFT JOIN (SELECT point_id, round(sum(dz * coalesce(ux, 0)) / nullif(sum(abs(dz)), 0), 6) AS ix, round(sum(dz * coalesce(uy, 0)) / nullif(sum(abs(dz)), 0), 6) AS iy FROM near GROUP BY point_id) USING (point_id)"""
_LINES = """rays AS (SELECT GpsTime, arg_min({x: X, y: Y, z: Z}, (-Z, point_id)) AS top, min(Z) AS z_last, arg_max(ScanDirectionFlag, point_id) AS flag, arg_max(ScanAngleRank, point_id) AS angle, count(*) AS n_returns FROM cloud GROUP BY GpsTime),
lined AS (SELECT *, sum(brk) OVER (ORDER BY GpsTime ROWS UNBOUNDED PRECEDING) AS line FROM (
  SELECT *, CASE WHEN GpsTime - lag(GpsTime) OVER (ORDER BY GpsTime) >= 1e-4 OR flag <> lag(flag) OVER (ORDER BY GpsTime) THEN 1 ELSE 0 END AS brk FROM rays)),
pieces AS (SELECT t, lead(t) OVER (ORDER BY t) AS t1, row_number() OVER (ORDER BY t) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM knots)),
located AS (SELECT l.*, ((1 - (GpsTime - t) / (t1 - t)) * (t * 8) + (GpsTime - t) / (t1 - t) * (t1 * 8)) AS sx, CAST(0 AS DOUBLE) AS sy, CAST(1000 AS DOUBLE) AS sz
  FROM lined l JOIN pieces ON t1 IS NOT NULL AND (k = 1 OR GpsTime >= t) AND (k = n - 1 OR GpsTime < t1))"""
_ALL = fx.with_views("pts", "knots") + ", cloud AS (SELECT * FROM pts), " + _LINES
_NEIGHBOURS = """, shape AS (SELECT GpsTime, line, angle, top.x - sx AS dx, top.y - sy AS dy, top.z - sz AS dz FROM located),
across AS (SELECT a.GpsTime, CASE WHEN b.line > a.line THEN 'next_line' ELSE 'prev_line' END AS side, b.GpsTime AS other,
   round(acos(greatest(-1.0, least(1.0, (a.dx * b.dx + a.dy * b.dy + a.dz * b.dz) / (sqrt(a.dx * a.dx + a.dy * a.dy + a.dz * a.dz) * sqrt(b.dx * b.dx + b.dy * b.dy + b.dz * b.dz))))), 9) AS turn
   FROM shape a JOIN shape b ON abs(a.line - b.line) = 1 AND abs(a.angle - b.angle) <= 1),
beside AS (
  SELECT GpsTime, 'prev' AS side, lag(GpsTime) OVER w AS other FROM located WINDOW w AS (PARTITION BY line ORDER BY GpsTime)
  UNION ALL SELECT GpsTime, 'next', lead(GpsTime) OVER w FROM located WINDOW w AS (PARTITION BY line ORDER BY GpsTime)
  UNION ALL SELECT GpsTime, side, arg_min(other, (turn, other)) FROM across GROUP BY GpsTime, side),
sides AS (SELECT * FROM beside WHERE other IS NOT NULL)"""
_ECHO = ", echo AS (SELECT *, Z - min(Z) OVER (PARTITION BY GpsTime) AS gain, row_number() OVER (PARTITION BY GpsTime ORDER BY Z, point_id DESC) = 1 AS is_last FROM {0})"
_SINGLE = """, edge_rays AS (SELECT DISTINCT GpsTime FROM echo WHERE gain > 2),
met AS (SELECT c.point_id, c.X, c.Y, c.Z, o.z_last, s.side,
    o.sx + (c.Z - o.sz) / (o.top.z - o.sz) * (o.top.x - o.sx) AS rx, o.sy + (c.Z - o.sz) / (o.top.z - o.sz) * (o.top.y - o.sy) AS ry
  FROM located l JOIN cloud c USING (GpsTime) JOIN sides s USING (GpsTime) JOIN located o ON o.GpsTime = s.other
  WHERE l.n_returns = 1 AND c.Classification NOT IN (3, 4, 5) AND o.GpsTime NOT IN (SELECT GpsTime FROM edge_rays)),
g AS (SELECT *, round(Z - z_last - sqrt((X - rx) * (X - rx) + (Y - ry) * (Y - ry)), 6) AS g,
   CASE side WHEN 'prev' THEN 0 WHEN 'next' THEN 1 WHEN 'prev_line' THEN 2 ELSE 3 END AS o FROM met),
best AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY g DESC, o DESC) AS k FROM g)
SELECT point_id, g AS gain, round((X + rx) / 2, 6) AS x, round((Y + ry) / 2, 6) AS y FROM best WHERE k = 1 AND g > 2"""

QUERIES = {f.__name__: f for f in (
    reclassify, reclassify_chain, class_filter, split_counts, merge_points, las_bounds, inward_roof, inward_facade, rays, return_numbers, scan_lines, trajectory_interp,
    ray_neighbours, multi_echo_edges, facade_points, single_echo_edges, ray_counters, point_weights, gap_runs, nearest_points, principal_axes,
)}
ORACLE_SQL = {
    "reclassify": _PTS + " SELECT CASE WHEN Classification IN (1, 64, 65, 67) THEN 6 ELSE Classification END AS Classification, count(*) AS n FROM pts GROUP BY 1",
    "reclassify_chain": _PTS + " SELECT point_id, CASE WHEN Classification IN (1, 2) THEN 9 WHEN Classification = 5 THEN 1 ELSE Classification END AS Classification FROM pts",
    "class_filter": _PTS + " SELECT point_id, Classification FROM pts WHERE Classification IN (0, 1, 2, 6, 64, 67)",
    "split_counts": _PTS + " SELECT PointSourceId, count(*) AS n FROM pts GROUP BY 1",
    "merge_points": _PTS + " SELECT point_id, X, CASE WHEN PointSourceId % 2 = 1 THEN Z END AS Z FROM pts",
    "las_bounds": _PTS + " SELECT CAST(trunc(min(X - 20.5)) AS BIGINT) AS min_x, CAST(trunc(max(X - 20.5)) AS BIGINT) AS max_x, CAST(trunc(min(Y - 20.5)) AS BIGINT) AS min_y, CAST(trunc(max(Y - 20.5)) AS BIGINT) AS max_y FROM pts",
    "inward_roof": _PTS + _ROOF + " SELECT * FROM inward",
    "inward_facade": _PTS + _FACADE,
    "rays": _PTS + " SELECT GpsTime, list(point_id ORDER BY Z DESC, point_id) AS point_ids, count(*) AS n_returns, min(Z) AS z_last, max(Z) AS z_top, arg_max(ScanDirectionFlag, point_id) AS flag, arg_max(ScanAngleRank, point_id) AS angle FROM pts GROUP BY GpsTime",
    "return_numbers": _PTS + " SELECT point_id, CAST(row_number() OVER (PARTITION BY GpsTime ORDER BY Z DESC, point_id) - 1 AS INTEGER) AS return_rank, CAST(row_number() OVER (PARTITION BY GpsTime ORDER BY point_id) - 1 AS INTEGER) AS return_index FROM pts",
    "scan_lines": _ALL + " SELECT GpsTime, CAST(line AS BIGINT) AS line FROM lined",
    "trajectory_interp": _ALL + " SELECT GpsTime, round(sx, 6) AS scanner_x, round(sy, 6) AS scanner_y, round(sz, 6) AS scanner_z FROM located",
    "ray_neighbours": _ALL + _NEIGHBOURS + " SELECT * FROM sides",
    "multi_echo_edges": _PTS + _ECHO.format("pts") + " SELECT point_id, gain, gain > 2 AS is_edge FROM echo",
    "facade_points": _PTS + _ECHO.format("pts") + " SELECT point_id FROM echo e WHERE is_last AND EXISTS (SELECT 1 FROM echo o WHERE o.GpsTime = e.GpsTime AND o.gain > 2 AND o.Classification NOT IN (3, 4, 5))",
    "single_echo_edges": _ALL + _NEIGHBOURS + _ECHO.format("cloud") + _SINGLE,
    "ray_counters": _PTS + _ECHO.format("pts") + """, r AS (SELECT GpsTime, count(*) AS n FROM pts GROUP BY GpsTime),
t AS (SELECT (SELECT count(*) FROM r) AS rays, (SELECT count(*) FROM r WHERE n = 1) AS rays_single, (SELECT count(*) FROM r WHERE n > 1) AS rays_multi, count(*) AS points, count(*) FILTER (WHERE gain > 2) AS points_edge,
  count(*) FILTER (WHERE is_last AND EXISTS (SELECT 1 FROM echo o WHERE o.GpsTime = e.GpsTime AND o.gain > 2 AND o.Classification NOT IN (3, 4, 5))) AS points_facade FROM echo e)
UNPIVOT t ON rays, rays_single, rays_multi, points, points_edge, points_facade INTO NAME counter VALUE value""",
    "point_weights": _PTS + " SELECT point_id, round(CASE point_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.2 END * CASE WHEN Classification = 6 THEN 1.0 ELSE 0.3 END, 6)::DOUBLE AS weight FROM pts",
    "gap_runs": _PTS + """, s AS (SELECT *, coalesce(CAST(GpsTime - lag(GpsTime) OVER (PARTITION BY PointSourceId ORDER BY GpsTime, point_id) > 0.5 AS INTEGER), 0) AS brk FROM pts),
r AS (SELECT *, sum(brk) OVER (PARTITION BY PointSourceId ORDER BY GpsTime, point_id ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT PointSourceId, CAST(run AS BIGINT) AS run, count(*) AS n, min(GpsTime) AS low, max(GpsTime) AS high FROM r GROUP BY PointSourceId, run""",
    "nearest_points": _PTS + """, d AS (SELECT p.point_id AS a, q.point_id AS b, row_number() OVER (PARTITION BY p.point_id ORDER BY (p.X - q.X) * (p.X - q.X) + (p.Y - q.Y) * (p.Y - q.Y), q.point_id) AS rank
  FROM pts p JOIN pts q ON p.Classification = 5 AND q.Classification = 6 AND q.X BETWEEN p.X - 4 AND p.X + 4 AND (p.X - q.X) * (p.X - q.X) + (p.Y - q.Y) * (p.Y - q.Y) <= 16)
SELECT a, b, CAST(rank AS INTEGER) AS rank FROM d WHERE rank <= 3""",
    "principal_axes": _PTS + """, c AS (SELECT Classification, var_pop(X) AS xx, var_pop(Y) AS yy, covar_pop(X, Y) AS xy FROM pts GROUP BY 1)
SELECT Classification, round((xx + yy) / 2 - sqrt(((xx - yy) / 2) * ((xx - yy) / 2) + xy * xy), 4) AS least, round((xx + yy) / 2 + sqrt(((xx - yy) / 2) * ((xx - yy) / 2) + xy * xy), 4) AS most FROM c""",
}
