"""Queries that score and move edges, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import lines3d, optimise, outline
from plumbline.operators import points as P
from plumbline.operators.keys import shuffled
from plumbline.plans import flows
from plumbline.plans.queries_points import _PTS, _ROOF
from plumbline.plans.scratch import Scratch
from plumbline.sources import fixtures as fx
from plumbline.sources import synthetic


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scratch(spark, "optimise").keep(outline.keyed_edges(spark, fx.buildings(spark, sf_dir)), "edges")


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = fx.points(spark, sf_dir)
    return cloud.join(shuffled(P.inward_roof(cloud)), "point_id").withColumn("weight", F.round(P.weight(F.lit(0), F.col("Classification")), 6))


def roof_offset_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return optimise.best_offsets(edges, optimise.roof_scores(edges, _weighted(spark, sf_dir))).select("edge_key", "k", "metric")


def foot_offset_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    cloud = fx.points(spark, sf_dir).withColumn("weight", F.round(P.weight(F.lit(0), F.col("Classification")), 6))
    return optimise.best_offsets(edges, optimise.foot_scores(edges, cloud)).select("edge_key", "k", "metric")


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return optimise.edge_groups(spark, edges, outline.edge_overlaps(edges))


def edge_group_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select("edge_key", "group_id", "group_length")


def optimised_roofprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = optimise.units(spark, _grouped(spark, sf_dir))
    return optimise.optimise(spark, grouped, _weighted(spark, sf_dir), "roof", 3, unit_edges=0)


def optimised_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints from the outlines as they are, and from the same outlines half a metre off."""
    edges = _edges(spark, sf_dir)
    off = edges.withColumns({"start_x": F.col("start_x") + 0.5, "end_x": F.col("end_x") + 0.5})
    return flows.footprints_of(spark, {"outlines": edges, "shifted": off}, fx.points(spark, sf_dir), fx.faces(spark, sf_dir), 1)


def circle_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = synthetic.circle_points(spark, 400, 20.0, 0.05)
    return optimise.optimise(spark, synthetic.circle_edges(spark, 12, 20.0, 0.6), points, "roof", 3).select("edge_key", F.round("start_x", 3).alias("x"), F.round("start_y", 3).alias("y"), "status")


def _edge_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = fx.block_edges(spark, sf_dir)
    met = optimise.edge_points(edges.drop("z", "k"), fx.eaves(spark, sf_dir), 0.3)
    return edges, lines3d.edge_lines(met.where(F.col("size") >= lines3d.LEAST_EDGE))


def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [F.round(c, 6).alias(c) for c in ("x0", "y0", "z0", "x1", "y1", "z1")]
    # A line's two ends come in either order.
    first = F.struct("x0", "y0", "z0") < F.struct("x1", "y1", "z1")
    turned = [F.when(first, F.col(f"{c}{i}")).otherwise(F.col(f"{c}{1 - i}")).alias(f"{c}{i}") for i in (0, 1) for c in "xyz"]
    return _edge_lines(spark, sf_dir)[1].select("edge_key", "segment", "n_inliers", F.round("score", 6).alias("score"), *ends).select("edge_key", "segment", "n_inliers", "score", *turned)


def edge_lines_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines3d.connected_lines(*_edge_lines(spark, sf_dir)).select("edge_key", F.posexplode("points").alias("i", "p"))
    return found.select("edge_key", "i", *[F.round(f"p.{c}", 6).alias(c) for c in "xyz"])


def interval_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fx.buildings(spark, sf_dir).select("k", "x0", "x1")
    s = b.select((F.col("k") - 40).alias("k"), (F.col("x0") + (F.col("k") % 5) - 2).alias("b0"), (F.col("x1") + (F.col("k") % 3) - 1).alias("b1"))
    return b.join(shuffled(s), "k").select("k", lines3d.interval_relation(F.col("x0"), F.col("x1"), F.col("b0"), F.col("b1")).alias("relation"))


_LINE = """, e AS (SELECT *, (end_x - start_x) / sqrt((end_x - start_x) ^ 2 + (end_y - start_y) ^ 2) AS ux, (end_y - start_y) / sqrt((end_x - start_x) ^ 2 + (end_y - start_y) ^ 2) AS uy, sqrt((end_x - start_x) ^ 2 + (end_y - start_y) ^ 2) AS size FROM edges),
met AS (SELECT edge_key, p.*, (p.X - start_x) * ux + (p.Y - start_y) * uy AS along, (p.X - start_x) * uy - (p.Y - start_y) * ux AS s, -uy AS nx, ux AS ny, size
  FROM e JOIN cloud p ON p.X BETWEEN least(start_x, end_x) - 2.5 AND greatest(start_x, end_x) + 2.5 AND p.Y BETWEEN least(start_y, end_y) - 2.5 AND greatest(start_y, end_y) + 2.5),
held AS (SELECT * FROM met WHERE along >= 0 AND along <= size)"""
_BEST = """, every AS (SELECT edge_key, k, metric FROM scores UNION ALL SELECT edge_key, 0, 0.0 FROM edges),
summed AS (SELECT edge_key, k, sum(metric) AS metric FROM every GROUP BY edge_key, k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY edge_key ORDER BY round(metric + 1e-6 * abs(k * 0.05::DOUBLE), 9), CASE WHEN k = 0 THEN 0 WHEN k < 0 THEN -2 * k - 1 ELSE 2 * k END) AS n FROM summed)
SELECT edge_key, CAST(k AS BIGINT) AS k, metric FROM ranked WHERE n = 1"""
# Edges of the houses that stand alone, and their two lines as distances and heights.
_EAVES = fx.with_views("bld") + """, g AS (SELECT k, z, CAST(10 * (k % 40) AS DOUBLE) AS gx, CAST(10 * (k // 40) AS DOUBLE) AS gy, x1 - x0 AS w, y1 - y0 AS h FROM bld),
e AS (SELECT 4 * k + n AS edge_key, k, z, gx + sx * w AS ax, gy + sy * h AS ay, CAST(vx AS DOUBLE) AS ux, CAST(vy AS DOUBLE) AS uy, CASE WHEN vx = 0 THEN h ELSE w END AS size
  FROM g, (VALUES (0, 0, 0, 1, 0), (1, 1, 0, 0, 1), (2, 1, 1, -1, 0), (3, 0, 1, 0, -1)) v(n, sx, sy, vx, vy)),
l AS (SELECT edge_key, 0 AS segment, 13 AS n, CAST(0 AS DOUBLE) AS t0, CAST(1.5 AS DOUBLE) AS t1, z AS h0, z + 0.75 AS h1 FROM e
  UNION ALL SELECT edge_key, 1, 11, CAST(CASE k % 3 WHEN 1 THEN 2.25 WHEN 2 THEN 1.0 ELSE 1.625 END AS DOUBLE), CAST(CASE k % 3 WHEN 2 THEN 2.25 ELSE 2.875 END AS DOUBLE),
    z + CASE k % 3 WHEN 0 THEN 8.8125 WHEN 1 THEN 3.9375 ELSE 8.5 END, z + CASE k % 3 WHEN 0 THEN 9.4375 WHEN 1 THEN 8.9375 ELSE 9.125 END FROM e)"""
_WEIGHT = "CAST(CASE WHEN Classification = 6 THEN 1.0 ELSE 0.3 END AS DOUBLE) AS weight"
QUERIES = {f.__name__: f for f in (roof_offset_argmin, foot_offset_argmin, edge_group_length, optimised_roofprints, optimised_footprints, circle_experiment, edge_lines, edge_lines_connected, interval_relation)}
ORACLE_SQL = {
    "roof_offset_argmin": fx.with_views("pts", "edges") + _ROOF + f""", cloud AS (SELECT pts.*, inward_x, inward_y, {_WEIGHT} FROM pts JOIN inward USING (point_id))""" + _LINE + """,
v AS (SELECT edge_key, k, abs(s - k * 0.05::DOUBLE) AS d, weight * (inward_x * nx + inward_y * ny) AS w FROM held, (SELECT unnest(range(-40, 41)) AS k) WHERE inward_x * nx + inward_y * ny > 0),
scores AS (SELECT edge_key, k, round(-3 * sum(w * (1 - d / 0.3::DOUBLE)), 6) AS metric FROM v WHERE d <= 0.3::DOUBLE GROUP BY edge_key, k)""" + _BEST,
    "foot_offset_argmin": fx.with_views("pts", "edges") + f""", cloud AS (SELECT *, {_WEIGHT} FROM pts WHERE Classification NOT IN (3, 4, 5))""" + _LINE + """,
v AS (SELECT edge_key, k, round(k * 0.05::DOUBLE - s, 9) AS i, weight, Classification = 2 AS ground FROM held, (SELECT unnest(range(-30, 31)) AS k)),
scores AS (SELECT edge_key, k, round(sum(CASE WHEN i >= -0.3::DOUBLE AND i < 0.3::DOUBLE THEN -weight * (1 - abs(i) / 0.3::DOUBLE) * CASE WHEN ground THEN 0.3::DOUBLE ELSE 1 END
   ELSE weight * least((i - 0.3::DOUBLE) / 0.3::DOUBLE, 1) * CASE WHEN ground THEN 1 ELSE 0.3::DOUBLE END END), 6) AS metric FROM v WHERE i >= -0.3::DOUBLE AND i <= 0.6::DOUBLE GROUP BY edge_key, k)""" + _BEST,
    "edge_group_length": fx.with_views("overlaps") + """, w(root, node) AS (SELECT edge_key, edge_key FROM edges UNION SELECT root, b FROM w JOIN (SELECT edge_key_a AS a, edge_key_b AS b FROM shared_walls UNION SELECT edge_key_b, edge_key_a FROM shared_walls) ON a = node),
g AS (SELECT node AS edge_key, min(root) AS group_id FROM w GROUP BY node)
SELECT edge_key, group_id, sum(abs(end_x - start_x) + abs(end_y - start_y)) OVER (PARTITION BY group_id) AS group_length FROM g JOIN edges USING (edge_key)""",
    "edge_lines": _EAVES + """, p AS (SELECT edge_key, segment, n, ax + t0 * ux AS px, ay + t0 * uy AS py, h0 AS pz, ax + t1 * ux AS qx, ay + t1 * uy AS qy, h1 AS qz FROM l JOIN e USING (edge_key))
SELECT edge_key, CAST(segment AS INTEGER) AS segment, CAST(n AS INTEGER) AS n_inliers, CAST(n AS DOUBLE) AS score,
   CASE WHEN f THEN px ELSE qx END AS x0, CASE WHEN f THEN py ELSE qy END AS y0, CASE WHEN f THEN pz ELSE qz END AS z0,
   CASE WHEN f THEN qx ELSE px END AS x1, CASE WHEN f THEN qy ELSE py END AS y1, CASE WHEN f THEN qz ELSE pz END AS z1
FROM (SELECT *, (px, py, pz) < (qx, qy, qz) AS f FROM p)""",
    "edge_lines_connected": _EAVES + """, n AS (SELECT edge_key, k, z, ax, ay, ux, uy, size, unnest(range(0, CASE k % 3 WHEN 1 THEN 3 ELSE 4 END)) AS i FROM e),
c AS (SELECT *, CASE WHEN i = 0 THEN 0 WHEN i = CASE k % 3 WHEN 1 THEN 2 ELSE 3 END THEN size WHEN k % 3 = 1 THEN 1.875 WHEN k % 3 = 2 THEN 1.5 ELSE 1.5625 END AS t,
  i < 2 AS low FROM n),
d AS (SELECT *, z + CASE WHEN low THEN t / 2 WHEN k % 3 = 1 THEN 0.9375 + 8 * (t - 1.875) ELSE 8 + t / 2 END AS h FROM c)
SELECT edge_key, CAST(i AS INTEGER) AS i, round(ax + t * ux, 6)::DOUBLE AS x, round(ay + t * uy, 6)::DOUBLE AS y, round(h, 6)::DOUBLE AS z FROM d""",
    "interval_relation": fx.with_views("bld") + """, p AS (SELECT a.k, a.x0 AS a0, a.x1 AS a1, b.x0 + b.k % 5 - 2 AS b0, b.x1 + b.k % 3 - 1 AS b1 FROM bld a JOIN bld b ON b.k = a.k + 40)
SELECT k, CASE WHEN b1 <= a0 THEN 'none_before' WHEN b0 >= a1 THEN 'none_after' WHEN b0 <= a0 AND b1 >= a1 THEN 'full_covers' WHEN b0 >= a0 AND b1 <= a1 THEN 'full_inside' WHEN b0 < a0 THEN 'partial_before' ELSE 'partial_after' END AS relation FROM p""",
}
