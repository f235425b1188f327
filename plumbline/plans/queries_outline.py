"""Queries over outlines: edges, overlaps, groups, crops, tiles and parameter grids; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geo
from plumbline.operators import grids, outline
from plumbline.operators.keys import cyclic
from plumbline.operators.simplify import simplify
from plumbline.plans.scratch import Scratch
from plumbline.sources import fixtures as fx
from plumbline.sources import readers

CROP = (10.0, 3.0, 120.0, 90.0)
EDGE_COLUMNS = ["edge_key", "cleabs", "idx_polygon", "idx_ring", "idx_edge", "start_x", "start_y", "start_z", "end_x", "end_y", "end_z"]


def edges_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.keyed_edges(spark, fx.buildings(spark, sf_dir)).select(*EDGE_COLUMNS)


def edge_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.edge_overlaps(outline.keyed_edges(spark, fx.buildings(spark, sf_dir))).select("edge_key_a", "edge_key_b", "length")


def _parts(spark: SparkSession, sf_dir: str, true_components: bool = False):
    scratch = Scratch(spark, "outline")
    buildings = fx.buildings(spark, sf_dir)
    keyed = scratch.keep(outline.keyed_edges(spark, buildings), "edges")
    overlaps = scratch.keep(outline.edge_overlaps(keyed), "overlaps")
    roots = (outline.component_roots if true_components else outline.reachable_roots)(spark, buildings, outline.building_links(overlaps))
    return keyed, overlaps, outline.building_groups(spark, buildings, roots)


def building_groups_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[2].select("group_id", "cleabs_list", F.size("cleabs_list").cast("long").alias("num_buildings"))


def building_groups_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, True)[2].select("group_id", "cleabs_list", F.size("cleabs_list").cast("long").alias("num_buildings"))


def group_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[2].select("group_id", "xmin", "ymin", "xmax", "ymax")


def crop_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed, overlaps, groups = _parts(spark, sf_dir)
    return outline.crop(groups, keyed, overlaps, CROP)[0].select("group_id", "cleabs_list")


def crop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed, overlaps, groups = _parts(spark, sf_dir)
    return outline.crop(groups, keyed, overlaps, CROP)[1].select(*EDGE_COLUMNS)


def crop_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed, overlaps, groups = _parts(spark, sf_dir)
    return outline.crop(groups, keyed, overlaps, CROP)[2].select("edge_key_a", "edge_key_b")


def bbox_hilbert_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.hilbert_order(fx.buildings(spark, sf_dir), ("x0", "y0", "x1", "y1"), 8).select("cleabs", "hilbert")


def rebuild_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = outline.rebuild(outline.keyed_edges(spark, fx.buildings(spark, sf_dir)))
    size = F.aggregate(F.flatten("geometry"), F.lit(0), lambda s, r: s + F.size(r))
    return out.select("cleabs", F.size(F.element_at("geometry", 1)).cast("long").alias("n_rings"), size.cast("long").alias("n_points"))


def edge_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge with those before and after it in its ring."""
    edges = outline.keyed_edges(spark, fx.buildings(spark, sf_dir))
    return cyclic(edges, ["cleabs", "idx_polygon", "idx_ring"], "idx_edge", {"before": F.col("edge_key"), "after": F.col("edge_key")}).select("edge_key", "before", "after")


def simplified_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines with a vertex at every metre, without those that no ring needs: points of each, and the area."""
    out = simplify(spark, fx.dense(spark, sf_dir), "cleabs", "geometry")
    return out.select("cleabs", F.aggregate(F.flatten("geometry"), F.lit(0), lambda s, r: s + F.size(r) - 1).cast("long").alias("n_points"), F.aggregate("geometry", F.lit(0.0), lambda s, p: s + geo.polygon_area(p)).alias("area"))


def known_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the cropped edges in the overlaps of all edges, as they are read from files."""
    return _read_known(spark, sf_dir)[0].select("edge_key_a", "edge_key_b", "row_a", "row_b")


def _read_known(spark: SparkSession, sf_dir: str):
    scratch = Scratch(spark, "known")
    keyed, overlaps, groups = _parts(spark, sf_dir)
    scratch.keep(outline.crop(groups, keyed, overlaps, CROP)[1], "edges")
    scratch.keep(overlaps, "overlaps")
    _, met, counters = readers.read_edges(spark, scratch.path("edges"), scratch.path("overlaps"))
    return scratch.keep(met, "met"), counters


def overlap_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many overlaps were read and skipped there, counted in the same pass."""
    return _read_known(spark, sf_dir)[1].table(spark)


def scored_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that suppliers' keys name, by a list or a range that the scan is told."""
    ids = fx.table(spark, sf_dir, "supplier").select("s_suppkey")
    return readers.read_scored(spark, f"{sf_dir}/part.parquet", ids, "p_partkey", ["p_size", "p_brand"])


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = fx.points(spark, sf_dir).agg(*[F.expr(f"cast({f}({c} * 40) as bigint)").alias(f"{c.lower()}{n}") for c in "XY" for f, n in (("min", 0), ("max", 1))])
    return grids.tiles(box, 1000).select("tile_x", "tile_y", "name")


def best_tile_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = fx.buildings(spark, sf_dir).select("cleabs", "x0", "y0", "x1", "y1")
    offered = fx.scored(spark, sf_dir).select(F.col("cleabs").alias("url"), "sx0", "sy0", "sx1", "sy1")
    return grids.best_overlap(wanted, offered, ("x0", "y0", "x1", "y1"), ("sx0", "sy0", "sx1", "sy1"), "cleabs", "url", 0.6)


def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"fixed": {"noise": 1, "points": 100}, "variable": [[{"radius": 1}, {"radius": 2}], [{"noise": 3}, {"noise": 4}, {"noise": 5, "radius": 9}]]}
    return grids.parameter_grid(spark, spec)


_REACH = """, reach(root, node) AS (SELECT src, src FROM links UNION SELECT r.root, e.dst FROM reach r JOIN links e ON e.src = r.node),
roots AS (SELECT cleabs, coalesce(min(root), cleabs) AS root_id FROM bld LEFT JOIN reach ON node = cleabs GROUP BY cleabs)"""
_CC = """, walk(root, node) AS (SELECT cleabs, cleabs FROM bld UNION SELECT w.root, e.b FROM walk w JOIN (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links) e ON e.a = w.node),
roots AS (SELECT node AS cleabs, min(root) AS root_id FROM walk GROUP BY node)"""
_GROUPS = """, bgroups AS (SELECT row_number() OVER (ORDER BY root_id) AS group_id, list(cleabs ORDER BY cleabs) AS cleabs_list,
  min(x0) AS xmin, min(y0) AS ymin, max(x1) AS xmax, max(y1) AS ymax FROM roots JOIN bld USING (cleabs) GROUP BY root_id)"""
_CROP = """, kept AS (SELECT * FROM bgroups WHERE xmin >= 10 AND ymin >= 3 AND xmax <= 120 AND ymax <= 90),
own AS (SELECT * FROM edges WHERE cleabs IN (SELECT unnest(cleabs_list) FROM kept))"""
_EDGES = ", ".join(EDGE_COLUMNS)
REACH = fx.with_views("links") + _REACH + _GROUPS
HILBERT_SQL = fx.with_views("bld") + """,
b AS (SELECT min(x0) AS a0, min(y0) AS b0, max(x1) AS a1, max(y1) AS b1 FROM bld),
h(cleabs, x, y, d, n) AS (
  SELECT cleabs, CAST(floor(((x0 + x1) / 2 - a0) / (a1 - a0) * 255) AS BIGINT), CAST(floor(((y0 + y1) / 2 - b0) / (b1 - b0) * 255) AS BIGINT), CAST(0 AS BIGINT), CAST(128 AS BIGINT) FROM bld, b
  UNION ALL
  SELECT cleabs,
    CASE WHEN (y & n) = 0 THEN CASE WHEN (x & n) > 0 THEN 255 - y ELSE y END ELSE x END,
    CASE WHEN (y & n) = 0 THEN CASE WHEN (x & n) > 0 THEN 255 - x ELSE x END ELSE y END,
    d + n * n * xor(CASE WHEN (x & n) > 0 THEN 3 ELSE 0 END, CASE WHEN (y & n) > 0 THEN 1 ELSE 0 END), n // 2
  FROM h WHERE n > 0)
SELECT cleabs, d AS hilbert FROM h WHERE n = 0"""
TILES_SQL = fx.with_views("pts") + """, b AS (SELECT CAST(trunc(min(X * 40)) AS BIGINT) AS x0, CAST(trunc(max(X * 40)) AS BIGINT) AS x1, CAST(trunc(min(Y * 40)) AS BIGINT) AS y0, CAST(trunc(max(Y * 40)) AS BIGINT) AS y1 FROM pts)
SELECT tile_x, tile_y, lpad(CAST(tile_x AS VARCHAR), 4, '0') || '_' || lpad(CAST(tile_y AS VARCHAR), 4, '0') AS name
FROM b, LATERAL (SELECT unnest(range(x0 // 1000, (x1 - 1) // 1000 + 1)) AS tile_x) tx, LATERAL (SELECT unnest(range(y0 // 1000, (y1 - 1) // 1000 + 1)) AS tile_y) ty"""
BEST_SQL = fx.with_views("scored") + """, o AS (SELECT b.cleabs, s.cleabs AS url,
  greatest(0, least(x1, sx1) - greatest(x0, sx0)) * greatest(0, least(y1, sy1) - greatest(y0, sy0)) / ((x1 - x0) * (y1 - y0)) AS overlap
  FROM bld b JOIN scored s ON x0 <= sx1 AND sx0 <= x1 AND y0 <= sy1 AND sy0 <= y1)
SELECT cleabs, arg_max(url, (overlap, -CAST(substr(url, 9) AS BIGINT))) AS url, round(max(overlap), 6) AS overlap FROM o GROUP BY cleabs HAVING max(overlap) > 0.6"""
PARAM_SQL = """SELECT CAST(n AS BIGINT) AS experiment, CAST(noise AS BIGINT) AS noise, CAST(100 AS BIGINT) AS points, CAST(radius AS BIGINT) AS radius
FROM (VALUES (0, 3, 1), (1, 4, 1), (2, 5, 9), (3, 3, 2), (4, 4, 2), (5, 5, 9)) t(n, noise, radius)"""

QUERIES = {
    "edges_unnest": edges_unnest,
    "edge_overlaps": edge_overlaps,
    "building_groups_reach": building_groups_reach,
    "building_groups_cc": building_groups_cc,
    "group_extents": group_extents,
    "crop_groups": crop_groups,
    "crop_edges": crop_edges,
    "crop_intersections": crop_intersections,
    "bbox_hilbert_order": bbox_hilbert_order,
    "rebuild_outlines": rebuild_outlines,
    "tile_grid": tile_grid,
    "best_tile_match": best_tile_match,
    "param_grid": param_grid,
    "edge_neighbours": edge_neighbours,
    "simplified_outlines": simplified_outlines,
    "known_overlaps": known_overlaps,
    "overlap_counters": overlap_counters,
    "scored_scan": scored_scan,
}
ORACLE_SQL = {
    "edges_unnest": fx.with_views("edges") + f" SELECT {_EDGES} FROM edges",
    "edge_overlaps": fx.with_views("overlaps") + " SELECT edge_key_a, edge_key_b, length FROM shared_walls",
    "building_groups_reach": REACH + " SELECT group_id, cleabs_list, len(cleabs_list) AS num_buildings FROM bgroups",
    "building_groups_cc": fx.with_views("links") + _CC + _GROUPS + " SELECT group_id, cleabs_list, len(cleabs_list) AS num_buildings FROM bgroups",
    "group_extents": REACH + " SELECT group_id, xmin, ymin, xmax, ymax FROM bgroups",
    "crop_groups": REACH + _CROP + " SELECT group_id, cleabs_list FROM kept",
    "crop_edges": REACH + _CROP + f" SELECT {_EDGES} FROM own",
    "crop_intersections": REACH + _CROP + " SELECT edge_key_a, edge_key_b FROM shared_walls WHERE edge_key_a IN (SELECT edge_key FROM own) AND edge_key_b IN (SELECT edge_key FROM own)",
    "bbox_hilbert_order": HILBERT_SQL,
    "rebuild_outlines": fx.with_views("verts") + " SELECT cleabs, max(ring) + 1 AS n_rings, count(*) AS n_points FROM verts GROUP BY cleabs",
    "tile_grid": TILES_SQL,
    "best_tile_match": BEST_SQL,
    "param_grid": PARAM_SQL,
    "edge_neighbours": fx.with_views("edges") + """ SELECT edge_key, coalesce(lag(edge_key) OVER w, last_value(edge_key) OVER a) AS before, coalesce(lead(edge_key) OVER w, first_value(edge_key) OVER a) AS after FROM edges
  WINDOW w AS (PARTITION BY cleabs, idx_polygon, idx_ring ORDER BY idx_edge), a AS (PARTITION BY cleabs, idx_polygon, idx_ring ORDER BY idx_edge ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    # A point along a wall stays only where another outline turns.
    "simplified_outlines": fx.with_views("verts") + """, turns AS (SELECT DISTINCT x, y FROM verts),
along AS (SELECT cleabs, x, y FROM bld, LATERAL (SELECT unnest(range(CAST(x0 AS BIGINT) + 1, CAST(x1 AS BIGINT))) AS x) u, LATERAL (VALUES (y0), (y1)) v(y)
  UNION ALL SELECT cleabs, x, y FROM bld, LATERAL (SELECT unnest(range(CAST(y0 AS BIGINT) + 1, CAST(y1 AS BIGINT))) AS y) u, LATERAL (VALUES (x0), (x1)) v(x)),
kept AS (SELECT cleabs, count(*) AS n FROM along JOIN turns ON along.x = turns.x AND along.y = turns.y GROUP BY cleabs)
SELECT cleabs, CAST(CASE WHEN k % 7 = 0 THEN 8 ELSE 4 END + coalesce(n, 0) AS BIGINT) AS n_points, (x1 - x0) * (y1 - y0) - CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS area FROM bld LEFT JOIN kept USING (cleabs)""",
    "known_overlaps": REACH + _CROP + """, r AS (SELECT edge_key, row_number() OVER (ORDER BY edge_key) - 1 AS row FROM own)
SELECT edge_key_a, edge_key_b, a.row AS row_a, b.row AS row_b FROM shared_walls JOIN r a ON a.edge_key = edge_key_a JOIN r b ON b.edge_key = edge_key_b""",
    "overlap_counters": REACH + _CROP + """, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE edge_key_a NOT IN (SELECT edge_key FROM own) OR edge_key_b NOT IN (SELECT edge_key FROM own)) AS s FROM shared_walls)
SELECT 'overlaps_read' AS counter, n AS value FROM c UNION ALL SELECT 'overlaps_skipped', s FROM c""",
    "scored_scan": "SELECT p_partkey, p_size, p_brand FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)",
}
