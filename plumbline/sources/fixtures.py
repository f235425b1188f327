"""Deterministic geometry from the supplied tables, in Spark and as SQL common table expressions.

Coordinates are multiples of 1/8, so both engines compute them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column, z: Column) -> Column:
    """Counter-clockwise ring."""
    return F.array(*[_point(x, y, z) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])


def buildings(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Source outlines: cleabs, k, z, box columns and a multipolygon; every seventh has a hole.

    A small file is read by one task, whatever is made from it; ``dealt`` rows are spread over all tasks first.
    """
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    part = part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey") if dealt else part
    b = part.select(
        F.concat(F.lit("BATIMENT"), F.lpad(k.cast("string"), 16, "0")).alias("cleabs"), k.alias("k"), (F.col("p_size") % 8).cast("double").alias("z"),
        (4 * (k % 40)).cast("double").alias("x0"), (4 * F.floor(k / 40)).cast("double").alias("y0"), F.col("p_size").alias("s"),
    )
    b = b.withColumns({"x1": F.col("x0") + 3 + F.col("s") % 2, "y1": F.col("y0") + 3 + F.floor(F.col("s") / 2) % 2}).drop("s")
    outer = rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("z"))
    hole = F.reverse(rectangle(F.col("x0") + 1, F.col("y0") + 1, F.col("x0") + 2, F.col("y0") + 2, F.col("z")))
    return b.withColumn("geometry", F.array(F.when(k_of(7), F.array(outer, hole)).otherwise(F.array(outer))))


def k_of(n: int) -> Column:
    return F.col("k") % n == 0


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A laser cloud: point_id, ray, X, Y, Z, Classification, GpsTime, ScanDirectionFlag, ScanAngleRank, PointSourceId.

    Two points share a GPS time, but every third pair has a time for each, so its rays have one return.
    """
    i = F.col("event_id")
    ray = F.floor(i / 2)
    apart = F.when(ray % 3 == 0, i % 2).otherwise(0) / 65536
    kind = F.col("event_type")
    classes = F.when(kind == "click", 6).when(kind == "view", 2).when(kind == "purchase", 1).when(kind == "signup", 5).otherwise(67)
    return table(spark, sf_dir, "events").select(
        i.alias("point_id"), ray.alias("ray"), ((i * 37 % 1280) / 8).alias("X"), ((i * 101 % 1600) / 8).alias("Y"), ((i * 13 % 160) / 8).alias("Z"), classes.alias("Classification"),
        (ray / 32768 + apart + F.floor(ray / 50)).alias("GpsTime"), (F.floor(i / 100) % 2).cast("int").alias("ScanDirectionFlag"), (ray % 25).cast("int").alias("ScanAngleRank"), (F.col("user_id") % 4).cast("int").alias("PointSourceId"),
    )


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knots (seq, t, x, y, z), one per 500 events."""
    i = F.col("event_id")
    t = F.floor(i / 2) / 32768 + F.floor(F.floor(i / 2) / 50)
    return table(spark, sf_dir, "events").where(i % 500 == 250).select(i.alias("seq"), t.alias("t"), (t * 8).alias("x"), F.lit(0.0).alias("y"), F.lit(1000.0).alias("z"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines to be scored: the buildings shifted by up to one, every eleventh missing; id, boxes."""
    dx = (F.col("k") % 3) / 2
    return buildings(spark, sf_dir).where(~k_of(11)).select("cleabs", (F.col("x0") + dx).alias("sx0"), F.col("y0").alias("sy0"), (F.col("x1") + dx).alias("sx1"), F.col("y1").alias("sy1"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One roof face per building on the plane z = x/8 + y/16 + z0."""
    z = lambda x, y: x / 8 + y / 16 + F.col("z")
    corners = [(F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y0")), (F.col("x1"), F.col("y1")), (F.col("x0"), F.col("y1")), (F.col("x0"), F.col("y0"))]
    ring = F.array(*[_point(x, y, z(x, y)) for x, y in corners])
    return buildings(spark, sf_dir).select("cleabs", F.lit(0).alias("face"), F.array(ring).alias("polygon"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buildings with a vertex at every metre of their outlines (cleabs, geometry)."""
    along = lambda a, b: F.transform(F.sequence(F.lit(0), (F.abs(b["x"] - a["x"]) + F.abs(b["y"] - a["y"])).cast("int") - 1), lambda i: F.struct((a["x"] + i * F.signum(b["x"] - a["x"])).alias("x"), (a["y"] + i * F.signum(b["y"] - a["y"])).alias("y")))
    closed = lambda r: F.concat(F.flatten(F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), along)), F.transform(F.slice(r, 1, 1), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))))
    return buildings(spark, sf_dir, dealt=True).select("cleabs", F.transform("geometry", lambda p: F.transform(p, closed)).alias("geometry"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Houses on a grid of ten metres, so that none is near another: cleabs, k, box columns and geometry."""
    b = buildings(spark, sf_dir).select("cleabs", "k", "z", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    b = b.select("cleabs", "k", "z", (10 * (F.col("k") % 40)).cast("double").alias("x0"), (10 * F.floor(F.col("k") / 40)).cast("double").alias("y0"), "w", "h")
    b = b.withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("h")}).drop("w", "h")
    return b.withColumn("geometry", F.array(F.array(rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("z")))))


def block_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four edges of each of these houses, with a key of their own: 4 * k + the edge's number."""
    corner = lambda i, c: F.col("geometry")[0][0][i][c]
    e = blocks(spark, sf_dir).select("cleabs", "k", "z", "geometry", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("idx_edge"))
    return e.select((4 * F.col("k") + F.col("idx_edge")).alias("edge_key"), "cleabs", F.lit(0).alias("idx_polygon"), F.lit(0).alias("idx_ring"), "idx_edge", F.col("k"), "z", *[corner(F.col("idx_edge") + j, c).alias(f"{n}_{c}") for n, j in (("start", 0), ("end", 1)) for c in "xy"])


def eaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of two lines along each of these edges (point_id, X, Y, Z): 13 that rise from the edge's start, and 11 that go on behind a
    gap 8 higher (k % 3 = 0), behind a gap on a steep line that the other one meets there (1), or over the other one's
    end 8 higher (2)."""
    e = block_edges(spark, sf_dir).select("edge_key", "k", "z", "start_x", "start_y", F.signum(F.col("end_x") - F.col("start_x")).alias("ux"), F.signum(F.col("end_y") - F.col("start_y")).alias("uy"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("j"))
    n, kind = F.col("j") - 13, F.col("k") % 3
    t = F.when(F.col("j") < 13, F.col("j") / 8).when(kind == 1, 2.25 + n / 16).when(kind == 2, 1 + n / 8).otherwise(1.625 + n / 8)
    z = F.when(F.col("j") < 13, t / 2).when(kind == 1, 0.9375 + 8 * (t - 1.875)).otherwise(8 + t / 2)
    e = e.withColumn("t", t)
    return e.select((F.col("edge_key") * 24 + F.col("j")).alias("point_id"), (F.col("start_x") + F.col("t") * F.col("ux")).alias("X"), (F.col("start_y") + F.col("t") * F.col("uy")).alias("Y"), (F.col("z") + z).alias("Z"))


def slanted(spark: SparkSession, sf_dir: str, inner: bool = True) -> DataFrame:
    """The buildings with their holes, leaned over (x + y / 2), and in every other hole a house that fills it: cleabs, geometry."""
    lean = lambda c: F.transform(c, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.struct((q["x"] + q["y"] / 2).alias("x"), q["y"].alias("y")))))
    b = buildings(spark, sf_dir)
    own = b.select("cleabs", lean("geometry").alias("geometry"))
    fill = b.where(k_of(14)).select(F.concat(F.lit("INNER"), F.col("cleabs")).alias("cleabs"), lean(F.array(F.array(F.col("geometry")[0][1]))).alias("geometry"))
    return own.unionByName(fill) if inner else own


#: The same views in SQL, each after those that it needs.
SQL = {
    "bld": """bld AS (SELECT *, x0 + 3 + s % 2 AS x1, y0 + 3 + (s // 2) % 2 AS y1 FROM (
        SELECT 'BATIMENT' || lpad(CAST(p_partkey AS VARCHAR), 16, '0') AS cleabs, p_partkey AS k, CAST(p_size % 8 AS DOUBLE) AS z,
               CAST(4 * (p_partkey % 40) AS DOUBLE) AS x0, CAST(4 * (p_partkey // 40) AS DOUBLE) AS y0, p_size AS s FROM part))""",
    "verts": """verts AS (
        SELECT cleabs, 0 AS ring, v.i AS i, v.x AS x, v.y AS y, z FROM bld, LATERAL (VALUES (0, x0, y0), (1, x1, y0), (2, x1, y1), (3, x0, y1), (4, x0, y0)) v(i, x, y)
        UNION ALL
        SELECT cleabs, 1, v.i, v.x, v.y, z FROM bld, LATERAL (VALUES (0, x0 + 1, y0 + 1), (1, x0 + 1, y0 + 2), (2, x0 + 2, y0 + 2), (3, x0 + 2, y0 + 1), (4, x0 + 1, y0 + 1)) v(i, x, y) WHERE k % 7 = 0)""",
    "edges": """edges AS (
        SELECT row_number() OVER (ORDER BY a.cleabs, a.ring, a.i) AS edge_key, a.cleabs, 0 AS idx_polygon, a.ring AS idx_ring, a.i AS idx_edge,
               a.x AS start_x, a.y AS start_y, a.z AS start_z, b.x AS end_x, b.y AS end_y, b.z AS end_z
        FROM verts a JOIN verts b ON a.cleabs = b.cleabs AND a.ring = b.ring AND b.i = a.i + 1)""",
    "overlaps": """shared_walls AS (
        SELECT a.edge_key AS edge_key_a, b.edge_key AS edge_key_b, a.cleabs AS cleabs_a, b.cleabs AS cleabs_b,
               least(greatest(a.start_x, a.end_x), greatest(b.start_x, b.end_x)) - greatest(least(a.start_x, a.end_x), least(b.start_x, b.end_x))
             + least(greatest(a.start_y, a.end_y), greatest(b.start_y, b.end_y)) - greatest(least(a.start_y, a.end_y), least(b.start_y, b.end_y)) AS length
        FROM edges a JOIN edges b ON a.edge_key < b.edge_key AND (
             (a.start_x = a.end_x AND b.start_x = b.end_x AND a.start_x = b.start_x AND least(greatest(a.start_y, a.end_y), greatest(b.start_y, b.end_y)) > greatest(least(a.start_y, a.end_y), least(b.start_y, b.end_y)))
          OR (a.start_y = a.end_y AND b.start_y = b.end_y AND a.start_y = b.start_y AND least(greatest(a.start_x, a.end_x), greatest(b.start_x, b.end_x)) > greatest(least(a.start_x, a.end_x), least(b.start_x, b.end_x)))))""",
    "links": "links AS (SELECT DISTINCT cleabs_a AS src, cleabs_b AS dst FROM shared_walls WHERE cleabs_a < cleabs_b)",
    "pts": """pts AS (SELECT event_id AS point_id, event_id // 2 AS ray, (event_id * 37 % 1280) / 8 AS X, (event_id * 101 % 1600) / 8 AS Y, (event_id * 13 % 160) / 8 AS Z,
        CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 2 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 5 ELSE 67 END AS Classification,
        (event_id // 2) / 32768 + CASE WHEN (event_id // 2) % 3 = 0 THEN event_id % 2 ELSE 0 END / 65536 + ((event_id // 2) // 50) AS GpsTime, CAST((event_id // 100) % 2 AS INTEGER) AS ScanDirectionFlag,
        CAST((event_id // 2) % 25 AS INTEGER) AS ScanAngleRank, CAST(user_id % 4 AS INTEGER) AS PointSourceId FROM events)""",
    "knots": "knots AS (SELECT event_id AS seq, (event_id // 2) / 32768 + ((event_id // 2) // 50) AS t FROM events WHERE event_id % 500 = 250)",
    "scored": "scored AS (SELECT cleabs, x0 + (k % 3) / 2 AS sx0, y0 AS sy0, x1 + (k % 3) / 2 AS sx1, y1 AS sy1 FROM bld WHERE k % 11 <> 0)",
}
NEEDS = {"verts": ["bld"], "edges": ["verts"], "overlaps": ["edges"], "links": ["overlaps"], "scored": ["bld"]}


def with_views(*names: str) -> str:
    """The WITH clause that defines these views and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in order)
