"""Laser points: classes, neighbourhoods, rays, scan lines and roof edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geo
from plumbline.operators.keys import shuffled
from plumbline.operators.spatial import radius_join

#: Codes of the LAS point classes (fixed values of the format).
UNCLASSIFIED, GROUND, BUILDING = 1, 2, 6
VEGETATION = (3, 4, 5)
#: Classes that the outputs keep.
KEPT_CLASSES = (0, 1, 2, 6, 64, 67)
#: What the pipeline takes for buildings before roofs are modelled.
TO_BUILDING = ((1, 6), (64, 6), (65, 6), (67, 6))
EDGE_GAIN = 2.0


def reclassify(points: DataFrame, mapping: tuple[tuple[int, int], ...] = TO_BUILDING) -> DataFrame:
    """Each (old, new) in turn, so a class can be mapped twice."""
    out = F.col("Classification")
    for old, new in mapping:
        out = F.when(out == old, new).otherwise(out)
    return points.withColumn("Classification", out)


def bounds(points: DataFrame) -> DataFrame:
    """Integer bounds, cut toward zero as the header's are."""
    return points.agg(*[F.expr(f"cast({f}({c}) as bigint)").alias(f"{f}_{c.lower()}") for c in "XY" for f in ("min", "max")])


def merge(*clouds: DataFrame) -> DataFrame:
    """All points with all dimensions of any."""
    out = clouds[0]
    for c in clouds[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def _pairs(points: DataFrame, radius: float, residual: Column | None = None) -> DataFrame:
    """Pairs of places, each once however many points it has, and n: how many other points there are at the second one."""
    places = points.groupBy("X", "Y", "Z").agg(F.count("*").alias("n"))
    p, q = (places.select(*[F.col(c).alias(f"{s}_{c}") for c in ("X", "Y", "Z", "n")]) for s in "pq")
    met = radius_join(p, q, radius, ("p_X", "p_Y"), ("q_X", "q_Y"), residual)
    own = F.lit(True)
    for c in "XYZ":
        own &= F.col(f"p_{c}").eqNullSafe(F.col(f"q_{c}"))
    return met.withColumn("n", F.col("q_n") - F.when(own, 1).otherwise(0)).where("n > 0")


def _by_place(met: DataFrame, x: Column, y: Column) -> DataFrame:
    return met.groupBy(*[F.col(f"p_{c}").alias(c) for c in "XYZ"]).agg(x.alias("inward_x"), y.alias("inward_y"))


def inward_roof(points: DataFrame, radius: float = 2.0, most_dz: float = 1.0) -> DataFrame:
    """(point_id, inward_x, inward_y): mean unit vector to the neighbours in a flat sphere; 0 without any."""
    dx, dy, dz = (F.col(f"q_{c}") - F.col(f"p_{c}") for c in "XYZ")
    met = _pairs(points, radius, (dx * dx + dy * dy + dz * dz <= radius * radius) & (F.abs(dz) <= most_dz))
    size = F.nullif(geo.length(dx, dy), F.lit(0.0))
    mean = lambda d: F.round(F.sum(F.col("n") * F.coalesce(d / size, F.lit(0.0))) / F.sum("n"), 6)
    return _or_zero(points, _by_place(met, mean(dx), mean(dy)))


def inward_facade(points: DataFrame, radius: float = 2.0) -> DataFrame:
    """(point_id, inward_x, inward_y): height differences times unit vectors from the neighbours, over their sizes' sum."""
    dx, dy, dz = (F.col(f"p_{c}") - F.col(f"q_{c}") for c in "XYZ")
    size = F.nullif(geo.length(dx, dy), F.lit(0.0))
    total = F.nullif(F.sum(F.col("n") * F.abs(dz)), F.lit(0.0))
    mean = lambda d: F.round(F.sum(F.col("n") * dz * F.coalesce(d / size, F.lit(0.0))) / total, 6)
    return _or_zero(points, _by_place(_pairs(points, radius), mean(dx), mean(dy)))


def _or_zero(points: DataFrame, found: DataFrame) -> DataFrame:
    return points.select("point_id", "X", "Y", "Z").join(shuffled(found), ["X", "Y", "Z"], "left").select("point_id", *[(F.coalesce(c, F.lit(0.0)) + F.lit(0.0)).alias(c) for c in ("inward_x", "inward_y")])


def rays(points: DataFrame) -> DataFrame:
    """Points of one GPS time: their ids by height, top and last return, flag and angle of the last point read."""
    by_height = F.array_sort(F.collect_list(F.struct((-F.col("Z")).alias("nz"), "point_id")))
    top = F.min_by(F.struct("X", "Y", "Z"), F.struct(-F.col("Z"), "point_id"))
    out = points.groupBy("GpsTime").agg(
        by_height.alias("r"), top.alias("top"), F.min("Z").alias("z_last"), F.max_by("ScanDirectionFlag", "point_id").alias("flag"), F.max_by("ScanAngleRank", "point_id").alias("angle"), F.count("*").alias("n_returns")
    )
    return out.withColumn("point_ids", F.transform("r", lambda x: x["point_id"])).drop("r")


def return_numbers(points: DataFrame) -> DataFrame:
    """Per point its place in its ray by height (return_rank) and in input order (return_index), both from 0."""
    ray = Window.partitionBy("GpsTime")
    return points.withColumns({"return_rank": F.row_number().over(ray.orderBy(F.desc("Z"), "point_id")) - 1, "return_index": F.row_number().over(ray.orderBy("point_id")) - 1})


def scan_lines(all_rays: DataFrame, gap: float = 1e-4, bucket: float = 16.0) -> DataFrame:
    """Rays with their scan line (from 0): a new line where the time jumps by ``gap`` or the flag turns.

    Rays are ordered inside time buckets; one row per bucket carries the last ray and the number of breaks
    on to the next bucket, so no task sees more than a bucket of rays or the row per bucket.
    """
    rows = all_rays.withColumn("__b", F.floor(F.col("GpsTime") / bucket))
    own = Window.partitionBy("__b").orderBy("GpsTime")
    rows = rows.withColumns({"__t": F.lag("GpsTime").over(own), "__f": F.lag("flag").over(own)})
    broken = lambda t, f, t0, f0: ((t - t0 >= gap) | (f != f0)).cast("long")
    rows = rows.withColumn("__break", F.when(F.col("__t").isNull(), 0).otherwise(broken(F.col("GpsTime"), F.col("flag"), F.col("__t"), F.col("__f"))))
    ends = rows.groupBy("__b").agg(F.sum("__break").alias("n"), F.min_by(F.struct("GpsTime", "flag"), "GpsTime").alias("first"), F.max_by(F.struct("GpsTime", "flag"), "GpsTime").alias("last"))
    order = Window.orderBy("__b")
    before = F.lag("last").over(order)
    start = F.coalesce(broken(F.col("first.GpsTime"), F.col("first.flag"), before["GpsTime"], before["flag"]), F.lit(0))
    ends = ends.withColumn("start", start).withColumn("base", F.sum(F.col("start") + F.col("n")).over(order) - F.col("n")).select("__b", "base")
    running = F.sum("__break").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__run", running).join(shuffled(ends), "__b").withColumn("line", F.col("base") + F.col("__run")).drop("__b", "__t", "__f", "__break", "__run", "base")


def ray_neighbours(lined: DataFrame, spread: int = 1) -> DataFrame:
    """(GpsTime, side, other): previous and next ray of the line, and in the lines before and after the ray of
    the least 3D angle among those within ``spread`` ranks of the scan angle. Needs scanner_x, _y, _z."""
    own = Window.partitionBy("line").orderBy("GpsTime")
    along = lined.select("GpsTime", F.lag("GpsTime").over(own).alias("prev"), F.lead("GpsTime").over(own).alias("next"))
    pick = lambda c: along.where(F.col(c).isNotNull()).select("GpsTime", F.lit(c).alias("side"), F.col(c).alias("other"))
    d = [F.col(f"top.{c}") - F.col(f"scanner_{c.lower()}") for c in "XYZ"]
    # Pairs of adjacent lines meet once, in bands of the angle, and each tells both of its rays.
    band = lambda c: F.floor(c / (2 * spread + 1))
    shape = lined.select("GpsTime", "line", "angle", *[v.alias(f"d{c}") for v, c in zip(d, "xyz", strict=True)])
    low = shape.withColumn("band", band(F.col("angle")))
    high = shape.select(F.col("GpsTime").alias("other"), (F.col("line") - 1).alias("line"), F.col("angle").alias("at"), F.explode(F.sequence(band(F.col("angle") - spread), band(F.col("angle") + spread))).alias("band"), *[F.col(f"d{c}").alias(f"e{c}") for c in "xyz"])
    turn = F.round(geo.angle_between(*[F.col(f"d{c}") for c in "xyz"], *[F.col(f"e{c}") for c in "xyz"]), 9)
    met = low.join(shuffled(high), ["line", "band"]).where(F.abs(F.col("angle") - F.col("at")) <= spread).select("GpsTime", "other", turn.alias("turn"))
    tell = lambda a, up, b: F.struct(F.col(a).alias("GpsTime"), F.lit(up).alias("up"), F.struct("turn", F.col(b).alias("other")).alias("o"))
    told = met.select(F.explode(F.array(tell("GpsTime", True, "other"), tell("other", False, "GpsTime"))).alias("t")).select("t.*")
    across = told.groupBy("GpsTime", "up").agg(F.min("o").alias("o")).select("GpsTime", F.when(F.col("up"), "next_line").otherwise("prev_line").alias("side"), F.col("o.other").alias("other"))
    return pick("prev").unionByName(pick("next")).unionByName(across)


def multi_echo(points: DataFrame) -> DataFrame:
    """Points with the gain over their ray's last return; edges have over 2, and a ray's last return is façade
    if one of the edges above it is no vegetation."""
    ray = Window.partitionBy("GpsTime")
    out = points.withColumn("gain", F.col("Z") - F.min("Z").over(ray))
    edge = F.col("gain") > EDGE_GAIN
    solid = F.max((edge & ~F.col("Classification").isin(*VEGETATION)).cast("int")).over(ray)
    last = F.row_number().over(ray.orderBy("Z", F.desc("point_id"))) == 1
    return out.withColumn("is_edge", edge).withColumn("is_facade", last & (solid == 1))


def at_height(h: Column, origin: list[Column], top: list[Column]) -> list[Column]:
    """x and y where the ray from ``origin`` through ``top`` has height ``h``."""
    s = (h - origin[2]) / F.nullif(top[2] - origin[2], F.lit(0.0))
    return [origin[i] + s * (top[i] - origin[i]) for i in (0, 1)]


def single_echo(points: DataFrame, lined: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(point_id, gain, x, y) of the edges that single returns show: of the neighbour rays without edges of their
    own the largest drop below the point less the distance to the ray at its height; the edge lies midway."""
    order = F.create_map(*[F.lit(x) for p in (("prev", 0), ("next", 1), ("prev_line", 2), ("next_line", 3)) for x in p])
    edge_rays = multi_echo(points).where("is_edge").select("GpsTime").distinct()
    alone = lined.where("n_returns = 1").select("GpsTime").join(shuffled(points), "GpsTime").where(~F.col("Classification").isin(*VEGETATION)).select("GpsTime", "point_id", "X", "Y", "Z")
    other = lined.join(shuffled(edge_rays), "GpsTime", "left_anti").select(F.col("GpsTime").alias("other"), "top", "z_last", "scanner_x", "scanner_y", "scanner_z")
    met = alone.join(shuffled(neighbours), "GpsTime").join(shuffled(other), "other")
    x, y = at_height(F.col("Z"), [F.col(f"scanner_{c}") for c in "xyz"], [F.col(f"top.{c}") for c in "XYZ"])
    met = met.withColumns({"rx": x, "ry": y}).withColumn("g", F.round(F.col("Z") - F.col("z_last") - geo.length(F.col("X") - F.col("rx"), F.col("Y") - F.col("ry")), 6))
    best = met.groupBy("point_id").agg(F.max_by(F.struct("g", "X", "Y", "rx", "ry"), F.struct(F.col("g"), order[F.col("side")])).alias("b"))
    mid = lambda a, b: F.round((F.col(f"b.{a}") + F.col(f"b.{b}")) / 2, 6)
    return best.where(F.col("b.g") > EDGE_GAIN).select("point_id", F.col("b.g").alias("gain"), mid("X", "rx").alias("x"), mid("Y", "ry").alias("y"))


def weight(generated: Column, classification: Column) -> Column:
    """How much a point counts: 1, 0.6 or 0.2 by how it was made, times 1 for buildings and 0.3 for others."""
    return F.when(generated == 0, 1.0).when(generated == 1, 0.6).otherwise(0.2) * F.when(classification == BUILDING, 1.0).otherwise(0.3)


def gap_runs(df: DataFrame, group: str, value: str, key: str, gap: float = 1.0, bucket: float = 16.0) -> DataFrame:
    """Runs of values without a step over ``gap``: group, run (from 0), its size and ends.

    Steps are found inside buckets of the value; one row a bucket carries its last value and the number of its steps
    on, so no task sees more of a group than a bucket of rows or its row per bucket. Rows without a value are left out.
    """
    rows = df.select(group, value, key).where(F.col(value).isNotNull()).withColumn("__b", F.floor(F.col(value) / bucket))
    own, order = Window.partitionBy(group, "__b").orderBy(value, key), Window.partitionBy(group).orderBy("__b")
    rows = rows.withColumn("__new", F.coalesce((F.col(value) - F.lag(value).over(own) > gap).cast("long"), F.lit(0)))
    ends = rows.groupBy(group, "__b").agg(F.sum("__new").alias("n"), F.min(value).alias("first"), F.max(value).alias("last"))
    start = F.coalesce((F.col("first") - F.lag("last").over(order) > gap).cast("long"), F.lit(0))
    ends = ends.withColumn("start", start).withColumn("base", F.sum(F.col("start") + F.col("n")).over(order) - F.col("n")).select(F.col(group).alias("__g"), F.col("__b").alias("__at"), "base")
    rows = rows.withColumn("__run", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.join(shuffled(ends), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__at"))).withColumn("run", F.col("base") + F.col("__run"))
    return out.groupBy(group, "run").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


def principal_axes(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Eigenvalues of the covariance of each group's points, ascending."""
    out = df.groupBy(group).agg(F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"))
    mid, half = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, 2) + F.col("xy") * F.col("xy"))
    return out.select(group, F.round(mid - half, 4).alias("least"), F.round(mid + half, 4).alias("most"))
