"""Planar arrangements as joins: shapes' edges split where they meet, sides told by parity, and the rest walked into rings.

Shapes are multipolygons (2D is enough); a place is inside a shape if it lies within an odd number of its rings. All
steps are joins and grouped sums over edges, pieces and shapes, so a large group of shapes is many rows and not one; what
comes into one row is a shape that was given or a ring that is returned. Coordinates are snapped to 1e-9.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geo
from plumbline.operators.graph import connected_components
from plumbline.operators.keys import shuffled
from plumbline.operators.spatial import box_join
from plumbline.plans.scratch import Scratch

#: Digits that are kept of coordinates, and the distance at which a point is on a line.
DIGITS, NEAR = 9, 1e-9
ENDS = ("ax", "ay", "bx", "by")


def _segments(shapes: DataFrame, geometry: str) -> DataFrame:
    """(g, shape, ax, ay, bx, by, n): distinct undirected edges of each shape, the lesser end first, and how much oftener they come
    forward than backward."""
    e = shapes.select("g", "shape", F.explode(F.flatten(F.transform(F.flatten(geometry), geo.ring_edges))).alias("e"))
    end = lambda p: F.struct(*[(F.round(F.col(f"e.{p}.{c}"), DIGITS) + F.lit(0.0)).alias(c) for c in "xy"])
    e = e.select("g", "shape", end("a").alias("a"), end("b").alias("b")).where("a <> b").select("g", "shape", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), 1).otherwise(-1).alias("n"))
    return e.groupBy("g", "shape", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by")).agg(F.sum("n").alias("n"))


def _cuts(p: str, q: str) -> Column:
    """Places on edge ``p`` at which edge ``q`` crosses it or ends."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = ([F.col(f"{s}_{c}") for c in ENDS] for s in (p, q))
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    det = geo.cross(ux, uy, vx, vy)
    det = F.when(F.abs(det) > 1e-12 * geo.length(ux, uy) * geo.length(vx, vy), det)
    t, u = geo.cross(cx - ax, cy - ay, vx, vy) / det, geo.cross(cx - ax, cy - ay, ux, uy) / det
    held = (t > 0) & (t < 1) & (u >= -1e-12) & (u <= 1 + 1e-12)
    # One formula for both edges, so that they meet in one place.
    fx, fy, gx, gy = (F.col(f"{s}_a{c}") for s in "pq" for c in "xy")
    hx, hy, kx, ky = (F.col(f"{s}_b{c}") - F.col(f"{s}_a{c}") for s in "pq" for c in "xy")
    w = geo.cross(gx - fx, gy - fy, kx, ky) / F.nullif(geo.cross(hx, hy, kx, ky), F.lit(0.0))
    point = lambda x, y: F.struct((F.round(x, DIGITS) + F.lit(0.0)).alias("x"), (F.round(y, DIGITS) + F.lit(0.0)).alias("y"))
    crossing = F.when(held, point(fx + w * hx, fy + w * hy))
    touch = [F.when(geo.segment_distance(x, y, ax, ay, bx, by) <= NEAR, point(x, y)) for x, y in ((cx, cy), (dx, dy))]
    return F.array_compact(F.array(*touch, F.when(touch[0].isNull() & touch[1].isNull(), crossing)))


def pieces(spark: SparkSession, shapes: DataFrame, geometry: str, scratch: Scratch, cell: float | None = 8.0, name: str = "pieces") -> DataFrame:
    """(g, shape, ax, ay, bx, by): the boundaries of the shapes of each group ``g``, split wherever edges of the group meet.

    Pieces that a shape runs along an even number of times bound nothing and are left out (spikes, shapes without area); a
    shape all of whose other pieces come equally often in one direction counts once (rings given twice).
    """
    own = scratch.keep(_segments(shapes, geometry), f"{name}-edges")
    lines = own.select("g", *ENDS).distinct()
    side = lambda p: lines.select(F.col("g").alias(f"{p}_g"), *[F.col(c).alias(f"{p}_{c}") for c in ENDS], *[f(f"a{c}", f"b{c}").alias(f"{p}_{k}{c}") for c in "xy" for k, f in (("low", F.least), ("high", F.greatest))])
    box = lambda p: (f"{p}_lowx", f"{p}_lowy", f"{p}_highx", f"{p}_highy")
    key = lambda p: F.struct(*[F.col(f"{p}_{c}") for c in ENDS])
    met = box_join(side("p"), side("q"), cell, box("p"), box("q"), key("p") < key("q"), same=("p_g", "q_g"))
    cut = lambda p, q: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in ENDS], _cuts(p, q).alias("at"))
    # In a function, as Java leaves what so long expressions are compiled to uncompiled (see ``box_join``).
    both = F.flatten(F.transform(F.array(F.lit(0)), lambda _: F.array(cut("p", "q"), cut("q", "p"))))
    cuts = met.select(F.col("p_g").alias("g"), F.explode(F.filter(both, lambda e: F.size(e["at"]) > 0)).alias("e"))
    cuts = cuts.select("g", "e.*").groupBy("g", *ENDS).agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("cuts"))
    ends = [F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for p in "ab"]
    along = lambda c: F.struct(((c["x"] - F.col("ax")) * (F.col("bx") - F.col("ax")) + (c["y"] - F.col("ay")) * (F.col("by") - F.col("ay"))).alias("t"), c.alias("c"))
    split = own.join(shuffled(cuts), ["g", *ENDS], "left")
    # A point that is an end already may come again as a cut.
    row = F.transform(F.array_sort(F.transform(F.array_distinct(F.concat(F.array(*ends), F.coalesce("cuts", F.array().cast("array<struct<x:double,y:double>>")))), along)), lambda s: s["c"])
    split = split.select("g", "shape", "n", row.alias("row"))
    part = F.zip_with(F.slice("row", 1, F.size("row") - 1), F.slice("row", 2, F.size("row") - 1), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    split = split.select("g", "shape", "n", F.explode(part).alias("s")).select("g", "shape", "n", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    counted = scratch.keep(split.groupBy("g", "shape", *ENDS).agg(F.abs(F.sum("n")).alias("n")).where("n > 0"), f"{name}-split")
    alike = counted.groupBy("g", "shape").agg(F.when(F.min("n") == F.max("n"), F.min("n")).otherwise(F.lit(1)).alias("times"))
    odd = counted.join(shuffled(alike), ["g", "shape"]).where("(n div times) % 2 = 1")
    return scratch.keep(odd.select("g", "shape", *ENDS), name)


def sides(split: DataFrame, cell: float | None = 8.0) -> DataFrame:
    """(g, ax, ay, bx, by, shape, own, left, right): for each distinct piece and each shape of its group that is near, is it a
    boundary of the shape, and is the shape inside at its left and right (from the lesser end on).

    Without ``cell`` (groups of a few shapes) shapes meet the pieces by their group alone, and no shape is shown once a cell."""
    rings = split.groupBy("g", "shape").agg(
        F.collect_list(F.struct(*ENDS)).alias("edges"), *[f(g(f"a{c}", f"b{c}")).alias(f"__{k}{c}") for c in "xy" for k, f, g in (("low", F.min, F.least), ("high", F.max, F.greatest))]
    )
    rings = rings.select(F.col("g").alias("of"), "shape", "edges", *[(F.col(f"__low{c}") - 1e-6).alias(f"__low{c}") for c in "xy"], *[(F.col(f"__high{c}") + 1e-6).alias(f"__high{c}") for c in "xy"])
    mid = lambda c: (F.col(f"a{c}") + F.col(f"b{c}")) / 2
    asked = split.select("g", *ENDS).distinct().withColumns({"mx": mid("x"), "my": mid("y"), "nx": mid("x"), "ny": mid("y")})
    met = box_join(asked, rings, cell, ("mx", "my", "nx", "ny"), ("__lowx", "__lowy", "__highx", "__highy"), same=("g", "of"))
    same = lambda e: (e["ax"] == F.col("ax")) & (e["ay"] == F.col("ay")) & (e["bx"] == F.col("bx")) & (e["by"] == F.col("by"))

    def beyond(e: Column) -> Column:
        """Does a way to the right, a little above the middle, cross the edge?"""
        up = (e["ay"] > F.col("my")) != (e["by"] > F.col("my"))
        return up & (F.col("mx") < e["ax"] + (F.col("my") - e["ay"]) * (e["bx"] - e["ax"]) / (e["by"] - e["ay"])) & ~same(e)

    found = met.select("g", *ENDS, "shape", F.exists("edges", same).alias("own"), (F.size(F.filter("edges", beyond)) % 2 == 1).alias("there"))
    # "There" is to the right of the middle, or above it where the piece is level.
    at_left = F.col("by") <= F.col("ay")
    other = F.col("there") != F.col("own")
    return found.select("g", *ENDS, "shape", "own", F.when(at_left, F.col("there")).otherwise(other).alias("left"), F.when(at_left, other).otherwise(F.col("there")).alias("right"))


def _walk(column: pd.Series) -> pd.Series:
    """Rings from pieces that know the one after them, cut apart where they come to a point again; points on a line go."""
    out = []
    for row in column:
        by, found = {p["id"]: p for p in row}, []
        walked = set()
        for at in sorted(by):
            stack, seen, way = [], {}, []
            while at not in walked:
                walked.add(at)
                way.append(at)
                at = by[at]["next"]
            for q in [*way, at] if way else []:  # the piece that comes again closes the way
                here = (by[q]["x"], by[q]["y"])
                if here in seen:
                    loop, stack = stack[seen[here] :], stack[: seen[here]]
                    for gone in loop:
                        del seen[gone]
                    found.append(loop)
                seen[here] = len(stack)
                stack.append(here)
        kept = []
        for loop in found:
            a = np.array(loop)
            u, v = a - np.roll(a, 1, 0), np.roll(a, -1, 0) - a
            bent = np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) > 1e-9 * np.hypot(*u.T) * np.hypot(*v.T)
            if bent.sum() >= 3:
                b = a[bent].tolist()
                kept.append([{"x": x, "y": y} for x, y in [*b, b[0]]])
        out.append(kept)
    return pd.Series(out)


RINGS = "array<array<struct<x:double,y:double>>>"


def _linked(directed: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, id, px, py, qx, qy, rx, ry, next): each directed piece (from p to q) with the one after it (from q to r)."""
    pieces = scratch.keep(directed.withColumn("id", F.monotonically_increasing_id()), "directed")
    out = pieces.select("g", F.col("id").alias("next"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("qx").alias("rx"), F.col("qy").alias("ry"))
    turn = F.atan2(F.col("py") - F.col("qy"), F.col("px") - F.col("qx")) - F.atan2(F.col("ry") - F.col("qy"), F.col("rx") - F.col("qx"))
    clockwise = F.when(turn <= 1e-12, turn + 2 * np.pi).otherwise(turn)
    linked = pieces.join(shuffled(out), ["g", "qx", "qy"]).groupBy("g", "id", "px", "py").agg(F.min_by(F.struct("next", "qx", "qy", "rx", "ry"), F.struct(clockwise, F.col("next"))).alias("n"))
    return scratch.keep(linked.select("g", "id", "px", "py", "n.*"), "linked")


def boundary_rings(spark: SparkSession, directed: DataFrame, scratch: Scratch, single: bool = False) -> DataFrame:
    """(g, ring, area): rings of the directed pieces (g, px, py, qx, qy), which have the inside at their left.

    Each ring is walked by itself, but all of a group at once where a group is one shape that was given (``single``)."""
    linked, key = _linked(directed, scratch), ["g"]
    if not single:
        found = connected_components(spark, linked.select("id", F.col("next").alias("n")), scratch, "rings").withColumnRenamed("id", "piece")
        linked, key = linked.join(shuffled(found), F.col("id") == F.col("piece")), ["g", "component"]
    whole = linked.groupBy(*key).agg(F.collect_list(F.struct("id", "next", F.col("px").alias("x"), F.col("py").alias("y"))).alias("row"))
    walked = whole.select("g", F.explode(F.pandas_udf(_walk, RINGS)("row")).alias("ring"))
    return walked.withColumn("area", geo.ring_area(F.col("ring")))


def _assembled(rings: DataFrame, scratch: Scratch, cell: float) -> DataFrame:
    """(g, geometry, area): holes go to the least ring that holds them."""
    rings = scratch.keep(rings.withColumn("no", F.monotonically_increasing_id()), "rings")
    span = [f(F.transform("ring", lambda q: q[c])).alias(f"o_{k}{c}") for k, f in (("low", F.array_min), ("high", F.array_max)) for c in "xy"]
    outer = rings.where("area > 0").select("g", "no", "ring", "area", *span)
    holes = rings.where("area < 0").select(F.col("g").alias("of"), F.col("no").alias("hole_no"), F.col("ring").alias("hole"), *[((F.col("ring")[0][c] + F.col("ring")[1][c]) / 2).alias(m) for m, c in (("mx", "x"), ("my", "y"), ("nx", "x"), ("ny", "y"))])
    inside = geo.in_ring(F.col("mx"), F.col("my"), F.col("ring"))
    met = box_join(holes, outer, cell, ("mx", "my", "nx", "ny"), ("o_lowx", "o_lowy", "o_highx", "o_highy"), inside, same=("of", "g"))
    home = met.groupBy("hole_no").agg(F.min_by("no", F.struct("area", "no")).alias("no"), F.first("hole").alias("hole"))
    held = home.groupBy("no").agg(F.array_sort(F.collect_list("hole")).alias("holes"))
    polygons = outer.select("g", "no", "ring").join(shuffled(held), "no", "left").select("g", F.concat(F.array("ring"), F.coalesce("holes", F.array().cast(RINGS))).alias("polygon"))
    polygons = polygons.withColumn("a", geo.polygon_area(F.col("polygon")))
    return polygons.groupBy("g").agg(F.array_sort(F.collect_list("polygon")).alias("geometry"), F.sum("a").alias("area"))


def _outline(spark: SparkSession, named: DataFrame, scratch: Scratch, cell: float, single: bool = False) -> DataFrame:
    """(g, px, py, qx, qy): the pieces that bound each group's union, with the inside at their left."""
    found = sides(pieces(spark, named, "geometry", scratch, cell), None if single else cell).groupBy("g", *ENDS).agg(F.max("left").alias("left"), F.max("right").alias("right")).where("left <> right")
    turned = lambda a, b: F.when(F.col("left"), F.col(a)).otherwise(F.col(b))
    return found.select("g", turned("ax", "bx").alias("px"), turned("ay", "by").alias("py"), turned("bx", "ax").alias("qx"), turned("by", "ay").alias("qy"))


def dissolve(spark: SparkSession, shapes: DataFrame, group: str, shape: str, geometry: str, cell: float = 8.0, single: bool = False) -> DataFrame:
    """(group, geometry, area): the union of each group's shapes as a valid multipolygon, holes kept; exteriors run
    counter-clockwise, holes clockwise, without points on a line. A group without area has an empty geometry. ``single``
    tells that each group is one shape."""
    scratch = Scratch(spark, "dissolve")
    named = shapes.select(F.col(group).alias("g"), F.col(shape).alias("shape"), F.col(geometry).alias("geometry"))
    whole = _assembled(boundary_rings(spark, _outline(spark, named, scratch, cell, single), scratch, single), scratch, cell)
    empty = F.array().cast(f"array<{RINGS}>")
    every = named.select("g").distinct().join(shuffled(whole), "g", "left")
    return every.select(F.col("g").alias(group), F.coalesce("geometry", empty).alias("geometry"), F.coalesce("area", F.lit(0.0)).alias("area"))


def dissolved_measures(spark: SparkSession, shapes: DataFrame, group: str, shape: str, geometry: str, cell: float = 8.0) -> DataFrame:
    """(group, area, boundary, corners) of the union of each group's shapes: sums over the pieces that bound it, so that no ring and
    no group comes into one row. A corner is a turn of the boundary; where it touches itself in a point each way through counts."""
    scratch = Scratch(spark, "dissolved-measures")
    named = shapes.select(F.col(group).alias("g"), F.col(shape).alias("shape"), F.col(geometry).alias("geometry"))
    c = F.col
    ux, uy, vx, vy = c("qx") - c("px"), c("qy") - c("py"), c("rx") - c("qx"), c("ry") - c("qy")
    turns = F.abs(geo.cross(ux, uy, vx, vy)) > 1e-9 * geo.length(ux, uy) * geo.length(vx, vy)
    linked = _linked(_outline(spark, named, scratch, cell), scratch)
    whole = linked.groupBy("g").agg(F.sum(geo.cross(c("px"), c("py"), c("qx"), c("qy")) / 2).alias("area"), F.sum(geo.length(ux, uy)).alias("boundary"), F.sum(turns.cast("long")).alias("corners"))
    every = named.select("g").distinct().join(shuffled(whole), "g", "left")
    return every.select(c("g").alias(group), *[F.coalesce(n, F.lit(zero)).alias(n) for n, zero in (("area", 0.0), ("boundary", 0.0), ("corners", 0))])


def overlap_areas(spark: SparkSession, shapes: DataFrame, group: str, shape: str, first: str, geometry: str, cell: float = 8.0) -> DataFrame:
    """(group, area_first, area_second, area_both) of the unions of each group's shapes on two sides (``first`` tells which) and
    of what these have in common.

    An area is a sum over the pieces of its boundary, so a group of any size is added up piece by piece.
    """
    scratch = Scratch(spark, "overlap-areas")
    named = shapes.select(F.col(group).alias("g"), F.struct(F.col(first).alias("first"), F.col(shape).alias("id")).alias("shape"), F.col(geometry).alias("geometry"))
    facts = sides(pieces(spark, named, "geometry", scratch, cell), cell)
    one = F.col("shape.first")
    within = lambda side, own: F.coalesce(F.max(F.when(own, F.col(side))), F.lit(False))
    held = facts.groupBy("g", *ENDS).agg(*[within(s, o).alias(f"{n}_{s}") for s in ("left", "right") for n, o in (("a", one), ("b", ~one))])
    size = geo.cross(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) / 2
    area = lambda left, right: F.sum(F.when(left & ~right, size).when(right & ~left, -size).otherwise(0.0))
    c = F.col
    both = area(c("a_left") & c("b_left"), c("a_right") & c("b_right"))
    found = held.groupBy("g").agg(area(c("a_left"), c("a_right")).alias("area_first"), area(c("b_left"), c("b_right")).alias("area_second"), both.alias("area_both"))
    return found.withColumnRenamed("g", group)


def make_valid(spark: SparkSession, shapes: DataFrame, key: str, geometry: str, cell: float = 8.0) -> DataFrame:
    """(key, geometry, area): each shape as a valid multipolygon of the places within an odd number of its rings: a bow tie
    becomes two polygons, spikes go, a ring that is given twice counts once."""
    same = shapes.select(F.col(key).alias("__g"), F.col(key).alias("__shape"), F.col(geometry).alias("__geometry"))
    return dissolve(spark, same, "__g", "__shape", "__geometry", cell, single=True).select(F.col("__g").alias(key), F.col("geometry").alias(geometry), "area")


def touching(spark: SparkSession, shapes: DataFrame, key: str, geometry: str, cell: float = 8.0) -> DataFrame:
    """Pairs (a before b) of valid shapes that share boundary points, along a piece or at a point, but no inside."""
    scratch = Scratch(spark, "touching")
    b = F.transform(geometry, geo.bounds)
    over = lambda f, c: f(F.transform(b, lambda x: x[c]))
    box = {"__x0": over(F.array_min, "xmin"), "__y0": over(F.array_min, "ymin"), "__x1": over(F.array_max, "xmax"), "__y1": over(F.array_max, "ymax")}
    boxed = scratch.keep(shapes.select(F.col(key).alias("id"), F.col(geometry).alias("geometry")).withColumns(box), "boxed")
    side = lambda p: boxed.select(F.col("id").alias(p), *[F.col(f"__{c}").alias(f"{p}_{c}") for c in ("x0", "y0", "x1", "y1")])
    boxes = lambda p: tuple(f"{p}_{c}" for c in ("x0", "y0", "x1", "y1"))
    near = box_join(side("a"), side("b"), cell, boxes("a"), boxes("b"), F.col("a") < F.col("b")).select("a", "b")
    # All that follows carries a pair's number and not its two names, which are most of a row.
    near = scratch.keep(near.select(F.monotonically_increasing_id().alias("g"), "a", "b"), "near")
    both = near.select("g", F.posexplode(F.array("a", "b")).alias("shape", "name")).join(shuffled(boxed), F.col("name") == F.col("id")).select("g", "shape", "geometry")
    split = pieces(spark, both, "geometry", scratch, None)
    facts = sides(split, None).groupBy("g", *ENDS).agg(F.sum(F.col("own").cast("int")).alias("owners"), F.sum((F.col("left") & F.col("right")).cast("int")).alias("within"), F.sum(F.col("left").cast("int")).alias("lefts"), F.sum(F.col("right").cast("int")).alias("rights"))
    # Inside is shared where a piece lies within the other shape, or where both bound it from one side.
    shared = facts.where("within > 0 or (owners = 2 and (lefts = 2 or rights = 2))").select("g").distinct()
    ends = split.select("g", "shape", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    contact = ends.groupBy("g", "p").agg(F.min("shape").alias("x"), F.max("shape").alias("y")).where("x <> y").select("g").distinct()
    return near.join(shuffled(contact.join(shuffled(shared), "g", "left_anti")), "g").select("a", "b")
