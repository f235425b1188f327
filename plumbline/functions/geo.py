"""Planar geometry as Column expressions.

A point is a struct with x, y (and z), a ring an array of points whose last equals its first, a polygon an
array of rings (the exterior first), a multipolygon an array of polygons.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tolerance of boundary tests, in metres.
ON_BOUNDARY = 1e-6


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def ring_edges(ring: Column) -> Column:
    """Array of (a, b) for consecutive points."""
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_area(ring: Column) -> Column:
    """Signed area, positive for counter-clockwise rings."""
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda s, e: s + cross(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])) / 2


def polygon_area(polygon: Column) -> Column:
    """Area of the exterior less the holes."""
    return 2 * F.abs(ring_area(polygon[0])) - F.aggregate(polygon, F.lit(0.0), lambda s, r: s + F.abs(ring_area(r)))


def force_ccw(polygon: Column) -> Column:
    """The exterior counter-clockwise, holes clockwise."""
    return F.transform(polygon, lambda r, i: F.when((ring_area(r) < 0) == (i == 0), F.reverse(r)).otherwise(r))


def segment_position(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on a->b the point's closest point lies, from 0 to 1; 0 for a segment without length."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / F.nullif(square, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = segment_position(px, py, ax, ay, bx, by)
    return length(px - ax - t * (bx - ax), py - ay - t * (by - ay))


def on_ring(px: Column, py: Column, ring: Column) -> Column:
    near = lambda e: segment_distance(px, py, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]) <= ON_BOUNDARY
    return F.exists(ring_edges(ring), near)


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Inside or on the boundary, by crossing parity."""

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((ay > py) != (by > py)) & (px < ax + (py - ay) * (bx - ax) / (by - ay))

    return on_ring(px, py, ring) | (F.size(F.filter(ring_edges(ring), crosses)) % 2 == 1)


def in_polygon(px: Column, py: Column, polygon: Column) -> Column:
    """Inside or on the exterior, and neither in a hole nor on a hole's boundary."""
    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
    return in_ring(px, py, polygon[0]) & ~F.exists(holes, lambda r: in_ring(px, py, r))


def bounds(polygon: Column) -> Column:
    """Struct xmin, ymin, xmax, ymax of a polygon's exterior."""
    xs, ys = F.transform(polygon[0], lambda p: p["x"]), F.transform(polygon[0], lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def collinear_overlap(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Length that a->b and c->d share on one line; 0 if they only touch, cross, or have no length."""
    ux, uy = bx - ax, by - ay
    flat = (cross(ux, uy, cx - ax, cy - ay) == 0) & (cross(ux, uy, dx - ax, dy - ay) == 0)
    size = length(ux, uy)
    c, d = ((cx - ax) * ux + (cy - ay) * uy) / size, ((dx - ax) * ux + (dy - ay) * uy) / size
    shared = F.least(size, F.greatest(c, d)) - F.greatest(F.lit(0.0), F.least(c, d))
    return F.when(flat & (size > 0) & (shared > 0), shared).otherwise(F.lit(0.0))


def line_crossing(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Point where the lines through a, b and c, d meet; null if they are parallel."""
    det = cross(bx - ax, by - ay, dx - cx, dy - cy)
    t = cross(cx - ax, cy - ay, dx - cx, dy - cy) / F.when(F.abs(det) >= 1e-10, det)
    return F.when(t.isNotNull(), F.struct((ax + t * (bx - ax)).alias("x"), (ay + t * (by - ay)).alias("y")))


def angle_between(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    """Radians between two vectors."""
    dot = ax * bx + ay * by + az * bz
    size = F.sqrt(ax * ax + ay * ay + az * az) * F.sqrt(bx * bx + by * by + bz * bz)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.nullif(size, F.lit(0.0)))))


def hilbert(x: Column, y: Column, bits: int = 16) -> Column:
    """Place on a Hilbert curve of integer coordinates from 0 to 2**bits - 1."""
    state = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, level: Column) -> Column:
        n = (F.lit(1 << (bits - 1)) / F.pow(F.lit(2.0), level)).cast("long")
        rx, ry = (s["x"].bitwiseAND(n) > 0).cast("long"), (s["y"].bitwiseAND(n) > 0).cast("long")
        d = s["d"] + n * n * (3 * rx).bitwiseXOR(ry)
        full = F.lit((1 << bits) - 1).cast("long")
        fx, fy = F.when((ry == 0) & (rx == 1), full - s["x"]).otherwise(s["x"]), F.when((ry == 0) & (rx == 1), full - s["y"]).otherwise(s["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), state, step)["d"]


def wkt(multipolygon: Column) -> Column:
    """Well-known text of a multipolygon with z."""
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), p["z"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, point), ", "), F.lit(")"))
    poly = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    return F.concat(F.lit("MULTIPOLYGON Z ("), F.array_join(F.transform(multipolygon, poly), ", "), F.lit(")"))
