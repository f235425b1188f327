"""Dropping vertices that lie on the line of their neighbours, so that rings that share a wall go on sharing it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.keys import shuffled
from plumbline.plans.scratch import Scratch

#: How far a vertex may lie off its neighbours' line, in metres (fixed value of the method).
TOLERANCE = 1e-6


class _Rings:
    """Places of the vertices of a batch of rings (without their closing points), and of those before and after each."""

    def __init__(self, lists: pa.Array):
        self.size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.of = np.repeat(np.arange(len(self.size)), self.size)
        self.n, first = self.size[self.of], self.start[self.of]
        self.at = np.arange(len(self.of))
        self.before = np.where(self.at == first, first + self.n - 1, self.at - 1)
        self.after = np.where(self.at == first + self.n - 1, first, self.at + 1)

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many vertices of its ring are meant, for each vertex."""
        return np.bincount(self.of[mask], minlength=len(self.size))[self.of]

    def lists(self, mask: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(self.start, len(mask)).astype(np.int32)), pa.array(mask))


def _coordinates(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    points = v.flatten()
    return tuple(points.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in "xy")


def _along(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where on a->b (from 0 to 1 on the segment, or anywhere on the ``whole`` line) each place's closest point lies, and how far off."""
    dx, dy = x[b] - x[a], y[b] - y[a]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((x - x[a]) * dx + (y - y[a]) * dy) / (dx * dx + dy * dy)
    t = t if whole else np.where(dx * dx + dy * dy == 0, 0.0, np.clip(t, 0.0, 1.0))
    return t, np.sqrt((x - x[a] - t * dx) ** 2 + (y - y[a] - t * dy) ** 2)


def _is_flat(g: _Rings, x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    a, b = g.before, g.after
    return (_along(x, y, a, b, False)[1] <= tolerance) & (g.n > 3) & ~((x[a] == x[b]) & (y[a] == y[b]))


def flat_vertices(v: pa.Array, tolerance: float) -> pa.Array:
    """Which vertices of each ring lie on the line of their neighbours."""
    g = _Rings(v)
    return g.lists(_is_flat(g, *_coordinates(v), tolerance))


def sure_vertices(v: pa.Array, tolerance: float) -> pa.Array:
    """Which vertices of each ring lie on the line of their neighbours whichever others go first.

    Such are the vertices between two that are not flat if all of them follow each other on the line of these two, off by less
    than half the tolerance: each is then within the tolerance of the line of any two others, one before and one after it. A ring with fewer than
    three vertices that are not flat has none.
    """
    g = _Rings(v)
    x, y = _coordinates(v)
    flat = _is_flat(g, x, y, tolerance)
    if not flat.any():
        return g.lists(flat)
    ends = g.start[g.of] + g.n - 1
    bends = np.flatnonzero(~flat)
    able = flat & (g.count(~flat) >= 3)
    # The bends before and after each vertex, around the ring; those of rings without bends are not used.
    low, high = np.searchsorted(bends, g.start[g.of]), np.searchsorted(bends, ends, "right") - 1
    k = np.searchsorted(bends, g.at)
    bend = lambda i: bends[np.clip(i, 0, max(len(bends) - 1, 0))] if len(bends) else g.at
    a, b = bend(np.where(k - 1 < low, high, k - 1)), bend(np.where(k > high, low, k))
    t, off = _along(x, y, a, b, True)
    fine = (t > 0) & (t < 1) & (off <= 0.49 * tolerance) & (~flat[g.before] | (t > t[g.before]))
    return g.lists(able & (np.bincount(a[able & ~fine], minlength=len(a))[a] == 0))


def going_vertices(h: pa.Array, free: pa.Array) -> pa.Array:
    """Which of the ``free`` vertices (numbers) of each ring have a smaller hash than their free neighbours; none of a ring that
    would fall below three."""
    g = _Rings(h)
    own = pc.list_value_length(free).to_numpy(zero_copy_only=False)
    value, may = h.flatten().to_numpy(zero_copy_only=False), np.zeros(len(g.of), bool)
    may[np.repeat(g.start, own) + free.flatten().to_numpy(zero_copy_only=False)] = True
    goes = may.copy()
    for other in (g.before, g.after):
        goes &= ~may[other] | (value < value[other])
    return g.lists(goes & (g.n - g.count(goes) >= 3))


def _agreed(rings: DataFrame, mark: str, of: str | None = None) -> DataFrame:
    """(id, numbers): the vertices with the mark whose place has it in all rings; ``of`` has the numbers of those that count."""
    if of is None:
        at = rings.select("id", F.posexplode(F.arrays_zip("v", F.col(mark).alias("mark"))).alias("i", "p"))
    else:
        at = rings.select("id", "v", mark, F.explode(of).alias("i")).select("id", "i", F.struct(F.col("v")[F.col("i")].alias("v"), F.col(mark)[F.col("i")].alias("mark")).alias("p"))
    at = at.select("id", "i", F.col("p.v.x").alias("x"), F.col("p.v.y").alias("y"), F.col("p.mark").alias("mark"))
    against = at.where("not mark").select("x", "y").distinct()
    return at.where("mark").join(shuffled(against), ["x", "y"], "left_anti").groupBy("id").agg(F.collect_list("i").alias("numbers"))


def simplify(spark: SparkSession, shapes: DataFrame, key: str, geometry: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, geometry): multipolygons without the vertices that lie within ``tolerance`` of the line between their neighbours.

    A vertex goes only if it may go from all rings, of all shapes, that have one at its place, and no ring falls
    below three. Those that may go whichever others go first, in all rings, go at once, so straight runs of any length take one
    pass. What is left goes in rounds: no two neighbours go at once, so a place is always measured against vertices
    that are there; of neighbours that may go, the one with the least hash of its place does. A ring stays one row; what is dealt by
    place is each vertex once a pass. Rings are returned closed; a null geometry stays null.
    """
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    scratch = Scratch(spark, "simplify")
    flat = F.arrow_udf(lambda v: flat_vertices(v, tolerance), "array<boolean>")
    sure = F.arrow_udf(lambda v: sure_vertices(v, tolerance), "array<boolean>")
    going = F.arrow_udf(going_vertices, "array<boolean>")
    # Shapes without a vertex go by as they are. No filter needs the geometry, as that would be worked out where the shapes are read.
    held = F.coalesce(F.exists(geometry, lambda p: F.exists(p, lambda r: F.size(r) > 0)), F.lit(False))
    given = shapes.select(F.monotonically_increasing_id().alias("shape"), F.col(key).alias("key"), F.col(geometry).alias("g"), held.alias("held"))
    polygons = given.select("shape", "key", F.when(~F.col("held"), F.col("g")).alias("bare"), "held", F.posexplode_outer(F.when(F.col("held"), F.col("g"))).alias("polygon", "p"))
    rings = polygons.select("shape", "key", "bare", "held", "polygon", F.posexplode_outer("p").alias("ring", "r")).where("size(r) > 0 or not held")
    # The closing point is left out; the first one stands for both.
    rings = rings.select("shape", "key", "bare", "polygon", "ring", F.slice("r", 1, F.greatest(F.size("r") - 1, F.lit(1))).alias("v"))
    now, k = scratch.keep(rings.withColumns({"id": F.monotonically_increasing_id(), "mark": sure("v")}), "rings-0"), 0
    bare = scratch.keep(now.where("v is null").select("key", "bare"), "bare")
    now = now.where("v is not null").drop("bare")

    def without(gone: DataFrame) -> DataFrame:
        left = F.array_except(F.sequence(F.lit(0), F.size("v") - 1), "numbers")
        kept = now.drop("mark").join(shuffled(gone), "id", "left").withColumn("v", F.when(F.col("numbers").isNull(), F.col("v")).otherwise(F.transform(left, lambda i: F.col("v")[i])))
        return scratch.keep(kept.drop("numbers").withColumn("mark", flat("v")), f"rings-{k + 1}")

    gone = _agreed(now, "mark")
    while True:
        now, k = without(gone), k + 1
        for name in ("rings", "turn", "gone"):
            scratch.remove(f"{name}-{k - 1}")
        free = scratch.keep(_agreed(now, "mark").withColumnRenamed("numbers", "free"), f"free-{k}")
        if free.isEmpty():
            break
        hashed = now.drop("mark").join(shuffled(free), "id").withColumn("h", F.transform("v", lambda p: F.xxhash64(p["x"], p["y"])))
        turn = scratch.keep(hashed.select("id", "v", "free", going("h", "free").alias("goes")), f"turn-{k}")
        gone = scratch.keep(_agreed(turn, "goes", "free"), f"gone-{k}")
        if gone.isEmpty():  # what may go would leave a ring too small, or neighbours wait for each other in different rings
            break
    made = now.select("shape", "key", "polygon", "ring", F.concat("v", F.slice("v", 1, 1)).alias("r")).repartition("shape")
    polygons = made.groupBy("shape", "polygon").agg(F.first("key").alias("key"), F.transform(F.array_sort(F.collect_list(F.struct("ring", "r"))), lambda x: x["r"]).alias("p"))
    done = polygons.groupBy("shape").agg(F.first("key").alias(key), F.transform(F.array_sort(F.collect_list(F.struct("polygon", "p"))), lambda x: x["p"]).alias(geometry))
    return done.drop("shape").union(bare)
