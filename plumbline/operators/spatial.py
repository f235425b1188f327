"""Spatial joins as equi-joins on grid cells, and joins to a trajectory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.keys import shuffled


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def _range(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(low, high))


def _apart(condition: Column) -> Column:
    """``condition`` as a function of its own: a join is compiled into one method with its condition, and Java leaves a method
    of over 8000 bytes uncompiled, which made joins with long conditions several times slower."""
    return F.exists(F.array(F.lit(0)), lambda _: condition)


def box_join(left: DataFrame, right: DataFrame, size: float | None, left_box: tuple[str, ...], right_box: tuple[str, ...], residual: Column | None = None, how: str = "inner", same: tuple[str, str] | None = None) -> DataFrame:
    """Pairs whose boxes (xmin, ymin, xmax, ymax; column names, all different) meet, each once.

    A box is in every cell that it touches; a pair is kept in the cell of the larger of the two lower-left
    corners only. ``how`` is inner or left_semi; ``same`` names a column of
    each side that must be equal; where few rows share a value of it, no cells are needed (``size`` is None). The cell should be about as large as most boxes.
    """
    a, b = [F.col(c) for c in left_box], [F.col(c) for c in right_box]
    meets = (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])
    if same is not None:
        meets = (F.col(same[0]) == F.col(same[1])) & meets
    if residual is not None:
        meets &= _apart(residual)
    if size is None:
        return left.join(shuffled(right), meets, how)
    grid = lambda df, b, p: df.withColumn(f"__{p}x", _range(_cell(F.col(b[0]), size), _cell(F.col(b[2]), size))).withColumn(f"__{p}y", _range(_cell(F.col(b[1]), size), _cell(F.col(b[3]), size)))
    l, r = grid(left, left_box, "l"), grid(right, right_box, "r")  # noqa: E741
    owner = (F.col("__lx") == F.greatest(_cell(a[0], size), _cell(b[0], size))) & (F.col("__ly") == F.greatest(_cell(a[1], size), _cell(b[1], size)))
    on = (F.col("__lx") == F.col("__rx")) & (F.col("__ly") == F.col("__ry")) & owner & meets
    return l.join(shuffled(r), on, how).drop("__lx", "__ly", "__rx", "__ry")


def radius_join(left: DataFrame, right: DataFrame, radius: float, left_xy: tuple[str, str], right_xy: tuple[str, str], residual: Column | None = None) -> DataFrame:
    """Pairs of points within ``radius`` in the plane: the right side is shown in its 3 x 3 cells."""
    l = left.withColumn("__lx", _cell(F.col(left_xy[0]), radius)).withColumn("__ly", _cell(F.col(left_xy[1]), radius))  # noqa: E741
    around = lambda c: _range(_cell(F.col(c), radius) - 1, _cell(F.col(c), radius) + 1)
    r = right.withColumn("__rx", around(right_xy[0])).withColumn("__ry", around(right_xy[1]))
    dx, dy = F.col(left_xy[0]) - F.col(right_xy[0]), F.col(left_xy[1]) - F.col(right_xy[1])
    on = (F.col("__lx") == F.col("__rx")) & (F.col("__ly") == F.col("__ry")) & (dx * dx + dy * dy <= radius * radius)
    return l.join(shuffled(r), on if residual is None else on & _apart(residual)).drop("__lx", "__ly", "__rx", "__ry")


def nearest(left: DataFrame, right: DataFrame, k: int, radius: float, left_id: str, left_xy: tuple[str, str], right_id: str, right_xy: tuple[str, str]) -> DataFrame:
    """The ``k`` nearest right points within ``radius`` of each left point, with their rank from 1; of equally near ones
    the least ids come first.

    Points of one place have the same neighbours, so each place is looked at once; of the right points of a place
    only the ``k`` least ids can be among the nearest of any.
    """
    least = F.row_number().over(Window.partitionBy(*right_xy).orderBy(right_id))
    few = right.withColumn("__k", least).where(F.col("__k") <= k).drop("__k")
    pairs = radius_join(left.select(*left_xy).distinct(), few, radius, left_xy, right_xy)
    dx, dy = F.col(left_xy[0]) - F.col(right_xy[0]), F.col(left_xy[1]) - F.col(right_xy[1])
    rank = F.row_number().over(Window.partitionBy(*left_xy).orderBy(dx * dx + dy * dy, right_id))
    found = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
    return left.join(shuffled(found), list(left_xy)).select(*left.columns, *right.columns, "rank")


def interpolate(df: DataFrame, time: str, knots: DataFrame, bucket: float, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """``df`` with the knots' columns at its times: between two knots linear, beyond them on the line of the
    first or last two. ``knots`` has t and the columns; of knots with one t the last row counts (by ``seq``).

    A knot opens an interval up to the next one. Rows and knots are ordered together inside time buckets, where a row takes
    the last knot before it; one row a bucket that holds any carries the last knot on, so a pause of any length between
    knots costs nothing, and no task sees more than a bucket or the row per bucket. Times before the first and after the
    last knot go to the end intervals.
    """
    knots = knots.where("t is not null").groupBy("t").agg(F.max_by(F.struct(*columns), "seq").alias("p"))
    # A bucket's last knot leads to the first one of the next bucket that has any.
    knots = knots.withColumn("__b", F.floor(F.col("t") / bucket))
    own, order = Window.partitionBy("__b").orderBy("t"), Window.orderBy("__b")
    firsts = knots.groupBy("__b").agg(F.min_by(F.struct("t", "p"), "t").alias("first"))
    after = firsts.select("__b", F.lead("first").over(order).alias("after"))
    pieces = knots.select("__b", "t", "p", F.lead("t").over(own).alias("t1"), F.lead("p").over(own).alias("p1")).join(shuffled(after), "__b")
    pieces = pieces.select("__b", F.struct("t", "p", F.coalesce("t1", "after.t").alias("t1"), F.coalesce("p1", "after.p").alias("p1")).alias("__k")).where("__k.t1 is not null")
    ends = F.broadcast(pieces.agg(F.min("__k.t").alias("__low"), F.max("__k.t").alias("__high")))  # one row
    at = F.col(time)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    held = df.join(ends).where(at.isNotNull()).select(F.greatest(F.least(at, F.col("__high")), F.col("__low")).alias("__at"), row.alias("__row"), F.lit(None).cast(pieces.schema["__k"].dataType).alias("__k"))
    both = held.unionByName(pieces.select(F.col("__k.t").alias("__at"), F.lit(None).cast(held.schema["__row"].dataType).alias("__row"), "__k"))
    both = both.withColumn("__b", F.floor(F.col("__at") / bucket))
    # A knot comes before the rows of its time.
    last = Window.partitionBy("__b").orderBy("__at", F.col("__k").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.groupBy("__b").agg(F.max_by("__k", F.when(F.col("__k").isNotNull(), F.col("__at"))).alias("k"))
    carried = carried.select("__b", F.last("k", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    found = both.withColumn("__own", F.last("__k", True).over(last)).where("__row is not null").join(shuffled(carried), "__b")
    found = found.select("__row", F.coalesce("__own", "__before").alias("__k")).where("__k is not null")
    u = (F.col(f"__row.`{time}`") - F.col("__k.t")) / (F.col("__k.t1") - F.col("__k.t"))
    out = [((1 - u) * F.col(f"__k.p.{c}") + u * F.col(f"__k.p1.{c}")).alias(f"scanner_{c}") for c in columns]
    return found.select(*[F.col(f"__row.`{c}`").alias(c) for c in df.columns], *out)
