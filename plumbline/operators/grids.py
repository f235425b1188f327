"""Tile grids, best tile for a box, and grids of parameters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.spatial import box_join


def tiles(boxes: DataFrame, size: int) -> DataFrame:
    """The tiles of integer boxes (x0, x1, y0, y1; the upper ends not included), with their four-digit names."""
    index = lambda c: F.floor(c / size).cast("long")
    out = boxes.withColumn("tile_x", F.explode(F.sequence(index(F.col("x0")), index(F.col("x1") - 1))))
    out = out.withColumn("tile_y", F.explode(F.sequence(index(F.col("y0")), index(F.col("y1") - 1))))
    four = lambda c: F.lpad(F.col(c).cast("string"), 4, "0")
    return out.withColumn("name", F.concat_ws("_", four("tile_x"), four("tile_y")))


def best_overlap(wanted: DataFrame, offered: DataFrame, wanted_box: tuple[str, ...], offered_box: tuple[str, ...], key: str, name: str, least: float, cell: float = 8.0) -> DataFrame:
    """Per wanted box the offered one that covers the largest share of it, if that is over ``least``; of equals the first name."""
    a, b = [F.col(c) for c in wanted_box], [F.col(c) for c in offered_box]
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    share = side(0) * side(1) / ((a[2] - a[0]) * (a[3] - a[1]))
    met = box_join(wanted, offered, cell, wanted_box, offered_box).select(key, name, share.alias("share"))
    best = met.groupBy(key).agg(F.min_by(name, F.struct(-F.col("share"), F.col(name))).alias(name), F.round(F.max("share"), 6).alias("overlap"), F.max("share").alias("s"))
    return best.where(F.col("s") > least).select(key, name, "overlap")


def parameter_grid(spark: SparkSession, spec: dict) -> DataFrame:
    """Every combination of the lists in ``variable`` over ``fixed``; of a name set twice the later list's value counts."""
    names = sorted({k for k in spec.get("fixed", {})} | {k for options in spec.get("variable", []) for o in options for k in o})
    grid = spark.range(1).select(F.lit(0).cast("long").alias("experiment"), F.lit(json.dumps(spec.get("fixed", {}))).alias("p0"))
    for i, options in enumerate(spec.get("variable", []), 1):
        each = F.posexplode(F.array(*[F.lit(json.dumps(o)) for o in options])).alias("n", f"p{i}")
        grid = grid.select("*", each).withColumn("experiment", F.col("experiment") * len(options) + F.col("n")).drop("n")
    last = len(spec.get("variable", []))
    value = lambda k: F.coalesce(*[F.get_json_object(f"p{i}", f"$.{k}") for i in range(last, -1, -1)]).cast("long").alias(k)
    return grid.select("experiment", *[value(k) for k in names])
