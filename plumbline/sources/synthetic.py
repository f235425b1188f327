"""Synthetic outlines and points for experiments, from hashes, so any partitioning gives the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, *keys: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _normal(seed: int, *keys: Column) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed, *keys))) * F.cos(2 * math.pi * _uniform(seed + 1, *keys))


def circle_points(spark: SparkSession, n: int, radius: float, noise: float, seed: int = 0) -> DataFrame:
    """(point_id, X, Y, inward_x, inward_y, weight): points about a circle, looking to its centre."""
    angle = F.col("id") * (2 * math.pi / n)
    r = radius + noise * _normal(seed, F.col("id"))
    return spark.range(n).select(
        F.col("id").alias("point_id"), (r * F.cos(angle)).alias("X"), (r * F.sin(angle)).alias("Y"), (-F.cos(angle)).alias("inward_x"), (-F.sin(angle)).alias("inward_y"),
        F.lit(6).alias("Classification"), F.lit(1.0).alias("weight"),
    )


def circle_edges(spark: SparkSession, corners: int, radius: float, noise: float, seed: int = 0) -> DataFrame:
    """A noisy polygon about a circle as edges of one unit, each edge a group of its own."""

    def corner(i: Column) -> tuple[Column, Column]:
        angle = i * (2 * math.pi / corners)
        r = radius + noise * _normal(seed + 7, i)
        return r * F.cos(angle), r * F.sin(angle)

    i, j = F.col("id"), (F.col("id") + 1) % corners
    (x0, y0), (x1, y1) = corner(i), corner(j)
    zero = F.lit(0.0)
    return spark.range(corners).select(
        F.lit("u").alias("unit_id"), i.alias("group_id"), i.alias("edge_key"), F.lit("circle").alias("cleabs"), F.lit(0).alias("idx_polygon"), F.lit(0).alias("idx_ring"), i.cast("int").alias("idx_edge"),
        x0.alias("start_x"), y0.alias("start_y"), zero.alias("start_z"), x1.alias("end_x"), y1.alias("end_y"), zero.alias("end_z"),
    )


def edge_samples(edges: DataFrame, per_metre: float, noise: float, seed: int = 0) -> DataFrame:
    """(edge_key, X, Y): points along each edge, as many as its length asks for, off it by noise."""
    dx, dy = F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y")
    size = F.sqrt(dx * dx + dy * dy)
    n = F.greatest(F.lit(1), F.ceil(size * per_metre).cast("int"))
    out = edges.withColumn("__i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("__n", n)
    t = (F.col("__i") + _uniform(seed, F.col("edge_key"), F.col("__i"))) / F.col("__n")
    off = noise * _normal(seed + 3, F.col("edge_key"), F.col("__i"))
    return out.select("edge_key", (F.col("start_x") + t * dx + off * dy / size).alias("X"), (F.col("start_y") + t * dy - off * dx / size).alias("Y"))
