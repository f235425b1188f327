"""How well outlines match the ground truth, one by one and as groups that touch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geo
from plumbline.functions.overlay import iou_series
from plumbline.operators import arrange
from plumbline.operators.graph import connected_components
from plumbline.operators.keys import shuffled
from plumbline.operators.spatial import box_join, radius_join
from plumbline.plans.scratch import Scratch


def check_rows(df: DataFrame, key: str, geometry: str) -> None:
    """One pass over the table; raises where an id is null or repeated, or a geometry is null."""
    r = df.agg(F.count("*").alias("n"), F.count(key).alias("keys"), F.countDistinct(key).alias("distinct"), F.count(geometry).alias("shapes")).first()
    for bad, what in ((r["n"] - r["keys"], "null ids"), (r["keys"] - r["distinct"], "repeated ids"), (r["n"] - r["shapes"], "null geometries")):
        if bad:
            raise ValueError(f"{bad} {what}")


def touching(shapes: DataFrame, key: str, box: tuple[str, ...], cell: float = 8.0) -> DataFrame:
    """Pairs (a before b) of rectangles that share boundary points but no inside."""
    side = lambda p: shapes.select(F.col(key).alias(p), *[F.col(c).alias(f"{p}{i}") for i, c in enumerate(box)])
    inside = (F.least("a2", "b2") > F.greatest("a0", "b0")) & (F.least("a3", "b3") > F.greatest("a1", "b1"))
    met = box_join(side("a"), side("b"), cell, ("a0", "a1", "a2", "a3"), ("b0", "b1", "b2", "b3"), (F.col("a") < F.col("b")) & ~inside)
    return met.select("a", "b")


def aggregate_id(ids: Column) -> Column:
    return F.concat(F.lit("agg_"), F.substring(F.sha1(F.array_join(F.array_sort(ids), ",").cast("binary")), 1, 12))


def _roots(spark: SparkSession, shapes: DataFrame, key: str, box: tuple[str, ...], geometry: str) -> DataFrame:
    met = arrange.touching(spark, shapes, key, geometry) if geometry else touching(shapes, key, box)
    found = connected_components(spark, met, Scratch(spark, "touching"))
    return shapes.select(key).join(shuffled(found), F.col(key) == F.col("id"), "left").select(key, F.coalesce("component", key).alias("root"))


def aggregated(spark: SparkSession, shapes: DataFrame, key: str, box: tuple[str, ...] = (), geometry: str = "") -> DataFrame:
    """Components of touching shapes: ground_truth_aggregate_id and ground_truth_ids.

    Shapes are rectangles that ``box`` names, or multipolygons of any form in ``geometry``.
    """
    groups = _roots(spark, shapes, key, box, geometry).groupBy("root").agg(F.array_sort(F.collect_list(key)).alias("ground_truth_ids"))
    return groups.select(aggregate_id(F.col("ground_truth_ids")).alias("ground_truth_aggregate_id"), "ground_truth_ids")


def members(spark: SparkSession, shapes: DataFrame, key: str, box: tuple[str, ...] = (), geometry: str = "") -> DataFrame:
    """The same groups as a row for each shape: ground_truth_aggregate_id and the key.

    Names come sorted and the id is digested name by name, so no row or task holds a group of any size.
    """
    scratch = Scratch(spark, "members")
    of = scratch.keep(_roots(spark, shapes, key, box, geometry), "roots")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(root: str, sha) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([root], pa.string()), pa.array([f"agg_{sha.hexdigest()[:12]}"], pa.string())], ["root", "ground_truth_aggregate_id"])

        last, sha = None, None
        for b in batches:
            for root, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if root != last:
                    if sha is not None:
                        yield made(last, sha)
                    last, sha = root, hashlib.sha1(name.encode())
                else:
                    sha.update(b"," + name.encode())
        if sha is not None:
            yield made(last, sha)

    ids = of.select("root", F.col(key).alias("name")).repartition("root").sortWithinPartitions("root", "name").mapInArrow(digest, "root string, ground_truth_aggregate_id string")
    return of.join(shuffled(ids), "root").select("ground_truth_aggregate_id", key)


def ring_samples(ring: Column, spacing: float) -> Column:
    """Points along a ring at 0, s, 2s, ... below its length; one point for a ring without length."""
    if spacing <= 0:
        raise ValueError("the spacing must be positive")
    edges = F.transform(geo.ring_edges(ring), lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), geo.length(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]).alias("d")))
    placed = F.aggregate(
        edges,
        F.expr("struct(cast(0 as double) as at, cast(array() as array<struct<ax:double,ay:double,bx:double,by:double,d:double,at:double>>) as e)"),
        lambda s, e: F.struct((s["at"] + e["d"]).alias("at"), F.concat(s["e"], F.array(F.struct(e["a"]["x"].alias("ax"), e["a"]["y"].alias("ay"), e["b"]["x"].alias("bx"), e["b"]["y"].alias("by"), e["d"].alias("d"), s["at"].alias("at")))).alias("e")),
        lambda s: s["e"],
    )

    def along(e: Column) -> Column:
        first, last = F.ceil(e["at"] / spacing), F.ceil((e["at"] + e["d"]) / spacing) - 1
        t = lambda i: (i * spacing - e["at"]) / e["d"]
        steps = F.when((e["d"] > 0) & (last >= first), F.sequence(first, last)).otherwise(F.expr("cast(array() as array<bigint>)"))
        return F.transform(steps, lambda i: F.struct((e["ax"] + t(i) * (e["bx"] - e["ax"])).alias("x"), (e["ay"] + t(i) * (e["by"] - e["ay"])).alias("y")))

    found = F.flatten(F.transform(placed, along))
    start = F.array(F.struct(ring[0]["x"].alias("x"), ring[0]["y"].alias("y")))
    return F.when(F.size(found) == 0, start).otherwise(found)


#: Samples of one boundary that are measured at once against the other's edges.
SAMPLES_AT_ONCE = 1 << 12


def _ring_arrays(shape) -> list[np.ndarray]:
    return [np.array([(p["x"], p["y"]) for p in ring], float) for polygon in shape for ring in polygon if len(ring)]


def _samples(ring: np.ndarray, spacing: float) -> np.ndarray:
    """Points along a ring at 0, s, 2s, ... below its length; its first point if it has none."""
    step = np.diff(ring, axis=0)
    size = np.hypot(*step.T)
    upto = np.concatenate([[0.0], np.cumsum(size)])
    at = np.arange(int(np.ceil(upto[-1] / spacing))) * spacing
    if not len(at):
        return ring[:1]
    edge = np.minimum(np.searchsorted(upto, at, "right") - 1, len(size) - 1)
    part = (at - upto[edge]) / np.where(size[edge] > 0, size[edge], 1.0)
    return ring[edge] + part[:, None] * step[edge]


def _mean_gap(source: list[np.ndarray], target: list[np.ndarray], spacing: float) -> float:
    a, d = np.concatenate([r[:-1] for r in target]), np.concatenate([np.diff(r, axis=0) for r in target])
    square = np.maximum((d**2).sum(1), np.finfo(float).tiny)
    total, n = 0.0, 0
    for ring in source:
        points = _samples(ring, spacing)
        for k in range(0, len(points), SAMPLES_AT_ONCE):
            gap = points[k : k + SAMPLES_AT_ONCE, None] - a
            t = np.clip((gap * d).sum(2) / square, 0.0, 1.0)
            total += np.sqrt(((gap - t[..., None] * d) ** 2).sum(2)).min(1).sum()
        n += len(points)
    return total / n


def boundary_distances(spacing: float):
    """A UDF: mean distances (there, back) from samples of each one of two multipolygons' rings to the other's boundary."""
    if spacing <= 0:
        raise ValueError("the spacing must be positive")

    @F.pandas_udf("there double, back double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            one, two = (_ring_arrays(s) if s is not None else [] for s in (x, y))
            held = any(len(r) > 1 for r in one) and any(len(r) > 1 for r in two)
            rows.append((_mean_gap(one, two, spacing), _mean_gap(two, one, spacing)) if held else (None, None))
        return pd.DataFrame(rows, columns=["there", "back"], dtype=float)

    return run


def centroid(multipolygon: Column) -> Column:
    """Centroid by area of all polygons, holes taken off."""
    rings = F.flatten(F.transform(multipolygon, lambda p: F.transform(p, lambda r, i: F.struct(r.alias("r"), F.when(i == 0, 1.0).otherwise(-1.0).alias("sign")))))

    def moment(r: Column) -> Column:
        return F.aggregate(
            geo.ring_edges(r["r"]),
            F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
            lambda s, e: F.struct(
                (s["a"] + geo.cross(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])).alias("a"),
                (s["x"] + (e["a"]["x"] + e["b"]["x"]) * geo.cross(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])).alias("x"),
                (s["y"] + (e["a"]["y"] + e["b"]["y"]) * geo.cross(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])).alias("y"),
            ),
        )

    def add(s: Column, r: Column) -> Column:
        m = moment(r)
        side = r["sign"] * F.signum(m["a"])
        return F.struct((s["a"] + side * m["a"]).alias("a"), (s["x"] + side * m["x"]).alias("x"), (s["y"] + side * m["y"]).alias("y"))

    total = F.aggregate(rings, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), add)
    return F.transform(F.array(total), lambda m: F.struct((m["x"] / (3 * F.nullif(m["a"], F.lit(0.0)))).alias("x"), (m["y"] / (3 * F.nullif(m["a"], F.lit(0.0)))).alias("y")))[0]


def compare(pairs: DataFrame, key: str, truth: str, found: str, spacing: float) -> DataFrame:
    """The five measures of each pair of multipolygons (columns ``truth`` and ``found``)."""
    iou = F.pandas_udf(iou_series, "double")
    # Small tables, which are much work here, come in one or two partitions.
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    c = pairs.withColumns({"ct": centroid(F.col(truth)), "cf": centroid(F.col(found))})
    gap = F.coalesce(geo.length(F.col("ct.x") - F.col("cf.x"), F.col("ct.y") - F.col("cf.y")), F.lit(0.0))
    measured = c.select(key, iou(F.col(truth), F.col(found)).alias("iou"), gap.alias("centroid_distance_m"), boundary_distances(spacing)(F.col(truth), F.col(found)).alias("d"))
    there, back = F.col("d.there"), F.col("d.back")
    return measured.select(
        key, "iou", "centroid_distance_m", there.alias("ground_truth_to_scored_boundary_distance_m"), back.alias("scored_to_ground_truth_boundary_distance_m"), ((there + back) / 2).alias("symmetric_boundary_distance_m")
    )


MEASURES = ("iou", "ground_truth_to_scored_boundary_distance_m", "scored_to_ground_truth_boundary_distance_m", "symmetric_boundary_distance_m", "centroid_distance_m")


def summary(compared: DataFrame, truth: DataFrame, scored: DataFrame) -> DataFrame:
    """How many outlines there are on each side, matched and ignored, and the means of all measures (0 for none).

    ``compared`` has one row a match; one-row aggregates are joined.
    """
    means = compared.agg(F.count("*").alias("matched_count"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"mean_{c}") for c in MEASURES])
    sizes = truth.agg(F.count("*").alias("ground_truth_count")).crossJoin(scored.agg(F.count("*").alias("scored_count")))
    out = sizes.crossJoin(means)
    ignored = [(F.col(c) - F.col("matched_count")).alias(f"ignored_{c}") for c in ("ground_truth_count", "scored_count")]
    return out.select("ground_truth_count", "scored_count", "matched_count", *ignored, *[f"mean_{c}" for c in MEASURES])


def keep_columns(df: DataFrame, key: str, geometry: str, wanted: list[str]) -> list[str]:
    """The wanted columns once each, without key and geometry; one that ``df`` lacks raises."""
    out = [c for c in dict.fromkeys(wanted) if c not in (key, geometry)]
    for c in out:
        if c not in df.columns:
            raise ValueError(f"the ground truth has no column {c}")
    return out


def snap_vertices(spark: SparkSession, vertices: DataFrame, threshold: float) -> DataFrame:
    """(vertex, x, y): vertices whose chains of neighbours within ``threshold`` join them take the place of the least of them."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    side = lambda p: vertices.select(F.col("vertex").alias(p), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    near = radius_join(side("a"), side("b"), threshold, ("ax", "ay"), ("bx", "by"), F.col("a") < F.col("b")).select("a", "b")
    found = connected_components(spark, near, Scratch(spark, "snap"))
    of = vertices.select("vertex").join(shuffled(found), F.col("vertex") == F.col("id"), "left").select("vertex", F.coalesce("component", "vertex").alias("root"))
    place = vertices.select(F.col("vertex").alias("root"), "x", "y")
    return of.join(shuffled(place), "root").select("vertex", "x", "y")


def clean_rings(vertices: DataFrame, snapped: DataFrame) -> DataFrame:
    """Rings of snapped vertices without repeated neighbours; those with fewer than four points go.

    ``vertices`` has vertex, cleabs, ring and i (the closing point is not among them).
    """
    made = vertices.select("vertex", "cleabs", "ring", "i").join(shuffled(snapped), "vertex").groupBy("cleabs", "ring").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    point = F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    made = made.select("cleabs", "ring", point.alias("p"))
    distinct = F.filter("p", lambda p, i: (i == 0) | (p != F.col("p")[F.greatest(i - 1, F.lit(0))]))
    made = made.select("cleabs", "ring", distinct.alias("p"))
    closed = F.when(F.element_at("p", -1) == F.element_at("p", 1), F.col("p")).otherwise(F.concat("p", F.slice("p", 1, 1)))
    return made.select("cleabs", "ring", closed.alias("points")).where(F.size("points") >= 4)
