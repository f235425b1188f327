"""Readers: typed Parquet columns, outlines in well-known binary, trajectories, experiment specifications."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geo
from plumbline.operators.counters import Counters
from plumbline.operators.keys import numbered, shuffled
from plumbline.sources.wkb import from_wkb

#: Stored types that may be read as a narrower or signed one, with a checked cast.
WIDENINGS = {"smallint": ("tinyint", "int", "bigint"), "int": ("smallint", "bigint"), "bigint": ("int", "decimal(20,0)"), "double": ("float",)}


def read_columns(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns as the wanted types (Spark's names); a missing column or another type raises, and so
    does a value that the type can't hold when it is read."""
    found = spark.read.parquet(path)
    types = dict(found.dtypes)
    out = []
    for name, kind in wanted.items():
        if name not in types:
            raise ValueError(f"{path} has no column {name}")
        if types[name] != kind and types[name] not in WIDENINGS.get(kind, ()):
            raise TypeError(f"{name} is {types[name]}, not {kind}")
        narrower = types[name] != kind and kind != "double"
        raw = F.col(f"`{name}`")
        lost = raw.isNotNull() & raw.try_cast(kind).isNull()
        value = F.when(lost, F.raise_error(F.lit(f"{name} has values outside {kind}"))).otherwise(raw.try_cast(kind)) if narrower else raw.cast(kind)
        out.append(value.alias(name))
    return found.select(*out)


def read_outlines(spark: SparkSession, path: str, key: str = "cleabs", geometry: str = "geometry") -> DataFrame:
    """Outlines from Parquet with well-known binary: all columns, the geometry parsed and its rings turned (exteriors
    counter-clockwise, holes clockwise), the number in the id added; rows without id or geometry are left out."""
    raw = spark.read.parquet(path).where(F.col(key).isNotNull() & F.col(geometry).isNotNull())
    out = raw.withColumn(geometry, from_wkb(F.col(geometry))).where(F.col(geometry).isNotNull())
    out = out.withColumn(geometry, F.transform(geometry, geo.force_ccw))
    return out.withColumn(f"{key}_int", F.substring(key, 9, 1 << 30).try_cast("bigint"))


def read_edges(spark: SparkSession, edges_path: str, overlaps_path: str) -> tuple[DataFrame, DataFrame, Counters]:
    """Edges with their row (from 0, in the order of edge_key), and the overlaps whose two edges are known, as rows.

    The counters tell, once the overlaps have been written or counted, how many were read and how many skipped.
    """
    edges = numbered(spark, spark.read.parquet(edges_path), ["edge_key"], "row", 0)
    counters = Counters()
    of = lambda p: edges.select(F.col("edge_key").alias(f"edge_key_{p}"), F.col("row").alias(f"row_{p}"))
    met = spark.read.parquet(overlaps_path).join(shuffled(of("a")), "edge_key_a", "left").join(shuffled(of("b")), "edge_key_b", "left")
    known = F.col("row_a").isNotNull() & F.col("row_b").isNotNull()
    met = counters.watch(met, overlaps_read=F.count("*"), overlaps_skipped=F.count_if(~known))
    return edges, met.where(known), counters


#: Ids up to this many are pushed to the scan as a list.
MOST_LISTED = 1000


def read_scored(spark: SparkSession, path: str, ids: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns of the rows of a Parquet table whose key is among ``ids`` (one column).

    Few ids reach the scan as a list; of more, the least and the largest do, which lets row groups of a clustered
    table be skipped, and a semi join looks at the rest. The ids are counted first, and only a short list comes to the driver.
    """
    name = ids.columns[0]
    ids = ids.select(F.col(f"`{name}`").alias("__id")).where("__id is not null").distinct()
    seen = ids.agg(F.count("*").alias("n"), F.min("__id").alias("low"), F.max("__id").alias("high")).first()
    found = spark.read.parquet(path).select(*dict.fromkeys([key, *columns]))
    if seen["n"] <= MOST_LISTED:
        return found.where(F.col(key).isin([r[0] for r in ids.collect()]))
    return found.where(F.col(key).between(seen["low"], seen["high"])).join(ids, F.col(key) == F.col("__id"), "left_semi")


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Knots (seq, t, x, y, z) of text lines ``t x y z``; a bad line raises when it is read. Empty lines don't count."""
    raw = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    value = lambda i: F.try_element_at(parts, F.lit(i + 1)).try_cast("double")
    bad = (F.size(parts) != 4) | F.exists(F.array(*[value(i) for i in range(4)]), lambda v: v.isNull())
    message = F.concat(F.lit("not t x y z: "), F.col("value"))
    checked = lambda i: F.when(bad, F.raise_error(message)).otherwise(value(i))
    return raw.select("seq", *[checked(i).alias(c) for i, c in enumerate("txyz")])


def read_experiments(spark: SparkSession, path: str) -> dict[str, dict]:
    """Leaves of a specification: name -> {fixed, variable}; inner ``specific`` entries add to what stands above them."""
    text = spark.read.text(path, wholetext=True).first()[0]
    out: dict[str, dict] = {}

    def walk(node: dict, name: str, fixed: dict, variable: list) -> None:
        fixed, variable = fixed | node.get("fixed", {}), [*variable, *node.get("variable", [])]
        inner = node.get("specific")
        if not inner:
            out[name or "all"] = {"fixed": fixed, "variable": variable}
        for key, child in (inner or {}).items():
            walk(child, f"{name}/{key}" if name else key, fixed, variable)

    walk(json.loads(text), "", {}, [])
    return out
