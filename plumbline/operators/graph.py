"""Connected components and reachability over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from plumbline.operators.keys import shuffled
from plumbline.plans.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node tells its larger neighbours of the least node it knows."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(shuffled(least), "u")
    return tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(window: int, schema: pa.Schema):
    """Edges to one edge from each node to the least of those that a task's edges tie it to, of up to ``window`` nodes at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = {}

        def least(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        def tied() -> pa.RecordBatch:
            pairs = [(x, r) for x in list(up) if (r := least(x)) != x]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], schema.types[i]) for i in (0, 1)], schema=schema)

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = least(u), least(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
                if len(up) >= window:
                    yield tied()
        yield tied()

    return run


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, label: str = "components", most_rounds: int = 60, window: int = 200_000) -> DataFrame:
    """(id, component) for each node of ``edges`` (two columns of one ordered type); component is the least id.

    Edges are dealt by range, and each task first ties the nodes that its own edges connect to their least, so that long ways among near
    ids are one step. Then alternating large and small stars: the rounds grow with the logarithm of the diameter, no node's
    neighbours are ever gathered, and each round's edges are written to the shared folder, which cuts lineage.
    Loops and repeated edges do no harm; edges with a null end are left out.
    """
    a, b = edges.columns
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    now = scratch.keep(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}-0")
    loops = now.where("u = v").select("u")
    kind = now.schema["u"].dataType
    if not isinstance(kind, (StructType, ArrayType)):
        schema = StructType([StructField(c, kind) for c in "uv"])
        now = scratch.keep(now.where("u <> v").repartitionByRange("v").sortWithinPartitions("v").mapInArrow(_stars(window, to_arrow_schema(schema)), schema), f"{label}-stars")
    state = None
    for k in range(1, most_rounds + 1):
        now = scratch.keep(_small_star(_large_star(now.where("u <> v"))), f"{label}-{k}")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if k > 2:
            scratch.remove(f"{label}-{k - 2}")
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    roots = now.select("v").distinct()
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("id"), F.col("v").alias("component")))
    alone = loops.join(shuffled(ids), loops.u == ids.id, "left_anti").select(F.col("u").alias("id"), F.col("u").alias("component"))
    return ids.union(alone.distinct())
