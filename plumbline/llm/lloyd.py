"""Plain Lloyd clustering in integers, the same on any number of machines.

A vector is kept if it has exactly ``DIMENSIONS`` components, none null or not finite; a component x becomes
floor(256 * x), with x as double. Centroids are broadcast (``k`` rows of ``DIMENSIONS`` integers, whatever the table's
size). Each task takes integer squared differences to one centroid after the other in NumPy, and argmin takes the lowest
of equals; a task adds up its own vectors by centroid, and these sums, one row a task and centroid, are merged by a
grouped sum. Sums of integers do not depend on the order, so neither does any result, and a lost task is done again.

Edge cases: with fewer kept vectors than centroids there are as many centroids as vectors; vectors without an id are
assigned but do not start centroids; rows with one id that start centroids come in the order of their components;
a kept vector with a component beyond +-2**27 after scaling has no distance in a long, so such vectors are left
out; columns of any name ride along unread; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.scratch import Scratch

DIMENSIONS, SCALE = 64, 256
#: Scaled components beyond this have squared distances that a long may not hold.
LARGEST = 1 << 27
#: Vectors that are compared with the centroids at once.
BLOCK = 4096


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The kept rows of a column of float arrays (by number), and their scaled components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    fits = (np.diff(offsets) == DIMENSIONS) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.nonzero(fits)[0]
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become not-a-number
    x = np.floor(SCALE * values[offsets[rows][:, None] + np.arange(DIMENSIONS)])
    with np.errstate(invalid="ignore"):
        held = (np.abs(x) <= LARGEST).all(1)
    return rows[held], x[held].astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, the lowest of equals, and the squared distance."""
    cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        d = np.empty((len(centroids), len(part)), np.int64)
        for k, c in enumerate(centroids):
            gap = part - c
            d[k] = np.einsum("ij,ij->i", gap, gap)
        cluster[at : at + BLOCK] = d.argmin(0)
        distance[at : at + BLOCK] = d.min(0)
    return cluster, distance


def _starts(df: DataFrame, k: int, seed: int) -> np.ndarray:
    """The kept vectors with the least hashes of their ids; ``k`` rows come to the driver."""
    scaled = lambda v: SCALE * v.cast("double")
    fits = F.forall("vector", lambda v: (scaled(v) >= -LARGEST) & (scaled(v) < LARGEST + 1))  # not-a-number is above all
    held = df.where(F.col("id").isNotNull() & (F.size("vector") == DIMENSIONS) & F.coalesce(fits, F.lit(False)))
    x = F.transform("vector", lambda v: F.floor(scaled(v)))
    rows = held.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), x.alias("x")).orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64).reshape(-1, DIMENSIONS)


def lloyd(spark: SparkSession, df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector."""
    df = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"))
    schema = "vec_id long, cluster int, distance long"
    centroids = _starts(df, k, seed)
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], result)
    sums = ", ".join(f"s{i} long" for i in range(DIMENSIONS))
    names = [f"s{i}" for i in range(DIMENSIONS)]

    for _ in range(rounds):
        now = spark.sparkContext.broadcast(centroids)

        def add(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(now.value), np.zeros(len(now.value), np.int64)
            for b in batches:
                _, x = integers(b.column(0))
                cluster, _ = nearest(x, now.value)
                np.add.at(n, cluster, 1)
                order = np.argsort(cluster, kind="stable")
                there, first = np.unique(cluster[order], return_index=True)
                if len(there):
                    total[there] += np.add.reduceat(x[order], first, axis=0)
            held = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held]), *[pa.array(total[held, i]) for i in range(DIMENSIONS)]], ["cluster", "n", *names])

        own = df.select("vector").mapInArrow(add, f"cluster int, n long, {sums}")
        merged = own.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect()
        centroids = centroids.copy()
        for r in merged:
            centroids[r["cluster"]] = np.array([r[c] for c in names], np.int64) // r["n"]
        now.destroy()

    last = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = integers(b.column(1))
            cluster, distance = nearest(x, last.value)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = Scratch(spark, "lloyd").keep(df.select("id", "vector").mapInArrow(assign, schema), "assigned")
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k rows
    whole = sum(inertia.values())
    digests = spark.createDataFrame([(c, ",".join(map(str, x)), int(inertia.get(c, 0)), int(whole)) for c, x in enumerate(centroids.tolist())], "cluster int, text string, cluster_inertia long, inertia long")
    digests = digests.select("cluster", "cluster_inertia", "inertia", F.sha2("text", 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(digests), "cluster").select(*[c.split()[0] for c in result.split(", ")])  # k rows
