"""Lines in 3D along edges: random sampling consensus, splitting by gaps, and relations of intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.operators.keys import shuffled

EPS = 1e-9
SEGMENTS = "edge_key long, segment int, n_inliers int, score double, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"


def interval_relation(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How [b0, b1] lies to [a0, a1]: none, partial or full, before, after or covers (tolerance 1e-9)."""
    return (
        F.when(b1 <= a0 + EPS, "none_before")
        .when(b0 >= a1 - EPS, "none_after")
        .when((b0 <= a0 + EPS) & (b1 >= a1 - EPS), "full_covers")
        .when((b0 >= a0 - EPS) & (b1 <= a1 + EPS), "full_inside")
        .when(b0 < a0, "partial_before")
        .otherwise("partial_after")
    )


#: A segment stays only if better ones leave more than this of its length along the edge.
LEAST_UNCOVERED = 0.1
#: Distances of points to lines that are held at once.
PLACES = 1 << 18
#: Shorter edges get no lines.
LEAST_EDGE = 0.5


def uncovered(low: float, high: float, others: list[tuple[float, float]]) -> float:
    """Length of [low, high] outside the other intervals."""
    left, at = 0.0, low
    for a, b in sorted(others):
        left += max(0.0, min(a, high) - at)
        at = max(at, b)
    return left + max(0.0, high - at)


def fit_lines(key: int, xyz: np.ndarray, samples: int, threshold: float, least_score: float, gap: float, along: np.ndarray | None = None) -> list[tuple]:
    """Segments of one edge's points: seeded pairs, inliers weighed by distance, runs without gaps, then only
    those that are not mostly shared with a better one and not covered by better ones.

    ``along`` is the edge's direction in the plane; without it, that in which the points spread most.
    """
    found = []
    if along is None and len(xyz):
        along = np.linalg.svd(xyz[:, :2] - xyz[:, :2].mean(0), full_matrices=False)[2][0]
    if len(xyz) >= 2:
        rng = np.random.default_rng([977, key % (1 << 63)])
        x, y = rng.integers(0, len(xyz), (samples, 2)).T
        pairs = np.stack(np.divmod(np.unique(np.minimum(x, y) * len(xyz) + np.maximum(x, y)), len(xyz)), 1)
        d = xyz[pairs[:, 1]] - xyz[pairs[:, 0]]
        size = np.linalg.norm(d, axis=1)
        first, u = xyz[pairs[size >= EPS, 0]], d[size >= EPS] / size[size >= EPS, None]
        step, places = max(1, PLACES // len(xyz)), xyz[:, :2] @ along
        for k in range(0, len(u), step):
            way = u[k : k + step, :, None]
            rel = [xyz[:, c] - first[k : k + step, c, None] for c in range(3)]  # by coordinate, as short axes are slow
            t = rel[0] * way[:, 0] + rel[1] * way[:, 1] + rel[2] * way[:, 2]
            off = [r - t * way[:, c] for c, r in enumerate(rel)]
            away = np.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])
            worth = np.where(away <= threshold, 1 - away / threshold, 0.0)
            total = worth.sum(1)
            able = np.nonzero(total > least_score)[0]  # no run has more than all together
            able = able[np.argsort(-total[able], kind="stable")]
            # Of lines with the same inliers the best one is looked at.
            near = away[able] <= threshold
            if len(xyz) <= 62:  # as bits of one number, which sort faster
                _, one = np.unique(near @ (1 << np.arange(len(xyz))), return_index=True)
            else:
                _, one = np.unique(np.packbits(near, axis=1), axis=0, return_index=True)
            one = np.sort(one)
            able, near = able[one], near[one]
            # All their points, line by line in order along it; a run ends with its line and before a gap.
            order = np.argsort(np.where(near, t[able], np.inf), axis=1, kind="stable")
            row, at = np.nonzero(np.arange(len(xyz)) < near.sum(1)[:, None])
            point, line = order[row, at], able[row]
            where = t[line, point]
            starts = np.nonzero(np.append(True, (row[1:] != row[:-1]) | (where[1:] - where[:-1] > gap))[: len(row)])[0]
            if not len(starts):
                continue
            ends = np.append(starts[1:], len(row))
            score = np.add.reduceat(worth[line, point], starts)
            low, high = (f.reduceat(places[point], starts) for f in (np.minimum, np.maximum))
            for r in np.nonzero(score > least_score)[0]:
                a, b = starts[r], ends[r]
                found.append((float(score[r]), sorted(point[a:b].tolist()), (first[k + line[a]], u[k + line[a]], where[a], where[b - 1]), (low[r], high[r])))
    found.sort(key=lambda x: (-x[0], x[1]))
    kept: list[tuple] = []
    for score, run, (base, way, t0, t1), span in found:
        held = frozenset(run)
        if all(len(held & other) <= 0.5 * min(len(held), len(other)) for _, other, _, _ in kept) and uncovered(*span, [x[3] for x in kept]) > LEAST_UNCOVERED:
            kept.append((score, held, (base + t0 * way, base + t1 * way), span))
    return [(key, n, len(held), score, *ends[0], *ends[1]) for n, (score, held, ends, _) in enumerate(kept)]


def edge_lines(df: DataFrame, samples: int = 1000, threshold: float = 0.3, least_score: float = 5.0, gap: float = 1.0) -> DataFrame:
    """Segments of each edge's points (edge_key, X, Y, Z, and ux, uy: the edge's direction).

    Edges are many and small, so they come in batches, in order, and no edge is a group of its own to Spark.
    """

    def fitted(rows: pa.Table) -> pa.RecordBatch:
        key, *columns = (c.combine_chunks().to_numpy() for c in rows.columns)
        xyz, way = np.stack(columns[:3], 1), np.stack(columns[3:], 1)
        starts = np.append(np.nonzero(np.append(True, key[1:] != key[:-1]))[0], len(key))
        out = [r for a, b in zip(starts[:-1], starts[1:], strict=True) for r in fit_lines(int(key[a]), xyz[a:b], samples, threshold, least_score, gap, way[a])]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last edge, more may come
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            key = b.column(0).to_numpy()
            if held[0].column(0)[0].as_py() == key[-1]:
                continue
            last = int(np.searchsorted(key, key[-1]))
            yield fitted(pa.Table.from_batches([*held[:-1], b.slice(0, last)]))
            held = [b.slice(last)]
        if held:
            yield fitted(pa.Table.from_batches(held))

    schema = to_arrow_schema(StructType.fromDDL(SEGMENTS))
    # A number of its own keeps small tables, which are much work, in as many tasks as there are partitions.
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select("edge_key", *[F.col(c).cast("double").alias(c) for c in ("X", "Y", "Z", "ux", "uy")])
    return rows.repartition(spread, "edge_key").sortWithinPartitions("edge_key", "X", "Y", "Z").mapInArrow(run, SEGMENTS)


Piece = tuple[float, float, float, float]


def _at(p: Piece, x: float) -> float:
    """Height of a piece's line."""
    return p[1] + (p[3] - p[1]) * (x - p[0]) / (p[2] - p[0])


def _meet(p: Piece, q: Piece) -> float | None:
    """Where the lines of two pieces cross; none if they are parallel."""
    a, b = (p[3] - p[1]) / (p[2] - p[0]), (q[3] - q[1]) / (q[2] - q[0])
    return (q[1] - b * q[0] - p[1] + a * p[0]) / (a - b) if abs(a - b) > EPS else None


def _cut(p: Piece, low: float, high: float) -> Piece:
    return low, _at(p, low), high, _at(p, high)


def connect(segments: list[Piece], size: float) -> list[tuple[float, float]]:
    """One line of (distance along, height) from 0 to ``size`` out of an edge's segments, the best first.

    Each segment takes what is still free of the edge. Where it runs into an earlier one and the two cross
    there, both end at the crossing; else the earlier one keeps its place. What is left free between two is shared at the crossing of
    their lines if that lies there, else halfway; at the edge's ends the outer ones are drawn out. Segments that are
    upright along the edge, or outside it, show nothing.
    """
    kept: list[Piece] = []
    for x0, y0, x1, y1 in segments:
        new = (x0, y0, x1, y1) if x0 <= x1 else (x1, y1, x0, y0)
        if new[2] - new[0] <= EPS:
            continue
        kept.sort()
        borders = [0.0, *[b for p in kept for b in (p[0], p[2])], size]
        added = []
        for i in range(len(kept) + 1):
            low, high = max(borders[2 * i], new[0]), min(borders[2 * i + 1], new[2])
            if high - low <= EPS:
                continue
            for j, here in ((i - 1, True), (i, False)):  # the earlier pieces before and after this free place
                if not (0 <= j < len(kept)) or (new[0] > borders[2 * i] if here else new[2] < borders[2 * i + 1]):
                    continue
                x = _meet(kept[j], new)
                if x is not None and max(kept[j][0], new[0]) + EPS < x < min(kept[j][2], new[2]) - EPS:
                    kept[j] = _cut(kept[j], kept[j][0], x) if here else _cut(kept[j], x, kept[j][2])
                    low, high = (x, high) if here else (low, x)
            added.append(_cut(new, low, high))
        kept += added
    kept.sort()
    if not kept:
        return []
    ends = [0.0]
    for p, q in zip(kept[:-1], kept[1:], strict=True):
        x = _meet(p, q)
        ends.append(x if x is not None and p[2] <= x <= q[0] else (p[2] + q[0]) / 2)
    ends.append(size)
    out: list[tuple[float, float]] = []
    for p, low, high in zip(kept, ends[:-1], ends[1:], strict=True):
        for x in (low, high):
            point = (x, _at(p, x))
            if not out or abs(point[0] - out[-1][0]) > 1e-6 or abs(point[1] - out[-1][1]) > 1e-6:
                out.append(point)
    return out


def connected_lines(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """(edge_key, points): each edge's line in 3D, its segments joined without gaps from its start to its end.

    Segments come together by edge (an edge has few); edges without any get no row.
    """
    size = F.sqrt(F.pow(F.col("end_x") - F.col("start_x"), 2) + F.pow(F.col("end_y") - F.col("start_y"), 2))
    e = edges.select("edge_key", "start_x", "start_y", ((F.col("end_x") - F.col("start_x")) / size).alias("ux"), ((F.col("end_y") - F.col("start_y")) / size).alias("uy"), size.alias("size")).where("size > 0")
    along = lambda i: (F.col(f"x{i}") - F.col("start_x")) * F.col("ux") + (F.col(f"y{i}") - F.col("start_y")) * F.col("uy")
    of = segments.join(shuffled(e), "edge_key").groupBy("edge_key", "start_x", "start_y", "ux", "uy", "size").agg(F.array_sort(F.collect_list(F.struct("segment", along(0).alias("t0"), "z0", along(1).alias("t1"), "z1"))).alias("s"))

    @F.pandas_udf("array<struct<t:double,z:double>>")
    def line(s: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([[{"t": t, "z": z} for t, z in connect([(r["t0"], r["z0"], r["t1"], r["z1"]) for r in row], n)] for row, n in zip(s, size, strict=True)])

    place = F.transform("line", lambda p: F.struct((F.col("start_x") + p["t"] * F.col("ux")).alias("x"), (F.col("start_y") + p["t"] * F.col("uy")).alias("y"), p["z"].alias("z")))
    return of.withColumn("line", line("s", "size")).where(F.size("line") > 1).select("edge_key", place.alias("points"))
