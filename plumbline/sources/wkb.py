"""Well-known binary of multipolygons, in Arrow batches."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MULTIPOLYGON = "array<array<array<struct<x: double, y: double, z: double>>>>"


def parse(data: bytes) -> list | None:
    """Polygons (lists of rings of (x, y, z)) of a Polygon or MultiPolygon, with or without z; None for other bytes."""
    at = 0

    def take(kind: str) -> tuple:
        nonlocal at
        out = struct.unpack_from(kind, data, at)
        at += struct.calcsize(kind)
        return out

    def header() -> tuple[str, int, bool]:
        order = "<" if take("B")[0] == 1 else ">"
        (code,) = take(order + "I")
        if code & 0x20000000:  # an SRID follows
            take(order + "I")
        flat = code & 0x0FFFFFFF
        return order, flat % 1000, bool(code & 0x80000000) or flat // 1000 in (1, 3)

    def polygon(order: str, has_z: bool) -> list:
        size = 3 if has_z else 2
        rings = []
        for _ in range(take(order + "I")[0]):
            flat = take(f"{order}{size * take(order + 'I')[0]}d")
            rings.append([(*flat[i : i + 2], flat[i + 2] if has_z else 0.0) for i in range(0, len(flat), size)])
        return rings

    try:
        order, kind, has_z = header()
        if kind == 3:
            return [polygon(order, has_z)]
        if kind != 6:
            return None
        out = []
        for _ in range(take(order + "I")[0]):
            own, inner, inner_z = header()
            if inner != 3:
                return None
            out.append(polygon(own, inner_z))
        return out
    except struct.error:
        return None


def emit(polygons: list) -> bytes:
    """MultiPolygon Z, little-endian."""
    out = [struct.pack("<BII", 1, 1006, len(polygons))]
    for rings in polygons:
        out.append(struct.pack("<BII", 1, 1003, len(rings)))
        for ring in rings:
            out.append(struct.pack("<I", len(ring)) + b"".join(struct.pack("<3d", *p) for p in ring))
    return b"".join(out)


def from_wkb(column: Column) -> Column:
    """A multipolygon column; null for null or other bytes."""

    def run(values: pd.Series) -> pd.Series:
        found = (None if v is None else parse(bytes(v)) for v in values)
        return pd.Series([None if p is None else [[[{"x": x, "y": y, "z": z} for x, y, z in ring] for ring in rings] for rings in p] for p in found], dtype=object)

    return F.pandas_udf(run, MULTIPOLYGON)(column)


def to_wkb(column: Column) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else emit([[[(p["x"], p["y"], p["z"]) for p in ring] for ring in rings] for rings in v]) for v in values], dtype=object)

    return F.pandas_udf(run, "binary")(column)
