"""Areas of unions and intersections of polygons, by slabs between their vertices and crossings.

A shape is a list of polygons (lists of rings of (x, y)); points inside any of them, by the even-odd rule of
its rings, are inside the shape. No edges cross within a slab, so areas are sums of trapezoids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

Ring = list[tuple[float, float]]
Shape = list[list[Ring]]


def _segments(polygon: list[Ring]) -> np.ndarray:
    rows = [(*a, *b) for ring in polygon for a, b in zip(ring[:-1], ring[1:], strict=True) if a[1] != b[1]]
    return np.array(rows, float).reshape(-1, 4)


#: Pairs of segments that are looked at together.
PAIRS = 1 << 18


def _crossings(s: np.ndarray) -> np.ndarray:
    """Heights at which any two segments cross."""
    out = []
    d = s[:, 2:] - s[:, :2]
    step = max(1, PAIRS // max(len(s), 1))
    for k in range(0, len(s), step):
        e, gap = d[k : k + step, None], s[None, :, :2] - s[k : k + step, None, :2]
        det = e[..., 0] * d[:, 1] - e[..., 1] * d[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[..., 0] * d[:, 1] - gap[..., 1] * d[:, 0]) / det
            u = (gap[..., 0] * e[..., 1] - gap[..., 1] * e[..., 0]) / det
        later = np.arange(len(s)) > np.arange(k, min(k + step, len(s)))[:, None]
        fit = later & (det != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        out.append((s[k : k + step, None, 1] + t * e[..., 1])[fit])
    return np.concatenate(out) if out else np.zeros(0)


def _spans(s: np.ndarray, low: float, high: float) -> list[tuple[float, float, int]]:
    """Inside intervals at the slab's middle, with their widths' average as the area's factor."""
    held = s[(np.minimum(s[:, 1], s[:, 3]) <= low) & (np.maximum(s[:, 1], s[:, 3]) >= high)]
    at = lambda y: held[:, 0] + (y - held[:, 1]) * (held[:, 2] - held[:, 0]) / (held[:, 3] - held[:, 1])
    return np.sort(at((low + high) / 2)).reshape(-1, 2).tolist()


def _merged(spans: list[list[float]]) -> list[list[float]]:
    out: list[list[float]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def areas(a: Shape, b: Shape) -> tuple[float, float, float]:
    """Areas of a, of b, and of their intersection. As x runs linearly in a slab, its mid-height widths are exact."""
    parts = [[_segments(p) for p in shape] for shape in (a, b)]
    every = np.concatenate([np.zeros((0, 4)), *[s for side in parts for s in side]])
    if not len(every):
        return 0.0, 0.0, 0.0
    heights = np.unique(np.concatenate([every[:, 1], every[:, 3], _crossings(every)]))
    total = [0.0, 0.0, 0.0]
    for low, high in zip(heights[:-1], heights[1:], strict=True):
        sides = [_merged([x for s in side for x in _spans(s, low, high)]) for side in parts]
        both = [[max(p[0], q[0]), min(p[1], q[1])] for p in sides[0] for q in sides[1] if max(p[0], q[0]) < min(p[1], q[1])]
        for k, spans in enumerate([*sides, both]):
            total[k] += sum(y - x for x, y in spans) * (high - low)
    return total[0], total[1], total[2]


def _shape(value) -> Shape:
    return [[[(p["x"], p["y"]) for p in ring] for ring in polygon] for polygon in value]


def iou_series(a: pd.Series, b: pd.Series) -> pd.Series:
    """Intersection over union of each pair of multipolygons; 0 where the union has no area."""
    out = []
    for x, y in zip(a, b, strict=True):
        one, two, both = areas(_shape(x), _shape(y))
        union = one + two - both
        out.append(both / union if union > 0 else 0.0)
    return pd.Series(out, dtype=float)
