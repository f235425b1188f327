"""Unions, contact and repair of polygons against brute force and shapes worked out by hand."""

import itertools
import math
import random

import pytest

from plumbline.functions import overlay
from plumbline.operators import arrange

SHAPES = "g string, shape string, geometry array<array<array<struct<x:double,y:double>>>>"


def ring(points):
    points = [(float(x), float(y)) for x, y in points]
    return [*points, points[0]]


def turned(cx, cy, r, angle, n):
    return ring([(cx + r * math.cos(angle + 2 * math.pi * i / n), cy + r * math.sin(angle + 2 * math.pi * i / n)) for i in range(n)])


def area(geometry):
    size = lambda r: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r[:-1], r[1:])) / 2
    return sum(size(r) for polygon in geometry for r in polygon)


def plain(geometry):
    return [[[(p.x, p.y) for p in r] for r in polygon] for polygon in geometry]


def test_unions_of_slanted_shapes(spark):
    rng = random.Random(12)
    rows = []
    for g in range(6):
        for s in range(9):
            c = (rng.uniform(0, 12), rng.uniform(0, 12))
            outer = turned(*c, rng.uniform(1, 4), rng.uniform(0, 3), rng.choice([3, 4, 5, 7]))
            hole = [list(reversed(turned(*c, 0.4, rng.uniform(0, 3), 4)))] if rng.random() < 0.5 else []
            rows.append((f"g{g}", f"s{s}", [[outer, *hole]]))
    got = {r.g: r for r in arrange.dissolve(spark, spark.createDataFrame(rows, SHAPES), "g", "shape", "geometry", 4.0).collect()}
    assert len(got) == 6
    for g, r in got.items():
        shape = [p for k, _, geometry in rows if k == g for p in geometry]
        want = overlay.areas(shape, [])[0]
        assert r.area == pytest.approx(want, abs=1e-6) and area(plain(r.geometry)) == pytest.approx(want, abs=1e-6)
        # The result is the same place: nothing is lost or added.
        assert overlay.areas(shape, plain(r.geometry)) == pytest.approx((want, want, want), abs=1e-6)
        for polygon in plain(r.geometry):
            assert area([[polygon[0]]]) > 0 and all(area([[h]]) < 0 for h in polygon[1:])
            assert all(len(set(x[:-1])) == len(x) - 1 and x[0] == x[-1] for x in polygon)


def test_unions_by_hand(spark):
    box = lambda x, y, w=1.0, h=1.0: ring([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
    frame = [box(0, 0, 3, 1), box(0, 2, 3, 1), box(0, 1), box(2, 1)]  # around an empty middle
    rows = [("frame", f"s{i}", [[r]]) for i, r in enumerate(frame)]
    rows += [("corner", "a", [[box(0, 0)]]), ("corner", "b", [[box(1, 1)]])]
    rows += [("same", "a", [[box(5, 5)]]), ("same", "b", [[box(5, 5)]])]
    rows += [("island", "a", [[box(0, 0, 5, 5), list(reversed(box(1, 1, 3, 3)))]]), ("island", "b", [[box(2, 2)]])]
    rows += [("flat", "a", [[ring([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)])]])]
    got = {r.g: plain(r.geometry) for r in arrange.dissolve(spark, spark.createDataFrame(rows, SHAPES), "g", "shape", "geometry").collect()}
    assert [len(p) for p in got["frame"]] == [2] and area(got["frame"]) == 8 and len(got["frame"][0][0]) == len(got["frame"][0][1]) == 5
    assert [len(p) for p in got["corner"]] == [1, 1] and area(got["corner"]) == 2
    assert len(got["same"]) == 1 and area(got["same"]) == 1
    assert sorted(len(p) for p in got["island"]) == [1, 2] and area(got["island"]) == 25 - 9 + 1
    assert got["flat"] == []


def crossing(p, q, r, s):
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return side(p, q, r) * side(p, q, s) < -1e-12 and side(r, s, p) * side(r, s, q) < -1e-12


def test_contact_without_common_inside(spark):
    rng = random.Random(13)
    shapes = []
    # Triangles and quads on a coarse grid meet in points, along edges, along parts of edges, and inside each other.
    while len(shapes) < 60:
        n = rng.choice([3, 4])
        p = [(float(rng.randint(0, 9)), float(rng.randint(0, 9))) for _ in range(n)]
        r = ring(p)
        if len(set(p)) < n or abs(area([[r]])) < 0.5 or any(crossing(r[i], r[i + 1], r[j], r[j + 1]) for i in range(n) for j in range(i)):
            continue
        if n == 4 and any(abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) < 1e-9 for a, b, c in itertools.permutations(p, 3)):
            continue
        shapes.append((f"{len(shapes):02}", [[r]]))
    ground = ring([(20.0, 20.0), (26.0, 20.0), (26.0, 26.0), (20.0, 26.0)])
    shapes += [("60", [[ground, ring([(22.0, 22.0), (22.0, 24.0), (24.0, 24.0), (24.0, 22.0)])]]), ("61", [[ring([(22.0, 22.0), (24.0, 22.0), (24.0, 24.0), (22.0, 24.0)])]]), ("62", [[ring([(22.5, 22.5), (23.0, 22.5), (22.5, 23.0)])]])]
    df = spark.createDataFrame(shapes, "key string, geometry array<array<array<struct<x:double,y:double>>>>")
    got = {(r.a, r.b) for r in arrange.touching(spark, df, "key", "geometry", 3.0).collect()}

    def gap(a, b):
        def one(p, e):
            dx, dy = e[1][0] - e[0][0], e[1][1] - e[0][1]
            t = max(0.0, min(1.0, ((p[0] - e[0][0]) * dx + (p[1] - e[0][1]) * dy) / (dx * dx + dy * dy)))
            return math.hypot(p[0] - e[0][0] - t * dx, p[1] - e[0][1] - t * dy)

        edges = lambda s: [e for polygon in s for r in polygon for e in zip(r[:-1], r[1:])]
        return min(min(one(p, e) for x, y in ((a, b), (b, a)) for f in edges(x) for p in f for e in edges(y)), 0.0 if any(crossing(*e, *f) for e in edges(a) for f in edges(b)) else math.inf)

    want = {(a, b) for (a, x), (b, y) in itertools.combinations(shapes, 2) if gap(x, y) < 1e-9 and overlay.areas(x, y)[2] < 1e-9}
    assert got == want and ("60", "61") in got and ("61", "62") not in got and len(want) > 20


def test_repair(spark):
    box = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    star = [(math.cos(4 * math.pi * i / 5), math.sin(4 * math.pi * i / 5)) for i in range(5)]
    rows = [
        ("tie", [[ring([(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)])]]), ("spike", [[ring([*box[:2], (9.0, 0.0), *box[1:]])]]), ("twice", [[[*box, *box, box[0]]]]), ("sound", [[ring(box)]]),
        ("star", [[ring(star)]]), ("line", [[ring([(0.0, 0.0), (1.0, 1.0)])]]), ("hole", [[ring(box), ring([(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)])]]), ("two", [[ring(box)], [ring([(10.0, 0.0), (11.0, 0.0), (11.0, 1.0)])]]),
    ]
    got = {r.key: (plain(r.geometry), r.area) for r in arrange.make_valid(spark, spark.createDataFrame(rows, "key string, geometry array<array<array<struct<x:double,y:double>>>>"), "key", "geometry").collect()}
    assert {k: (len(g), round(a, 9)) for k, (g, a) in got.items() if k != "star"} == {"tie": (2, 8.0), "spike": (1, 16.0), "twice": (1, 16.0), "sound": (1, 16.0), "line": (0, 0.0), "hole": (1, 15.0), "two": (2, 16.5)}
    assert len(got["spike"][0][0][0]) == 5 and len(got["hole"][0][0]) == 2
    # A five-pointed star drawn in one go: its points, and its middle twice around, so not inside.
    assert len(got["star"][0]) == 5 and got["star"][1] == pytest.approx(overlay.areas([[ring(star)]], [])[0], abs=1e-9)


def test_areas_of_two_sides(spark):
    rng = random.Random(14)
    rows = [(f"g{g}", f"s{s}", rng.random() < 0.5, [[turned(rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(1, 3), rng.uniform(0, 3), rng.choice([3, 4, 6]))]]) for g in range(5) for s in range(10)]
    rows += [("one", "s", True, [[turned(0, 0, 1, 0, 4)]])]
    df = spark.createDataFrame(rows, "g string, shape string, first boolean, geometry array<array<array<struct<x:double,y:double>>>>")
    got = {r.g: (r.area_first, r.area_second, r.area_both) for r in arrange.overlap_areas(spark, df, "g", "shape", "first", "geometry", 3.0).collect()}
    assert len(got) == 6
    for g, areas in got.items():
        one, two = ([p for k, _, f, geometry in rows if k == g and f == side for p in geometry] for side in (True, False))
        assert areas == pytest.approx(overlay.areas(one, two), abs=1e-6)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SHAPES)
    assert arrange.dissolve(spark, none, "g", "shape", "geometry").count() == 0
    assert arrange.touching(spark, none, "shape", "geometry").count() == 0


def test_measures_and_groups_without_a_row_for_a_group(spark):
    """Area, boundary and corners are summed over pieces, and ids digested name by name; the same as from whole rings and lists."""
    from plumbline.operators import validation

    boxes = [("a", 0.0, 0.0, 4.0, 4.0), ("b", 4.0, 4.0, 6.0, 6.0), ("c", 4.0, 0.0, 7.0, 2.0), ("d", 20.0, 0.0, 21.0, 1.0)]
    df = spark.createDataFrame(boxes, "name string, x0 double, y0 double, x1 double, y1 double").selectExpr("*", "array(array(transform(array(array(x0, y0), array(x1, y0), array(x1, y1), array(x0, y1), array(x0, y0)), q -> struct(q[0] as x, q[1] as y)))) as geometry")
    rows = {(r[0], r[1]) for r in validation.members(spark, df, "name", ("x0", "y0", "x1", "y1")).collect()}
    lists = validation.aggregated(spark, df, "name", ("x0", "y0", "x1", "y1")).collect()
    assert rows == {(r[0], name) for r in lists for name in r[1]} and len(lists) == 2
    got = {tuple(r) for r in arrange.dissolved_measures(spark, df.selectExpr("name = 'd' as g", "name", "geometry"), "g", "name", "geometry").collect()}
    assert got == {(False, 26.0, 30.0, 10), (True, 1.0, 4.0, 4)}


def test_a_shape_is_walked_without_components(spark, monkeypatch):
    """All rings of a shape that was given are walked at once."""
    monkeypatch.setattr(arrange, "connected_components", None)
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    far = [ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))], [ring((10, 0), (13, 0), (13, 3), (10, 3), (10, 0)), ring((11, 1), (11, 2), (12, 2), (12, 1), (11, 1))]
    df = spark.createDataFrame([("a", list(far)), ("b", [far[1]])], "k string, geometry array<array<array<struct<x:double,y:double>>>>")
    got = {r.k: ([len(p) for p in r.geometry], round(r.area, 9)) for r in arrange.make_valid(spark, df, "k", "geometry").collect()}
    assert got == {"a": ([1, 1, 2], 10.0), "b": ([2], 8.0)}
