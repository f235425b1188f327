import glob
import itertools
import json
import math
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import geo, overlay
from plumbline.operators import graph, lines3d, optimise, outline, roofs, spatial
from plumbline.operators import points as P
from plumbline.operators.keys import numbered
from plumbline.plans.scratch import Scratch
from plumbline.sources import readers, sinks, synthetic, wkb
from plumbline.streaming import sessions


def square(x, y, w, h, z=0.0):
    return [[x, y, z], [x + w, y, z], [x + w, y + h, z], [x, y + h, z], [x, y, z]]


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(150)] + [(7, 7), (900, 900)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in graph.connected_components(spark, spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in root}


def test_reachable_roots_are_no_components(spark):
    b = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "cleabs string")
    links = spark.createDataFrame([("a", "c"), ("b", "c")], "src string, dst string")
    got = {r.cleabs: r.root_id for r in outline.reachable_roots(spark, b, links).collect()}
    assert got == {"a": "a", "b": "b", "c": "a", "d": "d"}


def test_long_chains_take_few_rounds(spark):
    rng = random.Random(8)
    n = 400
    pairs = [(i, i + 1) for i in range(n - 1) if i % 97 != 96] + [tuple(sorted(rng.sample(range(n), 2))) for _ in range(5)]
    want = list(range(n))
    for a, b in sorted(pairs, key=lambda p: p[1]):
        want[b] = min(want[b], want[a])
    b = spark.createDataFrame([(f"{i:03}",) for i in range(n)], "cleabs string")
    links = spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in pairs], "src string, dst string")
    rounds = []
    original = Scratch.keep
    try:
        Scratch.keep = lambda self, df, name, *more, **named: (rounds.append(name), original(self, df, name, *more, **named))[1]
        got = {int(r.cleabs): int(r.root_id) for r in outline.reachable_roots(spark, b, links).collect()}
    finally:
        Scratch.keep = original
    assert got == dict(enumerate(want)) and len(rounds) < 20


def test_roots_come_down_a_comb_in_few_rounds(spark):
    """A chain in which each building also has a small source of its own."""
    n = 48
    chain = [(f"b{i:03}", f"b{i + 1:03}") for i in range(n)]
    combs = [(f"a{n - i:03}", f"b{i:03}") for i in range(n + 1)]
    names = sorted({x for p in chain + combs for x in p})
    want, before = {}, {}
    for x, y in sorted(chain + combs, key=lambda p: p[1]):
        before.setdefault(y, []).append(x)
    for x in names:
        want[x] = min([x, *[want[y] for y in before.get(x, [])]])
    rounds = []
    original = Scratch.keep
    try:
        Scratch.keep = lambda self, df, name, *more, **named: (rounds.append(name), original(self, df, name, *more, **named))[1]
        got = {r.cleabs: r.root_id for r in outline.reachable_roots(spark, spark.createDataFrame([(x,) for x in names], "cleabs string"), spark.createDataFrame(chain + combs, "src string, dst string")).collect()}
    finally:
        Scratch.keep = original
    assert got == want and sum(r.startswith("roots-") for r in rounds) <= 10


def test_roots_in_random_graphs(spark):
    rng = random.Random(21)
    names = [f"{i:03}" for i in range(150)]
    pairs = [tuple(sorted(rng.sample(names, 2))) for _ in range(170)]
    want = {}
    for x in names:
        want[x] = min([x, *[want[a] for a, b in pairs if b == x]])
    got = {r.cleabs: r.root_id for r in outline.reachable_roots(spark, spark.createDataFrame([(x,) for x in names], "cleabs string"), spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == want


def test_roots_come_down_within_a_task(spark):
    """Long chains and combs are done in one or two passes; small windows and few passes give the same roots by ways."""
    n = 300
    links = [(i, i + 1) for i in range(n) if i % 101 != 100] + [(i, i + 40) for i in range(0, n - 40, 3)]
    want = list(range(n + 1))
    for a, b in sorted(links, key=lambda p: p[1]):
        want[b] = min(want[b], want[a])
    b = spark.createDataFrame([(i,) for i in range(n + 1)], "cleabs long")
    df = spark.createDataFrame(links, "src long, dst long")
    original = Scratch.keep
    for window, passes, most in ((1000, 4, 6), (7, 4, None), (1, 1, None)):
        rounds = []
        try:
            Scratch.keep = lambda self, df, name, *more, **named: (rounds.append(name), original(self, df, name, *more, **named))[1]  # noqa: B023
            got = {r.cleabs: r.root_id for r in outline.reachable_roots(spark, b, df, window, passes).collect()}
        finally:
            Scratch.keep = original
        assert got == dict(enumerate(want))
        assert most is None or len(rounds) <= most


def test_components_are_tied_within_a_task(spark):
    n = 900
    pairs = [(i, i + 1) for i in range(n) if i % 300 != 299] + [(5, 5), (7, 600), (2000, 2000)]
    want = {i: 0 if i < 300 or i >= 600 else 300 for i in range(n)} | {2000: 2000}
    df = spark.createDataFrame(pairs, "a long, b long")
    original = Scratch.keep
    for window, most in ((100_000, 6), (3, 40)):
        rounds = []
        try:
            Scratch.keep = lambda self, df, name, *more, **named: (rounds.append(name), original(self, df, name, *more, **named))[1]  # noqa: B023
            got = {r.id: r.component for r in graph.connected_components(spark, df, Scratch(spark, "test"), window=window).collect()}
        finally:
            Scratch.keep = original
        assert got == want and len(rounds) <= most


def test_rays_of_adjacent_lines_meet_once(spark):
    rng = random.Random(31)
    rows = [(float(i), rng.randrange(4), rng.randrange(-7, 8), {"X": rng.uniform(-9, 9), "Y": rng.uniform(-9, 9), "Z": 0.0}, 0.0, 0.0, 50.0) for i in range(80)]
    lined = spark.createDataFrame(rows, "GpsTime double, line long, angle int, top struct<X:double,Y:double,Z:double>, scanner_x double, scanner_y double, scanner_z double")
    for spread in (1, 2):
        found = P.ray_neighbours(lined, spread)
        got = {(r.GpsTime, r.side): r.other for r in found.collect() if r.side.endswith("line")}
        want = {}
        for a in rows:
            for side, step in (("next_line", 1), ("prev_line", -1)):
                turn = lambda b: round(math.acos(max(-1.0, min(1.0, np.dot(u := [a[3]["X"], a[3]["Y"], -50.0], v := [b[3]["X"], b[3]["Y"], -50.0]) / (np.linalg.norm(u) * np.linalg.norm(v))))), 9)  # noqa: B023, E731
                near = [b for b in rows if b[1] == a[1] + step and abs(b[2] - a[2]) <= spread]
                if near:
                    want[a[0], side] = min(near, key=lambda b: (turn(b), b[0]))[0]
        assert got == want and len(want) > 100
    assert "band" in found._jdf.queryExecution().executedPlan().toString()


def test_edges_of_other_lines_do_not_meet(spark):
    """Level, upright and slanted edges; -0.0 is the line of 0.0."""
    rows = [(1, 0.0, 0.0, 9.0, 0.0), (2, 20.0, -0.0, 4.0, -0.0), (3, 9.0, 0.0, 12.0, 0.0), (4, 0.0, 0.0, 0.0, 5.0), (5, -0.0, 4.0, 0.0, 30.0), (6, 1.0, 1.0, 5.0, 5.0), (7, 9.0, 9.0, 2.0, 2.0), (8, 1.0, 2.0, 5.0, 6.0), (9, 0.0, 1.0, 9.0, 1.0)]
    keyed = spark.createDataFrame([(k, str(k), *e) for k, *e in rows], "edge_key long, cleabs string, start_x double, start_y double, end_x double, end_y double")
    met = outline.edge_overlaps(keyed)
    assert sorted((r.edge_key_a, r.edge_key_b, round(r.length, 9)) for r in met.collect()) == [(1, 2, 5.0), (2, 3, 3.0), (4, 5, 1.0), (6, 7, round(18**0.5, 9))]
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "a_line" in plan[plan.index("SortMergeJoin") :].split("\n")[0]


def test_numbers_take_one_shuffle(spark):
    plan = numbered(spark, spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")), ["v"], "n", 5).sort("v")
    assert [(r.v, r.n) for r in plan.collect()] == [(i, i + 5) for i in range(1000)]
    numbers = numbered(spark, spark.range(1000).toDF("v"), ["v"], "n")._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in numbers


def test_runs_go_on_over_buckets(spark):
    rng = random.Random(22)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *[round(rng.uniform(-90, 90), 2)] * 9]), i) for i in range(300)]
    got = sorted((str(r.g), r.run, r.n, r.low, r.high) for r in P.gap_runs(spark.createDataFrame(rows, "g string, v double, k long"), "g", "v", "k", 1.5, 4.0).collect())
    want = []
    for g in {r[0] for r in rows}:
        values = sorted(v for h, v, _ in rows if h == g and v is not None)
        cuts = [i for i in range(1, len(values)) if values[i] - values[i - 1] > 1.5]
        want += [(str(g), n, b - a, values[a], values[b - 1]) for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(values)]))]
    assert got == sorted(want) and len(want) > 20


def test_interpolation_over_a_year_without_knots(spark):
    knots = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0), (2, 31_536_000.0, 2.0), (3, 31_536_001.0, 5.0)], "seq long, t double, x double")
    at = spark.createDataFrame([(0.5,), (1.0,), (15_768_000.5,), (31_536_000.5,), (None,)], "t double")
    plan = spatial.interpolate(at, "t", knots, 1.0, ("x",))
    got = {r.t: r.scanner_x for r in plan.collect()}
    assert got == pytest.approx({0.5: 0.5, 1.0: 1.0, 15_768_000.5: 1.5, 31_536_000.5: 3.5})
    assert "explode" not in plan._jdf.queryExecution().toString().lower()
    assert spatial.interpolate(at, "t", knots.limit(1), 1.0, ("x",)).count() == 0


def test_lines_along_an_edge_are_joined():
    c = lines3d.connect
    assert c([], 4.0) == []
    assert c([(1.0, 2.0, 3.0, 2.0)], 4.0) == [(0.0, 2.0), (4.0, 2.0)]  # drawn out to both ends
    assert c([(3.0, 2.0, 1.0, 2.0)], 4.0) == [(0.0, 2.0), (4.0, 2.0)]
    assert c([(0.0, 0.0, 1.0, 0.0), (3.0, 1.0, 4.0, 1.0)], 4.0) == [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (4.0, 1.0)]  # halfway
    assert c([(0.0, 0.0, 1.5, 1.5), (2.5, 1.5, 4.0, 0.0)], 4.0) == [(0.0, 0.0), (2.0, 2.0), (4.0, 0.0)]  # at the crossing in the gap
    assert c([(0.0, 0.0, 3.0, 3.0), (1.0, 3.0, 4.0, 0.0)], 4.0) == [(0.0, 0.0), (2.0, 2.0), (4.0, 0.0)]  # at the crossing in the overlap
    assert c([(0.0, 0.0, 3.0, 0.0), (2.0, 1.0, 4.0, 1.0)], 4.0) == [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (4.0, 1.0)]  # the better one keeps its place
    assert c([(1.0, 5.0, 2.0, 5.0), (0.0, 0.0, 4.0, 0.0)], 4.0) == [(0.0, 0.0), (1.0, 0.0), (1.0, 5.0), (2.0, 5.0), (2.0, 0.0), (4.0, 0.0)]  # on both sides
    assert c([(0.0, 0.0, 4.0, 0.0), (1.0, 5.0, 2.0, 5.0)], 4.0) == [(0.0, 0.0), (4.0, 0.0)]  # covered
    assert c([(2.0, 0.0, 2.0, 9.0), (-3.0, 1.0, 9.0, 1.0)], 4.0) == [(0.0, 1.0), (4.0, 1.0)]  # upright, and cut to the edge
    rng = random.Random(5)
    for _ in range(300):
        out = c([(rng.uniform(-1, 9), rng.uniform(0, 3), rng.uniform(-1, 9), rng.uniform(0, 3)) for _ in range(rng.randint(1, 7))], 8.0)
        assert not out or (out[0][0] == 0.0 and out[-1][0] == 8.0 and all(a[0] <= b[0] + 1e-9 for a, b in zip(out[:-1], out[1:])))


def test_binned_joins_equal_brute_force(spark):
    rng = random.Random(3)
    boxes = [(i, x := rng.uniform(-20, 20), y := rng.uniform(-20, 20), x + rng.uniform(0, 9), y + rng.uniform(0, 9)) for i in range(120)]
    one = spark.createDataFrame(boxes, "a long, ax double, ay double, au double, av double")
    two = spark.createDataFrame(boxes, "b long, bx double, by double, bu double, bv double")
    want = {(p[0], q[0]) for p in boxes for q in boxes if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    for cell in (0.7, 4.0, 50.0):
        got = [(r.a, r.b) for r in spatial.box_join(one, two, cell, ("ax", "ay", "au", "av"), ("bx", "by", "bu", "bv")).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    near = [(r.a, r.b) for r in spatial.radius_join(one, two, 2.5, ("ax", "ay"), ("bx", "by")).collect()]
    assert sorted(near) == sorted((p[0], q[0]) for p in boxes for q in boxes if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 2.5**2)


def test_interpolation_at_and_beyond_knots(spark):
    knots = spark.createDataFrame([(0, 1.0, 0.0), (1, 2.0, 10.0), (2, 2.0, 20.0), (3, 5.0, 50.0)], "seq long, t double, x double")
    at = spark.createDataFrame([(-1.0,), (1.0,), (1.5,), (2.0,), (4.0,), (5.0,), (9.0,)], "time double")
    got = {r.time: r.scanner_x for r in spatial.interpolate(at, "time", knots, 1.0, ("x",)).collect()}
    assert got == {-1.0: -40.0, 1.0: 0.0, 1.5: 10.0, 2.0: 20.0, 4.0: 40.0, 5.0: 50.0, 9.0: 90.0}


def test_interpolation_over_many_buckets(spark):
    rng = random.Random(2)
    times = sorted({round(rng.uniform(0, 3000), 3) for _ in range(200)})
    path = [(i, t, rng.uniform(-9, 9)) for i, t in enumerate(times)]
    asked = [rng.uniform(-50, 3050) for _ in range(300)] + times
    knots = spark.createDataFrame([*path, (999, None, 1.0)], "seq long, t double, x double")
    got = {r.time: r.scanner_x for r in spatial.interpolate(spark.createDataFrame([(t,) for t in asked], "time double"), "time", knots, 1.0, ("x",)).collect()}
    assert len(got) == len(set(asked))
    for t in asked:
        k = min(max(sum(u <= t for u in times) - 1, 0), len(times) - 2)
        (_, t0, x0), (_, t1, x1) = path[k : k + 2]
        assert got[t] == pytest.approx(x0 + (t - t0) / (t1 - t0) * (x1 - x0), abs=1e-6)
    plan = spatial.interpolate(spark.range(3).selectExpr("double(id) time"), "time", knots, 1.0, ("x",))
    assert "double" in plan.schema["scanner_x"].dataType.simpleString()


def test_plane_takes_the_first_three_points_off_a_line(spark):
    rng = random.Random(6)
    rings = []
    for _ in range(60):
        base = [rng.choice([(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (2.0, 2.0, 2.0), (1.0, 0.0, 2.0), (0.0, 3.0, 1.0)]) for _ in range(rng.randint(1, 6))]
        rings.append([*base, base[0]])
    rings.append([(float(i), 0.0, 0.0) for i in range(300)] + [(5.0, 1.0, 0.0), (0.0, 0.0, 0.0)])

    def want(ring):
        for p, q, r in itertools.combinations(ring[:-1], 3):
            u, v = [b - a for a, b in zip(p, q)], [b - a for a, b in zip(p, r)]
            m = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
            if sum(x * x for x in m) > 1e-18:
                return (*m, sum(a * b for a, b in zip(m, p)))
        return None

    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "id int, ring array<struct<x:double,y:double,z:double>>")
    got = {r.id: r.p and tuple(r.p) for r in df.select("id", roofs.plane(F.col("ring")).alias("p")).collect()}
    assert got == {i: want(r) for i, r in enumerate(rings)}


def test_split_by_value_is_spread(spark, tmp_path):
    df = spark.range(2000).selectExpr("id", "if(id % 10 = 0, 6, 2) as Classification")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small parts would be put together
    try:
        sinks.write_split(df, str(tmp_path / "split"), "Classification", rows_per_file=450)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(os.path.basename(p) for p in glob.glob(str(tmp_path / "split" / "C*"))) == ["Classification=2", "Classification=6"]
    assert 2 <= len(glob.glob(str(tmp_path / "split" / "Classification=2" / "*.parquet"))) <= 4
    back = spark.read.parquet(str(tmp_path / "split"))
    assert sorted((r.id, r.Classification) for r in back.collect()) == sorted((r.id, r.Classification) for r in df.collect())


def test_stream_of_rays_falls_into_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:03"), (1, "2024-01-01 00:00:20"), (2, "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "strip int, t string").selectExpr("strip", "timestamp(t) as t")
    df.write.parquet(str(tmp_path / "rays"))
    live = sessions.line_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "rays")), "t", "strip", "5 seconds", "0 seconds")
    run = live.writeStream.format("memory").queryName("line_sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(120)
    # The sessions that the watermark (00:00:20) has passed are out.
    assert sorted((r.strip, r.start.second, r.end.second, r.n) for r in spark.table("line_sessions").collect()) == [(1, 0, 8, 2), (2, 1, 6, 1)]


def test_numbers_are_dense(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v long").repartition(5)
    assert sorted((r.v, r.n) for r in numbered(spark, df, ["v"], "n").collect()) == [(i, i + 1) for i in range(1000)]


def test_scan_lines_do_not_depend_on_buckets(spark):
    rows = [(i * 3e-5 + (i // 40) * 0.5, i // 100 % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "GpsTime double, flag int")
    lines, now, before = [], -1, None
    for t, f in sorted(rows):
        if before is None or t - before[0] >= 1e-4 or f != before[1]:
            now += 1
        before = (t, f)
        lines.append((t, now))
    for bucket in (0.001, 0.3, 100.0):
        got = sorted((r.GpsTime, r.line) for r in P.scan_lines(df, bucket=bucket).collect())
        assert got == [(t, n) for t, n in lines]


def test_overlay_of_known_shapes():
    a = [[[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]]]
    b = [[[(2, 2), (6, 2), (6, 6), (2, 6), (2, 2)]]]
    assert overlay.areas(a, b) == pytest.approx((15, 16, 4))
    n = 90
    circle = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    area = n / 2 * math.sin(2 * math.pi / n)
    ring = [[[*circle, circle[0]]]]
    assert overlay.areas(ring, ring) == pytest.approx((area, area, area))
    assert overlay.areas(ring + ring, []) == pytest.approx((area, 0, 0))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(1, 5), st.integers(1, 5)), min_size=1, max_size=5), st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(1, 5), st.integers(1, 5)), max_size=5))
def test_overlay_equals_cells(one, two):
    shape = lambda rows: [[[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]] for x, y, w, h in rows]
    cells = lambda rows: {(i, j) for x, y, w, h in rows for i in range(x, x + w) for j in range(y, y + h)}
    a, b = cells(one), cells(two)
    assert overlay.areas(shape(one), shape(two)) == pytest.approx((len(a), len(b), len(a & b)))


def test_wkb_round_trip_and_others(spark, tmp_path):
    shape = [[[(0.0, 0.0, 1.0), (1.0, 0.0, 1.0), (1.0, 1.0, 2.0), (0.0, 0.0, 1.0)]]]
    assert wkb.parse(wkb.emit(shape)) == shape
    assert wkb.parse(b"") is None and wkb.parse(b"\x01\x01\x00\x00\x00") is None
    df = spark.createDataFrame([("BATIMENT0000000000000012", bytearray(wkb.emit(shape)), 5), ("x", None, 1), (None, bytearray(wkb.emit(shape)), 1)], "cleabs string, geometry binary, other int")
    df.write.parquet(str(tmp_path / "o"))
    got = readers.read_outlines(spark, str(tmp_path / "o"))
    row = got.collect()
    assert len(row) == 1 and row[0].cleabs_int == 12 and row[0].geometry[0][0][2].z == 2.0
    sinks.write_clustered(got, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c")).first()
    assert wkb.parse(bytes(back.geometry)) == shape and back.bbox.xmax == 1.0
    assert not sinks.should_write(spark, [str(tmp_path / "c")], "skip_existing")
    with pytest.raises(FileExistsError):
        sinks.should_write(spark, [str(tmp_path / "c")], "none")
    sinks.write_clustered(got.limit(0), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 0


def test_typed_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 70000, "a"), (None, 2, "b")], "a long, b long, c string").write.parquet(path)
    assert sorted(readers.read_columns(spark, path, {"a": "int", "c": "string"}).collect(), key=str)[0].a == 1
    with pytest.raises(ValueError):
        readers.read_columns(spark, path, {"zz": "int"})
    with pytest.raises(TypeError):
        readers.read_columns(spark, path, {"c": "int"})
    with pytest.raises(Exception, match="outside"):
        readers.read_columns(spark, path, {"b": "smallint"}).collect()


def test_trajectory_and_experiments(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1.0 2 3 4\n\n 2.0  3 4 5\n")
    assert [tuple(r)[1:] for r in readers.read_trajectory(spark, str(tmp_path / "t.txt")).collect()] == [(1, 2, 3, 4), (2, 3, 4, 5)]
    (tmp_path / "bad.txt").write_text("1.0 2 x 4\n")
    with pytest.raises(Exception, match="not t x y z"):
        readers.read_trajectory(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "s.json").write_text(json.dumps({"fixed": {"a": 1}, "specific": {"p": {"fixed": {"b": 2}}, "q": {"specific": {"r": {"fixed": {"a": 3}}}}}}))
    assert readers.read_experiments(spark, str(tmp_path / "s.json")) == {"p": {"fixed": {"a": 1, "b": 2}, "variable": []}, "q/r": {"fixed": {"a": 3}, "variable": []}}


def test_city_model(spark, tmp_path):
    city = {
        "type": "CityJSON", "transform": {"scale": [0.5, 0.5, 0.5], "translate": [10, 20, 0]},
        "vertices": [[0, 0, 8], [8, 0, 8], [8, 8, 8], [0, 8, 8]],
        "CityObjects": {
            "b1": {"type": "Building"},
            "b1-0": {"type": "BuildingPart", "parents": ["b1"], "geometry": [{"type": "Solid", "boundaries": [[[[0, 1, 2, 3]], [[3, 2, 1, 0]]]], "semantics": {"surfaces": [{"type": "RoofSurface"}, {"type": "GroundSurface"}], "values": [[0, 1]]}}]},
        },
    }
    (tmp_path / "c.json").write_text(json.dumps(city))
    faces = roofs.read_roofs(spark, str(tmp_path / "c.json"))
    row = faces.collect()
    assert len(row) == 1 and row[0].cleabs == "b1" and [(p.x, p.y, p.z) for p in row[0].polygon[0]] == [(10, 20, 4), (14, 20, 4), (14, 24, 4), (10, 24, 4), (10, 20, 4)]
    cloud = spark.createDataFrame([(1, 12.0, 22.0, 1.0), (2, 12.0, 22.0, 3.6), (3, 14.2, 22.0, 1.0), (4, 14.4, 22.0, 1.0)], "point_id long, X double, Y double, Z double")
    assert sorted(r.point_id for r in roofs.under_roof(cloud, faces).collect()) == [1, 3]


def test_deep_and_circular_parents(spark, tmp_path):
    shape = [{"type": "MultiSurface", "boundaries": [[[0, 1, 2]]], "semantics": {"surfaces": [{"type": "RoofSurface"}], "values": [0]}}]
    objects = {f"o{i}": {"type": "BuildingPart", **({"parents": [f"o{i - 1}"]} if i else {})} for i in range(11)}
    objects["o10"]["geometry"] = shape
    objects |= {"a": {"type": "BuildingPart", "parents": ["b"], "geometry": shape}, "b": {"type": "BuildingPart", "parents": ["a"]}}
    (tmp_path / "d.json").write_text(json.dumps({"type": "CityJSON", "vertices": [[0, 0, 8], [8, 0, 8], [8, 8, 8]], "CityObjects": objects}))
    assert {r.part: r.cleabs for r in roofs.read_roofs(spark, str(tmp_path / "d.json")).collect()} == {"o10": "o0", "a": "b"}


def test_square_snaps_to_its_points(spark):
    edges = [("u", i, i, "s", 0, 0, i, *a, 0.0, *b, 0.0) for i, (a, b) in enumerate([((0.0, 0.0), (10.0, 0.0)), ((10.0, 0.0), (10.0, 8.0)), ((10.0, 8.0), (0.0, 8.0)), ((0.0, 8.0), (0.0, 0.0))])]
    e = spark.createDataFrame(edges, "unit_id string, group_id long, edge_key long, cleabs string, idx_polygon int, idx_ring int, idx_edge int, start_x double, start_y double, start_z double, end_x double, end_y double, end_z double")
    side = [(0.5 * k, -0.5, 0.0, 1.0) for k in range(1, 20)] + [(0.5 * k, 8.75, 0.0, -1.0) for k in range(1, 20)] + [(-0.25, 0.5 * k, 1.0, 0.0) for k in range(1, 16)] + [(10.5, 0.5 * k, -1.0, 0.0) for k in range(1, 16)]
    p = spark.createDataFrame([(i, x, y, nx, ny, 6, 1.0) for i, (x, y, nx, ny) in enumerate(side)], "point_id long, X double, Y double, inward_x double, inward_y double, Classification int, weight double")
    got = {r.edge_key: (r.start_x, r.start_y) for r in optimise.optimise(spark, e, p, "roof", 3).collect()}
    assert np.allclose([got[i] for i in range(4)], [(-0.25, -0.5), (10.5, -0.5), (10.5, 8.75), (-0.25, 8.75)], atol=0.051)


def test_points_of_later_iterations_are_there(spark):
    edges = [("u", i, i, "s", 0, 0, i, *a, 0.0, *b, 0.0) for i, (a, b) in enumerate([((0.0, 0.0), (10.0, 0.0)), ((10.0, 0.0), (10.0, 8.0)), ((10.0, 8.0), (0.0, 8.0)), ((0.0, 8.0), (0.0, 0.0))])]
    e = spark.createDataFrame(edges, "unit_id string, group_id long, edge_key long, cleabs string, idx_polygon int, idx_ring int, idx_edge int, start_x double, start_y double, start_z double, end_x double, end_y double, end_z double")
    rows = [(0.5 * k, -y, w) for y, w in ((1.9, 1.0), (3.8, 3.0), (5.6, 9.0)) for k in range(1, 20)]
    p = spark.createDataFrame([(i, x, y, 0.0, 1.0, 6, w) for i, (x, y, w) in enumerate(rows)], "point_id long, X double, Y double, inward_x double, inward_y double, Classification int, weight double")
    for margin in (None, 0.5):  # what is missing at first is fetched
        got = {r.edge_key: r for r in optimise.optimise(spark, e, p, "roof", 3, margin).collect()}
        assert len(got) == 4 and abs(got[0].start_y + 5.6) < 0.051 and got[0].status == "ok"
    assert optimise.optimise(spark, e, p.limit(0), "roof", 3).count() == 4


def test_moves_push_neighbours_that_would_flip():
    import pandas as pd

    corners = [(0, 0), (10, 0), (10, 5), (9, 5), (9, 6), (0, 6)]
    e = pd.DataFrame([(i, i, "s", 0, 0, i, *corners[i], 0, *corners[(i + 1) % 6], 0) for i in range(6)], columns="edge_key group_id cleabs idx_polygon idx_ring idx_edge start_x start_y start_z end_x end_y end_z".split())
    unit = optimise.Unit.of(e)
    members = {i: [i] for i in range(6)}
    new, moving = unit.moved(unit.c, {2}, 2.0, unit.normal[2], members)  # past the next step up
    assert 4 in moving and not unit.flipped(new, np.arange(6)).any()
    still, alone = unit.moved(unit.c, {2}, 0.5, unit.normal[2], members)
    assert alone == {2} and not unit.flipped(still, np.arange(6)).any()


def test_lines_are_found_and_repeatable():
    rng = np.random.default_rng(1)
    t = np.concatenate([np.linspace(0, 5, 40), np.linspace(8, 12, 30)])
    xyz = np.stack([t, 0 * t, 1 + 0.1 * t], 1) + rng.normal(0, 0.02, (70, 3))
    found = lines3d.fit_lines(4, xyz, 300, 0.3, 5.0, 1.0)
    assert [r[2] for r in found[:2]] == [40, 30] and found == lines3d.fit_lines(4, xyz, 300, 0.3, 5.0, 1.0)


def test_covered_lines_go():
    """Two lines over one stretch of an edge share no points; only the better one stays."""
    t = np.linspace(0, 5, 40)
    low, high = np.stack([t, 0 * t, 0 * t], 1), np.stack([t[8:32], 0 * t[8:32], 3 + 0 * t[8:32]], 1)
    found = lines3d.fit_lines(4, np.concatenate([low, high]), 300, 0.3, 5.0, 1.0)
    assert [r[2] for r in found] == [40]
    beside = high + [2.5, 0, 0]  # most of it is covered, 1.4 m is not
    assert sorted(r[2] for r in lines3d.fit_lines(4, np.concatenate([low, beside]), 300, 0.3, 5.0, 1.0, np.array([1.0, 0.0])) if r[2] >= 24) == [24, 40]
    assert lines3d.uncovered(0, 10, [(-1, 2), (1, 3), (5, 6), (9, 12)]) == 5


def test_lines_query_runs_whole(monkeypatch):
    """The registered queries take the operators' own parameters."""
    from plumbline.plans import queries_optimise as q

    seen = {}
    monkeypatch.setattr(q, "_edges", lambda *a: None)
    monkeypatch.setattr(q.fx, "points", lambda *a: None)
    monkeypatch.setattr(q, "_grouped", lambda *a: None)
    monkeypatch.setattr(q, "_weighted", lambda *a: None)
    monkeypatch.setattr(q.optimise, "units", lambda *a: None)
    monkeypatch.setattr(q.optimise, "optimise", lambda *a, **k: seen.update(iterations=a[4]))
    q.optimised_roofprints(None, "")
    assert seen["iterations"] == 3


def test_geometry_expressions(spark):
    ring = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(p, "xyz")]) for p in square(0, 0, 4, 3)])
    row = spark.range(1).select(
        geo.ring_area(ring).alias("a"), geo.ring_area(F.reverse(ring)).alias("b"), geo.in_ring(F.lit(4.0), F.lit(1.0), ring).alias("on"), geo.in_ring(F.lit(4.1), F.lit(1.0), ring).alias("out"),
        geo.line_crossing(*[F.lit(float(v)) for v in (0, 0, 2, 2, 0, 2, 2, 0)]).alias("x"), geo.line_crossing(*[F.lit(float(v)) for v in (0, 0, 1, 0, 0, 2, 1, 2)]).alias("none"),
    ).first()
    assert (row.a, row.b, row.on, row.out, tuple(row.x), row.none) == (12, -12, True, False, (1, 1), None)
    cells = spark.range(256).select(geo.hilbert(F.col("id") % 16, F.floor(F.col("id") / 16), 4).alias("d"), (F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y")).orderBy("d").collect()
    assert [r.d for r in cells] == list(range(256))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(cells, cells[1:]))


def test_synthetic_does_not_depend_on_partitions(spark):
    one = synthetic.circle_points(spark, 50, 5.0, 0.1).collect()
    assert sorted(one) == sorted(synthetic.circle_points(spark, 50, 5.0, 0.1).repartition(7).collect())
    assert synthetic.edge_samples(synthetic.circle_edges(spark, 6, 3.0, 0.0), 1.9, 0.0).count() == 36


def test_edges_come_in_batches(spark):
    """No edge is a group of its own to Spark, and those that go on over batches are whole: the same segments as edge by edge."""
    rng = np.random.default_rng(6)
    rows, want = [], []
    for key in range(40):
        n = int(rng.integers(2, 30))
        t = np.sort(rng.uniform(0, 6, n))
        xyz = np.stack([t, 0 * t, 0.2 * t + rng.choice([0, 3], n)], 1)
        rows += [(key, *p, 1.0, 0.0) for p in rng.permutation(xyz).tolist()]
        want += lines3d.fit_lines(key, xyz[np.lexsort(xyz.T[::-1])], 1000, 0.3, 2.0, 1.0, np.array([1.0, 0.0]))
    df = spark.createDataFrame(rows, "edge_key long, X double, Y double, Z double, ux double, uy double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = lines3d.edge_lines(df, least_score=2.0)
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
        assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(float(x) if i > 2 else x for i, x in enumerate(r)) for r in want) and len(want) > 40
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
