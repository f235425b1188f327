"""Readers and writers: footers, pushed filters, counters, comparison tables, and rows that are refused."""

import glob
import json
import random
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geo
from plumbline.operators import validation
from plumbline.operators.counters import Counters
from plumbline.operators.keys import cyclic
from plumbline.operators.simplify import simplify
from plumbline.sources import readers, sinks, wkb

GEOMETRY = "geometry array<array<array<struct<x:double,y:double,z:double>>>>"


def box(x, y, w=1.0):
    x, y = float(x), float(y)
    return [[[(x, y, 0.0), (x + w, y, 0.0), (x + w, y + w, 0.0), (x, y + w, 0.0), (x, y, 0.0)]]]


def test_footers_hold_the_metadata(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"b{i}", box(rng.uniform(0, 1000), rng.uniform(0, 1000))) for i in range(500)]
    path = str(tmp_path / "c")
    df = spark.createDataFrame(rows, f"cleabs string, {GEOMETRY}")
    for _ in range(2):  # the second time over the first
        sinks.write_clustered(df, path, row_group_rows=50)
    assert sorted(r.cleabs for r in spark.read.parquet(path).collect()) == sorted(r[0] for r in rows)
    files = glob.glob(f"{path}/*") + glob.glob(f"{path}/.[!.]*")
    assert files and all(f.rsplit("/", 1)[1].startswith("part-") for f in files if not f.endswith(".crc"))
    for f in glob.glob(f"{path}/part-*"):
        meta = pq.read_metadata(f)
        told = json.loads(meta.metadata[b"geo"])
        assert told["version"] == "1.1.0" and told["columns"]["geometry"]["encoding"] == "WKB" and told["columns"]["geometry"]["covering"]["bbox"]["xmin"] == ["bbox", "xmin"]
        assert all(meta.row_group(i).num_rows == 50 for i in range(meta.num_row_groups - 1))
    # Neighbours share row groups: a small window meets few of them.
    groups = [pq.ParquetFile(f).metadata.row_group(i) for f in glob.glob(f"{path}/part-*") for i in range(pq.read_metadata(f).num_row_groups)]
    spans = [{g.column(c).path_in_schema: g.column(c).statistics for c in range(g.num_columns)} for g in groups]
    met = [s for s in spans if s["bbox.xmin"].min <= 100 and s["bbox.ymin"].min <= 100]
    assert 0 < len(met) <= len(groups) / 2


def test_empty_table_has_a_footer_too(spark, tmp_path):
    path = str(tmp_path / "e")
    sinks.write_clustered(spark.createDataFrame([], f"cleabs string, {GEOMETRY}"), path)
    assert spark.read.parquet(path).count() == 0 and b"geo" in pq.read_metadata(glob.glob(f"{path}/part-*")[0]).metadata


def test_rings_are_turned_when_they_are_read(spark, tmp_path):
    hole = [(0.2, 0.2, 0.0), (0.4, 0.2, 0.0), (0.4, 0.4, 0.0), (0.2, 0.2, 0.0)]
    shape = [[list(reversed(box(0, 0)[0][0])), hole]]
    spark.createDataFrame([("BATIMENT0000000000000001", bytearray(wkb.emit(shape)))], "cleabs string, geometry binary").write.parquet(str(tmp_path / "o"))
    got = readers.read_outlines(spark, str(tmp_path / "o")).select(F.transform(F.col("geometry")[0], geo.ring_area).alias("a")).first().a
    assert got[0] == 1.0 and got[1] < 0


def test_edges_get_rows_and_unknown_ones_are_counted(spark, tmp_path):
    spark.createDataFrame([(30,), (10,), (20,)], "edge_key long").write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([(10, 30), (10, 99), (98, 20), (97, 96)], "edge_key_a long, edge_key_b long").write.parquet(str(tmp_path / "o"))
    edges, met, counters = readers.read_edges(spark, str(tmp_path / "e"), str(tmp_path / "o"))
    assert sorted((r.edge_key, r.row) for r in edges.collect()) == [(10, 0), (20, 1), (30, 2)]
    assert [(r.row_a, r.row_b) for r in met.collect()] == [(0, 2)]
    assert counters.values() == {"overlaps_read": 4, "overlaps_skipped": 3}


def test_ids_reach_the_scan(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    spark.range(10_000).selectExpr("id as k", "id * 2 as v", "'x' as wide").repartitionByRange(8, "k").write.parquet(path)
    few = readers.read_scored(spark, path, spark.createDataFrame([(5,), (7,), (None,), (5,), (-1,)], "id long"), "k", ["v"])
    assert sorted((r.k, r.v) for r in few.collect()) == [(5, 10), (7, 14)]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "In(k, [" in plan and "wide" not in plan.split("ReadSchema")[1]
    monkeypatch.setattr(readers, "MOST_LISTED", 3)
    many = readers.read_scored(spark, path, spark.range(100, 120).withColumnRenamed("id", "k"), "k", ["v"])
    assert sorted(r.k for r in many.collect()) == list(range(100, 120))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,100)" in plan and "LessThanOrEqual(k,119)" in plan and "LeftSemi" in plan
    assert readers.read_scored(spark, path, spark.range(0), "k", []).count() == 0


def test_counters_ride_along(spark):
    counters = Counters()
    df = counters.watch(spark.range(10), n=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
    assert df.where("id > 7").count() == 2
    assert counters.values() == {"n": 10, "even": 5}
    assert [tuple(r) for r in counters.table(spark).collect()] == [("even", 5), ("n", 10)]


def test_rows_and_columns_that_are_refused(spark):
    schema = f"cleabs string, {GEOMETRY}"
    validation.check_rows(spark.createDataFrame([("a", box(0, 0))], schema), "cleabs", "geometry")
    for rows, what in (([(None, box(0, 0))], "null ids"), ([("a", box(0, 0))] * 2, "repeated ids"), ([("a", None)], "null geometries")):
        with pytest.raises(ValueError, match=what):
            validation.check_rows(spark.createDataFrame(rows, schema), "cleabs", "geometry")
    df = spark.createDataFrame([("a", 1, 2)], "cleabs string, u int, v int").withColumn("geometry", F.lit(None))
    assert validation.keep_columns(df, "cleabs", "geometry", ["v", "cleabs", "u", "v", "geometry"]) == ["v", "u"]
    with pytest.raises(ValueError, match="no column w"):
        validation.keep_columns(df, "cleabs", "geometry", ["w"])


def test_comparison_tables_and_iterations(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], 0.5, box(1.0, 2.0))], f"id string, ids array<string>, iou double, {GEOMETRY}")
    for kind in ("csv", "json", "parquet"):
        sinks.write_comparison(df, str(tmp_path / kind), kind, "geometry")
    row = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert row.id == "a" and json.loads(row.ids) == ["x", "y"] and row.geometry.startswith("MULTIPOLYGON Z (((1.0 2.0 0.0")
    assert spark.read.json(str(tmp_path / "json")).first().iou == 0.5
    assert wkb.parse(bytes(spark.read.parquet(str(tmp_path / "parquet")).first().geometry)) == box(1.0, 2.0)
    with pytest.raises(ValueError):
        sinks.write_comparison(df, str(tmp_path / "x"), "xml")
    assert sinks.write_iteration(df.drop("geometry"), str(tmp_path / "it_{iteration}"), 3).endswith("it_3")
    assert spark.read.parquet(str(tmp_path / "it_3")).count() == 1
    with pytest.raises(ValueError):
        sinks.write_iteration(df, str(tmp_path / "none"), 1)


def test_cyclic_neighbours(spark):
    rows = [("r", i, v) for i, v in enumerate([10, None, 30, 40])] + [("s", 5, 1)]
    got = {(r.ring, r.i): (r.before, r.after) for r in cyclic(spark.createDataFrame(rows, "ring string, i int, v int"), ["ring"], "i", {"before": F.col("v"), "after": F.col("v")}).collect()}
    assert got == {("r", 0): (40, None), ("r", 1): (10, 30), ("r", 2): (None, 40), ("r", 3): (30, 10), ("s", 5): (1, 1)}


def test_vertices_go_where_no_ring_needs_them(spark):
    long = [[[(float(i), 0.0, 0.0) for i in range(40)] + [(39.0, 5.0, 0.0), (0.0, 5.0, 0.0), (0.0, 0.0, 0.0)]]]
    below = [[[(10.0, 0.0, 0.0), (9.0, -3.0, 0.0), (20.0, -3.0, 0.0), (20.0, 0.0, 0.0), (15.0, 0.0, 0.0), (10.0, 0.0, 0.0)]]]
    first = [[[(5.0, 50.0, 0.0), (9.0, 50.0, 0.0), (9.0, 55.0, 0.0), (0.0, 55.0, 0.0), (0.0, 50.0, 0.0), (5.0, 50.0, 0.0)]]]  # begins on a line
    near = [[[(0.0, 90.0, 0.0), (2.0, 90.0 + 1e-5, 0.0), (4.0, 90.0, 0.0), (4.0, 95.0, 0.0), (0.0, 90.0, 0.0)]]]
    bare = [[[(0.0, 70.0, 0.0), (1.0, 70.0, 0.0), (2.0, 70.0, 0.0), (0.0, 70.0, 0.0)]]]  # no area: three points stay
    rows = [("long", long), ("below", below), ("first", first), ("near", near), ("bare", bare), ("none", None)]
    out = {r.key: r.geometry for r in simplify(spark, spark.createDataFrame(rows, f"key string, {GEOMETRY}"), "key", "geometry").collect()}
    at = {k: [(p.x, p.y) for p in g[0][0]] for k, g in out.items() if g}
    assert at["long"] == [(0.0, 0.0), (10.0, 0.0), (20.0, 0.0), (39.0, 0.0), (39.0, 5.0), (0.0, 5.0), (0.0, 0.0)]
    assert at["below"] == [(10.0, 0.0), (9.0, -3.0), (20.0, -3.0), (20.0, 0.0), (10.0, 0.0)]
    assert at["first"] == [(9.0, 50.0), (9.0, 55.0), (0.0, 55.0), (0.0, 50.0), (9.0, 50.0)]
    assert len(at["near"]) == 5 and len(at["bare"]) == 4 and out["none"] is None


def test_straight_runs_go_in_one_pass(spark, monkeypatch):
    """Walls of 60 metres with a vertex at each, one of them met half-way, take the writes of one pass; shapes without a vertex stay as they are."""
    from plumbline.operators.simplify import Scratch

    wall = [(float(i), 0.0, 0.0) for i in range(60)]
    upper = [[[*wall, (60.0, 0.0, 0.0), (60.0, 9.0, 0.0), (0.0, 9.0, 0.0), wall[0]]]]
    lower = [[[(30.0, 0.0, 0.0), *reversed(wall[:30]), (0.0, -9.0, 0.0), (30.0, -9.0, 0.0), (30.0, 0.0, 0.0)]]]
    bent = [[[*[(float(i), 40.0 + (0.9e-6 if i % 2 else 0.0), 0.0) for i in range(9)], (8.0, 45.0, 0.0), (0.0, 45.0, 0.0), (0.0, 40.0, 0.0)]]]
    rows = [("upper", upper), ("lower", lower), ("bent", bent), ("empty", []), ("bare", [[]]), ("none", None)]
    written, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, *a, **b: written.append(name) or keep(self, df, name, *a, **b))
    out = {r.key: r.geometry for r in simplify(spark, spark.createDataFrame([r for r in rows if r[0] != "bent"], f"key string, {GEOMETRY}"), "key", "geometry").collect()}
    assert len(written) <= 4
    at = {k: [(p.x, p.y) for p in g[0][0]] for k, g in out.items() if k in ("upper", "lower")}
    assert at["upper"] == [(0.0, 0.0), (30.0, 0.0), (60.0, 0.0), (60.0, 9.0), (0.0, 9.0), (0.0, 0.0)]
    assert at["lower"] == [(30.0, 0.0), (0.0, 0.0), (0.0, -9.0), (30.0, -9.0), (30.0, 0.0)]
    assert out["empty"] == [] and out["bare"] == [[]] and out["none"] is None
    # Off the line by almost the tolerance: what goes is within it of the line of its neighbours then, so the ends stay.
    out = {r.key: r.geometry for r in simplify(spark, spark.createDataFrame(rows, f"key string, {GEOMETRY}"), "key", "geometry").collect()}
    left = [(p.x, p.y) for p in out["bent"][0][0]]
    assert {(0.0, 40.0), (8.0, 40.0), (8.0, 45.0), (0.0, 45.0)} <= set(left) and len(left) < 12


def test_what_was_shuffled_for_a_kept_table_is_removed(spark):
    from plumbline.plans.scratch import Scratch

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in blocks.getAllFiles().mkString("\n").split("\n") if x.endswith(".data")}
    counts = spark.range(100_000).groupBy((F.col("id") % 777).alias("k")).count()
    scratch, before = Scratch(spark, "test"), files()
    kept = scratch.keep(counts, "counts")
    for _ in range(50):
        left = files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert kept.count() == counts.count() == scratch.keep(counts, "again").count() == 777
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    scratch.drop()
