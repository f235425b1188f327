"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")
@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_equals_sql(spark, db, name):
    df = __spark_entry__.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    want = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    assert got, "a query without rows shows nothing"
    assert got == sorted(repr([plain(r[columns.index(c)]) for c in names]) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_no_pairs_of_everything(spark):
    """The spatial joins are equi-joins on cells."""
    from plumbline.operators import outline
    from plumbline.sources import fixtures as fx

    edges = outline.edges(outline.rings(outline.polygons(fx.buildings(spark, SF))))
    plan = outline.edge_overlaps(edges.withColumnRenamed("idx_edge", "edge_key"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
