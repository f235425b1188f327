"""Writers: spatially clustered Parquet, splits by a dimension, comparison tables, output policy."""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions import geo
from plumbline.operators.outline import hilbert_order
from plumbline.sources.wkb import to_wkb

POLICIES = ("overwrite", "skip_existing", "none")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def should_write(spark: SparkSession, paths: list[str], policy: str) -> bool:
    """For outputs that belong together: all or none. ``skip_existing`` skips if all exist, ``none`` raises if any does."""
    if policy not in POLICIES:
        raise ValueError(f"the policy is one of {', '.join(POLICIES)}")
    there = [p for p in paths if exists(spark, p)]
    if policy == "none" and there:
        raise FileExistsError(there[0])
    return policy != "skip_existing" or len(there) < len(paths)


def write_clustered(df: DataFrame, path: str, geometry: str = "geometry", row_group_rows: int = 100_000, policy: str = "overwrite", crs: int = 2154) -> None:
    """GeoParquet in Hilbert order of the boxes, with well-known binary and a bbox struct whose statistics let readers skip row groups.

    Each file's footer has the ``geo`` key. Tasks write files under hidden names of their own; when all have ended,
    the files of those attempts that counted get their names, and what was there before goes. An empty table is written as such.
    """
    spark = df.sparkSession
    if not should_write(spark, [path], policy):
        return
    boxed = df.withColumn("bbox", F.transform(geometry, geo.bounds))
    over = lambda f, c: f(F.transform("bbox", lambda b: b[c]))
    boxed = boxed.withColumns({"__x0": over(F.array_min, "xmin"), "__y0": over(F.array_min, "ymin"), "__x1": over(F.array_max, "xmax"), "__y1": over(F.array_max, "ymax")})
    ordered = hilbert_order(boxed, ("__x0", "__y0", "__x1", "__y1"))
    bbox = F.struct(F.col("__x0").alias("xmin"), F.col("__y0").alias("ymin"), F.col("__x1").alias("xmax"), F.col("__y1").alias("ymax"))
    out = ordered.withColumn("bbox", bbox).withColumn(geometry, to_wkb(F.col(geometry))).drop("__x0", "__y0", "__x1", "__y1")
    out = out.repartitionByRange("hilbert").sortWithinPartitions("hilbert").drop("hilbert")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = files.makeQualified(where).toString()
    schema = to_arrow_schema(out.schema).with_metadata({"geo": geo_metadata(geometry, crs)})
    write = _file_writer(uri, schema, row_group_rows)
    names = [r["name"] for r in out.mapInArrow(write, "name string").collect()] or [next(write(iter(())))["name"][0].as_py()]
    at = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{uri}/{name}")
    for old in files.listStatus(where):
        if old.getPath().getName() not in names:
            files.delete(old.getPath(), True)
    for k, name in enumerate(sorted(names)):
        files.rename(at(name), at(f"part-{k:05}-{name.split('-')[-1]}"))


def _file_writer(uri: str, schema: pa.Schema, row_group_rows: int):
    """For ``mapInArrow``: one file for each task that has rows; returns its hidden name."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        first = next(batches, None)
        context = TaskContext.get()
        if first is None and context is not None:
            return
        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        name = f".{context.partitionId() if context else 0:05}-{uuid.uuid4().hex}.parquet"
        with store.open_output_stream(f"{base}/{name}") as sink, pq.ParquetWriter(sink, schema, compression="zstd") as writer:
            held, rows = [], 0
            for b in itertools.chain([first] if first is not None else [], batches):
                held.append(b)
                rows += len(b)
                if rows >= row_group_rows:
                    table = pa.Table.from_batches(held).cast(schema)
                    writer.write_table(table.slice(0, rows - rows % row_group_rows), row_group_size=row_group_rows)
                    held = table.slice(rows - rows % row_group_rows).to_batches()
                    rows %= row_group_rows
            if rows:
                writer.write_table(pa.Table.from_batches(held).cast(schema), row_group_size=row_group_rows)
        yield pa.RecordBatch.from_pydict({"name": [name]})

    return write


def geo_metadata(geometry: str, crs: int = 2154) -> str:
    """GeoParquet 1.1.0 metadata of a dataset: binary encoding and the bbox covering."""
    side = lambda c: ["bbox", c]
    column = {"encoding": "WKB", "geometry_types": ["MultiPolygon Z"], "crs": {"id": {"authority": "EPSG", "code": crs}}, "covering": {"bbox": {c: side(c) for c in ("xmin", "ymin", "xmax", "ymax")}}}
    return json.dumps({"version": "1.1.0", "primary_column": geometry, "columns": {geometry: column}})


def write_split(df: DataFrame, path: str, dimension: str, rows_per_file: int = 5_000_000) -> None:
    """One folder per value of a dimension, with as many files (and tasks) as its rows ask for."""
    counts = df.groupBy(F.col(f"`{dimension}`").alias("__value")).agg(F.ceil(F.count("*") / rows_per_file).alias("__files"))
    counted = df.join(counts, F.col(f"`{dimension}`").eqNullSafe(F.col("__value")))
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col("__files"))
    dealt = counted.withColumn("__file", deal).repartition(F.col(f"`{dimension}`"), F.col("__file"))
    dealt.drop("__value", "__files", "__file").write.mode("overwrite").partitionBy(dimension).parquet(path)


def write_classes(df: DataFrame, path: str, classes: list[int] | None = None) -> None:
    """Points of the given classes; none given: all."""
    (df.where(F.col("Classification").isin(*classes)) if classes else df).write.mode("overwrite").parquet(path)


def write_iteration(df: DataFrame, template: str, iteration: int) -> str:
    """Into the folder of an iteration; the template holds ``{iteration}`` exactly once."""
    if template.count("{iteration}") != 1:
        raise ValueError("the template holds {iteration} exactly once")
    path = template.replace("{iteration}", str(iteration))
    df.write.mode("overwrite").parquet(path)
    return path


def write_comparison(df: DataFrame, path: str, kind: str, geometry: str | None = None) -> None:
    """csv (lists as JSON, geometry as text), json records, or parquet (geometry as binary)."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError("the kind is csv, json or parquet")
    if geometry:
        df = df.withColumn(geometry, to_wkb(F.col(geometry)) if kind == "parquet" else geo.wkt(F.col(geometry)))
    if kind == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
        df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    else:
        getattr(df.write.mode("overwrite"), kind)(path)
