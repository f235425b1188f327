"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="plumbline-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{local}")
    return shared_dir(spark)


_open: list[tuple[str, Scratch]] = []


def drop_all(label: str, unless: DataFrame) -> None:
    """Remove the folders of all runs with this label, as what was made from them is written elsewhere; those
    that ``unless`` still reads from stay."""
    files = unless.inputFiles() if any(x[0] == label for x in _open) else []
    for item in [x for x in _open if x[0] == label]:
        name = item[1].root.rpartition("/")[2]
        if not any(name in f for f in files):
            item[1].drop()
            _open.remove(item)


#: Spark's switch for removing the shuffle files of a query once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one run, under a folder of their own; a lost executor loses none of them.

    The folder lives as long as results that read from it may be needed; ``drop`` removes it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/plumbline/{label}-{uuid.uuid4().hex}"
        _open.append((label, self))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "snappy", dictionary: bool = True) -> DataFrame:
        """Write ``df`` once and go on from the files: lineage is cut, later reads are column-pruned.

        Tables of hashes and texts, whose values hardly repeat, are written faster without a dictionary. What was shuffled for the
        table is removed with the end of the write; else it stays until the driver happens to collect its garbage.
        """
        where, before = self.path(name), self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", codec).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(where)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(where)

    def remove(self, name: str) -> None:
        self._delete(self.path(name))

    def drop(self) -> None:
        self._delete(self.root)

    def put_bytes(self, name: str, data: bytes) -> str:
        """A small file by Hadoop's file system, so that any store works; its URI."""
        jvm, where = self.spark.sparkContext._jvm, self.path(name)
        target = jvm.org.apache.hadoop.fs.Path(where)
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(target, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return fs.makeQualified(target).toString()

    def _delete(self, where: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
