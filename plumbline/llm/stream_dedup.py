"""Exact deduplication as a stream.

Two streams run one after the other, each over what has arrived since its last run:

1. documents -> a log of digests (one light row per document: id, digest, content locator), and per batch
   one row per digest (count, largest id), summed map-side first, so a text that a third of all rows have
   reaches the state as one row;
2. those rows -> keyed state in RocksDB on the executors' disks, without expiry: per digest the stable id
   and content locator (file and row in it) of its first document, the count, and the row that stays so far.

A digest seen more than once is a hit, and hits are confirmed on full bytes: the texts of all hits are
grouped by (digest, text), which compares whole strings and combines copies map-side. Digests under which
different texts meet are then resolved by text. State and logs lie in the shared folder, so a lost executor
costs only a retry.

Edge cases: a null text counts as empty; texts are equal when identical after lower-casing A-Z; of equal
texts the row with the largest id stays (null is the least), and of repeated rows with that id one row; an
empty table gives an empty result. The id -2^63 stands for null inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.plans.scratch import Scratch

NO_ID = -(1 << 63)
#: Names of the files that have been read are broadcast up to this many (about 20 MB); beyond that they are joined by shuffling.
MOST_FILES = 100_000
SEEN = "digest string, first struct<batch:long,doc_id:long,row:long,locator:string>, keep struct<doc_id:long,batch:long,row:long>, n long"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Many small stores would each set 4 MB of disk aside.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


class StreamDedup:
    """A deduplication that goes on: call ``run`` again after files have come to ``source``."""

    def __init__(self, spark: SparkSession, source: str, doc_id: str = "doc_id", text: str = "text", digest=sha256, max_files: int = 1000):
        self.spark, self.source, self.digest, self.max_files = spark, source, digest, max_files
        self.scratch = Scratch(spark, "stream-dedup")
        schema = spark.read.parquet(source).schema
        # A file source takes a folder or a pattern; as a pattern, a single file will do as well.
        pattern = f"{source[:-1]}[{source[-1]}]" if source[-1].isalnum() else source
        docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(pattern)
        where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index")]
        self.shape = lambda df: df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), normalised(F.col(text)).alias("text"), *where)
        self.schema, self.docs = schema, self.shape(docs)

    def _log(self, rows: DataFrame, k: int) -> None:
        """Idempotent: a batch that is run again replaces its own folders."""
        log = rows.withColumns({"batch": F.lit(k).cast("long"), "row": F.monotonically_increasing_id()})
        log.write.mode("overwrite").parquet(self.scratch.path(f"log/part={k}"))
        log = self.spark.read.parquet(self.scratch.path(f"log/part={k}"))
        found = log.groupBy("digest").agg(F.min(F.struct("batch", "doc_id", "row", "locator")).alias("first"), F.max(F.struct("doc_id", "batch", "row")).alias("keep"), F.count("*").alias("n"))
        found.write.mode("overwrite").parquet(self.scratch.path(f"seen/part={k}"))

    def _drain(self, stream: DataFrame, sink, name: str, mode: str) -> None:
        query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", self.scratch.path(f"checkpoint/{name}")).trigger(availableNow=True).start()
        query.awaitTermination()

    def run(self) -> None:
        light = self.docs.select("doc_id", self.digest(F.col("text")).alias("digest"), F.concat_ws("#", "file", "index").alias("locator"))
        self._drain(light, self._log, "log", "append")
        seen = self.spark.readStream.schema(SEEN).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", self.max_files).parquet(self.scratch.path("seen"))
        before = {k: self.spark.conf.get(k, None) for k in ROCKSDB}
        for k, v in ROCKSDB.items():
            self.spark.conf.set(k, v)
        try:
            # No watermark: the state of a digest never expires.
            changed = seen.groupBy("digest").agg(F.min("first").alias("first"), F.max("keep").alias("keep"), F.sum("n").alias("n"))
            self._drain(changed, lambda df, k: df.write.mode("overwrite").parquet(self.scratch.path(f"changes/part={k}")), "state", "update")
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.scratch.path(name))

    def state(self) -> DataFrame:
        """The latest state of each digest; counts only grow, so it is the one with the largest count."""
        latest = self._table("changes", SEEN).groupBy("digest").agg(F.max_by(F.struct("first", "keep", "n"), "n").alias("s"))
        return latest.select("digest", F.col("s.first.doc_id").alias("stable_id"), "s.first.locator", F.col("s.keep").alias("keep"), F.col("s.keep.doc_id").alias("keep_id"), "s.n")

    def result(self) -> DataFrame:
        """One row per document: doc_id, digest, keep_id, group_size, kept."""
        log = self._table("log", "doc_id long, digest string, locator string, batch long, row long")
        # Written, so that a digest that very many rows have is split over tasks where it is joined.
        state = self.scratch.keep(self.state(), "latest")
        # The source may have grown since the last run: only files that are in the log count.
        files = self.scratch.keep(log.select(F.regexp_replace("locator", "#[0-9]+$", "").alias("file")).distinct(), "files")
        files = F.broadcast(files) if files.count() <= MOST_FILES else files
        texts = self.shape(self.spark.read.schema(self.schema).parquet(self.source)).join(files, "file", "left_semi").withColumn("digest", self.digest(F.col("text")))
        hits = state.where("n > 1").select("digest")
        variants = texts.join(hits, "digest", "left_semi").groupBy("digest", "text").agg(F.count("*").alias("n"))
        clashes = self.scratch.keep(variants.groupBy("digest").agg(F.count("*").alias("v")).where("v > 1").select("digest"), "clashes")
        some = not clashes.isEmpty()
        plain = log.join(clashes, "digest", "left_anti") if some else log
        out = plain.join(state, "digest").select("doc_id", "digest", "keep_id", F.col("n").alias("group_size"), F.expr("struct(doc_id, batch, row) = keep").alias("kept"))
        if some:
            met = texts.join(clashes, "digest", "left_semi")
            groups = met.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
            nth = F.row_number().over(Window.partitionBy("digest", "text", "doc_id").orderBy("doc_id"))
            own = met.withColumn("nth", nth).join(groups, ["digest", "text"])
            out = out.unionByName(own.select("doc_id", "digest", "keep_id", "group_size", F.expr("doc_id = keep_id and nth = 1").alias("kept")))
        known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
        return out.select(known("doc_id"), "digest", known("keep_id"), "group_size", "kept")
