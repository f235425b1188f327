"""Best-fit packing planned over a histogram of lengths.

Documents are tokenised and only those longer than a sequence are cut. The driver gets one count per
length, which is at most ``seq_len`` numbers however large the corpus, and packs counts: lengths in
descending order, each into the fullest open sequences that still have room, many alike at a time. The plan
is a list of slots, (length, first rank, sequences, places a sequence, first sequence, offset). A piece then
takes the slot that holds its rank among the pieces of its length.

Size of the plan: a length opens or splits at most four runs of like sequences, and a run takes up each
length once at most, so distinct lengths in it sum to ``seq_len`` or less (about 90 for 4096); the plan has
at most 4 * 4096 * 90 slots whatever the corpus holds, and it is broadcast on that ground.

Ranks within a length come from counts per (length, bucket) plus a row number inside the bucket; a length has
buckets in proportion to its pieces, dealt by a stored salt, so one length that a third of all pieces have is
ranked by many tasks, and the counts are few.

Edge cases: a null or empty text is a piece of one token (the end id); repeated rows and repeated or null
ids are packed each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.tokens import text_bytes, text_encoder
from plumbline.plans.scratch import Scratch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
#: Pieces that one task ranks, about.
BUCKET_ROWS = 20_000


def pieces(docs: DataFrame, tokenizer: str, seq_len: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, and a salt of the row."""
    ending = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n = text_encoder(tokenizer), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), model.encode(text_bytes(batch.column(1))), strict=True):
                whole = memoryview(ids + ending)
                for k, at in enumerate(range(0, len(whole) // 4, seq_len)):
                    own = whole[4 * at : 4 * (at + seq_len)]
                    rows.append((key, k, at, len(own) // 4, zlib.crc32(own), (part << 40) + n))
                    n += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], seq_len: int) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, places a sequence, first sequence, offset) in order, and the sequence count."""
    runs: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, how many)
    free, opened, slots = 0, 0, []  # free: bit r is set where runs[r] has any

    def put(room: int, first: int, count: int) -> None:
        nonlocal free
        if count and room:
            runs.setdefault(room, []).append((first, count))
            free |= 1 << room

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= seq_len:
            raise ValueError(f"length {length} is outside 1..{seq_len}")
        left, rank = histogram[length], 0
        while left:
            fits = free >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                first, count = runs[room].pop()
                if not runs[room]:
                    free &= ~(1 << room)
            else:
                room, first = seq_len, opened
                count = -(-left // (seq_len // length))
                opened += count
            each = room // length
            full = min(count, left // each)
            if full:
                slots.append((length, rank, each, first, seq_len - room))
                rank += full * each
                left -= full * each
                put(room - each * length, first, full)
            if left and full < count:  # fewer than a sequence takes
                slots.append((length, rank, left, first + full, seq_len - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, count - full)
    table = np.array(slots, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], opened


def ranked(found: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``found`` with the rank of each row among those of its length, from 0."""
    each = found.sparkSession.createDataFrame([(k, n // BUCKET_ROWS + 1) for k, n in histogram.items()], "length long, buckets long")
    # One row per length, so at most a sequence's length of them.
    dealt = found.join(F.broadcast(each), "length").withColumn("bucket", F.pmod(F.xxhash64("salt"), F.col("buckets"))).drop("buckets")
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "salt")
    return dealt.withColumn("own", F.row_number().over(own)).join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, seq_len: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(spark, "best-fit")
    found = scratch.keep(pieces(docs, tokenizer, seq_len, end_id, doc_id, text), "pieces")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan(histogram, seq_len)
    keys = spark.sparkContext.broadcast(((slots[:, 0] << 48) | slots[:, 1], slots))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        starts, rows = keys.value
        at = rows[np.searchsorted(starts, (length.to_numpy() << 48) | rank.to_numpy(), "right") - 1]
        inside = rank.to_numpy() - at[:, 1]
        return pd.DataFrame({"sequence_id": at[:, 3] + inside // at[:, 2], "offset": at[:, 4] + inside % at[:, 2] * length.to_numpy()})

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = ranked(found, histogram).select(*names, place("length", "rank").alias("at"))
    return out.select(*names, "at.sequence_id", "at.offset")
