"""Packed token matrices: best-fit decreasing with a segment tree over the room left.

Texts are tokenised to 16-bit ids with an end id after each; a document longer than a row is split into
row-long pieces, losslessly. Pieces are dealt evenly over shards whose size is bounded by ``shard_bytes`` of
text (a text has at most one token per byte), and a shard is packed by one task: pieces in descending order
of length, each into the fullest row that still takes it, found by descending a segment tree over capacities.

A row of the result is a row of its shard's id matrix: ids (``seq_len`` little-endian unsigned 16-bit
numbers, padded with the end id), cu_seqlens (cumulative segment lengths from 0), position_resets (the
columns at which the position counter starts again from 0), and doc_ids and pieces of its segments.

Long runs of white space, on which the library's pattern search runs out of stack, are merged apart from the text
around them: such a run but its last character is a unit of its own to the pattern, so the ids are the same.

Edge cases: a null or empty text is one end id; repeated rows and null ids are packed each for itself; which
row a piece gets depends on how the input is dealt over tasks, what is packed does not; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tokens import rank_encoding, text_bytes

PIECES = "doc_id long, piece int, length int, ids binary, shard long"
ROWS = "shard long, row int, n_tokens int, n_segments int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, position_resets array<int>, ids binary"

#: What Unicode calls white space (fixed values), in runs that are long.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def encode(model, text: str) -> np.ndarray:
    """The ids of ``text``, as ``model.encode_to_numpy`` gives them."""
    parts, at = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - 1 if run.end() < len(text) else run.end()
        parts += [model.encode_to_numpy(text[at : run.start()]), np.array(model._encode_single_piece(text[run.start() : end]), np.uint32)]
        at = end
    return np.concatenate([*parts, model.encode_to_numpy(text[at:])]) if parts else model.encode_to_numpy(text)


class CapacityTree:
    """Rows by room left; ``best`` finds a row with the least room that is enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.any = np.zeros(2 * self.size, bool)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _mark(self, room: int) -> None:
        at = self.size + room
        self.any[at] = bool(self.rows[room])
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        if len(self.rows[room]) == 1:
            self._mark(room)

    def best(self, need: int) -> tuple[int, int] | None:
        """(room, row), taken out; None if no row has room enough."""
        at = self.size + need
        while not self.any[at]:
            while at & 1:  # a right child: what is larger hangs further up
                at //= 2
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self._mark(room)
        return room, row


def best_fit_decreasing(lengths: list[int], seq_len: int) -> list[list[int]]:
    """Indices of ``lengths``, by row; equal lengths in the order given."""
    tree, rows = CapacityTree(seq_len), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.best(lengths[k])
        if found is None:
            found = seq_len, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(k)
        if room > lengths[k]:
            tree.add(room - lengths[k], row)
    return rows


def token_pieces(docs: DataFrame, ranks: str, pattern: str, seq_len: int, end_id: int, n_shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = rank_encoding(ranks, pattern)
        n = TaskContext.get().partitionId()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = text_bytes(batch.column(1))
            for start in range(0, len(keys), 512):
                rows: list[tuple] = []
                for key, text in zip(keys[start : start + 512], texts[start : start + 512], strict=True):
                    ids = np.append(encode(model, text.decode()), end_id).astype("<u2")
                    for k, at in enumerate(range(0, len(ids), seq_len)):
                        own = ids[at : at + seq_len]
                        rows.append((key, k, len(own), own.tobytes(), n % n_shards))
                        n += 1
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "length", "ids", "shard"])

    return docs.mapInArrow(run, PIECES)


def pack(docs: DataFrame, ranks: str, pattern: str, seq_len: int = 4096, end_id: int = 50256, shard_bytes: int = 16 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed rows of all shards; the writer's files are the output, each holding rows of id matrices."""
    if not 0 <= end_id < 1 << 16:
        raise ValueError("ids are written as 16-bit numbers")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n_shards = max(1, -(-total // shard_bytes))

    def rows(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        out = []
        for k, own in enumerate(best_fit_decreasing(group["length"].tolist(), seq_len)):
            part = group.loc[own]
            ends = np.cumsum([0, *part["length"]])
            used = int(ends[-1])
            ids = b"".join(part["ids"]) + np.full(seq_len - used, end_id, "<u2").tobytes()
            out.append((group["shard"].iat[0], k, used, len(own), [None if pd.isna(x) else int(x) for x in part["doc_id"]], part["piece"].tolist(), ends.tolist(), ends[:-1].tolist(), ids))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    return token_pieces(docs, ranks, pattern, seq_len, end_id, n_shards).repartition(n_shards, "shard").groupBy("shard").applyInPandas(rows, ROWS)


def positions(cu_seqlens: list[int]) -> np.ndarray:
    """The position of each token of a row within its segment."""
    ends = np.asarray(cu_seqlens)
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
