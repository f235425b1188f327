"""SentencePiece encoding and decoding with a unigram model: Viterbi over a double-array trie.

A model file's pieces and scores are read from its protobuf fields; the scores count as log probabilities,
whatever the file was trained for. A text gets a leading space if the model says so, spaces become the
marker U+2581, and the path of the largest score is found over the pieces that the trie holds. A character
that is no piece costs the least score less 10 and is written as its UTF-8 bytes' pieces.

Where no piece has a marker after another character (checked when the model is loaded), the best path of a
text is that of its words one after another, so a task encodes a word once and finds it again in a bounded
cache; else whole texts are searched.

Edge cases: a null or empty text has no ids and decodes to an empty text; U+2581 in a text is read back as a
space; of paths with equal scores the one whose last piece is longest wins; an empty table gives an empty
result; columns besides id and text are not looked at.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character costs below the least score.
UNKNOWN_COST = 10.0
CACHE_WORDS, CACHE_WORD_BYTES = 300_000, 64
#: The trie and the pieces are broadcast; a larger model file is refused.
MAX_MODEL_BYTES = 64 << 20


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) pairs of a protobuf message; nested messages come as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = {5: 4, 1: 8}[tag & 7]
            yield tag >> 3, data[at : at + size]
            at += size


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], bool, bool]:
    """Pieces (text, score, kind), whether a leading space is added, whether extra spaces are removed."""
    pieces, prefix, squeeze = [], True, True
    for number, value in _fields(data):
        if number == 1:
            own = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0], own[3]))
        elif number == 3:
            own = dict(_fields(value))
            if own.get(2):
                raise ValueError("the model normalises characters; only the identity is supported")
            prefix, squeeze = bool(own.get(3, prefix)), bool(own.get(4, squeeze))
    return pieces, prefix, squeeze


class DoubleArray:
    """A trie in two arrays: a child by byte b of node s is t = base[s] + b + 1 where check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        names = sorted(keys)
        base, check, value, used = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)

        def grow(least: int) -> None:
            nonlocal base, check, value, used
            more = max(least, 2 * len(used)) - len(used)
            base, used = np.append(base, np.zeros(more, np.int32)), np.append(used, np.zeros(more, bool))
            check, value = (np.append(x, np.full(more, -1, np.int32)) for x in (check, value))

        grow(1 << 16)
        used[0] = True
        free, fork = 1, 1  # no free place before free; forks are not looked for before fork
        todo = [(0, 0, len(names), 0)] if names else []  # node, range of keys, depth
        while todo:
            node, low, high, depth = todo.pop()
            if len(names[low]) == depth:
                value[node] = keys[names[low]]
                low += 1
            groups, at = [], low
            while at < high:
                byte, end = names[at][depth], at + 1
                while end < high and names[end][depth] == byte:
                    end += 1
                groups.append((byte, at, end))
                at = end
            if not groups:
                continue
            codes = np.array([g[0] + 1 for g in groups])
            while used[free]:
                free += 1
            start = max((free if len(codes) == 1 else max(free, fork)) - codes[0], 0)
            while True:
                if start + 1024 + 257 >= len(used):
                    grow(start + 2048)
                fits = ~used[(start + np.arange(1024))[:, None] + codes].any(1)
                if fits.any():
                    start += int(fits.argmax())
                    break
                start += 1024
                fork = max(fork, start)
            base[node] = start
            for byte, first, last in groups:
                child = start + byte + 1
                used[child], check[child] = True, node
                todo.append((child, first, last, depth + 1))
        self.base, self.check, self.value = base, check, value

    def prefixes(self, data: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of each key that ``data`` has at ``at``."""
        node = 0
        for end in range(at, len(data)):
            child = int(self.base[node]) + data[end] + 1
            if self.check[child] != node:
                return
            node = child
            if self.value[node] >= 0:
                yield end + 1, int(self.value[node])


@dataclass
class Model:
    """What tasks need: the trie's arrays, scores and the pieces' bytes."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    raw: list[bytes]
    byte_ids: list[int]
    unknown_id: int
    unknown_score: float
    prefix: bool
    by_words: bool
    by_lines: bool

    @classmethod
    def load(cls, data: bytes) -> Model:
        if len(data) > MAX_MODEL_BYTES:
            raise ValueError(f"the model has {len(data)} bytes; at most {MAX_MODEL_BYTES} go to executors")
        pieces, prefix, squeeze = read_model(data)
        if squeeze:
            raise ValueError("the model removes extra spaces; only models that keep all are supported")
        scores = np.array([p[1] for p in pieces])
        normal = [i for i, p in enumerate(pieces) if p[2] == NORMAL]
        low, high = scores[normal].min(), scores[normal].max()
        for i, p in enumerate(pieces):
            if p[2] == USER:
                scores[i] = len(p[0]) * high - 0.1
        trie = DoubleArray({p[0].encode(): i for i, p in enumerate(pieces) if p[2] in (NORMAL, USER)})
        byte_ids = [-1] * 256
        raw = []
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                byte_ids[int(text[3:5], 16)] = i
                raw.append(bytes([int(text[3:5], 16)]))
            else:
                raw.append({CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind, text.replace(MARK, " ").encode()))
        in_trie = [p[0] for p in pieces if p[2] in (NORMAL, USER)]
        unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        return cls(
            trie.base, trie.check, trie.value, scores, raw, byte_ids, unknown, float(low - UNKNOWN_COST), prefix,
            by_words=not any(MARK in p.lstrip(MARK) for p in in_trie), by_lines=not any("\n" in p for p in in_trie),
        )


class Codec:
    def __init__(self, model: Model):
        self.m = model
        self.base, self.check, self.value, self.scores = (x.tolist() for x in (model.base, model.check, model.value, model.scores))
        self.cache: dict[bytes, bytes] = {}
        parts = rb" +[^ \n]*|\n|[^ \n]+" if model.by_lines else rb" +[^ ]*|[^ ]+"
        self.split = re.compile(parts).findall if model.by_words else lambda x: [x]

    def best_path(self, data: bytes) -> list[int]:
        """Ids of the path with the largest score over ``data`` (markers for spaces)."""
        base, check, value, scores = self.base, self.check, self.value, self.scores
        n = len(data)
        best: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        best[0], at = 0.0, 0
        while at < n:
            lead = data[at]
            after = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            here, node, end, single = best[at], 0, at, False
            while end < n:
                child = base[node] + data[end] + 1
                if check[child] != node:
                    break
                node, end = child, end + 1
                found = value[node]
                if found >= 0:
                    score = here + scores[found]
                    if best[end] is None or score > best[end]:
                        best[end], back[end] = score, (at, found)
                    single = single or end == after
            if not single:
                score = here + self.m.unknown_score
                if best[after] is None or score > best[after]:
                    best[after], back[after] = score, (at, -1)
            at = after
        out: list[int] = []
        while n:
            start, found = back[n]
            if found >= 0:
                out.append(found)
            else:
                ids = [self.m.byte_ids[b] for b in reversed(data[start:n])]
                out += ids if min(ids) >= 0 else [self.m.unknown_id]
            n = start
        return out[::-1]

    def encode(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        text = text.replace(MARK.encode(), b" ")
        words, cache = self.split(b" " + text if self.m.prefix else text), self.cache
        big: dict[bytes, bytes] = {}
        for w in {w for w in words if w not in cache}:
            ids = np.array(self.best_path(w.replace(b" ", MARK.encode())), "<i4").tobytes()
            (cache if len(w) <= CACHE_WORD_BYTES else big)[w] = ids
        out = b"".join([big[w] if w in big else cache[w] for w in words] if big else [cache[w] for w in words])
        if len(cache) > CACHE_WORDS:
            cache.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        raw = self.m.raw
        text = b"".join([raw[i] for i in memoryview(ids).cast("i")])
        return text[1:] if self.m.prefix and text[:1] == b" " else text


def encode_documents(spark: SparkSession, docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_ids, ids, decoded_crc32 (of the ids' text in UTF-8), round_trip (that text is the document's)."""
    with open(model_file, "rb") as f:
        shared = spark.sparkContext.broadcast(Model.load(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                kind = pa.large_binary() if pa.types.is_large_string(part.column(1).type) else pa.binary()
                texts = [x or b"" for x in part.column(1).cast(kind).to_pylist()]
                ids = [codec.encode(t) for t in texts]
                back = [codec.decode(x) for x in ids]
                sizes = [len(x) // 4 for x in ids]
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), lists, pa.array([zlib.crc32(x) for x in back], pa.int64()), pa.array([a == b for a, b in zip(texts, back, strict=True)])],
                    names=["doc_id", "n_ids", "ids", "decoded_crc32", "round_trip"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids array<int>, decoded_crc32 long, round_trip boolean")
