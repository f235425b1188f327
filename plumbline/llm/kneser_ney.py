"""Interpolated modified Kneser-Ney language models of any order, counted in Spark and looked up in sorted hash arrays.

Tokens are words in lower case (A-Z only) and one end a text; before a text stand ``order - 1`` begins. Training goes
level by level from the longest n-grams down. A task counts the n-grams of its texts (a block holds a bounded number of
tokens) and sends each shard of hashes the distinct ones once, so a very frequent n-gram is one entry a block. A
shard adds the counts up, writes its sorted arrays, and sends the level below what it needs: to an n-gram's tail one more
left neighbour (the adjusted count of lower levels), to its head the sum of counts and how many followers have counts
of 1, 2, 3 or more. The shards are as many as the texts' bytes ask for, so none grows with the corpus, and the driver sees
counts of counts alone.

The model lies in the shared folder as flat files of one array each, by level and shard. Workers memory-map them (where the
folder is no mounted one, after a copy of the shard they ask for) and probe the sorted distinct n-grams of many texts
at once, so a shard is passed over from front to back.

With D(1), D(2), D(3+) of a level from its counts of counts n1 to n4 (kept within 0.1 and k - 0.1, 0.5 * k where n1
to n4 do not tell):
p_k(w | h) = max(0, a(hw) - D(a(hw))) / a(h.) + (sum of D(i) * N_i(h.)) / a(h.) * p_(k-1)(w | h without its first), a being counts at the
highest level and numbers of left neighbours below; p_k = p_(k-1) for an unseen h. At the lowest level the rest is spread
evenly over all known tokens and one unknown, so the probabilities after any h add up to 1.

Edge cases: null and empty texts are an end alone; without training texts all tokens are unknown and equally likely
(log 0 from the one unknown); repeated rows count as often as they come; texts and words of any length; columns of
any name ride along in ``score``; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.words import mix, runs, words
from plumbline.plans.scratch import Scratch

#: Hashes of the end of a text and of what stands before it.
END, BEGIN = np.uint64(0xE4D00000000000E1), np.uint64(0xBE61000000000BE9)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Tokens that are counted, or scored, at once.
BLOCK_TOKENS = 2_000_000
#: Bytes of texts for each shard of a level.
SHARD_BYTES = 16 << 20
#: What is added up of an n-gram: (adjusted) count, raw count, and of its followers the sum and those with 1, 2, 3+.
FIELDS = ("count", "raw", "total", "one", "two", "more")


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """One hash for each row of words' hashes."""
    h = grams[:, 0]
    for k in range(1, grams.shape[1]):
        h = mix(h * _STEP + grams[:, k])
    return h


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first text's number, tokens' hashes with the ends, and where each text's begin."""
    for first, data, starts in runs(column):
        w = words(data, starts, lower=True)
        at = np.searchsorted(w.text, np.arange(len(starts) + 1))
        yield first, np.insert(w.hash, at[1:], END), at[:-1] + np.arange(len(starts))


def windows(hashes: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each token."""
    out = np.empty((len(hashes), order), np.uint64)
    place = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    for k in range(order):
        back = order - 1 - k
        out[:, k] = BEGIN
        held = place >= back
        out[held, k] = hashes[np.nonzero(held)[0] - back]
    return out


# --- what goes between tasks ------------------------------------------------------------------------------


def _pack(grams: np.ndarray, fields: dict[str, np.ndarray]) -> bytes:
    """Rows as one compressed block: the distinct words, rows as numbers of words, and the fields that are not all 0.

    Words come as bytes of the steps from one to the next, all first bytes together, as sorted hashes have little in their highest bytes then.
    """
    known, numbers = np.unique(grams, return_inverse=True)
    numbers = numbers.reshape(grams.shape).astype(np.uint16 if len(known) <= 1 << 16 else np.uint32)
    # Rows with one head stand together, which compression makes short.
    order = np.lexsort(numbers.T[::-1])
    numbers, fields = numbers[order], {f: v[order] for f, v in fields.items()}
    given = [f for f in FIELDS if f in fields]
    kinds = [np.uint8 if fields[f].max(initial=0) < 256 else np.int64 for f in given]
    # Distinct single words are their own numbers.
    size = 0 if grams.shape[1] == 1 and len(grams) == len(known) else numbers.itemsize
    head = np.array([len(grams), grams.shape[1], len(known), size, sum(1 << FIELDS.index(f) for f in given), sum(1 << FIELDS.index(f) for f, k in zip(given, kinds, strict=True) if k == np.uint8)], np.int64)
    columns = [numbers[:, k].tobytes() for k in range(grams.shape[1])] if size else []
    steps = np.diff(known, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    block = b"".join([head.tobytes(), steps, *columns, *[fields[f].astype(k).tobytes() for f, k in zip(given, kinds, strict=True)]])
    return len(block).to_bytes(8, "little") + pa.compress(block, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    block = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    n, order, n_known, size, given, small = np.frombuffer(block, np.int64, 6).tolist()
    at = 48

    def take(kind: type, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(block, kind, count, at)
        at += out.nbytes
        return out

    known = np.cumsum(np.ascontiguousarray(take(np.uint8, 8 * n_known).reshape(8, n_known).T).view(np.uint64).ravel(), dtype=np.uint64)
    grams = np.stack([known[take(np.uint16 if size == 2 else np.uint32, n)] for _ in range(order)], 1) if size else known[:, None]
    return grams, {f: take(np.uint8 if small >> i & 1 else np.int64, n) for i, f in enumerate(FIELDS) if given >> i & 1}


def _merged(grams: np.ndarray, fields: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Distinct n-grams by hash, with their fields added up."""
    h = gram_hash(grams)
    order = np.argsort(h)
    h = h[order]
    first = np.nonzero(np.append(True, h[1:] != h[:-1]))[0] if len(h) else np.zeros(0, np.int64)
    add = lambda v: np.add.reduceat(v[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return h[first], grams[order[first]], {f: add(v) for f, v in fields.items()}


def _dealt(grams: np.ndarray, fields: dict[str, np.ndarray], shards: int) -> Iterator[tuple[int, bytes]]:
    """A block for each shard that has any of the rows, which come in the order of their hashes."""
    shard = shard_of(gram_hash(grams), shards)
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.nonzero(np.diff(cuts))[0]:
        a, b = cuts[s], cuts[s + 1]
        yield int(s), _pack(grams[a:b], {f: v[a:b] for f, v in fields.items()})


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the hash; their number is a power of two."""
    bits = shards.bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


# --- the model's files --------------------------------------------------------------------------------------


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _write(root: str, name: str, array: np.ndarray) -> None:
    """A file that is either whole or not there; a task that is run again writes the same."""
    store, base = _store(root)
    store.create_dir(base, recursive=True)
    part = f"{base}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).tobytes())
    store.move(part, f"{base}/{name}")


_maps: dict[tuple[str, str], np.ndarray] = {}


def _map(root: str, name: str) -> np.ndarray:
    """The bytes of a file of the model, memory-mapped; mapped once in a worker."""
    if (root, name) not in _maps:
        store, base = _store(root)
        where = f"{base}/{name}"
        if store.type_name == "local":
            _maps[root, name] = _mapped(where)
        else:  # a store that is not mounted: a private copy to map
            with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(where) as source:
                while piece := source.read(1 << 22):
                    copy.write(piece)
                copy.flush()
                _maps[root, name] = _mapped(copy.name)
    return _maps[root, name]


def _mapped(where: str) -> np.ndarray:
    return np.memmap(where, np.uint8, "r") if os.path.getsize(where) else np.zeros(0, np.uint8)


def _field(root: str, name: str, n: int) -> np.ndarray:
    """Numbers of a shard of ``n`` n-grams, as wide as the file's size tells."""
    raw = _map(root, name)
    return raw.view(f"u{len(raw) // n}")


def _narrow(values: np.ndarray) -> np.ndarray:
    most = int(values.max(initial=0))
    return values.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max))


@dataclass(frozen=True)
class Model:
    """A trained model: where its files are, the shards of each level, discounts by level, and totals of the lowest level.

    ``types`` and ``tokens`` are the known tokens and all training tokens, ``left`` the sum of the lowest level's counts and
    ``counts`` how many of its tokens have counts of 1, 2, 3 or more.
    """

    root: str
    order: int
    shards: int
    discounts: tuple[tuple[float, float, float], ...]
    types: int
    tokens: int
    left: int
    counts: tuple[int, int, int]

    def find(self, level: int, grams: np.ndarray, fields: tuple[str, ...]) -> dict[str, np.ndarray]:
        """The fields of n-grams of a level, 0 where they are unknown."""
        h = gram_hash(grams)
        asked, back = np.unique(h, return_inverse=True)
        out = {f: np.zeros(len(asked), np.int64) for f in fields}
        shard = shard_of(asked, self.shards)
        cuts = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.nonzero(np.diff(cuts))[0]:
            a, b = cuts[s], cuts[s + 1]
            keys = _map(self.root, f"{level}-{s}-hash").view(np.uint64)
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, asked[a:b]), len(keys) - 1)
            hit = keys[at] == asked[a:b]
            for f in fields:
                out[f][a:b][hit] = _field(self.root, f"{level}-{s}-{f}", len(keys))[at[hit]]
        return {f: v[back] for f, v in out.items()}

    def probabilities(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p of the last token of each n-gram, and the token's raw count."""
        low = self.find(1, grams[:, -1:], ("count", "raw"))
        p = self._step(1, low["count"], np.full(len(grams), self.left), [np.full(len(grams), c) for c in self.counts], np.full(len(grams), 1 / (self.types + 1)))
        for k in range(2, self.order + 1):
            head = self.find(k - 1, grams[:, -k:-1], ("total", "one", "two", "more"))
            p = self._step(k, self.find(k, grams[:, -k:], ("count",))["count"], head["total"], [head[f] for f in ("one", "two", "more")], p)
        return p, low["raw"]

    def _step(self, level: int, count: np.ndarray, total: np.ndarray, followers: list[np.ndarray], lower: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.discounts[level - 1]])
        own = np.maximum(count - d[np.minimum(count, 3)], 0.0)
        rest = sum(x * n for x, n in zip(d[1:], followers, strict=True))
        return np.where(total > 0, (own + rest * lower) / np.maximum(total, 1), lower)


def discounts_of(n: list[int]) -> tuple[float, float, float]:
    """D(1), D(2), D(3+) from how many n-grams have counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3)]
    return tuple(min(max(d, 0.1), k - 0.1) for k, d in zip((1, 2, 3), raw, strict=True))


# --- training and scoring -----------------------------------------------------------------------------------

BLOCKS = "shard int, block binary"
#: What the driver gets of a level, added up: n-grams with counts of 1, 2, 3, 4 and of 3 or more, the sum of counts, n-grams, raw counts.
FACTS = 8


def _counted(docs: DataFrame, order: int, shards: int) -> DataFrame:
    """Blocks of the longest n-grams with their counts."""

    def block(held: list[np.ndarray]) -> pa.RecordBatch:
        grams = np.concatenate(held)
        held.clear()
        _, grams, fields = _merged(grams, {"count": np.ones(len(grams), np.int64)})
        parts = list(_dealt(grams, fields, shards))
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], ["shard", "block"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            for _, hashes, starts in tokens(b.column(0)):
                held.append(windows(hashes, starts, order))
                if sum(map(len, held)) >= BLOCK_TOKENS:
                    yield block(held)
        if held:
            yield block(held)

    return docs.mapInArrow(count, BLOCKS)


def _level(blocks: DataFrame, root: str, level: int, order: int, shards: int) -> DataFrame:
    """Adds up the shards of a level and writes their arrays; returns a row of facts for each shard, and blocks for the level below."""
    stored = ["count"] if level == order else [f for f in FIELDS if f != "raw" or level == 1]

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(b) for b in frame["block"]]
        names = {f for _, x in parts for f in x} | {"count"}
        fields = {f: np.concatenate([x[f].astype(np.int64) if f in x else np.zeros(len(g), np.int64) for g, x in parts]) for f in names}
        every = np.concatenate([g for g, _ in parts])
        del parts
        h, grams, fields = _merged(every, fields)
        del every
        none = np.zeros(len(h), np.int64)
        _write(root, f"{level}-{key[0]}-hash", h)
        for f in stored:
            _write(root, f"{level}-{key[0]}-{f}", _narrow(fields.get(f, none)))
        held = fields["count"] > 0
        grams, a = grams[held], fields["count"][held]
        raw = fields["raw"][held] if "raw" in fields else a
        facts = [*[int((a == k).sum()) for k in (1, 2, 3, 4)], int((a >= 3).sum()), int(a.sum()), len(a), int(raw.sum())]
        out = []
        if level > 1:
            both = lambda tail, head: np.concatenate([tail, head]).astype(np.int64)
            off = np.zeros(len(a), np.int64)
            told = {"count": both(off + 1, off), "raw": both(raw, off), "total": both(off, a), "one": both(off, a == 1), "two": both(off, a == 2), "more": both(off, a >= 3)}
            _, below, told = _merged(np.concatenate([grams[:, 1:], grams[:, :-1]]), told)
            out = list(_dealt(below, told, shards))
        return pd.DataFrame({"shard": np.array([-1, *[s for s, _ in out]], np.int32), "block": [None, *[b for _, b in out]], "facts": [facts, *[None] * len(out)]})

    # Every shard is written, those without n-grams too.
    empty = _pack(np.zeros((0, level), np.uint64), {})
    every = blocks.select("shard", "block").unionByName(blocks.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(empty).alias("block")))
    return every.groupBy("shard").applyInPandas(add, f"{BLOCKS}, facts array<long>")


def train(spark: SparkSession, docs: DataFrame, text: str = "text", order: int = 2) -> Model:
    """A model of all ``docs``; its files stay in the shared folder as long as scores may be asked for."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    scratch = Scratch(spark, "kneser-ney")
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    shards = 1 << max(2, (size // SHARD_BYTES).bit_length())
    root = scratch.path("model")
    blocks, discounts, facts = _counted(texts, order, shards), [], []
    for level in range(order, 0, -1):
        done = scratch.keep(_level(blocks, root, level, order, shards), f"level-{level}", "zstd", dictionary=False)
        facts = list(done.where("shard < 0").agg(*[F.sum(F.col("facts")[i]) for i in range(FACTS)]).first())
        discounts.append(discounts_of(facts[:4]))
        if level < order:
            scratch.remove(f"level-{level + 1}")
        blocks = done.where("shard >= 0")
    scratch.remove("level-1")
    return Model(root, order, shards, tuple(reversed(discounts)), types=facts[6], tokens=facts[7], left=facts[5], counts=(facts[0], facts[1], facts[4]))


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, and of each text its tokens, those known, the training tokens, the log10 probability by
    single tokens (add one) and by the model, and the perplexity; columns of these names are replaced."""
    added = [c.split()[0] for c in SCORES.split(", ")]
    names = [c for c in docs.columns if c != text and c not in added]
    rows = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"), *[F.col(f"`{c}`") for c in names])

    def measure(column: pa.Array) -> list[np.ndarray]:
        n, known, base, own = (np.zeros(len(column), k) for k in (np.int64, np.int64, np.float64, np.float64))
        spread = np.log10(model.tokens + model.types + 1)
        for first, hashes, starts in tokens(column):
            p, raw = model.probabilities(windows(hashes, starts, model.order))
            at = slice(first, first + len(starts))
            n[at] = np.diff(np.append(starts, len(hashes)))
            known[at] = np.add.reduceat((raw > 0).astype(np.int64), starts)
            base[at] = np.add.reduceat(np.log10(raw + 1) - spread, starts)
            own[at] = np.add.reduceat(np.log10(p), starts)
        return [n, known, np.full(len(column), model.tokens), base, own, 10 ** np.minimum(-own / np.maximum(n, 1), 300)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *map(pa.array, measure(b.column(0)))], [*names, *added])

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names]
    return rows.mapInArrow(run, ", ".join([*fields, SCORES]))
