r"""Fuzzy line deduplication: DataFrame joins and sums, with NumPy for signatures and comparisons.

Lines are normalised (lower case, white space runs as one space, trimmed); lines without a character are left alone. Two
lines are linked if they are equal or the Jaccard similarity of their sets of 5-character shingles is ``similarity``
(0.8) or more; of each component of links the first line (least document id, then row, then line number) stays and all others go.

A line's MinHash signature is the ``LEAST`` least hashes of all its shingles of seven characters, in any script, with or without
spaces; all lines sign alike. A band is a run of three hashes that follow each other in the sorted signature (of two or one in
short signatures): two lines meet if any three that follow each other are the same, whatever else stands between the others. Recall by kind of line is in the README and the tests.

Equal lines are one node (by their md5), so copies are never expanded. Members of a bucket bring a sketch of their signature (a bitmap
of parities), and pairs whose sketches show that their signatures have too few hashes in common never leave the bucket: most
buckets of a large corpus hold lines that share common words by chance. Each member first meets the nearest of those before it (in blocks
of ``BLOCK``). What is left to compare in a bucket is remembered; where its members are still apart
after that, they meet in all pairs, block by block, so that no pair that shares a bucket goes by. There they bring a bitmap of
all their shingles, and pairs of which it shows that they aren't similar stay in the block, too. Keys are dealt in ``PASSES`` passes,
so only a part of all bands is on disk at once. Pairs whose
signatures have few hashes in common are dropped; texts of nodes in the pairs that are left are split off again, and these are verified on the sets of
all their shingles, as strings. Components come from alternating stars.

Signatures and comparisons run in Arrow batches: with DataFrame functions alone, the shingles of all lines took more CPU
than the whole operator may (figures in the README).

Edge cases: null texts have no lines that count and stay as they are; lines shorter than a shingle are linked to equal
ones only; repeated rows keep their lines once, with the first of them; lines of one character repeated are compared like
others; columns of any name ride along; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.quality import normalised_line
from plumbline.llm.words import mix, runs
from plumbline.operators.graph import connected_components
from plumbline.plans.scratch import Scratch

#: Characters of a shingle that is compared, and of one in a signature: fewer lines share longer ones.
SHINGLE, SIGNED = 5, 7
#: Hashes in a signature.
LEAST = 20
#: Hashes in a band, and the shortest and longest signatures that have such bands.
RUNS = ((3, 5, LEAST), (2, 3, 5), (1, 1, 3))
#: Similarity that the signatures of similar lines show at least: 0.73 (0.8 of the shorter shingles where edits are far apart), less three standard deviations.
COMMON = 0.42
#: Bits in which the sketches of such signatures differ at most: they have 9 of ``LEAST`` hashes in common, and each other hash turns one bit.
MOST_APART = 22
#: Members of a bucket that meet in one place, and pairs that are looked at together.
BLOCK, TOGETHER = 256, 1 << 20
#: Rows of sorted bands that are taken at once.
CHUNK = 1 << 16
#: Passes over the bands of a large table, and bands of one pass of a small one.
PASSES, PASS_BANDS = 8, 1 << 22
#: Ids of lines that are compared are broadcast to the lines up to this many; beyond that a bitmap of as many bits tells which lines may be
#: among them (of 10 million ids, it lets 7 in 100 of the others by), and these and the ids are shuffled.
MOST_BROADCAST, BITMAP = 500_000, 1 << 26
#: Hashes of a line that are sorted first, about; it has ``LEAST`` distinct ones among them, or all are sorted.
PICKED = 48

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hashes(points: np.ndarray, length: int = SIGNED) -> np.ndarray:
    """A 32-bit hash, as 64-bit number, of the shingle that begins at each code point but the last ones."""
    n = max(0, len(points) - length + 1)
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h *= _STEP
        h += points[k : k + n]
    return mix(h) >> np.uint64(32)


def _picked(h: np.ndarray, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (line, hash) in order, the ``LEAST`` least of each line: hashes, and how many each line has."""
    both = np.unique((line.astype(np.uint64) << np.uint64(32)) | h)
    of = (both >> np.uint64(32)).astype(np.int64)
    place = np.arange(len(both)) - np.searchsorted(of, of)
    kept = place < LEAST
    return (both[kept] & np.uint64(0xFFFFFFFF)), np.bincount(of[kept], minlength=lines)


def _shingled(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of lines: how many shingles each line has, the hashes of all of them one line after another, and their lines."""
    for _, data, starts in runs(column):
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        heads = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        first = heads[starts]
        size = np.diff(np.append(first, len(points)))
        own = np.maximum(size - length + 1, 0)
        h = _hashes(points, length)
        at = np.repeat(first - np.cumsum(own) + own, own) + np.arange(own.sum())
        yield own, h[at], np.repeat(np.arange(len(own)), own)


def signatures(column: pa.Array) -> pa.Array:
    """The least hashes of each line of a string column without nulls, ascending."""
    flat, counts = [], []
    for own, h, line in _shingled(column, SIGNED):
        few = h < np.repeat(np.minimum(PICKED / np.maximum(own, 1), 1.0) * 2.0**32, own)
        least, n = _picked(h[few], line[few], len(own))
        short = (n < np.minimum(own, LEAST)) & (own > PICKED)  # many repeats: all hashes of these lines
        if short.any():
            again = short[line]
            more, m = _picked(h[again], line[again], len(own))
            rows = np.repeat(np.arange(len(own)), n)
            keep = ~short[rows]
            order = np.argsort(np.concatenate([rows[keep], np.repeat(np.arange(len(own)), m)]), kind="stable")
            least, n = np.concatenate([least[keep], more])[order], np.where(short, m, n)
        flat.append(least)
        counts.append(n)
    values = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
    offsets = np.append(0, np.cumsum(np.concatenate(counts))) if counts else np.zeros(1, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.uint32).view(np.int32)))


def _signed(lines: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and s: the signature of ``norm``; of lines that are equal (by ``id``) and come together, the first one's only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, first = np.unique(b.column(keep.index("id") + 1).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False), return_index=True)
            first = np.sort(first[which >= 0])
            at = np.full(b.num_rows, -1)
            at[first] = np.arange(len(first))
            s = signatures(b.column(0).take(pa.array(first)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], s.take(pa.array(at, mask=at < 0))], [*keep, "s"])

    rows = lines.select(F.coalesce("norm", F.lit("")).alias("norm"), *keep)
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep], "s array<int>"]))


def sketches(column: pa.Array) -> list[np.ndarray]:
    """Of each signature (none is empty) 256 bits in four numbers: a bit is set if an odd number of hashes fall on it."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    at = mix(column.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64)) >> np.uint64(56)
    word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
    if not len(sizes):
        return [np.zeros(0, np.int64)] * 4
    starts = np.append(0, np.cumsum(sizes)[:-1])
    return [np.bitwise_xor.reduceat(np.where(word == w, bit, 0), starts).view(np.int64) for w in range(4)]


SKETCH = ["k0", "k1", "k2", "k3"]
#: Of a line that is compared: characters where a shingle begins (no less than its distinct shingles), and 1024 bits, on which these fall.
FULL = ["places", *[f"b{i}" for i in range(16)]]


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, norm) with what ``FULL`` tells of the line."""
    for b in batches:
        n, bits = [], []
        for own, h, line in _shingled(b.column(1), SHINGLE):
            held = np.zeros((len(own), 1024), bool)
            held[line, (h >> np.uint64(22)).astype(np.int64)] = True
            n.append(np.maximum(own, 1))
            bits.append(np.packbits(held, axis=1).view(np.int64))
        n, bits = (np.concatenate(n), np.concatenate(bits)) if n else (np.zeros(0, np.int64), np.zeros((0, 16), np.int64))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n.astype(np.int64)), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(16)]], ["node", "norm", *FULL])


def _most(similarity: float, n: object) -> object:
    """Shingles that one of two similar lines has and the other has not, at most; no more bits differ, as each that differs tells of one such shingle. n: both lines' shingles."""
    return (1 - similarity) / (1 + similarity) * n + 0.01


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each node (node, id, s), with its sketch; rows come in order."""
    last = None
    for b in batches:
        node = b.column(0).to_numpy()
        new = np.append(True, node[1:] != node[:-1])[: len(node)]
        if len(node):
            new[0] = node[0] != last
            last = node[-1]
        one = b.filter(pa.array(new))
        yield pa.RecordBatch.from_arrays([*one.columns, *map(pa.array, sketches(one.column(2)))], ["node", "id", "s", *SKETCH])


def _banded(signs: DataFrame, part: int, parts: int) -> DataFrame:
    """(key, node, sketch): the bands of each signature whose first hash falls in this part.

    Numbers are exploded and each row hashes its own run, as Spark compiles that; a function over arrays is interpreted, hash by hash.
    """
    n = F.size("s")

    def numbers(run: int, low: int, high: int) -> Column:
        return F.when((n >= low) & (n <= high), F.sequence(F.lit(32 * run), 32 * run + n - run)).otherwise(F.array().cast("array<int>"))

    rows = signs.select("node", *SKETCH, "s", F.explode(F.concat(*[numbers(*r) for r in RUNS])).alias("k"))
    run, at = F.shiftright("k", 5), F.col("k").bitwiseAND(31)
    longest = max(r[0] for r in RUNS)
    own = rows.where(F.pmod(F.get("s", at), F.lit(parts)) == part) if parts > 1 else rows
    return own.select(F.xxhash64(*[F.when(run > i, F.get("s", at + i)) for i in range(longest)], run).alias("key"), "node", *SKETCH)


def _ranges(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of each row i and the rows j from ``low`` to before ``high``, about ``TOGETHER`` at once."""
    n = np.maximum(high - low, 0)
    upto = np.cumsum(n)
    at = 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOGETHER, "right")))
        i = np.repeat(np.arange(at, end), n[at:end])
        first = np.append(0, np.cumsum(n[at:end])[:-1])
        yield i, low[i] + np.arange(len(i)) - np.repeat(first, n[at:end])
        at = end


def _bits_apart(k: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the sketches (four columns) of rows i and j differ."""
    return np.bitwise_count(np.take(k, i, 0) ^ np.take(k, j, 0)).sum(1, dtype=np.int64)


def _near(key: np.ndarray, node: np.ndarray, k: np.ndarray, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of their keys: pairs of each row and the nearest of those before it in its bucket, and which rows have more that they may
    be like. Members meet in blocks, and all of them the bucket's first; ``split`` is the key of a bucket that has members elsewhere."""
    if not len(key):
        return np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
    rows = np.arange(len(key))
    new = np.append(True, key[1:] != key[:-1])
    first = np.maximum.accumulate(np.where(new, rows, 0))
    ends = np.append(np.nonzero(new)[0][1:], len(key))
    end = ends[np.cumsum(new) - 1]
    block = (rows - first) // BLOCK
    more = np.zeros(len(key), bool)
    pairs = []

    def look(i: np.ndarray, j: np.ndarray) -> None:
        d = _bits_apart(k, i, j)
        near = np.nonzero((d <= MOST_APART) & (node[i] != node[j]))[0]
        pairs.append((i[near], j[near], d[near]))

    for i, j in _ranges(rows + 1, np.minimum(end, first + (block + 1) * BLOCK)):
        look(i, j)
    late = rows[block > 0]
    look(first[late], late)
    i, j, d = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((i, d, j))
    i, j = i[order], j[order]
    best = np.append(True, j[1:] != j[:-1])[: len(j)]
    more[i[~best]] = more[j[~best]] = True
    more |= end - first > BLOCK
    if split is not None:
        more |= key == split
    return np.stack([i[best], j[best]]), np.nonzero(more)[0]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of bands in order of their keys: pairs to be compared (no key, a, b), and members of buckets in which there are more (key, a, null)."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        columns = [c.combine_chunks().to_numpy() for c in rows.columns]
        key, node, k = columns[0], columns[1], np.stack([c.view(np.uint64) for c in columns[2:]], 1)
        shared = np.zeros(len(key), bool)
        shared[1:] = key[1:] == key[:-1]
        shared[:-1] |= shared[1:]
        key, node, k = key[shared], node[shared], k[shared]
        near, more = _near(key, node, k, split)
        a, b = node[near[0]], node[near[1]]
        n = len(a)
        none = np.arange(n + len(more))
        out = [pa.array(np.append(np.zeros(n, np.int64), key[more]), mask=none < n), pa.array(np.append(np.minimum(a, b), node[more])), pa.array(np.append(np.maximum(a, b), np.zeros(len(more), np.int64)), mask=none >= n)]
        return pa.RecordBatch.from_arrays(out, ["key", "a", "b"])

    held: list[pa.RecordBatch] = []
    size, split = 0, None
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= CHUNK:
            rows = pa.Table.from_batches(held)
            key = rows.column(0).combine_chunks().to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield found(rows.slice(0, last))
            rest = rows.slice(last)
            if rest.num_rows >= CHUNK:  # a bucket of very many: its first member meets those that come later, too
                split = int(key[-1])
                yield found(rest)
                rest = rest.slice(0, 1)
            held, size = rest.combine_chunks().to_batches(), rest.num_rows
    if size:
        yield found(pa.Table.from_batches(held))


def _every(batches: Iterator[pa.RecordBatch], similarity: float = 0.0) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of different components in blocks (key, i, j, block, node, component and, if any, sketch and ``FULL``) that come in order."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        key, i, j, block, node, component, *k = [c.combine_chunks().to_numpy() for c in rows.columns]
        row = np.arange(len(key))
        new = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))[: len(key)]
        end = np.append(np.nonzero(new)[0][1:], len(key))[np.cumsum(new) - 1]
        turn = np.append(True, new[1:] | (block[1:] != block[:-1]))[: len(key)]
        after = np.append(np.nonzero(turn)[0][1:], len(key))[np.cumsum(turn) - 1]
        pairs = [np.zeros((2, 0), np.int64)]
        if k:
            sketch, n_of, bits = np.stack([c.view(np.uint64) for c in k[:4]], 1), k[4], np.stack([c.view(np.uint64) for c in k[5:]], 1)
        for x, y in _ranges(np.where(i == j, row + 1, after), np.where(block == i, end, 0)):
            apart = (component[x] != component[y]) & (node[x] != node[y])
            x, y = x[apart], y[apart]
            if k:
                near = _bits_apart(sketch, x, y) <= MOST_APART
                x, y = x[near], y[near]
                near = _bits_apart(bits, x, y) <= _most(similarity, n_of[x] + n_of[y])
                x, y = x[near], y[near]
            pairs.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]))
        a, b = np.concatenate(pairs, 1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= CHUNK:
            rows = pa.Table.from_batches(held).combine_chunks()
            key, i, j = (rows.column(c).to_numpy() for c in range(3))
            other = np.nonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))[0]
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield found(rows.slice(0, last))
            held, size = rows.slice(last).to_batches(), rows.num_rows - last
    if size:
        yield found(pa.Table.from_batches(held))


def shingle_set(line: str) -> set[str]:
    """All 5-character shingles; a shorter line is its own shingle."""
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def _sizes(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Sizes of the intersections and unions of two lines' shingle sets; neighbours often share a line."""
    out, last, known = [], None, None
    for x, y in zip(a, b, strict=True):
        if x != last:
            last, known = x, shingle_set(x)
        other = shingle_set(y)
        both = len(known & other)
        out.append((both, len(known) + len(other) - both))
    return pd.DataFrame(out, columns=["both", "either"]).astype("int64")


def similarities(a: pa.Array, b: pa.Array) -> pa.Array:
    """Similarity by signatures, pair by pair: the least hashes of both together are a sample of their union."""
    sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
    pair = [np.repeat(np.arange(len(n)), n).astype(np.uint64) << np.uint64(32) for n in sizes]
    # Each side is in order, so sorting is one merge; a hash of both stands twice in a row.
    both = np.sort(np.concatenate([p | x.flatten().to_numpy(zero_copy_only=False).view(np.uint32) for p, x in zip(pair, (a, b), strict=True)]), kind="stable")
    first = np.append(True, both[1:] != both[:-1])[: len(both)]
    twice = np.append(~first[1:], False)[: len(both)][first]
    of = (both[first] >> np.uint64(32)).astype(np.int64)
    least = np.arange(len(of)) - np.searchsorted(of, of) < LEAST
    total, shared = (np.bincount(of[m], minlength=len(a)) for m in (least, least & twice))
    return pa.array(shared / np.maximum(total, 1))


def _places(node: Column) -> list[Column]:
    """Two places of a node in the bitmap."""
    return [F.shiftrightunsigned(node, n).bitwiseAND(BITMAP - 1).cast("int") for n in (0, 32)]


class FuzzyLines:
    """Links between the lines of one table (row, doc_id, text), which has one row per document."""

    def __init__(self, spark: SparkSession, rows: DataFrame, scratch: Scratch, similarity: float = 0.8):
        self.spark, self.similarity, self.scratch = spark, similarity, scratch
        lines = rows.select("row", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "line"))
        # An exploded value is made once, however often it is asked for.
        lines = lines.select("row", "no", "doc_id", F.explode(F.array(normalised_line(F.col("line")))).alias("norm"))
        self.split = lines.select("row", "no", "doc_id", F.when(F.col("norm") != "", F.col("norm")).alias("norm")).withColumn("id", F.unhex(F.md5("norm")))
        # Texts are not stored; those of pairs that are compared are split off again.
        self.lines = scratch.keep(_signed(self.split, ["row", "no", "doc_id", "id"]), "lines", "zstd", dictionary=False)

    def _fitting(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose signatures allow a link, and how far apart these are."""
        side = lambda x: self.signs.select(F.col("node").alias(x), F.col("s").alias(f"s_{x}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b")
        alike = F.arrow_udf(similarities, "double")
        return met.select("a", "b", (1 - alike("s_a", "s_b")).alias("apart")).where(F.col("apart") <= 1 - COMMON * self.similarity / 0.8)

    def _confirm(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are links by all their shingles."""
        t = lambda x: self.texts.select(F.col("node").alias(x), F.col("norm").alias(f"t_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in FULL])
        apart = reduce(Column.__add__, [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in FULL[1:]])
        met = pairs.select("a", "b").join(t("b"), "b").join(t("a"), "a").where(apart <= _most(self.similarity, F.col("places_a") + F.col("places_b")))
        sizes = F.pandas_udf(_sizes, "both long, either long")
        found = met.select("a", "b", sizes("t_a", "t_b").alias("n")).where(F.col("n.both") >= F.lit(self.similarity) * F.col("n.either") - 1e-6)
        return self.scratch.keep(found.select("a", "b"), f"{name}-links")

    @staticmethod
    def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        of = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))
        known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return known.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select(*pairs.columns)

    def _labels(self, links: DataFrame, name: str) -> DataFrame:
        return connected_components(self.spark, links, self.scratch, name)

    def _signs(self) -> DataFrame:
        """(node, id, s, sketch): one row of each node that has a signature."""
        lines = self.lines.where("id is not null and size(s) > 0").select(F.xxhash64("id").alias("node"), "id", "s")
        dealt = lines.repartition("node").sortWithinPartitions("node", "id")
        return dealt.mapInArrow(_nodes, "node long, id binary, s array<int>, " + ", ".join(f"{c} long" for c in SKETCH))

    def labels(self) -> DataFrame:
        """(id, component) of the nodes that have links.

        Buckets deal with 64-bit hashes of the ids; should two ids have one hash, the larger takes no part
        in links, and its copies are found all the same.
        """
        keep = self.scratch.keep
        every = keep(self._signs(), "every-sign", dictionary=False)
        bands = every.agg(F.sum(F.size("s"))).first()[0] or 0
        parts = min(PASSES, 1 + bands // PASS_BANDS)
        met = []
        for part in range(parts):
            dealt = _banded(every, part, parts).repartition("key").sortWithinPartitions("key")
            met.append(keep(dealt.mapInArrow(_met, "key long, a long, b long"), f"met-{part}", dictionary=False))
        met = reduce(DataFrame.unionByName, met)
        first = keep(met.where("key is null").select("a", "b").distinct(), "first")
        members = keep(met.where("key is not null").select("key", F.col("a").alias("node")).distinct(), "members")
        nodes = first.select(F.col("a").alias("node")).union(first.select("b")).union(members.select("node")).distinct()
        self.signs = keep(every.join(nodes.hint("merge"), "node", "left_semi"), "signs", dictionary=False)
        for name in ("every-sign", *[f"met-{part}" for part in range(parts)]):
            self.scratch.remove(name)

        star = keep(self._fitting(first), "star")
        self._fetch(star.select(F.col("a").alias("node")).union(star.select("b")).union(members.select("node")).distinct())
        best = star.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("apart", "a"))).where("k = 1").drop("k")
        links = self._confirm(best, "best")
        found = self._labels(links, "best-labels")
        more = self._apart(star.join(best.select("a", "b"), ["a", "b"], "left_anti"), found)
        links = links.union(self._confirm(more, "star"))
        found = self._labels(links, "star-labels")

        # What still is apart in a bucket meets in all pairs.
        mixed = keep(self._mixed(members, found), "mixed")
        met = keep(self._fitting(self._every_pair(mixed.join(self.signs.select("node", *SKETCH), "node").join(self.texts.select("node", *FULL), "node"), self.similarity)), "rest")
        links = links.union(self._confirm(met, "rest"))
        found = self._labels(links, "labels")
        ids = self.signs.select(F.col("node").alias("id"), F.col("id").alias("line_id"))
        found = keep(found.join(ids, "id").select(F.col("line_id").alias("id"), "component"), "found")
        for name in ("first", "members", "signs", "texts", "star", "mixed", "rest"):
            self.scratch.remove(name)
        return found

    def _fetch(self, nodes: DataFrame) -> None:
        """texts: (node, norm, and what ``FULL`` tells) of the nodes."""
        ids = self.scratch.keep(self.signs.select("node", "id").join(nodes, "node", "left_semi"), "ids")
        lines = self.split.select("id", "norm")
        if ids.count() <= MOST_BROADCAST:
            ids = F.broadcast(ids)
        else:
            lines = lines.join(F.broadcast(self._bitmap(ids)), reduce(Column.__and__, [F.getbit(F.get("bits", F.shiftright(x, 6)), x.bitwiseAND(63).cast("int")) == 1 for x in _places(F.xxhash64("id"))]), "left_semi")
        one = lines.join(ids, "id").groupBy("id", "node").agg(F.first("norm").alias("norm")).select("node", "norm")
        self.texts = self.scratch.keep(one.mapInArrow(_full, "node long, norm string, " + ", ".join(f"{c} long" for c in FULL)), "texts", "zstd", dictionary=False)

    def _bitmap(self, ids: DataFrame) -> DataFrame:
        """One row (bits): a bitmap in which two places of each node are set."""
        at = ids.select(F.explode(F.array(*_places(F.col("node")))).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))).alias("bits")).toPandas()
        bits = np.zeros(BITMAP >> 6, np.int64)
        bits[words["word"].to_numpy()] = words["bits"].to_numpy()
        return self.spark.createDataFrame([(bits.tolist(),)], "bits array<long>")

    def _mixed(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """(key, node, component, size) of the buckets which hold several components."""
        shown = members.join(labels.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        mixed = shown.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"))
        return shown.join(mixed.where(F.col("x") != F.col("y")).select("key", "size"), "key")

    @staticmethod
    def _every_pair(mixed: DataFrame, similarity: float = 0.0) -> DataFrame:
        """Pairs (a, b) of different components in buckets of any size; of those with sketches, the ones that these allow.

        Members are dealt into blocks of about ``BLOCK``, and each two blocks of a bucket meet apart from the others, so no task
        holds a bucket. The work grows with the square of a bucket that holds many components.
        """
        blocks = F.ceil(F.col("size") / BLOCK)
        own = mixed.withColumn("n", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")))
        own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        own = own.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", *[c for c in (*SKETCH, *FULL) if c in mixed.columns])
        dealt = own.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block")
        return dealt.mapInArrow(lambda batches: _every(batches, similarity), "a long, b long").distinct()

    def removed(self) -> DataFrame:
        """(row, removed, keepers): the numbers of the lines that go, ascending, of each row that loses any, and
        the (doc_id, line) that each of them was linked to and that stays."""
        labels = self.labels()
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "no")
        held = self.lines.where("id is not null")
        nodes = held.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n"))
        joined = nodes.join(labels, "id", "left").where("n > 1 or component is not null")
        joined = joined.select("id", "first", F.struct("component", F.when(F.col("component").isNull(), F.col("id"))).alias("component"))
        joined = self.scratch.keep(joined, "nodes-found")
        keepers = joined.groupBy("component").agg(F.min("first").alias("keeper"))
        fate = joined.join(keepers, "component").select("id", "keeper")
        gone = held.select("id", "row", "no").join(fate, "id").where("row <> keeper.row or no <> keeper.no")
        gone = gone.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("no", F.struct("keeper.doc_id", F.col("keeper.no").alias("line")).alias("keeper")))).alias("gone"))
        return gone.select("row", F.col("gone.no").alias("removed"), F.col("gone.keeper").alias("keepers"))


def line_report(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (numbers of the lines that go, from 0), keepers
    (for each of them the doc_id and number of the line that stays)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    run = FuzzyLines(spark, rows, Scratch(spark, "fuzzy-lines"), **params)
    counts = run.lines.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_lines"))
    removed = run.removed()
    none = lambda c: F.coalesce(c, F.array().cast(removed.schema[c].dataType)).alias(c)
    return counts.join(removed, "row", "left").select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), none("removed"), none("keepers"))


def dedup_lines(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """``docs`` with the texts that are left; a document that loses all its lines goes. n_chars is counted anew."""
    names = docs.columns
    scratch = Scratch(spark, "fuzzy-lines")
    kept = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")), "docs", "zstd")
    run = FuzzyLines(spark, kept.select("row", F.col(f"doc.`{doc_id}`").alias("doc_id"), F.col(f"doc.`{text}`").alias("text")), scratch, **params)
    marked = kept.join(run.removed().select("row", "removed"), "row", "left")
    left = F.filter(F.split(F.col(f"doc.`{text}`"), "\n"), lambda x, i: ~F.array_contains("removed", i))
    marked = marked.select("doc", F.when(F.col("removed").isNotNull(), left).alias("left")).where("left is null or size(left) > 0")
    new = F.when(F.col("left").isNull(), F.col(f"doc.`{text}`")).otherwise(F.array_join("left", "\n"))
    out = marked.select(*[new.alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in names])
    return out.withColumn("n_chars", F.char_length(f"`{text}`").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
