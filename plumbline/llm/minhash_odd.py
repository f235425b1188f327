"""Near-duplicate documents by MinHash, odd sketches and exact confirmation.

A text's set is its distinct 5-word shingles as 64-bit hashes. Of each set 120 MinHash samples are drawn:
24 bands of five samples give candidates (a pair at the threshold of 0.85 is missed by all bands once in a
million), and all samples are folded into a 512-bit odd sketch, a bitmap of parities. The population count
of two sketches' XOR tells how many samples differ, which is precise for high similarities, so candidates
are dropped when it puts them ``SLACK`` (six standard deviations) below the threshold. What is left is
confirmed on full sets.

No bucket is ever expanded into pairs at first: equal sets are one node; then every member of a bucket meets
the bucket's least member only. Components of the links found so far tell which buckets still hold several
components, and only there do members of different components meet, in blocks of bounded size and without
any cap, so no link between different texts that share a bucket is lost.

Edge cases: a null or empty text or one without words has an empty set and is linked with nothing; a text of
fewer than five words has its whole sequence as one shingle; repeated rows and null ids are rows of their
own; columns of any name ride along; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.graph import connected_components
from plumbline.plans.scratch import Scratch

SHINGLE = 5
BANDS, BAND_ROWS = 24, 5
SAMPLES = BANDS * BAND_ROWS
SKETCH_WORDS = 8
SLACK = 0.2
#: Bytes of text whose words are hashed at once, and rows of a bucket that meet in one task.
CHUNK_BYTES, BLOCK_ROWS = 1 << 19, 1024
#: Bytes of full sets that such rows have, about; a block has one row at least.
BLOCK_BYTES = 1 << 25

_rng = np.random.default_rng(20240501)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = _rng.integers(1, 1 << 64, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _rng.integers(0, 1 << 64, SAMPLES, np.uint64)
_SCALE = _rng.integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and how many words each text (they begin at ``starts``) has."""
    data = _LOWER[data]
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = starts[(starts > 0) & (starts < len(data))]
    begins[inner] = solid[inner]
    at = np.nonzero(begins)[0]
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    kept = data[solid]
    first = np.cumsum(solid)[at] - 1
    sizes = np.diff(np.append(first, len(kept)))
    within = np.arange(len(kept)) - np.repeat(first, sizes)
    powers = np.cumprod(np.full(sizes.max(), _STEP))
    sums = np.add.reduceat(_BYTE[kept] * powers[within], first)
    counts = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    return _mix(sums + sizes.astype(np.uint64) * _STEP), counts


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in runs of a bounded size; one longer text comes alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > CHUNK_BYTES:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def _pieces(text: bytes) -> list[bytes]:
    """A long text in pieces that end between words."""
    out, at = [], 0
    while len(text) - at > CHUNK_BYTES:
        end = at + CHUNK_BYTES
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def shingle_sets(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: sorted distinct shingles one text after another, and how many each text has."""
    for run in _chunks(texts):
        if len(run) == 1:
            parts = [_word_hashes(np.frombuffer(p, np.uint8), np.zeros(1, np.int64)) for p in _pieces(run[0])]
            words, counts = np.concatenate([p[0] for p in parts]), np.array([sum(int(p[1][0]) for p in parts)])
        else:
            starts = np.cumsum([0, *map(len, run[:-1])])
            words, counts = _word_hashes(np.frombuffer(b"".join(run), np.uint8), starts)
        ends = np.cumsum(counts)
        whole = np.maximum(counts - SHINGLE + 1, (counts > 0).astype(np.int64))
        padded = np.append(words, np.zeros(SHINGLE, np.uint64))
        n = len(words)
        total = np.zeros(n, np.uint64)
        text_of = np.repeat(np.arange(len(counts)), counts)
        left = ends[text_of] - np.arange(n)  # words from here to the text's end
        for k in range(SHINGLE):
            total += np.where(left > k, padded[k : k + n], np.uint64(0)) * _PLACE[k]
        total = _mix(total + np.minimum(left, SHINGLE).astype(np.uint64) * _STEP)
        begin = ends - counts
        taken = np.arange(n) - begin[text_of] < whole[text_of]
        values, owner = total[taken], text_of[taken]
        bounds = np.cumsum([0, *whole])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            values[a:b].sort()
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        yield values[fresh], np.bincount(owner[fresh], minlength=len(counts))


def sketch(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketches) of the sets; rows of empty sets are zero."""
    held = np.nonzero(sizes)[0]
    bands, odd = np.zeros((len(sizes), BANDS), np.int64), np.zeros((len(sizes), SKETCH_WORDS), np.int64)
    if not len(held):
        return bands, odd
    starts = np.cumsum([0, *sizes[held][:-1]])
    least = np.empty((len(held), SAMPLES), np.uint64)
    for j in range(SAMPLES):
        least[:, j] = np.minimum.reduceat((values ^ _TURN[j]) * _SCALE[j], starts)
    salted = _mix(least + np.arange(1, SAMPLES + 1, dtype=np.uint64) * _STEP)
    keys = np.zeros((len(held), BANDS), np.uint64)
    for k in range(BAND_ROWS):
        keys = _mix(keys + salted[:, k::BAND_ROWS][:, :BANDS])
    bands[held] = keys.view(np.int64)
    bit = salted % np.uint64(64 * SKETCH_WORDS)
    words = np.zeros((len(held), SKETCH_WORDS), np.uint64)
    np.bitwise_xor.at(words, (np.arange(len(held))[:, None], (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    odd[held] = words.view(np.int64)
    return bands, odd


def most_differing_bits(similarity: float) -> int:
    """The XOR count at which a pair of sketches is estimated to have this similarity, rounded up."""
    bits = 64 * SKETCH_WORDS
    return math.ceil(bits / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / bits)))


def _text_bytes(column: pa.Array) -> list[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


SKETCHES = "row long, n long, k1 long, k2 long, odd array<long>, bands array<long>"


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SKETCHES.split(", ")]
    lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))
    for batch in batches:
        at = 0
        for values, sizes in shingle_sets(_text_bytes(batch.column(1))):
            bands, odd = sketch(values, sizes)
            ends = np.append(0, np.cumsum(sizes))
            k1, k2 = (np.append(0, np.cumsum(x))[ends].astype(np.uint64) for x in (values, _mix(values + _STEP)))
            keys = [np.diff(k).view(np.int64) for k in (k1, k2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), pa.array(sizes, pa.int64()), *map(pa.array, keys), lists(odd), lists(bands)], names=names)
            at += len(sizes)


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for values, sizes in shingle_sets(_text_bytes(batch.column(1))):
            ends = np.append(0, np.cumsum(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)])], names=["row", "values"])
            at += len(sizes)


def common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sizes of the intersections of sorted distinct sets, as bytes."""
    sets = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True))
    return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets], dtype="int64")


def _differing(a: Column, b: Column) -> Column:
    count = F.lit(0)
    for k in range(SKETCH_WORDS):
        count = count + F.bit_count(a[k].bitwiseXOR(b[k]))
    return count


class NearDuplicates:
    """Links of one table; ``components`` is the result."""

    def __init__(self, spark: SparkSession, docs: DataFrame, text: str = "text", percent: int = 85):
        self.spark, self.percent = spark, percent
        self.scratch = Scratch(spark, "near-duplicates")
        keep = self.scratch.keep
        self.docs = keep(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "docs")
        self.raw = self.docs.select("row", F.col(f"doc.`{text}`").alias("raw"))
        self.sketches = keep(self.raw.mapInArrow(_sketch_batches, SKETCHES), "sketches")
        self.most = most_differing_bits(percent / 100 - SLACK)

    def _candidates(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and odd sketches allow a link, with the count of differing bits."""
        s = lambda x: self.sketches.select(F.col("row").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}"))
        both = pairs.join(s("a"), "a").join(s("b"), "b")
        sized = both.where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        return sized.select("a", "b", "n_a", "n_b", _differing(F.col("odd_a"), F.col("odd_b")).alias("bits")).where(F.col("bits") <= self.most)

    def _confirm(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are links by their full sets."""
        pairs = self.scratch.keep(pairs, f"{name}-pairs")
        rows = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        sets = self._sets(rows, f"{name}-sets")
        s = lambda x: sets.select(F.col("row").alias(x), F.col("values").alias(f"v_{x}"))
        met = pairs.join(s("a"), "a").join(s("b"), "b").withColumn("both", F.pandas_udf(common, "long")("v_a", "v_b"))
        found = self.scratch.keep(met.where(100 * F.col("both") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"), f"{name}-links")
        self.scratch.remove(f"{name}-sets")
        return found

    def _sets(self, rows: DataFrame, name: str) -> DataFrame:
        return self.scratch.keep(self.raw.join(rows, "row", "left_semi").select("row", "raw").mapInArrow(_set_batches, "row long, values binary"), name)

    def _labels(self, links: DataFrame, name: str) -> DataFrame:
        return connected_components(self.spark, links, self.scratch, name)

    def components(self) -> DataFrame:
        """(row, node, component): node is the least row with the same set, component the least row linked to it; empty sets are left out."""
        scratch = self.scratch
        held = self.sketches.where("n > 0")
        # Written, so that a set that very many rows have is split over tasks where it is joined.
        nodes = scratch.keep(held.groupBy("k1", "k2", "n").agg(F.min("row").alias("node")), "nodes")
        members = scratch.keep(held.select("row", "k1", "k2", "n").join(nodes, ["k1", "k2", "n"]).select("row", "node"), "members")
        own = held.join(members.where("row = node").select("row"), "row", "left_semi")
        entries = own.select("row", F.posexplode("bands").alias("band", "key"))
        buckets = entries.groupBy("band", "key").agg(F.min("row").alias("pivot"), F.count("*").alias("size")).where("size > 1")
        entries = scratch.keep(entries.join(buckets, ["band", "key"]).select("row", "band", "key", "pivot"), "entries")

        star = entries.where("row <> pivot").select(F.col("pivot").alias("a"), F.col("row").alias("b")).distinct()
        star = scratch.keep(self._candidates(star), "star")
        best = star.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy("bits", "a"))).where("k = 1").drop("k")
        links = self._confirm(best, "best")
        labels = self._labels(links, "best-labels")
        rest = self._apart(star.join(best.select("a", "b"), ["a", "b"], "left_anti"), labels)
        links = links.union(self._confirm(rest, "star"))
        labels = self._labels(links, "star-labels")
        links = links.union(self._residual(entries, labels))
        labels = self._labels(links, "labels").select(F.col("id").alias("node"), "component")
        return members.join(labels, "node", "left").select("row", "node", F.coalesce("component", "node").alias("component"))

    @staticmethod
    def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs whose ends are not yet in one component."""
        of = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))
        known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return known.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select(*pairs.columns)

    def _residual(self, entries: DataFrame, labels: DataFrame) -> DataFrame:
        """Links between components that buckets still hold side by side.

        Buckets with several components tie their rows into clusters; a cluster is dealt into blocks, and
        each pair of blocks meets in one task, which confirms pairs of different components on full sets,
        the most similar sketches first, and returns only links that join two components there.
        """
        keep = self.scratch.keep
        label = labels.select(F.col("id").alias("row"), "component")
        shown = entries.join(label, "row", "left").select("row", "band", "key", F.coalesce("component", "row").alias("component"))
        mixed = shown.groupBy("band", "key").agg(F.min("row").alias("pivot"), F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"))
        mixed = mixed.where("x <> y and size > 2").select("band", "key", "pivot")
        shown = keep(shown.join(mixed, ["band", "key"]).select("row", "component", "pivot").distinct(), "mixed")
        clusters = self._labels(shown.select(F.col("pivot").alias("a"), F.col("row").alias("b")), "clusters")
        rows = keep(clusters.select(F.col("id").alias("row"), F.col("component").alias("cluster")).join(shown.select("row", "component").distinct(), "row"), "clustered")
        weighed = rows.join(self.sketches.select("row", "n"), "row")
        sizes = weighed.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum(8 * F.col("n")) / BLOCK_BYTES)).cast("int").alias("blocks"))
        dealt = rows.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.select("row", "component", "cluster", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        sets = self._sets(rows.select("row"), "mixed-sets")
        met = met.join(self.sketches.select("row", "n", "odd"), "row").join(sets, "row")
        most, percent = self.most, self.percent

        def meet(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("row")
            low, high = int(group["low"].iat[0]), int(group["high"].iat[0])
            a, b = group[group["block"] == low], group[group["block"] == high]
            odd_a, odd_b = (np.stack(x["odd"]).view(np.uint64) if len(x) else np.zeros((0, SKETCH_WORDS), np.uint64) for x in (a, b))
            n_a, n_b, c_a, c_b, row_a, row_b = (x[c].to_numpy() for c in ("n", "component", "row") for x in (a, b))
            found: list[np.ndarray] = []
            for i in range(len(a)):
                fit = (c_b != c_a[i]) & (100 * np.minimum(n_b, n_a[i]) >= percent * np.maximum(n_b, n_a[i]))
                if low == high:
                    fit &= row_b > row_a[i]
                at = np.nonzero(fit)[0]
                bits = np.bitwise_count(odd_b[at] ^ odd_a[i]).sum(1, dtype=np.int64)
                near = bits <= most
                found.append(np.stack([bits[near], np.full(near.sum(), i), at[near]], 1))
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := root.get(x, x)) != x:
                    root[x] = root.get(up, up)
                    x = up
                return x

            sets_a, sets_b = ([np.frombuffer(v, np.uint64) for v in x["values"]] for x in (a, b))
            pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            out = []
            for _, i, j in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
                x, y = find(int(c_a[i])), find(int(c_b[j]))
                if x == y:
                    continue
                both = len(np.intersect1d(sets_a[i], sets_b[j], assume_unique=True))
                if 100 * both >= percent * (int(n_a[i]) + int(n_b[j]) - both):
                    root[max(x, y)] = min(x, y)
                    out.append((int(row_a[i]), int(row_b[j])))
            return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

        return keep(met.groupBy("cluster", "low", "high").applyInPandas(meet, "a long, b long"), "rest-links")


def components(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: row, doc (all its columns), n_shingles, component_id (least id reachable), stays (one row of each component)."""
    run = NearDuplicates(spark, docs, text, percent)
    of = run.components()
    key = F.col(f"doc.`{doc_id}`")
    ids = run.docs.select("row", key.alias("id"))
    sizes = run.sketches.select("row", F.col("n").alias("n_shingles"))
    known = ids.join(sizes, "row").join(of.select("row", "component"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    known = run.scratch.keep(known, "known")
    least = known.groupBy("component").agg(F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    least = run.scratch.keep(least, "least")
    out = known.join(least, "component").select("row", "id", "n_shingles", "component_id", (F.col("row") == F.col("first.row")).alias("stays"))
    return out.join(run.docs.select("row", "doc"), "row")


def dedup(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One document of each component; those without words all stay."""
    return components(spark, docs, doc_id, text, percent).where("stays").select("doc.*")
