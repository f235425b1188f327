"""How filters of documents overlap: what each removes, alone and behind others, in every order.

Texts are scanned in Arrow's buffers (``words.py``): byte classes and prefix sums give words, capitals, symbols and
code points; a document's word hashes are sorted, and neighbours of equal hash are compared byte by byte, so distinct
words are exact. Each document becomes a mask with one bit a failed filter. Equal texts are found by SHA-256 over the
whole table; counts by (text, part, labels, document) come before anything is joined, so a text with very many copies
is one row a part when it meets its smallest document id. What is left is one row of counts per part and mask (at most 32
masks), from which all orders follow.

Edge cases: a null text counts as empty; a null part is the empty string; rows with the same document id have none
before each other, so they are no copies of one another; a null id is never smaller than another one and has none
smaller; a document with several label rows is good or toxic if one of them says so; columns of any name ride along
unread; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import runs, words

FILTERS = "ABCDE"
#: The limits of the filters (fixed values of the method).
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
COPY = 1 << FILTERS.index("E")
#: Bytes of repeated words that are compared at once.
COMPARED = 1 << 22

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_FOLLOWS = (np.arange(256) & 0xC0) == 0x80


def counts_of(classes: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many bytes of a class each text has, by prefix sums."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(classes[data], out=sums[1:])
    return np.diff(sums[np.append(starts, len(data))])


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words at a and b (of one size each) have the same bytes."""
    out = np.zeros(len(a), bool)
    upto, first = np.cumsum(size), 0
    while first < len(a):
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + COMPARED, "right")))
        n = size[first:last]
        at = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(at, n)
        equal = data[np.repeat(a[first:last], n) + within] == data[np.repeat(b[first:last], n) + within]
        out[first:last] = np.logical_and.reduceat(equal, at)
        first = last
    return out


def distinct_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of each text of a run."""
    w = words(data, starts)
    n = np.bincount(w.text, minlength=len(starts))
    order = np.lexsort((w.hash, w.text))
    h, t = w.hash[order], w.text[order]
    twin = np.zeros(len(h), bool)
    twin[1:] = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
    j = np.nonzero(twin)[0]
    a, b = order[j - 1], order[j]
    size = w.end[b] - w.begin[b]
    same = w.end[a] - w.begin[a] == size
    same[same] = _same(data, w.begin[a[same]], w.begin[b[same]], size[same])
    distinct = n - np.bincount(t[j], minlength=len(starts))
    for k in np.unique(t[j[~same]]):  # a collision: this text's words are told apart by their bytes
        own = np.nonzero(w.text == k)[0]
        distinct[k] = len({data[w.begin[i] : w.end[i]].tobytes() for i in own})
    return n, distinct


def masks(column: pa.Array) -> np.ndarray:
    """The failed filters of each text that depend on the text alone, as bits A to D."""
    out = np.zeros(len(column), np.int32)
    for first, data, starts in runs(column):
        n, distinct = distinct_words(data, starts)
        points = np.diff(np.append(starts, len(data))) - counts_of(_FOLLOWS, data, starts)
        failed = (n < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * counts_of(_CAPITAL, data, starts) > CAPITALS_PERCENT * points, counts_of(_SYMBOL, data, starts) > 0)
        out[first : first + len(starts)] = sum(f.astype(np.int32) << i for i, f in enumerate(failed))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(masks(b.column(0)))], [*b.schema.names[1:], "mask"])


def scanned(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """doc_id, part, digest and mask (bits A to D) of each row."""
    c = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(c.alias("text"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(c, 256)).alias("digest"))
    return rows.mapInArrow(_scan, "doc_id long, part string, digest binary, mask int")


def histogram(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of all filters that they fail."""
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(said("quality"), said("toxic"))
    # One row a document and text first: copies of rows are counted, and no text's rows are brought together yet.
    rows = scanned(docs, doc_id, text, part).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    rows = rows.join(marks, "doc_id", "left").select("doc_id", "digest", "part", "mask", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")])
    # Then one row a text, part and labels: its rows, its least id, and how many rows have that id or none.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n"))
    groups = rows.groupBy("digest", "part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    first = groups.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    met = groups.join(first, "digest")
    alone = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), alone.alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - alone).alias("n")))
    each = met.select("part", "quality", "toxic", F.explode(both).alias("m")).select("part", "m.mask", "m.n", "quality", "toxic")
    counted = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), counted("quality").alias("good"), counted("toxic").alias("bad"))


def _orders() -> tuple[list[str], list[int], dict[str, np.ndarray]]:
    """All orders with their steps, and for each of these which masks (columns) count in each figure."""
    names, steps, rows = [], [], {k: [] for k in ("kept", "removed", "redundant", "unique_fails", "filter")}
    every = np.arange(1 << len(FILTERS))
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            fails, gone = (every >> f & 1) == 1, (every & before) != 0
            before |= 1 << f
            names.append("".join(FILTERS[i] for i in order))
            steps.append(k + 1)
            rows["kept"].append((every & before) == 0)
            rows["removed"].append(fails & ~gone)
            rows["redundant"].append(fails & gone)
            rows["unique_fails"].append(every == 1 << f)
            rows["filter"].append(f)
    return names, steps, {k: np.array(v, np.int64) for k, v in rows.items()}


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: documents kept and removed there, redundant and unique failures,
    good and toxic documents lost there, and the filter's removals over all orders."""
    h = histogram(docs, labels, doc_id, text, part)
    size = 1 << len(FILTERS)
    filled: Column = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "bad"))))
    counts = lambda c: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i)[c], F.lit(0))).alias(c)
    by_part = h.groupBy("part").agg(filled.alias("m")).select("part", counts("n"), counts("good"), counts("bad"))

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, steps, on = _orders()
        for frame in frames:
            for r in frame.itertuples():
                n, good, bad = (np.asarray(x, np.int64) for x in (r.n, r.good, r.bad))
                removed = on["removed"] @ n
                shapley = np.zeros(len(FILTERS), np.int64)
                np.add.at(shapley, on["filter"], removed)
                yield pd.DataFrame({
                    "part": r.part, "filter_order": names, "step": np.array(steps, np.int32), "kept": on["kept"] @ n, "removed": removed, "redundant": on["redundant"] @ n,
                    "unique_fails": on["unique_fails"] @ n, "good_lost": on["removed"] @ good, "toxic_lost": on["removed"] @ bad, "shapley": shapley[on["filter"]],
                })

    return by_part.mapInPandas(reduce, AUDIT)
