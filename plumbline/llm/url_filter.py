"""URL filter over a sorted digest array.

The rules' keys are hashed with 64-bit xxhash and sorted; the array, the verdicts and the rules' full
strings go into one file, which executors fetch once and memory-map. A batch of URLs is expanded into
candidate keys (host suffix + path prefix), hashed, and looked up by vectorised binary search; every hit
is confirmed against the stored full string, so equal digests of different strings do no harm.

The file's size is checked against ``MAX_INDEX_BYTES`` before it is sent to executors.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits no rule, and gets the
default verdict. Repeated rows are judged each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.scratch import Scratch

#: Executors hold one mapped copy of the index each; a longer rule list is refused, not cut.
MAX_INDEX_BYTES = 2 << 30
MAGIC = b"PLURLIX1"
SCHEMA = "rule string, verdict string"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_index(rules: Iterable[tuple[str, str, str]], digest=xxhash.xxh64_intdigest) -> bytes:
    """(host, path, verdict) rules as one file: header, sorted digests, offsets, verdicts, strings.

    Of rules for the same host and path the last one counts.
    """
    table = {(host, path): verdict for host, path, verdict in rules}
    if bad := [v for v in table.values() if v not in ("allow", "block")]:
        raise ValueError(f"verdicts are allow or block, not {bad[0]!r}")
    rows = sorted((digest((h + p).encode()), len(h.encode()), (h + p).encode(), v == "block") for (h, p), v in table.items())
    keys = np.array([r[0] for r in rows], np.uint64)
    ends = np.cumsum([0] + [len(r[2]) for r in rows], dtype=np.int64)
    hosts = np.array([r[1] for r in rows], np.int64)
    block = np.array([r[3] for r in rows], np.int64)
    paths = sorted({len(p) for _, p in table})
    head = np.array([len(rows), len(paths), *paths], np.int64)
    out = MAGIC + b"".join(a.tobytes() for a in (head, keys, ends, hosts, block)) + b"".join(r[2] for r in rows)
    if len(out) > MAX_INDEX_BYTES:
        raise ValueError(f"the rule index has {len(out)} bytes; at most {MAX_INDEX_BYTES} go to executors")
    return out


class DigestArray:
    """A memory-mapped index; ``find`` probes many keys at once."""

    def __init__(self, file: str, digest=xxhash.xxh64_intdigest):
        raw = np.memmap(file, np.uint8, mode="r")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError(f"{file} is no URL index")
        n, n_paths = (int(x) for x in raw[8:24].view(np.int64))
        self.path_lengths = [int(x) for x in raw[24 : 24 + 8 * n_paths].view(np.int64)]
        at = 24 + 8 * n_paths
        cut = lambda k, kind: raw[at + 8 * k[0] : at + 8 * k[1]].view(kind)
        self.keys = cut((0, n), np.uint64)
        self.ends = cut((n, 2 * n + 1), np.int64)
        self.hosts = cut((2 * n + 1, 3 * n + 1), np.int64)
        self.block = cut((3 * n + 1, 4 * n + 1), np.int64)
        self.text = raw[at + 8 * (4 * n + 1) :]
        self.digest = digest

    def string(self, row: int) -> bytes:
        return self.text[self.ends[row] : self.ends[row + 1]].tobytes()

    def find(self, keys: list[tuple[bytes, int]]) -> np.ndarray:
        """Row of each (host + path, length of the host), or -1; equal digests are told apart by the strings."""
        out = np.full(len(keys), -1, np.int64)
        if not len(keys) or not len(self.keys):
            return out
        probes = np.fromiter((self.digest(k) for k, _ in keys), np.uint64, len(keys))
        low = np.searchsorted(self.keys, probes, "left")
        high = np.searchsorted(self.keys, probes, "right")
        for i in np.nonzero(high > low)[0]:
            for row in range(low[i], high[i]):
                if self.hosts[row] == keys[i][1] and self.string(row) == keys[i][0]:
                    out[i] = row
                    break
        return out


def candidates(host: str, path: str, path_lengths: list[int]) -> list[tuple[bytes, int]]:
    """Keys of all rules that could fit, longest first, then the longer host."""
    labels = host.split(".")
    tails = [".".join(labels[k:]) for k in range(len(labels))] if host else []
    found = [(t, path[:n]) for t in tails for n in path_lengths if n <= len(path)]
    found.sort(key=lambda x: (len(x[0]) + len(x[1]), len(x[0])), reverse=True)
    return [((t + p).encode(), len(t.encode())) for t, p in found]


def judge(index: DigestArray, hosts: Iterable[str], paths: Iterable[str], default: str) -> pd.DataFrame:
    """The longest fitting rule of each URL and its verdict."""
    own: dict[tuple[bytes, int], int] = {}
    spans, asked = [], []
    for host, path in zip(hosts, paths, strict=True):
        keys = candidates(host, path, index.path_lengths)
        spans.append([own.setdefault(k, len(own)) for k in keys])
    asked = list(own)
    rows = index.find(asked)
    rules, verdicts = [], []
    for span in spans:
        row = next((rows[k] for k in span if rows[k] >= 0), -1)
        rules.append(index.string(row).decode() if row >= 0 else None)
        verdicts.append(("block" if index.block[row] else "allow") if row >= 0 else default)
    return pd.DataFrame({"rule": pd.Series(rules, dtype=object), "verdict": verdicts})


def filter_urls(spark: SparkSession, df: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict of each row's URL (columns of these names are replaced)."""
    data = build_index(rules)
    name = f"urls-{uuid.uuid4().hex}.idx"
    spark.sparkContext.addFile(Scratch(spark, "url-index").put_bytes(name, data))
    loaded: dict[str, DigestArray] = {}

    @F.pandas_udf(SCHEMA)
    def match(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        if name not in loaded:
            loaded[name] = DigestArray(SparkFiles.get(name))
        for hosts, paths in pairs:
            yield judge(loaded[name], hosts, paths, default)

    judged = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    kept = [c for c in judged.columns if c not in ("rule", "verdict")]
    return judged.select(*[F.col(f"`{c}`") for c in kept], match("host", "path").alias("__m")).select(
        *[F.col(f"`{c}`") for c in kept], F.col("__m.rule").alias("rule"), F.col("__m.verdict").alias("verdict")
    )
