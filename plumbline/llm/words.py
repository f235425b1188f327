"""Words of many texts at once: byte classes, prefix sums and hashes over Arrow's buffers.

A word is a maximal run of bytes other than U+0020 and U+0009 to U+000D. Its hash is a polynomial over its bytes, read
off as a difference of prefix sums, so no byte is looked at word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes whose prefix sums are held at once, and bytes of texts that are scanned together (a longer text comes alone).
PIECE, RUN = 1 << 19, 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_VALUE = np.random.default_rng(20251103).integers(1, 1 << 64, 256, np.uint64)
_VALUE_LOWER = _VALUE[LOWER]


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_STEP), _powers(_BACK)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers over all bits; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of a run of texts: where each begins and ends in the data, its hash, and its text (from 0, ascending)."""

    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray


def words(data: np.ndarray, starts: np.ndarray, lower: bool = False) -> Words:
    """The words of the texts that begin at ``starts`` (ascending, the first 0) in ``data``.

    The data is taken in pieces of one size, whatever the texts, so a long text or a long word needs no more memory
    than its own bytes and words.
    """
    value = _VALUE_LOWER if lower else _VALUE
    begins, ends, at_begin, at_end = [], [], [], []
    total, before, scale, back = 0, False, 1, 1
    for base in range(0, len(data), PIECE):
        piece = data[base : base + PIECE]
        solid = ~SPACE[piece]
        previous = np.empty_like(solid)
        previous[0], previous[1:] = before, solid[:-1]
        first = starts[np.searchsorted(starts, base) : np.searchsorted(starts, base + len(piece))] - base
        fresh = np.zeros(len(piece), bool)
        fresh[first] = True
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(value[piece] * _UP[: len(piece)], out=sums[1:])
        sums *= np.uint64(scale)
        sums += np.uint64(total)
        b = np.nonzero(solid & (~previous | fresh))[0]
        e = np.nonzero(previous & (~solid | fresh))[0]
        begins.append(b + base)
        ends.append(e + base)
        at_begin.append((sums[b], _DOWN[b] * np.uint64(back)))
        at_end.append(sums[e])
        total, before = int(sums[-1]), bool(solid[-1])
        scale, back = scale * int(_UP[len(piece)]) % (1 << 64), back * int(_DOWN[len(piece)]) % (1 << 64)
    if before:
        ends.append(np.array([len(data)]))
        at_end.append(np.array([total], np.uint64))
    none = np.zeros(0, np.int64)
    begin, end = np.concatenate([none, *begins]), np.concatenate([none, *ends])
    low, down = (np.concatenate([np.zeros(0, np.uint64), *[x[i] for x in at_begin]]) for i in (0, 1))
    high = np.concatenate([np.zeros(0, np.uint64), *at_end])
    hashed = mix((high - low) * down + (end - begin).astype(np.uint64) * np.uint64(_STEP))
    return Words(begin, end, hashed, np.searchsorted(starts, begin, "right") - 1)


def runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts of a string column without nulls: the first text's number, the bytes of the run, and where each text begins."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + RUN, "right")) - 1)
        # Empty texts at the end begin where the data ends; many empty texts still make a run of at most a million.
        last = min(last, len(column), first + 1_000_000)
        yield first, whole[at[first] : at[last]], at[first:last] - at[first]
        first = last
