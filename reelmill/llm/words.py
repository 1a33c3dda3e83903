"""Vectorised word splitting and hashing over the bytes of Arrow string batches.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]``; A-Z count as lower case. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
BLOCK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_VALUE = _VALUE[LOWER]
_powers = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray, lower: bool) -> np.ndarray:
    """Sums from which span_hash() gives the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER_VALUE if lower else _VALUE)[data] * powers(len(data))[0], out=out[1:], dtype=np.uint64)
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, which depend on their bytes alone."""
    down = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its rows+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Block(NamedTuple):
    first: int  #: the row of the batch at which the block begins
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[Block]:
    """The column in runs of whole rows with at most limit bytes, or one row."""
    data, at = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Block(i, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray  #: of each word
    per_row: np.ndarray  #: words in each row

    @property
    def first(self) -> np.ndarray:
        """rows+1 offsets into the words."""
        out = np.zeros(len(self.per_row) + 1, np.int64)
        np.cumsum(self.per_row, out=out[1:])
        return out


def split(block: Block, between: np.ndarray = SPACE) -> Words:
    """between: which of the 256 bytes stand between words."""
    data, at = block.data, block.offsets
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(block.rows, np.int64))
    gap = between[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1] | edge[1:n]
    last[:-1] &= gap[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    row = np.searchsorted(at, starts, "right") - 1
    return Words(starts, np.flatnonzero(last) + 1, row, np.bincount(row, minlength=block.rows))


def hashes(block: Block, words: Words) -> np.ndarray:
    """A 64-bit hash of each lower-cased word."""
    return span_hash(prefix_hash(block.data, lower=True), words.starts, words.ends)
