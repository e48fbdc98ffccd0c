"""Words of Arrow text columns as NumPy arrays, read straight from the Arrow buffers.

A word is a run of bytes outside ``\\x20\\x09-\\x0D`` (the pattern ``[^\\x20\\x09-\\x0D]+`` on
UTF-8). Nulls and empty texts have no words. Tasks work through a batch in slices of a few
megabytes, so memory does not follow the batch; a longer text is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
LONG_WORD = 4096
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: between runs of letters: ASCII other than letters; longer characters count as letters
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD1342543DE82EF95


class Words(NamedTuple):
    """Words of some rows: ``data`` bytes, byte ``start`` and ``end`` of each word, its ``row``,
    and per row the number of its first word (``first``, one entry more than rows)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64's published constants)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string or binary column; nulls are empty."""
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.type != large:
        column = column.cast(large)
    if column.null_count:
        column = column.fill_null(b"" if large == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each; a larger row stands alone."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = to


def split(data: np.ndarray, bounds: np.ndarray, apart: np.ndarray = _SPACE) -> Words:
    """The words of consecutive rows; ``apart`` says for each byte if it stands between words."""
    n = len(data)
    rows = len(bounds) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(rows + 1, np.int64))
    inside = ~apart[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    cut[0] = cut[n] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside
    ends = ends & cut[1:] | ends & np.concatenate([~inside[1:], [True]])
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, bounds)
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(data, start, np.flatnonzero(ends) + 1, row, first)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one little-endian integer; zeros follow the last."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(padded) - 7,), "<u8", padded.tobytes(), strides=(1,))


def hashes(words: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (``lower``: A-Z as a-z)."""
    out = np.zeros(len(words.start), np.uint64)
    if not len(out):
        return out
    data = _LOWER[words.data] if lower else words.data
    eight = eights(data)
    size = words.end - words.start
    out += mixed(size.astype(np.uint64) * _ODD)
    left = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(left):
        part = eight[words.start[left] + at] & _KEEP[np.minimum(size[left] - at, 8)]
        out[left] = mixed(out[left] ^ part * _ODD)
        at += 8
        left = left[size[left] > at]
    for k in np.flatnonzero(size > LONG_WORD):
        digest = hashlib.blake2b(data[words.start[k] : words.end[k]].tobytes(), digest_size=8)
        out[k] = int.from_bytes(digest.digest(), "little")
    return out


def windows(items: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash of every run of ``width`` consecutive items, by its first; shorter by ``width - 1``.

    The order counts. Built from runs of doubling length, so it takes a few passes.
    """
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step, run, length, done, have = _STEP, items ^ np.uint64(salt), 1, None, 0
    while True:
        if width >> (length.bit_length() - 1) & 1:
            if done is None:
                done, have = run, length
            else:  # append this run behind what is there
                m = len(items) - have - length + 1
                done, have = done[:m] * np.uint64(pow(step, length, 1 << 64)) + run[have : have + m], have + length
        if 2 * length > width:
            break
        m = len(items) - 2 * length + 1
        run = mixed(run[:m] * np.uint64(pow(step, length, 1 << 64)) + run[length : length + m])
        length *= 2
    return mixed(done[:n] + np.uint64(salt * 2 + 1 & (1 << 64) - 1))


def whole_windows(words: Words, width: int) -> np.ndarray:
    """Which of ``windows`` lie within one row."""
    n = max(0, len(words.row) - width + 1)
    return words.row[:n] == words.row[len(words.row) - n :] if n else np.zeros(0, bool)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
