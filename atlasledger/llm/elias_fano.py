"""Elias-Fano code of a sequence that never falls, with select.

Of ``n`` numbers below ``u``, the low ``log2(u / n)`` bits of each are stored as they are and the high
bits as one set bit each in a string of at most ``3 n`` bits: about ``2 + log2(u / n)`` bits a number.
``select`` finds the i-th set bit from 32-bit samples of every ``SAMPLE``-th one, so there is no table
of offsets.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQB")


def encoded(values: np.ndarray) -> bytes:
    """The code of non-negative values that never fall."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    if n and bool((values[1:] < values[:-1]).any()):
        raise ValueError("values must not fall")
    low = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
    bits = (values[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    if len(high) >= 1 << 32:
        raise ValueError("too many values for 32-bit samples; write smaller files")
    return (
        _HEAD.pack(n, top, low)
        + ones[::SAMPLE].astype("<u4").tobytes()
        + np.packbits(bits.reshape(-1), bitorder="little").tobytes()
        + np.packbits(high, bitorder="little").tobytes()
    )


class EliasFano:
    """A code read from bytes; nothing is decoded before it is asked for."""

    def __init__(self, code: bytes) -> None:
        self.size, self.top, self._low = _HEAD.unpack_from(code)
        at = _HEAD.size
        count = -(-self.size // SAMPLE)
        self._samples = np.frombuffer(code, "<u4", count, at)
        at += 4 * count
        count = (self.size * self._low + 7) // 8
        self._lows = np.frombuffer(code, np.uint8, count, at)
        self._highs = np.frombuffer(code, np.uint8, offset=at + count)

    def __len__(self) -> int:
        return self.size

    def select(self, start: int, stop: int) -> np.ndarray:
        """Values ``start`` to ``stop`` (excluded), at the cost of those and one sample's stretch."""
        stop = min(stop, self.size)
        if start >= stop:
            return np.zeros(0, np.uint64)
        begin = int(self._samples[start // SAMPLE])
        skip = start % SAMPLE
        last = (stop - 1) // SAMPLE + 1
        end = int(self._samples[last]) if last < len(self._samples) else 8 * len(self._highs)
        part = self._highs[begin // 8 : end // 8 + 1]
        ones = np.flatnonzero(np.unpackbits(part, bitorder="little")) + begin // 8 * 8
        ones = ones[ones >= begin][skip : skip + stop - start]
        high = (ones - np.arange(start, stop)).astype(np.uint64)
        if not self._low:
            return high
        first, count = start * self._low, (stop - start) * self._low
        part = self._lows[first // 8 : (first + count + 7) // 8]
        bits = np.unpackbits(part, bitorder="little")[first % 8 :][:count].reshape(-1, self._low)
        low = (bits.astype(np.uint64) << np.arange(self._low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return high << np.uint64(self._low) | low

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.size:
            raise IndexError(k)
        return int(self.select(k, k + 1)[0])
