"""Elias-Fano code of a non-decreasing sequence of non-negative integers, as bytes.

A value's low `width` bits are stored as they are; its high part h, of value i, is the bit h + i of a bit vector. That takes about
2 + log2(range / count) bits a value. A sample of every 512th one's place makes `select`, and so any single value, a look into one short run.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 512
_HEAD = struct.Struct("<QQBxxxxxxx")  # count, largest value, width of the low part


def _pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def encode(values: np.ndarray) -> bytes:
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // n).bit_length() - 1) if n and top >= n else 0
    low = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
    high[ones] = 1
    parts = [np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u8")]
    return _HEAD.pack(n, top, width) + b"".join(_pad(x.tobytes()) for x in parts)


class EliasFano:
    """Reads a code made by `encode`; `size` is the number of bytes it takes from the start of `raw`."""

    def __init__(self, raw: bytes | memoryview):
        self.n, self.top, self.width = _HEAD.unpack_from(raw)
        at = _HEAD.size
        takes = lambda bits: (bits + 63) // 64 * 8
        low, high = takes(self.n * self.width), takes((self.top >> self.width) + self.n if self.n else 0)
        self._low = np.frombuffer(raw, np.uint8, low, at)
        self._high = np.frombuffer(raw, np.uint8, high, at + low)
        samples = -(-self.n // SAMPLE)
        self._samples = np.frombuffer(raw, "<u8", samples, at + low + high)
        self.size = at + low + high + 8 * samples

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Place of the i-th one (from 0) in the high bits."""
        at = int(self._samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        while True:  # the run after a sample holds at most SAMPLE ones
            bits = np.flatnonzero(np.unpackbits(self._high[byte : byte + 256], bitorder="little"))
            bits = bits[bits + 8 * byte >= at]
            if left < len(bits):
                return int(bits[left]) + 8 * byte
            left, byte = left - len(bits), byte + 256
            at = 8 * byte

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        bit = i * self.width
        raw = int.from_bytes(self._low[bit // 8 : (bit + self.width + 7) // 8].tobytes(), "little")
        low = raw >> bit % 8 & (1 << self.width) - 1
        return (self.select(i) - i) << self.width | low

    def values(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        bits = np.unpackbits(self._low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width).astype(np.uint64)
        return high | (bits << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
