"""Elias-Fano code of a non-decreasing sequence, with select by sampled positions.

A value of a sequence of n values below u is split into its low ``l = log2(u / n)`` bits, stored as
they are, and its high part, stored in unary in a bit vector of about 2 n bits. The position of the
i-th one bit gives the i-th high part, so ``select(i)`` needs no table of 64-bit offsets: one sample
for every ``STRIDE`` ones and a scan of a few bytes find it. Space: at most n (2 + l) bits and the
samples.
"""

from __future__ import annotations

import struct

import numpy as np

STRIDE = 256
HEAD = "<QBQI"


def pack_low(values: np.ndarray, bits: int) -> bytes:
    if not bits:
        return b""
    shifts = np.arange(bits, dtype=np.uint64)
    return np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """``values``: non-decreasing, unsigned. The empty sequence is allowed."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    if n and (values[1:] < values[:-1]).any():
        raise ValueError("values must not decrease")
    top = int(values[-1]) if n else 0
    low = max(0, (max(1, (top + 1) // max(1, n))).bit_length() - 1)
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros((top >> low) + n + 1, np.uint8)
    high[places] = 1
    high_bytes = np.packbits(high, bitorder="little").tobytes()
    samples = places[::STRIDE].astype("<u4").tobytes()
    return struct.pack(HEAD, n, low, len(high_bytes), len(samples)) + high_bytes + samples + pack_low(values, low)


class EliasFano:
    """Reads what ``encode`` wrote."""

    def __init__(self, data: bytes):
        self.n, self.low, n_high, n_samples = struct.unpack_from(HEAD, data)
        at = struct.calcsize(HEAD)
        self.high = np.frombuffer(data, np.uint8, n_high, at)
        self.samples = np.frombuffer(data, "<u4", n_samples // 4, at + n_high)
        self.lows = np.frombuffer(data, np.uint8, (self.n * self.low + 7) // 8, at + n_high + n_samples)

    def __len__(self) -> int:
        return self.n

    def low_parts(self, first: int, count: int) -> np.ndarray:
        if not self.low:
            return np.zeros(count, np.uint64)
        start, end = first * self.low, (first + count) * self.low
        bits = np.unpackbits(self.lows[start // 8 : (end + 7) // 8], bitorder="little")[start % 8 :][: end - start]
        weights = np.uint64(1) << np.arange(self.low, dtype=np.uint64)
        return (bits.reshape(count, self.low).astype(np.uint64) * weights).sum(1, dtype=np.uint64)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.uint64)
        return (high << np.uint64(self.low)) | self.low_parts(0, self.n)

    def select(self, i: int) -> int:
        """The i-th value, from its sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // STRIDE]), i % STRIDE
        byte = at // 8
        word = int(self.high[byte]) & (0xFF << at % 8)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i) << self.low | int(self.low_parts(i, 1)[0])
