"""Elias-Fano code of ascending numbers: about 2 + log2(universe / n) bits each, with random access.

Each number is split at ``low`` bits.  Low parts lie packed side by side; high parts are a bit string
in which the i-th one stands at (number >> low) + i.  The place of every 256th one is kept, so
``select(i)`` reads one sample and a few bytes.
"""

from __future__ import annotations

import struct

import numpy as np

HEADER = "<4sB3xQQ"
MAGIC = b"EFB1"
EVERY = 256
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(numbers: np.ndarray, universe: int) -> bytes:
    """``numbers`` ascend (repeats allowed) and none exceeds ``universe``."""
    x = np.asarray(numbers, np.int64)
    n = len(x)
    low = max(int(universe // n).bit_length() - 1, 0) if n else 0
    bits = ((x[:, None] >> np.arange(low)) & 1).astype(np.uint8) if low else np.zeros((n, 0), np.uint8)
    places = (x >> low) + np.arange(n)
    high = np.zeros(n + (universe >> low) + 1, np.uint8)
    high[places] = 1
    samples = places[::EVERY].astype("<u4" if len(high) < 1 << 32 else "<u8")
    return b"".join([struct.pack(HEADER, MAGIC, low, n, universe), np.packbits(bits.ravel(), bitorder="little").tobytes(),
                     np.packbits(high, bitorder="little").tobytes(), samples.tobytes()])


class EliasFano:
    def __init__(self, data: bytes):
        magic, self.low, self.n, self.universe = struct.unpack_from(HEADER, data)
        if magic != MAGIC:
            raise ValueError("not an Elias-Fano file")
        low_bytes, high_bits = -(-self.n * self.low // 8), self.n + (self.universe >> self.low) + 1
        raw = np.frombuffer(data, np.uint8)
        a = struct.calcsize(HEADER)
        self.lows, self.high = raw[a:a + low_bytes], raw[a + low_bytes:a + low_bytes + -(-high_bits // 8)]
        self.samples = np.frombuffer(data, "<u4" if high_bits < 1 << 32 else "<u8", -(-self.n // EVERY),
                                     a + low_bytes + len(self.high))

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        first = i * self.low
        part = int.from_bytes(self.lows[first // 8:(first + self.low + 7) // 8].tobytes(), "little")
        return (part >> (first % 8)) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """The i-th number, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // EVERY])
        rest = i % EVERY                                    # ones still to pass behind the sampled one
        if rest:
            byte, shift = divmod(place + 1, 8)
            first = int(self.high[byte]) >> shift << shift if byte < len(self.high) else 0
            while ONES[first] < rest:
                rest -= int(ONES[first])
                byte += 1
                first = int(self.high[byte])
            for bit in range(8):
                rest -= first >> bit & 1
                if rest == 0:
                    place = byte * 8 + bit
                    break
        return (place - i << self.low) | self._low(i)

    def block(self, first: int, count: int) -> np.ndarray:
        """Numbers ``first`` to ``first + count - 1``: only the bits between two samples are looked at."""
        count = max(min(count, self.n - first), 0)
        if not count:
            return np.zeros(0, np.int64)
        sample = first // EVERY
        byte = int(self.samples[sample]) // 8
        last = -(-(first + count) // EVERY)              # sample behind the block
        stop = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[byte:stop], bitorder="little")) + byte * 8
        skip = int(np.searchsorted(places, int(self.samples[sample]))) + first - sample * EVERY
        number = np.arange(first, first + count)
        high = places[skip:skip + count] - number
        if not self.low:
            return high
        start, end = first * self.low, (first + count) * self.low
        bits = np.unpackbits(self.lows[start // 8:-(-end // 8)], bitorder="little")[start % 8:start % 8 + end - start]
        return (high << self.low) | (bits.reshape(count, self.low).astype(np.int64) << np.arange(self.low)).sum(axis=1)

    def all(self) -> np.ndarray:
        """All numbers at once."""
        return self.block(0, self.n)
