"""Directly addressable codes: token ids split into chunks, level by level, with rank directories.

Level 0 holds the lowest chunk of every id and one continuation bit for it; level k holds
the next chunk of those ids whose bit at level k-1 is set. The place of an id at the next
level is the rank of its bit: a directory counts the set bits before each block, so any id
is read without decoding its neighbours.

A stored sequence, little endian: ``DAC1``, u32 levels, u32 chunk bits; for each level u32
entries, then its chunks (one byte each), its bitmap, and its directory (u32 for each block
of 512 bits).
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, CHUNK, BLOCK = b"DAC1", 8, 512


def encode(ids: np.ndarray) -> bytes:
    rest = ids.astype(np.uint64)
    levels = []
    while True:
        low, rest = (rest & np.uint64((1 << CHUNK) - 1)).astype(np.uint8), rest >> np.uint64(CHUNK)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // BLOCK) * BLOCK, np.bool_)
        padded[: len(more)] = more
        counts = padded.reshape(-1, BLOCK).sum(axis=1)
        directory = (np.cumsum(counts) - counts).astype("<u4")
        levels.append(struct.pack("<I", len(low)) + low.tobytes() + bits.tobytes() + directory.tobytes())
        rest = rest[more]
        if not len(rest):
            return MAGIC + struct.pack("<II", len(levels), CHUNK) + b"".join(levels)


class Sequence:
    """Random access to the ids of one stored sequence."""

    def __init__(self, stored: bytes):
        if stored[:4] != MAGIC:
            raise ValueError("not a stored sequence")
        count, self.chunk = struct.unpack_from("<II", stored, 4)
        at, self.levels = 12, []
        for _ in range(count):
            (n,) = struct.unpack_from("<I", stored, at)
            at += 4
            chunks = np.frombuffer(stored, np.uint8, n, at)
            bits = np.frombuffer(stored, np.uint8, -(-n // 8), at + n)
            directory = np.frombuffer(stored, "<u4", -(-n // BLOCK), at + n + len(bits))
            at += n + len(bits) + 4 * len(directory)
            self.levels.append((chunks, bits, directory))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (self.chunk * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            i = int(directory[block]) + int(np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK].sum())
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop-1, reading only their own places at each level."""
        out = np.zeros(stop - start, np.uint64)
        places = np.arange(stop - start)
        for k, (chunks, bits, directory) in enumerate(self.levels):
            if start >= stop:
                break
            out[places] |= chunks[start:stop].astype(np.uint64) << np.uint64(self.chunk * k)
            first = start // BLOCK * BLOCK
            flags = np.unpackbits(bits[first // 8 : (stop + 7) // 8], bitorder="little")[: stop - first].astype(bool)
            own = flags[start - first :]
            begin = int(directory[start // BLOCK]) + int(flags[: start - first].sum())
            places, start, stop = places[own], begin, begin + int(own.sum())
        return out
