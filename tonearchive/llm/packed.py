"""Columns of numbers packed into one binary value: what large shuffles of short records carry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

_COMPRESS, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(columns: list[np.ndarray]) -> bytes:
    """Byte planes of equally long columns, one after the other, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return _COMPRESS.compress(b"".join(planes))


def unpack(value: bytes, types: list) -> list[np.ndarray]:
    raw = np.frombuffer(_EXPAND.decompress(value), np.uint8)
    widths = [np.dtype(t).itemsize for t in types]
    rows, at, out = len(raw) // sum(widths), 0, []
    for t, w in zip(types, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + rows * w].reshape(w, rows).T).view(t).ravel())
        at += rows * w
    return out


def unpack_all(values: list[bytes], types: list) -> list[np.ndarray]:
    parts = [unpack(v, types) for v in values]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, t) for t in types]


def deal(buckets: np.ndarray, columns: list[np.ndarray], count: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed columns of its rows) for every bucket that has rows; ``count`` buckets in all."""
    narrow = np.uint16 if count <= 1 << 16 else np.uint32
    order = np.argsort(buckets.astype(narrow), kind="stable")
    sorted_buckets = buckets[order]
    columns = [c[order] for c in columns]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(sorted_buckets)) + 1, [len(order)]]).tolist() if len(order) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(sorted_buckets[a]), pack([c[a:b] for c in columns])
