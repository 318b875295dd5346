"""Exact repeats of word passages across documents, found through fixed-block anchors.

With windows of W words, every window holds one whole block of B = (W+1)/2 words that starts
at a multiple of B in its document. Such blocks are the index; every document probes it with
the hash of its B words at every position. Only places that hit, and the blocks that were
hit by a greater document, are extended: all windows around them are compared by a 96-bit
hash with the least document that holds the same window. The windows found to repeat,
joined where they touch, are the maximal exact repeats.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashMemo, documents, materialize, partitions, prepare, release, runs
from .packed import deal, unpack_all

#: Probes of one bucket, and characters of text of one bucket: both stay put as the input grows.
BUCKET_PROBES, BUCKET_TEXT = 1 << 18, 4 << 20
#: Probes that a task gathers before it deals them out.
GATHER = 1 << 21
_PROBE = [np.uint32, np.uint32, np.int64, np.bool_, np.bool_]  # hash, place, key, no id, indexed block
_MARK = [np.int64, np.uint32]  # key, place
_WINDOW = [np.uint32, np.uint64, np.uint32, np.uint32, np.int64, np.bool_]  # hash, more hash, place, which text, key, no id
_COVER = [np.int64, np.uint32, np.uint32]  # key, place, which text
_GOLDEN, _LAST = 0x9E3779B97F4A7C15, np.iinfo(np.int64).max
_WORDS = HashMemo(lambda w: xxhash.xxh3_64_intdigest(w, 7))
_ROWS = pa.schema([("bucket", pa.int64()), ("packed", pa.binary())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _grams(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """64-bit hash of every run of ``size`` words, from the words' own hashes."""
    total = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        total += words[k : k + len(total)] * np.uint64(((2 * (k + 64 * seed) + 1) * _GOLDEN | 1) & 0xFFFFFFFFFFFFFFFF)
    return _mix(total)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def _key(doc_id: int | None, text: bytes) -> int:
    """Documents without an id are told apart by their text; they come after all others."""
    return doc_id if doc_id is not None else xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _doc_buckets(keys: np.ndarray, count: int) -> np.ndarray:
    return _mix(keys.view(np.uint64) * np.uint64(_GOLDEN)) % np.uint64(count)


def _high(hashes: np.ndarray, count: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) % np.uint64(count)


def _batches(dealt: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    buckets, blobs, held = [], [], 0
    for bucket, blob in dealt:
        buckets.append(bucket)
        blobs.append(blob)
        held += len(blob)
        if held > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], schema=_ROWS)
            buckets, blobs, held = [], [], 0
    yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], schema=_ROWS)


def _probe(window: int, buckets: int):
    """Of each document: the hash of its words at every place, each once, and whether it is an indexed block."""
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            grams, *rest = (np.concatenate(c) for c in zip(*held, strict=True))
            yield from _batches(deal(_high(grams, buckets), [grams.astype(np.uint32), *rest], buckets))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                words = raw.split()
                if len(words) < window:
                    continue
                every = _grams(_hashes(words), block, 1)
                grams, first = np.unique(every, return_index=True)
                indexed = np.zeros(len(grams), np.bool_)
                indexed[np.searchsorted(grams, every[::block])] = doc_id is not None
                held.append((grams, first.astype(np.uint32), np.full(len(grams), _key(doc_id, raw)), np.full(len(grams), doc_id is None), indexed))
                size += len(grams)
                if size >= GATHER:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _each_bucket(rows: DataFrame, function: Callable[[pa.Table], list[np.ndarray]], doc_buckets: int) -> DataFrame:
    """Apply ``function`` to each bucket; what it finds (keys first) is gathered over a task's buckets, then dealt to the documents' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in itertools.chain(runs(batches, ["bucket"]), [None]):
            if table is not None:
                held.append(function(table))
                size += len(held[-1][0])
            if held and (table is None or size >= GATHER):
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                yield from _batches(deal(_doc_buckets(columns[0], doc_buckets), columns, doc_buckets))
                held, size = [], 0

    return rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long, packed binary")


def _meet(rows: pa.Table) -> list[np.ndarray]:
    """In a bucket of hashes: marks the probes that a smaller document indexes, and the blocks that a greater one hits."""
    hashes, place, key, no_id, indexed = unpack_all(rows.column("packed").to_pylist(), _PROBE)
    order = np.argsort(hashes)
    hashes, place, key, indexed = hashes[order], place[order], key[order], indexed[order]
    rank = np.where(no_id[order], _LAST, key)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(hashes)) + 1])
    group = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(hashes))))
    least = np.minimum.reduceat(np.where(indexed, key, _LAST), cuts)
    greatest = np.maximum.reduceat(rank, cuts)
    marked = (least[group] < rank) | (indexed & (greatest[group] > key))
    return [key[marked], place[marked]]


def _texts(doc_buckets: int):
    """Every document with the bucket of its key, its text compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            keys = np.array([_key(i, t) for i, t in zip(ids, raw, strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_doc_buckets(keys, doc_buckets).astype(np.int64)), pa.array(ids, pa.int64()), pa.array(keys), pa.array([shrink.compress(t) for t in raw], pa.binary())], ["bucket", "doc_id", "key", "text"]
            )

    return run


def _unfold(texts: pa.Table, keys: np.ndarray) -> Iterator[tuple]:
    """Of each row of a bucket: doc_id, key, text, which of the key's texts it is, and the span of its key in sorted ``keys``."""
    expand = zstandard.ZstdDecompressor()
    own, raw = texts.column("key").to_pylist(), [expand.decompress(t) for t in texts.column("text").to_pylist()]
    several: dict[int, list[bytes]] = {}
    for k, t in zip(own, raw, strict=True):
        several.setdefault(k, []).append(t)
    several = {k: sorted(set(v)) for k, v in several.items() if len(v) > 1}
    low, high = np.searchsorted(keys, own, "left").tolist(), np.searchsorted(keys, own, "right").tolist()
    for doc_id, key, text, a, b in zip(texts.column("doc_id").to_pylist(), own, raw, low, high, strict=True):
        yield doc_id, key, text, several[key].index(text) if key in several else 0, a, b


def _by_key(table: pa.Table, types: list) -> list[np.ndarray]:
    columns = unpack_all(table.column("packed").to_pylist(), types)
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _extend(window: int, buckets: int):
    """Of marked documents: a hash for each window that holds a marked block, each once a document."""
    block = (window + 1) // 2

    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        keys, places = _by_key(marks, _MARK)
        held = []
        for doc_id, key, text, nth, a, b in _unfold(texts, keys):
            if a == b:
                continue
            words = _hashes(text.split())
            starts = len(words) - window + 1
            grams = _grams(words, block, 1)
            at = places[a:b]
            at = np.flatnonzero(np.isin(grams, grams[at[at < len(grams)]]))
            near = np.zeros(len(words) + 1, np.int64)
            np.add.at(near, np.maximum(at - (window - block), 0), 1)
            np.add.at(near, at + 1, -1)
            near = np.flatnonzero(np.cumsum(near)[:max(starts, 0)] > 0)
            hashes, first = np.unique(_grams(words, window, 2)[near], return_index=True)
            near = near[first]
            n = len(near)
            held.append((hashes, _grams(words, window, 3)[near], near.astype(np.uint32), np.full(n, nth, np.uint32), np.full(n, key), np.full(n, doc_id is None)))
        if not held:
            return _ROWS.empty_table()
        hashes, *rest = (np.concatenate(c) for c in zip(*held, strict=True))
        return pa.Table.from_batches(_batches(deal(_high(hashes, buckets), [hashes.astype(np.uint32), *rest], buckets)), _ROWS)

    return run


def _repeat(rows: pa.Table) -> list[np.ndarray]:
    """In a bucket of windows: those that a smaller document holds too."""
    hashes, more, place, nth, key, no_id = unpack_all(rows.column("packed").to_pylist(), _WINDOW)
    order = np.lexsort((hashes, more))
    hashes, more, place, nth, key, no_id = (c[order] for c in (hashes, more, place, nth, key, no_id))
    rank = np.where(no_id, _LAST, key)
    cuts = np.concatenate([[0], np.flatnonzero((np.diff(hashes) != 0) | (np.diff(more) != 0)) + 1])
    least = np.repeat(np.minimum.reduceat(rank, cuts), np.diff(np.append(cuts, len(rank))))
    found = least < rank
    return [key[found], place[found], nth[found]]


_RESULT = "doc_id long, n_words long, n_removed long, repeats array<struct<start:long,end:long>>, kept string"


def _cover(window: int):
    """Of each document: the maximal repeats that its repeated windows form, and what is left without them."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("repeats", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])

    def run(texts: pa.Table, covers: pa.Table) -> pa.Table:
        keys, places, which = _by_key(covers, _COVER)
        out = []
        for doc_id, _, text, nth, a, b in _unfold(texts, keys):
            words = text.split()
            at = places[a:b][which[a:b] == nth]
            spans = []
            if len(at):
                hashes = _grams(_hashes(words), window, 2)
                starts = np.flatnonzero(np.isin(hashes, hashes[at]))
                cuts = np.flatnonzero(np.diff(starts) > window)
                spans = list(zip(starts[np.append(0, cuts + 1)].tolist(), (starts[np.append(cuts, len(starts) - 1)] + window).tolist(), strict=True))
            kept, last = [], 0
            for start, end in spans:
                kept += words[last:start]
                last = end
            kept += words[last:]
            out.append({"doc_id": doc_id, "n_words": len(words), "n_removed": len(words) - len(kept), "repeats": [{"start": s, "end": e} for s, e in spans], "kept": b" ".join(kept).decode()})
        return pa.Table.from_pylist(out, kind)

    return run


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """Remove each word covered by a window that also starts in a document with a smaller doc_id.

    Returns per row doc_id, n_words, n_removed, repeats (the maximal repeated spans, as word
    places with exclusive ends) and kept (the other words, joined by one blank). Windows are
    judged on the input. Null and empty texts have no words. Rows without doc_id come after
    all others and are no source for one another; rows that share a doc_id are none for each
    other either, and each is judged by its own text. An empty table gives an empty result.
    """
    if window % 2 == 0 or window < 3:
        raise ValueError("the window must be odd and at least 3 words")
    spark = docs.sparkSession
    prepare(spark)
    docs = documents(docs)
    characters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(partitions(spark), characters // (6 * BUCKET_PROBES))
    doc_buckets = max(partitions(spark), characters // BUCKET_TEXT)
    rows, texts = "bucket long, packed binary", "bucket long, doc_id long, key long, text binary"

    probes = docs.mapInArrow(_probe(window, buckets), rows)
    marks = materialize(_each_bucket(probes, _meet, doc_buckets), "marks")
    del probes
    release(spark)
    by_bucket = docs.mapInArrow(_texts(doc_buckets), texts).groupBy("bucket")
    windows = by_bucket.cogroup(marks.groupBy("bucket")).applyInArrow(_extend(window, buckets), rows)
    covers = materialize(_each_bucket(windows, _repeat, doc_buckets), "covers")
    del windows, by_bucket
    release(spark)
    by_bucket = docs.mapInArrow(_texts(doc_buckets), texts).groupBy("bucket")
    return by_bucket.cogroup(covers.groupBy("bucket")).applyInArrow(_cover(window), _RESULT)
