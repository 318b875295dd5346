"""What the operators of this folder share: work tables, bounded Arrow batches, memo of chunks."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import itertools
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that the contracts call white space: blank, and tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that very long rows cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def work_dir(spark: SparkSession) -> str:
    """The shared folder for work tables: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster
    without it is an error, as a machine-local folder would not be seen by others.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = getattr(work_dir, "own", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        work_dir.own = shared
    return shared.rstrip("/")


class _Noting(threading.local):
    """Lists that note the work tables that this thread makes while they are open."""

    def __init__(self) -> None:
        self.lists: list[list[str]] = []


_noting = _Noting()


@contextlib.contextmanager
def noting_tables(paths: list[str]) -> Iterator[None]:
    """Adds the paths of the work tables made meanwhile to ``paths``."""
    _noting.lists.append(paths)
    try:
        yield
    finally:
        _noting.lists = [x for x in _noting.lists if x is not paths]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove work tables that nothing reads any more, and forget them."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a work table into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/work-{name}-{uuid.uuid4().hex}"
    for paths in _noting.lists:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], to: str, name: str) -> DataFrame:
    """``to``: the place of each row in the order, from 0. Rows are dealt by ranges and numbered where they lie; only the ranges' counts meet."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_id"))
    parts = materialize(parts.withColumn("_part", F.shiftright("_id", 33)), name)
    counts = parts.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    offsets = counts.select("_part", before.alias("_before"))
    return parts.join(F.broadcast(offsets), "_part").withColumn(to, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_id", "_before")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_cache: dict = {}


def worker_cache(name: str, make: Callable[[], object] = object) -> object:
    """The one large cache that this Python worker keeps; asking for another, or for one of nothing, lets it go."""
    if name not in _cache:
        _cache.clear()
        _cache[name] = make()
    return _cache[name]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other systems have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving freed memory back when its rows are done: a worker that waits, as JVM steps run, holds little."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return wrapped


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_batches(df: DataFrame, function: Callable[[dict[str, list]], Iterable[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """``mapInArrow`` that hands each batch over as a dict of Python lists."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)})

    return df.mapInArrow(lean(run), schema)


def lower_words(text: str) -> list[bytes]:
    """Words of the ASCII-lower-cased text, as UTF-8: bytes split at blank, tab to carriage return."""
    return text.encode().lower().split()


class HashMemo(dict):
    """Word -> 64-bit hash, remembering the words met first up to a limit (only a cache)."""

    def __init__(self, function: Callable[[bytes], int], limit: int = 300_000):
        self.function, self.limit = function, limit

    def __missing__(self, word: bytes) -> int:
        value = self.function(word)
        if len(self) < self.limit:
            self[word] = value
        return value


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lengths[i]-1 of all i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class ChunkMemo:
    """Chunk -> ids. ``missing`` encodes a list of unseen chunks to (flat ids, counts).

    Chunks met first are remembered, up to a limit; later unseen ones are encoded each time.
    """

    def __init__(self, missing: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = 300_000):
        self.missing, self.limit, self.index = missing, limit, {}
        self.flat = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)

    def encode(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all chunks and the number of ids of each chunk."""
        n = len(chunks)
        get = self.index.get
        at = np.fromiter(map(get, chunks, itertools.repeat(-1)), np.int64, n)
        flat, starts, counts = self.flat, self.starts, self.counts
        unseen = np.flatnonzero(at < 0)
        if len(unseen):
            fresh: dict = {}
            known = len(starts)
            for i in unseen.tolist():
                at[i] = known + fresh.setdefault(chunks[i], len(fresh))
            new_flat, new_counts = self.missing(list(fresh))
            new_starts = len(flat) + np.cumsum(new_counts) - new_counts
            flat = np.concatenate([flat, new_flat.astype(np.int32)])
            starts = np.concatenate([starts, new_starts])
            counts = np.concatenate([counts, new_counts])
            take = min(len(fresh), self.limit - known)
            if take > 0:
                self.index.update((c, known + k) for c, k in itertools.islice(fresh.items(), take))
                self.starts, self.counts = starts[: known + take], counts[: known + take]
                self.flat = flat[: self.starts[-1] + self.counts[-1]]
        lengths = counts[at]
        return flat[ragged(starts[at], lengths)], lengths


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) alone, so that no other column can clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that come sorted by ``keys``, one table per run of equal keys, across batch borders."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None:
            held.append(batch)
            last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
            if [batch.column(k)[0].as_py() for k in keys] == last and [held[0].column(k)[0].as_py() for k in keys] == last:
                continue  # one run so far
        if not held:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            values = table.column(k).to_numpy()
            change |= values[1:] != values[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
        keep = 1 if batch is not None else 0  # the last run may go on
        for a, b in zip(bounds[: len(bounds) - 1 - keep], bounds[1:], strict=False):
            yield table.slice(a, b - a)
        held = table.slice(bounds[-2]).to_batches() if keep else []
