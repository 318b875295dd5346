"""Near-duplicate vectors: sign hashing by random hyperplanes, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, prepare, runs
from .components import connected_components

#: Vectors that one tile of a crowded bucket takes from either side.
TILE = 4096
#: Rows of a tile that are compared at once.
ROWS = 128
#: Rows of sketches that a task compares together, whole buckets of at most ``TILE`` rows.
GATHER = 1 << 16
#: A bucket's key: the code, from this bit on its table, from that on the length of the vectors.
TABLE_AT, WIDTH_AT = 30, 42


def layout(vectors: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits of a code, number of tables) for so many vectors.

    Bits grow with the logarithm of the input, so buckets of unrelated vectors stay about as
    full; tables are as many as make a pair at exactly the threshold go unfound with
    probability ``miss`` at most. More similar pairs go unfound more rarely. Where that would
    take more tables than a key can number, codes are shorter.
    """
    bits = min(TABLE_AT, max(8, math.ceil(math.log2(max(vectors, 2))) - 4))
    alike = 1 - math.acos(threshold) / math.pi
    while bits > 1 and math.log(miss) / math.log(1 - alike**bits) > 1 << (WIDTH_AT - TABLE_AT):
        bits -= 1
    return bits, math.ceil(math.log(miss) / math.log(1 - alike**bits))


def most_apart(threshold: float, miss: float) -> int:
    """Bits of 64 in which the sketches of a pair at the threshold differ, save with probability ``miss`` at most."""
    apart = math.acos(threshold) / math.pi
    beyond = 1.0
    for k in range(64):
        beyond -= math.comb(64, k) * apart**k * (1 - apart) ** (64 - k)
        if beyond <= miss:
            return k
    return 64


def _planes(seed: int, width: int, count: int, *use: int) -> np.ndarray:
    return np.random.default_rng([seed, width, *use]).standard_normal((width, count))


def _codes(x: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """Codes of the rows of ``x``, a column a table."""
    codes = np.zeros((len(x), planes.shape[1] // bits), np.int64)
    for low in range(0, len(x), 256):
        part = x[low : low + 256]
        codes[low : low + 256] = ((part @ planes > 0).reshape(len(part), -1, bits) << np.arange(bits, dtype=np.int64)).sum(axis=2)
    return codes


def _kept(bits: int) -> str:
    return "<u2" if bits <= 16 else "<u4"


def _sign(bits: int, tables: int, seed: int):
    """Each vector (node, least, copies, embedding) with its codes in all tables as bytes, and a sketch of 64 signs of their own: signs are computed here and nowhere else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                width = np.diff(part.column("embedding").offsets.to_numpy())
                for d in np.unique(width).tolist():  # vectors of different lengths never meet
                    of = part.take(pa.array(np.flatnonzero(width == d)))
                    x = of.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                    if d not in planes:
                        planes[d] = _planes(seed, d, bits * tables), _planes(seed, d, 64, 1)
                    codes = _codes(x, planes[d][0], bits).astype(_kept(bits))
                    sketch = np.packbits(x @ planes[d][1] > 0, axis=1).view(np.int64).ravel()
                    yield pa.RecordBatch.from_arrays([*(of.column(c) for c in ("node", "least", "copies", "embedding")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(sketch)], ["node", "least", "copies", "embedding", "codes", "sketch"])

    return run


def _unpacked(codes: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), _kept(bits)).reshape(len(codes), -1)


def _keys(bits: int):
    """Of each vector (node, width, codes, sketch): a row a table with its bucket's key; no vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                codes = _unpacked(part.column("codes"), bits).astype(np.int64)
                tables = codes.shape[1]
                key = (part.column("width").to_numpy().astype(np.int64)[:, None] << WIDTH_AT) | (np.arange(tables, dtype=np.int64) << TABLE_AT) | codes
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(pa.array(np.repeat(part.column(c).to_numpy(), tables)) for c in ("node", "sketch"))], ["key", "node", "sketch"])

    return run


def _near(bound: int):
    """Of rows that come sorted by key: those whose bucket holds another with a sketch ``bound`` bits apart or fewer."""

    def some(key: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        near, step = np.zeros(len(key), bool), 1
        at = np.flatnonzero(key[1:] == key[:-1])
        while len(at):  # every row with the one ``step`` places on, in all buckets at once
            close = at[np.bitwise_count(sketch[at] ^ sketch[at + step]) <= bound]
            near[close] = near[close + step] = True
            step += 1
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
        return pa.RecordBatch.from_arrays([pa.array(key[near]), pa.array(node[near])], ["key", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy().view(h.dtype)]) for i, h in enumerate(held)]
            if len(held[0]) >= GATHER:
                cut = np.searchsorted(held[0], held[0][-1])  # the last bucket may go on
                yield some(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        yield some(*held)

    return run


def _roots(parent: np.ndarray, of: np.ndarray) -> np.ndarray:
    found = parent[of]
    while not (parent[found] == found).all():
        found = parent[found]
    return found


def _compare(threshold: float, bits: int):
    """In each tile: links whose ends meet in no earlier table, counted for both ends, and a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["key", "low", "high"]):
            n = rows.num_rows
            if n < 2:
                continue
            key, a, b = (rows.column(c)[0].as_py() for c in ("key", "low", "high"))
            table = key >> TABLE_AT & (1 << WIDTH_AT - TABLE_AT) - 1
            node, copies, own = (rows.column(c).to_numpy() for c in ("node", "copies", "own"))
            x = rows.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(n, -1)
            codes = _unpacked(rows.column("codes").combine_chunks(), bits)[:, :table]
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
            links, parent = np.zeros(n, np.int64), np.arange(n)
            for at in range(0, len(left), ROWS):
                i, j = np.nonzero(x[left[at : at + ROWS]] @ x[right].T >= threshold)
                i, j = left[at + i], right[j]
                fresh = i < j if a == b else np.ones(len(i), bool)
                i, j = i[fresh], j[fresh]
                fresh = ~(codes[i] == codes[j]).any(axis=1)
                i, j = i[fresh], j[fresh]
                links += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
                while len(i):
                    ri, rj = _roots(parent, i), _roots(parent, j)
                    apart = ri != rj
                    i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
                    np.minimum.at(parent, np.maximum(ri, rj), np.minimum(ri, rj))
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[_roots(parent, some)])], ["node", "links", "head"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, miss: float = 1e-4, seed: int = 7) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept.

    Two vectors link if their cosine, in double precision, is at least ``threshold``; labels
    play no part. Copies are compared once and counted by their number. Vectors that are null,
    zero, empty or hold null or non-finite components, and rows without vec_id, link with
    nothing; the latter have a null component_id and are not kept. Vectors of different
    lengths do not link. Rows that repeat a vec_id are vectors of their own.

    A bucket compares sketches first; only vectors with a near sketch in it are sent there. A
    pair at the threshold meets in no table with probability ``miss`` at most, and is passed
    over by its sketches with a tenth of that. Signs are computed once a vector and kept beside
    it, so that the first table of a pair is the same wherever it is compared.
    """
    spark = vectors.sparkSession
    prepare(spark)
    given = vectors.select("vec_id", "embedding")
    sound = F.coalesce(
        F.col("vec_id").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False)
    )
    distinct = given.where(sound).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    bits, tables = layout(distinct.count(), threshold, miss)
    kind = distinct.schema["embedding"].dataType.simpleString()
    distinct = materialize(distinct.select("node", "least", "copies", "embedding").mapInArrow(_sign(bits, tables, seed), f"node long, least long, copies long, embedding {kind}, codes binary, sketch long"), "codes")

    signed = distinct.select("node", F.size("embedding").alias("width"), "codes", "sketch").mapInArrow(_keys(bits), "key long, node long, sketch long")
    crowded = signed.groupBy("key").count().where(F.col("count") > TILE)
    crowded = materialize(crowded.select("key", F.ceil(F.col("count") / TILE).cast("int").alias("parts")), "crowded")
    anywhere = bool(crowded.head(1))
    sparse = signed.join(crowded, "key", "left_anti") if anywhere else signed
    sparse = sparse.repartition(partitions(spark), "key").sortWithinPartitions("key")
    met = sparse.mapInArrow(_near(most_apart(threshold, miss / 10)), "key long, node long").withColumn("own", F.lit(0)).withColumn("other", F.lit(0))
    if anywhere:  # a crowded bucket is cut in parts; each pair of parts is a tile of its own
        cut = signed.join(crowded, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        met = met.unionByName(cut.select("key", "node", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")))
    tile = ["key", "low", "high"]
    met = met.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node")
    dealt = met.join(distinct.select("node", "copies", "embedding", "codes"), "node").repartition(partitions(spark), *tile).sortWithinPartitions(*tile)
    found = materialize(dealt.mapInArrow(_compare(threshold, bits), "node long, links long, head long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("node").alias("u"), F.col("head").alias("v")))
    named = distinct.select("node", "least", "copies").join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(heads, "component").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of = materialize(distinct.select("node", "embedding").join(named, "node").drop("node"), "groups")
    out = given.where(sound).join(of, "embedding").select("vec_id", "n_links", "component_id")
    alone = given.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
