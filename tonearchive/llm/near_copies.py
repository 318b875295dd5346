"""Near copies by word-shingle similarity, for fingerprints too noisy to tell them: min-wise bands.

At a Jaccard similarity of 0.8 whole-text fingerprints differ in some ten of 64 bits, beyond
what a covering code can reach. So each text gets ``BANDS`` band keys, each the hash of the two
shingles that are least under the band's own hash (MinHash, not SimHash): near copies share one
in most bands. Texts that meet in a band are compared by MinHash signatures of ``SKETCH``
minima. Every text's strongest links in a meeting are verified first, on the whole shingle
sets; only verified links join groups. Where a meeting has links left between different
groups, its texts' shingle sets meet in tiles and all such links are compared there, without
any pair being sent around. Whole-text SimHash fingerprints within three bits are candidates
beside them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, partitions, prepare, release, runs, worker_cache
from .components import connected_components
from .simhash import fingerprint, fingerprint_links

BANDS, SKETCH = 12, 48
#: How rarely the sketches may drop a pair right at the similarity; the bands together drop about 5e-6.
MISS = 1e-6
#: Members of a meeting that are compared at once, and that one tile of a crowded meeting takes from either side.
BLOCK, MEETING = 512, 8192
#: Links that a member of a meeting gives at first, and members of a meeting whose sets one tile takes from either side.
FIRST, SETS = 4, 512
TILE = ["band", "key", "low", "high"]
_TILE_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32()]
_ODD = (np.random.default_rng(17).integers(0, 1 << 62, BANDS + SKETCH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _shingles(words: list[bytes], size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles (fewer words: the whole sequence; none: nothing)."""
    if not words:
        return np.empty(0, np.uint64)
    text, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends, k = np.cumsum(lengths + 1) - 1, min(size, len(words))
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(text[a:b]) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64))


def _minima(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per band the hash of its two least shingles together, and the sketch: per function the least value."""
    bands, sketch = np.zeros(BANDS, np.uint64), np.full(SKETCH, np.iinfo(np.uint64).max)
    least = np.full((BANDS, 2), np.iinfo(np.uint64).max)
    for low in range(0, len(shingles), 4096):
        mixed = shingles[low : low + 4096, None] * _ODD
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        sketch = np.minimum(sketch, mixed[:, BANDS:].min(axis=0))
        least = np.sort(np.hstack([least, np.sort(mixed[:, :BANDS], axis=0)[:2].T]), axis=1)[:, :2]
    bands = least[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ least[:, 1]
    return bands, (sketch >> np.uint64(32)).astype(np.uint32)


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("none")  # what an earlier step of the job kept
        for batch in batches:
            out = [[] for _ in range(4)]
            for text in batch.column("text").to_pylist():
                words = text.encode().lower().split()
                bands, sketch = _minima(_shingles(words, size))
                for column, value in zip(out, (fingerprint(words, size), xxhash.xxh3_128_digest(b" ".join(words)), bands.tobytes(), sketch.tobytes()), strict=True):
                    column.append(value)
            fps = pa.array(np.array(out[0], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), fps, *[pa.array(c, pa.binary()) for c in out[1:]]], ["row", "doc_id", "fp", "same", "bands", "sketch"])

    return lean(run)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        bands = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64).reshape(n, BANDS)
        again = pa.array(np.repeat(np.arange(n), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(bands.ravel()), batch.column("node").take(again), batch.column("sketch").take(again)], ["band", "key", "node", "sketch"])


def _least_equal(similarity: float) -> int:
    """Equal minima that a pair of at least this similarity falls short of with probability ``MISS`` at most."""
    short, at = 0.0, 0
    while (short := short + math.comb(SKETCH, at) * similarity**at * (1 - similarity) ** (SKETCH - at)) <= MISS:
        at += 1
    return at


def _alike(sketch: np.ndarray, some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many minima each of some rows has in common with each of the others."""
    equal = np.zeros((len(some), len(others)), np.int8)
    for k in range(SKETCH):
        equal += sketch[some, k, None] == sketch[None, others, k]
    return equal


def _meet(similarity: float):
    """In each meeting: every member's strongest ``FIRST`` links; a row without u tells that the tile has more."""
    least = _least_equal(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, TILE):
            if rows.num_rows < 2:
                continue
            order = np.argsort(rows.column("node").to_numpy())
            rows = rows.take(pa.array(order)).combine_chunks()
            n, node = rows.num_rows, rows.column("node").to_numpy()
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint32).reshape(n, SKETCH)
            tile = [rows.column(c)[0].as_py() for c in TILE]
            own = rows.column("own").to_numpy()
            left, right = np.flatnonzero(own == tile[2]), np.flatnonzero(own == tile[3])
            us, vs, more = [], [], False
            for at in range(0, len(left), BLOCK):
                a = left[at : at + BLOCK]
                equal = _alike(sketch, a, right)
                if tile[2] == tile[3]:
                    equal[np.arange(len(a)), at + np.arange(len(a))] = -1
                ranked = np.argsort(-equal, axis=1, kind="stable")[:, :FIRST]
                open_ = equal >= least
                i = np.arange(len(a))[:, None]
                i, j = np.nonzero(open_[i, ranked])[0], ranked[open_[i, ranked]]
                us.append(node[a[i]])
                vs.append(node[right[j]])
                more = more or int(open_.sum()) > len(i)
            u, v = np.concatenate(us), np.concatenate(vs)
            pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
            m = pairs.shape[1]
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), *[pa.nulls(m, t) for t in _TILE_TYPES]], ["u", "v", *TILE])
            if more:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 2, *[pa.array([x], t) for x, t in zip(tile, _TILE_TYPES, strict=True)]], ["u", "v", *TILE])

    return lean(run)


def _settle(similarity: float):
    """In each tile of shingle sets: all links between groups are compared, strongest first; those that hold and join groups are given.

    A pair that meets in an earlier band too has been, or is, compared there.
    """
    least = _least_equal(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for rows in runs(batches, TILE):
            n, node = rows.num_rows, rows.column("node").to_numpy()
            group = np.unique(rows.column("component").to_numpy(), return_inverse=True)[1]
            band, _, low, high = (rows.column(c)[0].as_py() for c in TILE)
            own = rows.column("own").to_numpy()
            left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
            if group.max() == 0 or not len(left) or not len(right):
                continue
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint32).reshape(n, SKETCH)
            bands = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.int64).reshape(n, BANDS)
            stored = rows.column("shingles").combine_chunks()
            sets: dict[int, np.ndarray] = {}
            parent = list(range(int(group.max()) + 1))

            def top(g: int, parent: list[int] = parent) -> int:
                while parent[g] != g:
                    parent[g] = g = parent[parent[g]]
                return g

            us, vs = [], []
            for at in range(0, len(left), 128):
                a = left[at : at + 128]
                equal = _alike(sketch, a, right)
                open_ = (equal >= least) & (group[a, None] != group[None, right])
                if low == high:
                    open_ &= a[:, None] < right[None, :]
                for k in range(band):
                    open_ &= bands[a, k, None] != bands[None, right, k]
                i, j = np.nonzero(open_)
                strongest = np.argsort(-equal[i, j], kind="stable")
                for x, y in zip(a[i[strongest]].tolist(), right[j[strongest]].tolist(), strict=True):
                    p, q = top(group[x]), top(group[y])
                    if p == q:
                        continue
                    for z in (x, y):
                        if z not in sets:
                            sets[z] = np.frombuffer(expand.decompress(stored[z].as_py()), np.uint32)
                    if _similar(sets[x], sets[y], similarity):
                        parent[max(p, q)] = min(p, q)
                        us.append(node[x])
                        vs.append(node[y])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return lean(run)


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted, without repeats) have this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    both = int((both[1:] == both[:-1]).sum())
    return both >= similarity * (len(a) + len(b) - both)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            sets = [shrink.compress(np.unique(_shingles(t.encode().lower().split(), size).astype(np.uint32)).tobytes()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return lean(run)


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = np.frombuffer(expand.decompress(a), np.uint32), np.frombuffer(expand.decompress(b), np.uint32)
                keep.append(_similar(a, b, similarity))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], ["u", "v"])

    return lean(run)


def _shingle_sets(nodes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """node, shingles (sorted 32-bit hashes, compressed) of the texts (node, text) whose node is wanted."""
    sets = texts.join(nodes.hint("merge"), "node", "left_semi").mapInArrow(_sets(size), "node long, shingles binary")
    return materialize(sets, "sets")


def _verified(links: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The links (u, v) whose texts (node, text) have sets of shingles similar enough."""
    spark = links.sparkSession
    sets = _shingle_sets(links.select(F.col("u").alias("node")).union(links.select("v")).distinct(), texts, size)
    release(spark)
    both = links.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    return materialize(both.mapInArrow(_verify(similarity), "u long, v long"), "verified")


def _tiled(placed: DataFrame, crowded: DataFrame) -> DataFrame:
    """Members of meetings with the tiles they belong to: of a meeting in ``crowded`` (band, key, parts), each pair of parts is a tile."""
    parts = F.coalesce("parts", F.lit(1))
    if crowded.head(1):
        placed = placed.join(crowded, ["band", "key"], "left").withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    else:
        placed = placed.withColumn("own", F.lit(0)).withColumn("other", F.lit(0))
    return placed.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")


def _crowded(placed: DataFrame, most: int) -> DataFrame:
    counts = placed.groupBy("band", "key").count().where(F.col("count") > most)
    return materialize(counts.select("band", "key", F.ceil(F.col("count") / most).cast("int").alias("parts")), "crowded")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the one with the least doc_id.

    Rows whose lower-cased words agree are one group, as are rows whose sets of word shingles
    have a Jaccard similarity of at least ``similarity``; groups join where they share a row.
    Texts without words are copies of one another. Null doc_ids count as the greatest, and of
    rows that tie one stays. An empty table stays empty.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = docs.columns
    kept = materialize(docs.select(F.struct(*names).alias("carried")).withColumn("row", F.monotonically_increasing_id()), "rows")
    text = F.coalesce(F.col("carried.text"), F.lit("")).alias("text")
    each = kept.select("row", F.col("carried.doc_id").alias("doc_id"), text).mapInArrow(_describe(shingle), "row long, doc_id long, fp long, same binary, bands binary, sketch binary")
    each = materialize(each, "sketches")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = materialize(each.groupBy("same").agg(F.min_by(F.struct("row", "doc_id", "fp", "bands", "sketch"), order).alias("f")).select("same", F.col("f.row").alias("node"), "f.doc_id", "f.fp", "f.bands", "f.sketch"), "distinct")

    placed = first.select("node", "bands", "sketch").mapInArrow(lean(_place), "band int, key long, node long, sketch binary")
    texts = kept.select(F.col("row").alias("node"), text)
    tiles = _tiled(placed, _crowded(placed, MEETING))
    met = tiles.repartition(partitions(spark), *TILE).sortWithinPartitions(*TILE).mapInArrow(_meet(similarity), "u long, v long, band int, key long, low int, high int")
    met = materialize(met.distinct(), "candidates")
    release(spark)
    sure = _verified(met.where("u is not null").select("u", "v"), texts, shingle, similarity)
    groups = connected_components(sure)
    release(spark)
    later = met.where("u is null").select("band", "key").distinct()
    if later.head(1):
        named = placed.join(later, ["band", "key"], "left_semi").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = named.groupBy("band", "key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band", "key")
        members = materialize(named.join(mixed, ["band", "key"], "left_semi"), "members")
        sets = _shingle_sets(members.select("node").distinct(), texts, shingle).join(first.select("node", "bands"), "node")
        tiles = _tiled(members, _crowded(members, SETS)).join(sets, "node")
        found = tiles.repartition(partitions(spark), *TILE).sortWithinPartitions(*TILE).mapInArrow(_settle(similarity), "u long, v long")
        sure = sure.unionByName(materialize(found, "settled"))
        groups = connected_components(sure)
        release(spark)
    # whole-text fingerprints within three bits are candidates too
    prints = first.select("node", "fp").join(groups, "node", "left").select("node", "fp", F.coalesce("component", "node").alias("component"))
    each_fp = prints.groupBy("fp").agg(F.min_by(F.struct("node", "component"), "node").alias("f"), (F.min("component") != F.max("component")).alias("mixed"))
    each_fp = materialize(each_fp.select("fp", F.col("f.node").alias("head"), F.col("f.component").alias("component"), "mixed"), "prints")
    heads = each_fp.select("fp", "head")
    close = fingerprint_links(each_fp.select("fp", "component"), direct=True)
    close = close.join(heads.select(F.col("fp").alias("u"), F.col("head").alias("a")), "u").join(heads.select(F.col("fp").alias("v"), F.col("head").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same = prints.join(each_fp.where("mixed").select("fp", "head", F.col("component").alias("of")), "fp").where("component <> of").select(F.col("node").alias("u"), F.col("head").alias("v"))
    more = _verified(materialize(close.unionByName(same).distinct(), "candidates"), texts, shingle, similarity)
    if more.head(1):
        groups = connected_components(sure.unionByName(more))
    release(spark)
    named = first.select("node", "doc_id").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = named.groupBy("component").agg(F.min_by("node", F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("row"))
    # texts are dealt by row at any size: heads grow with the input
    return kept.join(heads.select("row").hint("merge"), "row", "left_semi").select("carried.*")
