"""SimHash near-duplicates found through anchor points of a covering code.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in at most three
bits differ in at most one bit within some half. In each half 31 bits are covered by the
Hamming code [31, 26]: every point lies within one bit of exactly one code word, its home
anchor. A fingerprint is placed at its home anchor and, as a probe, at every anchor within
two bits (covering radius one plus threshold one): sixteen at most. Two fingerprints whose
halves differ in one bit or none so meet at the home anchor of either. What meets is
compared over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, lean, lower_words, map_batches, materialize, partitions, prepare
from .components import connected_components

SEED = 42
#: Homes of one anchor that one task compares; an anchor with more is split.
HOMES = 4096
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANES = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, least bit first.

    Bit k of every byte is moved to the byte's lowest place; eight byte counters are then
    summed at once, in runs of 255 so that none overflows.
    """
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 255 * 4096):
        part = hashes[low : low + 255 * 4096]
        if len(part) % 255:
            part = np.concatenate([part, np.zeros(-len(part) % 255, np.uint64)])
        part = part.reshape(255, -1)
        for bit in range(8):
            lanes = ((part >> np.uint64(bit)) & _LANES).sum(axis=0, dtype=np.uint64)
            counts[bit::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """A bit is set if it is set in over half the XXH64 of the word shingles, repeats included."""
    if not words:
        return 0
    text = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(shingle, len(words))
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)
    set_bits = 2 * _bit_counts(hashes) > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp long (the 64 bits as signed) of every whole text."""

    def run(rows: dict) -> Iterator[pa.RecordBatch]:
        got = np.array([fingerprint(lower_words(t), shingle) for t in rows["text"]], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(got)], ["doc_id", "fp"])

    return map_batches(documents(docs), run, "doc_id long, fp long")


def _syndromes(points: np.ndarray) -> np.ndarray:
    """Of 31-bit points: the exclusive or of the places (1 to 31) that are set."""
    out = np.zeros(len(points), np.int64)
    for place in range(1, 32):
        out ^= ((points >> (place - 1)) & 1) * place
    return out


#: For each syndrome, the words to add so as to reach each anchor within two bits; the first is the home anchor's.
_REACH = [[0]] + [[1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i ^ s > i and i != s] for s in range(1, 32)]
_REACH_SIZE = np.array([len(r) for r in _REACH])
_REACH_FLAT = np.array([x for r in _REACH for x in r], np.int64)
_REACH_START = np.cumsum(_REACH_SIZE) - _REACH_SIZE


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) of every place of every fingerprint; an anchor's lowest bit tells the half."""
    rows, places, homes = [], [], []
    bits = fps.view(np.uint64)
    for half in (0, 1):
        points = ((bits >> np.uint64(33 * half)) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        s = _syndromes(points)
        sizes = _REACH_SIZE[s]
        row = np.repeat(np.arange(len(fps)), sizes)
        first = np.cumsum(sizes) - sizes
        nth = np.arange(len(row)) - np.repeat(first, sizes)
        rows.append(row)
        places.append(((points[row] ^ _REACH_FLAT[_REACH_START[s][row] + nth]) << 1) | half)
        homes.append(nth == 0)
    return np.concatenate(rows), np.concatenate(places), np.concatenate(homes)


def _compare(fps: np.ndarray, home: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """At one anchor: links between homes and all that are there, as a few edges per member.

    Members that link are joined to the least member they reach here, so a dense group
    gives edges in proportion to its size. Rows are compared in blocks.
    """
    bits = fps.view(np.uint64)
    parent = np.arange(len(fps))
    at_home = np.flatnonzero(home)
    for low in range(0, len(fps), 4096):
        rows = bits[low : low + 4096]
        for part in range(0, len(at_home), 1024):
            homes = at_home[part : part + 1024]
            a, b = np.nonzero(np.bitwise_count(rows[:, None] ^ bits[homes][None, :]) <= most)
            a, b = a + low, homes[b]
            while len(a):
                ra, rb = _roots(parent, a), _roots(parent, b)
                apart = ra != rb
                a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    top = _roots(parent, np.arange(len(fps)))
    linked = np.flatnonzero(top != np.arange(len(fps)))
    if len(linked):
        yield fps[linked], fps[top[linked]]


def _direct(fps: np.ndarray, home: np.ndarray, component: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """At one anchor: every link itself between a home and what is there, if their components differ."""
    bits = fps.view(np.uint64)
    at_home = np.flatnonzero(home)
    for low in range(0, len(fps), 4096):
        rows = slice(low, low + 4096)
        for part in range(0, len(at_home), 1024):
            homes = at_home[part : part + 1024]
            near = np.bitwise_count(bits[rows, None] ^ bits[None, homes]) <= most
            a, b = np.nonzero(near & (component[rows, None] != component[None, homes]))
            if len(a):
                yield fps[a + low], fps[homes[b]]


def _roots(parent: np.ndarray, of: np.ndarray) -> np.ndarray:
    found = parent[of]
    while True:
        up = parent[found]
        if (up == found).all():
            return found
        found = up


def fingerprint_links(fps: DataFrame, most: int = 3, direct: bool = False) -> DataFrame:
    """Edges (u, v) between distinct fingerprints such that those within ``most`` bits (three at most) connect.

    With ``direct`` the edges are the pairs within that distance themselves, of different ``component`` (a second column); they may repeat.
    """
    if not 0 <= most <= 3:
        raise ValueError("the two covered halves find distances of three bits at most")
    spark = fps.sparkSession
    prepare(spark)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for low in range(0, len(values), 4096):
                part = values[low : low + 4096]
                rows, at, home = anchors(part)
                more = [batch.column(c).slice(low, 4096).take(pa.array(rows)) for c in carried]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(part[rows]), pa.array(home), *more], ["anchor", "fp", "home", *carried])

    carried = ["component"] if direct else []
    placed = fps.select("fp", *carried).distinct().mapInArrow(lean(place), ", ".join(["anchor long, fp long, home boolean", *(f"{c} long" for c in carried)]))
    # An anchor's homes are counted before anything meets there; crowded ones are split by salt.
    crowded = placed.where("home").groupBy("anchor").count().where(F.col("count") > HOMES)
    crowded = materialize(crowded.select("anchor", F.ceil(F.col("count") / HOMES).cast("int").alias("parts")), "crowded")
    if crowded.head(1):
        parts = F.coalesce("parts", F.lit(1))
        own = F.pmod(F.xxhash64("fp"), parts).cast("int")
        placed = placed.join(crowded, "anchor", "left").select("anchor", "fp", "home", *carried, own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        placed = placed.select("anchor", "salt", "fp", (F.col("home") & (F.col("own") == F.col("salt"))).alias("home"), *carried)
    else:
        placed = placed.select("anchor", F.lit(0).alias("salt"), "fp", "home", *carried)
    dealt = placed.repartition(partitions(spark), "anchor", "salt").sortWithinPartitions("anchor", "salt")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in _then_none(batches):
            if batch is not None:
                now = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("anchor", "salt", "fp", "home", *carried)]
                kept = [np.concatenate([a, b]) for a, b in zip(kept, now, strict=True)] if kept else now
            if not kept or not len(kept[0]):
                continue
            anchor, salt, fp, home, *component = kept
            cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
            if batch is not None:  # the last run may go on in the next batch
                done = cuts[-1] if len(cuts) else 0
                kept = [x[done:] for x in kept]
            else:
                done = len(anchor)
            bounds = np.concatenate([[0], cuts, [len(anchor)]])
            bounds = bounds[bounds <= done]
            firsts, sizes = bounds[:-1], np.diff(bounds)
            with_home = np.add.reduceat(home[:done].astype(np.int64), firsts) if len(firsts) else firsts
            out_u, out_v = [], []
            for i in np.flatnonzero((sizes > 1) & (with_home > 0)).tolist():
                run = slice(firsts[i], firsts[i] + sizes[i])
                for u, v in _direct(fp[run], home[run], component[0][run], most) if direct else _compare(fp[run], home[run], most):
                    out_u.append(u)
                    out_v.append(v)
            if out_u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], ["u", "v"])

    return dealt.mapInArrow(lean(meet), "u long, v long")


def _then_none(batches: Iterator) -> Iterator:
    """The batches, then None."""
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (signed 64 bits), component_id.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows
    stay. component_id is the least doc_id reachable; null doc_ids count as the greatest.
    An empty table gives an empty result.
    """
    each = materialize(fingerprints(docs, shingle), "fingerprints")
    owners = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = connected_components(fingerprint_links(owners, most)).withColumnRenamed("node", "fp")
    named = owners.join(groups, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = materialize(named.join(heads, "component").select("fp", "component_id"), "groups")
    return each.join(of, "fp").select("doc_id", "fp", "component_id")
