"""Packing of token sequences as a cutting-stock problem solved by column generation.

Texts are cut into whole sequences and one tail each. Tails are counted by length, in steps
of ``GRAIN`` tokens: a histogram of fixed size whatever the corpus holds. A linear program
chooses how often to use each pattern (how many tails of each length fill one sequence);
its columns are priced by a knapsack dynamic program over the dual values. The rounded
patterns are then given to the tails by their rank within each length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, lean, map_batches, materialize, prepare
from .tokens import encoder, gathered

GRAIN = 8


def _price(values: np.ndarray, widths: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern (unbounded knapsack): its value, and how many it has of each width."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(widths)
    w, v = widths[order], values[order]
    upto = np.searchsorted(w, np.arange(room + 1), "right")
    for u in range(1, room + 1):
        best[u], k = best[u - 1], upto[u]
        if k:
            sums = best[u - w[:k]] + v[:k]
            i = int(np.argmax(sums))
            if sums[i] > best[u] + 1e-12:
                best[u], took[u] = sums[i], order[i]
    pattern, u = np.zeros(len(widths), np.int64), room
    while u > 0:
        if took[u] < 0:
            u -= 1
        else:
            pattern[took[u]] += 1
            u -= int(widths[took[u]])
    return float(best[room]), pattern


def _fill(left: np.ndarray, widths: np.ndarray, room: int) -> np.ndarray:
    """A pattern filled greatest width first from what is left; ``widths`` descend."""
    pattern = np.zeros(len(widths), np.int64)
    for i in np.flatnonzero(left > 1e-9).tolist():
        pattern[i] = min(int(np.ceil(left[i] - 1e-9)), room // int(widths[i]))
        room -= int(pattern[i] * widths[i])
    return pattern


def _start(demand: np.ndarray, widths: np.ndarray, room: int) -> np.ndarray:
    """A first basis: greedy patterns, each used until it exhausts a width, which no later one holds."""
    basis, left, at = np.diag(room // widths).astype(float), demand.copy(), set(range(len(widths)))
    while at:
        pattern = _fill(left, widths, room)
        some = np.flatnonzero(pattern)
        ratio = left[some] / pattern[some]
        left[some] -= ratio.min() * pattern[some]
        gone = some[ratio <= ratio.min() * (1 + 1e-12)]
        basis[:, gone[0]] = pattern  # widths exhausted with it keep a pattern of their own, unused
        left[gone] = 0
        at -= set(gone.tolist())
    return basis


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan steps on whole rows: at a few hundred rows cheaper than threads of a linear-algebra library beside Spark's."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        pivot = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0
        some = np.flatnonzero(factors)
        both[some] -= factors[some, None] * both[k]
    return both[:, n:]


def _program(demand: np.ndarray, widths: np.ndarray, room: int, within: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often to use each: simplex with generated columns, to ``within`` of the least cost."""
    basis = _start(demand, widths, room)
    inverse = _inverse(basis)
    use = np.maximum((inverse * demand).sum(axis=1), 0)
    least = float((demand * widths).sum()) / room
    for step in range(10 * len(demand)):
        total = float(use.sum())
        value, pattern = _price(inverse.sum(axis=0), widths, room)
        least = max(least, total / max(value, 1.0))  # what the dual values prove
        if total - least <= max(0.25, within * total) or value <= 1 + 1e-7:
            break
        direction = (inverse * pattern).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, use / direction, np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = pattern
        if step % 50 == 49:
            inverse = _inverse(basis)
        else:
            row = inverse[out] / direction[out]
            inverse -= np.outer(direction, row)
            inverse[out] = row
        use = np.maximum((inverse * demand).sum(axis=1), 0)
    return basis.round().astype(np.int64), use


def plan(counts: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {width: how many} with their number of uses, that take exactly ``counts`` tails of each width."""
    widths = np.array(sorted((w for w, n in counts.items() if n), reverse=True), np.int64)
    if not len(widths):
        return []
    left = np.array([counts[int(w)] for w in widths], np.int64)
    patterns, use = _program(left.astype(float), widths, room)
    out = []
    for j, times in enumerate(np.floor(use + 1e-6).astype(np.int64).tolist()):
        column = patterns[:, j]
        some = column > 0
        times = min([times, *(left[some] // column[some]).tolist()])
        if times > 0:
            out.append(({int(w): int(c) for w, c in zip(widths, column, strict=True) if c}, int(times)))
            left -= column * times
    while left.any():  # what rounding left over: fewer sequences than there are widths, filled greatest first
        pattern = _fill(left, widths, room)
        some = pattern > 0
        times = int((left[some] // pattern[some]).min())
        left -= pattern * times
        out.append(({int(w): int(n) for w, n in zip(widths, pattern, strict=True) if n}, times))
    return out


def _cut(path: str, length: int, ids_too: bool):
    """Pieces of every document, each with its rank among the task's pieces of its width."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "width", "part", "rank"] + ["ids"] * ids_too

    def start_task():
        return TaskContext.get().partitionId(), np.zeros(length // GRAIN + 1, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = start_task()
        for batch in gathered(batches):
            out = [[] for _ in names]
            ids, ends = encoder(path).encode(batch.column("text"))
            for doc_id, first, last in zip(batch.column("doc_id").to_pylist(), np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                n = last - first
                for a in range(0, n, length):
                    piece = ids[first + a : min(first + a + length, last)].astype("<u4").tobytes()
                    width = -(-len(piece) // (4 * GRAIN))
                    for column, x in zip(out, (doc_id, a, len(piece) // 4, zlib.crc32(piece), n, width, part, int(seen[width]), piece), strict=False):
                        column.append(x)
                    seen[width] += 1
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names)

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids.

    Every id of every document (null text: empty; each ends with id 1) lies in exactly one
    piece; a sequence holds ``length`` ids at most, its pieces without gaps from 0. Rows that
    repeat, or have no doc_id, are documents of their own. An empty table gives no pieces.
    """
    if length % GRAIN:
        raise ValueError(f"length must be a multiple of {GRAIN}")
    prepare(docs.sparkSession)
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, width int, part int, rank long" + ", ids binary" * ids
    pieces = materialize(documents(docs).mapInArrow(lean(_cut(tokenizer, length, ids)), kind), "pieces")
    counts = pieces.groupBy("width", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("width").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("width", "part", F.coalesce(before, F.lit(0)).alias("base"))
    totals = {r.width: r.n for r in counts.groupBy("width").agg(F.sum("n").alias("n")).collect()}  # as many rows as widths
    patterns = plan(totals, length // GRAIN)

    slots: dict[int, list[np.ndarray]] = {}
    first = np.cumsum([0, *(times for _, times in patterns)])
    for width in totals:
        uses = [(first[k], p[width], times) for k, (p, times) in enumerate(patterns) if width in p]
        sequence, each, times = (np.array(x, np.int64) for x in zip(*uses, strict=True))
        slots[width] = [np.cumsum(each * times), sequence, each]

    def place(rows: dict) -> Iterator[pa.RecordBatch]:
        width, rank = np.array(rows["width"]), np.array(rows["rank"], np.int64) + np.array(rows["base"], np.int64)
        sequence = np.empty(len(rank), np.int64)
        for w in np.unique(width).tolist():
            of = width == w
            ends, begin, each = slots[w]
            k = np.searchsorted(ends, rank[of], "right")
            sequence[of] = begin[k] + (rank[of] - np.where(k > 0, ends[k - 1], 0)) // each[k]
        columns = [pa.array(rows[c], pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        columns += [pa.array(sequence), pa.array(rank), pa.array(rows["width"], pa.int32())] + ([pa.array(rows["ids"], pa.binary())] if ids else [])
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "rank", "width", *["ids"] * ids])

    ranked = pieces.join(bases, ["width", "part"])
    placed = map_batches(ranked, place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, rank long, width int" + ", ids binary" * ids)
    row = Window.partitionBy("sequence_id").orderBy(F.desc("width"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(row), F.lit(0))).drop("rank", "width")
