"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words fall into ``WORDS`` classes by hash. Each class has a fixed sparse index vector; its
context vector is the sum, over the whole corpus, of the index vectors of the words within
two places. Sums are of integers, so they do not depend on the order of tasks. A document is
the mean of its words' vectors. The network is fitted on a bounded sample of labelled rows,
its probabilities calibrated by one temperature on rows set aside.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ChunkMemo, documents, lean, map_batches, materialize, prepare, worker_cache

WORDS, WIDTH, REACH, SEED = 1 << 14, 24, 2, 11
#: Labelled rows that the network is fitted on, at most; all statistics cover all rows.
FIT_ROWS = 20_000
#: Characters of text that are held as words at once.
SLICE = 1 << 20
HIDDEN, EPOCHS, RATE, DECAY = 24, 400, 0.01, 1e-4
_TOKENS = re.compile(r"[^\W\d_]+|\d+|_+|[^\w\s]+")


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _index_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    out = np.zeros((WORDS, WIDTH), np.int32)
    for place in range(4):
        out[np.arange(WORDS), rng.integers(0, WIDTH, WORDS)] += np.where(rng.random(WORDS) < 0.5, 1, -1).astype(np.int32)
    return out


def _classes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of each word: its lower-case letters, marks for capitals, digits by number, signs as they stand."""
    out, counts = [], []
    for word in words:
        n = len(out)
        for token in _TOKENS.findall(word):
            if token[0].isdigit():
                token = "0" * len(token)
            elif token[0].isalpha():
                if len(token) > 1 and token.isupper():
                    out.append(0)
                token = token.lower()
            out.append(1 + xxhash.xxh3_64_intdigest(token, SEED) % (WORDS - 1))
        counts.append(len(out) - n)
    return np.array(out, np.int32), np.array(counts, np.int64)


def _encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word classes of all texts, one after the other, and where each text begins (and the last ends)."""
    memo = worker_cache("word classes", lambda: ChunkMemo(_classes))
    split = [t.split() for t in texts]
    ids, counts = memo.encode(list(itertools.chain.from_iterable(split)))
    return ids, np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, split)])]


_SPACE = re.compile(r"\s")


def _stretches(text: str, most: int) -> Iterator[str]:
    """A text in stretches of about so many characters, cut at white space: no word is cut."""
    at = 0
    while len(text) - at > most and (space := _SPACE.search(text, at + most)):
        yield text[at : space.start()]
        at = space.end()
    yield text[at:]


def _slices(texts: list[str], most: int = SLICE) -> Iterator[tuple[list[int], list[str]]]:
    """Stretches of all texts in order, in groups of about so many characters, and which text each is of."""
    rows, group, size = [], [], 0
    for row, text in enumerate(texts):
        for stretch in _stretches(text, most):
            rows.append(row)
            group.append(stretch)
            size += len(stretch)
            if size >= most:
                yield rows, group
                rows, group, size = [], [], 0
    if group:
        yield rows, group


def _contexts(texts: list[str], index: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word classes, what is near each (sums of index vectors), and whether it is counted here, a slice at a time.

    A text goes on over slices: its last words come again before the next stretch, not counted, and only pairs with a new word count.
    """
    tail, before = np.empty(0, np.int64), -1
    for rows, group in _slices(texts):
        ids, bounds = _encode(group)
        document = np.repeat(rows, np.diff(bounds))
        old = tail if rows[0] == before else tail[:0]
        ids, document = np.concatenate([old, ids]).astype(np.int64), np.concatenate([np.full(len(old), before), document])
        fresh = np.arange(len(ids)) >= len(old)
        near, vectors = np.zeros((len(ids), WIDTH), np.int32), index[ids]
        for o in range(1, REACH + 1):
            together = ((document[o:] == document[:-o]) & fresh[o:])[:, None]
            near[o:] += vectors[:-o] * together
            near[:-o] += vectors[o:] * together
        yield ids, near, fresh
        before = rows[-1]
        tail = ids[document == before][-REACH:]


def context_vectors(docs: DataFrame) -> np.ndarray:
    """(WORDS, WIDTH + 1): each class's context sums over the corpus, and its count."""
    prepare(docs.sparkSession)
    names = [f"c{k}" for k in range(WIDTH + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = _index_vectors(), np.zeros((WORDS, WIDTH + 1), np.int64)
        for batch in batches:
            for ids, near, fresh in _contexts(batch.column("text").to_pylist(), index):
                for k in range(WIDTH):
                    sums[:, k] += np.bincount(ids, near[:, k], WORDS).astype(np.int64)
                sums[:, WIDTH] += np.bincount(ids[fresh], minlength=WORDS)
        some = np.flatnonzero(sums[:, WIDTH])
        for low in range(0, len(some), 4096):
            part = some[low : low + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(sums[part, k]) for k in range(WIDTH + 1)]], ["word", *names])

    each = documents(docs).mapInArrow(lean(run), "word long, " + ", ".join(f"{n} long" for n in names))
    # one row per class: WORDS rows at most, whatever the corpus holds
    table = each.groupBy("word").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((WORDS, WIDTH + 1))
    out[table["word"].to_numpy()] = table[names].to_numpy()
    return out


def word_vectors(context: np.ndarray) -> np.ndarray:
    """Of each class: its context direction, less the corpus's, beside its own index vector, weighed down if common."""
    counts = context[:, WIDTH]
    total = max(counts.sum(), 1.0)
    direction = context[:, :WIDTH] / np.maximum(counts, 1)[:, None]
    direction -= (direction * counts[:, None]).sum(axis=0) / total
    direction /= np.maximum(np.sqrt((direction**2).sum(axis=1)), 1e-9)[:, None]
    weight = np.sqrt(1e-3 / (counts / total + 1e-3))[:, None]
    return np.hstack([direction * weight, _index_vectors() * 0.5]).astype(np.float32)


def _pool(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """The mean of each text's word vectors, from sums over its stretches; zeros without words."""
    sums, sizes = np.zeros((len(texts), vectors.shape[1])), np.zeros(len(texts), np.int64)
    for rows, group in _slices(texts):
        ids, bounds = _encode(group)
        counts = np.diff(bounds)
        some = counts > 0
        if some.any():
            of = np.array(rows)[some]
            np.add.at(sums, of, np.add.reduceat(vectors[ids], bounds[:-1][some], axis=0))
            np.add.at(sizes, of, counts[some])
    return (sums / np.maximum(sizes, 1)[:, None]).astype(np.float32)


def document_vectors(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, vector (mean over the words of the whole text; zeros if it has none)."""

    def run(rows: dict) -> Iterator[pa.RecordBatch]:
        out = _pool(rows["text"], vectors)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), lists], ["doc_id", "vector"])

    return map_batches(documents(docs), run, "doc_id long, vector array<float>")


def _forward(net: dict, x: np.ndarray) -> np.ndarray:
    hidden = np.tanh((x - net["mean"]) / net["scale"] @ net["w1"] + net["b1"])
    return (hidden @ net["w2"] + net["b2"]) / net["temperature"]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Two-layer network by Adam on four fifths of the rows; its temperature by the others' likelihood."""
    rng = np.random.default_rng(SEED)
    net = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-6, "temperature": 1.0}
    net |= {"w1": rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), "b1": np.zeros(HIDDEN), "w2": rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), "b2": 0.0}
    aside = rng.permutation(len(y)) % 5 == 0
    z, t = (x[~aside] - net["mean"]) / net["scale"], y[~aside]
    names = ["w1", "b1", "w2", "b2"]
    first, second = ({n: np.zeros_like(net[n]) for n in names} for _ in range(2))
    for step in range(1, EPOCHS + 1):
        hidden = np.tanh(z @ net["w1"] + net["b1"])
        error = (_sigmoid(hidden @ net["w2"] + net["b2"]) - t) / max(len(t), 1)
        back = np.outer(error, net["w2"]) * (1 - hidden**2)
        grads = {"w1": z.T @ back + DECAY * net["w1"], "b1": back.sum(axis=0), "w2": hidden.T @ error + DECAY * net["w2"], "b2": error.sum()}
        for n in names:
            first[n] = 0.9 * first[n] + 0.1 * grads[n]
            second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
            net[n] = net[n] - RATE * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    held, truth = _forward(net, x[aside]), y[aside]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
    if len(truth):
        loss = [np.logaddexp(0, np.where(truth == 1, -held, held) / g).mean() for g in grid]
        net["temperature"] = float(grid[int(np.argmin(loss))])
    return net


def _fit_task(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pa.schema([("vector", pa.list_(pa.float32())), ("quality", pa.int32())]))
        if not rows.num_rows:
            return
        x = rows.column("vector").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, width)
        net = fit(x, rows.column("quality").to_numpy().astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])

    return run


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, dict | None]:
    """Word vectors of the whole corpus, and the network fitted on at most ``fit_rows`` labelled rows, chosen by a hash of doc_id."""
    vectors = word_vectors(context_vectors(docs))
    known = labels.where("quality is not null and doc_id is not null").where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = materialize(known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows), "sample")
    # the sample's size is bounded by fit_rows
    chosen = document_vectors(docs.join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi"), vectors)
    got = chosen.join(F.broadcast(known), "doc_id").sort("doc_id", "quality", "vector").limit(fit_rows).select("vector", "quality").coalesce(1).mapInArrow(_fit_task(vectors.shape[1]), "net binary").collect()
    return vectors, pickle.loads(bytes(got[0]["net"])) if got else None


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted, and the columns of ``carry`` in ``carried``.

    Learns from ``labels(doc_id, quality)`` of documents whose crc32(doc_id as text) mod 4 is
    not 2, at most ``fit_rows`` of them. Only the text enters a score. Null and empty texts
    have the zero vector and its score. Without any label every score is 0.5. Rows without
    doc_id are scored, never learned from. Repeated rows stay.
    """
    vectors, net = train(docs, labels, fit_rows)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("carried"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _pool(batch.column("text").to_pylist(), vectors).astype(np.float64)
            score = _sigmoid(_forward(net, x)) if net else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), batch.column("carried")], ["doc_id", "score", "carried"])

    scored = rows.mapInArrow(lean(run), f"doc_id long, score double, carried {rows.schema['carried'].dataType.simpleString()}")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "carried")
