"""Whitening of vectors by an incremental eigendecomposition.

Each partition keeps the spectrum of the covariance of what it has read. A stretch of vectors, centred on
its own mean, has the scatter matrix R'R of its triangular factor R; the rows of R, and the distance of the
stretch's mean from the mean so far, are rank-one updates of the spectrum (with stretches of one vector, the plain
centred update of every vector). An update solves the secular equation for the new eigenvalues, with deflation of
components that it does not touch and of equal eigenvalues, and takes the vectors from it by the formula that keeps them orthogonal.
Spectra of partitions are combined by successive rank-one updates too, in a tree. The leading vectors then
span a subspace that passes over all vectors refine by Rayleigh and Ritz, until the residual is that of rounding.

Values are whole numbers; what is centred is n x - S, exact, before it is divided by n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, prepare

SCALE, OFFSET = 64, 1_000_000
#: Vectors of a stretch; spectra that are combined at a time; halvings of a root's bracket, on its logarithm.
STRETCH, FAN, HALVINGS = 4096, 16, 64
EPS = np.finfo(float).eps
#: Entries beyond are taken as this, so that whole numbers stay exact as doubles.
LARGEST = 1 << 53
#: Eigenvalues below this part of the trace are rounding, not variance.
NOTHING = 1e-13


def _rotate_equal(values: np.ndarray, z: np.ndarray, vectors: np.ndarray, small: float) -> None:
    """Deflation of (nearly) equal eigenvalues: a rotation within their vectors leaves one of them untouched."""
    last = -1
    for i in np.flatnonzero(z):
        if last >= 0 and (values[i] - values[last]) * abs(z[i] * z[last]) <= small * (z[i] ** 2 + z[last] ** 2):
            r = np.hypot(z[i], z[last])
            c, s = z[i] / r, z[last] / r
            z[i], z[last] = r, 0.0
            vectors[:, [last, i]] = np.column_stack([c * vectors[:, last] - s * vectors[:, i], s * vectors[:, last] + c * vectors[:, i]])
            values[last], values[i] = values[last] * c * c + values[i] * s * s, values[last] * s * s + values[i] * c * c
        last = i


def secular(d: np.ndarray, z: np.ndarray) -> np.ndarray:
    """d[j] - root[i] for the roots of 1 + sum z[j]^2 / (d[j] - root) = 0, by halving; d rises strictly, no z is zero.

    Root i lies above d[i]. It is sought as a distance from the nearer of the d around it, so differences keep their digits.
    """
    k, squares = len(d), z * z
    gaps = np.append(np.diff(d), squares.sum())
    base = np.arange(k)
    middle = d + gaps / 2
    at = 1 + (squares / (d - middle[:, None])).sum(axis=1)
    right = (at < 0) & (base < k - 1)  # the root is nearer to the upper end
    base = base + right
    apart = d - d[base][:, None]
    away = np.abs(apart)
    away[np.arange(k), base] = np.inf
    high = np.where(np.arange(k) < k - 1, gaps / 2, gaps)
    low = np.minimum(squares[base] / (1 + 2 * (squares / away).sum(axis=1)), high)
    sign = np.where(right, -1.0, 1.0)
    low, high = np.log(low), np.log(high)
    for _ in range(HALVINGS):
        half = (low + high) / 2
        value = 1 + (squares / (apart - (sign * np.exp(half))[:, None])).sum(axis=1)
        inner = (value > 0) == (sign > 0)  # the root is nearer to the base
        high, low = np.where(inner, half, high), np.where(inner, low, half)
    return apart - (sign * np.exp((low + high) / 2))[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and vectors of the matrix that has ``values`` and ``vectors``, plus x x'."""
    z = vectors.T @ x
    length = np.sqrt(z @ z)
    scale = max(values[-1], length * length)
    if not length or not np.isfinite(scale):
        return values, vectors
    small = 8 * EPS * scale
    values, vectors = values.copy(), vectors.copy()
    z[np.abs(z) * length <= small] = 0.0
    _rotate_equal(values, z, vectors, small)
    z[np.abs(z) * length <= small] = 0.0
    active = np.flatnonzero(z)
    if len(active):
        order = active[np.argsort(values[active], kind="stable")]
        d, z = values[order], z[order]
        apart = secular(d, z)  # of root i, in row i
        ratio = apart / np.where(np.eye(len(d), dtype=bool), 1.0, d[None] - d[:, None])
        weight = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(z)  # the z of which these are the exact roots
        turned = weight[:, None] / apart.T
        turned /= np.sqrt((turned * turned).sum(axis=0))
        vectors[:, order] = vectors[:, order] @ turned
        values[order] = d - np.diag(apart)
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number, mean and scatter matrix (about the mean) of vectors, the matrix by its eigenvalues and vectors."""

    def __init__(self, dim: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(dim), np.zeros(dim), np.eye(dim)

    def _join(self, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
        """Takes in n vectors of that mean whose scatter matrix is rows' rows."""
        shift, total = mean - self.mean, self.n + n
        for x in [*rows, shift * np.sqrt(self.n * n / total)]:
            self.values, self.vectors = rank_one(self.values, self.vectors, x)
        self.n, self.mean = total, self.mean + shift * (n / total)

    def add(self, block: np.ndarray) -> None:
        mean = block.mean(axis=0)
        self._join(len(block), mean, np.linalg.qr(block - mean, mode="r"))

    def merge(self, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
        self._join(n, mean, rows[np.abs(rows).max(axis=1) > 0])

    @property
    def rows(self) -> np.ndarray:
        return (self.vectors * np.sqrt(np.maximum(self.values, 0))).T


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row of whole numbers as bytes of the least width that holds all of it: equal rows, equal bytes."""
    most = np.abs(x).max(axis=1)
    width = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
    out = np.empty(len(x), object)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        flat = x[at].astype(f"<i{w}").tobytes()
        size = w * x.shape[1]
        out[at] = [flat[k * size : (k + 1) * size] for k in range(len(at))]
    return out.tolist()


def _unpacked(keys: pa.Array, dim: int) -> np.ndarray:
    keys = keys.to_pylist()
    out = np.empty((len(keys), dim), np.int64)
    width = np.array([len(k) // dim for k in keys])
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join(keys[k] for k in at), f"<i{w}").reshape(-1, dim)
    return out


def _whole(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(64 c) of the entries of vectors of ``dim`` entries."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64).reshape(-1, dim)


def _sound(vector: str) -> Column:
    """Whether a vector is there, has entries, and none is null or not finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column(0)
        sizes = vectors.value_lengths().to_numpy()
        for dim in np.unique(sizes):
            some = vectors.take(pa.array(np.flatnonzero(sizes == dim)))
            keys = sorted(set(_packed(_whole(some, int(dim)))))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), dim, np.int32)), pa.array(keys, pa.binary())], names=["dim", "key"])


def _sum_bytes(sums: list[int]) -> bytes:
    return b"".join(int(s).to_bytes(16, "little", signed=True) for s in sums)


def _sum_ints(data: bytes) -> list[int]:
    return [int.from_bytes(data[k : k + 16], "little", signed=True) for k in range(0, len(data), 16)]


SPECTRUM = "slot long, n long, sums binary, mean binary, rows binary"


def _record(slot: int, spectrum: Spectrum, sums: list[int]) -> dict:
    return {"slot": slot, "n": spectrum.n, "sums": _sum_bytes(sums), "mean": spectrum.mean.tobytes(), "rows": spectrum.rows.tobytes()}


def _spectra(dim: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, sums, held = Spectrum(dim), [0] * dim, []
        for batch in batches:
            if batch.num_rows:
                held.append(_unpacked(batch.column(0), dim))
            if held and (size := sum(map(len, held))) >= STRETCH:
                held = _take_in(spectrum, sums, held, size - size % STRETCH)
        if held:
            _take_in(spectrum, sums, held, sum(map(len, held)))
        if spectrum.n:
            yield pa.RecordBatch.from_pylist([_record(TaskContext.get().partitionId(), spectrum, sums)])

    return run


def _take_in(spectrum: Spectrum, sums: list[int], held: list[np.ndarray], upto: int) -> list[np.ndarray]:
    x = np.concatenate(held)
    for low in range(0, upto, STRETCH):
        block = x[low : min(upto, low + STRETCH)]
        exact = block if np.abs(block).max() < 1 << 50 else block.astype(object)
        sums[:] = [a + int(b) for a, b in zip(sums, exact.sum(axis=0))]
        spectrum.add(block.astype(np.float64))
    return [x[upto:]] if upto < len(x) else []


def _merged(dim: int):  # noqa: ANN202
    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([_merge(dim, key[0].as_py(), table.sort_by("slot").to_pylist())])

    return run


def _merge(dim: int, slot: int, rows: list[dict]) -> dict:
    spectrum, sums = Spectrum(dim), [0] * dim
    for r in rows:
        spectrum.merge(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["rows"]).reshape(-1, dim))
        sums = [a + b for a, b in zip(sums, _sum_ints(r["sums"]))]
    return _record(slot, spectrum, sums)


class Centre:
    """The exact sums of n vectors, and n x - S of others."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        most = max(map(abs, sums), default=0)
        self.small = most < 1 << 62 and np.array(sums, np.int64)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, in 64 bits where they hold it, else as Python's numbers."""
        if self.small is not False and float(self.n) * max(1, int(np.abs(x).max(initial=0))) < 2**61:
            return self.n * x - self.small
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviation(self, x: np.ndarray) -> list:
        scaled = self.scaled(x)
        if np.abs(scaled).max(initial=0) >= 2.0**31 / np.sqrt(max(1, x.shape[1])):
            scaled = scaled.astype(object)
        return [v if -(1 << 63) <= v < 1 << 63 else None for v in map(int, (scaled * scaled).sum(axis=1))]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n


def _products(dim: int, centre: Centre, basis: np.ndarray):  # noqa: ANN202
    """Per partition: sum of y (y' basis), sum of |y|^2 and sum of y' basis of the centred vectors y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, square, plain = np.zeros((dim, basis.shape[1])), 0.0, np.zeros(basis.shape[1])
        for batch in batches:
            if batch.num_rows:
                y = centre.centred(_unpacked(batch.column(0), dim))
                onto = y @ basis
                both, square, plain = both + y.T @ onto, square + float((y * y).sum()), plain + onto.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([both.tobytes()]), pa.array([square]), pa.array([plain.tobytes()])], names=["slot", "both", "square", "plain"])

    return run


PRODUCTS = "slot long, both binary, square double, plain binary"


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("slot")
    add = lambda c: sum(np.frombuffer(x) for x in pdf[c]).tobytes()
    return pd.DataFrame({"slot": [pdf["slot"].iloc[0] // FAN], "both": [add("both")], "square": [pdf["square"].sum()], "plain": [add("plain")]})


def _passed(fit: DataFrame, dim: int, centre: Centre, basis: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """The sums of ``_products`` over all partitions, added up in a tree: the driver gets ``FAN`` rows at most."""
    sums, parts = fit.select("key").mapInArrow(lean(_products(dim, centre, basis)), PRODUCTS), fit.rdd.getNumPartitions()
    while parts > FAN:
        sums, parts = sums.groupBy(F.floor(F.col("slot") / FAN)).applyInPandas(_added, PRODUCTS), -(-parts // FAN)
    rows = sorted(sums.collect(), key=lambda r: r["slot"])
    shape = (dim, basis.shape[1])
    return sum(np.frombuffer(r["both"]) for r in rows).reshape(shape), sum(r["square"] for r in rows), sum(np.frombuffer(r["plain"]) for r in rows)


class Whitener:
    """Eigenvalues (falling) and unit vectors of the leading components, with the centre and quality of the fit."""

    def __init__(self, centre: Centre, dim: int, values: np.ndarray, vectors: np.ndarray, explained: np.ndarray, error: float):
        self.centre, self.dim, self.values, self.vectors, self.explained, self.error = centre, dim, values, vectors, explained, error

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def fit_whitener(vectors: DataFrame, components: int = 16, most_passes: int = 40) -> Whitener | None:
    """Fits on the distinct whole-number vectors of column ``vector``; None without any.

    Vectors of the commonest length (of equally common ones the longer) count. Components without
    variance are left out. The driver holds at most ``FAN`` spectra, dim x dim numbers each.
    """
    fit = materialize(vectors.where(_sound("vector")).select("vector").mapInArrow(lean(_keys), "dim int, key binary").distinct(), "distinct")
    common = fit.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return None
    dim, n = common["dim"], common["count"]
    fit = fit.where(F.col("dim") == dim).select("key")
    spectra, parts = fit.mapInArrow(lean(_spectra(dim)), SPECTRUM), fit.rdd.getNumPartitions()
    while parts > FAN:
        spectra, parts = spectra.groupBy(F.floor(F.col("slot") / FAN).alias("slot")).applyInArrow(_merged(dim), SPECTRUM), -(-parts // FAN)
    rows = sorted((r.asDict() for r in spectra.collect()), key=lambda r: r["slot"])
    merged = _merge(dim, 0, rows) if len(rows) > 1 else rows[0]
    centre = Centre(n, _sum_ints(merged["sums"]))
    scatter = np.frombuffer(merged["rows"]).reshape(dim, dim)  # rising
    lengths = np.sqrt((scatter * scatter).sum(axis=1))
    lead = np.flatnonzero(lengths > 0)[::-1][: max(4 * components, components + 32)]
    if not len(lead):
        return Whitener(centre, dim, np.empty(0), np.empty((dim, 0)), np.empty(0), 0.0)
    basis = np.linalg.qr((scatter[lead] / lengths[lead, None]).T)[0]
    for _ in range(most_passes):  # Rayleigh and Ritz within the subspace, which the matrix then turns further
        both, square, _plain = _passed(fit, dim, centre, basis)
        both = both / n
        inner = basis.T @ both
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, k = basis @ turn, min(components, len(values))
        residual = np.sqrt(((both @ turn - ritz * values)[:, :k] ** 2).sum(axis=0)).max()
        if basis.shape[1] == min(dim, n - 1) or residual <= 64 * EPS * dim * values[0]:
            break
        basis = np.linalg.qr(both @ turn)[0]
    trace = square / n
    k = int((values[:k] > NOTHING * trace).sum())
    values, ritz = values[:k], ritz[:, :k]
    ritz = ritz * np.where(ritz[np.abs(ritz).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    if not k:
        return Whitener(centre, dim, values, ritz, values, 0.0)
    white = ritz / np.sqrt(values)
    both, _square, plain = _passed(fit, dim, centre, white)
    error = np.abs(white.T @ both / n - np.outer(plain / n, plain / n) - np.eye(k)).max()
    return Whitener(centre, dim, values, ritz, values / trace, float(error))


def whiten(rows: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row of ``rows(vec_id, embedding)`` and component.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped, as are rows of another length than most distinct
    vectors have. Entries become x = floor(64 c) + 1000000 (64 c within +-2^53). The fit is over distinct x vectors; n is their number, deviation the
    exact sum of (n x - S)^2 with S the sums over them (null beyond a long). Components are at most as many as have variance: none
    for a single distinct vector. Null and repeated vec_ids give rows like any other; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    prepare(spark)
    rows = rows.select("vec_id", F.col("embedding").alias("vector"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit_whitener(rows.select("vector"), components)
    if fitted is None or not len(fitted.values):
        return spark.createDataFrame([], schema)
    model = spark.sparkContext.broadcast(fitted)  # one small matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        k = len(fitted.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch.column(1), fitted.dim)
            times = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(times), fitted.centre.n, np.int64)),
                pa.array(fitted.centre.deviation(x), pa.int64()).take(pa.array(times)), pa.array(fitted.project(x).ravel()), pa.array(np.tile(fitted.explained, len(x))), pa.array(np.full(len(times), fitted.error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(_sound("vector") & (F.size("vector") == fitted.dim)).mapInArrow(lean(run), schema)
