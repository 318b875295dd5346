"""Numpy kernels over batches of sample rows: filters, interpolation, runs. No Spark here."""

from __future__ import annotations

import functools

import numpy as np

CHUNK = 128


def k_coefficients(rate: float) -> list[np.ndarray]:
    """(b0, b1, b2, a1, a2) of the shelf and of the high-pass that weight loudness (their constants are fixed values)."""
    f, gain, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
    k, high = np.tan(np.pi * f / rate), 10 ** (gain / 20)
    band, a0 = high**0.4996667741545416, 1 + k / q + k * k
    shelf = np.array([(high + band * k / q + k * k) / a0, 2 * (k * k - high) / a0, (high - band * k / q + k * k) / a0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    f, q = 38.13547087602444, 0.5003270373238773
    k = np.tan(np.pi * f / rate)
    a0 = 1 + k / q + k * k
    return [shelf, np.array([1 / a0, -2 / a0, 1 / a0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])]


def _step(x: np.ndarray, state: np.ndarray, sections: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One sample of each row through both sections; two numbers of state a section."""
    state = state.copy()
    for s, (b0, b1, b2, a1, a2) in enumerate(sections):
        y = b0 * x + state[:, 2 * s]
        state[:, 2 * s] = b1 * x - a1 * y + state[:, 2 * s + 1]
        state[:, 2 * s + 1] = b2 * x - a2 * y
        x = y
    return x, state


@functools.lru_cache(maxsize=16)
def _matrices(rate: float) -> tuple[np.ndarray, np.ndarray]:
    """What ``CHUNK`` samples and the state before them give: (outputs and next state) by (inputs and state)."""
    sections = k_coefficients(rate)
    n = CHUNK + 4
    state, outputs = np.vstack([np.zeros((CHUNK, 4)), np.eye(4)]), []
    for i in range(CHUNK):
        x = np.zeros(n)
        x[i] = 1.0
        y, state = _step(x, state, sections)
        outputs.append(y)
    return np.stack(outputs, axis=1), state


def k_weight(rows: np.ndarray, rate: float) -> np.ndarray:
    """Rows of samples through the weighting filter from rest, a chunk of all rows at a time."""
    to_output, to_state = _matrices(float(rate))
    length = rows.shape[1]
    padded = np.pad(rows, ((0, 0), (0, -length % CHUNK)))
    out, state = np.empty_like(padded, dtype=float), np.zeros((len(rows), 4))
    for at in range(0, padded.shape[1], CHUNK):
        given = np.hstack([padded[:, at : at + CHUNK], state])
        out[:, at : at + CHUNK], state = given @ to_output, given @ to_state
    return out[:, :length]


def peak_factor(rate: float) -> int:
    return 1 if rate >= 192_000 else 2 if rate >= 96_000 else 4


def peak_phases(factor: int, taps: int = 49) -> list[list[tuple[int, float]]]:
    """Per phase the (lag, coefficient) pairs of a Hann-windowed sinc; tiny coefficients are left out."""
    t = np.arange(taps)
    c = np.sinc((t - (taps - 1) / 2) / factor) * 0.5 * (1 - np.cos(2 * np.pi * t / (taps - 1)))
    return [[(int(i // factor), float(c[i])) for i in t[p::factor] if abs(c[i]) > 1e-6] for p in range(factor)]


def true_peak(samples: np.ndarray, history: np.ndarray, rate: float, last: bool, start: int) -> tuple[float, float]:
    """(greatest absolute value between and at samples, its frame) of one block; the filter is flushed after the last block."""
    best, frame = (float(np.abs(samples).max()), float(start + int(np.abs(samples).argmax()))) if len(samples) else (0.0, float(start))
    factor = peak_factor(rate)
    if factor == 1:
        return best, frame
    delay, group = -(-49 // factor), 48 / (2 * factor)
    before = np.concatenate([np.zeros(max(0, delay - len(history))), history[-delay:]]) if len(history) else np.zeros(delay)
    x = np.concatenate([before, samples, np.zeros(delay if last else 0)])
    n = len(x) - delay
    found = np.zeros((n, factor))
    for p, pairs in enumerate(peak_phases(factor)):
        for lag, c in pairs:
            found[:, p] += c * x[delay - lag : delay - lag + n]
    at = int(np.abs(found).argmax())
    value = float(np.abs(found).ravel()[at])
    if value > best:
        return value, start + at // factor - group + at % factor / factor
    return best, frame


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the stretches where flags hold."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def spectrum_levels(frame: np.ndarray, floor_db: float) -> np.ndarray:
    """Hann window, FFT magnitude in dB (at least -140), mapped to 0 .. 255 above the floor."""
    n = len(frame)
    magnitude = np.abs(np.fft.rfft(frame * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))))[: n // 2]
    level = np.maximum(-140.0, 20 * np.log10(np.maximum(magnitude * 4 / n, 1e-300)))
    return np.floor(255 * np.clip((level - floor_db) / -floor_db, 0, 1) + 0.5).astype(np.int16)


@functools.lru_cache(maxsize=16)
def _one_pole_matrix(alpha: float) -> np.ndarray:
    """What ``CHUNK`` samples and the output before them give: outputs by (inputs and output before)."""
    lag = np.arange(CHUNK)[None] - np.arange(CHUNK)[:, None]
    inputs = np.where(lag >= 0, alpha * (1 - alpha) ** np.maximum(lag, 0), 0.0)
    return np.vstack([inputs, (1 - alpha) ** np.arange(1, CHUNK + 1)])


def one_pole(rows: np.ndarray, hertz: float, rate: float) -> np.ndarray:
    """Rows of samples through a one-pole low-pass from rest, a chunk of all rows at a time."""
    matrix = _one_pole_matrix(float(1 - np.exp(-2 * np.pi * hertz / rate)))
    length = rows.shape[1]
    padded = np.pad(rows, ((0, 0), (0, -length % CHUNK)))
    out, before = np.empty_like(padded, dtype=float), np.zeros((len(rows), 1))
    for at in range(0, padded.shape[1], CHUNK):
        out[:, at : at + CHUNK] = np.hstack([padded[:, at : at + CHUNK], before]) @ matrix
        before = out[:, at + CHUNK - 1 : at + CHUNK]
    return out[:, :length]


def low_frequency(left: np.ndarray, right: np.ndarray | None, rate: float) -> dict[str, np.ndarray]:
    """By row (a window each): shares of energy below 20 and 120 Hz and above, by one-pole filters from rest, and the low band's correlation.

    Without energy, without a right channel, or without variance the figure is NaN. Rows may end in zeros.
    """
    channels = [x for x in (left, right) if x is not None]
    below, beneath = ([one_pole(x, hertz, rate) for x in channels] for hertz in (120, 20))
    power = lambda parts: sum((p * p).sum(axis=1) for p in parts)
    total = power(channels)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = lambda parts: np.where(total > 0, np.clip(100 * power(parts) / total, 0, 100), np.nan)
        out = {"subsonic_pct": share(beneath), "low_pct": share(below), "above_120_pct": share([x - b for x, b in zip(channels, below, strict=True)]), "low_correlation": np.full(len(left), np.nan)}
        if len(below) == 2:
            a, b = (y - y.mean(axis=1, keepdims=True) for y in below)
            bottom = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            out["low_correlation"] = np.where(bottom > 0, np.clip((a * b).sum(axis=1) / bottom, -1, 1), np.nan)
    return out


def gated_prefix_means(values: np.ndarray, ends: np.ndarray, floor: float, relative: float) -> np.ndarray:
    """For each end the mean of the values up to it (inclusive) that are above ``floor`` and above ``relative`` times their own mean; NaN if none is.

    How many of a prefix are below its gate, and their sum, come from sorted stretches: a prefix is made of at most one
    aligned stretch of every power of two, and each length's stretches are sorted at once.
    """
    some = np.flatnonzero(values > floor)
    v = values[some]
    upto = np.searchsorted(some, ends, "right")
    whole = np.append(0.0, np.cumsum(v))[upto]
    with np.errstate(divide="ignore", invalid="ignore"):
        gate = whole / upto * relative
    order = np.sort(v)
    rank, below = np.searchsorted(order, v, "left"), np.searchsorted(order, gate, "right")  # those of a lower rank than that are below
    size, count, total = len(v), np.zeros(len(ends)), np.zeros(len(ends))
    for level in range(size.bit_length()):
        length = 1 << level
        asks = np.flatnonzero(upto >> level & 1)
        rows = size >> level
        if not len(asks):
            continue
        nth = np.argsort(rank[: rows * length].reshape(rows, length), axis=1, kind="stable")
        keys = np.take_along_axis(rank[: rows * length].reshape(rows, length), nth, axis=1)
        sums = np.cumsum(np.take_along_axis(v[: rows * length].reshape(rows, length), nth, axis=1)[:, ::-1], axis=1)[:, ::-1]  # from the greatest down
        row = upto[asks] >> (level + 1) << 1
        flat = (keys + np.arange(rows)[:, None] * (size + 1)).ravel()
        at = np.searchsorted(flat, row * (size + 1) + below[asks], "left") - row * length
        count[asks] += length - at
        total[asks] += np.where(at < length, sums[row, np.minimum(at, length - 1)], 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(count > 0, total / count, np.nan)


def dither(index: np.ndarray, seed: int) -> np.ndarray:
    """Triangular noise of interleaved sample indices: the difference of two draws of a counter generator, in 32-bit arithmetic."""

    def draw(k: np.ndarray) -> np.ndarray:
        s = np.uint32(seed & 0xFFFFFFFF) + k.astype(np.uint32) * np.uint32(0x6D2B79F5)
        v = (s ^ s >> np.uint32(15)) * (s | np.uint32(1))
        v ^= v + (v ^ v >> np.uint32(7)) * (v | np.uint32(61))
        return (v ^ v >> np.uint32(14)) / 2.0**32

    with np.errstate(over="ignore"):
        index = index.astype(np.uint64)
        return draw((2 * index + 1) & np.uint64(0xFFFFFFFF)) - draw((2 * index + 2) & np.uint64(0xFFFFFFFF))


def payload(samples: np.ndarray, bits: int, encoding: str, noise: np.ndarray | float = 0.0) -> bytes:
    """Interleaved samples as the bytes of a file: 16, 24 or 32-bit integers with ``noise`` (in steps), or 32-bit floats; what is not finite is 0."""
    clean = np.where(np.isfinite(samples), samples, 0.0)
    if encoding == "float":
        return clean.astype("<f4").tobytes()
    scale = 2.0 ** (bits - 1)
    whole = np.floor(np.clip(samples + noise / scale, -1, 1 - 1 / scale) * scale + 0.5)
    whole = np.where(np.isfinite(samples), whole, 0.0).astype("<i4")
    return whole.astype("<i2").tobytes() if bits == 16 else whole.tobytes() if bits == 32 else whole.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
