"""Spectral screening: windows, low-frequency shares, mains hum, spectrograms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels

MOST_WINDOWS, WINDOW_SECONDS, SCREEN_RATE = 12, 5.0, 4000


def spectral_windows(recordings: DataFrame, rate: int, count: int = MOST_WINDOWS, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Evenly spaced windows (recording, start, length -> window_start, window_end), at most twelve, each start once."""
    n = max(1, min(MOST_WINDOWS, count))
    size = F.least(F.col("length"), F.lit(int(seconds * rate)))
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    begin = F.floor(F.col("start") + (F.col("length") - F.col("size")) * F.col("i") / max(1, n - 1) + 0.5)
    return recordings.withColumn("size", size).withColumn("i", at).select("recording", begin.alias("window_start"), (begin + F.col("size")).alias("window_end")).distinct()


def screened(frames: DataFrame, windows: DataFrame, rate: int) -> DataFrame:
    """Every stride-th frame of each window, at about ``SCREEN_RATE`` (no filter before)."""
    stride = max(1, rate // SCREEN_RATE)
    inside = (F.col("frame") >= F.col("window_start")) & (F.col("frame") < F.col("window_end")) & ((F.col("frame") - F.col("window_start")) % stride == 0)
    return frames.join(windows, "recording").where(inside).withColumn("i", F.floor((F.col("frame") - F.col("window_start")) / stride))


def low_frequency_metrics(part: DataFrame, rate: float, together: int = 64) -> DataFrame:
    """Per window (recording, window_start, i, left, right): energy shares and the low band's correlation; without a right channel (null) no correlation.

    Windows are gathered as arrays (five seconds each at most) and filtered some ``together`` at a time, a chunk of all of them in one product.
    """
    kind = "recording long, window_start long, subsonic_pct double, low_pct double, above_120_pct double, low_correlation double"

    def measured(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["recording", "window_start"]].copy()
        for stereo, rows in pdf.groupby(pdf["right"].map(lambda x: x is not None and len(x) > 0)):
            for length, same in rows.groupby(rows["left"].map(len)):  # one length, as a rule
                left = np.array(same["left"].tolist(), float).reshape(len(same), length)
                right = np.array(same["right"].tolist(), float).reshape(len(same), length) if stereo else None
                for name, values in kernels.low_frequency(left, right, rate).items():
                    out.loc[same.index, name] = values
        return out.astype(object).where(out.notna(), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), together):
                yield measured(pdf.iloc[at : at + together].reset_index(drop=True))

    ordered = F.array_sort(F.collect_list(F.struct("i", "left", "right")))
    side = lambda c: F.transform("rows", lambda x: x[c])
    gathered = part.groupBy("recording", "window_start").agg(ordered.alias("rows"), F.count("right").alias("n"))
    return gathered.select("recording", "window_start", side("left").alias("left"), F.when(F.col("n") > 0, side("right")).alias("right")).mapInPandas(run, kind)


def mains_hum(part: DataFrame, rate: float, base: float = 50.0, harmonics: int = 4) -> DataFrame:
    """Per window (recording, window_start, i, value): power at 50 Hz and the greatest of its harmonics, relative to all, in dB."""
    sums = [F.count("*").alias("n"), F.sum(F.col("value") * F.col("value")).alias("all")]
    for h in range(1, harmonics + 1):
        angle = F.col("i") * (2 * math.pi * base * h / rate)
        sums += [F.sum(F.col("value") * F.cos(angle)).alias(f"c{h}"), F.sum(F.col("value") * F.sin(angle)).alias(f"s{h}")]
    got = part.groupBy("recording", "window_start").agg(*sums)

    def level(h: int) -> Column:
        power = (F.col(f"c{h}") * F.col(f"c{h}") + F.col(f"s{h}") * F.col(f"s{h}")) / (F.col("n") * F.col("all"))
        return F.when((F.col("all") > 0) & (power > 0), 10 * F.log10(power))

    return got.select("recording", "window_start", level(1).alias("hum_db"), F.greatest(*[level(h) for h in range(1, harmonics + 1)]).alias("highest_db"))


def spectrogram(blocks: DataFrame, block_frames: int, fft: int, columns: int, floor_db: float = -100.0) -> DataFrame:
    """recording, channel, column, levels: only the blocks that a column overlaps are gathered for it (fft / block + 2 at most)."""
    lengths = blocks.groupBy("recording", "channel").agg(F.max(F.col("start_frame") + F.size("samples")).alias("frames"))
    column = lengths.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    centre = F.floor((F.col("column") + 0.5) / columns * F.col("frames") + 0.5)
    column = column.withColumn("begin", F.greatest(F.lit(0), F.least(F.col("frames") - fft, centre - fft // 2)).cast("long"))
    needed = column.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("begin") / block_frames), F.floor((F.col("begin") + fft - 1) / block_frames))))
    parts = needed.join(blocks.select("recording", "channel", "block_no", "samples"), ["recording", "channel", "block_no"])
    gathered = parts.groupBy("recording", "channel", "column", "begin").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "samples"))), lambda b: b["samples"])).alias("all"))
    cut = F.slice("all", (F.col("begin") % block_frames + 1).cast("int"), fft)

    @F.pandas_udf("array<smallint>")
    def levels(frames: pd.Series) -> pd.Series:
        return frames.map(lambda f: kernels.spectrum_levels(np.pad(np.asarray(f, float), (0, fft - len(f))), floor_db))

    return gathered.select("recording", "channel", "column", levels(cut).alias("levels"))


def log_frequency_rows(spectra: DataFrame, nyquist: float, rows: int = 256, highest: float | None = None) -> DataFrame:
    """Each column's levels at ``rows`` frequencies spaced evenly by ratio, highest first."""
    top = max(40.0, min(nyquist, highest or nyquist))
    low = min(20.0, top / 10)
    y = F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))
    frequency = low * F.pow(F.lit(top / low), 1 - F.col("y") / max(1, rows - 1))
    bins = F.size("levels")
    place = F.greatest(F.lit(0), F.least(bins - 1, F.floor(frequency / nyquist * bins + 0.5)))
    return spectra.withColumn("y", y).withColumn("level", F.element_at("levels", (place + 1).cast("int"))).drop("levels")
