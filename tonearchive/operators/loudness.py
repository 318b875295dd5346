"""Gated loudness, loudness range, rolling windows and segments over step tables (recording, step, energy)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.audio import OFFSET, db, energy, finite, half_up, lufs, power_db

#: Absolute gate in LUFS; relative gates as factors of the mean (10 and 20 LU below).
ABSOLUTE, RELATIVE, RANGE_RELATIVE = -70.0, 0.1, 0.01


def rolling_energy(steps: DataFrame, n: int, to: str, of: str = "energy") -> DataFrame:
    """Mean of the last ``n`` steps; null unless all of them are there and finite."""
    window = Window.partitionBy("recording").orderBy("step").rowsBetween(-(n - 1), 0)
    x = F.when(finite(of), F.col(of))
    return steps.withColumn(to, F.when(F.count(x).over(window) == n, F.avg(x).over(window)))


def integrated_lufs(momentary: DataFrame) -> DataFrame:
    """Per recording: mean momentary energy above the absolute and the relative gate, in LUFS; null if nothing passes.

    The gate of a recording is a window over its rows, so one shuffle by recording serves both passes.
    """
    every = Window.partitionBy("recording")
    above = F.when(F.col("momentary") > energy(F.lit(ABSOLUTE)), F.col("momentary"))
    gated = momentary.withColumn("above", above).withColumn("gate", F.avg(above).over(every) * RELATIVE)
    return gated.groupBy("recording").agg(lufs(F.avg(F.when(F.col("above") > F.col("gate"), F.col("above")))).alias("integrated"))


def loudness_range(short_term: DataFrame) -> DataFrame:
    """Per recording: the 95th less the 10th percentile of gated short-term loudness."""
    every = Window.partitionBy("recording")
    above = F.when(F.col("short_term") > energy(F.lit(ABSOLUTE)), F.col("short_term"))
    gated = short_term.withColumn("above", above).withColumn("gate", F.avg(above).over(every) * RANGE_RELATIVE)
    level = lufs(F.when(F.col("above") > F.col("gate"), F.col("above")))
    return gated.groupBy("recording").agg((F.percentile(level, 0.95) - F.percentile(level, 0.1)).alias("loudness_range"))


def max_loudness(steps: DataFrame, n: int, step_seconds: float) -> DataFrame:
    """Greatest rolling mean and the first window that reaches it: loudness and the window's end in seconds."""
    rolled = rolling_energy(steps, n, "rolled")
    best = rolled.groupBy("recording").agg(F.max(F.struct("rolled", (-F.col("step")).alias("back"))).alias("m"), ((F.max("step") + 1) * step_seconds).alias("duration"))
    return best.select("recording", lufs("m.rolled").alias("loudness"), F.when(F.col("m.rolled").isNotNull(), F.least((1 - F.col("m.back")) * step_seconds, "duration")).alias("seconds"))


def running_integrated(momentary: DataFrame, every: int = 10) -> DataFrame:
    """Integrated loudness so far, refreshed at every tenth step and at the end, carried forward between.

    One recording's steps make one group of ten numbers a second; a day of them takes about a second (n log^2 n, without a loop over steps).
    """
    floor = 10 ** ((ABSOLUTE - OFFSET) / 10)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("step")
        values = np.nan_to_num(group["momentary"].to_numpy(dtype=float), nan=0.0)
        number = np.arange(len(group))
        refresh = np.flatnonzero((number % every == every - 1) | (number == len(group) - 1))
        return pd.DataFrame({"recording": group["recording"].to_numpy()[refresh], "step": group["step"].to_numpy()[refresh], "refreshed": kernels.gated_prefix_means(values, refresh, floor, RELATIVE)})

    found = momentary.select("recording", "step", "momentary").groupBy("recording").applyInPandas(run, "recording long, step long, refreshed double")
    found = found.withColumn("refreshed", F.when(~F.isnan("refreshed"), F.col("refreshed")))
    so_far = Window.partitionBy("recording").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return momentary.join(found, ["recording", "step"], "left").withColumn("running", lufs(F.last("refreshed", ignorenulls=True).over(so_far)))


def temporal_segments(steps: DataFrame, step_seconds: float = 0.1, most: int = 720, grain: int = 5, low_level_db: float = -80.0) -> DataFrame:
    """Per segment of ``max(5, ceil(duration / 720 / 5) * 5)`` seconds: loudness to a tenth, peak, silence in whole percent, correlation to a hundredth.

    A step belongs to every segment it touches. Silence is the share of steps with a level whose RMS is at or below
    ``low_level_db``. Columns needed: momentary, short_term, raw_energy, peak, correlation.
    """
    duration = steps.groupBy("recording").agg(((F.max("step") + 1) * step_seconds).alias("duration"))
    width = F.greatest(F.lit(grain), F.ceil(F.col("duration") / most / grain) * grain)
    sized = steps.join(duration.select("recording", "duration", width.alias("width")), "recording")
    first, last = F.floor(F.col("step") * step_seconds / F.col("width") + 1e-9), F.ceil((F.col("step") + 1) * step_seconds / F.col("width") - 1e-9) - 1
    placed = sized.withColumn("segment", F.explode(F.sequence(first, F.greatest(first, last)))).withColumn("start_s", F.col("segment") * F.col("width"))
    m, s, rms, r = lufs("momentary"), lufs("short_term"), power_db("raw_energy"), F.when(finite("correlation"), F.col("correlation"))
    return placed.groupBy("recording", "segment", "start_s", F.least("duration", F.col("start_s") + F.col("width")).alias("end_s")).agg(
        half_up(F.percentile(m, 0.1), 1).alias("m_p10"), half_up(F.percentile(m, 0.5), 1).alias("m_median"), half_up(F.max(m), 1).alias("m_max"), half_up(F.percentile(s, 0.5), 1).alias("s_median"), half_up(F.max(s), 1).alias("s_max"),
        half_up(F.max(db("peak")), 1).alias("peak_db"), half_up(100.0 * F.count_if(rms <= low_level_db) / F.nullif(F.count(rms), F.lit(0))).alias("silence_pct"),
        half_up(F.percentile(r, 0.5), 2).alias("correlation_median"), half_up(F.min(r), 2).alias("correlation_min"),
    )
