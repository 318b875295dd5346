"""Runs, discontinuities and top events: gaps and islands over frames and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.audio import finite


def regions(rows: DataFrame, holds: Column, least: int, at: str = "frame", keys: tuple[str, ...] = ("recording",)) -> DataFrame:
    """Maximal runs of rows where ``holds``, of at least ``least`` rows: start, end (exclusive), length."""
    order = Window.partitionBy(*keys).orderBy(at)
    run = rows.withColumn("holds", F.coalesce(holds, F.lit(False))).select(*keys, at, "holds").where("holds")
    run = run.withColumn("island", F.col(at) - F.row_number().over(order))
    out = run.groupBy(*keys, "island").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end"))
    return out.withColumn("length", F.col("end") - F.col("start")).where(F.col("length") >= least).drop("island")


def kept_regions(found: DataFrame, most: int = 1000) -> DataFrame:
    """The first ``most`` regions of each recording by start, numbered, each beside the ``total`` that there are."""
    every = Window.partitionBy("recording")
    out = found.withColumn("nth", F.row_number().over(every.orderBy("start"))).withColumn("total", F.count("*").over(every))
    return out.where(F.col("nth") <= most)


def zero_regions(frames: DataFrame, least: int) -> DataFrame:
    """All channels finite and exactly zero."""
    return regions(frames, finite("left") & finite("right") & (F.col("left") == 0) & (F.col("right") == 0), least)


def overrange_regions(frames: DataFrame) -> DataFrame:
    over = lambda c: finite(c) & (F.abs(c) > 1)
    return regions(frames, over("left") | over("right"), 1)


def invalid_regions(samples: DataFrame) -> DataFrame:
    """Per channel: samples that are not finite."""
    return regions(samples, ~finite("value"), 1, keys=("recording", "channel"))


def low_level_regions(steps: DataFrame, least: int = 10, level_db: float = -80.0, first: int = 50) -> DataFrame:
    """Quiet stretches of steps; the first ``first`` by time."""
    found = regions(steps, F.col("energy") <= 10 ** (level_db / 10), least, at="step")
    order = Window.partitionBy("recording").orderBy("start")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= first)


def negative_correlation_regions(steps: DataFrame, least: int = 10, limit: float = -0.25) -> DataFrame:
    return regions(steps, finite("correlation") & (F.col("correlation") < limit), least, at="step")


def _neighbours(samples: DataFrame) -> DataFrame:
    """Finite samples beside the finite one before: what lies between is bridged."""
    order = Window.partitionBy("recording", "channel").orderBy("frame")
    return samples.where(finite("value")).withColumn("before", F.lag("value").over(order)).withColumn("delta", F.abs(F.col("value") - F.col("before")))


def discontinuities(samples: DataFrame, threshold: float = 0.8) -> DataFrame:
    return _neighbours(samples).where(F.col("delta") >= threshold).select("recording", "channel", "frame", "delta")


def flat_tops(samples: DataFrame, level: float = 0.999, same: float = 1e-7, least: int = 3) -> DataFrame:
    """Runs of samples at the level that hardly change: true start, end (exclusive), length."""
    order = Window.partitionBy("recording", "channel").orderBy("frame")
    near = _neighbours(samples)
    broken = F.when((F.abs("value") >= level) & (F.col("delta") <= same) & (F.abs("before") >= level), 0).otherwise(1)
    runs = near.withColumn("run", F.sum(broken).over(order)).where(F.abs("value") >= level)
    out = runs.groupBy("recording", "channel", "run").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end"), F.count("*").alias("length"))
    return out.where(F.col("length") >= least).drop("run")


def top_regions(found: DataFrame, most: int = 50) -> DataFrame:
    """The longest regions of a recording, numbered by start."""
    longest = Window.partitionBy("recording").orderBy(F.desc("length"), "start")
    by_time = Window.partitionBy("recording").orderBy("start")
    return found.withColumn("nth", F.row_number().over(longest)).where(F.col("nth") <= most).withColumn("nth", F.row_number().over(by_time))


def top_events(events: DataFrame, by: str, most: int = 100, keys: tuple[str, ...] = ("recording",)) -> DataFrame:
    """The greatest events per key; ties by frame, then channel."""
    order = Window.partitionBy(*keys).orderBy(F.desc(by), "frame", "channel")
    return events.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
