"""The whole analysis of recordings from one pass over their blocks: figures, regions, findings and markers.

Paired blocks (recording, block_no, start_frame, sample_rate, samples, halo, last) are read once. Each gives tagged
partial rows: sums of the steps that it touches, extremes and sums of its channels, and marks of runs and events. They
are written once, by kind; all that follows joins small rows where blocks touch, so no sample is read or sent twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.audio import db, finite, power_db
from ..sources.documents import work_path
from . import blocks, loudness, regions
from .markers import all_markers
from .rules import KEPT_REGIONS, observations
from .stats import correlation

#: Limits of findings (fixed values): a jump, a plateau and its samples, silence and low level in seconds, markers of a kind.
JUMP, PLATEAU, PLATEAU_SAMPLES, ZERO_SECONDS, LOW_SECONDS, LOW_DB, MOST_EVENTS = 0.8, 0.999, 3, 0.1, 1.0, -80.0, 100
STEP, FINE = 0.1, 0.01
_STEP = ("peak", *blocks._SUMS)
_CHANNEL = ("n", "sum", "squares", "peak", "peak_frame", "highest", "lowest", "zeros", "overrange", "not_finite", "true_peak", "true_frame")
PARTS = "recording string, part string, channel int, at long, start long, end long, count long, first boolean, last boolean, rate int, v array<double>"


def _channel_part(x: np.ndarray, halo: np.ndarray, rate: int, last: bool, start: int) -> list[float]:
    good = x[np.isfinite(x)]
    size = np.abs(np.where(np.isfinite(x), x, 0.0))
    peak, frame = kernels.true_peak(np.where(np.isfinite(x), x, 0.0), np.where(np.isfinite(halo), halo, 0.0), rate, last, start)
    ends = (good.max(), good.min()) if len(good) else (np.nan, np.nan)
    return [len(good), good.sum(), (good * good).sum(), size.max(initial=0.0), start + int(size.argmax()) if len(size) else start, *ends, (good == 0).sum(), (size > 1).sum(), len(x) - len(good), peak, frame]


def _block_rows(recording: str, start: int, rate: int, sides: list[np.ndarray], halos: list[np.ndarray], last: bool, weighted: list[np.ndarray]) -> Iterator[dict]:
    """All partial rows of one block."""
    n = len(sides[0])
    base = {"recording": recording, "rate": rate}
    step, frames, sums, peak = blocks.stereo_parts(sides, weighted, start, max(1, round(rate * STEP)))
    for k in range(len(step)):
        yield base | {"part": "step", "channel": len(sides), "at": int(step[k]), "count": int(frames[k]), "v": [float(peak[k]), *sums[:, k].tolist()]}
    fine = (start + np.arange(n)) // max(1, round(rate * FINE))
    first = np.flatnonzero(np.diff(fine, prepend=fine[0] - 1))
    energy = np.add.reduceat(sum(w * w for w in weighted), first)
    for k, c, e in zip(fine[first].tolist(), np.diff(np.append(first, n)).tolist(), energy.tolist(), strict=True):
        yield base | {"part": "fine", "at": k, "count": c, "v": [e]}
    for c, (x, h) in enumerate(zip(sides, halos, strict=True)):
        yield base | {"part": "channel", "channel": c, "start": start, "end": start + n, "v": [float(y) for y in _channel_part(x, h, rate, last, start)]}
        for m in blocks.marks_of(x, start, 1.0, PLATEAU, 1e-7, JUMP, PLATEAU_SAMPLES):
            if m["kind"] not in ("zero", "overrange"):
                values = [m[k] for k in ("first_value", "last_value", "value") if k in m]
                yield base | {"part": m["kind"], "channel": c, "at": start, "v": values} | {k: m[k] for k in ("start", "end", "count", "first", "last") if k in m}
    both = np.stack(sides)
    good = np.isfinite(both)
    for kind, flags in (("zero", (good & (both == 0)).all(axis=0)), ("overrange", (good & (np.abs(both) > 1)).any(axis=0))):
        for a, b in zip(*(k.tolist() for k in kernels.runs(flags)), strict=True):
            yield base | {"part": kind, "start": start + a, "end": start + b, "count": b - a}
    if len(sides) == 2 and good.all(axis=0).any():
        mid = np.where(good.all(axis=0), np.abs(both.sum(axis=0)) / 2, -1.0)
        yield base | {"part": "mono", "at": start + int(mid.argmax()), "v": [float(mid.max())]}


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in PARTS.split(", "))])
_EMPTY = dict.fromkeys(_SCHEMA.names)


def block_parts(paired: DataFrame) -> DataFrame:
    """``PARTS`` of all blocks, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rate, group in batch.to_pandas().groupby("sample_rate"):
                sides = [[np.asarray(c, float) for c in r] for r in group["samples"]]
                halos = [[np.asarray(c, float) for c in r] for r in group["halo"]]
                flat = [(h, s) for hs, ss in zip(halos, sides, strict=True) for h, s in zip(hs, ss, strict=True)]
                done = iter(blocks._filtered([blocks._clean(h) for h, _ in flat], [blocks._clean(s) for _, s in flat], rate))
                rows = []
                for recording, start, last, s, h in zip(group["recording"], group["start_frame"], group["last"], sides, halos, strict=True):
                    weighted = [next(done) for _ in s]
                    if s and len(s[0]):
                        rows += [_EMPTY | r for r in _block_rows(recording, int(start), int(rate), s, h, bool(last), weighted)]
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return paired.select(F.col("recording").cast("string").alias("recording"), "start_frame", "sample_rate", "samples", "halo", "last").mapInArrow(run, PARTS)


def _named(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return rows.select("*", *[F.get("v", F.lit(k)).alias(n) for k, n in enumerate(names)])


@dataclass
class Analysis:
    """Tables by recording: steps (with momentary, short_term and running loudness), channels, summary, regions and events by kind, findings, markers."""

    steps: DataFrame
    channels: DataFrame
    summary: DataFrame
    regions: dict[str, DataFrame]
    observations: DataFrame
    markers: DataFrame


def _channels(parts: DataFrame) -> DataFrame:
    """Figures of each channel from its blocks' rows; the first frame of a peak counts."""
    each = _named(parts.where("part = 'channel'"), _CHANNEL)
    first = lambda at, of: F.min_by(at, F.struct(-F.col(of), at))
    some = lambda c: F.when(finite(c), F.col(c))
    out = each.groupBy("recording", "channel").agg(
        F.max("rate").alias("rate"), F.max("end").alias("frames"), *[F.sum(c).alias(c) for c in ("n", "sum", "squares")], *[F.sum(c).cast("long").alias(c) for c in ("zeros", "overrange", "not_finite")], F.max("peak").alias("peak"), first("peak_frame", "peak").alias("peak_frame"),
        F.max(some("highest")).alias("highest"), F.min(some("lowest")).alias("lowest"), F.max("true_peak").alias("true_peak"), first("true_frame", "true_peak").alias("true_frame"),
    )
    rms = F.when(F.col("n") > 0, F.sqrt(F.col("squares") / F.col("n")))
    true_frame = F.greatest(F.lit(0.0), F.least("true_frame", F.col("frames") - 1.0))
    out = out.withColumns({"dc_offset": F.when(F.col("n") > 0, F.col("sum") / F.col("n")), "rms": rms, "true_frame": true_frame})
    return out.withColumns({"crest_db": F.when(F.col("rms") > 0, 20 * F.log10(F.col("peak") / F.col("rms"))), "peak_s": F.col("peak_frame") / F.col("rate"), "true_peak_s": F.col("true_frame") / F.col("rate")}).drop("sum", "squares")


def _steps(parts: DataFrame) -> DataFrame:
    """The step table with rolling energies, and the recording's stereo sums beside it."""
    rows = _named(parts.where("part = 'step'"), _STEP).withColumnsRenamed({"at": "step", "count": "frames"})
    summed = rows.groupBy("recording", "step").agg(F.max("channel").alias("channels"), F.sum("frames").alias("frames"), F.max("rate").alias("rate"), F.max("peak").alias("peak"), *[F.sum(c).alias(c) for c in blocks._SUMS])
    n, two, full = F.col("frames"), F.col("channels") > 1, F.col("frames") == F.greatest(F.lit(1), F.floor(F.col("rate") * STEP + 0.5))
    return summed.select(
        "*", F.when(full, F.col("k") / n).alias("energy"), ((F.col("l2") + F.col("r2")) / (F.col("channels") * n)).alias("raw_energy"),
        F.when(two & (F.col("n_both") > 0), correlation(*[F.col(c) for c in ("n_both", "sl", "sr", "sll", "srr", "slr")])).alias("correlation"),
        F.when(F.col("srr") > 0, power_db(F.col("sll") / F.col("srr"))).alias("balance_db"), F.when(F.col("ss") > 0, power_db(F.col("mm") / F.col("ss"))).alias("mid_side_db"),
    )


def _stereo(steps: DataFrame, parts: DataFrame) -> DataFrame:
    """Correlation, balance, mid/side and mono fold-down of each recording of two channels, from the sums of its steps."""
    s = steps.where("channels > 1").groupBy("recording").agg(*[F.sum(c).alias(c) for c in ("n_both", "sl", "sr", "sll", "srr", "slr", "mm", "ss")], (100.0 * F.count_if(finite("correlation") & (F.col("correlation") < -0.25)) / F.nullif(F.count_if(finite("correlation")), F.lit(0))).alias("negative_pct"))
    mono = _named(parts.where("part = 'mono'"), ("mid",)).groupBy("recording").agg(F.max("mid").alias("mono_peak"), F.min_by("at", F.struct(-F.col("mid"), "at")).alias("mono_peak_frame"))
    reference = (F.col("sll") + F.col("srr")) / 2
    delta = F.when(reference > 0, F.when(F.col("mm") > 0, 10 * F.log10(F.col("mm") / reference)).otherwise(-300.0))
    out = s.where("n_both > 0").select(
        "recording", correlation(*[F.col(c) for c in ("n_both", "sl", "sr", "sll", "srr", "slr")]).alias("correlation"), F.when(F.col("srr") > 0, power_db(F.col("sll") / F.col("srr"))).alias("balance_db"), F.when(F.col("ss") > 0, power_db(F.col("mm") / F.col("ss"))).alias("mid_side_db"),
        delta.alias("mono_delta_db"), "negative_pct", F.col("n_both").cast("long").alias("valid_frames"),
    )
    return out.join(mono, "recording", "left")


def _runs(parts: DataFrame, kind: str, keys: tuple[str, ...] = ("recording",)) -> DataFrame:
    """Runs of a kind, joined where blocks touch."""
    order = Window.partitionBy(*keys).orderBy("start")
    each = parts.where(F.col("part") == kind).withColumn("fresh", ~F.coalesce(F.lag("end").over(order) == F.col("start"), F.lit(False)))
    return blocks._joined(each, F.col("fresh"), keys)


def _kept(found: DataFrame, most: int, by: Column) -> DataFrame:
    order = Window.partitionBy("recording").orderBy(by.desc(), "start_s")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth")


def analyze(paired: DataFrame, layouts: DataFrame) -> Analysis:
    """Everything that is told about recordings, from their paired blocks and their rows of ``wav_inventory`` (recording, truncated)."""
    spark = paired.sparkSession
    path = work_path(spark, "parts")
    block_parts(paired).write.partitionBy("part").parquet(path)
    parts = spark.read.schema(PARTS).parquet(path)

    channels, steps = _channels(parts), _steps(parts)
    steps = loudness.rolling_energy(loudness.rolling_energy(steps, 4, "momentary"), 30, "short_term")
    fine = _named(parts.where("part = 'fine'"), ("k",)).groupBy("recording", F.col("at").alias("step")).agg(F.sum("count").alias("n"), F.sum("k").alias("k"), F.max("rate").alias("rate"))
    fine = fine.withColumn("energy", F.when(F.col("n") == F.greatest(F.lit(1), F.floor(F.col("rate") * FINE + 0.5)), F.col("k") / F.col("n")))
    lengths = channels.groupBy("recording").agg(F.max("frames").alias("frames"), F.max("rate").alias("rate")).withColumn("duration", F.col("frames") / F.col("rate"))
    rate = lengths.select("recording", "rate", "duration")
    seconds = lambda rows: rows.join(rate, "recording").withColumns({"start_s": F.col("start") / F.col("rate"), "end_s": F.col("end") / F.col("rate")})
    in_steps = lambda rows: rows.join(rate, "recording").withColumns({"start_s": F.col("start") * STEP, "end_s": F.least("duration", F.col("end") * STEP)})

    marks = parts.withColumnsRenamed({"part": "kind", "at": "block"}).withColumns({"value": F.get("v", F.lit(0)), "first_value": F.get("v", F.lit(0)), "last_value": F.get("v", F.lit(1))})
    flat = blocks.flat_tops_of_marks(marks, PLATEAU, 1e-7, PLATEAU_SAMPLES)
    jumps = blocks.discontinuities_of_marks(marks, JUMP)
    found = {
        "digital-zero": seconds(_runs(parts, "zero")).where(F.col("length") >= F.floor(F.col("rate") * ZERO_SECONDS + 0.5)), "overrange": seconds(_runs(parts, "overrange")), "invalid": seconds(_runs(parts, "invalid", ("recording", "channel"))),
        "flat-top": seconds(flat), "discontinuity": seconds(jumps.withColumn("start", F.col("frame")).withColumn("end", F.col("frame"))), "low-level": in_steps(regions.low_level_regions(steps.withColumn("energy", F.col("raw_energy")), int(LOW_SECONDS / STEP), LOW_DB)),
        "negative-correlation": in_steps(regions.negative_correlation_regions(steps, 10)),
    }

    maxima = [loudness.max_loudness(fine, n, FINE).select("recording", F.col("loudness").alias(f"{name}_max"), F.col("seconds").alias(f"{name}_s")) for name, n in (("momentary", 40), ("short_term", 300))]
    loudest = F.min_by("channel", F.struct(-F.col("true_peak"), "channel"))
    over_all = channels.groupBy("recording").agg(F.max("peak").alias("peak"), F.max("true_peak").alias("true_peak"), loudest.alias("true_peak_channel"), F.sqrt(F.sum(F.pow(F.coalesce("rms", F.lit(0.0)), F.lit(2))) / F.count("*")).alias("rms"), F.sum("overrange").alias("overrange"), F.sum("not_finite").alias("not_finite"), F.max("n").cast("long").alias("most_valid"), F.count("*").alias("channels"))
    summary = lengths.join(over_all, "recording")
    for rows in (loudness.integrated_lufs(steps), loudness.loudness_range(steps), *maxima, _stereo(steps, parts)):
        summary = summary.join(rows, "recording", "left")
    for kind, name in (("digital-zero", "zero_regions"), ("overrange", "overrange_regions"), ("flat-top", "flat_tops"), ("discontinuity", "discontinuities"), ("low-level", "low_regions")):
        summary = summary.join(found[kind].groupBy("recording").agg(F.count("*").alias(name)), "recording", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    summary = summary.join(layouts.select("recording", "truncated"), "recording", "left")
    summary = summary.withColumns({"crest_db": F.when(F.col("rms") > 0, 20 * F.log10(F.col("peak") / F.col("rms"))), "plr": db("true_peak") - F.col("integrated"), "valid_frames": F.coalesce("valid_frames", F.when(F.col("channels") == 1, F.col("most_valid")), F.lit(0))}).drop("most_valid")

    told = summary.withColumns({"truncated": F.coalesce("truncated", F.lit(False)), "zero_seconds": F.col("zero_regions"), "low_seconds": F.col("low_regions"), "byte_rate_ok": F.lit(True), "frames": F.col("valid_frames")})
    span = lambda at: F.greatest(F.lit(0.0), F.col("end_s") - at)
    kinds = {k: _kept(found[k], MOST_EVENTS, F.col(by)) for k, by in (("discontinuity", "delta"), ("flat-top", "length"))}
    kinds |= {k: _kept(found[k], KEPT_REGIONS, F.col("length")) for k in ("digital-zero", "overrange")}
    kinds["invalid"] = _kept(found["invalid"], MOST_EVENTS, F.col("length"))
    kinds["negative-correlation"] = _kept(found["negative-correlation"], MOST_EVENTS, -F.col("start"))
    kinds["sample-peak"] = channels.where("peak > 0").withColumn("start_s", F.col("peak_s"))
    kinds["true-peak"] = channels.where("true_peak > 0").withColumn("start_s", F.col("true_peak_s"))
    for name, length in (("momentary", 0.4), ("short_term", 3.0)):
        kinds[f"{name.replace('_', '-')}-max"] = summary.where(F.col(f"{name}_max").isNotNull()).withColumn("end_s", F.col(f"{name}_s")).withColumn("start_s", span(length))
    return Analysis(steps, channels, summary, found, observations(told), all_markers(kinds))
