"""Trim, gain, fades and local gain curves as column expressions over frames (recording, frame, left, right)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.audio import all_that_hold, down, finite, gain, half_up

#: Limits of a decision, and the seed of dither (fixed values).
GAIN_RANGE, LOCAL_RANGE, MOST_REGIONS, SEED = (-60.0, 24.0), (-60.0, 0.0), 256, 0x4C6A7564


def trim(frames: DataFrame, edits: DataFrame) -> DataFrame:
    """Frames within ``[start_frame, end_frame)`` of ``edits``, one row per recording, renumbered from 0.

    An edit beyond the recording is clamped by its frames; one that leaves none gives no rows.
    """
    inside = (F.col("frame") >= F.greatest(F.col("start_frame"), F.lit(0))) & (F.col("frame") < F.col("end_frame"))
    return frames.join(edits, "recording").where(inside).withColumn("frame", F.col("frame") - F.greatest(F.col("start_frame"), F.lit(0)))


def apply_gain(value: Column, decibels: Column) -> Column:
    return value * gain(decibels)


def fade_factor(i: Column, n: Column, fade_in: Column, fade_out: Column) -> Column:
    """Linear fades: the lesser of both; a fade of one frame is silence at that frame."""
    ramp = lambda k, length: F.when(length == 1, 0.0).otherwise(k / (length - 1))
    back = n - 1 - i
    return F.least(F.when(i < fade_in, ramp(i, fade_in)).otherwise(1.0), F.when(back < fade_out, ramp(back, fade_out)).otherwise(1.0))


def local_gain_factor(frame: Column, regions: Column) -> Column:
    """The least factor of all regions at a frame: attack, hold and release ramp linearly in amplitude; outside 1."""

    def factor(r: Column) -> Column:
        held = gain(r["gain_db"])
        attack = F.when(r["attack_end"] > r["start_frame"], 1 + (held - 1) * (frame - r["start_frame"]) / (r["attack_end"] - r["start_frame"])).otherwise(held)
        release = F.when(r["end_frame"] - 1 > r["release_start"], held + (1 - held) * (frame - r["release_start"]) / (r["end_frame"] - 1 - r["release_start"])).otherwise(held)
        at = F.when((frame < r["start_frame"]) | (frame >= r["end_frame"]), 1.0).when(frame < r["attack_end"], attack).when(frame >= r["release_start"], release).otherwise(held)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), at))

    return F.coalesce(F.array_min(F.transform(regions, factor)), F.lit(1.0))


def apply_edits(frames: DataFrame, edits: DataFrame) -> DataFrame:
    """The whole chain for analysis: finite samples scaled by gain, fades and local gain; others, and further columns of ``frames``, unchanged.

    ``edits``: recording, start_frame, end_frame, gain_db, fade_in, fade_out, regions.
    """
    out = trim(frames, edits)
    n = F.col("end_frame") - F.greatest(F.col("start_frame"), F.lit(0))
    source = F.col("frame") + F.greatest(F.col("start_frame"), F.lit(0))
    factor = gain("gain_db") * fade_factor(F.col("frame"), n, F.col("fade_in"), F.col("fade_out")) * local_gain_factor(source, F.col("regions"))
    for c in ("left", "right"):
        out = out.withColumn(c, F.when(finite(c), F.col(c) * factor).otherwise(F.col(c)))
    return out.select(*frames.columns)


def render_edits(frames: DataFrame, edits: DataFrame) -> DataFrame:
    """The chain for export: samples that are not finite become 0 and are counted per row in ``replaced``, which goes along through the cut."""
    bad = lambda c: F.when(finite(c), 0).otherwise(1)
    clean = {c: F.when(finite(c), F.col(c)).otherwise(0.0) for c in ("left", "right")}
    return apply_edits(frames.withColumn("replaced", bad("left") + bad("right")).withColumns(clean).select("recording", "frame", "left", "right", "replaced"), edits)


def signal_for_filters(c: str) -> tuple[Column, Column]:
    """(for raw statistics: null unless finite, for filters: 0 unless finite)."""
    return F.when(finite(c), F.col(c)), F.when(finite(c), F.col(c)).otherwise(0.0)


def mid_side(frames: DataFrame) -> DataFrame:
    """mid and side of the frames where both channels are finite."""
    both = frames.where(finite("left") & finite("right"))
    return both.withColumn("mid", (F.col("left") + F.col("right")) / 2).withColumn("side", (F.col("left") - F.col("right")) / 2)


def gain_breakpoints(regions: DataFrame) -> DataFrame:
    """Distinct knots of all gain curves of a recording, the last frame of each included."""
    last = F.greatest(F.col("release_start"), F.col("end_frame") - 1)
    return regions.select("recording", F.explode(F.array("start_frame", "attack_end", "release_start", last, "end_frame")).alias("frame")).distinct()


def peak_regions(events: DataFrame, ceiling: float = -2.0, transition: float = 0.2, padding: float = 0.05, margin: float = 0.3) -> DataFrame:
    """A protective gain region around each peak event (recording, start_s, end_s, peak_db, sample_rate, frames; peak_frame if it is not the start).

    The hold reaches from the padded start to the padded end and holds the peak; ramps lie outside it, within
    the recording. The reduction is at least 0.1 dB, floored to tenths.
    """
    frames = F.col("frames")
    scaled = lambda seconds, least: F.greatest(F.lit(least), half_up(F.col("sample_rate") * seconds)).cast("long")
    ramp, pad = scaled(transition, 1), scaled(padding, 0)
    first = half_up(F.col("start_s") * F.col("sample_rate")).cast("long")
    after = F.greatest(first + 1, half_up(F.col("end_s") * F.col("sample_rate")).cast("long"))
    peak = F.coalesce("peak_frame", first) if "peak_frame" in events.columns else first
    hold = F.least(peak, F.greatest(F.lit(0), first - pad))
    done = F.greatest(peak + 1, F.least(frames, after + pad))
    out = events.withColumns({"start_frame": F.greatest(F.lit(0), hold - ramp), "attack_end": hold, "release_start": F.greatest(hold, done - 1), "end_frame": F.least(frames, done + ramp)})
    out = out.select(*events.columns, *[F.col(c).cast("long").alias(c) for c in ("start_frame", "attack_end", "release_start", "end_frame")])
    return out.withColumn("target_dbtp", F.lit(ceiling)).withColumn("gain_db", F.greatest(F.lit(LOCAL_RANGE[0]), down(F.least(F.lit(-0.1), ceiling - F.col("peak_db") - margin), 1)))


def place_window(recordings: DataFrame, anchor: str = "centre", seconds: float = 1200.0) -> DataFrame:
    """A window of fixed length (recording, duration) at the start, centre or end, clamped to the recording."""
    length = F.least(F.col("duration"), F.lit(seconds))
    at = {"start": F.lit(0.0), "centre": (F.col("duration") - length) / 2, "end": F.col("duration") - length}[anchor]
    return recordings.withColumn("start_s", F.greatest(F.lit(0.0), at)).withColumn("end_s", F.col("start_s") + length)


#: Profiles of an export (fixed values): the payload as it is, or a processed one.
TRIM, EDITED = "sample-payload-trim", "edited-wav"


def normalize_edits(edits: DataFrame) -> DataFrame:
    """Decisions with their defaults filled in, ``errors``, and the profile that they amount to unless one is stated.

    Columns: recording, frames (null: unknown), start_frame, end_frame, gain_db, other_gain_db (an older name's value),
    fade_in, fade_out, local_regions (their number), profile; null means the default.
    """
    c, zero = F.col, F.lit(0)
    out = edits.withColumn("start_frame", F.coalesce("start_frame", zero))
    out = out.withColumn("end_frame", F.coalesce("end_frame", "frames", "start_frame")).withColumn("conflict", c("gain_db") != c("other_gain_db"))
    out = out.withColumns({"gain_db": F.coalesce("gain_db", "other_gain_db", zero), **{n: F.coalesce(n, zero) for n in ("fade_in", "fade_out", "local_regions")}})
    length = c("end_frame") - c("start_frame")
    changed = (c("gain_db") != 0) | (c("fade_in") > 0) | (c("fade_out") > 0) | (c("local_regions") > 0)
    out = out.withColumn("inferred", F.coalesce(F.nullif(F.col("profile"), F.lit("")), F.when(changed, EDITED).otherwise(TRIM)))
    errors = all_that_hold(
        ((c("start_frame") < 0) | (c("end_frame") > c("frames")) | (length < 0), "range"), (c("conflict"), "gain-conflict"), (~finite(c("gain_db").cast("double")) | ~c("gain_db").between(*GAIN_RANGE), "gain"),
        (~c("fade_in").between(zero, length) | ~c("fade_out").between(zero, length), "fade"), (c("local_regions") > MOST_REGIONS, "regions"), (~c("inferred").isin(TRIM, EDITED), "profile"), ((c("inferred") == TRIM) & changed, "profile-contradiction"),
    )
    return out.withColumn("errors", errors).drop("conflict")


def validate_gain_regions(regions: DataFrame) -> DataFrame:
    """Regions with ids trimmed and cut to 160 characters, their place by start, end and id, and ``errors``.

    Columns: recording, id, start_frame, attack_end (null: the start), release_start (null: the last frame), end_frame,
    gain_db, frames, target_dbtp (may be null). The last frame of attack and release lies before the end.
    """
    from pyspark.sql import Window

    c = F.col
    every = Window.partitionBy("recording")
    given = F.when(F.coalesce(F.length("id"), F.lit(0)) > 0, c("id")).otherwise(F.concat(F.lit("local-gain-"), F.row_number().over(every.orderBy("start_frame", "end_frame")).cast("string")))
    out = regions.withColumns({"id": F.substring(F.trim(given), 1, 160), "attack_end": F.coalesce("attack_end", "start_frame"), "release_start": F.coalesce("release_start", c("end_frame") - 1)})
    last = c("end_frame") - 1
    errors = all_that_hold(
        (~c("start_frame").between(0, c("frames")) | (last < c("start_frame")) | (c("end_frame") > c("frames")), "bounds"), (~c("attack_end").between(c("start_frame"), last) | ~c("release_start").between(c("attack_end"), last), "order"),
        (~F.coalesce(c("gain_db").between(*LOCAL_RANGE), F.lit(False)), "gain"), (~c("target_dbtp").between(*LOCAL_RANGE), "target"), (c("id") == "", "id"), (F.count("*").over(Window.partitionBy("recording", "id")) > 1, "id-repeated"), (F.count("*").over(every) > MOST_REGIONS, "too-many"),
    )
    return out.withColumn("nth", F.row_number().over(every.orderBy("start_frame", "end_frame", "id"))).withColumn("errors", errors)


def quantised(value: Column, noise: Column, bits: int) -> Column:
    """Integer sample of so many bits: dithered, clamped to [-1, 1 - 1/scale], rounded half up; what is not finite is 0."""
    scale = float(2 ** (bits - 1))
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1 - 1 / scale), value + noise / scale))
    return F.when(finite(value), half_up(x * scale)).otherwise(0.0).cast("long")


def _times(a: Column, b: Column) -> Column:
    """Product of two unsigned 32-bit numbers modulo 2^32, by halves that stay within a long."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = F.pmod(F.shiftrightunsigned(a, 16) * b, F.lit(1 << 32)).bitwiseAND(F.lit(0xFFFF)) * (1 << 16)
    return F.pmod(low + high, F.lit(1 << 32))


def _draw(k: Column, seed: int) -> Column:
    """The k-th number of the counter generator, in [0, 1)."""
    s = F.pmod(F.lit(seed) + _times(k, F.lit(0x6D2B79F5)), F.lit(1 << 32))
    v = _times(s.bitwiseXOR(F.shiftrightunsigned(s, 15)), s.bitwiseOR(F.lit(1)))
    v = v.bitwiseXOR(F.pmod(v + _times(v.bitwiseXOR(F.shiftrightunsigned(v, 7)), v.bitwiseOR(F.lit(61))), F.lit(1 << 32)))
    return v.bitwiseXOR(F.shiftrightunsigned(v, 14)) / float(1 << 32)


def tpdf_noise(index: Column, seed: int = SEED) -> Column:
    """Triangular dither of interleaved sample ``index``: the difference of two draws keyed by it, so any order of tasks agrees."""
    index = index.cast("long")
    return _draw(F.pmod(2 * index + 1, F.lit(1 << 32)), seed) - _draw(F.pmod(2 * index + 2, F.lit(1 << 32)), seed)


def encode_payload(paired: DataFrame, bits: int = 16, encoding: str = "pcm", dithered: bool = False, seed: int = SEED) -> DataFrame:
    """Bytes of each paired block (recording, block_no, start_frame, samples by channel): its frames interleaved, as a file holds them.

    Integers are clamped and rounded half up, with triangular noise keyed by the sample's index in the file if ``dithered``; floats
    get none. What is not finite is 0. Blocks side by side are the file's payload.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for start, channels in zip(pdf["start_frame"], pdf["samples"], strict=True):
                x = np.array([np.asarray(c, float) for c in channels]).T.ravel()
                noise = kernels.dither(start * len(channels) + np.arange(len(x)), seed) if dithered and encoding == "pcm" else 0.0
                found.append(kernels.payload(x, bits, encoding, noise))
            yield pdf[["recording", "block_no", "start_frame"]].assign(payload=found)

    return paired.select("recording", "block_no", "start_frame", "samples").mapInPandas(run, "recording long, block_no long, start_frame long, payload binary")


def payload_digest(payloads: DataFrame) -> DataFrame:
    """Per recording: bytes, and SHA-256 over the hashes of its blocks in order; blocks are hashed where they lie."""
    each = payloads.select("recording", "block_no", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("hash"))
    parts = F.array_sort(F.collect_list(F.struct("block_no", "hash")))
    return each.groupBy("recording").agg(F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.transform(parts, lambda p: p["hash"]), ""), 256).alias("payload_hash"))


def identical_payloads(source: DataFrame, output: DataFrame) -> DataFrame:
    """recording, source_hash and output_hash of payloads that were cut into the same blocks, for ``rules.verify_output``."""
    hashed = lambda rows, name: payload_digest(rows).select("recording", F.col("payload_hash").alias(name))
    return hashed(source, "source_hash").join(hashed(output, "output_hash"), "recording", "left")
