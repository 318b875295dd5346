"""Block-local measures: each task filters and sums whole blocks; only small rows are shuffled.

Blocks: recording, channel, block_no, start_frame, samples (about a second), and ``halo``, the
samples before them. A quarter second of halo brings the filter to its state within 1e-12.
Paired blocks have no channel, but arrays of the channels' samples and halos: what needs both channels is summed up
there as well, and no sample is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.audio import power_db
from .stats import correlation

HALO_SECONDS = 0.25


def _keys(blocks: DataFrame) -> list[str]:
    return ["recording", *[c for c in ("channel",) if c in blocks.columns]]


def merge_blocks(blocks: DataFrame, block_frames: int, least: int) -> DataFrame:
    """Blocks (paired ones too) of ``block_frames`` samples merged with their neighbours to ``least`` samples at least; numbers follow. Every sample moves once."""
    many, keys = -(-least // block_frames), _keys(blocks)
    if many <= 1:
        return blocks
    parts = F.array_sort(F.collect_list(F.struct("start_frame", "samples")))
    merged = blocks.groupBy(*keys, F.floor(F.col("block_no") / many).alias("block_no")).agg(parts.alias("parts"))
    samples = F.flatten(F.transform("parts", lambda p: p["samples"]))
    if len(keys) == 1:
        side = lambda k: F.flatten(F.transform("parts", lambda p: p["samples"][k]))
        samples = F.transform(F.sequence(F.lit(0), F.size(F.col("parts")[0]["samples"]) - 1), side)
    return merged.select(*keys, "block_no", F.col("parts")[0]["start_frame"].alias("start_frame"), samples.alias("samples"))


def split_blocks(blocks: DataFrame, block_frames: int) -> DataFrame:
    """Blocks cut to ``block_frames`` samples each, numbered by their place in the channel."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("samples") - 1) / block_frames))))
    cut = blocks.where(F.size("samples") > 0).withColumn("at", at)
    return cut.select("recording", "channel", (F.floor(F.col("start_frame") / block_frames) + F.col("at")).alias("block_no"), (F.col("start_frame") + F.col("at") * block_frames).alias("start_frame"), F.slice("samples", (F.col("at") * block_frames + 1).cast("int"), block_frames).alias("samples"))


def with_halo(blocks: DataFrame, halo: int, block_frames: int) -> DataFrame:
    """``halo``: up to so many samples before each block (of each channel, if paired); ``last``: whether a block ends its channel.

    Blocks shorter than the halo are merged first, so a block sends its last samples to the next one alone, and
    tells the one before that it is there. Blocks are dealt one by one: a long channel is spread over all tasks.
    """
    blocks = merge_blocks(blocks, block_frames, halo)
    keys = [*_keys(blocks), "block_no"]
    cut = lambda x: F.slice(x, F.greatest(F.lit(1), F.size(x) - halo + 1), F.lit(halo))
    kind, end = ("array<double>", cut(F.col("samples"))) if len(keys) == 3 else ("array<array<double>>", F.transform("samples", cut))
    sent = blocks.select(*keys[:-1], (F.col("block_no") + 1).alias("block_no"), end.alias("halo"), F.lit(False).alias("next"))
    told = blocks.select(*keys[:-1], (F.col("block_no") - 1).alias("block_no"), F.lit(None).cast(kind).alias("halo"), F.lit(True).alias("next"))
    parts = sent.unionByName(told).groupBy(*keys).agg(F.any_value("halo", ignoreNulls=True).alias("halo"), F.bool_or("next").alias("next"))
    none = F.array().cast(kind) if len(keys) == 3 else F.transform("samples", lambda x: F.array().cast("array<double>"))
    out = blocks.join(parts, keys, "left").withColumn("halo", F.coalesce("halo", none)).withColumn("last", ~F.coalesce("next", F.lit(False)))
    return out.select(*blocks.columns, "halo", "last")


def pair_channels(blocks: DataFrame) -> DataFrame:
    """Paired blocks of a table of blocks by channel (with or without halo); readers that have the channels side by side need no such shuffle."""
    rest = [c for c in ("halo", "last") if c in blocks.columns]
    side = F.array_sort(F.collect_list(F.struct("channel", "samples", *[c for c in rest if c == "halo"])))
    out = blocks.groupBy("recording", "block_no", "start_frame", *[c for c in rest if c == "last"]).agg(side.alias("side"))
    halo = [F.transform("side", lambda x: x["halo"]).alias("halo")] if "halo" in rest else []
    return out.select("recording", "block_no", "start_frame", *[c for c in rest if c == "last"], F.transform("side", lambda x: x["samples"]).alias("samples"), *halo)


def _clean(values) -> np.ndarray:
    x = np.asarray(values, float)
    return np.where(np.isfinite(x), x, 0.0)


def _filtered(halos: list[np.ndarray], samples: list[np.ndarray], rate: float) -> list[np.ndarray]:
    """K-weighted samples of each row; rows are padded in front by rest, so one pass serves all."""
    width, length = max(map(len, halos), default=0), max(map(len, samples), default=0)
    rows = np.zeros((len(samples), width + length))
    for i, (h, s) in enumerate(zip(halos, samples, strict=True)):
        rows[i, width - len(h) : width] = h
        rows[i, width : width + len(s)] = s
    done = kernels.k_weight(rows, rate)
    return [done[i, width : width + len(s)] for i, s in enumerate(samples)]


def _weighted(pdf: pd.DataFrame, rate: float) -> list[np.ndarray]:
    return _filtered([_clean(h) for h in pdf["halo"]], [_clean(s) for s in pdf["samples"]], rate)


def k_weight(blocks: DataFrame, rate: float) -> DataFrame:
    """The same blocks with weighted samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[["recording", "channel", "block_no", "start_frame"]].assign(samples=_weighted(pdf, rate))

    return blocks.mapInPandas(run, "recording long, channel int, block_no long, start_frame long, samples array<double>")


def true_peak(blocks: DataFrame, rate: float) -> DataFrame:
    """Per recording and channel: true peak and its time, clamped to the recording."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [kernels.true_peak(_clean(r.samples), _clean(r.halo), rate, r.last, r.start_frame) for r in pdf.itertuples()]
            yield pd.DataFrame({"recording": pdf["recording"], "channel": pdf["channel"], "peak": [f[0] for f in found], "frame": [f[1] for f in found], "end": pdf["start_frame"] + pdf["samples"].map(len)})

    each = blocks.mapInPandas(run, "recording long, channel int, peak double, frame double, end long")
    best = each.groupBy("recording", "channel").agg(F.max("peak").alias("true_peak"), F.min_by("frame", F.struct(-F.col("peak"), "frame")).alias("frame"), F.max("end").alias("frames"))
    return best.withColumn("frame", F.greatest(F.lit(0.0), F.least("frame", F.col("frames") - 1.0)))


def block_steps(blocks: DataFrame, rate: float, step_frames: int) -> DataFrame:
    """Per recording and step: weighted and raw energy, peak and frames, from partial sums of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            parts = []
            for row, weighted in zip(pdf.itertuples(), _weighted(pdf, rate), strict=True):
                x = _clean(row.samples)
                step = (row.start_frame + np.arange(len(x))) // step_frames
                first = np.flatnonzero(np.diff(step, prepend=step[0] - 1)) if len(x) else np.empty(0, int)
                if len(first):
                    sums = [np.add.reduceat(v, first) for v in (weighted**2, x**2)]
                    parts.append(pd.DataFrame({"recording": row.recording, "channel": row.channel, "step": step[first], "n": np.diff(np.append(first, len(x))), "k": sums[0], "raw": sums[1], "peak": np.maximum.reduceat(np.abs(x), first)}))
            if parts:
                yield pd.concat(parts)

    each = blocks.mapInPandas(run, "recording long, channel int, step long, n long, k double, raw double, peak double")
    channels = each.groupBy("recording", "step", "channel").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("raw").alias("raw"), F.max("peak").alias("peak"))
    full = F.min("n") == step_frames
    return channels.groupBy("recording", "step").agg(F.max("n").alias("frames"), F.when(full, F.sum(F.col("k") / F.col("n"))).alias("k_energy"), F.avg(F.col("raw") / F.col("n")).alias("raw_energy"), F.max("peak").alias("peak"))


_SUMS = ("k", "l2", "r2", "n_both", "sl", "sr", "sll", "srr", "slr", "mm", "ss")


def stereo_parts(sides: list[np.ndarray], weighted: list[np.ndarray], start: int, step_frames: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Steps that a block of one or two channels touches, their frames, the sums ``_SUMS`` and the peak of each."""
    n = len(sides[0])
    step = (start + np.arange(n)) // step_frames
    first = np.flatnonzero(np.diff(step, prepend=step[0] - 1))
    left, right = sides[0], sides[1] if len(sides) > 1 else np.full(n, np.nan)
    clean = [_clean(left), _clean(right)]
    both = np.isfinite(left) & np.isfinite(right)
    x, y = (np.where(both, c, 0.0) for c in clean)
    rows = [sum(w * w for w in weighted), clean[0] ** 2, clean[1] ** 2, both.astype(float), x, y, x * x, y * y, x * y, ((x + y) / 2) ** 2, ((x - y) / 2) ** 2]
    return step[first], np.diff(np.append(first, n)), np.add.reduceat(np.stack(rows), first, axis=1), np.maximum.reduceat(np.abs(np.stack(clean)).max(axis=0), first)


def stereo_steps(paired: DataFrame, rate: float, step_frames: int) -> DataFrame:
    """The step table of paired blocks: weighted energy summed over channels, raw energy, peak, RMS by channel, correlation, balance, mid/side.

    Each block gives sums for the steps that it touches, which add up over blocks: what the frames of both channels give, in one
    pass. ``energy`` is null for a last step that is not full; a recording of one channel has no correlation, balance and mid/side.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sides = [[np.asarray(c, float) for c in r] for r in pdf["samples"]]
            flat = [c for r in sides for c in r]
            done = iter(_filtered([_clean(h) for r in pdf["halo"] for h in r], [_clean(c) for c in flat], rate)) if flat else iter(())
            parts = []
            for recording, start, row in zip(pdf["recording"], pdf["start_frame"], sides, strict=True):
                weighted = [next(done) for _ in row]
                if row and len(row[0]):
                    step, n, sums, peak = stereo_parts(row, weighted, int(start), step_frames)
                    parts.append(pd.DataFrame({"recording": recording, "step": step, "channels": len(row), "frames": n, "peak": peak} | dict(zip(_SUMS, sums, strict=True))))
            if parts:
                yield pd.concat(parts)

    each = paired.select("recording", "start_frame", "samples", "halo").mapInPandas(run, f"recording long, step long, channels int, frames long, peak double, {', '.join(f'{c} double' for c in _SUMS)}")
    return step_measures(each, step_frames)


def step_measures(parts: DataFrame, step_frames: int) -> DataFrame:
    """The step table of partial sums (recording, step, channels, frames, peak and ``_SUMS``)."""
    summed = parts.groupBy("recording", "step").agg(F.max("channels").alias("channels"), F.sum("frames").alias("frames"), F.max("peak").alias("peak"), *[F.sum(c).alias(c) for c in _SUMS])
    n, two = F.col("frames"), F.col("channels") > 1
    return summed.select(
        "recording", "step", "frames", F.when(n == step_frames, F.col("k") / n).alias("energy"), ((F.col("l2") + F.col("r2")) / (F.col("channels") * n)).alias("raw_energy"), "peak",
        F.sqrt(F.col("l2") / n).alias("rms_left"), F.when(two, F.sqrt(F.col("r2") / n)).alias("rms_right"),
        F.when(two & (F.col("n_both") > 0), correlation(*[F.col(c) for c in ("n_both", "sl", "sr", "sll", "srr", "slr")])).alias("correlation"),
        F.when(F.col("srr") > 0, power_db(F.col("sll") / F.col("srr"))).alias("balance_db"), F.when(F.col("ss") > 0, power_db(F.col("mm") / F.col("ss"))).alias("mid_side_db"),
    )


#: Marks that a block gives: runs, events, and its first and last finite samples.
MARKS = "recording long, channel int, kind string, start long, end long, count long, value double, block long, first boolean, last boolean, first_value double, last_value double"


def _level_runs(v: np.ndarray, level: float, same: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of neighbours at the level that hardly change."""
    at = np.abs(v) >= level
    goes_on = np.append(False, at[1:] & at[:-1] & (np.abs(np.diff(v)) <= same))
    starts = np.flatnonzero(at & ~goes_on)
    ends = np.flatnonzero(at & ~np.append(goes_on[1:], False))
    return starts, ends


def marks_of(x: np.ndarray, start: int, over: float, level: float, same: float, jump: float, least: int) -> list[dict]:
    """Marks of one block's samples: zero, overrange and invalid runs, flat-top runs, jumps between finite neighbours, and the edge.

    Short flat-top runs are left out unless they touch the block's first or last finite sample: there they may go on.
    """
    good, out = np.isfinite(x), []
    for kind, flags in (("zero", good & (x == 0)), ("overrange", good & (np.abs(x) > over)), ("invalid", ~good)):
        out += [{"kind": kind, "start": start + a, "end": start + b, "count": b - a} for a, b in zip(*(k.tolist() for k in kernels.runs(flags)), strict=True)]
    at = np.flatnonzero(good)
    if not len(at):
        return out
    v, n = x[at], len(at)
    for a, b in zip(*(k.tolist() for k in _level_runs(v, level, same)), strict=True):
        if b - a + 1 >= least or a == 0 or b == n - 1:
            out.append({"kind": "flat", "start": start + int(at[a]), "end": start + int(at[b]) + 1, "count": b - a + 1, "first": a == 0, "last": b == n - 1})
    change = np.abs(np.diff(v))
    out += [{"kind": "jump", "start": start + int(at[i + 1]), "end": start + int(at[i + 1]) + 1, "count": 1, "value": float(change[i])} for i in np.flatnonzero(change >= jump).tolist()]
    out.append({"kind": "edge", "start": start + int(at[0]), "end": start + int(at[-1]) + 1, "count": n, "first_value": float(v[0]), "last_value": float(v[-1])})
    return out


def block_marks(blocks: DataFrame, over: float = 1.0, level: float = 0.999, same: float = 1e-7, jump: float = 0.8, least: int = 3) -> DataFrame:
    """``MARKS`` of all blocks in one pass; the functions below join them where blocks touch."""
    columns = [c.split()[0] for c in MARKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"recording": r.recording, "channel": r.channel, "block": r.start_frame} | m for r in pdf.itertuples() for m in marks_of(np.asarray(r.samples, float), int(r.start_frame), over, level, same, jump, least)]
            yield pd.DataFrame(rows, columns=columns)

    return blocks.select("recording", "channel", "start_frame", "samples").mapInPandas(run, MARKS)


def _before(marks: DataFrame) -> DataFrame:
    """Blocks with finite samples, and the last finite value before each."""
    order = Window.partitionBy("recording", "channel").orderBy("block")
    return marks.where("kind = 'edge'").withColumn("before", F.lag("last_value").over(order))


def _joined(parts: DataFrame, fresh: Column, keys: tuple[str, ...] = ("recording", "channel", "kind")) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start")
    return parts.withColumn("run", F.sum(F.when(fresh, 1).otherwise(0)).over(order)).groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("count").alias("length")).drop("run")


def runs_of_marks(marks: DataFrame, least: dict[str, int] | None = None) -> DataFrame:
    """Runs of zero, overrange and invalid samples per channel: recording, channel, kind, start, end, length; ``least`` by kind."""
    order = Window.partitionBy("recording", "channel", "kind").orderBy("start")
    each = marks.where("kind in ('zero', 'overrange', 'invalid')").withColumn("fresh", ~F.coalesce(F.lag("end").over(order) == F.col("start"), F.lit(False)))
    shortest = F.coalesce(F.create_map(*[F.lit(x) for k, v in (least or {}).items() for x in (k, v)])[F.col("kind")] if least else F.lit(None).cast("int"), F.lit(1))
    return _joined(each, F.col("fresh")).where(F.col("length") >= shortest)


def flat_tops_of_marks(marks: DataFrame, level: float = 0.999, same: float = 1e-7, least: int = 3) -> DataFrame:
    """Flat-top runs per channel, whatever blocks and invalid samples they cross: start, end, length (its finite samples)."""
    goes_on = _before(marks).where((F.abs("before") >= level) & (F.abs("first_value") >= level) & (F.abs(F.col("first_value") - F.col("before")) <= same))
    parts = marks.where("kind = 'flat'").join(goes_on.select("recording", "channel", "block", F.lit(True).alias("on")), ["recording", "channel", "block"], "left")
    return _joined(parts, ~(F.coalesce("first", F.lit(False)) & F.coalesce("on", F.lit(False)))).where(F.col("length") >= least)


def discontinuities_of_marks(marks: DataFrame, jump: float = 0.8) -> DataFrame:
    """Jumps between finite neighbours, within blocks and from one to the next: recording, channel, frame, delta."""
    inner = marks.where("kind = 'jump'").select("recording", "channel", F.col("start").alias("frame"), F.col("value").alias("delta"))
    edges = _before(marks).select("recording", "channel", F.col("start").alias("frame"), F.abs(F.col("first_value") - F.col("before")).alias("delta"))
    return inner.unionByName(edges.where(F.col("delta") >= jump))


def block_runs(blocks: DataFrame, over: float = 1.0, least: dict[str, int] | None = None) -> DataFrame:
    """Runs of zero, overrange and invalid samples per channel: found within blocks, joined where blocks touch."""
    return runs_of_marks(block_marks(blocks, over), least)
