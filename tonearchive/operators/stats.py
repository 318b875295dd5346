"""Statistics of frames, channels and recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.audio import db, finite, power_db
from ..sources.documents import work_path


def by_channel(frames: DataFrame) -> DataFrame:
    """recording, channel, frame, value."""
    return frames.select("recording", "frame", F.posexplode(F.array("left", "right")).alias("channel", "value"))


def channel_stats(samples: DataFrame) -> DataFrame:
    """Per recording and channel: DC offset, RMS, peak and its first frame, extremes and counts; only finite samples enter the measures."""
    x = F.when(finite("value"), F.col("value"))
    first = F.min_by("frame", F.when(finite("value"), F.struct((-F.abs("value")).alias("a"), F.col("frame").alias("f"))))
    return samples.groupBy("recording", "channel").agg(
        F.count(x).alias("n"), F.avg(x).alias("dc_offset"), F.sqrt(F.avg(x * x)).alias("rms"), F.max(F.abs(x)).alias("peak"), first.alias("peak_frame"), F.max(x).alias("highest"), F.min(x).alias("lowest"),
        F.count_if(x == 0).alias("zeros"), F.count_if(F.abs(x) > 1).alias("overrange"), F.count_if(~finite("value")).alias("not_finite"),
    )


def recording_summary(channels: DataFrame) -> DataFrame:
    """One row per recording from its channels: highest peak and its channel, combined RMS, totals, crest."""
    loudest = F.max_by("channel", F.struct("peak", -F.col("channel")))
    out = channels.groupBy("recording").agg(
        F.max("peak").alias("peak"), loudest.alias("peak_channel"), F.sqrt(F.sum(F.col("rms") * F.col("rms")) / F.count("*")).alias("rms"), F.sum("overrange").alias("overrange"), F.sum("not_finite").alias("not_finite")
    )
    return out.withColumn("crest_db", db("peak") - db("rms"))


def peaks_by_level(samples: DataFrame) -> DataFrame:
    """Peak and overrange count per channel and per recording at once (channel null)."""
    x = F.when(finite("value"), F.abs("value"))
    return samples.groupingSets([["recording", "channel"], ["recording"]], "recording", "channel").agg(F.max(x).alias("peak"), F.count_if(x > 1).alias("overrange"))


def correlation(n: Column, sl: Column, sr: Column, sll: Column, srr: Column, slr: Column) -> Column:
    """Clamped correlation from sums, null without variance."""
    bottom = F.sqrt(F.greatest(F.lit(0.0), (sll - sl * sl / n) * (srr - sr * sr / n)))
    return F.when(bottom > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (slr - sl * sr / n) / bottom)))


def _sums(both: Column) -> dict[str, Column]:
    left, right = F.when(both, F.col("left")), F.when(both, F.col("right"))
    return {"n": F.count(left), "sl": F.sum(left), "sr": F.sum(right), "sll": F.sum(left * left), "srr": F.sum(right * right), "slr": F.sum(left * right)}


def stereo_metrics(frames: DataFrame) -> DataFrame:
    """Per recording: correlation, balance and mid/side in dB, change of energy when folded to mono (floor -300)."""
    both = finite("left") & finite("right")
    mid = F.when(both, (F.col("left") + F.col("right")) / 2)
    side = F.when(both, (F.col("left") - F.col("right")) / 2)
    peak = F.max(F.when(both, F.struct(F.abs(mid).alias("a"), (-F.col("frame")).alias("f"))))
    out = frames.groupBy("recording").agg(*[v.alias(k) for k, v in _sums(both).items()], F.sum(mid * mid).alias("mm"), F.sum(side * side).alias("ss"), peak.alias("p"))
    mono = F.when(F.col("mm") > 0, 10 * F.log10(F.col("mm") / ((F.col("sll") + F.col("srr")) / 2))).otherwise(-300.0)
    return out.select(
        "recording", correlation(*[F.col(c) for c in ("n", "sl", "sr", "sll", "srr", "slr")]).alias("correlation"), F.when(F.col("srr") > 0, power_db(F.col("sll") / F.col("srr"))).alias("balance_db"),
        F.when(F.col("ss") > 0, power_db(F.col("mm") / F.col("ss"))).alias("mid_side_db"), mono.alias("mono_delta_db"), F.col("p.a").alias("mono_peak"), (-F.col("p.f")).alias("mono_peak_frame"),
    )


def step_table(frames: DataFrame, step_frames: int) -> DataFrame:
    """Per 100 ms step: raw energy (mean over channels and all frames), peak, RMS per channel, correlation, balance, mid/side.

    ``energy`` (here of the unweighted channels, summed) is null for a last step that is not full; ``blocks.stereo_steps`` gives the same
    table with weighted energy from blocks.
    """
    zero = lambda c: F.when(finite(c), F.col(c)).otherwise(0.0)
    both = finite("left") & finite("right")
    out = frames.groupBy("recording", F.floor(F.col("frame") / step_frames).alias("step")).agg(
        F.count("*").alias("frames"), F.sum(zero("left") * zero("left")).alias("l2"), F.sum(zero("right") * zero("right")).alias("r2"),
        F.max(F.greatest(F.abs(zero("left")), F.abs(zero("right")))).alias("peak"), *[v.alias(k) for k, v in _sums(both).items()],
        F.sum(F.when(both, F.pow((F.col("left") + F.col("right")) / 2, F.lit(2)))).alias("mm"), F.sum(F.when(both, F.pow((F.col("left") - F.col("right")) / 2, F.lit(2)))).alias("ss"),
    )
    n = F.col("frames")
    return out.select(
        "recording", "step", "frames", F.when(n == step_frames, (F.col("l2") + F.col("r2")) / n).alias("energy"), ((F.col("l2") + F.col("r2")) / (2 * n)).alias("raw_energy"), "peak",
        F.sqrt(F.col("l2") / n).alias("rms_left"), F.sqrt(F.col("r2") / n).alias("rms_right"), correlation(*[F.col(c) for c in ("n", "sl", "sr", "sll", "srr", "slr")]).alias("correlation"),
        F.when(F.col("srr") > 0, power_db(F.col("sll") / F.col("srr"))).alias("balance_db"), F.when(F.col("ss") > 0, power_db(F.col("mm") / F.col("ss"))).alias("mid_side_db"),
    )


def _bins(frames: DataFrame, bin_of: Column, *more: Column) -> DataFrame:
    x = F.when(finite("value"), F.col("value"))
    return frames.groupBy("recording", "channel", bin_of.alias("bin")).agg(
        F.coalesce(F.min(x), F.lit(0.0)).alias("lowest"), F.coalesce(F.max(x), F.lit(0.0)).alias("highest"), F.coalesce(F.sqrt(F.avg(x * x)), F.lit(0.0)).alias("rms"), F.count("*").alias("n"), *more
    )


def waveform_envelope(samples: DataFrame, bins: int = 4096, least: int = 64) -> DataFrame:
    """Extremes and RMS per bin; frames per bin follow from the recording's length."""
    lengths = samples.groupBy("recording").agg((F.max("frame") + 1).alias("length"))
    per = F.ceil(F.col("length") / F.greatest(F.lit(least), F.least(F.lit(bins), F.col("length"))))
    sized = samples.join(lengths.select("recording", per.alias("per")), "recording")
    return _bins(sized, F.floor(F.col("frame") / F.col("per")))


def waveform_detail(samples: DataFrame, start: int, end: int, pixels: int, sample_rate: int = 48_000, longest: float = 0.01, values: bool = False) -> DataFrame:
    """As the envelope, of one range, at most ``longest`` seconds a bin; if asked for, ``values`` holds a bin's samples in order."""
    per = max(1, int(min((end - start) / pixels, longest * sample_rate)))
    part = samples.where((F.col("frame") >= start) & (F.col("frame") < end))
    bin_of = F.floor((F.col("frame") - start) / per)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda x: x["value"])  # a bin holds ``per`` samples
    return _bins(part, bin_of, *([ordered.alias("values")] if values else []))


def negative_correlation_pct(steps: DataFrame, limit: float = -0.25) -> DataFrame:
    ok = finite("correlation")
    return steps.groupBy("recording").agg((100.0 * F.count_if(ok & (F.col("correlation") < limit)) / F.count_if(ok)).alias("negative_pct"))


def spectral_summary(windows: DataFrame, metrics: list[str], key: str = "recording") -> DataFrame:
    """Median and greatest finite value of each metric."""
    out = []
    for m in metrics:
        x = F.when(finite(m), F.col(m))
        out += [F.percentile(x, 0.5).alias(f"{m}_median"), F.max(x).alias(f"{m}_max")]
    return windows.groupBy(key).agg(*out)


def conformance(expected: DataFrame, measured: DataFrame) -> DataFrame:
    """status of each expected value (file, metric, expected, lower, upper): passed, failed or missing."""
    gap = F.col("actual") - F.col("expected")
    joined = expected.join(measured, ["file", "metric"], "left")
    return joined.withColumn("status", F.when(F.col("actual").isNull(), "missing").when(gap.between(F.col("lower"), F.col("upper")), "passed").otherwise("failed"))


#: What a report's figures are called in its layouts, newest first (fixed values).
FIGURES = {
    "loudness": ("integratedLufs", "lufsI"),
    "peak": ("truePeakEstimateDbtp", "truePeakDbtp"),
    "loudness_range": ("loudnessRangeLu", "lra"),
    "plr": ("plrEstimateLu", "plrLu"),
    "balance": ("channelBalanceDb",),
    "mono_delta": ("monoCompatibility.energyDeltaDb", "monoEnergyDeltaDb"),
}
_SUMMARY = f"struct<{','.join(f'{n}:double' for names in FIGURES.values() for n in names if '.' not in n)},monoCompatibility:struct<energyDeltaDb:double>>"
_FILE = f"summary:{_SUMMARY},format:struct<durationSeconds:double>,duration:double"
_REPORT = (
    f"struct<sections:struct<verifiedExportFile:struct<analysis:struct<{_FILE}>,verifiedOutput:struct<{_FILE}>,{_FILE}>>,verifiedOutput:struct<{_FILE}>,exportReport:struct<verifiedOutput:struct<{_FILE}>>,summary:{_SUMMARY},metadata:struct<durationSeconds:double>>"
)


def report_values(reports: DataFrame, report: str = "report") -> DataFrame:
    """Figures of each JSON report, whatever layout it has: those of ``FIGURES`` and duration.

    The first place that is there counts: the verified file's analysis, its output, the section itself if it holds
    a measurement, the report's verified output, an export report's. Its own summary and metadata come last.
    """

    def values(r: Column) -> Column:
        section = r["sections"]["verifiedExportFile"]
        itself = F.when(section["summary"].isNotNull() | section["format"].isNotNull(), F.struct(*[section[n].alias(n) for n in ("summary", "format", "duration")]))
        found = F.coalesce(section["analysis"], section["verifiedOutput"], itself, r["verifiedOutput"], r["exportReport"]["verifiedOutput"])
        return F.struct(F.coalesce(found["summary"], r["summary"]).alias("summary"), F.coalesce(found["format"]["durationSeconds"], found["duration"], r["metadata"]["durationSeconds"]).alias("duration"))

    # a generator stands for itself in a plan: the text is parsed once a row
    out = reports.select("*", F.inline(F.transform(F.array(F.from_json(report, _REPORT)), values)))
    inner = lambda path: F.col("summary." + path)
    return out.withColumns({k: F.coalesce(*[inner(n) for n in names]) for k, names in FIGURES.items()}).drop("summary")


#: Bins of a histogram, and rows up to which what is left of one is sorted.
BINS, SORTED = 4096, 10_000


def _bin(x: Column, low: Column, high: Column) -> Column:
    """The bin of a value between low and high; by logarithm where these lie magnitudes apart, so that a few passes settle any range."""
    size = F.abs(low), F.abs(high)
    wide = (low <= 0) & (high >= 0) | (F.greatest(*size) > 1e4 * F.least(*size))
    scale = lambda v: F.when(wide, F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.ln(F.abs(v)) + 746))).otherwise(v / 2)  # noqa: E731  # no double is below exp(-746)
    return F.least(F.lit(BINS - 1), F.floor((scale(x) - scale(low)) / (scale(high) - scale(low)) * BINS))


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The keys, and for each name in ``shares`` the exact percentile of ``value`` at that share, interpolated between ranks as ``percentile`` does.

    A group's values never meet in one task: a histogram between its extremes (counts, least and greatest of each bin) tells in which bins
    the wanted ranks lie, and is refined there until a bin holds one value or few rows, which are then sorted. Each pass reads the
    rows once and shuffles bins only. Values that are null or not finite do not count; null keys make groups; ``rows`` is read several times.
    """
    group, span = "_key", ["_key", "low", "high", "before"]  # a struct: null keys are equal
    rows = rows.where(finite(value)).select(F.struct(*keys).alias(group), F.col(value).cast("double").alias("_x"))
    whole = rows.groupBy(group).agg(F.count("*").alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"))
    place = lambda p: p * (F.col("n") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*[F.array((F.floor(place(p)) + 1).cast("long"), (F.ceil(place(p)) + 1).cast("long")) for p in shares.values()])))
    state = _kept_table(whole.select(*span[:3], "n", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"), F.explode(wanted).alias("rank")))
    open_ = (F.col("low") < F.col("high")) & (F.col("inside") > SORTED)
    within = (F.col("_x") >= F.col("low")) & (F.col("_x") <= F.col("high"))
    while state.where(open_).head(1):
        ranges = state.where(open_).select(*span).distinct()
        bins = rows.join(ranges, group).where(within).groupBy(*span, _bin(F.col("_x"), F.col("low"), F.col("high")).alias("bin")).agg(F.count("*").alias("m"), F.min("_x").alias("least"), F.max("_x").alias("most"))
        order = Window.partitionBy(*span).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("until", F.col("before") + F.coalesce(F.sum("m").over(order), F.lit(0)))
        found = state.where(open_).drop("inside").join(bins, span).where((F.col("rank") > F.col("until")) & (F.col("rank") <= F.col("until") + F.col("m")))
        found = found.select(group, F.col("least").alias("low"), F.col("most").alias("high"), "n", F.col("until").alias("before"), F.col("m").alias("inside"), "rank")
        state = _kept_table(found.unionByName(state.where(~open_)))
    some = state.where("low < high")
    left = rows.join(some.select(*span).distinct(), group).where(within).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy(*span).orderBy("_x")))
    ranked = left.join(some.select(*span, "rank"), [*span, "rank"]).select(group, "rank", F.col("_x").alias("at")).unionByName(state.where("low >= high").select(group, "rank", F.col("low").alias("at")))
    by_rank = ranked.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "at"))).alias("by")).join(whole.select(group, "n"), group)

    def share(p: float) -> Column:
        low, high = (F.element_at("by", (f(place(p)) + 1).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place(p) - F.floor(place(p)))

    return by_rank.select(f"{group}.*", *[share(p).alias(name) for name, p in shares.items()])


def _kept_table(df: DataFrame) -> DataFrame:
    """The rows written to a work table and read back, so that a loop's plan does not grow."""
    path = work_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def series_overview(reports: DataFrame, fields: list[str], key: str = "series") -> DataFrame:
    """Per series and field: median, least, greatest and count; rows without any number are left out.

    A few series may hold all reports: medians come from histograms (``exact_percentiles``), so no task holds a field.
    """
    long = _kept_table(reports.select(key, *fields).unpivot([key], fields, "field", "value").where(finite("value")))
    ends = long.groupBy(key, "field").agg(F.min("value").alias("least"), F.max("value").alias("greatest"), F.count("*").alias("n"))
    return ends.join(exact_percentiles(long, [key, "field"], "value", {"median": 0.5}), [key, "field"])


def latest_results(results: DataFrame, keys: list[str], job: str, tie: str) -> DataFrame:
    """The newest result per key; older jobs are stale."""
    order = Window.partitionBy(*keys).orderBy(F.col(job).desc(), F.col(tie).desc())
    return results.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
