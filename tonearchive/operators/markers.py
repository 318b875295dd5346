"""Markers: kinds, classes, sanitising, merging, ranking, and joins with regions and selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.audio import finite, half_up, when_first

#: Severity, objective and heuristic of each machine kind (fixed values).
KINDS = {
    "discontinuity": ("review", False, True),
    "flat-top": ("review", False, True),
    "digital-zero": ("info", True, False),
    "overrange": ("review", True, False),
    "invalid": ("critical", True, False),
    "negative-correlation": ("review", True, False),
    "sample-peak": ("info", True, False),
    "true-peak": ("info", True, False),
    "momentary-max": ("info", True, False),
    "short-term-max": ("info", True, False),
    "low-frequency": ("review", False, True),
}
SEVERITIES = ("critical", "review", "info")


#: Words that tell an imported marker's kind, in the order that they are looked for (fixed values).
KIND_WORDS = (
    (("true peak",), "true-peak"),
    (("sample peak",), "sample-peak"),
    (("ogilt", "invalid", "nan", "infinity"), "invalid-float"),
    (("overrange",), "float-overrange"),
    (("flat",), "possible-flat-top"),
    (("tyst", "zero"), "silence"),
    (("diskont", "discontinu"), "possible-discontinuity"),
    (("momentary",), "momentary-maximum"),
    (("short-term",), "short-term-maximum"),
)
MARKER_TYPES = ("descriptive", "technical", "privacy", "keep", "remove", "chapter", "user", "note")


def marker_kind(text: Column, explicit: Column | None = None) -> Column:
    """The kind that a marker states (lower case, at most 100 characters), else the one that its words tell, else review-point."""
    t = F.lower(F.coalesce(text, F.lit("")))
    rules = [(reduce(lambda a, b: a | b, [t.contains(w) for w in words]), kind) for words, kind in KIND_WORDS]
    told = when_first(*rules, otherwise="review-point")
    return told if explicit is None else F.coalesce(F.nullif(F.substring(F.lower(F.trim(explicit)), 1, 100), F.lit("")), told)


def marker_severity(severity: Column) -> Column:
    """critical, review or information (also written info); everything else is for review."""
    return F.when(severity == "info", "information").when(severity.isin("critical", "review", "information"), severity).otherwise("review")


def marker_class(objective: Column, heuristic: Column, classification: Column) -> Column:
    """objective unless also heuristic, heuristic, or what is stated if it is a known class; else heuristic."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    stated = F.when(classification.isin("objective", "heuristic", "artistic"), classification).otherwise("heuristic")
    return F.when(yes(objective) & ~yes(heuristic), "objective").when(yes(heuristic), "heuristic").otherwise(stated)


def sanitize_markers(markers: DataFrame, duration: Column, exact: bool = False) -> DataFrame:
    """Times clamped to the recording; rounded to whole seconds unless exact times are wanted or a critical marker that is objective alone needs them.

    A column ``heuristic`` counts where there is one; ``precision_s`` tells what times are rounded to (null: not rounded).
    """
    heuristic = F.coalesce(F.col("heuristic"), F.lit(False)) if "heuristic" in markers.columns else F.lit(False)
    keep = F.lit(exact) | F.coalesce((F.col("severity") == "critical") & F.col("objective") & ~heuristic, F.lit(False))
    clean = lambda c: F.greatest(F.lit(0.0), F.least(duration, F.when(keep, F.col(c)).otherwise(half_up(c))))
    out = markers.withColumn("start_s", clean("seconds")).withColumn("end_s", F.greatest(F.col("start_s"), clean("end_seconds")))
    return out.withColumn("precision_s", F.when(~keep, 1.0))


def normalize_markers(markers: DataFrame) -> DataFrame:
    """Imported rows, all texts: unknown words replaced, times made numbers and not negative; rows without a time are dropped.

    Columns: seconds, end_seconds, type, severity, review, objective, suggested, origin, text.
    """
    number = lambda c: F.when(finite(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
    zero, s = F.lit(0.0), F.lower(F.coalesce("severity", F.lit("")))
    out = markers.where(number("seconds").isNotNull()).withColumns({"seconds": F.greatest(zero, number("seconds")), "end_seconds": F.greatest(zero, F.coalesce(number("end_seconds"), number("seconds")))})
    severity = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).when(s.rlike("warning|error|critical"), "critical").when(s.rlike("notice|technical"), "review").otherwise("info")
    return out.withColumns({
        "type": F.when(F.col("type").isin(*MARKER_TYPES), F.col("type")).otherwise("user"), "severity": severity, "review": F.when(F.col("review").isin("unreviewed", "accepted", "false-positive"), F.col("review")).otherwise("unreviewed"),
        "objective": F.coalesce("objective", F.lit(True)), "suggested": F.coalesce("suggested", F.lit(False)), "origin": F.coalesce("origin", F.when(F.coalesce("suggested", F.lit(False)), "analysis").otherwise("user")), "text": F.coalesce("text", F.lit("Marker")),
    })


#: Types that belong to the editorial layer (fixed values).
EDITORIAL_TYPES = ("privacy", "remove", "keep", "chapter", "editorial")


def in_layer(markers: DataFrame, layer: str) -> Column:
    """Whether a marker belongs to a layer of the timeline: rumble, float, mono or editorial (``all`` and other names: every marker).

    Columns that are missing count as empty: kind, type, classification, origin, id. Upper case counts as lower.
    """
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))) if c in markers.columns else F.lit("")
    holds = lambda *words: reduce(lambda a, b: a | b, [text("kind").contains(w) for w in words])
    origin, id_ = (F.coalesce(F.col(c), F.lit("")) if c in markers.columns else F.lit("") for c in ("origin", "id"))
    layers = {
        "rumble": (origin == "spectral-screening") | holds("low-frequency", "rumble", "50-hz"),
        "float": id_.startswith("overrange-") | holds("overrange"),
        "mono": holds("mono", "correlation", "stereo") | (text("type") == "stereo"),
        "editorial": (text("classification") == "editorial") | text("type").isin(*EDITORIAL_TYPES),
    }
    return layers.get(layer, F.lit(True))


def filter_markers(markers: DataFrame, severity: str | None = None, layer: str | None = None, start: float | None = None, end: float | None = None) -> DataFrame:
    """By severity, by layer of the timeline, and by overlap with a selection (both ends count)."""
    if severity:
        markers = markers.where(F.col("severity") == severity)
    if layer:
        markers = markers.where(in_layer(markers, layer))
    if start is not None:
        markers = markers.where((F.coalesce("end_seconds", "seconds") >= start) & (F.col("seconds") <= end))
    return markers


def merge_markers(existing: DataFrame, suggested: DataFrame) -> DataFrame:
    """Suggested markers join those whose id is not there yet, so a person's changes survive."""
    return existing.unionByName(suggested.join(existing.select("recording", "id"), ["recording", "id"], "left_anti"))


def replace_markers(markers: DataFrame, fresh: DataFrame, origin: str) -> DataFrame:
    """All markers of one origin give way to a fresh batch."""
    return markers.where(F.col("origin") != origin).unionByName(fresh)


def all_markers(kinds: dict[str, DataFrame]) -> DataFrame:
    """One table of machine markers: recording, kind, start_s, end_s (the start unless given), with each kind's class."""
    parts = []
    for kind, rows in kinds.items():
        severity, objective, heuristic = KINDS[kind]
        end = F.coalesce("end_s", "start_s") if "end_s" in rows.columns else F.col("start_s")
        parts.append(rows.select("recording", F.lit(kind).alias("kind"), "start_s", end.alias("end_s"), F.lit(severity).alias("severity"), F.lit(objective).alias("objective"), F.lit(heuristic).alias("heuristic")))
    return reduce(DataFrame.unionByName, parts)


def rank_markers(markers: DataFrame, most: int = 500) -> DataFrame:
    """By severity, then length, then start; the first ``most`` of a recording."""
    weight = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "review", 1).otherwise(2)
    order = Window.partitionBy("recording").orderBy(weight, F.desc(F.coalesce("end_seconds", "seconds") - F.col("seconds")), "seconds", "id")
    return markers.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def order_markers(markers: DataFrame) -> DataFrame:
    """Numbered by time within each recording; rows of a recording lie together, sorted."""
    order = Window.partitionBy("recording").orderBy("seconds", "id")
    return markers.withColumn("nth", F.row_number().over(order)).sortWithinPartitions("recording", "nth")


def marker_counts(markers: DataFrame) -> DataFrame:
    """Counts per recording and severity with recording totals (severity null), and those not yet reviewed: all, critical, and of privacy or removal."""
    waiting = F.col("review") == "unreviewed"
    counts = [F.count("*").alias("n"), F.count_if(waiting).alias("unreviewed"), F.count_if(waiting & (F.col("severity") == "critical")).alias("unreviewed_critical"), F.count_if(waiting & F.col("type").isin("privacy", "remove")).alias("unreviewed_editorial")]
    return markers.rollup("recording", "severity").agg(*counts).where("recording is not null")


def peaks_in_regions(peaks: DataFrame, regions: DataFrame) -> DataFrame:
    """The region that contains each recording's peak frame."""
    near = (F.col("p.recording") == F.col("r.recording")) & (F.col("p.peak_frame") >= F.col("r.start")) & (F.col("p.peak_frame") < F.col("r.end"))
    return peaks.alias("p").join(regions.alias("r"), near).select("p.recording", "p.peak_frame", "r.start", "r.end")


def interval_peak(regions: DataFrame, steps: DataFrame, fallback: DataFrame) -> DataFrame:
    """Greatest step level that a region (recording, id, first, last step) overlaps; else the recording's; else 0 dB."""
    spread = regions.withColumn("step", F.explode(F.sequence("first", F.greatest("first", "last"))))
    found = spread.join(steps.select("recording", "step", "level"), ["recording", "step"]).groupBy("recording", "id").agg(F.max("level").alias("inside"))
    out = regions.join(found, ["recording", "id"], "left").join(fallback.select("recording", F.col("level").alias("whole")), "recording", "left")
    return out.withColumn("level", F.coalesce("inside", "whole", F.lit(0.0)))


#: Types of a user's markers that a cue sheet takes (fixed values).
CUE_TYPES = ("descriptive", "user", "note", "privacy", "keep", "remove", "chapter")


def cue_sheet(markers: DataFrame, selections: DataFrame, types: tuple[str, ...] = CUE_TYPES, most: int = 200) -> DataFrame:
    """A user's markers of allowed types (null: user) inside a recording's selection, at times relative to its start, in order; the first ``most``."""
    inside = (F.col("seconds") >= F.col("start_s")) & (F.col("seconds") <= F.col("end_s"))
    out = markers.withColumn("type", F.coalesce("type", F.lit("user"))).where((F.col("origin") == "user") & F.col("type").isin(*types)).join(selections, "recording").where(inside)
    end = F.greatest(F.lit(0.0), F.coalesce("end_seconds", "seconds") - F.col("start_s"))
    out = out.withColumn("cue_start", F.col("seconds") - F.col("start_s")).withColumn("cue_end", F.least(F.col("end_s") - F.col("start_s"), end))
    order = Window.partitionBy("recording").orderBy("seconds", "id")
    return out.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
