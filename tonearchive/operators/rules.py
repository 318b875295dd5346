"""Rules over measured recordings: observations, gates, status, proposals and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.audio import all_that_hold, down, finite, half_up, when_first

#: Observation: severity, objective, next step (fixed values; the steps in own words).
OBSERVATIONS = {
    "truncated-data": ("warning", True, None),
    "non-finite": ("warning", True, "Keep the original; find the cause before any processed export."),
    "overrange": ("notice", True, "Play the marked regions, then decide how much lower an integer export must be."),
    "flat-top": ("notice", False, "Zoom in and listen: a plateau may be clipping or the signal itself."),
    "discontinuity": ("notice", False, "Listen in context: a fast step may be a natural transient."),
    "digital-zero": ("info", True, None),
    "low-level": ("info", True, "Listen at normal level; quiet is no fault in itself."),
    "overrange-region-limit": ("info", True, None),
    "lra-short": ("info", True, None),
    "byte-rate": ("info", True, None),
    "below-gate": ("info", True, "Judge the stillness and its intent; do not raise the level for the gate alone."),
    "no-valid-frames": ("warning", True, None),
}
DEFAULT_STEP = "Read the figure beside the timeline and listen before acting."
#: Limits of level classes by type of recording (fixed values): very low, low, reference, high; above: very high. A type not named counts as other; "objective" has none.
LEVELS = {
    "soundscape-quiet": (-30, -24, -18, -14),
    "soundscape-active": (-27, -21, -16, -12),
    "interview": (-24, -20, -16, -13),
    "music": (-24, -19, -14, -10),
    "other": (-28, -22, -16, -12),
}
#: Profile of a series: figures are fixed values; names and texts are this library's own.
SERIES = {
    "id": "series-default", "version": "1", "seconds": 1200.0, "target": -19.0, "lowest": -20.0, "highest": -18.0, "ceiling": -2.0,
    "policy": "Keep the dynamics of the place: one stated gain over all, and short fades at the edges if wanted.",
    "rationale": "A reference of our own for even listening; no service's standard and no criterion of acceptance.",
}
QUESTIONS = ("Is there a technical finding that must be listened to?", "Are dynamics and the sense of place preserved?", "Is anything left to review for editorial or privacy reasons?")
#: Regions of one kind that a recording's findings keep (fixed value).
KEPT_REGIONS = 50


def observations(summary: DataFrame) -> DataFrame:
    """One row per finding of a recording, with severity, objective and next step.

    Columns: truncated, not_finite, overrange, flat_tops, discontinuities, zero_seconds,
    low_seconds, overrange_regions, duration, loudness_range, byte_rate_ok, integrated, frames.
    """
    c = F.col
    found = all_that_hold(
        (c("truncated"), "truncated-data"), (c("not_finite") > 0, "non-finite"), (c("overrange") > 0, "overrange"), (c("flat_tops") > 0, "flat-top"), (c("discontinuities") > 0, "discontinuity"),
        (c("zero_seconds") > 0, "digital-zero"), (c("low_seconds") > 0, "low-level"), (c("overrange_regions") > KEPT_REGIONS, "overrange-region-limit"), ((c("duration") < 60) & c("loudness_range").isNotNull(), "lra-short"),
        (~c("byte_rate_ok"), "byte-rate"), (c("integrated").isNull(), "below-gate"), (c("frames") == 0, "no-valid-frames"),
    )
    return summary.select("recording", F.posexplode(found).alias("nth", "observation")).withColumn("nth", c("nth") + 1)


def observation_rules(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in OBSERVATIONS.items()]
    return spark.createDataFrame(rows, "observation string, severity string, objective boolean, step string")


def next_steps(found: DataFrame) -> DataFrame:
    """What to do about each observation; a default where nothing is set."""
    rules = F.broadcast(observation_rules(found.sparkSession))
    return found.join(rules, "observation", "left").withColumn("step", F.coalesce("step", F.lit(DEFAULT_STEP)))


def level_class(level: Column, kind: Column) -> Column:
    """very-low to very-high by the limits of the recording's type; null for a missing level and for objective measurements."""
    out = F
    for name, (a, b, c, d) in LEVELS.items():
        mine = ~F.coalesce(kind.isin(*[k for k in LEVELS if k != "other"]), F.lit(False)) if name == "other" else kind == name
        out = out.when(mine, F.when(level < a, "very-low").when(level < b, "low").when(level <= c, "reference").when(level <= d, "high").otherwise("very-high"))
    return F.when(level.isNotNull() & ~F.coalesce(kind == "objective", F.lit(False)), out.otherwise(None))


def level_limits(spark: SparkSession) -> DataFrame:
    rows = [(k, *map(float, v)) for k, v in LEVELS.items()]
    return spark.createDataFrame(rows, "kind string, very_low double, low double, reference double, high double")


def level_class_join(summary: DataFrame, limits: DataFrame) -> DataFrame:
    """As ``level_class``, by a join with a table of limits (one row per type)."""
    x = F.col("loudness")
    band = F.when(x < F.col("very_low"), "very-low").when(x < F.col("low"), "low").when(x <= F.col("reference"), "reference").when(x <= F.col("high"), "high").when(x.isNotNull() & F.col("high").isNotNull(), "very-high")
    kind = F.coalesce(F.col("kind"), F.lit("other"))
    kind = F.when(kind.isin("objective", *LEVELS), kind).otherwise("other")
    return summary.withColumn("kind", kind).join(F.broadcast(limits), "kind", "left").withColumn("level_class", band)


#: Slack of a ceiling in decibels, of a clamp in full scales (fixed values).
CEILING_SLACK, CLAMP_SLACK = 1e-9, 2.220446049250313e-16


def clamping_risk(maximum: Column, minimum: Column, bits: Column, dithered: Column) -> Column:
    """Whether integer samples of so many bits would be clamped by extremes after gain, or by dither of one step on top of them."""
    step = 1 / F.pow(F.lit(2.0), bits - 1)
    margin = F.when(dithered, step).otherwise(0.0)
    return F.coalesce((maximum + margin > 1 - step + CLAMP_SLACK) | (minimum - margin < -1 - CLAMP_SLACK), F.lit(False))


def export_gate(rows: DataFrame) -> DataFrame:
    """The first rule that forbids an export, or ``ok``.

    Columns: frames, gain_db, bit_exact, changed, valid_bits, bits, ceiling, enforce (null: unless
    bit exact), peak_db (null: not measured), not_finite, pcm, maximum, minimum (after gain).
    """
    c = F.col
    enforce = F.coalesce("enforce", ~c("bit_exact"))
    risk = c("pcm") & clamping_risk(c("maximum"), c("minimum"), c("bits"), ~c("bit_exact"))
    code = when_first(
        (c("frames") <= 0, "EMPTY_RANGE"), (~c("gain_db").between(-60, 24), "GAIN_RANGE"), (c("bit_exact") & c("changed"), "PROFILE_REQUIRES_BIT_EXACT_PAYLOAD"), ((c("valid_bits") != c("bits")) & ~c("bit_exact"), "VALID_BITS_REENCODE_BLOCKED"),
        (~F.coalesce(c("ceiling").between(-60, 0), F.lit(False)), "CEILING_RANGE"), (enforce & (c("peak_db") > c("ceiling") + CEILING_SLACK), "TRUE_PEAK_CEILING_EXCEEDED"), ((c("not_finite") > 0) & ~c("bit_exact"), "INVALID_FLOAT_TRANSFORM_BLOCKED"), (risk, "PCM_CLAMPING_RISK"),
        otherwise="ok",
    )
    return rows.withColumn("gate", code)


def verify_output(rows: DataFrame) -> DataFrame:
    """The first check that an output fails against its source, or ``ok``.

    Columns: structure_equal, ceiling, enforce, peak_db, not_finite, bit_exact, source_hash, output_hash.
    """
    c = F.col
    code = when_first(
        (~c("structure_equal"), "OUTPUT_STRUCTURE_VERIFICATION_FAILED"), (c("enforce") & (c("peak_db") > c("ceiling") + CEILING_SLACK), "VERIFIED_TRUE_PEAK_CEILING_EXCEEDED"), ((c("not_finite") > 0) & ~c("bit_exact"), "VERIFIED_INVALID_FLOAT"),
        (c("bit_exact") & (c("source_hash") != c("output_hash")), "SAMPLE_PAYLOAD_IDENTITY_FAILED"), otherwise="ok",
    )
    return rows.withColumn("verified", code)


PUBLICATION = ("duration", "verified_wav", "markers_reviewed", "full_listen", "boundaries", "stereo", "mono", "privacy", "metadata", "archive_saved")


def publication_status(rows: DataFrame, target: float = SERIES["seconds"]) -> DataFrame:
    """Ten checks, those that fail in order, and ready or review-required; nothing is blocked by it.

    The duration may be off by a sample at 44.1 kHz or a millisecond, whichever is more, or by any amount with a
    note. Columns: duration_s, note, verified, critical_unreviewed, editorial_unreviewed, full_listen, boundaries,
    stereo, mono, privacy, archived, title, episode, place.
    """
    c = F.col
    written = lambda name: F.length(F.trim(F.coalesce(c(name).cast("string"), F.lit("")))) > 0
    close = F.abs(c("duration_s") - target) <= max(1 / 44_100, 0.001)
    checks = [
        F.coalesce(close, F.lit(False)) | written("note"), c("verified"), (c("critical_unreviewed") == 0) & (c("editorial_unreviewed") == 0), c("full_listen"), c("boundaries"), c("stereo"), c("mono"), c("privacy"),
        written("title") & written("episode") & written("place"), c("archived"),
    ]
    failed = all_that_hold(*[(~F.coalesce(x, F.lit(False)), name) for x, name in zip(checks, PUBLICATION, strict=True)])
    return rows.withColumn("incomplete", failed).withColumn("status", F.when(F.size("incomplete") == 0, "ready").otherwise("review-required"))


def series_proposal(gain: Column, loudness: Column, peak: Column, target: float = SERIES["target"], ceiling: float = SERIES["ceiling"]) -> Column:
    """Gain towards the series target as far as the peak's ceiling allows, to a tenth."""
    return half_up(gain + F.least(target - loudness, ceiling - peak), 1)


def peak_scenarios(rows: DataFrame) -> DataFrame:
    """What each ceiling asks of a recording (peak, gain, loudness): the reduction, peak and loudness after it, and the gain to set.

    A reduction of a hundredth or less changes nothing; else the gain is floored to tenths, at least -60 dB.
    """
    out = rows.withColumn("ceiling", F.explode(F.array(F.lit(-1.0), F.lit(-2.0), F.lit(-3.0))))
    out = out.withColumn("reduction", F.when(F.col("peak").isNotNull(), F.least(F.lit(0.0), F.col("ceiling") - F.col("peak"))))
    out = out.withColumn("peak_after", F.col("peak") + F.col("reduction")).withColumn("loudness_after", F.col("loudness") + F.col("reduction"))
    return out.withColumn("next_gain", F.when(F.col("reduction") >= -0.01, F.col("gain")).when(F.col("reduction").isNotNull(), F.greatest(F.lit(-60.0), down(F.col("gain") + F.col("reduction"), 1))))


def peak_categories(rows: DataFrame) -> DataFrame:
    """Four rows per recording: category (float, digital, analog, delivery), state and finding.

    Columns: analyzed, sample_peak, true_peak, overrange, invalid, is_float, flat_top, incomplete.
    """
    c = F.col
    unsound, stored_over = (c("invalid") > 0) | c("incomplete"), c("is_float") & (c("overrange") > 0)
    said = {
        "float": F.when(stored_over, "info:kept-overrange").when(c("is_float"), "neutral:none-found").otherwise("neutral:not-applicable"),
        "digital": F.when(unsound, "warning:not-assessable").when(c("flat_top"), "review:plateau").when(~c("is_float") & (c("sample_peak") >= -0.01), "review:full-scale").otherwise("safe:none-found"),
        "analog": F.lit("unknown:not-decidable"),
        "delivery": F.when(unsound, "warning:check-integrity").when(stored_over | (c("true_peak") > 0) | (c("sample_peak") > 0), "warning:lower-first").when(c("true_peak") > -1, "review:small-margin").otherwise("safe:margin"),
    }
    said = {k: F.when(c("analyzed"), v).otherwise("waiting:not-analyzed") for k, v in said.items()}
    long = rows.select("recording", *[v.alias(k) for k, v in said.items()]).unpivot("recording", list(said), "category", "said")
    return long.select("recording", "category", F.split_part("said", F.lit(":"), F.lit(1)).alias("state"), F.split_part("said", F.lit(":"), F.lit(2)).alias("finding"))


def integrity_state() -> Column:
    """waiting, stop, review or pass. Columns: analyzed, not_finite, truncated, flat_top."""
    c = F.col
    return F.when(~c("analyzed"), "waiting").when((c("not_finite") > 0) | c("truncated"), "stop").when(c("flat_top"), "review").otherwise("pass")


def preflight_state(target: float = SERIES["ceiling"]) -> Column:
    """Of the selection about to be exported. Further columns: region_running, processed (measured anew), processed_not_finite, processed_peak, ceiling (null: the series')."""
    c = F.col
    return (
        F.when(~c("analyzed"), "waiting").when(integrity_state() == "stop", "stop").when(c("region_running"), "running").when(~c("processed"), "review").when(c("processed_not_finite") > 0, "stop")
        .when(c("processed_peak").isNull() | (c("processed_peak") > F.coalesce("ceiling", F.lit(target))), "review").otherwise("pass")
    )


def status_board(rows: DataFrame) -> DataFrame:
    """One row per recording and module: waiting, stop, review, pass, info, unknown or running.

    Columns: those of ``preflight_state``, and true_peak, overrange, is_float, loudness, kind, purpose,
    risk_regions, spectral_running, spectral_regions (null: not screened), unreviewed.
    """
    c = F.col
    rating = level_class(c("loudness"), c("kind"))
    modules = {
        "integrity": integrity_state(),
        "peaks": F.when(c("flat_top") | (c("true_peak") > -2), "review").when(c("is_float") & (c("overrange") > 0), "info").otherwise("pass"),
        "loudness": F.when((c("purpose") == "preservation") | (c("kind") == "objective"), "info").when(rating.isNull(), "unknown").when(rating == "reference", "pass").otherwise("info"),
        "dynamics": F.lit("info"),
        "stereo": F.when(c("risk_regions") > 0, "review").otherwise("pass"),
        "rumble": F.when(~c("spectral_running") & (c("spectral_regions") > 0), "review").otherwise("info"),
        "review": F.when(c("unreviewed") > 0, "review").otherwise("pass"),
        "preflight": preflight_state(),
    }
    return rows.select("recording", *[F.when(c("analyzed"), v).otherwise("waiting").alias(k) for k, v in modules.items()]).unpivot("recording", list(modules), "module", "status")


def recommendations(rows: DataFrame) -> DataFrame:
    """Ordered actions of a recording, one row each, with decibels where a trial gain is proposed; ``listen`` if there is nothing else.

    Columns: not_finite, overrange, kind, purpose, plr (null: peak less loudness), peak, loudness.
    """
    c = F.col
    rating, other = level_class(c("loudness"), c("kind")), F.lit(float(LEVELS["other"][1]))
    low_limit = F.coalesce(F.element_at(F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(float(v[1])))]), c("kind")), other)
    available = F.greatest(F.lit(0.0), -2 - c("peak"))
    trial = F.least(F.greatest(F.lit(0.0), low_limit - c("loudness")), available, F.lit(6.0))
    told = c("peak").isNotNull() & (c("purpose") == "distribution")
    rows = rows.withColumn("rating", rating).withColumn("trial", F.when(told & rating.isin("very-low", "low") & (available >= 0.5) & (trial >= 0.5), trial))
    actions = all_that_hold(
        (c("not_finite") > 0, "check-invalid"), (c("overrange") > 0, "check-overrange"), (c("kind").isin("soundscape-quiet", "soundscape-active"), "screen-rumble"), (F.coalesce(c("plr"), c("peak") - c("loudness")) >= 14, "keep-dynamics"),
        (c("trial").isNotNull(), "try-gain"), (told & c("rating").isin("high", "very-high"), "keep-level"),
    )
    actions = F.when(F.size(actions) > 0, actions).otherwise(F.array(F.lit("listen")))
    out = rows.select("recording", "trial", F.posexplode(actions).alias("nth", "action"))
    return out.select("recording", c("nth") + 1, "action", F.when(c("action") == "try-gain", c("trial")).alias("amount")).toDF("recording", "nth", "action", "amount")


def safe_level(rows: DataFrame, headroom: float = -3.0) -> DataFrame:
    """Whether a recording may be played, why, and how much lower: ready, reason, projected, safety, total.

    Columns: analyzed, trusted, true_peak, sample_peak (used where there is no true peak), edit_gain (null: 0).
    Without an analysis, trust in it, or a peak nothing is played and safety is null.
    """
    c = F.col
    peak = F.coalesce(*[F.when(finite(p), c(p)) for p in ("true_peak", "sample_peak")])
    edit = F.when(finite("edit_gain"), c("edit_gain")).otherwise(0.0)
    safety = F.least(F.lit(0.0), headroom - (peak + edit))
    reason = F.when(~c("analyzed"), "not-analyzed").when(~c("trusted"), "untrusted-analysis").when(peak.isNull(), "missing-peak").when(safety < 0, "attenuated").otherwise("safe")
    ready = reason.isin("attenuated", "safe")
    return rows.withColumns({"reason": reason, "ready": ready, "projected": F.when(ready, peak + edit), "safety": F.when(ready, safety), "total": F.when(ready, edit + safety).otherwise(0.0)})


def projected_metrics(rows: DataFrame) -> DataFrame:
    """Loudness and peak after a gain, and a warning if the peak passes full scale."""
    return rows.withColumn("projected_loudness", F.col("loudness") + F.col("gain")).withColumn("projected_peak", F.col("peak") + F.col("gain")).withColumn("warning", F.when(F.col("projected_peak") > 0, "peak-over-full-scale"))


def coordinates(value: Column, policy: str, digits: int = 3) -> Column:
    """A coordinate written with comma or point: hidden, rounded or exact; text that is no number is hidden."""
    if policy == "hidden":
        return F.lit(None).cast("string")
    number = F.regexp_replace(F.trim(value), ",", ".").try_cast("double")
    if policy == "exact":
        return F.when(number.isNotNull(), F.regexp_replace(F.trim(value), ",", "."))
    return F.format_string(f"%.{digits}f", half_up(number, digits)) if digits else number.cast("long").cast("string")


def slug(text: Column, longest: int = 80) -> Column:
    """Lower case, accents of Latin letters dropped, everything else to single hyphens; at most ``longest`` characters."""
    folded = F.translate(F.lower(text), "åäöéèêëüùûáàâãóòôõíìîïñç", "aaoeeeeuuuaaaaooooiiiinc")
    return F.substring(F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-|-$", ""), 1, longest)


def master_file_name(title: Column, episode: Column, fallback: Column, prefix: str = "EP") -> Column:
    """prefix_E<episode, three digits at least>_<slug of title or fallback>_MASTER.wav."""
    digits = F.regexp_replace(F.coalesce(episode, F.lit("")), "[^0-9]", "")
    name = F.coalesce(F.nullif(slug(F.coalesce(title, fallback)), F.lit("")), F.lit("episode"))
    return F.concat(F.lit(f"{prefix}_E"), F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0")), F.lit("_"), name, F.lit("_MASTER.wav"))


MANIFEST = "tonearchive.episode-handoff/1"
#: Texts of a handoff with their greatest lengths (fixed values).
HANDOFF = {"title": 500, "series": 500, "session": 500, "place": 500, "date": 80, "local_time": 80, "tags": 2000, "description": 2000, "artwork": 2000}


def episode_manifest(rows: DataFrame) -> DataFrame:
    """``manifest``: schema, time, episode, location (hidden unless disclosed), verified master, publication and report of each recording.

    Columns: those of ``HANDOFF``, episode (text), disclosure, latitude, longitude, sha256, duration_s, loudness,
    true_peak, loudness_range, plr, channels, sample_rate, status, incomplete, report_id; created_at (now, if it is missing). Missing texts are empty.
    """
    c = F.col
    created = c("created_at") if "created_at" in rows.columns else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    shown = F.coalesce("disclosure", F.lit("hidden")) != "hidden"
    number = lambda name: F.when(finite(c(name).cast("double")), c(name)).alias(name)
    texts = [F.substring(F.coalesce(c(k).cast("string"), F.lit("")), 1, n).alias(k) for k, n in HANDOFF.items()]
    episode = F.struct(c("episode").try_cast("double").alias("number"), *texts)
    location = F.struct(F.substring(F.coalesce("disclosure", F.lit("hidden")), 1, 40).alias("disclosure"), F.when(shown, c("latitude")).alias("latitude"), F.when(shown, c("longitude")).alias("longitude"))
    master = F.struct(F.nullif(F.substring(c("sha256"), 1, 128), F.lit("")).alias("sha256"), *[number(n) for n in ("duration_s", "loudness", "true_peak", "loudness_range", "plr", "channels", "sample_rate")])
    publication = F.struct("status", "incomplete")
    return rows.withColumn("manifest", F.struct(F.lit(MANIFEST).alias("schema"), created.alias("createdAt"), episode.alias("episode"), location.alias("location"), master.alias("master"), publication.alias("publication"), F.nullif(F.substring("report_id", 1, 500), F.lit("")).alias("report_id")))


def editorial_context(purpose: str = "distribution", seconds: Column | None = None) -> Column:
    """The series' profile as a struct, to go with every bundle; ``seconds`` replaces its target duration where it is a finite number."""
    own = lambda k: F.lit(SERIES[k])
    target = own("seconds") if seconds is None else F.coalesce(F.when(finite(seconds), seconds), own("seconds"))
    loudness = F.struct(own("target").alias("targetLufs"), own("lowest").alias("rangeMinLufs"), own("highest").alias("rangeMaxLufs"), own("rationale").alias("rationale"))
    return F.struct(
        F.lit("editorial").alias("classification"), own("id").alias("seriesProfileId"), own("version").alias("seriesProfileVersion"), F.lit(purpose[:80]).alias("purpose"), target.alias("targetDurationSeconds"), F.lit(1 / 44_100).alias("durationToleranceSeconds"),
        loudness.alias("loudnessOrientation"), own("ceiling").alias("truePeakOrientationDbtp"), own("policy").alias("continuityPolicy"), F.array(*map(F.lit, QUESTIONS)).alias("questions"),
    )


def rumble_score(low: Column, subsonic: Column, upper: Column, correlation: Column) -> Column:
    """Points for low-frequency noise; null if a share is missing. A missing correlation (mono) gives no point."""
    score = F.when(low >= 55, 3).when(low >= 35, 2).when(low >= 20, 1).otherwise(0) + F.when(subsonic >= 12, 2).when(subsonic >= 4, 1).otherwise(0) + F.when(upper >= 45, -1).otherwise(0) + F.when(correlation < 0.35, 1).otherwise(0)
    return F.when(low.isNotNull() & subsonic.isNotNull() & upper.isNotNull(), score)


def rumble_class(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 4, "elevated").when(score >= 2, "moderate").otherwise("low")
