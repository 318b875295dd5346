"""Rules, markers and documents over the signals derived from the tables."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents, loudness, markers, regions, rules, stats
from ..sources import signals
from .registry import out, query, r

#: Columns that the rule queries add to a measured recording.
_MORE = """rep as (select *, recording % 11 = 0 as truncated, case when recording % 13 = 0 then 2 else 0 end as not_finite, case when peak > 0 then 3 else 0 end as overrange, recording % 3 as flat_tops, recording % 4 as discontinuities,
 cast(recording % 5 as double) as zero_seconds, cast(recording % 7 as double) as low_seconds, recording % 2003 as overrange_regions, case when recording % 6 > 0 then cast(recording % 30 as double) end as loudness_range, recording % 17 > 0 as byte_rate_ok,
 case when recording % 9 > 0 then loudness end as integrated, recording % 19 as frames, case when recording % 8 > 0 then recording % 100 / 50.0 - 1 end as correlation, case when recording % 7 > 0 then recording % 6 end as rumble, recording % 4 as unreviewed from reports)"""


def _more(spark, d):
    n, c = F.col("recording"), F.col
    return signals.reports(spark, d).select(
        "*", (n % 11 == 0).alias("truncated"), F.when(n % 13 == 0, 2).otherwise(0).alias("not_finite"), F.when(c("peak") > 0, 3).otherwise(0).alias("overrange"), (n % 3).alias("flat_tops"), (n % 4).alias("discontinuities"),
        (n % 5).cast("double").alias("zero_seconds"), (n % 7).cast("double").alias("low_seconds"), (n % 2003).alias("overrange_regions"), F.when(n % 6 > 0, (n % 30).cast("double")).alias("loudness_range"), (n % 17 > 0).alias("byte_rate_ok"),
        F.when(n % 9 > 0, c("loudness")).alias("integrated"), (n % 19).alias("frames"), F.when(n % 8 > 0, n % 100 / 50.0 - 1).alias("correlation"), F.when(n % 7 > 0, n % 6).alias("rumble"), (n % 4).alias("unreviewed"),
    )


_RULES = [("truncated", "truncated-data"), ("not_finite > 0", "non-finite"), ("overrange > 0", "overrange"), ("flat_tops > 0", "flat-top"), ("discontinuities > 0", "discontinuity"), ("zero_seconds > 0", "digital-zero"), ("low_seconds > 0", "low-level"), ("overrange_regions > 50", "overrange-region-limit"), ("duration < 60 and loudness_range is not null", "lra-short"), ("not byte_rate_ok", "byte-rate"), ("integrated is null", "below-gate"), ("frames = 0", "no-valid-frames")]
_list = lambda rows: "list_filter([" + ", ".join(f"case when {c} then '{t}' end" for c, t in rows) + "], lambda x: x is not null)"
_case = lambda rows, end=None: "case " + " ".join(f"when {c} then '{t}'" for c, t in rows) + (f" else '{end}'" if end else "") + " end"
_OBS = f"o as (select recording, unnest({_list(_RULES)}) as observation, generate_subscripts({_list(_RULES)}, 1) as nth from rep)"


@query("f1_observations", f"with {_MORE}, {_OBS} select recording, nth, observation from o", "reports")
def f1(spark, d):
    return out(rules.observations(_more(spark, d)), "recording nth", "", "observation")


_KNOWN = ", ".join(f"('{k}', '{s}', {str(o).lower()}, {f"'{t.replace(chr(39), chr(39) * 2)}'" if t else 'null'})" for k, (s, o, t) in rules.OBSERVATIONS.items())


@query("f32_next_steps", f"with {_MORE}, {_OBS}, known(observation, severity, objective, step) as (values {_KNOWN}) select recording, observation, severity, coalesce(step, '{rules.DEFAULT_STEP}') as step from o left join known using (observation)", "reports")
def f32(spark, d):
    return out(rules.next_steps(rules.observations(_more(spark, d))), "recording", "", "observation severity step")


@query("f2_marker_kind", """select recording, id, case when severity = 'critical' then 'own kind' when type = 'view' then 'invalid-float' when type = 'click' then 'possible-flat-top' when type = 'error' then 'silence' else 'review-point' end as kind from markers""", "markers")
def f2(spark, d):
    m = signals.markers(spark, d)
    text = F.when(F.col("type") == "view", "Short-term step to INFINITY").otherwise(F.col("text"))
    return out(m.withColumn("kind", markers.marker_kind(text, F.when(F.col("severity") == "critical", " Own Kind ").otherwise(" "))), "recording", "", "id kind")


@query("f3_marker_class", """select recording, id, case type when 'click' then 'information' when 'error' then 'review' else replace(severity, 'info', 'information') end as severity, case type when 'view' then 'objective' when 'error' then 'artistic' else 'heuristic' end as class from markers""", "markers")
def f3(spark, d):
    t = F.col("type")
    severity = F.when(t == "click", "info").when(t == "error", "error").otherwise(F.col("severity"))
    kind = markers.marker_class(t.isin("view", "click"), t == "click", F.when(t == "error", "artistic").otherwise("odd"))
    return out(signals.markers(spark, d).withColumn("class", kind).withColumn("severity", markers.marker_severity(severity)), "recording", "", "id severity class")


@query("f4_sanitize", f"""with k as (select *, severity = 'critical' and type = 'view' and review <> 'open' as exact from markers), t as (select *, greatest(0.0, least(100.0, case when exact then seconds else floor(seconds + 0.5) end)) as s, greatest(0.0, least(100.0, case when exact then end_seconds else floor(end_seconds + 0.5) end)) as e from k)
 select recording, id, {r("s", "start_s")}, {r("greatest(s, e)", "end_s")} from t""", "markers")
def f4(spark, d):
    m = signals.markers(spark, d).withColumn("objective", F.col("type") == "view").withColumn("heuristic", F.col("review") == "open")
    return out(markers.sanitize_markers(m, F.lit(100.0)), "recording", "start_s end_s", "id")


@query("f5_normalize", f"""select recording, id, {r("case when type = 'view' then 0.0 else seconds end", "seconds")}, {r("case type when 'click' then seconds else end_seconds end", "end_seconds")}, case when type = 'click' then 'privacy' else 'user' end as type,
 case type when 'click' then 'critical' when 'view' then 'review' else severity end as severity, case when review = 'reviewed' then 'accepted' else 'unreviewed' end as review, case when type = 'signup' then 'analysis' else 'user' end as origin from markers where type <> 'error'""", "markers")
def f5(spark, d):
    m, t = signals.markers(spark, d), F.col("type")
    raw = m.select(
        "recording", "id", F.when(t == "error", "soon").when(t == "view", "-1").otherwise(F.col("seconds").cast("string")).alias("seconds"), F.when(t != "click", F.col("end_seconds").cast("string")).alias("end_seconds"), F.when(t == "click", "privacy").otherwise(t).alias("type"),
        F.when(t == "click", "Warning!").when(t == "view", "technical").otherwise(F.col("severity")).alias("severity"), F.when(F.col("review") == "reviewed", "accepted").otherwise(F.col("review")).alias("review"), F.lit(None).cast("boolean").alias("objective"), (t == "signup").alias("suggested"), F.lit(None).cast("string").alias("origin"), "text",
    )
    return out(markers.normalize_markers(raw), "recording", "seconds end_seconds", "id type severity review origin")


_LAYERS = ("all", "rumble", "float", "mono", "editorial")


@query("b12_filter_markers", """with k as (select *, case when text like '%full scale%' then 'float-overrange' when text like '%zero%' then 'Possible-Rumble' when text like '%flat%' then 'mono-fold' else 'other' end as kind, case when type = 'signup' then 'Chapter' else type end as t from markers),
 l as (select *, unnest(['all', 'rumble', 'float', 'mono', 'editorial']) as layer from k)
 select layer, recording, id from l where severity = 'review' and end_seconds >= 10 and seconds <= 60 and case layer when 'all' then true when 'rumble' then kind = 'Possible-Rumble' when 'float' then kind = 'float-overrange' when 'mono' then kind = 'mono-fold' else t = 'Chapter' end""", "markers")
def b12(spark, d):
    kind = F.when(F.col("text").contains("full scale"), "float-overrange").when(F.col("text").contains("zero"), "Possible-Rumble").when(F.col("text").contains("flat"), "mono-fold").otherwise("other")
    m = signals.markers(spark, d).withColumn("kind", kind).withColumn("type", F.when(F.col("type") == "signup", "Chapter").otherwise(F.col("type")))
    found = [markers.filter_markers(m, "review", layer, 10.0, 60.0).withColumn("layer", F.lit(layer)) for layer in _LAYERS]
    return out(functools.reduce(DataFrame.unionByName, found), "recording", "", "layer id")


@query("l3_rank_markers", "with o as (select *, row_number() over (partition by recording order by case severity when 'critical' then 0 when 'review' then 1 else 2 end, end_seconds - seconds desc, seconds, id) as nth from markers) select recording, id, nth from o where nth <= 500", "markers")
def l3(spark, d):
    return out(markers.rank_markers(signals.markers(spark, d)), "recording nth", "", "id")


@query("l4_order_markers", "select recording, id, row_number() over (partition by recording order by seconds, id) as nth from markers", "markers")
def l4(spark, d):
    return out(markers.order_markers(signals.markers(spark, d)), "recording nth", "", "id")


@query("c15_marker_counts", "select recording, severity, count(*) as n, count(*) filter (review <> 'reviewed') as unreviewed, count(*) filter (review <> 'reviewed' and severity = 'critical') as unreviewed_critical, count(*) filter (review <> 'reviewed' and type = 'click') as unreviewed_editorial from markers group by rollup (recording, severity) having recording is not null", "markers")
def c15(spark, d):
    m = signals.markers(spark, d).withColumn("type", F.when(F.col("type") == "click", "privacy").otherwise(F.col("type"))).withColumn("review", F.when(F.col("review") == "reviewed", "accepted").otherwise("unreviewed"))
    return out(markers.marker_counts(m), "recording n unreviewed unreviewed_critical unreviewed_editorial", "", "severity")


@query("j4_merge_markers", "with a as (select recording, id, 'user' as origin from markers where type in ('view', 'click')), b as (select recording, id, 'machine' as origin from markers where type in ('click', 'error')) select * from a union all select * from b where not exists (select 1 from a where a.id = b.id and a.recording = b.recording)", "markers")
def j4(spark, d):
    m = signals.markers(spark, d)
    a = m.where("type in ('view', 'click')").select("recording", "id", F.lit("user").alias("origin"))
    b = m.where("type in ('click', 'error')").select("recording", "id", F.lit("machine").alias("origin"))
    return out(markers.merge_markers(a, b), "recording", "", "id origin")


@query("s2_replace_markers", "select recording, id, type as origin from markers where type <> 'error' union all select recording, id || '-new', 'error' from markers where type = 'error' and severity <> 'info'", "markers")
def s2(spark, d):
    m = signals.markers(spark, d)
    fresh = m.where("type = 'error' and severity <> 'info'").select("recording", F.concat("id", F.lit("-new")).alias("id"), F.lit("error").alias("origin"))
    return out(markers.replace_markers(m.select("recording", "id", F.col("type").alias("origin")), fresh, "error"), "recording", "", "id origin")


_RUN = lambda cond, src="dirty": f"(select recording, min(frame) as s, max(frame) + 1 as e, count(*) as n from (select *, frame - row_number() over (partition by recording order by frame) as island from {src} where {cond}) group by recording, island)"


@query("s1_all_markers", f"""select recording, 'digital-zero' as kind, s / 100.0 as start_s, e / 100.0 as end_s, 'info' as severity from {_RUN('"left" = 0 and "right" = 0')} where n >= 2
 union all select recording, 'invalid', s / 100.0, e / 100.0, 'critical' from {_RUN('isnan("left")')}
 union all select recording, 'sample-peak', arg_max(frame, (greatest(abs("left"), abs("right")), -frame)) / 100.0 as start_s, start_s as end_s, 'info' from dirty where not isnan("left") group by recording""", "dirty")
def s1(spark, d):
    f = signals.dirty(spark, d)
    timed = lambda x: x.select("recording", (F.col("start") / 100).alias("start_s"), (F.col("end") / 100).alias("end_s"))
    left = stats.by_channel(f).where("channel = 0")
    finite = f.where("not isnan(left)")
    peak = finite.groupBy("recording").agg((F.max_by("frame", F.struct(F.greatest(F.abs("left"), F.abs("right")), -F.col("frame"))) / 100).alias("start_s"))
    found = markers.all_markers({"digital-zero": timed(regions.zero_regions(f, 2)), "invalid": timed(regions.invalid_regions(left)), "sample-peak": peak})
    return out(found, "recording", "start_s end_s", "kind severity")


@query("j5_peaks_in_regions", f"""with o as (select recording, arg_max(frame, (greatest(abs("left"), abs("right")), -frame)) as peak_frame from frames group by recording) select o.recording, peak_frame, s as start, e as "end" from o join {_RUN('abs("left") > 1 or abs("right") > 1', 'frames')} x on x.recording = o.recording and peak_frame >= s and peak_frame < e""", "frames")
def j5(spark, d):
    f = signals.frames(spark, d)
    peaks = f.groupBy("recording").agg(F.max_by("frame", F.struct(F.greatest(F.abs("left"), F.abs("right")), -F.col("frame"))).alias("peak_frame"))
    return out(markers.peaks_in_regions(peaks, regions.overrange_regions(f)), "recording peak_frame start end")


@query("j6_interval_peak", f"""with st as (select recording, floor(frame / 10) as step, max("left") as level from frames group by all), w as (select recording, max("left") as whole from frames group by recording)
 select m.recording, m.id, {r("coalesce(max(st.level), any_value(whole))", "level")} from markers m left join st on st.recording = m.recording and st.step between floor(m.seconds / 2) and floor(m.end_seconds / 2) left join w on w.recording = m.recording group by m.recording, m.id""".replace("with st", f"with {signals.SQL['frames']}, st"), "markers")
def j6(spark, d):
    f = signals.frames(spark, d)
    step = f.groupBy("recording", F.floor(F.col("frame") / 10).alias("step")).agg(F.max("left").alias("level"))
    whole = f.groupBy("recording").agg(F.max("left").alias("level"))
    m = signals.markers(spark, d).select("recording", "id", F.floor(F.col("seconds") / 2).alias("first"), F.floor(F.col("end_seconds") / 2).alias("last"))
    return out(markers.interval_peak(m, step, whole), "recording", "level", "id")


@query("j7_cue_sheet", f"""with c as (select *, row_number() over (partition by recording order by seconds, id) as nth from markers where type in ('click', 'signup') and severity <> 'info' and seconds >= 10 and seconds <= 90)
 select recording, id, {r("seconds - 10", "cue_start")}, {r("least(end_seconds, 90.0) - 10", "cue_end")}, nth from c where nth <= 200""", "markers")
def j7(spark, d):
    m, t = signals.markers(spark, d), F.col("type")
    m = m.withColumn("origin", F.when(F.col("severity") == "info", "analysis").otherwise("user")).withColumn("type", F.when(t == "click", "chapter").when(t != "signup", "technical"))
    selections = m.select("recording").distinct().select("recording", F.lit(10.0).alias("start_s"), F.lit(90.0).alias("end_s"))
    return out(markers.cue_sheet(m, selections), "recording nth", "cue_start cue_end", "id")


@query("c14_series_overview", f"with u as (unpivot (select series, loudness, peak, duration from reports) on loudness, peak, duration into name field value value) select series, field, {r('quantile_cont(value, 0.5)', 'median')}, {r('min(value)', 'least')}, {r('max(value)', 'greatest')}, count(*) as n from u group by all", "reports")
def c14(spark, d):
    rep, n = signals.reports(spark, d), F.col("recording")
    summary = F.struct(F.col("loudness").alias("integratedLufs"), F.col("peak").alias("truePeakDbtp"))
    verified = F.struct(F.struct(F.col("duration").alias("durationSeconds")).alias("format"), summary.alias("summary"))
    older = F.struct(F.col("duration").alias("duration"), F.struct(F.col("loudness").alias("lufsI"), F.col("peak").alias("truePeakEstimateDbtp")).alias("summary"))
    sections = lambda x: F.to_json(F.struct(F.struct(x.alias("verifiedExportFile")).alias("sections")))
    layouts = [sections(F.struct(verified.alias("analysis"))), sections(F.struct(older.alias("verifiedOutput"))), sections(verified), F.to_json(F.struct(older.alias("verifiedOutput"))), F.to_json(F.struct(F.struct(older.alias("verifiedOutput")).alias("exportReport"))), F.to_json(F.struct(summary.alias("summary"), F.struct(F.col("duration").alias("durationSeconds")).alias("metadata")))]
    report = F
    for k, text in enumerate(layouts):
        report = report.when(n % len(layouts) == k, text)
    report = report.otherwise(None)
    return out(stats.series_overview(stats.report_values(rep.select("series", report.alias("report"))), ["loudness", "peak", "duration"]), "n", "median least greatest", "series field")


@query("c16_spectral_summary", f"select recording, {r('quantile_cont(energy, 0.5)', 'energy_median')}, {r('max(energy)', 'energy_max')}, {r('quantile_cont(correlation, 0.5)', 'correlation_median')}, {r('max(correlation)', 'correlation_max')} from steps group by recording", "steps")
def c16(spark, d):
    return out(stats.spectral_summary(signals.steps(spark, d), ["energy", "correlation"]), "recording", "energy_median energy_max correlation_median correlation_max")


@query("c17_conformance", """with e as (select recording, -20.0 as expected, -2.5 as lower, 2.5 as upper, case when recording % 10 > 0 then loudness end as actual, series from reports)
 select series, case when actual is null then 'missing' when actual - expected between lower and upper then 'passed' else 'failed' end as status, count(*) as n from e group by all""", "reports")
def c17(spark, d):
    rep = signals.reports(spark, d).withColumn("file", F.col("recording").cast("string"))
    expected = rep.select("file", F.lit("loudness").alias("metric"), "series", F.lit(-20.0).alias("expected"), F.lit(-2.5).alias("lower"), F.lit(2.5).alias("upper"))
    measured = rep.where("recording % 10 > 0").select("file", F.lit("loudness").alias("metric"), F.col("loudness").alias("actual"))
    return out(stats.conformance(expected, measured).groupBy("series", "status").agg(F.count("*").alias("n")), "n", "", "series status")


_GATE_COLUMNS = "g as (select *, recording % 5 = 0 as bit_exact, recording % 2 = 0 as changed, case when recording % 7 = 0 then 20 else 24 end as valid_bits, 24 as bits, case when recording % 29 = 0 then -70.0 when recording % 31 <> 0 then -2.0 end as ceiling, case when recording % 3 = 0 then recording % 5 <> 0 end as enforce, peak as peak_db, recording % 3 = 0 as pcm, case recording % 4 when 0 then 0.5 when 1 then 0.9999998 when 2 then 1.2 else 0.3 end as maximum, case when recording % 8 = 3 then -1.1 else -0.5 end as minimum, gain * 6 as gain_db from rep)"
_GATE_RULES = [("frames <= 0", "EMPTY_RANGE"), ("gain_db < -60 or gain_db > 24", "GAIN_RANGE"), ("bit_exact and changed", "PROFILE_REQUIRES_BIT_EXACT_PAYLOAD"), ("valid_bits <> bits and not bit_exact", "VALID_BITS_REENCODE_BLOCKED"), ("recording % 29 = 0 or recording % 31 = 0", "CEILING_RANGE"), ("recording % 5 <> 0 and peak > -2.0 + 1e-9", "TRUE_PEAK_CEILING_EXCEEDED"), ("not_finite > 0 and not bit_exact", "INVALID_FLOAT_TRANSFORM_BLOCKED"), ("pcm and (recording % 4 = 2 or recording % 8 = 3 or (recording % 4 = 1 and not bit_exact))", "PCM_CLAMPING_RISK")]


def _gate(spark, d):
    n = F.col("recording")
    return _more(spark, d).select(
        "*", (n % 5 == 0).alias("bit_exact"), (n % 2 == 0).alias("changed"), F.when(n % 7 == 0, 20).otherwise(24).alias("valid_bits"), F.lit(24).alias("bits"), F.when(n % 29 == 0, -70.0).when(n % 31 != 0, -2.0).alias("ceiling"), F.when(n % 3 == 0, n % 5 != 0).alias("enforce"),
        F.col("peak").alias("peak_db"), (n % 3 == 0).alias("pcm"), F.when(n % 4 == 0, 0.5).when(n % 4 == 1, 0.9999998).when(n % 4 == 2, 1.2).otherwise(0.3).alias("maximum"), F.when(n % 8 == 3, -1.1).otherwise(-0.5).alias("minimum"), (F.col("gain") * 6).alias("gain_db"),
    )


@query("f8_export_gate", f"with {_MORE}, {_GATE_COLUMNS} select recording, {_case(_GATE_RULES, 'ok')} as gate from g", "reports")
def f8(spark, d):
    return out(rules.export_gate(_gate(spark, d)), "recording", "", "gate")


@query("f9_verify_output", f"""with {_MORE}, {_GATE_COLUMNS} select recording, {_case([("recording % 23 = 0", "OUTPUT_STRUCTURE_VERIFICATION_FAILED"), ("recording % 3 = 0 and recording % 5 <> 0 and ceiling is not null and peak_db > ceiling + 1e-9", "VERIFIED_TRUE_PEAK_CEILING_EXCEEDED"), ("not_finite > 0 and not bit_exact", "VERIFIED_INVALID_FLOAT"), ("bit_exact and changed", "SAMPLE_PAYLOAD_IDENTITY_FAILED")], "ok")} as verified from g""", "reports")
def f9(spark, d):
    n = F.col("recording")
    rows = _gate(spark, d).withColumn("structure_equal", n % 23 != 0).withColumn("source_hash", F.sha2(n.cast("string"), 256)).withColumn("output_hash", F.sha2(F.when(F.col("changed"), F.concat(n.cast("string"), F.lit("x"))).otherwise(n.cast("string")), 256))
    return out(rules.verify_output(rows), "recording", "", "verified")


_PUB = [("abs(duration - 1200) > 0.001 and recording % 4 > 0", "duration"), ("recording % 7 = 1", "verified_wav"), ("recording % 5 in (1, 2)", "markers_reviewed"), ("recording % 11 = 1", "full_listen"), ("recording % 13 = 1", "boundaries"), ("recording % 6 = 1", "stereo"), ("recording % 9 = 1", "mono"), ("recording % 17 = 1", "privacy"), ("recording % 2 = 1 or recording % 3 = 1", "metadata"), ("recording % 19 = 1", "archive_saved")]


@query("f10_publication", f"with {_MORE}, p as (select recording, list_aggregate({_list(_PUB)}, 'string_agg', ',') as incomplete from rep) select recording, coalesce(incomplete, '') as incomplete, case when incomplete is null then 'ready' else 'review-required' end as status from p", "reports")
def f10(spark, d):
    n = F.col("recording")
    mods = {"verified": 7, "full_listen": 11, "boundaries": 13, "stereo": 6, "mono": 9, "privacy": 17, "archived": 19}
    rows = _more(spark, d).select(
        "recording", F.col("duration").alias("duration_s"), F.when(n % 4 == 0, "shortened on purpose").otherwise("  ").alias("note"), F.when(n % 5 == 1, 3).otherwise(0).alias("critical_unreviewed"), F.when(n % 5 == 2, 1).otherwise(0).alias("editorial_unreviewed"),
        F.when(n % 2 == 0, "Title").otherwise(" ").alias("title"), F.when(n % 3 != 1, n).alias("episode"), F.lit("Here").alias("place"), *[(n % m != 1).alias(c) for c, m in mods.items()],
    )
    return out(rules.publication_status(rows).withColumn("incomplete", F.concat_ws(",", "incomplete")), "recording", "", "incomplete status")


@query("f11_series_proposal", f"select recording, {r('floor((gain + least(-19.0 - loudness, -2.0 - peak)) * 10 + 0.5) / 10', 'proposal')} from reports", "reports")
def f11(spark, d):
    return out(signals.reports(spark, d).withColumn("proposal", rules.series_proposal(F.col("gain"), F.col("loudness"), F.col("peak"))), "recording", "proposal")


@query("f12_peak_scenarios", f"""with s as (select *, unnest([-1.0, -2.0, -3.0]::double[]) as ceiling from reports), t as (select *, case when recording % 8 > 0 then least(0.0, ceiling - peak) end as reduction from s)
 select recording, {r('ceiling', 'ceiling')}, {r('reduction', 'reduction')}, {r('peak + reduction', 'peak_after')}, {r('loudness + reduction', 'loudness_after')}, {r('case when reduction >= -0.01 then gain else greatest(-60.0, floor((gain + reduction) * 10) / 10) end', 'next_gain')} from t where reduction is not null
 union all select recording, {r('ceiling', 'ceiling')}, null, null, null, null from t where reduction is null""", "reports")
def f12(spark, d):
    rows = signals.reports(spark, d).withColumn("peak", F.when(F.col("recording") % 8 > 0, F.col("peak")))
    return out(rules.peak_scenarios(rows), "recording", "ceiling reduction peak_after loudness_after next_gain")


#: Inputs of the rules below, as SQL of both sides.
_INPUTS = {
    "analyzed": "recording % 37 > 0", "flat_top": "recording % 10 = 3", "true_peak": "case when recording % 8 > 0 then peak end", "sample_peak": "case when recording % 16 > 0 then peak - 1 end", "is_float": "recording % 2 = 0",
    "kind": "case recording % 7 when 0 then 'soundscape-quiet' when 1 then 'soundscape-active' when 2 then 'interview' when 3 then 'music' when 4 then 'other' when 5 then 'objective' else 'unheard-of' end", "purpose": "case recording % 3 when 0 then 'distribution' when 1 then 'preservation' else 'series' end",
    "risk_regions": "recording % 5", "spectral_running": "recording % 13 = 0", "spectral_regions": "case when recording % 4 > 0 then recording % 3 end", "region_running": "recording % 17 = 0", "processed": "recording % 6 > 0", "processed_not_finite": "case when recording % 23 = 0 then 1 else 0 end",
    "processed_peak": "case when recording % 8 > 0 then peak - 1 end", "ceiling": "case when recording % 9 = 0 then -1.0 end", "plr": "case when recording % 4 = 0 then 15.0 end", "trusted": "recording % 11 > 0", "edit_gain": "case when recording % 4 > 0 then gain end",
}
_IN = f"{_MORE}, inp as (select * exclude (loudness), integrated as loudness, {', '.join(f'{v} as {k}' for k, v in _INPUTS.items())} from rep)"
#: The limits that hold for a recording's kind, by hand.
_RATED = """rated as (select *, case when kind = 'objective' or loudness is null then null when loudness < b1 then 'very-low' when loudness < b2 then 'low' when loudness <= b3 then 'reference' when loudness <= b4 then 'high' else 'very-high' end as rating
 from (select *, case kind when 'soundscape-quiet' then -30 when 'soundscape-active' then -27 when 'interview' then -24 when 'music' then -24 else -28 end as b1, case kind when 'soundscape-quiet' then -24 when 'soundscape-active' then -21 when 'interview' then -20 when 'music' then -19 else -22 end as b2,
 case kind when 'soundscape-quiet' then -18 when 'soundscape-active' then -16 when 'interview' then -16 when 'music' then -14 else -16 end as b3, case kind when 'soundscape-quiet' then -14 when 'soundscape-active' then -12 when 'interview' then -13 when 'music' then -10 else -12 end as b4 from inp))"""


def _inputs(spark, d):
    more = _more(spark, d).select("*", *[F.expr(v).alias(k) for k, v in _INPUTS.items()])
    return more.withColumn("loudness", F.col("integrated")).withColumn("invalid", F.col("not_finite")).withColumn("incomplete", F.col("truncated"))


_SOUND = {
    "float": [("is_float and overrange > 0", "info:kept-overrange"), ("is_float", "neutral:none-found"), ("true", "neutral:not-applicable")],
    "digital": [("not_finite > 0 or truncated", "warning:not-assessable"), ("flat_top", "review:plateau"), ("not is_float and sample_peak >= -0.01", "review:full-scale"), ("true", "safe:none-found")],
    "analog": [("true", "unknown:not-decidable")],
    "delivery": [("not_finite > 0 or truncated", "warning:check-integrity"), ("(is_float and overrange > 0) or true_peak > 0 or sample_peak > 0", "warning:lower-first"), ("true_peak > -1", "review:small-margin"), ("true", "safe:margin")],
}


@query("f13_peak_categories", f"with {_IN}, u as (" + " union all ".join(f"select recording, '{k}' as category, case when not analyzed then 'waiting:not-analyzed' else {_case(v)} end as said from inp" for k, v in _SOUND.items()) + ") select recording, category, split_part(said, ':', 1) as state, split_part(said, ':', 2) as finding from u", "reports")
def f13(spark, d):
    return out(rules.peak_categories(_inputs(spark, d)), "recording", "", "category state finding")


_BOARD = {
    "integrity": [("not_finite > 0 or truncated", "stop"), ("flat_top", "review"), ("true", "pass")], "peaks": [("flat_top", "review"), ("true_peak > -2", "review"), ("is_float and overrange > 0", "info"), ("true", "pass")],
    "loudness": [("purpose = 'preservation'", "info"), ("kind = 'objective'", "info"), ("rating is null", "unknown"), ("rating = 'reference'", "pass"), ("true", "info")], "dynamics": [("true", "info")], "stereo": [("risk_regions > 0", "review"), ("true", "pass")],
    "rumble": [("spectral_running", "info"), ("spectral_regions > 0", "review"), ("true", "info")], "review": [("unreviewed > 0", "review"), ("true", "pass")],
    "preflight": [("not_finite > 0 or truncated", "stop"), ("region_running", "running"), ("not processed", "review"), ("processed_not_finite > 0", "stop"), ("processed_peak is null", "review"), ("processed_peak > case when recording % 9 = 0 then -1.0 else -2.0 end", "review"), ("true", "pass")],
}


@query("f14_status_board", f"with {_IN}, {_RATED} " + " union all ".join(f"select recording, '{k}' as module, case when not analyzed then 'waiting' else {_case(v)} end as status from rated" for k, v in _BOARD.items()), "reports")
def f14(spark, d):
    return out(rules.status_board(_inputs(spark, d)), "recording", "", "module status")


_ACTIONS = [("not_finite > 0", "check-invalid"), ("overrange > 0", "check-overrange"), ("kind in ('soundscape-quiet', 'soundscape-active')", "screen-rumble"), ("coalesce(plr, peak - loudness) >= 14", "keep-dynamics"), ("trial >= 0.5", "try-gain"), ("purpose = 'distribution' and rating in ('high', 'very-high')", "keep-level")]


@query("f15_recommendations", f"""with {_IN}, {_RATED}, tr as (select *, case when purpose = 'distribution' and rating in ('very-low', 'low') and -2 - peak >= 0.5 then least(greatest(0, b2 - loudness), -2 - peak, 6.0) end as trial from rated), l as (select *, {_list(_ACTIONS)} as given from tr),
 e as (select *, case when len(given) = 0 then ['listen'] else given end as actions from l), x as (select recording, trial, unnest(actions) as action, generate_subscripts(actions, 1) as nth from e) select recording, nth, action, {r("case when action = 'try-gain' then trial end", "amount")} from x""", "reports")
def f15(spark, d):
    return out(rules.recommendations(_inputs(spark, d)), "recording nth", "amount", "action")


@query("f16_safe_level", f"""with {_IN}, p as (select *, coalesce(true_peak, sample_peak) as known, coalesce(edit_gain, 0.0) as edit from inp), w as (select *, case when not analyzed then 'not-analyzed' when not trusted then 'untrusted-analysis' when known is null then 'missing-peak' when -3.0 - (known + edit) < 0 then 'attenuated' else 'safe' end as reason from p)
 select recording, reason, reason in ('attenuated', 'safe') as ready, {r("case when reason in ('attenuated', 'safe') then known + edit end", "projected")}, {r("case when reason in ('attenuated', 'safe') then least(0.0, -3.0 - (known + edit)) end", "safety")}, {r("case when reason in ('attenuated', 'safe') then edit + least(0.0, -3.0 - (known + edit)) else 0.0 end", "total")} from w""", "reports")
def f16(spark, d):
    return out(rules.safe_level(_inputs(spark, d)), "recording", "projected safety total", "reason ready")


@query("f17_coordinates", "with u as (select recording, 56 + recording % 10 as a, recording % 100000 as b, floor((recording % 100000) / 100 + 0.5)::bigint as m from reports) select recording, cast(a + m // 1000 as varchar) || '.' || lpad(cast(m % 1000 as varchar), 3, '0') as rounded, cast(a as varchar) || '.' || lpad(cast(b as varchar), 5, '0') as exact from u", "reports")
def f17(spark, d):
    n = F.col("recording")
    text = F.concat((56 + n % 10).cast("string"), F.lit(","), F.lpad((n % 100_000).cast("string"), 5, "0"))
    rep = signals.reports(spark, d).withColumn("text", text)
    return out(rep.withColumn("rounded", rules.coordinates(F.col("text"), "rounded")).withColumn("exact", rules.coordinates(F.col("text"), "exact")), "recording", "", "rounded exact")


@query("f18_metadata", "select doc_id as recording, left(text, 500) as title, left(text, 80) as date, left(text, 2000) as tags, cast(null as varchar) as place, left(source, 255) as file from documents")
def f18(spark, d):
    rows = signals.table(spark, d, "documents").select(F.col("doc_id").alias("recording"), F.col("text").alias("title"), F.col("text").alias("date"), F.col("text").alias("tags"), F.col("source").alias("place"), F.col("source").alias("source_file_name"))
    m = documents.select_metadata(rows, ("identity", "notes"), file_name=True).select("recording", "metadata.*")
    return out(m.select("recording", "identity.title", "identity.date", "notes.tags", F.col("location").cast("string").alias("place"), F.col("sourceFileName").alias("file")), "recording", "", "title date tags place file")


# no text of the tables is longer than the edge of 1 MiB: the last edge is empty (a test has longer ones)
@query("f19_edge_fingerprint", """select recording, sha256('{"size":' || size || ',"headLength":' || size || ',"tailStart":' || size || '}' || content) as fingerprint from files""", "files")
def f19(spark, d):
    return out(signals.files(spark, d).withColumn("fingerprint", documents.edge_fingerprint(F.col("content"))), "recording", "", "fingerprint")


@query("f20_content_hash", "select recording, path, size, sha256(content) as hash from files", "files")
def f20(spark, d):
    return out(signals.files(spark, d).withColumn("hash", documents.content_hash(F.col("content"))), "recording size", "", "path hash")


@query("f21_canonical_digest", """select recording, sha256('{"note":null,"path":"' || path || '","recording":' || recording || ',"share":' || case when size % 2 = 0 then size // 2 || '' else size // 2 || '.5' end || ',"where":{"a":[' || size || '],"b":"say \\"' || size || '\\""}}') as digest from files""", "files")
def f21(spark, d):
    f = signals.files(spark, d)
    inner = F.struct(F.concat(F.lit('say "'), F.col("size").cast("string"), F.lit('"')).alias("b"), F.array("size").alias("a"))
    f = f.withColumn("value", F.struct(inner.alias("where"), (F.col("size") / 2).alias("share"), "recording", "path", F.lit(None).cast("string").alias("note")))
    return out(f.withColumn("digest", documents.canonical_digest(f, "value")), "recording", "", "digest")


@query("j10_duplicates", "select sha256(content) as hash, size, count(*) as copies, min(recording) as first from files group by content, size having count(*) > 1", "files")
def j10(spark, d):
    return out(documents.duplicate_recordings(signals.files(spark, d)), "size copies first", "", "hash")


@query("j1_match_sources", """with p as (select recording + 5 as recording, case when recording % 4 = 0 then size + 1 else size end as size, case when recording % 6 <> 1 then sha256(content) end as hash from files), f as (select recording, size, sha256(content) as hash from files)
 select p.recording, case when f.size is null then 'missing' when f.size <> p.size then 'size-differs' when p.hash is null then 'reanalysis-required' when f.hash <> p.hash then 'content-differs' else 'match' end as outcome from (select recording - case when recording % 2 = 0 then 5 else 0 end as recording, size, hash from p) p left join f using (recording)""", "files")
def j1(spark, d):
    f = signals.files(spark, d).withColumn("hash", documents.content_hash(F.col("content")))
    own = F.col("recording") + 5
    projects = f.select((own - F.when(own % 2 == 0, 5).otherwise(0)).alias("recording"), F.when(F.col("recording") % 4 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("recording") % 6 != 1, F.col("hash")).alias("hash"))
    return out(documents.match_sources(f, projects), "recording", "", "outcome")


_BIND = """r as (select recording as bundle, md5(path) as digest, recording, sha256(path) as source_hash from files where recording % 5 > 0), c as (select recording, case when recording % 7 = 0 then 'other' else sha256(path) end as hash_now, case when recording % 3 = 0 then 'old' else md5(path) end as digest_now from files where recording % 11 > 0),
 b as (select g.bundle, r.recording, case when r.recording is null then 'unbound' when hash_now is null then 'source-unverified' when hash_now <> source_hash then 'source-mismatch' when digest_now <> g.digest then 'analysis-unverified' else 'bound-current' end as status from (select recording as bundle, md5(path) as digest from files) g left join r using (bundle, digest) left join c on c.recording = r.recording)"""


def _bound(spark, d):
    f = signals.files(spark, d).withColumn("digest", F.md5("path")).withColumn("hash", F.sha2("path", 256))
    n = F.col("recording")
    receipts = f.where(n % 5 > 0).select(n.alias("bundle"), "digest", "recording", F.col("hash").alias("source_hash"))
    current = f.where(n % 11 > 0).select("recording", F.when(n % 7 == 0, "other").otherwise(F.col("hash")).alias("hash_now"), F.when(n % 3 == 0, "old").otherwise(F.col("digest")).alias("digest_now"))
    return documents.bind_guidance(f.select(n.alias("bundle"), "digest"), receipts, current)


@query("j2_bind_guidance", f"with {_BIND} select bundle, status from b", "files")
def j2(spark, d):
    return out(_bound(spark, d), "bundle", "", "status")


@query("f30_accept_suggestions", f"with {_BIND} select bundle as suggestion, recording, 1.5::double as gain_db from b where status = 'bound-current' and bundle % 4 = 0 and bundle % 8 = 0", "files")
def f30(spark, d):
    bound = _bound(spark, d).select(F.col("bundle").alias("suggestion"), "recording", "status", F.when(F.col("bundle") % 4 == 0, "global-gain").otherwise("note").alias("kind"), F.lit(1.5).alias("value"))
    decisions = bound.select("suggestion", F.when(F.col("suggestion") % 8 == 0, "accepted").otherwise("rejected").alias("decision"))
    return out(documents.accept_suggestions(bound, decisions), "suggestion recording", "gain_db")


@query("j3_evidence", "with s as (select event_id as suggestion, user_id as bundle, unnest(['m' || event_id, 'm' || (event_id + 7)]) as ref from events), k as (select s.*, exists (select 1 from events e where e.user_id = s.bundle and 'm' || e.event_id = s.ref and e.event_type <> 'error') as known from s) select suggestion, ref, known from k")
def j3(spark, d):
    e = signals.table(spark, d, "events")
    ref = lambda plus: F.concat(F.lit("m"), (F.col("event_id") + plus).cast("string"))
    suggestions = e.select(F.col("event_id").alias("suggestion"), F.col("user_id").alias("bundle"), F.array(ref(0), ref(7)).alias("refs"))
    receipts = e.where("event_type <> 'error'").select(F.col("user_id").alias("bundle"), ref(0).alias("ref"))
    known, unknown = documents.evidence(suggestions, receipts)
    return out(known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False))), "suggestion", "", "ref known")


_STAGES = "ms as (select o_custkey as recording, case o_orderstatus when 'F' then 'verified' when 'O' then 'calculated' else 'source' end as stage, o_totalprice as value from orders)"


def _stages(spark, d):
    return signals.table(spark, d, "orders").select(F.col("o_custkey").alias("recording"), F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "calculated").otherwise("source").alias("stage"), F.col("o_totalprice").alias("value"))


@query("j8_select_stage", f"with {_STAGES}, v as (select recording, max(value) filter (stage = 'verified') as a, max(value) filter (stage = 'calculated') as b, max(value) filter (stage = 'source') as c from ms group by recording) select recording, {r('coalesce(a, b, c)', 'value')}, case when a is not null then 'verified' when b is not null then 'calculated' else 'source' end as stage from v")
def j8(spark, d):
    return out(documents.select_stage(_stages(spark, d)), "recording", "value", "stage")


@query("j9_compare_stages", f"with {_STAGES}, s as (select recording, max(value) as top, min(value) as low from ms where stage = 'source' group by 1), p as (select recording, max(value) as top, min(value) as low from ms where stage = 'verified' group by 1) select recording, {r('p.top - s.top', 'top_delta')}, {r('p.low - s.low', 'low_delta')} from s join p using (recording)")
def j9(spark, d):
    m = _stages(spark, d)
    side = lambda stage: m.where(F.col("stage") == stage).groupBy("recording").agg(F.max("value").alias("top"), F.min("value").alias("low"))
    return out(documents.compare_stages(side("source"), side("verified"), ["top", "low"]), "recording", "top_delta low_delta")


_KIND = "case series when 'AUTOMOBILE' then 'music' when 'BUILDING' then 'interview' when 'FURNITURE' then 'soundscape-quiet' when 'HOUSEHOLD' then 'objective' else 'unheard-of' end"
_LIMITS = "('soundscape-quiet', -30.0, -24.0, -18.0, -14.0), ('soundscape-active', -27.0, -21.0, -16.0, -12.0), ('interview', -24.0, -20.0, -16.0, -13.0), ('music', -24.0, -19.0, -14.0, -10.0), ('other', -28.0, -22.0, -16.0, -12.0)"


@query("j11_level_class", f"with limits(kind, a, b, c, e) as (values {_LIMITS}), k as (select *, {_KIND} as kind from reports) select recording, case when loudness < a then 'very-low' when loudness < b then 'low' when loudness <= c then 'reference' when loudness <= e then 'high' when e is not null then 'very-high' end as level_class from k left join limits on limits.kind = replace(k.kind, 'unheard-of', 'other')", "reports")
def j11(spark, d):
    s = F.col("series")
    kind = F.when(s == "AUTOMOBILE", "music").when(s == "BUILDING", "interview").when(s == "FURNITURE", "soundscape-quiet").when(s == "HOUSEHOLD", "objective").otherwise("unheard-of")
    return out(rules.level_class_join(signals.reports(spark, d).withColumn("kind", kind), rules.level_limits(spark)), "recording", "", "level_class")


@query("s3_key_violations", """select event_id, case when event_type in ('error', 'click') then 'k' else '' end as unknown, case when event_type = 'error' then 'k' else '' end as forbidden from events where event_type in ('error', 'click') union all select event_id, '', '' from events where event_type not in ('error', 'click')""".replace("case when event_type = 'error' then 'k' else '' end as forbidden", "'k' as forbidden").replace("'', '' from events where", "'k', 'k' from events where"))
def s3(spark, d):
    e = signals.table(spark, d, "events").withColumnRenamed("props", "json")
    found = documents.key_violations(e, ["a", "b"], ["k", "audio"])
    return out(found.withColumn("unknown", F.concat_ws(",", "unknown")).withColumn("forbidden", F.concat_ws(",", "forbidden")), "event_id", "", "unknown forbidden")


@query("f25_migrate", """select recording, case when recording % 7 = 0 then 3 else 2 end as schema, case when recording % 7 = 0 then 'schema' end as error, case when recording % 4 in (1, 3) then sha256(path) end as identity, case when recording % 4 = 0 and recording % 3 = 0 and recording % 7 > 0 then md5(path) end as preflight, recording % 4 in (0, 2) as identity_required,
 case when recording % 3 = 0 and recording % 7 > 0 then '0.9' end as migrated_from, case when recording % 5 = 0 then -2.0 else -1.0 end::double as ceiling from files""", "files")
def f25(spark, d):
    n = F.col("recording")
    p = signals.files(spark, d).select(
        "recording", F.when(n % 7 == 0, 3).when(n % 3 == 0, 1).otherwise(2).alias("schema"), F.when(n % 4 == 0, "descriptor+first+last").otherwise("full").alias("strategy"), F.when(n % 4 == 0, F.md5("path")).when(n % 4 == 2, "short").otherwise(F.sha2("path", 256)).alias("fingerprint"),
        F.when(n % 5 != 0, -1.0).alias("ceiling"), F.lit("0.9").alias("app_version"),
    )
    return out(documents.migrate_projects(p), "recording schema", "ceiling", "error identity preflight identity_required migrated_from")


@query("f26_reports", f"with {_STAGES}, s as (select recording, max(value) filter (stage = 'source') as a, max(value) filter (stage = 'calculated') as b, max(value) filter (stage = 'verified') as c from ms group by 1) select recording, {r('a', 'source')}, {r('b', 'calculated')}, {r('c', 'verified')} from s where a is not null")
def f26(spark, d):
    m = _stages(spark, d)
    side = lambda stage: m.where(F.col("stage") == stage).groupBy("recording").agg(F.max("value").alias("value"))
    got = documents.build_reports(side("source"), side("calculated"), side("verified"), ["value"])
    return out(got.select("recording", F.col("source.value").alias("source"), F.col("calculated.value").alias("calculated"), F.col("verified.value").alias("verified")), "recording", "source calculated verified")


@query("f27_manifest", r"""select p_partkey as recording, 'EP_E' || case when p_partkey % 9 = 0 then '000' when p_partkey > 999 then p_partkey || '' else lpad(p_partkey || '', 3, '0') end || '_' || left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 80) || '_MASTER.wav' as file_name, case when p_partkey % 9 > 0 then p_partkey end as number, left(p_name, 500) as title,
 case when p_partkey % 3 = 0 then 'exact' else 'hidden' end as disclosure, case when p_partkey % 3 = 0 then 59 end as latitude, case when p_partkey % 2 = 0 then 'ready' else 'review-required' end as status, cast(p_size as bigint) as channels from part""")
def f27(spark, d):
    n, none = F.col("p_partkey"), F.lit(None).cast("string")
    p = signals.table(spark, d, "part").select(
        n.alias("recording"), F.col("p_name").alias("title"), F.when(n % 9 == 0, "none").otherwise(n.cast("string")).alias("episode"), F.when(n % 3 == 0, "exact").alias("disclosure"), F.lit(59.0).alias("latitude"), F.lit(18.0).alias("longitude"), F.lit("").alias("sha256"), F.col("p_size").alias("channels"),
        F.when(n % 2 == 0, "ready").otherwise("review-required").alias("status"), F.array().cast("array<string>").alias("incomplete"), none.alias("report_id"), *[F.lit(None).cast("double").alias(c) for c in ("duration_s", "loudness", "true_peak", "loudness_range", "plr", "sample_rate")], *[none.alias(c) for c in rules.HANDOFF if c != "title"],
    )
    m = rules.episode_manifest(p).withColumn("file_name", rules.master_file_name(F.col("title"), F.col("episode"), F.lit("episode")))
    return out(m.select("recording", "file_name", "manifest.episode.number", "manifest.episode.title", "manifest.location.disclosure", "manifest.location.latitude", "manifest.publication.status", "manifest.master.channels"), "recording number latitude channels", "", "file_name title disclosure status")


@query("f29_projected", f"select recording, {r('loudness + gain', 'projected_loudness')}, {r('peak + gain', 'projected_peak')}, case when peak + gain > 0 then 'peak-over-full-scale' end as warning from reports", "reports")
def f29(spark, d):
    return out(rules.projected_metrics(signals.reports(spark, d)), "recording", "projected_loudness projected_peak", "warning")


@query("f31_editorial_context", f"select recording, 'editorial' as classification, 'series' as purpose, 'series-default/1' as profile, 3::bigint as questions, case when recording % 2 = 0 then 600.0 else 1200.0 end::double as seconds, -19.0::double as target, -20.0::double as lowest, -18.0::double as highest, -2.0::double as ceiling, {r('duration - case when recording % 2 = 0 then 600.0 else 1200.0 end', 'over')} from reports", "reports")
def f31(spark, d):
    rep = signals.reports(spark, d).withColumn("context", rules.editorial_context("series", F.when(F.col("recording") % 2 == 0, 600.0)))
    x, y = F.col("context"), F.col("context.loudnessOrientation")
    rows = rep.select("recording", x["classification"].alias("classification"), x["purpose"].alias("purpose"), F.concat_ws("/", x["seriesProfileId"], x["seriesProfileVersion"]).alias("profile"), F.size(x["questions"]).alias("questions"), x["targetDurationSeconds"].alias("seconds"), y["targetLufs"].alias("target"), y["rangeMinLufs"].alias("lowest"), y["rangeMaxLufs"].alias("highest"), x["truePeakOrientationDbtp"].alias("ceiling"), "duration")
    rows = rows.withColumn("over", F.col("duration") - F.col("seconds"))
    return out(rows, "recording questions", "seconds target lowest highest ceiling over", "classification profile purpose")


@query("w14_latest", "select user_id as recording, event_type as operation, max(event_id) as job from events group by all")
def w14(spark, d):
    e = signals.table(spark, d, "events").select(F.col("user_id").alias("recording"), F.col("event_type").alias("operation"), F.col("event_id").alias("job"))
    return out(stats.latest_results(e, ["recording", "operation"], "job", "job"), "recording job", "", "operation")


@query("w15_measurement_status", "with e as (select o_custkey as recording, max(o_orderdate) as last_edit from orders where o_orderstatus = 'O' group by 1) select o_orderkey as measurement, case when last_edit > o_orderdate then 'stale' else 'current' end as status from orders left join e on recording = o_custkey")
def w15(spark, d):
    o = signals.table(spark, d, "orders")
    m = o.select(F.col("o_orderkey").alias("measurement"), F.col("o_custkey").alias("recording"), F.col("o_orderdate").alias("measured"))
    changes = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("recording"), F.col("o_orderdate").alias("edited"))
    return out(documents.measurement_status(m, changes), "measurement", "", "status")


_LOG = """lg as (select conv_id as log, turn + 1 as sequence, md5(role || text) as m, case when turn % 3 = 0 then turn * 1.0 - 3 end as gain, '2026-01-01T00:00:' || lpad((turn % 60) || '', 2, '0') || 'Z' as stamp from conversations),
 ev as (select *, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-4' || substr(m, 14, 3) || '-8' || substr(m, 18, 3) || '-' || substr(m, 21, 12) as bundle, ['export', 'import', 'accept', 'reject'][sequence % 4 + 1] as action, sha256(m) as analysis from lg),
 tx as (select *, '{"action":"' || action || '","after":' || case when gain is null then 'null' else '{"globalGainDb":' || gain::bigint || ',"trimStartFrame":' || sequence || '}' end || ',"analysisDigest":"' || analysis || '","before":null,"bundleId":"' || bundle || '","previousDigest":' as head, ',"sequence":' || sequence || ',"suggestionId":' || case when sequence % 2 = 0 then '"s' || sequence || '"' else 'null' end || ',"timestamp":"' || stamp || '"}' as tail from ev)"""


def _log(spark, d):
    c = signals.table(spark, d, "conversations").select(F.col("conv_id").alias("log"), (F.col("turn") + 1).alias("sequence"), F.md5(F.concat("role", "text")).alias("m"), "turn")
    n, part = F.col("sequence"), lambda a, k: F.substring("m", a, k)
    after = F.when(F.col("turn") % 3 == 0, F.struct((F.col("turn") - 3).cast("double").alias("globalGainDb"), n.cast("double").alias("trimStartFrame"), *[F.lit(None).cast("double").alias(k) for k in ("trimEndFrame", "fadeInFrames", "fadeOutFrames")]))
    return c.select(
        "log", "sequence", F.format_string("2026-01-01T00:00:%02dZ", F.col("turn") % 60).alias("timestamp"), F.element_at(F.array(*map(F.lit, documents.ACTIONS)), (n % 4 + 1).cast("int")).alias("action"),
        F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12)).alias("bundleId"), F.sha2("m", 256).alias("analysisDigest"), F.when(n % 2 == 0, F.concat(F.lit("s"), n.cast("string"))).alias("suggestionId"), after.alias("after"),
    )


@query("w13_build_audit", f"""with recursive {_LOG}, ch as (select log, sequence, null::varchar as previous, sha256(head || 'null' || tail) as digest from tx where sequence = 1
 union all select tx.log, tx.sequence, ch.digest, sha256(head || '"' || ch.digest || '"' || tail) from ch join tx on tx.log = ch.log and tx.sequence = ch.sequence + 1) select log, sequence, previous, digest from ch""")
def w13(spark, d):
    got = documents.build_audit(_log(spark, d))
    return out(got.withColumnsRenamed({"previousDigest": "previous", "entryDigest": "digest"}), "log sequence", "", "previous digest")


@query("w12_validate_audit", f"""with {_LOG}, a as (select *, case when sequence % 4 = 0 then 'x' else lag(sha256(analysis)) over (partition by log order by sequence) end as previous, row_number() over (partition by log order by sequence) as nth from tx)
 select log, sequence, concat_ws(',', case when sequence <> nth then 'sequence' end, case when sequence % 5 = 0 then 'action' end, case when sequence % 7 = 0 then 'ids' end, case when previous = 'x' then 'link' end, 'digest') as errors from a""")
def w12(spark, d):
    from pyspark.sql import Window

    order, n = Window.partitionBy("log").orderBy("sequence"), F.col("sequence")
    a = _log(spark, d).withColumn("entryDigest", F.sha2("analysisDigest", 256))
    a = a.withColumn("previousDigest", F.when(n % 4 == 0, "x").otherwise(F.lag("entryDigest").over(order)))
    a = a.withColumn("action", F.when(n % 5 == 0, "open").otherwise(F.col("action"))).withColumn("bundleId", F.when(n % 7 == 0, "b").otherwise(F.col("bundleId")))
    return out(documents.validate_audit(a).withColumn("errors", F.concat_ws(",", "errors")), "log sequence", "", "errors")


def _bundles(spark, d):
    """A bundle per user of the events: a step of two seconds and a marker per event."""
    m, n = signals.markers(spark, d), F.col("recording")
    frames = signals.frames(spark, d)
    length = (F.floor(F.max("end_seconds")) + 1).cast("long") * 48_000
    sound = m.withColumn("objective", F.col("type") == "view").withColumn("heuristic", F.col("type") == "click").withColumn("kind", markers.marker_kind(F.col("text"))).withColumn("class", markers.marker_class(F.col("objective"), F.col("heuristic"), F.lit("artistic")))
    sound = markers.sanitize_markers(sound, F.lit(1e9)).withColumn("severity", markers.marker_severity(F.col("severity")))
    ranked = markers.rank_markers(sound.withColumns({"seconds": F.col("start_s"), "end_seconds": F.col("end_s")}))
    steps = frames.select("recording", F.col("frame").alias("step"), F.pow("left", F.lit(2)).alias("momentary"), F.pow("right", F.lit(2)).alias("short_term"), F.pow("left", F.lit(2)).alias("raw_energy"), F.abs("left").alias("peak"), (2 * F.col("right")).alias("correlation"))
    cues = markers.cue_sheet(m.withColumn("origin", F.lit("user")).withColumn("type", F.when(F.col("type") == "signup", "chapter").otherwise("technical")), m.groupBy("recording").agg(F.lit(4.0).alias("start_s"), F.max("end_seconds").alias("end_s")))
    recordings = documents.select_metadata(m.groupBy("recording").agg(length.alias("end_frame")).withColumns({"title": F.concat(F.lit("No. "), n.cast("string")), "latitude": n.cast("double"), "longitude": F.lit(18.123)}), ("identity", "location"), exact=True)
    mono = F.struct(F.lit(-1.5).alias("energyDeltaDb"), F.lit(None).cast("double").alias("samplePeakDbfs"), F.lit(2.0).alias("negativeCorrelationPercent"), F.array(F.struct(F.lit(0.0).alias("startSeconds"), F.lit(1.0).alias("endSeconds"))).alias("riskRegions"))
    recordings = recordings.select(
        "recording", F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0")).alias("bundle_id"), F.lit("2026-01-01T00:00:00Z").alias("created_at"), F.when(n % 2 == 0, "minimal").otherwise("temporal-diagnostic").alias("profile"), F.lit("exact").alias("privacy"), F.lit("source").alias("stage"),
        "end_frame", "metadata", F.lit("PCM").alias("encoding"), F.lit(2).alias("channels"), F.lit(48_000).alias("sample_rate"), F.lit(24).alias("bits"), F.when(n % 3 > 0, -23.5).alias("loudness"), F.lit(float("-inf")).alias("peak_db"), F.when(n % 4 > 0, mono).alias("mono"),
        F.when(n % 5 > 0, rules.editorial_context()).alias("editorial"), F.struct(F.lit("1").alias("engineVersion"), F.lit("bs1770").alias("loudnessModel")).alias("provenance"), F.lit("validated").alias("loudness_status"),
    )
    channels = stats.channel_stats(stats.by_channel(frames)).withColumns({"peak_db": 20 * F.log10("peak"), "rms_db": 20 * F.log10("rms")})
    return documents.build_bundles(recordings, ranked, loudness.temporal_segments(steps, 2.0), channels, cues)


_BUNDLE_SQL = """t as (select *, case when severity = 'critical' and type = 'view' then seconds else floor(seconds + 0.5) end as a, case when severity = 'critical' and type = 'view' then end_seconds else floor(end_seconds + 0.5) end as b from markers),
 rk as (select *, row_number() over (partition by recording order by case severity when 'critical' then 0 when 'review' then 1 else 2 end, greatest(a, b) - a desc, a, id) as nth from t),
 bd as (select recording, count(*) as n, (floor(max(end_seconds)) + 1)::bigint * 48000 as frames, string_agg(id, ',' order by nth) filter (nth <= 500) as ids from rk group by recording)"""


@query("f22_bundles", f"""with {_BUNDLE_SQL}, q as (select recording, count(*) as cues from markers where type = 'signup' and seconds >= 4 group by recording)
 select recording, least(n, 500) as n_markers, split_part(ids, ',', 1) as first_marker, case when recording % 2 > 0 then ceil(n * 2 / 5)::bigint end as n_segments, least(coalesce(cues, 0), 200) as n_cues, frames, case when recording <= 90 then recording end as latitude, '' as errors from bd left join q using (recording)""", "markers")
def f22(spark, d):
    built = documents.validate_bundles(_bundles(spark, d))
    a = F.col("bundle.analysis")
    rows = built.select(
        "recording", F.size(a["markers"]).alias("n_markers"), a["markers"][0]["id"].alias("first_marker"), F.size(a["temporalDiagnostic"]).alias("n_segments"), F.coalesce(F.size(a["editorialCueSheet"]), F.lit(0)).alias("n_cues"), a["region"]["endFrame"].alias("frames"),
        a["metadata"]["location"]["coordinates"]["latitude"].cast("long").alias("latitude"), F.concat_ws(",", "errors").alias("errors"),
    )
    return out(rows, "recording n_markers n_segments n_cues frames latitude", "", "first_marker errors")


@query("f28_receipts", f"""with {_BUNDLE_SQL} select recording, case when recording % 3 > 0 then sha256(recording || '') end as source_sha256, '1' as engine, 'bs1770' as method, sha256('{{"endFrame":' || frames || ',"fadeInFrames":0,"fadeOutFrames":0,"globalGainDb":0,"range":"[startFrame,endFrame)","selectedFrames":' || frames || ',"startFrame":0}}') as edit_digest, 'loudness,true-peak,markers' as evidence_ids, ids as marker_ids, case when recording % 3 = 0 then 'source-identity' end as error from bd""", "markers")
def f28(spark, d):
    bundles, n = _bundles(spark, d), F.col("recording")
    got = documents.receipts(bundles, bundles.where(n % 3 > 0).select("recording", F.sha2(n.cast("string"), 256).alias("hash")))
    joined = got.withColumn("evidence_ids", F.concat_ws(",", "evidence_ids")).withColumn("marker_ids", F.concat_ws(",", "marker_ids"))
    return out(joined, "recording", "", "source_sha256 engine method edit_digest evidence_ids marker_ids error")


#: A sound bundle and guidance, and one change for each kind of fault: text, what it becomes, the rules that then fail.
_BUNDLE = json.dumps({
    "schema": documents.SCHEMA, "bundleId": "0a1b2c3d-0000-4000-8000-000000000001", "analysisDigest": "a" * 64, "profile": "minimal", "privacy": "redacted", "createdAt": "2026-01-01T00:00:00Z", "analysis": {
        "signalStage": "source", "region": {"range": "[a,b)", "startFrame": 0, "endFrame": 480000, "selectedFrames": 480000, "fadeInFrames": 0, "fadeOutFrames": 100, "globalGainDb": -1.5},
        "format": {"container": "WAVE", "encoding": "PCM", "channels": 2, "sampleRate": 48000, "bitsPerSample": 24, "validBitsPerSample": 24, "durationSeconds": 10.0, "fileSizeBytes": 2880044, "fileName": None},
        "metadata": {"sourceFileName": None, "identity": None, "location": None, "notes": None, "creator": None},
        "measurements": {**dict.fromkeys(documents.BUNDLE_KEYS["$.analysis.measurements"].split()[:11], -20.5), "monoCompatibility": None, "overrangeSamples": 0, "nonFiniteSamples": 0, "channels": [{"channel": k, **dict.fromkeys(documents.CHANNEL_MEASURES, -20.5), **dict.fromkeys(documents.CHANNEL_COUNTS, 0)} for k in (1, 2)]},
        "markers": [{"id": "m1", "type": "silence", "classification": "objective", "severity": "review", "startSeconds": 1.0, "endSeconds": 2.0, "channel": None, "summary": "s", "methodId": "x", "reviewStatus": "unreviewed", "timePrecisionSeconds": 1}],
        "editorialContext": None, "editorialCueSheet": None, "temporalDiagnostic": None, "provenance": dict.fromkeys(documents.BUNDLE_KEYS["$.analysis.provenance"].split(), "1"), "evidence": [{"id": "loudness", "classification": "objective", "methodId": "m", "status": "s"}, {"id": "markers", "classification": "mixed", "methodId": "m", "status": "s"}],
    },
})
_segment = lambda start, silence: {"startSeconds": start, "endSeconds": start + 5, "momentaryLufs": dict.fromkeys(("p10", "median", "max"), -20), "shortTermLufs": dict.fromkeys(("median", "max")), "programSamplePeakDbfs": -1.5, "programTruePeakDbtp": None, "silencePercent": silence, "stereoCorrelation": None}
_SERIES, _GOOD_SERIES = (json.dumps([_segment(0, 0), _segment(5, last)]) for last in (120, 20))
_CONTEXT = json.dumps({**dict.fromkeys(("seriesProfileId", "seriesProfileVersion", "purpose", "continuityPolicy"), "x"), "classification": "editorial", **dict.fromkeys(("targetDurationSeconds", "durationToleranceSeconds", "truePeakOrientationDbtp")), "loudnessOrientation": {"targetLufs": -19, "rangeMinLufs": None, "rangeMaxLufs": -18, "rationale": "r"}, "questions": ["q"]})
_CUE = json.dumps([{"id": "cue-1", "type": "note", "startSeconds": 1, "endSeconds": 2, "text": "t", "reviewStatus": "u", "classification": "editorial"}])
_MONO = json.dumps({"energyDeltaDb": -1, "samplePeakDbfs": None, "negativeCorrelationPercent": 2, "riskRegions": [{"startSeconds": 0, "endSeconds": 1}]})
_POINT = json.dumps({"place": "p", "coordinates": {"latitude": 59.5, "longitude": 18, "precision": "exact"}})
_context, _cue, _mono, _point = (lambda new, name=name: (f'"{name}": null', f'"{name}": {new}') for name in ("editorialContext", "editorialCueSheet", "monoCompatibility", "location"))
_FAULTS = [
    ("{", "{", ""), ('"minimal"', '"huge"', "profile"), ('"startFrame"', '"pcmFrames": 1, "startFrame"', "keys:$.analysis.region"), ("-1.5", "30", "gain"), ('"endSeconds": 2.0', '"endSeconds": 10.5', "marker"), ('"validBitsPerSample": 24', '"validBitsPerSample": 40', "bits"), ('"id": "markers"', '"id": "loudness"', "evidence-repeated"),
    ('{"schema"', '["schema"', "json"), ("48000,", "8000,", "channels-or-rate"), ('"type": "silence"', '"PCM" : 1, "type": "silence"', "keys:$.analysis.markers[],forbidden"), ('"temporalDiagnostic": null', '"temporalDiagnostic": []', "minimal-with-series"), ('"selectedFrames": 480000', '"selectedFrames": 479999', "frames"), ('"overrangeSamples": 0', '"overrangeSamples": 0.5', "counts"),
    ('"analysisDigest": "a', '"analysisDigest": "A', "analysis-digest"), ('"durationSeconds": 10.0', '"durationSeconds": null', "duration-or-size,marker"), ('"fileName": null', '"fileName": 7', "file-name"), ('"channels": 2', '"channels": 1', "channel-measurements"), ('"channel": 2', '"channel": 3', "channel"), ('"channel": 1', '"gain": 1, "channel": 1', "keys:$.analysis.measurements.channels[]"), ('"nonFiniteSamples": 0}', '"nonFiniteSamples": -1}', "channel"), ('"dcOffset": -20.5', '"dcOffset": "0"', "channel-figures"), ("2026-01-01T", "yesterday", "created-at"),
    (f'"temporalDiagnostic": null|"minimal"', f'"temporalDiagnostic": {_SERIES}|"temporal-diagnostic"', "segment"), ('"integratedLufs": -20.5', '"integratedLufs": "-20.5"', "measurements"), ('"fadeOutFrames": 100', '"fadeOutFrames": 480001', "fades"), ('"classification": "objective", "severity"', '"classification": "wild", "severity"', "marker"),
    (f'"temporalDiagnostic": null|"minimal"', f'"temporalDiagnostic": {_GOOD_SERIES}|"temporal-diagnostic"', ""), (f'"temporalDiagnostic": null|"minimal"', f'"temporalDiagnostic": {_GOOD_SERIES.replace("p10", "p11")}|"temporal-diagnostic"', "keys:$.analysis.temporalDiagnostic[][]"), ('"summary": "s"', r'"\u0073amples": 1, "summary": "\"pcm\":"', "keys:$.analysis.markers[],forbidden"), ('"summary": "s"', r'"summary": "\"pcm\": \\\"fft\":"', ""),
    (*_context(_CONTEXT), ""), (*_context(_CONTEXT.replace('"editorial"', '"other"')), "editorial"), (*_context(_CONTEXT.replace("rangeMinLufs", "lowest")), "editorial"), (*_context(_CONTEXT.replace('["q"]', "[1]")), "editorial"), (*_context("7"), "keys:$.analysis.editorialContext,editorial"),
    (*_cue(_CUE), ""), (*_cue(_CUE.replace('"endSeconds": 2', '"endSeconds": 0.5')), "cue"), (*_cue(_CUE.replace('"note"', "null")), "cue"), (*_cue("{}"), "cue-list"), (*_mono(_MONO), ""), (*_mono(_MONO.replace('"endSeconds": 1', '"endSeconds": 11')), "risk"), (*_mono(_MONO.replace("-1", '"x"')), "mono"),
    (*_point(_POINT), ""), (*_point(_POINT.replace("59.5", "91")), "coordinates"), (*_point(_POINT.replace('"exact"', '"near"')), "coordinates"), (*_point(_POINT.replace('"p"', "5")), "metadata"), ('"identity": null', '"identity": {"owner": "x"}', "keys:$.analysis.metadata.identity"),
]
_GUIDANCE = json.dumps({
    "schema": documents.GUIDANCE_SCHEMA, "bundleId": "0a1b2c3d-0000-4000-8000-000000000001", "analysisDigest": "a" * 64, "guidanceDigest": "b" * 64, "createdAt": "2026-01-01T00:00:00Z",
    "producer": {"system": "s", "component": "c", "version": "1", "method": "m", "vepPerspectives": ["p"], "model": None, "promptId": None, "runId": None, "trust": "unsigned"}, "summary": "text", "assumptions": [], "uncertainties": ["u"],
    "suggestions": [{"id": "1", "classification": "heuristic", "kind": "global-gain", "summary": "s", "rationale": "r", "evidenceRefs": ["loudness"], "globalGainDb": 2.5, "predictedIntegratedLufs": None, "predictedTruePeakDbtp": None, "confidence": 0.5}],
})
_ADVICE = [("{", "{", ""), ('"unsigned"', '"signed"', "trust"), ("2.5", "24.5", "gain"), ('"global-gain"', '"note"', "gain"), ('["loudness"]', '["loudness", "m9"]', "evidence"), ('"confidence": 0.5', '"confidence": 1.5', "confidence"), ('["p"]', "[]", "perspectives"), ('"heuristic"', '"mixed"', "classification"), ('"global-gain"', '"louder"', "kind,gain"), ('"model": null', '"model": 3', "producer-optional"), ('"assumptions": []', '"assumptions": "none"', "text-lists"), ('"rationale": "r", ', "", "suggestion-text"), ('"summary": "text"', '"summary": "text", "extra": 1', "keys:$")]


def _faulty(rows, base: str, faults: list, n):
    """One of the faults per row, in turn."""
    text = F
    for k, (old, new, _) in enumerate(faults):
        changed = base
        for a, b in zip(old.split("|"), new.split("|"), strict=True):
            changed = changed.replace(a, b, 1)
        text = text.when(n % len(faults) == k, changed)
    return rows.withColumn("json", text.otherwise(None))


_FAULT_SQL = lambda faults, n: f"case {n} % {len(faults)} " + " ".join(f"when {k} then '{rule}'" for k, (_, _, rule) in enumerate(faults)) + " end as errors"


@query("f23_validate_bundles", f"select recording, {_FAULT_SQL(_FAULTS, 'recording')} from files", "files")
def f23(spark, d):
    rows = _faulty(signals.files(spark, d).select("recording"), _BUNDLE, _FAULTS, F.col("recording"))
    return out(documents.validate_bundles(rows, digest=False).withColumn("errors", F.concat_ws(",", "errors")), "recording", "", "errors")


@query("f23_validate_guidance", f"select event_id, {_FAULT_SQL(_ADVICE, 'event_id')} from events")
def f23b(spark, d):
    rows = _faulty(signals.table(spark, d, "events").select("event_id"), _GUIDANCE, _ADVICE, F.col("event_id"))
    return out(documents.validate_guidance(rows).withColumn("errors", F.concat_ws(",", "errors")), "event_id", "", "errors")


@query("f23_validate_receipts", "select recording, case recording % 8 when 1 then 'bundle-id' when 2 then 'digest' when 3 then 'source_sha256' when 4 then 'edit_digest' when 5 then 'engine' when 6 then 'marker_ids' when 7 then 'created-at' else '' end as errors from files", "files")
def f23c(spark, d):
    n, good = F.col("recording") % 8, F.sha2("path", 256)
    rows = signals.files(spark, d).select(
        "recording", F.when(n == 1, "7").otherwise("0a1b2c3d-0000-4000-8000-000000000001").alias("bundle_id"), F.when(n == 2, F.upper(good)).otherwise(good).alias("digest"), F.when(n != 3, good).alias("source_sha256"), F.when(n == 4, "").otherwise(good).alias("edit_digest"),
        F.when(n != 5, "1").alias("engine"), F.lit("m").alias("method"), F.array(F.lit("loudness")).alias("evidence_ids"), F.array(F.lit("m1"), F.when(n != 6, "m2")).alias("marker_ids"), F.when(n == 7, "soon").otherwise("2026-01-01T00:00:00Z").alias("created_at"),
    )
    return out(documents.validate_receipts(rows).withColumn("errors", F.concat_ws(",", "errors")), "recording", "", "errors")


@query("k8_rumble", "with m as (select recording, case when recording % 9 > 0 then recording % 70 end as low, recording % 15 as subsonic, recording % 60 as upper, case when recording % 4 > 0 then recording % 100 / 50.0 - 1 end as correlation from reports), s as (select *, case when low >= 55 then 3 when low >= 35 then 2 when low >= 20 then 1 else 0 end + case when subsonic >= 12 then 2 when subsonic >= 4 then 1 else 0 end + case when upper >= 45 then -1 else 0 end + case when correlation < 0.35 then 1 else 0 end as score from m) select recording, case when low is not null then score end as score, case when low is null then 'unknown' when score >= 4 then 'elevated' when score >= 2 then 'moderate' else 'low' end as class from s", "reports")
def k8(spark, d):
    n = F.col("recording")
    m = signals.reports(spark, d).withColumn("score", rules.rumble_score(F.when(n % 9 > 0, n % 70), n % 15, n % 60, F.when(n % 4 > 0, n % 100 / 50.0 - 1)))
    return out(m.withColumn("class", rules.rumble_class(F.col("score"))), "recording score", "", "class")


