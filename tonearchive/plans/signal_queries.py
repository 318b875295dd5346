"""Edits, statistics, loudness and regions over the signals derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits, loudness, regions, stats
from ..sources import signals
from .registry import out, query, r

FINITE = lambda c: f"({c} is not null and not isnan({c}) and not isinf({c}))"
LUFS = lambda e: f"(case when {e} > 0 then -0.691 + 10 * log10({e}) end)"
DB = lambda a: f"(case when {a} > 0 then 20 * log10({a}) end)"
#: Decisions derived for every recording: 5 frames off the start, 3 off the end, -3 dB, fades, two gain regions.
EDITS = """with lengths as (select recording, max(frame) + 1 as n from frames group by recording), cut as (select f.*, n, frame - 5 as i, n - 8 as len from frames f join lengths using (recording) where frame >= 5 and frame < n - 3)"""
FADE = "least(case when i < 4 then i / 3.0 else 1.0 end, case when len - 1 - i < 6 then (len - 1 - i) / 5.0 else 1.0 end)"
_HELD = "pow(10.0, {} / 20)"


def _curve(start: int, attack: int, release: int, end: int, db: float, f: str = "frame") -> str:
    held = _HELD.format(db)
    return f"greatest(0.0, least(1.0, case when {f} < {start} or {f} >= {end} then 1.0 when {f} < {attack} then 1 + ({held} - 1) * ({f} - {start}) / {float(attack - start)} when {f} >= {release} then {held} + (1 - {held}) * ({f} - {release}) / {float(end - 1 - release)} else {held} end))"


LOCAL = f"least({_curve(10, 20, 30, 41, -6.02)}, {_curve(25, 28, 40, 50, -12.0)})"


def _edits(frames):
    region = lambda a, b, c, d, g: F.struct(F.lit(a).alias("start_frame"), F.lit(b).alias("attack_end"), F.lit(c).alias("release_start"), F.lit(d).alias("end_frame"), F.lit(g).alias("gain_db"))
    return frames.groupBy("recording").agg((F.max("frame") + 1 - 3).alias("end_frame")).select(
        "recording", F.lit(5).alias("start_frame"), "end_frame", F.lit(-3.0).alias("gain_db"), F.lit(4).alias("fade_in"), F.lit(6).alias("fade_out"),
        F.array(region(10, 20, 30, 41, -6.02), region(25, 28, 40, 50, -12.0)).alias("regions"),
    )


@query("b1_trim", EDITS + f' select recording, i as frame, {r(chr(34) + "left" + chr(34), "l")}, {r(chr(34) + "right" + chr(34), "r")} from cut', "frames")
def b1(spark, d):
    f = signals.frames(spark, d)
    cut = edits.trim(f, _edits(f).select("recording", "start_frame", "end_frame"))
    return out(cut.withColumnsRenamed({"left": "l", "right": "r"}), "recording frame", "l r")


@query("b2_gain", f'select recording, frame, {r(chr(34) + "left" + chr(34) + " * pow(10.0, -3.0 / 20)", "gained")} from frames', "frames")
def b2(spark, d):
    return out(signals.frames(spark, d).withColumn("gained", edits.apply_gain(F.col("left"), F.lit(-3.0))), "recording frame", "gained")


@query("b3_fades", EDITS + f" select recording, i as frame, {r(FADE, 'factor')} from cut", "frames")
def b3(spark, d):
    f = signals.frames(spark, d)
    cut = edits.trim(f, _edits(f))
    factor = edits.fade_factor(F.col("frame"), F.col("end_frame") - F.col("start_frame"), F.col("fade_in"), F.col("fade_out"))
    return out(cut.withColumn("factor", factor), "recording frame", "factor")


@query("b4_local_gain", f"select recording, frame, {r(LOCAL, 'factor')} from frames", "frames")
def b4(spark, d):
    f = signals.frames(spark, d)
    joined = f.join(_edits(f).select("recording", "regions"), "recording")
    return out(joined.withColumn("factor", edits.local_gain_factor(F.col("frame"), F.col("regions"))), "recording frame", "factor")


_CHAIN = f"pow(10.0, -3.0 / 20) * ({FADE}) * {LOCAL}"


@query("b5_edit_chain", EDITS.replace("frames f", "dirty f").replace("from frames group", "from dirty group") + f' select recording, i as frame, {r(chr(34) + "left" + chr(34) + " * " + _CHAIN, "l")}, {r(chr(34) + "right" + chr(34) + " * " + _CHAIN, "r")} from cut', "dirty")
def b5(spark, d):
    f = signals.dirty(spark, d)
    return out(edits.apply_edits(f, _edits(f)).withColumnsRenamed({"left": "l", "right": "r"}), "recording frame", "l r")


@query("b6_render_chain", EDITS.replace("frames f", "dirty f").replace("from frames group", "from dirty group") + f' select recording, sum(case when {FINITE(chr(34) + "left" + chr(34))} then 0 else 1 end)::bigint as replaced, {r("max(greatest(abs(case when " + FINITE(chr(34) + "left" + chr(34)) + " then " + chr(34) + "left" + chr(34) + " else 0.0 end * " + _CHAIN + "), abs(" + chr(34) + "right" + chr(34) + " * " + _CHAIN + ")))", "peak")} from cut group by recording', "dirty")
def b6(spark, d):
    f = signals.dirty(spark, d)
    done = edits.render_edits(f, _edits(f))
    return out(done.groupBy("recording").agg(F.sum("replaced").alias("replaced"), F.max(F.greatest(F.abs("left"), F.abs("right"))).alias("peak")), "recording replaced", "peak")


@query("b7_filter_signal", f'select recording, count(case when {FINITE(chr(34) + "left" + chr(34))} then 1 end) as n, {r("avg(case when " + FINITE(chr(34) + "left" + chr(34)) + " then " + chr(34) + "left" + chr(34) + " end)", "raw_mean")}, {r("avg(case when " + FINITE(chr(34) + "left" + chr(34)) + " then " + chr(34) + "left" + chr(34) + " else 0.0 end)", "filter_mean")} from dirty group by recording', "dirty")
def b7(spark, d):
    raw, filled = edits.signal_for_filters("left")
    return out(signals.dirty(spark, d).groupBy("recording").agg(F.count(raw).alias("n"), F.avg(raw).alias("raw_mean"), F.avg(filled).alias("filter_mean")), "recording n", "raw_mean filter_mean")


@query("b8_mid_side", f'select recording, frame, {r("(" + chr(34) + "left" + chr(34) + " + " + chr(34) + "right" + chr(34) + ") / 2", "mid")}, {r("(" + chr(34) + "left" + chr(34) + " - " + chr(34) + "right" + chr(34) + ") / 2", "side")} from dirty where {FINITE(chr(34) + "left" + chr(34))}', "dirty")
def b8(spark, d):
    return out(edits.mid_side(signals.dirty(spark, d)), "recording frame", "mid side")


_REGION_SQL = "regions as (select recording, id, seconds, end_seconds, severity, floor(seconds * 100)::bigint as start_frame, floor(seconds * 100)::bigint + 20 as attack_end, floor(end_seconds * 100)::bigint + 20 as release_start, floor(end_seconds * 100)::bigint + 40 as end_frame from markers)"


def _regions(spark, d):
    m = signals.markers(spark, d)
    at, end = F.floor(F.col("seconds") * 100), F.floor(F.col("end_seconds") * 100)
    return m.select("recording", "id", "severity", at.alias("start_frame"), (at + 20).alias("attack_end"), (end + 20).alias("release_start"), (end + 40).alias("end_frame"))


@query("b9_gain_breakpoints", f"with {_REGION_SQL} select distinct recording, unnest([start_frame, attack_end, release_start, end_frame - 1, end_frame]) as frame from regions", "markers")
def b9(spark, d):
    return out(edits.gain_breakpoints(_regions(spark, d)), "recording frame")


@query("b10_peak_regions", f"""with e as (select recording, id, floor(seconds * 100 + 0.5)::bigint as a, greatest(floor(seconds * 100 + 0.5) + 1, floor(end_seconds * 100 + 0.5))::bigint as b, (end_seconds - seconds) - 4 as peak_db from markers where type = 'view'),
 h as (select *, greatest(0, a - 5) as hold, greatest(a + 1, least(100000, b + 5)) as done from e)
 select recording, id, greatest(0, hold - 20) as start_frame, hold as attack_end, greatest(hold, done - 1) as release_start, least(100000, done + 20) as end_frame, {r("greatest(-60.0, floor(least(-0.1, -2.0 - peak_db - 0.3) * 10) / 10)", "gain_db")}, -2.0::double as target_dbtp from h""", "markers")
def b10(spark, d):
    events = signals.markers(spark, d).where("type = 'view'").select("recording", "id", F.col("seconds").alias("start_s"), F.col("end_seconds").alias("end_s"), ((F.col("end_seconds") - F.col("seconds")) - 4).alias("peak_db"), F.lit(100).alias("sample_rate"), F.lit(100_000).alias("frames"))
    return out(edits.peak_regions(events), "recording start_frame attack_end release_start end_frame", "gain_db target_dbtp", "id")


@query("b11_place_window", f"select recording, {r('greatest(0.0, (duration - least(duration, 1200.0)) / 2)', 'start_s')}, {r('greatest(0.0, (duration - least(duration, 1200.0)) / 2) + least(duration, 1200.0)', 'end_s')} from reports", "reports")
def b11(spark, d):
    return out(edits.place_window(signals.reports(spark, d), "centre"), "recording", "start_s end_s")


_CH = 'channels as (select recording, frame, 0 as channel, "left" as value from dirty union all select recording, frame, 1, "right" from dirty)'
_OK = FINITE("value")


@query("c1_channel_stats", f"""with {_CH} select recording, channel::bigint as channel, count(*) filter ({_OK}) as n, {r(f"avg(value) filter ({_OK})", "dc_offset")}, {r(f"sqrt(avg(value * value) filter ({_OK}))", "rms")}, {r(f"max(abs(value)) filter ({_OK})", "peak")},
 {r(f"max(value) filter ({_OK})", "highest")}, {r(f"min(value) filter ({_OK})", "lowest")}, count(*) filter ({_OK} and value = 0) as zeros, count(*) filter ({_OK} and abs(value) > 1) as overrange, count(*) filter (not {_OK}) as not_finite from channels group by all""", "dirty")
def c1(spark, d):
    return out(stats.channel_stats(stats.by_channel(signals.dirty(spark, d))), "recording channel n zeros overrange not_finite", "dc_offset rms peak highest lowest")


@query("c2_peak_frame", f"with {_CH}, o as (select *, row_number() over (partition by recording, channel order by abs(value) desc, frame) as nth from channels where {_OK}) select recording, channel::bigint as channel, frame as peak_frame from o where nth = 1", "dirty")
def c2(spark, d):
    return out(stats.channel_stats(stats.by_channel(signals.dirty(spark, d))), "recording channel peak_frame")


@query("c3_decibels", f"select recording, {r(DB('peak_a'), 'peak_db')}, {r(LUFS('peak_a * peak_a'), 'level')}, {r(DB('peak_a') + ' - loudness', 'plr')} from (select *, pow(10.0, peak / 20) as peak_a from reports)", "reports")
def c3(spark, d):
    from ..functions.audio import db, gain, lufs

    a = signals.reports(spark, d).withColumn("a", gain("peak"))
    return out(a.select("recording", db("a").alias("peak_db"), lufs(F.col("a") * F.col("a")).alias("level"), (db("a") - F.col("loudness")).alias("plr")), "recording", "peak_db level plr")


@query("c4_recording_summary", f"""with {_CH}, c as (select recording, channel, max(abs(value)) filter ({_OK}) as peak, sqrt(avg(value * value) filter ({_OK})) as rms, count(*) filter ({_OK} and abs(value) > 1) as over, count(*) filter (not {_OK}) as bad from channels group by all),
 s as (select recording, max(peak) as peak, arg_max(channel, (peak, -channel)) as peak_channel, sqrt(sum(rms * rms) / count(*)) as rms, sum(over)::bigint as overrange, sum(bad)::bigint as not_finite from c group by recording)
 select recording, peak_channel::bigint as peak_channel, overrange, not_finite, {r("peak", "peak")}, {r("rms", "rms")}, {r(DB("peak") + " - " + DB("rms"), "crest_db")} from s""", "dirty")
def c4(spark, d):
    return out(stats.recording_summary(stats.channel_stats(stats.by_channel(signals.dirty(spark, d)))), "recording peak_channel overrange not_finite", "peak rms crest_db")


@query("c4_peaks_by_level", f"with {_CH} select recording, channel::bigint as channel, {r(f'max(abs(value)) filter ({_OK})', 'peak')}, count(*) filter ({_OK} and abs(value) > 1) as overrange from channels group by grouping sets ((recording, channel), (recording))", "dirty")
def c4b(spark, d):
    return out(stats.peaks_by_level(stats.by_channel(signals.dirty(spark, d))), "recording channel overrange", "peak")


_L, _R = '"left"', '"right"'
_SUMS = f"count(*) filter (ok) as n, sum({_L}) filter (ok) as sl, sum({_R}) filter (ok) as sr, sum({_L} * {_L}) filter (ok) as sll, sum({_R} * {_R}) filter (ok) as srr, sum({_L} * {_R}) filter (ok) as slr"
_CORR = "(case when sqrt(greatest(0.0, (sll - sl * sl / n) * (srr - sr * sr / n))) > 0 then greatest(-1.0, least(1.0, (slr - sl * sr / n) / sqrt(greatest(0.0, (sll - sl * sl / n) * (srr - sr * sr / n))))) end)"
_PDB = lambda a, b: f"(case when {b} > 0 and {a} > 0 then 10 * log10({a} / {b}) end)"


@query("c5_stereo", f"""with f as (select *, {FINITE(_L)} as ok, ({_L} + {_R}) / 2 as mid, ({_L} - {_R}) / 2 as side from dirty), s as (select recording, {_SUMS}, sum(mid * mid) filter (ok) as mm, sum(side * side) filter (ok) as ss, max(abs(mid)) filter (ok) as mono_peak, arg_max(frame, (abs(mid), -frame)) filter (ok) as mono_peak_frame from f group by recording)
 select recording, {r(_CORR, "correlation")}, {r(_PDB("sll", "srr"), "balance_db")}, {r(_PDB("mm", "ss"), "mid_side_db")}, {r("case when mm > 0 then 10 * log10(mm / ((sll + srr) / 2)) else -300.0 end", "mono_delta_db")}, {r("mono_peak", "mono_peak")}, mono_peak_frame from s""", "dirty")
def c5(spark, d):
    return out(stats.stereo_metrics(signals.dirty(spark, d)), "recording mono_peak_frame", "correlation balance_db mid_side_db mono_delta_db mono_peak")


_MS = f"sum(({_L} + {_R}) * ({_L} + {_R}) / 4) filter (ok) as mm, sum(({_L} - {_R}) * ({_L} - {_R}) / 4) filter (ok) as ss"


def _step_sql(n: int) -> str:
    return f"""with f as (select *, {FINITE(_L)} as ok, case when {FINITE(_L)} then {_L} else 0.0 end as l, {_R} as rr from dirty), s as (select recording, floor(frame / {n})::bigint as step, count(*) as frames, sum(l * l) as l2, sum(rr * rr) as r2, max(greatest(abs(l), abs(rr))) as peak, {_SUMS}, {_MS} from f group by all)
 select recording, step, frames, {r(f"case when frames = {n} then (l2 + r2) / frames end", "energy")}, {r("(l2 + r2) / (2 * frames)", "raw_energy")}, {r("peak", "peak")}, {r("sqrt(l2 / frames)", "rms_left")}, {r("sqrt(r2 / frames)", "rms_right")}, {r(_CORR, "correlation")}, {r(_PDB("sll", "srr"), "balance_db")}, {r(_PDB("mm", "ss"), "mid_side_db")} from s"""


@query("c6_step_table", _step_sql(10), "dirty")
def c6(spark, d):
    return out(stats.step_table(signals.dirty(spark, d), 10), "recording step frames", "energy raw_energy peak rms_left rms_right correlation balance_db mid_side_db")


@query("c7_max_steps", f"with s as (select recording, floor(frame / 2)::bigint as step, count(*) as n, sum(case when {FINITE(_L)} then {_L} * {_L} else 0.0 end + {_R} * {_R}) as e from dirty group by all) select recording, step, {r(LUFS('(case when n = 2 then e / n end)'), 'level')} from s", "dirty")
def c7(spark, d):
    from ..functions.audio import lufs

    return out(stats.step_table(signals.dirty(spark, d), 2).withColumn("level", lufs("energy")), "recording step", "level")


_ABS = "pow(10.0, (-70.0 + 0.691) / 10)"


def _rolled(n: int, name: str, of: str = "steps", value: str = "energy") -> str:
    w = f"over (partition by recording order by step rows between {n - 1} preceding and current row)"
    return f"case when count({value}) {w} = {n} then avg({value}) {w} end as {name}"


_MOM = f"m as (select *, {_rolled(4, 'momentary')}, {_rolled(30, 'short_term')} from steps)"
_GATE = lambda c, f: f"g as (select *, avg(case when {c} > {_ABS} then {c} end) over (partition by recording) * {f} as gate from m)"


def _rolled_steps(spark, d):
    return loudness.rolling_energy(loudness.rolling_energy(signals.steps(spark, d), 4, "momentary"), 30, "short_term")


@query("w1_rolling", f"with {_MOM} select recording, step, {r(LUFS('momentary'), 'momentary_lufs')}, {r(LUFS('short_term'), 'short_term_lufs')} from m", "steps")
def w1(spark, d):
    from ..functions.audio import lufs

    m = _rolled_steps(spark, d)
    return out(m.select("recording", "step", lufs("momentary").alias("momentary_lufs"), lufs("short_term").alias("short_term_lufs")), "recording step", "momentary_lufs short_term_lufs")


@query("w2_max_loudness", f"""with m as (select *, {_rolled(4, 'rolled')} from steps), o as (select *, row_number() over (partition by recording order by rolled desc nulls last, step) as nth, max(step) over (partition by recording) as last from m)
 select recording, {r(LUFS('rolled'), 'loudness')}, {r('case when rolled is not null then least((step + 1) * 0.1, (last + 1) * 0.1) end', 'seconds')} from o where nth = 1""", "steps")
def w2(spark, d):
    return out(loudness.max_loudness(signals.steps(spark, d), 4, 0.1), "recording", "loudness seconds")


_RUNNING_SQL = f"""with {_MOM}, p as (select * from m where recording <= 20), t as (select recording, step from p qualify step % 10 = 9 or step = max(step) over (partition by recording)),
 a as (select t.recording, t.step, avg(case when p.momentary > {_ABS} then p.momentary end) * 0.1 as gate from t join p on p.recording = t.recording and p.step <= t.step group by all),
 v as (select a.recording, a.step, avg(case when p.momentary > {_ABS} and p.momentary > a.gate then p.momentary end) as e from a join p on p.recording = a.recording and p.step <= a.step group by all)
 select p.recording, p.step, {r(LUFS("last_value(v.e ignore nulls) over (partition by p.recording order by p.step)"), 'running_lufs')} from p left join v on v.recording = p.recording and v.step = p.step"""


@query("w3_running_integrated", _RUNNING_SQL.replace("where recording <= 20", "where true"), "steps")
def w3(spark, d):
    return out(loudness.running_integrated(_rolled_steps(spark, d)).withColumnRenamed("running", "running_lufs"), "recording step", "running_lufs")


@query("c8_integrated", f"with {_MOM}, {_GATE('momentary', 0.1)} select recording, {r(LUFS(f'(avg(case when momentary > {_ABS} and momentary > gate then momentary end))'), 'integrated')} from g group by recording", "steps")
def c8(spark, d):
    return out(loudness.integrated_lufs(_rolled_steps(spark, d)), "recording", "integrated")


_GATED = f"case when short_term > {_ABS} and short_term > gate then -0.691 + 10 * log10(short_term) end"


@query("c9_loudness_range", f"with {_MOM}, {_GATE('short_term', 0.01)} select recording, {r(f'quantile_cont({_GATED}, 0.95) - quantile_cont({_GATED}, 0.1)', 'loudness_range')} from g group by recording", "steps")
def c9(spark, d):
    return out(loudness.loudness_range(_rolled_steps(spark, d)), "recording", "loudness_range")


@query("c10_envelope", f"""with {_CH}, n as (select recording, ceil((max(frame) + 1) / greatest(16.0, least(32.0, max(frame) + 1)))::bigint as per from channels group by recording)
 select recording, channel::bigint as channel, floor(frame / per)::bigint as bin, count(*) as n, {r(f"coalesce(min(value) filter ({_OK}), 0.0)", "lowest")}, {r(f"coalesce(max(value) filter ({_OK}), 0.0)", "highest")}, {r(f"coalesce(sqrt(avg(value * value) filter ({_OK})), 0.0)", "rms")} from channels join n using (recording) group by all""", "dirty")
def c10(spark, d):
    return out(stats.waveform_envelope(stats.by_channel(signals.dirty(spark, d)), 32, 16), "recording channel bin n", "lowest highest rms")


@query("c11_detail", f"""with {_CH} select recording, channel::bigint as channel, floor((frame - 5) / 3)::bigint as bin, count(*) as n, {r(f"coalesce(min(value) filter ({_OK}), 0.0)", "lowest")}, {r(f"coalesce(max(value) filter ({_OK}), 0.0)", "highest")}, {r("arg_min(value, frame)", "first_value")} from channels where frame >= 5 and frame < 35 group by all""", "dirty")
def c11(spark, d):
    got = stats.waveform_detail(stats.by_channel(signals.dirty(spark, d)), 5, 35, 10, values=True)
    return out(got.withColumn("first_value", F.element_at("values", 1)), "recording channel bin n", "lowest highest first_value")


@query("c12_negative_correlation", f"select recording, {r('100.0 * count(*) filter (correlation < -0.25) / count(correlation)', 'negative_pct')} from steps group by recording", "steps")
def c12(spark, d):
    return out(stats.negative_correlation_pct(signals.steps(spark, d)), "recording", "negative_pct")


_H = lambda x, k: f"floor(({x}) * 1e{k} + 0.5) / 1e{k} + 0.0"


@query("c13_segments", f"""with {_MOM}, n as (select recording, (max(step) + 1) * 0.1 as duration, greatest(5.0, ceil((max(step) + 1) * 0.1 / 720 / 5) * 5) as width from m group by recording),
 s as (select m.*, duration, width, floor(step * 0.1 / width + 1e-9)::bigint as a, (ceil((step + 1) * 0.1 / width - 1e-9) - 1)::bigint as b, case when energy > 0 then 10 * log10(energy) end as rms from m join n using (recording)),
 e as (select *, unnest(range(a, greatest(a, b) + 1)) as segment, {LUFS("momentary")} as ml, {LUFS("short_term")} as sl from s)
 select recording, segment::bigint as segment, {r("min(segment * width)", "start_s")}, {r("min(least(duration, (segment + 1) * width))", "end_s")}, {_H("quantile_cont(ml, 0.1)", 1)} as m_p10, {_H("quantile_cont(ml, 0.5)", 1)} as m_median, {_H("max(ml)", 1)} as m_max, {_H("quantile_cont(sl, 0.5)", 1)} as s_median, {_H("max(sl)", 1)} as s_max,
 {_H("max(20 * log10(sqrt(energy) * 3))", 1)} as peak_db, {_H("quantile_cont(correlation, 0.5)", 2)} as correlation_median, {_H("min(correlation)", 2)} as correlation_min, floor(100.0 * count(*) filter (rms <= -80) / count(rms) + 0.5) as silence_pct from e group by recording, segment""", "steps")
def c13(spark, d):
    steps = _rolled_steps(spark, d).withColumn("raw_energy", F.col("energy")).withColumn("peak", F.sqrt("energy") * 3)
    return out(loudness.temporal_segments(steps), "recording segment", "start_s end_s m_p10 m_median m_max s_median s_max peak_db correlation_median correlation_min silence_pct")


_ISLAND = lambda cond, keys="recording", src="dirty", at="frame": f"i as (select {keys}, {at} as pos, {at} - row_number() over (partition by {keys} order by {at}) as island from {src} where {cond}), runs as (select {keys}, min(pos) as start, max(pos) + 1 as \"end\", count(*) as length from i group by {keys}, island)"


@query("w4_discontinuities", f"with {_CH}, n as (select *, abs(value - lag(value) over (partition by recording, channel order by frame)) as delta from channels where {_OK}) select recording, channel::bigint as channel, frame, {r('delta', 'delta')} from n where delta >= 0.8", "dirty")
def w4(spark, d):
    return out(regions.discontinuities(stats.by_channel(signals.dirty(spark, d))), "recording channel frame", "delta")


@query("w5_flat_tops", f"""with {_CH}, n as (select *, lag(value) over (partition by recording, channel order by frame) as before from channels where {_OK}), b as (select *, sum(case when abs(value) >= 0.199 and abs(before) >= 0.199 and abs(value - before) <= 1e-7 then 0 else 1 end) over (partition by recording, channel order by frame) as run from n)
 select recording, channel::bigint as channel, min(frame) as start, max(frame) + 1 as "end", count(*) as length from b where abs(value) >= 0.199 group by recording, channel, run having count(*) >= 3""", "dirty")
def w5(spark, d):
    return out(regions.flat_tops(stats.by_channel(signals.dirty(spark, d)), 0.199), "recording channel start end length")


@query("w6_regions", f'with {_ISLAND(chr(34) + "right" + chr(34) + " > 0")}, t as (select *, row_number() over (partition by recording order by start) as nth, count(*) over (partition by recording) as total from runs where length >= 2) select recording, start, "end", length, nth, total from t where nth <= 1000', "dirty")
def w6(spark, d):
    return out(regions.kept_regions(regions.regions(signals.dirty(spark, d), F.col("right") > 0, 2)), "recording start end length nth total")


@query("w7_zero_regions", f'with {_ISLAND(chr(34) + "left" + chr(34) + " = 0 and " + chr(34) + "right" + chr(34) + " = 0")} select recording, start, "end", length from runs where length >= 2', "dirty")
def w7(spark, d):
    return out(regions.zero_regions(signals.dirty(spark, d), 2), "recording start end length")


@query("w8_overrange_regions", f'with {_ISLAND("abs(" + chr(34) + "left" + chr(34) + ") > 1 or abs(" + chr(34) + "right" + chr(34) + ") > 1", src="frames")} select recording, start, "end", length from runs', "frames")
def w8(spark, d):
    return out(regions.overrange_regions(signals.frames(spark, d)), "recording start end length")


@query("w9_invalid_regions", f'with {_CH}, {_ISLAND(f"not {_OK}", "recording, channel", "channels")} select recording, channel::bigint as channel, start, "end", length from runs', "dirty")
def w9(spark, d):
    return out(regions.invalid_regions(stats.by_channel(signals.dirty(spark, d))), "recording channel start end length")


@query("w10_low_level_regions", f'with {_ISLAND("energy <= 1e-8", src="steps", at="step")}, n as (select *, row_number() over (partition by recording order by start) as nth from runs where length >= 2) select recording, start, "end", length, nth from n where nth <= 50', "steps")
def w10(spark, d):
    return out(regions.low_level_regions(signals.steps(spark, d), 2), "recording start end length nth")


@query("w11_negative_regions", f'with {_ISLAND("correlation < -0.25", src="steps", at="step")} select recording, start, "end", length from runs where length >= 3', "steps")
def w11(spark, d):
    return out(regions.negative_correlation_regions(signals.steps(spark, d), 3), "recording start end length")


@query("l1_top_regions", f'with {_ISLAND("correlation < -0.25", src="steps", at="step")}, o as (select *, row_number() over (partition by recording order by length desc, start) as k from runs where length >= 1) select recording, start, "end", length, row_number() over (partition by recording order by start) as nth from o where k <= 50', "steps")
def l1(spark, d):
    return out(regions.top_regions(regions.negative_correlation_regions(signals.steps(spark, d), 1)), "recording start end length nth")


@query("l2_top_events", f"with {_CH}, n as (select *, abs(value - lag(value) over (partition by recording, channel order by frame)) as delta from channels where {_OK}), o as (select *, row_number() over (partition by recording order by delta desc, frame, channel) as nth from n where delta >= 0.8) select recording, channel::bigint as channel, frame, {r('delta', 'delta')}, nth from o where nth <= 10", "dirty")
def l2(spark, d):
    return out(regions.top_events(regions.discontinuities(stats.by_channel(signals.dirty(spark, d))), "delta", 10), "recording channel frame nth", "delta")


def _dither_sql(k: str) -> str:
    """One draw of the counter generator, in exact wide integers."""
    m = "4294967296"
    return f"(select xor(v2, v2 >> 14) / {m}.0 from (select xor(v1, ((v1 + (xor(v1, v1 >> 7)::hugeint * (v1 | 61)) % {m}) % {m})::bigint) as v2 from (select ((xor(s, s >> 15)::hugeint * (s | 1)) % {m})::bigint as v1 from (select (({0x4C6A7564} + {k}::hugeint * {0x6D2B79F5}) % {m})::bigint as s))))"


@query("a6_dither", f"select recording, frame, {r(_dither_sql('(2 * frame + 1)') + ' - ' + _dither_sql('(2 * frame + 2)'), 'noise')} from frames", "frames")
def a6(spark, d):
    return out(signals.frames(spark, d).withColumn("noise", edits.tpdf_noise(F.col("frame"))), "recording frame", "noise")


_Q = lambda v, bits: f"(case when {FINITE(v)} then floor(greatest(-1.0, least(1 - 1 / {2.0 ** (bits - 1)}, {v})) * {2.0 ** (bits - 1)} + 0.5) else 0.0 end)::bigint"


@query("a5_encode", f"select recording, frame, {_Q(_L, 16)} as pcm16, {_Q(_L, 24)} as pcm24, {_Q(_L, 32)} as pcm32 from dirty", "dirty")
def a5(spark, d):
    f = signals.dirty(spark, d)
    return out(f.select("recording", "frame", *[edits.quantised(F.col("left"), F.lit(0.0), b).alias(f"pcm{b}") for b in (16, 24, 32)]), "recording frame pcm16 pcm24 pcm32")


_NOISE = f"{_dither_sql('(2 * i + 1)')} - {_dither_sql('(2 * i + 2)')}"


@query("a5_payload", f"""with v as (select recording, frame, channel, frame * 2 + channel as i, value from channels), q as (select *, (case when {FINITE('value')} then floor(greatest(-1.0, least(1 - 1 / 32768.0, value + ({_NOISE}) / 32768)) * 32768 + 0.5) else 0.0 end)::bigint & 65535 as u from v),
 b as (select recording, frame // 64 as block_no, count(*) * 2 as bytes, sha256(unhex(string_agg(printf('%02x%02x', u % 256, u // 256), '' order by i))) as hash from q group by all)
 select recording, sum(bytes)::bigint as bytes, sha256(string_agg(hash, '' order by block_no)) as payload_hash from b group by recording""", "stereo")
def a5_payload(spark, d):
    return out(edits.payload_digest(edits.encode_payload(signals.stereo(spark, d), 16, "pcm", dithered=True)), "recording bytes", "", "payload_hash")


@query("f6_normalize_edits", """with e as (select *, case when recording % 7 > 0 then recording % 7 - 1 end as s, case when recording % 5 > 0 then 48000 - recording % 5 + 2 end as t, case when recording % 3 > 0 then gain * 3 end as g, case when recording % 6 = 1 then gain end as h, recording % 4 as fade_in, case when stage = 'P' then 50000 else 0 end as fade_out,
 case when recording % 10 = 0 then 2 else 0 end as regions, case when priority like '1%' then 'sample-payload-trim' when priority like '2%' then 'louder' when priority like '3%' then 'edited-wav' end as stated from reports),
 v as (select *, coalesce(s, 0) as a, coalesce(t, 48000) as b, coalesce(g, h, 0) as db, coalesce(g, h, 0) <> 0 or fade_in > 0 or fade_out > 0 or regions > 0 as changed from e)
 select recording, coalesce(stated, case when changed then 'edited-wav' else 'sample-payload-trim' end) as inferred, concat_ws(',', case when b > 48000 then 'range' end, case when g <> h then 'gain-conflict' end, case when db < -60 or db > 24 then 'gain' end, case when fade_out > b - a then 'fade' end, case when stated = 'louder' then 'profile' end,
 case when stated = 'sample-payload-trim' and changed then 'profile-contradiction' end) as errors from v""", "reports")
def f6(spark, d):
    n, p = F.col("recording"), F.col("priority")
    e = signals.reports(spark, d).select(
        "recording", F.lit(48000).alias("frames"), F.when(n % 7 > 0, n % 7 - 1).alias("start_frame"), F.when(n % 5 > 0, 48000 - n % 5 + 2).alias("end_frame"), F.when(n % 3 > 0, F.col("gain") * 3).alias("gain_db"), F.when(n % 6 == 1, F.col("gain")).alias("other_gain_db"), (n % 4).alias("fade_in"),
        F.when(F.col("stage") == "P", 50000).alias("fade_out"), F.when(n % 10 == 0, 2).alias("local_regions"), F.when(p.startswith("1"), "sample-payload-trim").when(p.startswith("2"), "louder").when(p.startswith("3"), "edited-wav").alias("profile"),
    )
    return out(edits.normalize_edits(e).withColumn("errors", F.concat_ws(",", "errors")), "recording", "", "inferred errors")


@query("f7_validate_regions", f"""with {_REGION_SQL}, c as (select *, case severity when 'critical' then -61.0 else -3.0 end as gain_db, row_number() over (partition by recording order by start_frame, id) as k from regions), w as (select *, case when k % 10 = 0 then 'same' when k % 10 = 1 then '' else id end as rid from c)
 select recording, id, concat_ws(',', case when end_frame > 12000 then 'bounds' end, case when k % 7 = 0 then 'order' end, case when gain_db < -60 then 'gain' end, case when k % 9 = 0 then 'target' end, case when rid = '' then 'id' end, case when count(*) over (partition by recording, rid) > 1 then 'id-repeated' end, case when count(*) over (partition by recording) > 256 then 'too-many' end) as errors from w""", "markers")
def f7(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("recording").orderBy("start_frame", "id"))
    regs = _regions(spark, d).withColumn("gain_db", F.when(F.col("severity") == "critical", -61.0).otherwise(-3.0)).withColumn("own", F.col("id")).withColumn("frames", F.lit(12_000)).withColumn("k", k)
    regs = regs.withColumn("id", F.when(F.col("k") % 10 == 0, " same ").when(F.col("k") % 10 == 1, "  ").otherwise(F.col("id"))).withColumn("release_start", F.when(F.col("k") % 7 == 0, F.col("end_frame")).otherwise(F.col("release_start"))).withColumn("target_dbtp", F.when(F.col("k") % 9 == 0, 1.0))
    return out(edits.validate_gain_regions(regs).select("recording", F.col("own").alias("id"), F.concat_ws(",", "errors").alias("errors")), "recording", "", "id errors")