"""Kernels over blocks, WAV files, documents and streams, over the signals derived from the tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import analysis, blocks, spectral
from ..sources import documents, signals, wav
from ..streaming import live
from .registry import out, query, r

RATE, HALO, BLOCK, STEP = 48_000, 12_000, 64, 100
_SHELF, _PASS = ([float(x) for x in s] for s in kernels.k_coefficients(RATE))


def _section(x: str, p: str, c: list[float]) -> str:
    return f"{c[0]!r} * {x} + {c[1]!r} * {p}x1 + {c[2]!r} * {p}x2 - {c[3]!r} * {p}y1 - {c[4]!r} * {p}y2"


_WEIGHTED = f"""w(recording, frame, ax1, ax2, ay1, ay2, bx2, by1, by2) as (select recording, -1::bigint, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double from samples where frame = 0
 union all select recording, nf, x, ax1, a, ay1, ay1, {_section('a', 'b', _PASS).replace('bx1', 'ay1')}, by1 from (select w.*, s.frame as nf, s.value as x, {_section('s.value', 'w.a', _SHELF)} as a from w join samples s on s.recording = w.recording and s.frame = w.frame + 1) t)"""


def _recursive(sql: str) -> str:
    return f"with recursive {signals.SQL['blocks']}, {_WEIGHTED} {sql}"


def _blocks(spark, d):
    return blocks.with_halo(signals.blocks(spark, d), HALO, BLOCK)


@query("k1_k_weight", _recursive(f"select recording, frame // 64 as block_no, {r('sum(by1 * by1) * 1000', 'energy')} from w where frame >= 0 group by all"))
def k1(spark, d):
    done = blocks.split_blocks(blocks.k_weight(_blocks(spark, d), RATE), BLOCK)
    return out(done.withColumn("energy", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x) * 1000), "recording block_no", "energy")


_TAPS = ", ".join(f"({p}, {lag}, {c!r})" for p, pairs in enumerate(kernels.peak_phases(4)) for lag, c in pairs)


@query("k2_true_peak", f"""with taps(phase, lag, c) as (values {_TAPS}), n as (select recording, max(frame) + 1 as n from samples group by 1), ph as (select distinct phase from taps),
 p as (select s.recording, s.frame + lag as frame, phase, sum(c * value) as v from samples s, taps group by all),
 a as (select recording, cast(frame as double) as pos, abs(value) as v from samples union all select recording, frame - 6 + phase / 4.0, abs(v) from p)
 select recording, {r('max(v)', 'true_peak')}, {r('greatest(0.0, least(any_value(n) - 1.0, arg_max(pos, v)))', 'frame')} from a join n using (recording) group by recording""", "blocks")
def k2(spark, d):
    return out(blocks.true_peak(_blocks(spark, d), RATE), "recording", "true_peak frame")


@query("k3_block_steps", _recursive(f""", s as (select recording, frame // {STEP} as step, count(*) as frames, sum(value * value) / count(*) as raw, max(abs(value)) as peak from samples group by all), k as (select recording, frame // {STEP} as step, sum(by1 * by1) / count(*) as k from w where frame >= 0 group by all)
 select recording, step, frames, {r(f'case when frames = {STEP} then k * 1000 end', 'k_energy')}, {r('raw * 1000', 'raw_energy')}, {r('peak', 'peak')} from s join k using (recording, step)"""))
def k3(spark, d):
    got = blocks.block_steps(_blocks(spark, d), RATE, STEP)
    return out(got.withColumn("k_energy", F.col("k_energy") * 1000).withColumn("raw_energy", F.col("raw_energy") * 1000), "recording step frames", "k_energy raw_energy peak")


_OK = lambda c: f"(not isnan({c}) and not isinf({c}))"
_WEIGHTED_2 = f"""clean as (select recording * 2 + channel as recording, frame, case when {_OK('value')} then value else 0.0 end as value from channels), {_WEIGHTED.replace('samples', 'clean')}"""
_PDB = lambda a, b: f"(case when {b} > 0 and {a} > 0 then 10 * log10({a} / {b}) end)"
_BOTTOM = "sqrt(greatest(0.0, (sll - sl * sl / n) * (srr - sr * sr / n)))"


@query("c6_block_steps", f"""with recursive {signals.SQL['stereo']}, {_WEIGHTED_2}, k as (select recording // 2 as recording, frame // {STEP} as step, sum(by1 * by1) as k from w where frame >= 0 group by all),
 f as (select *, {_OK('"left"')} and {_OK('"right"')} as ok, case when {_OK('"left"')} then "left" else 0.0 end as l, case when {_OK('"right"')} then "right" else 0.0 end as x from stereo),
 s as (select recording, frame // {STEP} as step, count(*) as frames, sum(l * l) as l2, sum(x * x) as r2, max(greatest(abs(l), abs(x))) as peak, count(*) filter (ok) as n, sum(l) filter (ok) as sl, sum(x) filter (ok) as sr, sum(l * l) filter (ok) as sll, sum(x * x) filter (ok) as srr, sum(l * x) filter (ok) as slr, sum((l + x) * (l + x) / 4) filter (ok) as mm, sum((l - x) * (l - x) / 4) filter (ok) as ss from f group by all)
 select recording, step, frames, {r(f'case when frames = {STEP} then k / frames * 1000 end', 'energy')}, {r('(l2 + r2) / (2 * frames) * 1000', 'raw_energy')}, {r('peak', 'peak')}, {r('sqrt(l2 / frames)', 'rms_left')}, {r('sqrt(r2 / frames)', 'rms_right')}, {r(f'case when {_BOTTOM} > 0 then greatest(-1.0, least(1.0, (slr - sl * sr / n) / {_BOTTOM})) end', 'correlation')}, {r(_PDB('sll', 'srr'), 'balance_db')}, {r(_PDB('mm', 'ss'), 'mid_side_db')} from s join k using (recording, step)""")
def c6_blocks(spark, d):
    got = blocks.stereo_steps(blocks.with_halo(signals.stereo(spark, d), HALO, BLOCK), RATE, STEP)
    return out(got.withColumn("energy", F.col("energy") * 1000).withColumn("raw_energy", F.col("raw_energy") * 1000), "recording step frames", "energy raw_energy peak rms_left rms_right correlation balance_db mid_side_db")


def _marks(spark, d):
    stereo = signals.stereo(spark, d).select("*", F.posexplode("samples").alias("channel", "side"))
    return blocks.block_marks(stereo.select("recording", "channel", "start_frame", F.col("side").alias("samples")), 0.3, 0.1, 1e-7, 0.25, 3)


_NEAR = f"n as (select *, lag(value) over (partition by recording, channel order by frame) as before from channels where {_OK('value')})"


@query("k4_block_flat_tops", f"""with {_NEAR}, b as (select *, sum(case when abs(value) >= 0.1 and abs(before) >= 0.1 and abs(value - before) <= 1e-7 then 0 else 1 end) over (partition by recording, channel order by frame) as run from n)
 select recording, channel::bigint as channel, min(frame) as start, max(frame) + 1 as "end", count(*) as length from b where abs(value) >= 0.1 group by recording, channel, run having count(*) >= 3""", "stereo")
def k4_flat(spark, d):
    return out(blocks.flat_tops_of_marks(_marks(spark, d), 0.1), "recording channel start end length")


@query("k4_block_jumps", f"with {_NEAR} select recording, channel::bigint as channel, frame, {r('abs(value - before)', 'delta')} from n where abs(value - before) >= 0.25", "stereo")
def k4_jumps(spark, d):
    return out(blocks.discontinuities_of_marks(_marks(spark, d), 0.25), "recording channel frame", "delta")


@query("k4_block_invalid", f"""with i as (select *, frame - row_number() over (partition by recording, channel order by frame) as island from channels where not {_OK('value')}) select recording, channel::bigint as channel, 'invalid' as kind, min(frame) as start, max(frame) + 1 as "end", count(*) as length from i group by recording, channel, island""", "stereo")
def k4_invalid(spark, d):
    return out(blocks.runs_of_marks(_marks(spark, d)).where("kind = 'invalid'"), "recording channel start end length", "", "kind")


@query("k4_block_runs", """with i as (select recording, frame, frame - row_number() over (partition by recording order by frame) as island from samples where abs(value) > 0.1) select recording, 'overrange' as kind, min(frame) as start, max(frame) + 1 as "end", count(*) as length from i group by recording, island having count(*) >= 2""", "blocks")
def k4(spark, d):
    return out(blocks.block_runs(signals.blocks(spark, d), 0.1, {"overrange": 2}), "recording start end length", "", "kind")


_WINDOWS = "n as (select recording, max(frame) + 1 as len from samples group by 1), win as (select distinct recording, floor((len - least(len, 240000)) * i / 11 + 0.5)::bigint as window_start, floor((len - least(len, 240000)) * i / 11 + 0.5)::bigint + least(len, 240000) as window_end from n, range(12) t(i))"


def _samples(spark, d):
    return signals.blocks(spark, d).select("recording", F.posexplode("samples").alias("i", "value"), "start_frame").select("recording", (F.col("start_frame") + F.col("i")).alias("frame"), "value")


def _windows(spark, d):
    lengths = signals.blocks(spark, d).groupBy("recording").agg((F.count("*") * BLOCK).alias("length")).withColumn("start", F.lit(0))
    return spectral.spectral_windows(lengths, RATE)


@query("k5_spectral_windows", f"with {_WINDOWS} select recording, window_start, window_end from win", "blocks")
def k5(spark, d):
    return out(_windows(spark, d), "recording window_start window_end")


_ALPHA = {hz: 1 - math.exp(-2 * math.pi * hz / 4000) for hz in (20, 120)}
_SCREENED = f"{_WINDOWS}, sc as (select s.recording, window_start, (frame - window_start) // 12 as i, value from samples s join win on win.recording = s.recording and frame >= window_start and frame < window_end and (frame - window_start) % 12 = 0)"


@query("k6_low_frequency", f"""with recursive {signals.SQL['blocks']}, {_SCREENED}, lo(recording, window_start, i, x, a, b) as (select recording, window_start, -1::bigint, 0.0::double, 0.0::double, 0.0::double from sc where i = 0
 union all select lo.recording, lo.window_start, sc.i, sc.value, lo.a + {_ALPHA[20]!r} * (sc.value - lo.a), lo.b + {_ALPHA[120]!r} * (sc.value - lo.b) from lo join sc on sc.recording = lo.recording and sc.window_start = lo.window_start and sc.i = lo.i + 1)
 select recording, window_start, {r('least(100.0, 100 * sum(a * a) / sum(x * x))', 'subsonic_pct')}, {r('least(100.0, 100 * sum(b * b) / sum(x * x))', 'low_pct')}, {r('least(100.0, 100 * sum((x - b) * (x - b)) / sum(x * x))', 'above_120_pct')} from lo where i >= 0 group by all""")
def k6(spark, d):
    part = spectral.screened(_samples(spark, d), _windows(spark, d), RATE).withColumn("left", F.col("value")).withColumn("right", F.col("value"))
    return out(spectral.low_frequency_metrics(part, 4000.0), "recording window_start", "subsonic_pct low_pct above_120_pct")


def _hum(h: int) -> str:
    w = 2 * math.pi * 50 * h / 4000
    return f"10 * log10((power(sum(value * cos(i * {w!r})), 2) + power(sum(value * sin(i * {w!r})), 2)) / (count(*) * sum(value * value)))"


@query("k7_mains_hum", f"with {_SCREENED} select recording, window_start, {r(_hum(1), 'hum_db')}, {r('greatest(' + ', '.join(_hum(h) for h in range(1, 5)) + ')', 'highest_db')} from sc group by all", "blocks")
def k7(spark, d):
    part = spectral.screened(_samples(spark, d), _windows(spark, d), RATE)
    return out(spectral.mains_hum(part, 4000.0), "recording window_start", "hum_db highest_db")


_SPECTRUM = f"""n as (select recording, max(frame) + 1 as len from samples group by 1), co as (select recording, c, greatest(0, least(len - 128, floor((c + 0.5) / 8 * len + 0.5)::bigint - 64)) as b from n, range(8) t(c)),
 fr as (select co.recording, c, frame - b as i, value * (0.5 - 0.5 * cos(2 * pi() * (frame - b) / 127)) as x from co join samples s on s.recording = co.recording and frame >= b and frame < b + 128),
 sp as (select recording, c, k, sqrt(power(sum(x * cos(2 * pi() * i * k / 128)), 2) + power(sum(x * sin(2 * pi() * i * k / 128)), 2)) as m from fr, range(64) t(k) group by all),
 lv as (select recording, c as "column", k, floor(255 * greatest(0.0, least(1.0, (greatest(-140.0, 20 * log10(greatest(m * 4 / 128, 1e-300))) + 100) / 100)) + 0.5)::bigint as level from sp)"""


def _spectrogram(spark, d):
    return spectral.spectrogram(signals.blocks(spark, d), BLOCK, 128, 8, -100.0)


@query("k9_spectrogram", f'with {_SPECTRUM} select recording, "column", k, level from lv', "blocks")
def k9(spark, d):
    return out(_spectrogram(spark, d).select("recording", "column", F.posexplode("levels").alias("k", "level")), "recording column k level")


@query("k10_log_frequency", f'with {_SPECTRUM}, y as (select y, greatest(0, least(63, floor(20.0 * pow(1200.0, 1 - y / 255.0) / 24000 * 64 + 0.5)::bigint)) as k from range(256) t(y)) select recording, "column", y, level from lv join y using (k)', "blocks")
def k10(spark, d):
    return out(spectral.log_frequency_rows(_spectrogram(spark, d), RATE / 2), "recording column y level")


def _files(spark, d):
    """A WAV file per recording; some damaged in ways that the inventory must tell."""
    files = wav.encode_files(signals.frames(spark, d), RATE).withColumn("recording", F.regexp_extract("path", r"(\d+)", 1).cast("long"))
    n, c = F.col("recording") % 10, F.col("content")
    tail = lambda k: F.substring(c, F.lit(k), F.octet_length(c))
    damaged = F.when(n == 1, F.concat(F.lit("RF64").cast("binary"), tail(5))).when(n == 2, F.substring(c, 1, 8)).when(n == 3, F.concat(F.lit("RIFX").cast("binary"), tail(5))).when(n == 4, F.substring(c, F.lit(1), F.octet_length(c) - 6))
    return files.withColumn("content", damaged.otherwise(c))


@query("a1_wav_inventory", "select recording, 48000::bigint as sample_rate, 2::bigint as channels, 16::bigint as bits, count(*) - case when recording % 10 = 4 then 2 else 0 end as frames, recording % 10 = 4 as truncated from frames where recording % 10 not in (1, 2, 3) group by recording", "frames")
def a1(spark, d):
    found = wav.wav_inventory(_files(spark, d)).where("status = 'ok'").withColumn("recording", F.regexp_extract("path", r"(\d+)", 1).cast("long"))
    return out(found, "recording sample_rate channels bits frames", "", "truncated")


@query("a2_wav_rejects", "select distinct recording, case recording % 10 when 1 then 'rf64' when 2 then 'too-short' else 'not-wave' end as reason from frames where recording % 10 in (1, 2, 3)", "frames")
def a2(spark, d):
    found = wav.wav_rejects(wav.wav_inventory(_files(spark, d))).withColumn("recording", F.regexp_extract("path", r"(\d+)", 1).cast("long"))
    return out(found, "recording", "", "reason")


_PCM = lambda c: f"floor(greatest(-1.0, least(1 - 1 / 32768.0, {c})) * 32768 + 0.5) / 32768"


@query("a3_wav_blocks", f'with c as (select recording, frame, 0 as channel, "left" as v from frames union all select recording, frame, 1, "right" from frames) select recording, channel::bigint as channel, frame // 10 as block_no, count(*) as n, {r("sum(" + _PCM("v") + ")", "total")} from c join (select recording, max(frame) + 1 as n from frames group by 1) using (recording) where recording % 10 = 0 or recording % 10 > 4 or (recording % 10 = 4 and frame < n - 2) group by all', "frames")
def a3(spark, d):
    found = wav.wav_blocks(_files(spark, d), 10 / RATE).withColumn("recording", F.regexp_extract("path", r"(\d+)", 1).cast("long"))
    return out(found.withColumn("n", F.size("samples")).withColumn("total", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)), "recording channel block_no n", "total")


_HEARD = f"""n as (select recording, max(frame) + 1 as n from frames group by 1), c as (select recording, frame, channel, {_PCM("v")} as value from (select recording, frame, 0 as channel, "left" as v from frames union all select recording, frame, 1, "right" from frames) join n using (recording) where recording % 10 = 0 or recording % 10 > 4 or (recording % 10 = 4 and frame < n - 2))"""


def _analysis(spark, d):
    """The analysis of the WAV files of the events, damaged ones among them."""
    files = _files(spark, d)
    number = F.regexp_extract("path", r"(\d+)", 1)
    blocks_ = wav.wav_blocks(files, 0.0005, 0.25, paired=True).withColumn("recording", number)
    layouts = wav.wav_inventory(files).where("status = 'ok'").select(number.alias("recording"), "truncated")
    return analysis.analyze(blocks_, layouts)


@query("analysis_summary", f"""with {_HEARD}, taps(phase, lag, c) as (values {_TAPS}), p as (select recording, channel, frame + lag as at, phase, sum(taps.c * value) as v from c, taps group by all), t as (select recording, channel, max(v) as v from (select recording, channel, abs(v) as v from p union all select recording, channel, abs(value) from c) group by all),
 tp as (select recording, max(v) as true_peak, arg_max(channel, (v, -channel)) as true_peak_channel from t group by 1), w as (select recording, frame, max(value) filter (channel = 0) as l, max(value) filter (channel = 1) as r from c group by all),
 s as (select recording, count(*) as n, max(greatest(abs(l), abs(r))) as peak, sqrt((sum(l * l) + sum(r * r)) / (2 * count(*))) as rms, sum(l) as sl, sum(r) as sr, sum(l * l) as sll, sum(r * r) as srr, sum(l * r) as slr, sum((l + r) * (l + r) / 4) as mm, sum((l - r) * (l - r) / 4) as ss, max(abs(l + r) / 2) as mono, arg_max(frame, (abs(l + r), -frame)) as mono_frame from w group by 1),
 j as (select recording, count(*) as jumps from (select *, abs(value - lag(value) over (partition by recording, channel order by frame)) as delta from c) where delta >= 0.8 group by 1)
 select recording, n as frames, coalesce(jumps, 0) as discontinuities, true_peak_channel::bigint as true_peak_channel, mono_frame as mono_peak_frame, {r('peak', 'peak')}, {r('true_peak', 'true_peak')}, {r('rms', 'rms')}, {r('20 * log10(peak / rms)', 'crest_db')}, {r(f'greatest(-1.0, least(1.0, (slr - sl * sr / n) / {_BOTTOM}))', 'correlation')}, {r(_PDB('sll', 'srr'), 'balance_db')}, {r(_PDB('mm', 'ss'), 'mid_side_db')},
 {r('10 * log10(mm / ((sll + srr) / 2))', 'mono_delta_db')}, {r('mono', 'mono_peak')} from s join tp using (recording) left join j using (recording)""", "frames")
def analysis_summary(spark, d):
    got = _analysis(spark, d).summary.withColumn("recording", F.col("recording").cast("long"))
    return out(got, "recording frames discontinuities true_peak_channel mono_peak_frame", "peak true_peak rms crest_db correlation balance_db mid_side_db mono_delta_db mono_peak")


@query("analysis_observations", f"""with {_HEARD}, d as (select *, abs(value - lag(value) over (partition by recording, channel order by frame)) as delta from c), s as (select recording, max(delta) as jump from d group by 1),
 o as (select recording, unnest(list_filter([case when recording % 10 = 4 then 'truncated-data' end, case when jump >= 0.8 then 'discontinuity' end, 'below-gate'], lambda x: x is not null)) as observation, generate_subscripts(list_filter([case when recording % 10 = 4 then 'truncated-data' end, case when jump >= 0.8 then 'discontinuity' end, 'below-gate'], lambda x: x is not null), 1) as nth from s)
 select recording, nth, observation from o""", "frames")
def analysis_observations(spark, d):
    got = _analysis(spark, d).observations
    return out(got.withColumn("recording", F.col("recording").cast("long")), "recording nth", "", "observation")


@query("analysis_markers", f"""with {_HEARD}, d as (select *, abs(value - lag(value) over (partition by recording, channel order by frame)) as delta from c), j as (select recording, 'discontinuity' as kind, frame / 48000.0 as start_s, row_number() over (partition by recording order by delta desc, frame / 48000.0) as nth from d where delta >= 0.8),
 k as (select recording, 'sample-peak' as kind, frame / 48000.0 as start_s, row_number() over (partition by recording, channel order by abs(value) desc, frame) as nth from c where value <> 0)
 select recording, kind, {r('start_s', 'start_s')} from (select * from j where nth <= 100 union all select * from k where nth = 1)""", "frames")
def analysis_markers(spark, d):
    got = _analysis(spark, d).markers.where("kind <> 'true-peak'")
    return out(got.withColumn("recording", F.col("recording").cast("long")), "recording", "start_s", "kind")


@query("a4_tables", f"select recording, count(*) as n, {r('sum(correlation)', 'total')} from steps group by recording", "steps")
def a4(spark, d):
    path = documents.work_path(spark, "steps")
    documents.write_table(signals.steps(spark, d), path, "recording")
    return out(documents.read_table(spark, path).groupBy("recording").agg(F.count("*").alias("n"), F.sum("correlation").alias("total")), "recording n", "total")


@query("a7_documents", "select event_id, case when event_type = 'click' then 'too-large' when event_type = 'error' then 'broken' end as reject, case when event_type not in ('click', 'error') then cast(regexp_extract(props, '(-?[0-9]+)', 1) as bigint) end as k from events")
def a7(spark, d):
    e = signals.table(spark, d, "events")
    text = F.when(F.col("event_type") == "click", F.concat("props", F.repeat(F.lit(" "), 200))).when(F.col("event_type") == "error", F.substring("props", 1, 5)).otherwise(F.col("props"))
    found = documents.parse_documents(e.withColumn("text", text), "k long", 100)
    return out(found.select("event_id", "reject", F.when(F.col("reject").isNull(), F.col("document.k")).alias("k")), "event_id k", "", "reject")


@query("a8_write_documents", """select recording, '{"recording":' || recording || ',"path":"' || path || '","size":' || size || '}' as json from files""", "files")
def a8(spark, d):
    path = documents.work_path(spark, "documents")
    documents.write_documents(signals.files(spark, d), ["recording", "path", "size"], path)
    read = spark.read.text(path).select(F.col("value").alias("json"))
    return out(read.withColumn("recording", F.get_json_object("json", "$.recording").cast("long")), "recording", "", "json")


@query("f24_tree_violations", "select event_id, case when event_type = 'error' then 'json' when event_type = 'click' then 'depth' when event_type = 'view' then 'text' else '' end as violations from events")
def f24(spark, d):
    e, t = signals.table(spark, d, "events"), F.col("event_type")
    deep = F.concat(F.repeat(F.lit("["), 10), F.lit("1"), F.repeat(F.lit("]"), 10))
    long = F.concat(F.lit('{"a": "'), F.repeat(F.lit("x"), 2001), F.lit('"}'))
    json = F.when(t == "error", F.substring("props", 1, 5)).when(t == "click", deep).when(t == "view", long).otherwise(F.col("props"))
    return out(documents.tree_violations(e.withColumn("json", json)), "event_id", "", "violations")


def _stream(spark, d):
    e = signals.table(spark, d, "events")
    # the times have no zone: they are read as UTC whatever the session's zone
    ts = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")))
    # a pattern, as a stream of files starts from a folder or a pattern, and the table may be one file
    return spark.readStream.schema(e.schema).parquet(f"{d}/events.parque[t]").select(F.col("user_id").alias("recording"), ts.alias("ts"), (F.col("value") / 100 - 0.5).alias("value"), "event_type", "event_id")


_DONE = "m as (select max(ts) - interval 1 hour as mark from events)"


@query("t1_live_steps", f"with {_DONE}, w as (select user_id as recording, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') as start, value / 100 - 0.5 as v from events) select recording, epoch_us(start)::bigint as start_us, count(*) as n, {r('avg(v * v) * 1.001', 'energy')}, {r('max(abs(v))', 'peak')} from w, m where start + interval 1 hour <= mark group by recording, start")
def t1(spark, d):
    got = live.drain(live.live_steps(_stream(spark, d), "1 hour", "1 hour"), spark, "live-steps")
    return out(got.withColumn("start_us", F.unix_micros("start")).withColumn("energy", F.col("energy") * 1.001), "recording start_us n", "energy peak")


@query("t2_live_rolling", f"with {_DONE}, w as (select user_id as recording, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') - to_hours(k::int) as start, value / 100 - 0.5 as v from events, range(3) t(k)) select recording, epoch_us(start)::bigint as start_us, {r('avg(v * v) * 1.001', 'energy')} from w, m where start + interval 3 hour <= mark group by recording, start")
def t2(spark, d):
    got = live.drain(live.live_rolling(_stream(spark, d), "3 hours", "1 hour", "1 hour"), spark, "live-rolling")
    return out(got.withColumn("start_us", F.unix_micros("start")).withColumn("energy", F.col("energy") * 1.001), "recording start_us", "energy")


_IDLE = 6 * 3600


@query("t3_live_runs", f"""with m as (select epoch_us(max(ts)) // 1000 * 1000 - 3600000000 as mark from events), e as (select user_id as recording, epoch_us(ts) as us, event_type in ('error', 'view') as holds from events), d as (select recording, us, holds from e, m where us <= mark),
 n as (select *, lag(us) over w as before, lag(holds) over w as held, lead(us) over w as after, lead(holds) over w as holds_on from d window w as (partition by recording order by us)),
 i as (select *, sum(case when held and us - before <= {_IDLE}000000 then 0 else 1 end) over (partition by recording order by us) as island from n where holds),
 g as (select recording, island, min(us) as start_us, max(us) as last, count(*) as length, case when bool_or(after is null) then null else max(after) end as after from i group by recording, island)
 select recording, start_us::bigint as start_us, (case when after - last <= {_IDLE}000000 then after else last + {_IDLE}000000 end)::bigint as end_us, length from g, m where after is not null or last + {_IDLE}000000 <= mark""")
def t3(spark, d):
    rows = _stream(spark, d).withColumn("holds", F.col("event_type").isin("error", "view"))
    return out(live.drain(live.live_runs(rows, "1 hour", _IDLE), spark, "live-runs", live.STORE), "recording start_us end_us length")


@query("t4_newest", f"select user_id as recording, event_type, max(event_id) as job, {r('arg_max(value / 100 - 0.5, event_id)', 'value')} from events group by user_id, event_type")
def t4_newest(spark, d):
    path, by = documents.work_path(spark, "live-newest"), ["job"]
    keys = ["recording", "event_type"]
    live.keep_newest(_stream(spark, d).select(*keys, F.col("event_id").alias("job"), "value"), path, keys, by)
    return out(live.newest_rows(spark, path, keys, by), "recording job", "value", "event_type")


@query("t4_without_repeats", "select distinct user_id as recording, event_type from events")
def t4(spark, d):
    got = live.drain(live.without_repeats(_stream(spark, d), ["recording", "event_type"], "400 days").select("recording", "event_type"), spark, "live-first")
    return out(got, "recording", "", "event_type")
