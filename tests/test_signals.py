"""Analytic expectations on synthesised sound: levels, peaks, loudness, files, and invariance to block size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonearchive.functions import kernels
from tonearchive.operators import blocks, edits, loudness, regions, rules, spectral, stats
from tonearchive.sources import wav

RATE = 48_000


def sine(hertz, seconds, amplitude=0.5, rate=RATE):
    return amplitude * np.sin(2 * np.pi * hertz * np.arange(int(rate * seconds)) / rate)


def as_blocks(spark, x, size, channel=0):
    rows = [(1, channel, k, a, x[a : a + size].tolist()) for k, a in enumerate(range(0, len(x), size))]
    return spark.createDataFrame(rows, "recording long, channel int, block_no long, start_frame long, samples array<double>")


def frames(spark, left, right):
    return spark.createDataFrame(pd.DataFrame({"recording": 1, "frame": np.arange(len(left)), "left": left, "right": right}))


def test_sine_levels(spark):
    got = stats.recording_summary(stats.channel_stats(stats.by_channel(frames(spark, sine(1000, 0.5), sine(1000, 0.5))))).first()
    assert 20 * np.log10(got.peak) == pytest.approx(-6.0206, abs=0.02) and 20 * np.log10(got.rms) == pytest.approx(-9.0309, abs=0.03)


def test_filter_from_rest_equals_the_recursion():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(1000)
    state, out = np.zeros((1, 4)), []
    for v in x:
        y, state = kernels._step(np.array([v]), state, kernels.k_coefficients(RATE))
        out.append(y[0])
    assert np.allclose(kernels.k_weight(x[None, :], RATE)[0], out, atol=1e-12)


def test_stereo_sine_loudness_and_block_size(spark):
    """A 997 Hz sine at 0 dBFS in one channel measures -3.01 LUFS; halves, seconds and whole recordings agree."""
    x = sine(997, 4, 1.0)
    seen = []
    for size in (24_000, 48_000, len(x)):
        cut = blocks.with_halo(as_blocks(spark, x, size), 12_000, size)
        steps = blocks.block_steps(cut, RATE, 4800).withColumnRenamed("k_energy", "energy")
        done = loudness.integrated_lufs(loudness.rolling_energy(steps, 4, "momentary")).first().integrated
        seen.append(done)
    assert seen[0] == pytest.approx(-3.01, abs=0.05) and np.ptp(seen) < 1e-9


def test_true_peak(spark):
    pattern = np.tile([0.99, 0.99, -0.99, -0.99], 250)
    got = blocks.true_peak(blocks.with_halo(as_blocks(spark, pattern, 100), 24, 100), RATE).first()
    assert 2.6 < 20 * np.log10(got.true_peak) < 3.2
    impulse = np.zeros(1000)
    impulse[400] = 0.9
    got = blocks.true_peak(blocks.with_halo(as_blocks(spark, impulse, 128), 24, 128), RATE).first()
    assert abs(got.frame - 400) <= 1 and got.true_peak == pytest.approx(0.9, abs=0.01)
    high = kernels.true_peak(sine(18_000, 0.2, 0.9), np.empty(0), RATE, True, 0)[0]
    assert 20 * np.log10(high) == pytest.approx(20 * np.log10(0.9), abs=0.05)


def test_antiphase(spark):
    x = sine(300, 0.2)
    got = stats.stereo_metrics(frames(spark, x, -x)).first()
    assert got.correlation < -0.9999 and got.mono_delta_db < -40


def test_dirty_float(spark):
    f = frames(spark, [0, 1.2, float("nan"), float("inf")], [0, -1.1, 0.2, 0.3])
    got = {r.channel: r for r in stats.channel_stats(stats.by_channel(f)).collect()}
    assert got[0].overrange == got[1].overrange == 1 and got[0].not_finite == 2 and got[1].not_finite == 0
    assert [(r.channel, r.start, r.end) for r in regions.invalid_regions(stats.by_channel(f)).collect()] == [(0, 2, 4)]


def test_gates():
    values = np.array([1e-4, 1e-4, 1e-3, 1e-3, 1e-2, 1e-2])
    found = kernels.runs(values > 5e-4)
    assert found[0].tolist() == [2] and found[1].tolist() == [6]
    assert np.isnan(kernels.gated_prefix_means(np.zeros(5), np.array([4]), 1e-7, 0.1)).all()
    rng = np.random.default_rng(2)
    e = rng.gamma(0.3, 1e-3, 300)
    plain = [np.mean(p[p > 0.1 * p.mean()]) for k in (9, 99, 299) for p in [e[: k + 1][e[: k + 1] > 10 ** ((-70 + 0.691) / 10)]]]
    assert np.allclose(kernels.gated_prefix_means(e, np.array([9, 99, 299]), 10 ** ((-70 + 0.691) / 10), 0.1), plain)


def test_local_gain_ramp(spark):
    held = 10 ** (-6.02 / 20)
    region = F.array(F.struct(F.lit(10).alias("start_frame"), F.lit(20).alias("attack_end"), F.lit(30).alias("release_start"), F.lit(41).alias("end_frame"), F.lit(-6.02).alias("gain_db")))
    got = {r.frame: r.f for r in spark.range(50).select(F.col("id").alias("frame"), edits.local_gain_factor(F.col("id"), region).alias("f")).collect()}
    assert [got[k] for k in (9, 10, 20, 30, 40, 41)] == pytest.approx([1, 1, held, held, 1, 1])


def test_overlapping_fades(spark):
    got = [r.f for r in spark.range(4).orderBy("id").select(edits.fade_factor(F.col("id"), F.lit(4), F.lit(4), F.lit(4)).alias("f")).collect()]
    assert got == pytest.approx([0, 1 / 3, 1 / 3, 0])


@pytest.mark.parametrize("bits,encoding", [(16, "pcm"), (24, "pcm"), (32, "pcm"), (32, "float")])
def test_files_round_trip(spark, tmp_path, bits, encoding):
    x = np.stack([sine(440, 1.3, 0.7), sine(330, 1.3, 0.4)], axis=1)
    content = wav.wav_bytes(x, RATE, bits, encoding)
    (tmp_path / "a.wav").write_bytes(content)
    spark.dataSource.register(wav.WavSource)
    whole = spark.read.format("binaryFile").load(f"{tmp_path}/a.wav")
    by_row = wav.wav_blocks(whole).orderBy("channel", "block_no").collect()
    by_range = spark.read.format("wav_blocks").option("path", f"{tmp_path}/a.wav").load().orderBy("channel", "block_no").collect()
    assert [r.samples for r in by_row] == [r.samples for r in by_range] and [len(r.halo) for r in by_range] == [0, 12_000] * 2
    got = np.concatenate([r.samples for r in by_row if r.channel == 0])
    assert np.abs(got - x[:, 0]).max() <= (1e-7 if encoding == "float" else 0.51 / 2 ** (bits - 1))
    assert wav.wav_inventory(whole).first().frames == len(x)


def test_valid_bits_and_bad_files(spark):
    payload = np.array([-0.5 * 2**31, 0.25 * 2**31]).astype("<i4").tobytes()
    assert wav.decode(payload, "pcm", 32, 24, 1)[0].tolist() == [-0.5, 0.25]
    good = wav.wav_bytes(np.zeros(4), RATE)
    odd = [None, b"", good[:20], good.replace(b"fmt ", b"junk"), good.replace(b"data", b"nope"), good[:22] + b"\3\0" + good[24:], good[:24] + b"\1\0\0\0" + good[28:]]
    frame = spark.createDataFrame([(str(i), c) for i, c in enumerate(odd)], "path string, content binary")
    got = {r.path: r.reason for r in wav.wav_rejects(wav.wav_inventory(frame)).collect()}
    assert got == {"0": "too-short", "1": "too-short", "2": "no-data", "3": "no-fmt", "4": "no-data", "5": "channels", "6": "sample-rate"}


def test_spectrogram_separates_tones(spark):
    def loudest(hertz):
        levels = spectral.spectrogram(as_blocks(spark, sine(hertz, 0.5), 4800), 4800, 1024, 8).first().levels
        return int(np.argmax(levels)) * RATE / 1024

    assert loudest(1000) == pytest.approx(1000, abs=47) and loudest(3000) == pytest.approx(3000, abs=47)


def test_runs_join_across_blocks(spark):
    x = np.zeros(1000)
    x[::250] = 0.5
    for size in (64, 250, 1000):
        got = sorted((r.start, r.end) for r in blocks.block_runs(as_blocks(spark, x, size)).collect())
        assert got == [(1, 250), (251, 500), (501, 750), (751, 1000)]


def test_marks_equal_the_frames_whatever_the_blocks(spark):
    """Flat tops and jumps over blocks of any size: those of the frames, invalid samples at edges and single samples in blocks included."""
    rng = np.random.default_rng(6)
    x = np.clip(rng.standard_normal(500), -1, 1)
    x[100:140], x[[64, 128, 129, 250, 251]] = 1.0, np.nan
    x[99], x[140], x[192:256] = 0.0, 0.0, np.nan  # a block without a finite sample
    frame = spark.createDataFrame([(1, 0, k, v) for k, v in enumerate(x.tolist())], "recording long, channel int, frame long, value double")
    tops = sorted((r.start, r.end, r.length) for r in regions.flat_tops(frame).collect())
    jumps = sorted((r.frame, round(r.delta, 9)) for r in regions.discontinuities(frame).collect())
    assert (100, 140, 38) in tops and len(jumps) > 50
    for size in (1, 7, 64, 500):
        marks = blocks.block_marks(as_blocks(spark, x, size))
        assert sorted((r.start, r.end, r.length) for r in blocks.flat_tops_of_marks(marks).collect()) == tops
        assert sorted((r.frame, round(r.delta, 9)) for r in blocks.discontinuities_of_marks(marks).collect()) == jumps
        assert sum(r.length for r in blocks.runs_of_marks(marks).where("kind = 'invalid'").collect()) == np.isnan(x).sum()


def test_steps_of_paired_blocks_equal_those_of_frames(spark):
    rng = np.random.default_rng(9)
    x, y = rng.standard_normal((2, 2400)) * 0.2
    y += x
    x[[5, 700]] = np.nan
    y[6] = np.inf
    expect = {r.step: r for r in stats.step_table(frames(spark, x, y), 480).collect()}
    for size in (100, 480, 2400):
        cut = blocks.pair_channels(as_blocks(spark, x, size).unionByName(as_blocks(spark, y, size, 1)))
        got = blocks.stereo_steps(blocks.with_halo(cut, 480, size), RATE, 480).collect()
        assert len(got) == len(expect) == 5
        for r in got:
            for c in ("frames", "raw_energy", "peak", "rms_left", "rms_right", "correlation", "balance_db", "mid_side_db"):
                assert r[c] == pytest.approx(expect[r.step][c], rel=1e-9), c
    one = blocks.stereo_steps(blocks.with_halo(blocks.pair_channels(as_blocks(spark, y, 480)), 480, 480), RATE, 480).first()
    assert one.correlation is None and one.rms_right is None and one.mid_side_db is None and one.energy > 0


def test_gated_prefix_means():
    """As taking each prefix for itself, ties included; a day of steps takes seconds."""
    import time

    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 64, 1000):
        values = np.round(10 ** rng.uniform(-9, -1, n), 4 if n % 2 else 12)
        ends = np.unique(rng.integers(0, max(1, n), 40)) if n else np.empty(0, int)
        got = kernels.gated_prefix_means(values, ends, 1e-7, 0.1)
        for end, mean in zip(ends, got, strict=True):
            some = values[: end + 1][values[: end + 1] > 1e-7]
            kept = some[some > some.mean() * 0.1] if len(some) else some
            assert mean == pytest.approx(kept.mean(), rel=1e-12) if len(kept) else np.isnan(mean)
    began = time.perf_counter()
    day = kernels.gated_prefix_means(10 ** rng.uniform(-9, -1, 864_000), np.arange(9, 864_000, 10), 1e-7, 0.1)
    assert time.perf_counter() - began < 20 and np.isfinite(day).all()


def test_one_pole_and_low_frequency():
    rng = np.random.default_rng(4)
    rows, y = rng.standard_normal((5, 1000)), np.zeros(5)
    alpha, out = 1 - np.exp(-2 * np.pi * 120 / 4000), np.empty((5, 1000))
    for i in range(1000):
        y = y + alpha * (rows[:, i] - y)
        out[:, i] = y
    assert np.allclose(kernels.one_pole(rows, 120, 4000), out, atol=1e-12)
    found = kernels.low_frequency(np.vstack([rows[0], np.zeros(1000)]), np.vstack([rows[0], rows[1]]), 4000)
    assert found["low_correlation"][0] == pytest.approx(1) and np.isnan(found["low_correlation"][1]) and found["low_pct"][0] == pytest.approx(100 * (out[0] ** 2).sum() / (rows[0] ** 2).sum())
    assert np.isnan(kernels.low_frequency(rows[:1], None, 4000)["low_correlation"]).all() and np.isnan(kernels.low_frequency(np.zeros((1, 9)), None, 4000)["low_pct"]).all()


def test_mono_and_stereo_windows(spark):
    rng = np.random.default_rng(5)
    rows = [(r, 0, i, float(v), float(-v) if r == 1 else None) for r in (1, 2) for i, v in enumerate(rng.standard_normal(300))]
    got = {r.recording: r for r in spectral.low_frequency_metrics(spark.createDataFrame(rows, "recording long, window_start long, i long, left double, right double"), 4000.0).collect()}
    assert got[1].low_correlation == pytest.approx(-1) and got[2].low_correlation is None and 0 < got[2].low_pct < 100


@pytest.mark.parametrize("bits,encoding", [(16, "pcm"), (24, "pcm"), (32, "pcm"), (32, "float")])
def test_payloads_decode_to_what_went_in(spark, bits, encoding):
    rng = np.random.default_rng(bits)
    x = rng.uniform(-1.2, 1.2, (2, 1000))
    x[0, 3], x[1, 7] = np.nan, np.inf
    rows = [(1, k, a, [x[0, a : a + 300].tolist(), x[1, a : a + 300].tolist()]) for k, a in enumerate(range(0, 1000, 300))]
    paired = spark.createDataFrame(rows, "recording long, block_no long, start_frame long, samples array<array<double>>")
    for dithered in (False, True):
        found = edits.encode_payload(paired, bits, encoding, dithered)
        whole = b"".join(bytes(r.payload) for r in found.orderBy("block_no").collect())
        back = wav.decode(whole, encoding, bits, bits, 2)
        clean = np.where(np.isfinite(x), x, 0.0)
        if encoding == "float":
            assert (back == clean.astype(np.float32)).all()
            continue
        frame = spark.createDataFrame([(2 * i + c, float(v)) for c in (0, 1) for i, v in enumerate(x[c])], "i long, v double")
        noise = edits.tpdf_noise(F.col("i")) if dithered else F.lit(0.0)
        expect = [r.q for r in frame.withColumn("q", edits.quantised(F.col("v"), noise, bits)).orderBy("i").collect()]
        assert (back.T.ravel() * 2.0 ** (bits - 1)).astype(np.int64).tolist() == expect
    other = edits.encode_payload(paired.withColumn("samples", F.transform("samples", lambda c: F.reverse(c))), bits, encoding)
    hashes = edits.identical_payloads(edits.encode_payload(paired, bits, encoding), other).first()
    row = spark.range(1).select(F.lit(True).alias("structure_equal"), F.lit(-1.0).alias("ceiling"), F.lit(True).alias("enforce"), F.lit(-1.0 + 5e-10).alias("peak_db"), F.lit(0).alias("not_finite"), F.lit(True).alias("bit_exact"), F.lit(hashes.source_hash).alias("source_hash"), F.lit(hashes.output_hash).alias("output_hash"))
    assert rules.verify_output(row).first().verified == "SAMPLE_PAYLOAD_IDENTITY_FAILED"  # the peak is within the slack
    assert rules.verify_output(row.withColumn("output_hash", F.col("source_hash"))).first().verified == "ok"


def test_exact_percentiles(spark, monkeypatch):
    """Against numpy, with ties, one value, far magnitudes and tiny bins, so that histograms are refined several times."""
    rng = np.random.default_rng(7)
    groups = {"spread": rng.standard_normal(3000), "ties": rng.integers(0, 3, 2000).astype(float), "one": np.array([4.5]), "same": np.full(500, -2.0), "far": np.concatenate([10.0 ** rng.uniform(-300, 300, 1500), -(10.0 ** rng.uniform(-300, 300, 999)), [1.7e308, -1.7e308, 0.0, 5e-324]]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("spread", None), ("spread", float("nan")), ("none", None), (None, 3.0)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for bins, few in ((stats.BINS, stats.SORTED), (8, 20)):
        monkeypatch.setattr(stats, "BINS", bins)
        monkeypatch.setattr(stats, "SORTED", few)
        got = {r.g: r for r in stats.exact_percentiles(frame, ["g"], "v", {"low": 0.1, "median": 0.5, "top": 0.95}).collect()}
        assert set(got) == {*groups, None} and got[None].median == 3
        for g, x in groups.items():
            expect = np.quantile(x, [0.1, 0.5, 0.95])
            assert [got[g].low, got[g].median, got[g].top] == pytest.approx(expect.tolist(), rel=1e-12)


def test_rules(spark):
    assert spark.range(1).select(rules.slug(F.lit("  Ång & Ö-vik! ")).alias("s")).first().s == "ang-o-vik"
    row = spark.range(1).select(rules.series_proposal(F.lit(0.0), F.lit(-25.0), F.lit(-4.0)).alias("p"), rules.rumble_class(rules.rumble_score(F.lit(60), F.lit(5), F.lit(10), F.lit(0.9))).alias("c")).first()
    assert row.p == 2.0 and row.c == "elevated"
