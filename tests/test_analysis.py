"""The whole analysis over synthesised files: levels, loudness, regions, findings and markers of known sounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearchive.operators import analysis
from tonearchive.sources import wav

RATE = 48_000


def tone(seconds, rate=RATE, hertz=1000, level=0.5):
    return level * np.sin(2 * np.pi * hertz * np.arange(int(seconds * rate)) / rate)


def silence(seconds, rate=RATE):
    return np.zeros(int(seconds * rate))


def sounds():
    x, y = tone(4), tone(4.0, 96_000, 440, 0.7)
    dirty = np.array([[0, 0], [1.2, -1.1], [np.nan, 0.2], [np.inf, 0.3]])
    plateau = np.concatenate([tone(0.2), np.full(40, 0.9995), tone(0.2), silence(0.3), tone(0.2), np.array([0.9, -0.9])])
    low = np.concatenate([tone(2), tone(3, level=2e-5), tone(2)])
    impulse = np.where(np.arange(1000) == 400, 0.9, 0.0)
    pattern = np.tile([0.99, 0.99, -0.99, -0.99], 250)
    late = lambda lead: np.concatenate([silence(lead), tone(3)])
    return {
        "sine": (np.stack([x, x], 1), RATE, 16, "pcm"), "mono24": (np.array([[-0.75], [0.5], [0], [0.25]]), RATE, 24, "pcm"), "offset": (np.stack([0.2 + y, -0.1 + y / 2], 1), 96_000, 32, "float"), "opposed": (np.stack([x, -x], 1), RATE, 16, "pcm"),
        "dirty": (dirty, RATE, 32, "float"), "plateau": (np.stack([plateau, plateau], 1), RATE, 32, "float"), "low": (np.stack([low, low], 1), RATE, 32, "float"), "impulse": (impulse[:, None], RATE, 32, "float"), "pattern": (pattern[:, None], RATE, 32, "float"),
        "early": (late(0.0)[:, None], RATE, 16, "pcm"), "late": (late(0.15)[:, None], RATE, 16, "pcm"), "full": (tone(4, hertz=997, level=1.0)[:, None], RATE, 32, "float"), "over": (np.repeat(1.5 * (np.arange(480_0) % 48 == 0).astype(float)[:, None], 1, 1), RATE, 32, "float"),
    }


@pytest.fixture(scope="module", params=[0.05, 1.0])
def found(request, spark):
    rows = [(name, wav.wav_bytes(x, rate, bits, kind)) for name, (x, rate, bits, kind) in sounds().items()]
    rows.append(("cut", rows[0][1][:-1000]))
    files = spark.createDataFrame(rows, "path string, content binary")
    paired = wav.wav_blocks(files, request.param, 0.25, paired=True).withColumnRenamed("path", "recording")
    got = analysis.analyze(paired, wav.wav_inventory(files).withColumnRenamed("path", "recording"))
    return {
        "summary": {r.recording: r for r in got.summary.collect()}, "channels": {(r.recording, r.channel): r for r in got.channels.collect()}, "steps": got.steps.orderBy("recording", "step").collect(), "regions": {k: v.collect() for k, v in got.regions.items()},
        "observations": {r.recording: r.o for r in got.observations.groupBy("recording").agg(F.sort_array(F.collect_list("observation")).alias("o")).collect()}, "markers": got.markers.collect(),
    }


def decibels(x):
    return 20 * np.log10(x)


def test_levels(found):
    s, c = found["summary"], found["channels"]
    assert decibels(s["sine"].peak) == pytest.approx(-6.0206, abs=0.02) and decibels(s["sine"].rms) == pytest.approx(-9.0309, abs=0.03)
    assert abs(s["sine"].balance_db) < 1e-3 and s["sine"].correlation > 0.99999 and s["sine"].mid_side_db is None and s["sine"].frames == 4 * RATE and s["sine"].valid_frames == 4 * RATE
    assert (c["mono24", 0].lowest, c["mono24", 0].highest, c["mono24", 0].zeros) == (pytest.approx(-0.75, abs=1e-6), pytest.approx(0.5, abs=1e-6), 1)
    assert c["offset", 0].dc_offset == pytest.approx(0.2, abs=1e-3) and 5.5 < s["offset"].balance_db < 6.5
    assert s["opposed"].correlation < -0.9999 and s["opposed"].mono_delta_db < -40 and s["opposed"].negative_pct > 90
    assert (s["dirty"].overrange, s["dirty"].not_finite, s["dirty"].valid_frames) == (2, 2, 2)
    assert 2.6 < decibels(s["pattern"].true_peak) < 3.2 and c["impulse", 0].true_frame == pytest.approx(400, abs=1)
    assert s["full"].integrated == pytest.approx(-3.01, abs=0.1) and s["full"].plr == pytest.approx(decibels(s["full"].true_peak) - s["full"].integrated)
    for name in ("momentary_max", "short_term_max"):
        assert s["late"][name] == pytest.approx(s["early"][name], abs=0.01)


def test_regions(found):
    r = found["regions"]
    of = lambda kind, name: [x for x in r[kind] if x.recording == name]
    assert [(x.start, x.end) for x in of("overrange", "dirty")] == [(1, 2)] and [(x.channel, x.start, x.end) for x in of("invalid", "dirty")] == [(0, 2, 4)]
    assert [(x.channel, x.length) for x in sorted(of("flat-top", "plateau"), key=lambda x: x.channel)] == [(0, 40), (1, 40)]
    assert {x.frame for x in of("discontinuity", "plateau")} >= {int(0.2 * RATE) + 0} and len(of("digital-zero", "plateau")) == 1 and of("digital-zero", "plateau")[0].length == pytest.approx(0.3 * RATE, abs=2)
    assert [(round(x.start_s, 3), round(x.end_s, 3)) for x in of("low-level", "low")] == [(2.0, 5.0)] and len(of("negative-correlation", "opposed")) == 1
    assert len(of("overrange", "over")) == 100


def test_findings_and_markers(found):
    o, m = found["observations"], found["markers"]
    assert o["cut"] == ["lra-short", "truncated-data"] and o["sine"] == ["lra-short"]
    assert {"non-finite", "overrange", "below-gate"} <= set(o["dirty"]) and {"flat-top", "discontinuity", "digital-zero"} <= set(o["plateau"]) and {"low-level"} <= set(o["low"])
    assert {"overrange", "overrange-region-limit"} <= set(o["over"])
    kinds = lambda name: sorted(x.kind for x in m if x.recording == name)
    assert kinds("sine") == ["momentary-max", "sample-peak", "sample-peak", "short-term-max", "true-peak", "true-peak"]
    assert kinds("over").count("overrange") == 50 and kinds("dirty").count("invalid") == 1
    window = next(x for x in m if x.recording == "sine" and x.kind == "momentary-max")
    assert window.end_s - window.start_s == pytest.approx(0.4)


def test_steps(found):
    rows = [x for x in found["steps"] if x.recording == "sine"]
    assert len(rows) == 40 and [x.momentary is None for x in rows] == [True] * 3 + [False] * 37 and rows[29].short_term is not None and rows[28].short_term is None
    assert all(x.correlation > 0.999 and x.raw_energy == pytest.approx(0.125, rel=1e-3) for x in rows)
