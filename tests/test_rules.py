"""Rules against literal values: what each must say about a few hand-made rows."""

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from tonearchive.operators import documents, edits, markers, rules, stats


def rows(spark, kind, *values):
    return spark.createDataFrame(list(values), kind)


def test_monitor_refuses_without_a_peak(spark):
    kind = "analyzed boolean, trusted boolean, true_peak double, sample_peak double, edit_gain double"
    given = rows(spark, kind, (False, True, -1.0, None, 0.0), (True, False, -1.0, None, 0.0), (True, True, None, None, 0.0), (True, True, None, -1.0, None), (True, True, -12.0, 0.0, 3.0), (True, True, float("nan"), -6.0, 4.0))
    got = [(r.reason, r.ready, r.safety, r.total) for r in rules.safe_level(given).collect()]
    assert got == [("not-analyzed", False, None, 0.0), ("untrusted-analysis", False, None, 0.0), ("missing-peak", False, None, 0.0), ("attenuated", True, -2.0, -2.0), ("safe", True, 0.0, 3.0), ("attenuated", True, -1.0, 3.0)]


def test_gate_order_and_slack(spark):
    kind = "frames long, gain_db double, bit_exact boolean, changed boolean, valid_bits int, bits int, ceiling double, enforce boolean, peak_db double, not_finite long, pcm boolean, maximum double, minimum double"
    base = (10, 0.0, False, True, 16, 16, -2.0, None, -2.0, 0, True, 0.5, -0.5)
    change = lambda **k: tuple(k.get(c.split()[0], v) for c, v in zip(kind.split(", "), base, strict=True))
    given = [change(), change(ceiling=-60.5), change(ceiling=None), change(peak_db=-2 + 5e-10), change(peak_db=-2 + 5e-9), change(peak_db=-1.0, enforce=False), change(maximum=1 - 1.5 / 32768), change(maximum=1 - 2.5 / 32768), change(minimum=-1.0), change(minimum=-1.0, pcm=False), change(frames=0, gain_db=99.0)]
    got = [r.gate for r in rules.export_gate(rows(spark, kind, *given)).collect()]
    assert got == ["ok", "CEILING_RANGE", "CEILING_RANGE", "ok", "TRUE_PEAK_CEILING_EXCEEDED", "ok", "PCM_CLAMPING_RISK", "ok", "PCM_CLAMPING_RISK", "ok", "EMPTY_RANGE"]


def test_publication(spark):
    kind = "duration_s double, note string, verified boolean, critical_unreviewed long, editorial_unreviewed long, full_listen boolean, boundaries boolean, stereo boolean, mono boolean, privacy boolean, archived boolean, title string, episode string, place string"
    good = (1200.0005, None, True, 0, 0, True, True, True, True, True, True, "T", "3", "P")
    bad = (1190.0, " ", None, 0, 1, True, True, False, None, True, True, "T", " ", "P")
    got = rules.publication_status(rows(spark, kind, good, bad, (1190.0, "on purpose", *good[2:]), (None, None, *good[2:]))).collect()
    assert [r.status for r in got] == ["ready", "review-required", "ready", "review-required"]
    assert got[1].incomplete == ["duration", "verified_wav", "markers_reviewed", "stereo", "mono", "metadata"] and got[3].incomplete == ["duration"]


def test_marker_kinds_and_classes(spark):
    texts = ["True Peak NaN", "sample peak", "Ogiltigt värde", "overrange flat", "Flat", "tyst", "Diskontinuitet", "momentary", "SHORT-TERM max", "wind", None]
    got = [r.k for r in rows(spark, "t string", *[(t,) for t in texts]).select(markers.marker_kind(F.col("t")).alias("k")).collect()]
    assert got == ["true-peak", "sample-peak", "invalid-float", "float-overrange", "possible-flat-top", "silence", "possible-discontinuity", "momentary-maximum", "short-term-maximum", "review-point", "review-point"]
    got = rows(spark, "s string", ("info",), ("critical",), ("odd",), (None,)).select(markers.marker_severity(F.col("s")).alias("s")).collect()
    assert [r.s for r in got] == ["information", "critical", "review", "review"]
    kind = "o boolean, h boolean, c string"
    got = rows(spark, kind, (True, None, None), (True, True, None), (None, None, "artistic"), (False, False, "x")).select(markers.marker_class(F.col("o"), F.col("h"), F.col("c")).alias("c")).collect()
    assert [r.c for r in got] == ["objective", "heuristic", "artistic", "heuristic"]


def test_normalized_markers(spark):
    kind = "id string, seconds string, end_seconds string, type string, severity string, review string, objective boolean, suggested boolean, origin string, text string"
    given = rows(spark, kind, ("a", "-2", None, "keep", "Notice", "accepted", None, True, None, None), ("b", "nan", "1", "keep", "info", None, None, None, None, "x"), ("c", "3", "x", "odd", "ERROR!", "odd", False, None, "me", "x"))
    got = [tuple(r) for r in markers.normalize_markers(given).collect()]
    assert got == [("a", 0.0, 0.0, "keep", "review", "accepted", True, True, "analysis", "Marker"), ("c", 3.0, 3.0, "user", "critical", "unreviewed", False, False, "me", "x")]


def test_levels_and_rumble(spark):
    given = rows(spark, "level double, kind string", (-18.0, "soundscape-quiet"), (-17.9, "soundscape-quiet"), (-16.0, "odd"), (-16.0, None), (-10.0, "objective"), (None, "music"), (-24.1, "music"))
    got = [r.c for r in given.select(rules.level_class(F.col("level"), F.col("kind")).alias("c")).collect()]
    assert got == ["reference", "high", "reference", "reference", None, None, "very-low"]
    given = rows(spark, "a double, b double, c double, d double", (60.0, 5.0, 10.0, None), (60.0, 5.0, 10.0, 0.1), (60.0, None, 10.0, 0.1), (10.0, 1.0, 50.0, 0.9))
    got = given.select(rules.rumble_score(*[F.col(x) for x in "abcd"]).alias("s")).select("s", rules.rumble_class(F.col("s")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(4, "elevated"), (5, "elevated"), (None, "unknown"), (-1, "low")]


def test_protective_region_and_knots(spark):
    kind = "recording long, start_s double, end_s double, peak_db double, sample_rate int, frames long"
    got = edits.peak_regions(rows(spark, kind, (1, 5.0, 5.0, 0.43, 1000, 10_000), (2, 0.01, 0.02, -3.0, 1000, 10_000), (3, 9.9, 9.999, 90.0, 1000, 10_000))).orderBy("recording").collect()
    assert [(r.start_frame, r.attack_end, r.release_start, r.end_frame, r.gain_db) for r in got] == [(4750, 4950, 5050, 5251, -2.8), (0, 0, 69, 270, -0.1), (9650, 9850, 9999, 10_000, -60.0)]
    knots = edits.gain_breakpoints(rows(spark, "recording long, start_frame long, attack_end long, release_start long, end_frame long", (1, 0, 5, 9, 10))).collect()
    assert sorted(r.frame for r in knots) == [0, 5, 9, 10]


def test_edges_of_long_files(spark):
    blob = bytes(i * 7 % 251 for i in range(300_000))
    got = spark.createDataFrame([(blob,), (blob[:100_000],), (blob[:9],)], "c binary").select(documents.edge_fingerprint(F.col("c"), 1).alias("f")).collect()

    def expect(x, edge=65536):
        head, tail = min(len(x), edge), max(min(len(x), edge), len(x) - edge)
        return hashlib.sha256(f'{{"size":{len(x)},"headLength":{head},"tailStart":{tail}}}'.encode() + x[:head] + x[tail:]).hexdigest()

    assert [r.f for r in got] == [expect(blob), expect(blob[:100_000]), expect(blob[:9])]


def test_canonical_json(spark):
    frame = spark.createDataFrame([(1,)], "k int").select(
        F.struct(F.lit(None).cast("string").alias("z"), F.array(F.lit(1.0), F.lit(0.1), F.lit(-2.5e-7), F.lit(1e21), F.lit(1 / 44100), F.lit(0.0), F.lit(123456789.25)).alias("n"), F.struct(F.lit('é "\\\n').alias("b"), F.lit(True).alias("a")).alias("m")).alias("v")
    )
    text = frame.select(documents.canonical_json(frame, "v").alias("t")).first().t
    assert text == '{"m":{"a":true,"b":"é \\"\\\\\\n"},"n":[1,0.1,-2.5e-7,1e+21,0.000022675736961451248,0,123456789.25],"z":null}'
    assert json.loads(text)["m"]["b"] == 'é "\\\n'


def test_file_names_and_context(spark):
    given = rows(spark, "t string, e string", ("Ön: vid  Kvällen!", "7b"), (None, "1234"), ("***", None))
    got = [r.n for r in given.select(rules.master_file_name(F.col("t"), F.col("e"), F.lit("Take 2.wav")).alias("n")).collect()]
    assert got == ["EP_E007_on-vid-kvallen_MASTER.wav", "EP_E1234_take-2-wav_MASTER.wav", "EP_E000_episode_MASTER.wav"]


def test_report_layouts(spark):
    file = {"summary": {"lufsI": -20.0, "monoCompatibility": {"energyDeltaDb": 1.5}}, "duration": 9.0}
    reports = [{"sections": {"verifiedExportFile": {"analysis": file}}}, {"sections": {"verifiedExportFile": file}}, {"sections": {"verifiedExportFile": {"status": 1}}, "verifiedOutput": file}, {"exportReport": {"verifiedOutput": {"format": {"durationSeconds": 9.0}}}, "summary": file["summary"]}]
    got = stats.report_values(rows(spark, "report string", *[(json.dumps(r),) for r in reports], ("broken",))).collect()
    assert [(r.loudness, r.duration, r.mono_delta) for r in got] == [(-20.0, 9.0, 1.5)] * 4 + [(None, None, None)]


@pytest.mark.parametrize("secret", ["waveform", "sourceHash", "PCM"])
def test_forbidden_keys_at_any_depth(spark, secret):
    from tonearchive.plans.rule_queries import _BUNDLE

    text = _BUNDLE.replace('"identity": null', json.dumps({"identity": {"title": {secret: 1}}})[1:-1])
    assert "forbidden" in documents.validate_bundles(rows(spark, "json string", (text,))).first().errors
    assert documents.validate_bundles(rows(spark, "json string", (_BUNDLE,)), digest=False).first().errors == []


def test_a_built_bundle_is_sound_and_its_digest_is_that_of_its_canonical_json(spark):
    """Every part present: the document parses to the expected names, its digest is recomputed here, and each change to it is found."""
    from tonearchive.operators import stats

    one = lambda schema, *values: rows(spark, schema, *values)
    recordings = one(
        "recording long, bundle_id string, created_at string, profile string, privacy string, stage string, start_frame long, end_frame long, gain_db double, encoding string, channels int, sample_rate int, bits int, size long, loudness double, peak_db double, correlation double",
        (1, "0a1b2c3d-0000-4000-8000-000000000001", "2026-01-01T00:00:00Z", "temporal-diagnostic", "redacted", "source", 48_000, 48_000 * 11, -1.5, "PCM", 2, 48_000, 24, 3_000_044, -19.25, float("-inf"), 1e-9),
        (2, "0a1b2c3d-0000-4000-8000-000000000002", "2026-01-01T00:00:00Z", "minimal", "exact", "source", 0, 480_000, None, None, 1, 44_100, 16, None, None, None, None),
    )
    recordings = recordings.withColumn("editorial", F.when(F.col("recording") == 1, rules.editorial_context("series", F.lit(float("nan")))))
    recordings = documents.select_metadata(recordings.withColumns({"title": F.lit('Ö "x" \\  '), "latitude": F.lit(59.123456), "longitude": F.lit(18.0)}), ("identity", "location"), file_name=True)
    found = one("recording long, nth int, id string, kind string, class string, severity string, start_s double, end_s double, review string, precision_s double", (1, 1, "b", "silence", "objective", "critical", 1.25, 2.5, None, None), (1, 2, "a", "review-point", "heuristic", "review", 0.0, 10.0, "accepted", 1.0))
    segments = one("recording long, segment long, start_s double, end_s double, m_p10 double, silence_pct double, correlation_median double, correlation_min double", (1, 0, 0.0, 5.0, -30.5, 0.0, 0.5, -1.0), (1, 1, 5.0, 10.0, None, None, None, None))
    channels = stats.channel_stats(one("recording long, channel int, frame long, value double", *[(r, c, k, 0.1 * k - 1) for r in (1, 2) for c in range(3 - r) for k in range(30)]))
    cues = one("recording long, nth int, type string, cue_start double, cue_end double, text string, review string", (1, 1, "chapter", 0.5, 3.0, "c" * 600, None))
    built = {r.recording: r for r in documents.validate_bundles(documents.build_bundles(recordings, found, segments, channels, cues)).collect()}
    assert built[1].errors == [] and built[2].errors == []
    for r in built.values():
        document = json.loads(r.json)
        assert document.pop("analysisDigest") == r.digest == hashlib.sha256(r.json.replace(f'"analysisDigest":"{r.digest}",', "").encode()).hexdigest()
        assert set(document["analysis"]) == set(documents.BUNDLE_KEYS["$.analysis"].split()) and list(document) == sorted(document)
    a = json.loads(built[1].json)["analysis"]
    assert [m["id"] for m in a["markers"]] == ["b", "a"] and a["markers"][0]["reviewStatus"] == "unreviewed" and a["format"]["durationSeconds"] == 10 and a["region"]["selectedFrames"] == 480_000
    assert a["measurements"]["samplePeakDbfs"] is None and a["measurements"]["stereoCorrelation"] == 1e-9 and [c["channel"] for c in a["measurements"]["channels"]] == [1, 2] and a["measurements"]["channels"][0]["overrangeSamples"] == 9
    assert a["metadata"]["identity"]["title"].startswith("Ö") and a["metadata"]["location"]["coordinates"] == {"latitude": 59.12, "longitude": 18, "precision": "redacted"} and a["metadata"]["notes"] is None
    assert len(a["temporalDiagnostic"]) == 2 and a["temporalDiagnostic"][1]["stereoCorrelation"] is None and len(a["editorialCueSheet"][0]["text"]) == 500 and a["editorialContext"]["targetDurationSeconds"] == 1200 and len(a["editorialContext"]["questions"]) == 3
    assert json.loads(built[2].json)["analysis"]["temporalDiagnostic"] is None
    broken = [built[1].json.replace('"globalGainDb":-1.5', '"globalGainDb":-2.5'), json.dumps(json.loads(built[1].json.replace("1e-9", "0.5").replace(built[1].digest, "0" * 64)), indent=1), built[2].json.replace(":", ": ").replace("T00: 00: 00Z", "T00:00:00Z")]
    got = documents.validate_bundles(rows(spark, "n int, json string", *enumerate(broken))).orderBy("n").collect()
    assert [r.errors for r in got] == [["digest-differs"], ["digest-differs"], []]


def test_audit_chain_of_many_entries(spark):
    """A hundred thousand entries of one log: folded as they stream by, and equal to a plain chain; each kind of fault is found."""
    n = 100_000
    events = spark.range(n).select(F.lit("a").alias("log"), (F.col("id") + 1).alias("sequence"), F.lit("2026-01-01T00:00:00Z").alias("timestamp"), F.lit("accept").alias("action"), F.lit("0a1b2c3d-0000-4000-8000-000000000001").alias("bundleId"), F.sha2(F.col("id").cast("string"), 256).alias("analysisDigest"))
    events = events.withColumn("after", F.when(F.col("sequence") % 2 == 0, F.struct((-F.col("sequence") / 4).alias("globalGainDb"), *[F.lit(None).cast("double").alias(k) for k in ("trimStartFrame", "trimEndFrame", "fadeInFrames", "fadeOutFrames")])))
    built = documents.build_audit(events.repartition(9))
    last = None
    for k, r in enumerate(built.orderBy("sequence").select("previousDigest", "entryDigest").collect(), 1):
        gain = -k / 4
        entry = {"sequence": k, "timestamp": "2026-01-01T00:00:00Z", "action": "accept", "bundleId": "0a1b2c3d-0000-4000-8000-000000000001", "analysisDigest": hashlib.sha256(str(k - 1).encode()).hexdigest(), "suggestionId": None, "before": None, "after": {"globalGainDb": int(gain) if gain == int(gain) else gain} if k % 2 == 0 else None, "previousDigest": last}
        assert r.previousDigest == last
        last = hashlib.sha256(json.dumps(entry, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert r.entryDigest == last
    assert documents.validate_audit(built).where("size(errors) > 0").count() == 0
    some = built.where("sequence <= 8")
    n = F.col("sequence")
    bad = some.withColumns({"action": F.when(n == 2, "open").otherwise(F.col("action")), "previousDigest": F.when(n == 3, "x").otherwise(F.col("previousDigest")), "after": F.when(n == 4, F.lit(None)).otherwise(F.col("after"))}).where("sequence <> 6")
    got = {r.sequence: r.errors for r in documents.validate_audit(bad).collect()}
    assert got == {1: [], 2: ["action", "digest"], 3: ["link", "digest"], 4: ["digest"], 5: [], 7: ["sequence", "link"], 8: ["sequence"]}


def test_a_bundle_of_many_segments_is_validated_in_one_reading(spark):
    # every segment is held against the first one: the list must not be read again for each
    from tonearchive.plans.rule_queries import _BUNDLE, _segment

    series = json.dumps([_segment(5 * k, 20) for k in range(documents.MOST_SEGMENTS)])
    text = _BUNDLE.replace('"temporalDiagnostic": null', f'"temporalDiagnostic": {series}').replace('"minimal"', '"temporal-diagnostic"').replace('"durationSeconds": 10.0', '"durationSeconds": 3600.0')
    given = rows(spark, "n int, json string", *[(n, text) for n in range(160)])
    documents.validate_bundles(given.limit(1), digest=False).collect()
    began = time.monotonic()
    assert [r.errors for r in documents.validate_bundles(given, digest=False).collect()] == [[]] * 160
    assert time.monotonic() - began < 25
