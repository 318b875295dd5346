"""Reports, bundles, guidance, receipts and audit logs as tables and JSON."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StringType, StructType

from ..functions.audio import all_that_hold, finite


def _number_text(x: Column) -> Column:
    """A double as JSON writes it: whole numbers without a point, the fewest digits, exponents beyond 1e-6 and 1e17.

    From 1e-3 to 1e7 that is how Spark writes it, but for the point of whole numbers; decimals and patterns are left to the others.
    """
    size = F.abs(x)
    usual = F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    digits = F.when(F.abs(x) < 1, x.cast("decimal(38,30)").cast("string")).otherwise(x.cast("decimal(38,18)").cast("string"))
    plain = F.regexp_replace(F.regexp_replace(digits, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    power = F.regexp_replace(F.regexp_replace(x.cast("string"), "(\\.0)?E(-?)", "e$2"), "e([0-9])", "e+$1")
    return F.when(x == 0, "0").when((size >= 1e-3) & (size < 1e7), usual).when((size >= 1e-6) & (size < 1e17), plain).otherwise(power)


#: A text that JSON writes as it is: ASCII without control characters, quotes and backslashes.
_PLAIN_TEXT = r"^[ !#-\[\]-~]*\z"


def _json_text(x: Column, kind: DataType, ready: dict[str, Column] | None = None, path: str = "") -> Column:
    """``ready``: texts of fields by path that are written already."""
    ready = ready or {}
    if path in ready:
        return ready[path]
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(F.lit(f'"{f.name}":'), _json_text(x[f.name], f.dataType, ready, f"{path}.{f.name}")) for f in fields]
        text = F.when(x.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: _json_text(e, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, DoubleType | FloatType):
        text = _number_text(x.cast("double"))
    elif isinstance(kind, StringType):
        quoted = F.to_json(F.array(x))
        text = F.when(x.rlike(_PLAIN_TEXT), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.substring(quoted, 2, F.length(quoted) - 2))
    else:
        text = x.cast("string")
    return F.coalesce(text, F.lit("null"))


def canonical_json(rows: DataFrame, column: str) -> Column:
    """The column as JSON with keys in order at every depth and nulls kept, so that equal values give equal texts."""
    return _json_text(F.col(column), rows.schema[column].dataType)


def canonical_digest(rows: DataFrame, column: str) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(rows, column), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


#: Bytes of an edge: the least, the greatest, and the default (fixed values).
LEAST_EDGE, MOST_EDGE, EDGE = 64 << 10, 4 << 20, 1 << 20


def edge_fingerprint(content: Column, edge: int = EDGE) -> Column:
    """SHA-256 of a descriptor (size, end of the first edge, start of the last), the first edge, and what of the last edge lies beyond it."""
    edge = max(LEAST_EDGE, min(MOST_EDGE, edge))
    size = F.octet_length(content).cast("long")
    head = F.least(size, F.lit(edge))
    tail = F.greatest(head, size - edge)
    descriptor = F.concat(F.lit('{"size":'), size.cast("string"), F.lit(',"headLength":'), head.cast("string"), F.lit(',"tailStart":'), tail.cast("string"), F.lit("}"))
    return F.sha2(F.concat(descriptor.cast("binary"), F.substring(content, F.lit(1), head.cast("int")), F.substring(content, (tail + 1).cast("int"), F.lit(edge))), 256)


def duplicate_recordings(files: DataFrame) -> DataFrame:
    """Groups of files with the same content: hash, size, how many, and the least recording; grouped by hash before anything meets."""
    hashed = files.select("recording", "size", content_hash(F.col("content")).alias("hash"))
    return hashed.groupBy("hash", "size").agg(F.count("*").alias("copies"), F.min("recording").alias("first")).where("copies > 1")


def match_sources(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Outcome per project (recording, size, hash): missing, size-differs, reanalysis-required (an old project without a full hash), content-differs or match."""
    joined = projects.join(files.select("recording", F.col("size").alias("file_size"), F.col("hash").alias("file_hash")), "recording", "left")
    outcome = F.when(F.col("file_size").isNull(), "missing").when(F.col("file_size") != F.col("size"), "size-differs").when(F.col("hash").isNull(), "reanalysis-required")
    return joined.withColumn("outcome", outcome.when(F.col("file_hash") != F.col("hash"), "content-differs").otherwise("match"))


def bind_guidance(guidance: DataFrame, receipts: DataFrame, current: DataFrame) -> DataFrame:
    """Status of each guidance (bundle, digest): unbound, source-unverified, source-mismatch, analysis-unverified or bound-current.

    receipts: bundle, digest, recording, source_hash; current: recording, hash_now, digest_now.
    """
    joined = guidance.join(receipts, ["bundle", "digest"], "left").join(current, "recording", "left")
    status = (
        F.when(F.col("recording").isNull(), "unbound").when(F.col("hash_now").isNull(), "source-unverified").when(F.col("hash_now") != F.col("source_hash"), "source-mismatch")
        .when(F.col("digest_now").isNull() | (F.col("digest_now") != F.col("digest")), "analysis-unverified").otherwise("bound-current")
    )
    return joined.withColumn("status", status)


def evidence(suggestions: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, unknown) references of suggestions (suggestion, bundle, refs) against receipts (bundle, ref)."""
    each = suggestions.select("suggestion", "bundle", F.explode("refs").alias("ref"))
    return each.join(receipts, ["bundle", "ref"], "left_semi"), each.join(receipts, ["bundle", "ref"], "left_anti")


def accept_suggestions(bound: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edits from accepted global-gain suggestions that are bound to the current analysis; other kinds only inform."""
    accepted = decisions.where(F.col("decision") == "accepted").select("suggestion")
    return bound.where((F.col("status") == "bound-current") & (F.col("kind") == "global-gain")).join(accepted, "suggestion").select("suggestion", "recording", F.col("value").alias("gain_db"))


def select_stage(measurements: DataFrame, wanted: tuple[str, ...] = ("verified", "calculated", "source")) -> DataFrame:
    """Per recording the value of the first stage that has one, and which it was."""
    stages = [F.max(F.when(F.col("stage") == s, F.col("value"))) for s in wanted]
    out = measurements.groupBy("recording").agg(*[x.alias(f"v{i}") for i, x in enumerate(stages)])
    chosen = F
    for i, s in enumerate(wanted):
        chosen = chosen.when(F.col(f"v{i}").isNotNull(), s)
    return out.select("recording", F.coalesce(*[F.col(f"v{i}") for i in range(len(wanted))]).alias("value"), chosen.otherwise(None).alias("stage"))


def compare_stages(source: DataFrame, processed: DataFrame, metrics: list[str]) -> DataFrame:
    """Change of every metric from source to processed, per recording."""
    a, b = source.alias("a"), processed.alias("b")
    return a.join(b, F.col("a.recording") == F.col("b.recording")).select("a.recording", *[(F.col(f"b.{m}") - F.col(f"a.{m}")).alias(f"{m}_delta") for m in metrics])


def measurement_status(measurements: DataFrame, edits: DataFrame) -> DataFrame:
    """A measurement older than its recording's last edit is stale."""
    last = edits.groupBy("recording").agg(F.max("edited").alias("last_edit"))
    return measurements.join(last, "recording", "left").withColumn("status", F.when(F.col("last_edit") > F.col("measured"), "stale").otherwise("current"))


_HASH, _UUID = "^[0-9a-f]{64}$", "^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
#: What an audit entry records of an event, and what it may have been (fixed values).
EVENT = {"timestamp": "string", "action": "string", "bundleId": "string", "analysisDigest": "string", "suggestionId": "string", "before": "", "after": ""}
SNAPSHOT = "struct<globalGainDb:double,trimStartFrame:double,trimEndFrame:double,fadeInFrames:double,fadeOutFrames:double>"
ACTIONS = ("export", "import", "accept", "reject")
LONGEST_ID = 160


def _entries(events: DataFrame) -> DataFrame:
    """Events with all columns of an entry; before and after ``head`` and ``tail`` of its canonical JSON comes the previous digest."""
    wanted = {n: F.col(n) if n in events.columns else F.lit(None) for n in EVENT}
    typed = {n: F.substring(v.cast("string"), 1, LONGEST_ID) if n == "suggestionId" else v.cast(EVENT[n] or SNAPSHOT) for n, v in wanted.items()}
    # a snapshot has the keys that it was given
    rows = events.withColumns(typed).withColumn("sequence", F.col("sequence").cast("long")).withColumn("_entry", F.struct(*EVENT, "sequence"))
    kind, entry = rows.schema["_entry"].dataType, F.col("_entry")
    snapshot = lambda n: F.when(entry[n].isNull(), "null").otherwise(_present(entry[n], kind[n].dataType))
    text = {n: snapshot(n) if n in ("before", "after") else _json_text(entry[n], kind[n].dataType) for n in kind.names}
    members = lambda names: F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), text[n]) for n in sorted(names)])
    first = [n for n in kind.names if n < "previousDigest"]
    head = F.concat(F.lit("{"), members(first), F.lit(',"previousDigest":'))
    tail = F.concat(F.lit(","), members([n for n in kind.names if n not in first]), F.lit("}"))
    return rows.withColumn("head", head).withColumn("tail", tail).drop("_entry")


def _present(x: Column, kind: StructType) -> Column:
    """A struct as a JSON object of the fields that are not null, keys in order."""
    fields = sorted(kind.fields, key=lambda f: f.name)
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.when(x[f.name].isNotNull(), F.concat(F.lit(f'"{f.name}":'), _json_text(x[f.name], f.dataType))) for f in fields]), F.lit("}"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of entries that come sorted by log and sequence, each over its text with the one before."""
    log, last = None, None
    for batch in batches:
        previous, digests = [], []
        for own, head, tail in zip(*(batch.column(c).to_pylist() for c in ("log", "head", "tail")), strict=True):
            last, log = last if own == log else None, own
            previous.append(last)
            last = hashlib.sha256(f"{head}{json.dumps(last)}{tail}".encode()).hexdigest()
            digests.append(last)
        rest = batch.drop_columns(["head", "tail"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(previous, pa.string()), pa.array(digests, pa.string())], [*rest.schema.names, "previousDigest", "entryDigest"])


def build_audit(events: DataFrame) -> DataFrame:
    """Each log's chain of digests: every entry's covers the one before. Rows: log, the entry's columns, previousDigest, entryDigest.

    ``events`` has log, sequence, and of ``EVENT`` what there is (the rest is null); before and after are snapshots of an edit.
    A digest is the SHA-256 of the entry's canonical JSON. Rows are sorted by log and sequence and folded as they stream by, so a
    log of any length takes constant memory and linear time; logs are independent.
    """
    rows = _entries(events).select("log", "sequence", *EVENT, "head", "tail")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("head", "tail"))
    return rows.repartition("log").sortWithinPartitions("log", "sequence").mapInArrow(_chained, f"{kinds}, previousDigest string, entryDigest string")


def validate_audit(audit: DataFrame) -> DataFrame:
    """``errors`` of each entry (as of ``build_audit``): sequence, action, form of ids, snapshots, link to the one before, and digest."""
    order = Window.partitionBy("log").orderBy("sequence")
    rows = _entries(audit)
    text = F.concat("head", F.coalesce(F.concat(F.lit('"'), "previousDigest", F.lit('"')), F.lit("null")), "tail")
    form = lambda c, pattern: ~F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    whole = lambda x: F.coalesce((x >= 0) & (x < 2**53) & (x == F.floor(x)), x.isNull())
    sound = lambda c: F.coalesce(finite(F.col(c)["globalGainDb"]) | F.col(c)["globalGainDb"].isNull(), F.lit(True)) & reduce(and_, [whole(F.col(c)[n]) for n in ("trimStartFrame", "trimEndFrame", "fadeInFrames", "fadeOutFrames")])
    errors = all_that_hold(
        (F.col("sequence") != F.row_number().over(order), "sequence"), (~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "action"), (form("bundleId", f"(?i){_UUID}") | form("analysisDigest", _HASH), "ids"),
        (~F.coalesce(sound("before") & sound("after"), F.lit(True)), "snapshot"), (~F.col("previousDigest").eqNullSafe(F.lag("entryDigest").over(order)), "link"), (~F.col("entryDigest").eqNullSafe(F.sha2(text, 256)), "digest"),
    )
    return rows.withColumn("errors", errors).drop("head", "tail")


def key_violations(documents: DataFrame, allowed: list[str], denied: list[str]) -> DataFrame:
    """Keys of each JSON object that are not allowed, and those that are forbidden."""
    keys = F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>"))
    lists = [F.array(*[F.lit(k) for k in ks]) for ks in (allowed, denied)]
    return documents.withColumn("unknown", F.array_sort(F.array_except(keys, lists[0]))).withColumn("forbidden", F.array_sort(F.array_intersect(keys, lists[1])))


#: Groups of metadata with the greatest length of each text, as documents name them (fixed values).
METADATA = {
    "identity": {"title": 500, "series": 500, "episode": 500, "sessionId": 500, "project": 500, "date": 80, "localTime": 80, "lightConditions": 500},
    "location": {"place": 500},
    "notes": {"tags": 2000, "environment": 2000, "notes": 2000, "relatedImage": 2000},
    "creator": {"creator": 500, "equipment": 2000, "license": 500},
}
FILE_NAME = 255


def _column_of(name: str) -> str:
    """The column that holds a document's field: words apart by underscores."""
    return re.sub("[A-Z]", lambda m: "_" + m[0].lower(), name)


def select_metadata(rows: DataFrame, wanted: tuple[str, ...] = (), file_name: bool = False, exact: bool = False) -> DataFrame:
    """The groups opted in to as structs with the names of documents, the others null; texts cut to their field's length (a privacy limit).

    The location also gets coordinates (latitude, longitude) if both are in range, to two decimals unless ``exact``.
    Columns are named as the fields, words apart by underscores (session_id); those that are not there count as null.
    """
    has = lambda n, kind: F.col(n).cast(kind) if n in rows.columns else F.lit(None).cast(kind)
    place = [F.when(finite(has(n, "double")) & (F.abs(has(n, "double")) <= most), has(n, "double")) for n, most in (("latitude", 90), ("longitude", 180))]
    shown = [p if exact else F.round(p, 2) for p in place]
    point = F.when(place[0].isNotNull() & place[1].isNotNull(), F.struct(shown[0].alias("latitude"), shown[1].alias("longitude"), F.lit("exact" if exact else "redacted").alias("precision")))
    out = {"sourceFileName": F.substring(has("source_file_name", "string"), 1, FILE_NAME) if file_name else F.lit(None).cast("string")}
    for name, fields in METADATA.items():
        group = F.struct(*[F.substring(has(_column_of(n), "string"), 1, longest).alias(n) for n, longest in fields.items()], *[point.alias("coordinates")] * (name == "location"))
        out[name] = F.when(F.lit(name in wanted), group)
    return rows.withColumn("metadata", F.struct(*[v.alias(k) for k, v in out.items()]))


def migrate_projects(projects: DataFrame) -> DataFrame:
    """Schema 1 rows take schema 2's form; rows of another schema get ``error``.

    Columns: schema, strategy and fingerprint (of the source, as stored), gain_db, ceiling, app_version. Only a full hash
    (64 hexadecimal digits) of the whole source is an identity; a fingerprint of edges is kept as a first check. Old
    projects without an identity must be analysed again. A missing ceiling is the series'.
    """
    c = F.col
    edges = F.coalesce(c("strategy") == "descriptor+first+last", F.lit(False))
    identity = F.when(~edges & c("fingerprint").rlike("^[0-9a-f]{64}$"), c("fingerprint"))
    old = c("schema") == 1
    return projects.withColumns({
        "identity": identity, "preflight": F.when(old & edges, c("fingerprint")), "identity_required": identity.isNull(), "migrated_from": F.when(old, F.coalesce("app_version", F.lit("unknown"))), "ceiling": F.coalesce("ceiling", F.lit(-2.0)),
        "error": F.when(~F.coalesce(c("schema").isin(1, 2), F.lit(False)), "schema"), "schema": F.when(old, 2).otherwise(c("schema")),
    })


def build_reports(source: DataFrame, calculated: DataFrame, verified: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per recording with a section per stage; missing stages are null."""
    section = lambda df, name: df.select("recording", F.struct(*metrics).alias(name))
    return section(source, "source").join(section(calculated, "calculated"), "recording", "left").join(section(verified, "verified"), "recording", "left")


SCHEMA = "tonearchive.analysis-exchange/2"
#: Limits of documents that leave the archive (fixed values).
MOST_MARKERS, MOST_SEGMENTS, MOST_CUES, MOST_EVIDENCE, MINIMAL_BYTES, TEMPORAL_BYTES, GUIDANCE_BYTES = 500, 720, 200, 32, 1_000_000, 5_000_000, 1_000_000
#: What the figures rest on: id, class, method.
EVIDENCE = (("loudness", "objective", "itu-r-bs-1770"), ("true-peak", "objective", "ebu-tech-3341"), ("markers", "mixed", "screening"))


#: Figures of a bundle and the columns that hold them; then those of its channels (names are fixed values).
MEASURES = {
    "integratedLufs": "loudness", "loudnessRangeLu": "loudness_range", "momentaryMaxLufs": "momentary_max", "shortTermMaxLufs": "short_term_max", "samplePeakDbfs": "peak_db", "truePeakDbtp": "true_peak_db", "plrLu": "plr", "rmsDbfs": "rms_db", "crestFactorDb": "crest_db", "channelBalanceDb": "balance_db", "stereoCorrelation": "correlation",
}
COUNTS = {"overrangeSamples": "overrange", "nonFiniteSamples": "not_finite"}
CHANNEL_MEASURES = {"samplePeakDbfs": "peak_db", "truePeakDbtp": "true_peak_db", "truePeakTimeSeconds": "true_peak_s", "dcOffset": "dc_offset", "rmsDbfs": "rms_db", "crestFactorDb": "crest_db"}
CHANNEL_COUNTS = {"clippedSamples": "clipped", "overrangeSamples": "overrange", "nonFiniteSamples": "not_finite"}
PROVENANCE = ("engineVersion", "releaseVersion", "releaseCommit", "loudnessModel", "truePeakMethod", "validationLevel")
SUMMARIES = {"objective": "Measured finding", "heuristic": "Point to review"}
METHOD = "screening"


def _part(rows: DataFrame, fields: dict[str, str], kind: str, default: Column | None = None) -> list[Column]:
    """Fields of a struct from columns of ``rows``; a column that is not there, and a number that is not finite, is the default (null)."""
    out = []
    for name, column in fields.items():
        value = F.col(column).cast(kind) if column in rows.columns else F.lit(None).cast(kind)
        value = F.when(finite(value), value) if kind == "double" else value
        out.append((value if default is None else F.coalesce(value, default)).alias(name))
    return out


def _listed(rows: DataFrame, order: str, item: list[Column], name: str) -> DataFrame:
    """One list a recording of the items in order, and its canonical JSON, whose items are written once, as they are gathered."""
    rows = rows.select("recording", F.col(order).alias("order"), F.struct(*item).alias("item"))
    listed = F.array_sort(F.collect_list(F.struct("order", "item", canonical_json(rows, "item").alias("text"))))
    lists = rows.groupBy("recording").agg(listed.alias("listed"))
    text = F.concat(F.lit("["), F.array_join(F.col("listed.text"), ","), F.lit("]"))
    return lists.select("recording", F.col("listed.item").alias(f"{name}_"), text.alias(f"{name}_json_"))


def _channel_rows(channels: DataFrame) -> DataFrame:
    """One list a recording of its channels' figures (recording, channel from 0, and ``CHANNEL_MEASURES`` and counts as far as they are there)."""
    zero = F.lit(0).cast("long")
    fields = [(F.col("channel") + 1).cast("long").alias("channel"), *_part(channels, CHANNEL_MEASURES, "double"), *_part(channels, CHANNEL_COUNTS, "long", zero)]
    return channels.groupBy("recording").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("channels_"))


def _marker_rows(markers: DataFrame) -> DataFrame:
    """The ranked markers (recording, nth, id, kind, class, severity, start_s, end_s, channel, summary, review, precision_s) of each recording in one list, ``MOST_MARKERS`` at most."""
    c = lambda n, kind="string": F.col(n).cast(kind) if n in markers.columns else F.lit(None).cast(kind)
    summary = F.coalesce(c("summary"), F.when(F.col("class") == "objective", SUMMARIES["objective"]).otherwise(SUMMARIES["heuristic"]))
    fields = [
        c("id").alias("id"), c("kind").alias("type"), c("class").alias("classification"), c("severity").alias("severity"), c("start_s", "double").alias("startSeconds"), c("end_s", "double").alias("endSeconds"), c("channel", "long").alias("channel"), summary.alias("summary"),
        F.lit(METHOD).alias("methodId"), F.substring(F.coalesce(c("review"), F.lit("unreviewed")), 1, 80).alias("reviewStatus"), c("precision_s", "double").alias("timePrecisionSeconds"),
    ]
    return _listed(markers.where(F.col("nth") <= MOST_MARKERS), "nth", fields, "markers")


def _segment_rows(segments: DataFrame) -> DataFrame:
    """The segments of ``loudness.temporal_segments`` of each recording in one list, ``MOST_SEGMENTS`` at most."""
    c = lambda n: F.col(n).cast("double") if n in segments.columns else F.lit(None).cast("double")
    r = F.when(c("correlation_median").isNotNull(), F.struct(c("correlation_median").alias("median"), c("correlation_min").alias("min")))
    fields = [
        c("start_s").alias("startSeconds"), c("end_s").alias("endSeconds"), F.struct(c("m_p10").alias("p10"), c("m_median").alias("median"), c("m_max").alias("max")).alias("momentaryLufs"), F.struct(c("s_median").alias("median"), c("s_max").alias("max")).alias("shortTermLufs"),
        c("peak_db").alias("programSamplePeakDbfs"), F.lit(None).cast("double").alias("programTruePeakDbtp"), c("silence_pct").alias("silencePercent"), r.alias("stereoCorrelation"),
    ]
    return _listed(segments.where(F.col("segment") < MOST_SEGMENTS), "segment", fields, "segments")


_CUES = "array<struct<id:string,type:string,startSeconds:double,endSeconds:double,text:string,reviewStatus:string,classification:string>>"


def _cue_rows(cues: DataFrame) -> DataFrame:
    """The cue sheet of ``markers.cue_sheet`` of each recording in one list, ``MOST_CUES`` at most."""
    fields = [
        F.concat(F.lit("cue-"), F.col("nth").cast("string")).alias("id"), F.col("type").cast("string").alias("type"), F.greatest(F.lit(0.0), F.col("cue_start").cast("double")).alias("startSeconds"), F.col("cue_end").cast("double").alias("endSeconds"), F.substring(F.coalesce("text", F.lit("")), 1, 500).alias("text"),
        F.substring(F.coalesce("review", F.lit("unreviewed")), 1, 80).alias("reviewStatus"), F.lit("editorial").alias("classification"),
    ]
    return _listed(cues.where(F.col("nth") <= MOST_CUES), "nth", fields, "cues").withColumn("cues_", F.col("cues_").cast(_CUES))


def build_bundles(recordings: DataFrame, markers: DataFrame, segments: DataFrame, channels: DataFrame, cues: DataFrame | None = None) -> DataFrame:
    """A bundle per recording: ``bundle`` (a struct in the names of documents), its canonical ``json``, and ``digest``, the SHA-256 of that JSON without the digest itself.

    ``recordings``: recording, bundle_id, created_at, profile (minimal or temporal-diagnostic), privacy, stage; start_frame, end_frame, fade_in,
    fade_out, gain_db; encoding, channels, sample_rate, bits, valid_bits, duration_s, size, file_name; the columns of ``MEASURES`` and
    ``COUNTS``; ``mono`` (a struct energyDeltaDb, samplePeakDbfs, negativeCorrelationPercent, riskRegions), ``editorial``, ``metadata`` (of
    ``select_metadata``), ``provenance`` (a struct, texts), loudness_status, peak_status. Missing columns count as null; frames, fades, gain
    and counts as 0. ``markers`` are ranked and sanitized rows, ``segments`` those of ``temporal_segments``, ``channels`` those of
    ``channel_stats``, ``cues`` of ``cue_sheet``: all are bounded per recording (500, 720, 2 and 200) before they are gathered.
    """
    out = recordings
    for rows in (_channel_rows(channels), _marker_rows(markers), _segment_rows(segments), *([_cue_rows(cues)] if cues is not None else [])):
        out = out.join(rows, "recording", "left")
    c = lambda n, kind="string": F.col(n).cast(kind) if n in out.columns else F.lit(None).cast(kind)
    zero, none = F.lit(0).cast("long"), F.lit("unknown")
    whole = lambda n, name: F.greatest(zero, F.coalesce(c(n, "long"), zero)).alias(name)
    as_is = lambda n, kind: F.col(n) if n in out.columns else F.lit(None).cast(kind)
    start, end = (F.greatest(zero, F.coalesce(c(n, "long"), zero)) for n in ("start_frame", "end_frame"))
    region = F.struct(F.lit("[startFrame,endFrame)").alias("range"), start.alias("startFrame"), end.alias("endFrame"), (end - start).alias("selectedFrames"), whole("fade_in", "fadeInFrames"), whole("fade_out", "fadeOutFrames"), F.coalesce(c("gain_db", "double"), F.lit(0.0)).alias("globalGainDb"))
    frames = (end - start) / F.nullif(c("sample_rate", "double"), F.lit(0.0))
    duration = F.when(end > start, F.coalesce(frames, c("duration_s", "double"))).otherwise(F.coalesce(c("duration_s", "double"), F.lit(0.0)))
    format_ = F.struct(
        F.lit("WAVE").alias("container"), F.substring(F.coalesce(c("encoding"), none), 1, 64).alias("encoding"), whole("channels", "channels"), whole("sample_rate", "sampleRate"), whole("bits", "bitsPerSample"), F.coalesce(c("valid_bits", "long"), c("bits", "long"), zero).alias("validBitsPerSample"),
        duration.alias("durationSeconds"), whole("size", "fileSizeBytes"), F.substring(c("file_name"), 1, FILE_NAME).alias("fileName"),
    )
    mono = "struct<energyDeltaDb:double,samplePeakDbfs:double,negativeCorrelationPercent:double,riskRegions:array<struct<startSeconds:double,endSeconds:double>>>"
    measures = F.struct(*_part(out, MEASURES, "double"), as_is("mono", mono).alias("monoCompatibility"), *_part(out, COUNTS, "long", zero), F.slice(F.coalesce("channels_", F.array()), 1, F.greatest(F.lit(0), c("channels", "int"))).alias("channels"))
    told = out.schema["provenance"].dataType.names if "provenance" in out.columns else ()
    provenance = F.struct(*[F.coalesce(F.col(f"provenance.{n}").cast("string") if n in told else F.lit(None).cast("string"), none).alias(n) for n in PROVENANCE])
    status = {"loudness": F.coalesce(c("loudness_status"), F.lit("unverified")), "true-peak": F.coalesce(c("peak_status"), F.lit("unverified")), "markers": F.lit("requires-human-review")}
    evidence_ = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(k).alias("classification"), F.lit(m).alias("methodId"), status[i].alias("status")) for i, k, m in EVIDENCE])
    temporal = F.when(F.col("profile") == "temporal-diagnostic", F.coalesce("segments_", F.array()))
    metadata = F.col("metadata") if "metadata" in out.columns else F.struct(*[F.lit(None).cast("string").alias(n) for n in ("sourceFileName", *METADATA)])
    analysis = F.struct(
        F.col("stage").alias("signalStage"), region.alias("region"), format_.alias("format"), metadata.alias("metadata"), measures.alias("measurements"), F.coalesce("markers_", F.array()).alias("markers"), as_is("editorial", "string").alias("editorialContext"),
        as_is("cues_", _CUES).alias("editorialCueSheet"), temporal.alias("temporalDiagnostic"), provenance.alias("provenance"), evidence_.alias("evidence"),
    )
    outer = [F.lit(SCHEMA).alias("schema"), F.col("bundle_id").alias("bundleId"), F.col("profile"), F.col("privacy"), F.col("created_at").alias("createdAt"), analysis.alias("analysis")]
    ready = {".analysis.markers": F.coalesce("markers_json_", F.lit("[]")), ".analysis.temporalDiagnostic": F.when(F.col("profile") == "temporal-diagnostic", F.coalesce("segments_json_", F.lit("[]"))).otherwise("null")}
    if cues is not None:
        ready[".analysis.editorialCueSheet"] = F.coalesce("cues_json_", F.lit("null"))
    out = out.select("recording", F.struct(*outer).alias("bundle"), *[text.alias(path) for path, text in ready.items()])
    ready = {path: F.col(f"`{path}`") for path in ready}
    # the text is written once: the digest's key follows that of the analysis, which is the first
    fields = sorted(out.schema["bundle"].dataType.fields, key=lambda f: f.name)
    written = [F.concat(F.lit(f'"{f.name}":'), _json_text(F.col("bundle")[f.name], f.dataType, ready, f".{f.name}")) for f in fields]
    head, tail = (F.concat_ws(",", *part) for part in (written[:1], written[1:]))
    out = out.select("recording", "bundle", F.concat(F.lit("{"), head, F.lit(",")).alias("head_"), F.concat(tail, F.lit("}")).alias("tail_"))
    out = out.withColumn("digest", F.sha2(F.concat("head_", "tail_"), 256))
    out = out.withColumn("json", F.concat("head_", F.lit('"analysisDigest":"'), "digest", F.lit('",'), "tail_"))
    bundle = F.struct(*[F.col("bundle")[n].alias(n) for n in ("schema", "bundleId")], F.col("digest").alias("analysisDigest"), *[F.col("bundle")[n].alias(n) for n in ("profile", "privacy", "createdAt", "analysis")])
    return out.withColumn("bundle", bundle).select("recording", "bundle", "digest", "json")


def receipts(bundles: DataFrame, files: DataFrame) -> DataFrame:
    """What stays behind when a bundle leaves: ids, digests of the bundle, its source and its edit, engine and method, ids of evidence and markers; ``error`` without a full hash of the source."""
    a = F.col("bundle.analysis")
    edit = bundles.select("*", F.col("bundle.analysis.region").alias("region"))
    joined = edit.withColumn("edit_digest", canonical_digest(edit, "region")).join(files.select("recording", F.col("hash").alias("source_sha256")), "recording", "left")
    ids = lambda name: F.transform(a[name], lambda x: x["id"])
    return joined.select(
        "recording", F.col("bundle.bundleId").alias("bundle_id"), "digest", "source_sha256", a["provenance"]["engineVersion"].alias("engine"), a["provenance"]["loudnessModel"].alias("method"), "edit_digest", ids("evidence").alias("evidence_ids"), ids("markers").alias("marker_ids"),
        F.col("bundle.createdAt").alias("created_at"), F.when(~F.coalesce(F.col("source_sha256").rlike(_HASH), F.lit(False)), "source-identity").alias("error"),
    )


#: Objects of a bundle by path with their keys: those that must be there, those that may be null, and those in lists (fixed values).
BUNDLE_KEYS = {
    "$": "schema bundleId analysisDigest profile privacy createdAt analysis",
    "$.analysis": "signalStage region format metadata measurements markers editorialContext editorialCueSheet temporalDiagnostic provenance evidence",
    "$.analysis.region": "range startFrame endFrame selectedFrames fadeInFrames fadeOutFrames globalGainDb",
    "$.analysis.format": "container encoding channels sampleRate bitsPerSample validBitsPerSample durationSeconds fileSizeBytes fileName",
    "$.analysis.metadata": "sourceFileName identity location notes creator",
    "$.analysis.measurements": "integratedLufs loudnessRangeLu momentaryMaxLufs shortTermMaxLufs samplePeakDbfs truePeakDbtp plrLu rmsDbfs crestFactorDb channelBalanceDb stereoCorrelation monoCompatibility overrangeSamples nonFiniteSamples channels",
    "$.analysis.provenance": "engineVersion releaseVersion releaseCommit loudnessModel truePeakMethod validationLevel",
}
NULLABLE_KEYS = {
    "$.analysis.metadata.identity": "title series episode sessionId project date localTime lightConditions",
    "$.analysis.metadata.location": "place coordinates",
    "$.analysis.metadata.notes": "tags environment notes relatedImage",
    "$.analysis.metadata.creator": "creator equipment license",
    "$.analysis.editorialContext": "classification seriesProfileId seriesProfileVersion purpose targetDurationSeconds durationToleranceSeconds loudnessOrientation truePeakOrientationDbtp continuityPolicy questions",
    "$.analysis.measurements.monoCompatibility": "energyDeltaDb samplePeakDbfs negativeCorrelationPercent riskRegions",
}
LIST_KEYS = {
    "$.analysis.markers": "id type classification severity startSeconds endSeconds channel summary methodId reviewStatus timePrecisionSeconds",
    "$.analysis.evidence": "id classification methodId status",
    "$.analysis.measurements.channels": "channel samplePeakDbfs truePeakDbtp truePeakTimeSeconds dcOffset rmsDbfs crestFactorDb clippedSamples overrangeSamples nonFiniteSamples",
    "$.analysis.editorialCueSheet": "id type startSeconds endSeconds text reviewStatus classification",
    "$.analysis.measurements.monoCompatibility.riskRegions": "startSeconds endSeconds",
    "$.analysis.temporalDiagnostic": "startSeconds endSeconds momentaryLufs shortTermLufs programSamplePeakDbfs programTruePeakDbtp silencePercent stereoCorrelation",
}
SEGMENT_KEYS = {"momentaryLufs": "p10 median max", "shortTermLufs": "median max", "stereoCorrelation": "median min"}
ORIENTATION_KEYS, COORDINATE_KEYS = "targetLufs rangeMinLufs rangeMaxLufs rationale", "latitude longitude precision"
MOST_RISKS = 100
#: Keys that name sound itself or its owner, which no document may hold at any depth (fixed values).
FORBIDDEN = "samples sampledata waveform spectrum spectrogram fft embedding embeddings fingerprint sourceidentity sourcehash fullfilehash pcm audiobytes channelrmsdbfs"
_MARKERS = "array<struct<id:string,type:string,classification:string,severity:string,startSeconds:double,endSeconds:double,channel:double,summary:string,methodId:string,reviewStatus:string,timePrecisionSeconds:double>>"
_SEGMENTS = "array<struct<startSeconds:double,endSeconds:double,silencePercent:double,stereoCorrelation:struct<median:double,min:double>>>"
_EVIDENCE = "array<struct<id:string,classification:string,methodId:string,status:string>>"
_SPANS = "array<struct<startSeconds:double,endSeconds:double>>"
_COUNTED = "array<struct<channel:double,clippedSamples:double,overrangeSamples:double,nonFiniteSamples:double>>"
_TEXT, _NUMBER, _NULL = "^STRING$", "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "^VOID$"


class _Document:
    """A JSON text parsed once (column ``_parsed``): its parts by path as text, number or list, and the type that JSON gives a part.

    ``kept``: parts by path and kind that rules read more than once or for each item of a list; each is taken out once a text.
    """

    def __init__(self, json: str, *kept: tuple[str, str]):
        self.json, self.whole = F.col(json), F.col("_parsed")
        self.kept = {part: f"_part_{k}" for k, part in enumerate(kept)}

    def parsed(self, rows: DataFrame) -> DataFrame:
        """The rows with the parsed text and the kept parts; a generator keeps Spark from parsing once per rule."""
        parts = lambda v: [F.try_variant_get(v, path, kind).alias(name) for (path, kind), name in self.kept.items()]
        return rows.select("*", F.inline(F.transform(F.array(F.try_parse_json(self.json)), lambda v: F.struct(v.alias("_parsed"), *parts(v)))))

    def written(self) -> Column:
        """The text written out again from the parse."""
        return F.to_json(self.whole)

    def part(self, path: str) -> Column:
        return F.try_variant_get(self.whole, path, "variant")

    def text(self, path: str) -> Column:
        return F.try_variant_get(self.whole, path, "string")

    def number(self, path: str) -> Column:
        return self.rows(path, "double")

    def is_(self, pattern: str, path: str) -> Column:
        """Whether the part's type matches: VOID for null, STRING, OBJECT<..>, ARRAY<..>, or a number's; no type where there is no such part."""
        return F.coalesce(F.schema_of_variant(self.part(path)).rlike(pattern), F.lit(False))

    def is_object(self, path: str) -> Column:
        return self.rows(path, _OBJECT).isNotNull()

    def is_text(self, path: str) -> Column:
        return self.is_(_TEXT, path)

    def is_number(self, path: str) -> Column:
        return self.is_(_NUMBER, path)

    def is_void(self, path: str) -> Column:
        return F.coalesce(F.is_variant_null(self.part(path)), F.lit(False))

    def whole_number(self, path: str, least: int = 0) -> Column:
        return self.is_number(path) & (F.floor(self.number(path)) == self.number(path)) & (self.number(path) >= least) & (self.number(path) < 2**53)

    def rows(self, path: str, kind: str) -> Column:
        return F.col(self.kept[path, kind]) if (path, kind) in self.kept else F.try_variant_get(self.whole, path, kind)

    def items(self, path: str) -> Column:
        return self.rows(path, "array<variant>")

    def unknown(self, path: str, allowed: str) -> Column:
        """Whether the part is no object, or has keys that are not allowed."""
        return _strange(self.rows(path, _OBJECT), allowed)

    def unknown_items(self, path: str, allowed: str) -> Column:
        """Whether an item of the list is no object, or has keys that are not allowed."""
        return F.coalesce(F.exists(self.rows(path, f"array<{_OBJECT}>"), lambda v: _strange(v, allowed)), F.lit(False))

    def odd_item(self, path: str, fields: str, pattern: str) -> Column:
        """Whether an item of the list has one of the fields not of the type."""
        kind = ",".join(f"{n}:variant" for n in fields.split())
        return F.coalesce(F.exists(self.rows(path, f"array<struct<{kind}>>"), lambda v: reduce(or_, [~_typed(v[n], "$", pattern) for n in fields.split()])), F.lit(False))

    def forbidden(self) -> Column:
        """Whether a key at any depth is one of ``FORBIDDEN``, in any case. The text written from the parse has keys without escapes, and quotes within texts escaped, so only a key matches.

        A text without backslashes in which none of them stands as a key is not written for it.
        """
        names = f"(?=[{''.join(sorted({n[0] for n in FORBIDDEN.split()}))}])({FORBIDDEN.replace(' ', '|')})"  # the first letter tells most keys apart
        none = ~F.contains(self.json, F.lit("\\")) & ~F.lower(self.json).rlike(rf'"{names}"\s*:')
        return F.when(none, False).otherwise(F.lower(self.written()).rlike(rf'"{names}":'))


#: An object by its keys alone: values of a kind that none has, so that they are null and not read.
_OBJECT = "map<string,array<array<boolean>>>"


def _strange(v: Column, allowed: str) -> Column:
    """Whether a part read as ``_OBJECT`` is none, or has keys that are not allowed."""
    return v.isNull() | (F.size(F.array_except(F.map_keys(v), F.array(*[F.lit(k) for k in allowed.split()]))) > 0)


def _typed(v: Column, path: str, pattern: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike(pattern), F.lit(False))


def _errors(rows: DataFrame, document: _Document, rules: list[tuple[Column, str]]) -> DataFrame:
    """``errors``: the rules that hold, in order; a text that is no JSON object has ``json`` alone."""
    sound = document.is_object("$")
    found = F.when(~sound, F.array(F.lit("json"))).otherwise(all_that_hold(*[(F.coalesce(rule, F.lit(True)), name) for rule, name in rules]))
    return document.parsed(rows).withColumn("errors", found).select(*rows.columns, "errors")


def _shape(document: _Document, schema: str) -> list[tuple[Column, str]]:
    form = lambda path, pattern: ~F.coalesce(document.text(path).rlike(pattern), F.lit(False))
    return [(document.text("$.schema") != schema, "schema"), (form("$.bundleId", f"(?i){_UUID}"), "bundle-id"), (form("$.analysisDigest", _HASH), "analysis-digest"), (document.text("$.createdAt").try_cast("timestamp").isNull(), "created-at")]


_OR_NULL = lambda pattern: f"{pattern}|{_NULL}"


def _keys_and_types(d: _Document) -> list[tuple[Column, str]]:
    """Rules about the names and types of a bundle's parts."""
    a, any_of = "$.analysis", lambda rules: reduce(or_, rules)
    rules = [(d.unknown(p, keys), f"keys:{p}") for p, keys in BUNDLE_KEYS.items()]
    rules += [(~d.is_void(p) & d.unknown(p, keys), f"keys:{p}") for p, keys in NULLABLE_KEYS.items()]
    rules += [(d.unknown_items(p, keys), f"keys:{p}[]") for p, keys in LIST_KEYS.items()]
    segment = lambda v: any_of([(_strange(F.try_variant_get(v[n], "$", _OBJECT), keys) & (F.lit(n != "stereoCorrelation") | ~_typed(v[n], "$", _NULL))) for n, keys in SEGMENT_KEYS.items()])
    inner = d.rows(f"{a}.temporalDiagnostic", f"array<struct<{','.join(f'{n}:variant' for n in SEGMENT_KEYS)}>>")
    rules.append((F.coalesce(F.exists(inner, segment), F.lit(False)), f"keys:{a}.temporalDiagnostic[][]"))
    groups = [f"{a}.metadata.{g}.{n}" for g, fields in METADATA.items() for n in fields]
    missing = lambda p: d.part(p).isNull() | d.is_(_OR_NULL(_TEXT), p)
    point, where = f"{a}.metadata.location.coordinates", d.number
    no_point = d.part(point).isNull() | d.is_void(point)
    outside = d.unknown(point, COORDINATE_KEYS) | ~d.is_number(f"{point}.latitude") | ~d.is_number(f"{point}.longitude") | (F.abs(where(f"{point}.latitude")) > 90) | (F.abs(where(f"{point}.longitude")) > 180) | ~F.coalesce(d.text(f"{point}.precision").isin("redacted", "exact"), F.lit(False))
    context = f"{a}.editorialContext"
    texts = [f"{context}.{n}" for n in ("classification", "seriesProfileId", "seriesProfileVersion", "purpose", "continuityPolicy", "loudnessOrientation.rationale")]
    numbers = [f"{context}.{n}" for n in ("targetDurationSeconds", "durationToleranceSeconds", "truePeakOrientationDbtp", *[f"loudnessOrientation.{k}" for k in ORIENTATION_KEYS.split()[:3]])]
    questions = d.items(f"{context}.questions")
    odd_context = d.unknown(f"{context}.loudnessOrientation", ORIENTATION_KEYS) | any_of([~d.is_text(p) for p in texts]) | any_of([~d.is_(_OR_NULL(_NUMBER), p) for p in numbers]) | (d.text(f"{context}.classification") != "editorial") | questions.isNull() | F.exists(questions, lambda q: ~_typed(q, "$", _TEXT))
    mono = f"{a}.measurements.monoCompatibility"
    rules += [
        (~d.text("$.profile").isin("minimal", "temporal-diagnostic"), "profile"), (~d.text("$.privacy").isin("redacted", "exact"), "privacy"), (~d.text(f"{a}.signalStage").isin("source", "calculated-export-selection", "verified-output"), "stage"),
        (any_of([~d.is_text(f"{a}.{p}") for p in ("region.range", "format.container", "format.encoding")]), "text"), (any_of([~d.is_text(f"{a}.provenance.{k}") for k in PROVENANCE]), "provenance"),
        (any_of([~d.is_(_OR_NULL(_TEXT), p) for p in (f"{a}.format.fileName", f"{a}.metadata.sourceFileName")]), "file-name"), (any_of([~missing(p) for p in groups]), "metadata"), (~no_point & F.coalesce(outside, F.lit(True)), "coordinates"),
        (any_of([~d.is_(_OR_NULL(_NUMBER), f"{a}.measurements.{k}") for k in MEASURES]), "measurements"), (~d.is_void(context) & F.coalesce(odd_context, F.lit(True)), "editorial"),
        (~d.is_void(mono) & any_of([~d.is_(_OR_NULL(_NUMBER), f"{mono}.{k}") for k in ("energyDeltaDb", "samplePeakDbfs", "negativeCorrelationPercent")]), "mono"),
        (d.odd_item(f"{a}.measurements.channels", " ".join(CHANNEL_MEASURES), _OR_NULL(_NUMBER)), "channel-figures"), (d.odd_item(f"{a}.temporalDiagnostic", "programSamplePeakDbfs programTruePeakDbtp silencePercent", _OR_NULL(_NUMBER)), "segment-figures"),
    ]
    return rules


def _written_digest(document: _Document) -> Column:
    """Whether the digest is that of the document's canonical JSON without the digest itself, as the text is or as it is written out again."""
    own = document.text("$.analysisDigest")
    without = lambda text: F.sha2(F.replace(text, F.concat(F.lit('"analysisDigest":"'), own, F.lit('",')), F.lit("")), 256)
    return F.coalesce((without(document.json) == own) | (without(document.written()) == own), F.lit(False))


def validate_bundles(bundles: DataFrame, json: str = "json", digest: bool = True) -> DataFrame:
    """``errors`` of each bundle's JSON text, by rule: names and types at every depth, forms, ranges, markers, segments, cues, evidence, sizes, and the digest (unless ``digest`` is false).

    The text is parsed once to a variant, and rules read its parts. Numbers with exponents count for the digest only as ``canonical_json`` writes them.
    """
    a = "$.analysis"
    lists = {f"{a}.markers": _MARKERS, f"{a}.temporalDiagnostic": _SEGMENTS, f"{a}.evidence": _EVIDENCE, f"{a}.editorialCueSheet": _CUES, f"{a}.measurements.monoCompatibility.riskRegions": _SPANS, f"{a}.measurements.channels": _COUNTED}
    d = _Document(json, *lists.items(), (f"{a}.format.durationSeconds", "double"), (f"{a}.format.channels", "double"))
    n = d.number
    markers, segments, evidence_ = d.rows(f"{a}.markers", _MARKERS), d.rows(f"{a}.temporalDiagnostic", _SEGMENTS), d.rows(f"{a}.evidence", _EVIDENCE)
    end = n(f"{a}.format.durationSeconds")
    span_bad = lambda m: F.coalesce((m["startSeconds"] < 0) | (m["endSeconds"] < m["startSeconds"]) | (m["endSeconds"] > end), F.lit(True))
    marker_bad = lambda m: span_bad(m) | F.coalesce(
        ~m["classification"].isin("objective", "heuristic", "artistic") | ~m["severity"].isin("critical", "review", "information")
        | m["id"].isNull() | m["type"].isNull() | m["summary"].isNull() | m["methodId"].isNull() | m["reviewStatus"].isNull() | F.coalesce((m["channel"] < 1) | (m["channel"] > n(f"{a}.format.channels")) | (m["channel"] != F.floor(m["channel"])), F.lit(False)) | F.coalesce(m["timePrecisionSeconds"] < 0, F.lit(False)),
        F.lit(True),
    )
    some = lambda rows, bad: F.coalesce(F.exists(rows, bad), F.lit(False))
    width = F.when(F.size(segments) == 1, 5.0).otherwise(F.try_element_at(segments, F.lit(1))["endSeconds"] - F.try_element_at(segments, F.lit(1))["startSeconds"])
    off = lambda v: F.coalesce((v < -1) | (v > 1), F.lit(False))
    segment_bad = lambda s, i: F.coalesce((width < 5) | (width % 5 != 0) | (s["startSeconds"] != i * width) | (s["endSeconds"] <= s["startSeconds"]) | (s["endSeconds"] - s["startSeconds"] > width), F.lit(True)) | F.coalesce(~s["silencePercent"].between(0, 100), F.lit(False)) | off(s["stereoCorrelation"]["median"]) | off(s["stereoCorrelation"]["min"])
    r = f"{a}.region."
    frames_bad = ~(d.whole_number(r + "startFrame") & d.whole_number(r + "endFrame") & d.whole_number(r + "selectedFrames")) | (n(r + "endFrame") < n(r + "startFrame")) | (n(r + "selectedFrames") != n(r + "endFrame") - n(r + "startFrame"))
    fades_bad = ~(d.whole_number(r + "fadeInFrames") & d.whole_number(r + "fadeOutFrames")) | (F.greatest(n(r + "fadeInFrames"), n(r + "fadeOutFrames")) > n(r + "selectedFrames"))
    f = f"{a}.format."
    minimal, temporal = (F.coalesce(d.text("$.profile") == p, F.lit(False)) for p in ("minimal", "temporal-diagnostic"))
    channels = d.rows(f"{a}.measurements.channels", _COUNTED)
    counted = lambda v: F.coalesce((v >= 0) & (v == F.floor(v)) & (v < 2**53), F.lit(False))
    channel_bad = lambda x, i: F.coalesce(x["channel"] != i + 1, F.lit(True)) | ~(counted(x["clippedSamples"]) & counted(x["overrangeSamples"]) & counted(x["nonFiniteSamples"]))
    cues, risks = d.rows(f"{a}.editorialCueSheet", _CUES), d.rows(f"{a}.measurements.monoCompatibility.riskRegions", _SPANS)
    cue_bad = lambda q: span_bad(q) | F.coalesce((q["classification"] != "editorial") | q["id"].isNull() | q["type"].isNull() | q["text"].isNull() | q["reviewStatus"].isNull(), F.lit(True))
    there = lambda p: ~d.is_void(p)
    rules = _keys_and_types(d) + _shape(d, SCHEMA)
    rules += [
        (reduce(or_, [~d.whole_number(f"{a}.measurements.{k}") for k in COUNTS]), "counts"), (frames_bad, "frames"), (fades_bad, "fades"), (~d.is_number(r + "globalGainDb") | ~n(r + "globalGainDb").between(-60, 24), "gain"),
        (~n(f + "channels").isin(1, 2) | ~n(f + "sampleRate").isin(44100, 48000, 88200, 96000, 176400, 192000), "channels-or-rate"), (~n(f + "bitsPerSample").isin(16, 24, 32) | ~d.whole_number(f + "validBitsPerSample", 1) | (n(f + "validBitsPerSample") > n(f + "bitsPerSample")), "bits"),
        (~d.is_number(f + "durationSeconds") | (end < 0) | ~d.whole_number(f + "fileSizeBytes"), "duration-or-size"), (channels.isNull() | (F.size(channels) != n(f + "channels")), "channel-measurements"), (F.size(F.filter(channels, channel_bad)) > 0, "channel"), (d.forbidden(), "forbidden"),
        (markers.isNull() | (F.size(markers) > MOST_MARKERS), "marker-list"), (some(markers, marker_bad), "marker"), (there(f"{a}.editorialCueSheet") & (cues.isNull() | (F.size(cues) > MOST_CUES)), "cue-list"), (some(cues, cue_bad), "cue"),
        (there(f"{a}.measurements.monoCompatibility") & (risks.isNull() | (F.size(risks) > MOST_RISKS)), "risk-list"), (some(risks, span_bad), "risk"), (minimal & ~d.is_void(f"{a}.temporalDiagnostic"), "minimal-with-series"),
        (temporal & (segments.isNull() | (F.size(segments) > MOST_SEGMENTS)), "segment-list"), (F.coalesce(temporal & (F.size(F.filter(segments, segment_bad)) > 0), F.lit(False)), "segment"),
        (evidence_.isNull() | (F.size(evidence_) > MOST_EVIDENCE), "evidence-list"), (some(evidence_, lambda e: F.coalesce(~e["classification"].isin("objective", "heuristic", "artistic", "mixed") | e["id"].isNull() | e["methodId"].isNull() | e["status"].isNull(), F.lit(True))), "evidence"),
        (F.coalesce(F.size(F.array_distinct(F.transform(evidence_, lambda e: e["id"]))) < F.size(evidence_), F.lit(False)), "evidence-repeated"), (F.octet_length(json) > F.when(minimal, MINIMAL_BYTES).otherwise(TEMPORAL_BYTES), "bytes"),
    ]
    if digest:
        rules.append((~_written_digest(d), "digest-differs"))
    return _errors(bundles, d, rules)


GUIDANCE_SCHEMA = "tonearchive.guidance/1"
_SUGGESTIONS = "array<struct<id:string,classification:string,kind:string,summary:string,rationale:string,evidenceRefs:array<string>,globalGainDb:double,predictedIntegratedLufs:double,predictedTruePeakDbtp:double,confidence:double>>"


def validate_guidance(guidance: DataFrame, json: str = "json", allowed: str | None = None) -> DataFrame:
    """``errors`` of each guidance's JSON text. ``allowed`` names a column of the references that its receipt knows; else the standing evidence counts."""
    d = _Document(json)
    known = F.col(allowed) if allowed else F.array(*[F.lit(i) for i, _, _ in EVIDENCE])
    items = d.rows("$.suggestions", _SUGGESTIONS)
    some = lambda rule: F.coalesce(F.exists(items, lambda s: F.coalesce(rule(s), F.lit(True))), F.lit(False))
    lists = [d.rows(p, "array<string>") for p in ("$.assumptions", "$.uncertainties")]
    gain = lambda s: F.when(s["kind"] == "global-gain", ~F.coalesce(s["globalGainDb"].between(-60, 24), F.lit(False))).otherwise(s["globalGainDb"].isNotNull())
    perspectives = d.rows("$.producer.vepPerspectives", "array<string>")
    rules = [(d.unknown("$", "schema bundleId analysisDigest guidanceDigest createdAt producer summary assumptions uncertainties suggestions"), "keys:$"), (d.unknown("$.producer", "system component version method vepPerspectives model promptId runId trust"), "keys:$.producer")]
    rules += _shape(d, GUIDANCE_SCHEMA)
    rules += [
        (~d.text("$.guidanceDigest").rlike(_HASH), "guidance-digest"), (~d.is_text("$.summary"), "summary"), (reduce(or_, [~d.is_text(f"$.producer.{k}") | (d.text(f"$.producer.{k}") == "") for k in ("system", "component", "version", "method")]), "producer"),
        (perspectives.isNull() | (F.size(perspectives) == 0) | F.exists(perspectives, lambda p: p.isNull() | (p == "")), "perspectives"), (d.text("$.producer.trust") != "unsigned", "trust"), (reduce(or_, [~(d.is_text(f"$.producer.{k}") | d.is_void(f"$.producer.{k}")) for k in ("model", "promptId", "runId")]), "producer-optional"),
        (items.isNull() | (F.size(items) > 100), "suggestion-list"), (some(lambda s: ~s["classification"].isin("objective", "heuristic", "artistic")), "classification"), (some(lambda s: ~s["kind"].isin("review", "global-gain", "question", "note")), "kind"), (some(lambda s: s["id"].isNull() | s["summary"].isNull() | s["rationale"].isNull()), "suggestion-text"),
        (some(lambda s: F.size(F.array_except(s["evidenceRefs"], known)) > 0), "evidence"), (some(gain), "gain"), (some(lambda s: F.coalesce(~s["confidence"].between(0, 1), F.lit(False))), "confidence"), (reduce(or_, [x.isNull() | (F.size(x) > 100) for x in lists]), "text-lists"), (F.octet_length(json) > GUIDANCE_BYTES, "bytes"), (d.forbidden(), "forbidden"),
    ]
    return _errors(guidance, d, rules)


def validate_receipts(rows: DataFrame) -> DataFrame:
    """``errors`` of each receipt (bundle_id, digest, source_sha256, edit_digest, engine, method, evidence_ids, marker_ids, created_at)."""
    form = lambda c, pattern: ~F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    listed = lambda c: F.col(c).isNull() | F.exists(c, lambda x: x.isNull())
    rules = [(form("bundle_id", f"(?i){_UUID}"), "bundle-id"), *[(form(c, _HASH), c) for c in ("digest", "source_sha256", "edit_digest")], *[(F.col(c).isNull(), c) for c in ("engine", "method")], *[(listed(c), c) for c in ("evidence_ids", "marker_ids")]]
    return rows.withColumn("errors", all_that_hold(*rules, (F.col("created_at").try_cast("timestamp").isNull(), "created-at")))
