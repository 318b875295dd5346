"""WAV files: inventory, quarantine and decoding, from rows of ``binaryFile`` or by byte ranges of mounted files.

Every way walks the chunks with ``parse``, which asks for the bytes that it needs, wherever they lie.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RATES = (44100, 48000, 88200, 96000, 176400, 192000)
#: Tail of the extensible format's identifiers (fixed value).
GUID = bytes.fromhex("000000001000800000aa00389b71")
#: Chunk headers that the JVM follows before it hands a file over whole; bytes at each that may hold a format; samples of one batch of blocks.
WALK, WINDOW, BATCH = 64, 264, 1 << 20
_FIELDS = "status string, reason string, encoding string, channels int, sample_rate int, bits int, valid_bits int, block_align int, extensible boolean, data_offset long, data_bytes long, frames long, truncated boolean, chunks array<struct<id:string,offset:long,declared:long,available:long>>"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]
Bytes = Callable[[int, int], bytes]


class Rejected(Exception):
    """A file that cannot be measured; its text is the reason."""


def parse(at: Bytes, size: int) -> dict:
    """Layout of a WAV file of ``size`` bytes, of which ``at(offset, count)`` gives some. A chunk that is cut off ends the walk."""
    lead = at(0, 12)
    if size < 12 or len(lead) < 12:
        raise Rejected("too-short")
    if lead[:4] in (b"RF64", b"BW64"):
        raise Rejected("rf64")
    if lead[:4] != b"RIFF" or lead[8:12] != b"WAVE":
        raise Rejected("not-wave")
    chunks, offset = [], 12
    while offset + 8 <= size:
        name, declared = struct.unpack("<4sI", at(offset, 8))
        chunks.append({"id": name.decode("latin-1"), "offset": offset + 8, "declared": declared, "available": max(0, min(declared, size - offset - 8))})
        offset += 8 + declared + declared % 2
    fmt, data = (next((c for c in chunks if c["id"] == i), None) for i in ("fmt ", "data"))
    if fmt is None or sum(c["id"] == "fmt " for c in chunks) > 1:
        raise Rejected("no-fmt" if fmt is None else "several-fmt")
    if data is None:
        raise Rejected("no-data")
    if fmt["available"] < 16:
        raise Rejected("short-fmt")
    head = at(fmt["offset"], min(40, fmt["available"]))
    tag, channels, rate, byte_rate, align, bits = struct.unpack_from("<HHIIHH", head)
    valid, extensible = bits, tag == 0xFFFE
    if extensible:
        if len(head) < 40 or head[26:40] != GUID:
            raise Rejected("guid")
        valid, tag = struct.unpack_from("<H", head, 18)[0] or bits, struct.unpack_from("<H", head, 24)[0]
    if tag not in (1, 3) or (tag == 3 and bits != 32):
        raise Rejected("encoding")
    if channels not in (1, 2):
        raise Rejected("channels")
    if rate not in RATES:
        raise Rejected("sample-rate")
    if bits not in (16, 24, 32) or not 1 <= valid <= bits:
        raise Rejected("bits")
    if align != channels * bits // 8:
        raise Rejected("block-align")
    if byte_rate != rate * align:
        raise Rejected("byte-rate")
    whole = data["available"] // align * align
    return {
        "encoding": "float" if tag == 3 else "pcm", "channels": channels, "sample_rate": rate, "bits": bits, "valid_bits": valid, "block_align": align, "extensible": extensible, "data_offset": data["offset"],
        "data_bytes": whole, "frames": whole // align, "truncated": whole < data["declared"], "chunks": chunks,
    }


def _try(at: Bytes, size: int) -> dict:
    try:
        return {"status": "ok", "reason": None} | parse(at, size)
    except Rejected as why:
        return {"status": "rejected", "reason": str(why)}


def _of(content: bytes) -> Bytes:
    return lambda offset, count: content[offset : offset + count]


def _little(b: Column) -> Column:
    """Four bytes as a whole number, the least significant first."""
    return F.conv(F.hex(F.concat(*[F.substring(b, k, 1) for k in (4, 3, 2, 1)])), 16, 10).cast("long")


def _windows(content: Column, size: Column) -> Column:
    """Bytes at each chunk header, as far as ``WALK`` headers go, and where the walk stands then."""
    piece = lambda at: F.substring(content, at.cast("int") + 1, F.lit(WINDOW))

    def follow(s: Column, _: Column) -> Column:
        declared = _little(F.substring(piece(s["at"]), 5, 4))
        on = F.struct((s["at"] + 8 + declared + declared % 2).alias("at"), F.concat(s["seen"], F.array(F.struct(s["at"].alias("at"), piece(s["at"]).alias("bytes")))).alias("seen"))
        return F.when(s["at"] + 8 <= size, on).otherwise(s)

    start = F.struct(F.lit(12).cast("long").alias("at"), F.array().cast("array<struct<at:long,bytes:binary>>").alias("seen"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, follow)


def wav_inventory(files: DataFrame) -> DataFrame:
    """Layout of each file (path, content), or why it is rejected; a bad file never fails the job. Null content is too short.

    The JVM follows the chunk headers and hands on some bytes at each; a file with more than ``WALK`` chunks is handed on whole.
    """

    def layout(lead: bytes, size: int, seen: list, rest: bytes | None) -> dict:
        if rest is not None:
            return _try(_of(bytes(rest)), size)
        windows = {0: bytes(lead)} | {w["at"]: bytes(w["bytes"]) for w in seen} | {w["at"] + 8: bytes(w["bytes"])[8:] for w in seen}
        return _try(lambda offset, count: windows[offset][:count], size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": r["path"]} | layout(r["lead"], r["size"], r["seen"], r["rest"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in ("path", *_NAMES)} for r in rows], schema=_SCHEMA)

    content = F.coalesce("content", F.lit(b""))
    size = F.octet_length(content).cast("long")
    walked = files.select("path", "content", size.alias("size"), _windows(content, size).alias("walk"))
    rest = F.when(F.col("walk.at") + 8 <= F.col("size"), F.col("content"))
    return walked.select("path", F.substring(content, 1, 12).alias("lead"), "size", F.col("walk.seen").alias("seen"), rest.alias("rest")).mapInArrow(run, f"path string, {_FIELDS}")


_CHUNK = pa.struct([("id", pa.string()), ("offset", pa.int64()), ("declared", pa.int64()), ("available", pa.int64())])
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([("path", pa.string()), *[(f.split()[0], _TYPES.get(f.split()[1], pa.list_(_CHUNK))) for f in _FIELDS.split(", ")]])


def wav_rejects(inventory: DataFrame) -> DataFrame:
    return inventory.where("status = 'rejected'").select("path", "reason")


def decode(payload: bytes, encoding: str, bits: int, valid_bits: int, channels: int) -> np.ndarray:
    """Samples by channel as doubles: signed integers over their scale, padding bits shifted out; floats as they are, NaN included."""
    if encoding == "float":
        flat = np.frombuffer(payload, "<f4").astype(float)
    elif bits == 24:
        raw = np.frombuffer(payload, np.uint8).reshape(-1, 3).astype(np.int32)
        flat = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8 >> (24 - valid_bits)).astype(float) / 2.0 ** (valid_bits - 1)
    else:
        flat = (np.frombuffer(payload, f"<i{bits // 8}") >> (bits - valid_bits)).astype(float) / 2.0 ** (valid_bits - 1)
    return flat.reshape(-1, channels).T


BLOCKS = "path string, channel int, block_no long, start_frame long, sample_rate int, samples array<double>"


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows) if rows else np.empty(0)))


PAIRED = "path string, block_no long, start_frame long, sample_rate int, samples array<array<double>>, halo array<array<double>>, last boolean"


def _nested(rows: list[list[np.ndarray]]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), _lists([c for r in rows for c in r]))


def _decoded(path: str, f: dict, at: Bytes, first: int, last: int, size: int, halo: int | None = None, paired: bool = False) -> Iterator[pa.RecordBatch]:
    """Blocks ``first`` to ``last`` of ``size`` frames, some ``BATCH`` samples at a time; with ``halo``, up to so many samples before each, and whether it ends the file.

    A block is a row for each channel, or one with both channels' samples (and halos) side by side if ``paired``.
    """
    many = max(1, BATCH // (size * f["channels"]))
    for number in range(first, last, many):
        begin, end = number * size, min(min(last, number + many) * size, f["frames"])
        before = min(halo or 0, begin)
        x = decode(at(f["data_offset"] + (begin - before) * f["block_align"], (end - begin + before) * f["block_align"]), f["encoding"], f["bits"], f["valid_bits"], f["channels"])
        starts = np.arange(begin, end, size)
        n, k = len(starts), len(x)
        places = (starts - begin + before).tolist()
        if paired:
            columns = [pa.array([path] * n), pa.array(starts // size), pa.array(starts), pa.array(np.full(n, f["sample_rate"], np.int32)), _nested([[c[s : s + size] for c in x] for s in places]), _nested([[c[max(0, s - (halo or 0)) : s] for c in x] for s in places]), pa.array(starts + size >= f["frames"])]
            yield pa.RecordBatch.from_arrays(columns, ["path", "block_no", "start_frame", "sample_rate", "samples", "halo", "last"])
            continue
        spans = [(c, s) for c in x for s in places]
        columns = [
            pa.array([path] * (n * k)), pa.array(np.repeat(np.arange(k, dtype=np.int32), n)), pa.array(np.tile(starts // size, k)), pa.array(np.tile(starts, k)), pa.array(np.full(n * k, f["sample_rate"], np.int32)),
            _lists([c[s : s + size] for c, s in spans]),
        ]
        if halo is not None:
            columns += [_lists([c[max(0, s - halo) : s] for c, s in spans]), pa.array(np.tile(starts + size >= f["frames"], k))]
        yield pa.RecordBatch.from_arrays(columns, ["path", "channel", "block_no", "start_frame", "sample_rate", "samples", "halo", "last"][: len(columns)])


def wav_blocks(files: DataFrame, block_seconds: float = 1.0, halo_seconds: float | None = None, paired: bool = False) -> DataFrame:
    """Blocks of samples of all sound files (path, content): path, channel, block_no, start_frame, sample_rate, samples. Others give none.

    With ``halo_seconds`` each has ``halo``, the samples before it, and ``last``; ``paired`` blocks have both and no channel, but arrays of the
    channels' samples. A file is decoded once, by stretches of some ``BATCH`` samples, whose blocks form one batch.
    """
    extra = ", halo array<double>, last boolean" if halo_seconds is not None else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at, f = _of(content or b""), _try(_of(content or b""), len(content or b""))
                if f["status"] == "ok":
                    size = max(1, int(f["sample_rate"] * block_seconds))
                    halo = None if halo_seconds is None and not paired else int(f["sample_rate"] * (halo_seconds or 0))
                    yield from _decoded(path, f, at, 0, -(-f["frames"] // size), size, halo, paired)

    return files.select("path", "content").mapInArrow(run, PAIRED if paired else BLOCKS + extra)


def _is_paired(options: dict) -> bool:
    return str(options.get("paired", "false")).lower() == "true"


class _Share(InputPartition):
    """Stretches of files for one task: path, size, and the bytes from which to which its blocks begin."""

    def __init__(self, pieces: list[tuple[str, int, int, int]]):
        self.pieces = pieces


class _Reader(DataSourceReader):
    """Files under a path (a file, a folder or a pattern), dealt by bytes; only tasks open them."""

    def __init__(self, options):
        self.path, self.share = options["path"].removeprefix("file://"), int(options.get("partition_bytes", 64 << 20))
        self.block_seconds, self.halo_seconds = float(options.get("block_seconds", 1.0)), float(options.get("halo_seconds", 0.25))
        self.paired = _is_paired(options)

    def _files(self) -> Iterator[tuple[str, int]]:
        for top in sorted(glob.glob(self.path)) or [self.path]:
            if not os.path.isdir(top):
                yield top, os.path.getsize(top)
            for folder, inner, names in os.walk(top):
                inner.sort()
                yield from ((path := os.path.join(folder, n), os.path.getsize(path)) for n in sorted(names) if not n.startswith((".", "_")))

    def partitions(self):
        """Stretches of ``partition_bytes``: a long file makes many, short ones share one."""
        shares, held = [_Share([])], 0
        for path, size in self._files():
            for low in range(0, max(1, size), self.share):
                part = min(self.share, size - low)
                if held + part > self.share and shares[-1].pieces:
                    shares.append(_Share([]))
                    held = 0
                shares[-1].pieces.append((path, size, low, low + part if low + part < size else size + 1))
                held += max(part, self.share >> 10)  # opening a file counts too
        return shares

    @staticmethod
    def _open(path: str):  # noqa: ANN205
        file = open(path, "rb")  # noqa: SIM115

        def at(offset: int, count: int) -> bytes:
            file.seek(offset)
            return file.read(count)

        return file, at

    def read(self, partition):
        for path, size, low, high in partition.pieces:
            file, at = self._open(path)
            with file:
                f = _try(at, size)
                if f["status"] == "ok":
                    frames = max(1, int(f["sample_rate"] * self.block_seconds))
                    nth = lambda byte: min(max(0, -(-(byte - f["data_offset"]) // (frames * f["block_align"]))), -(-f["frames"] // frames))  # noqa: B023, E731
                    yield from _decoded(path, f, at, nth(low), nth(high), frames, int(f["sample_rate"] * self.halo_seconds), self.paired)


class _Inventory(_Reader):
    def read(self, partition):
        rows = []
        for path, size, low, _ in partition.pieces:
            if low == 0:
                file, at = self._open(path)
                with file:
                    rows.append({n: None for n in _NAMES} | {"path": path} | _try(at, size))
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


class WavSource(DataSource):
    """``spark.read.format("wav_blocks").load(path)``: blocks, with the samples before each, of all WAV files of an archive.

    ``path`` is a file, a folder or a pattern that driver and executors mount; options: block_seconds, halo_seconds,
    partition_bytes, paired (channels side by side in one row). Files are read by ranges, so any number of tasks share a long one. Files that ``wav_inventory`` rejects give no blocks.
    """

    reader_class = _Reader

    @classmethod
    def name(cls):
        return "wav_blocks"

    def schema(self):
        return PAIRED if _is_paired(self.options) else f"{BLOCKS}, halo array<double>, last boolean"

    def reader(self, schema):
        return self.reader_class(self.options)


class WavInventory(WavSource):
    """``spark.read.format("wav_inventory").load(path)``: a row per file of an archive with its layout, or why it is rejected. Only headers are read."""

    reader_class = _Inventory

    @classmethod
    def name(cls):
        return "wav_inventory"

    def schema(self):
        return f"path string, {_FIELDS}"


def wav_bytes(samples: np.ndarray, rate: int, bits: int = 16, encoding: str = "pcm") -> bytes:
    """A plain WAV file of (frames x channels) samples."""
    x = np.atleast_2d(samples.T).T
    if encoding == "float":
        payload = x.astype("<f4").tobytes()
    else:
        scale = 2.0 ** (bits - 1)
        whole = np.floor(np.clip(np.where(np.isfinite(x), x, 0.0), -1, 1 - 1 / scale) * scale + 0.5).astype("<i4")
        payload = whole.astype("<i2").tobytes() if bits == 16 else whole.tobytes() if bits == 32 else whole.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    channels = x.shape[1]
    fmt = struct.pack("<HHIIHH", 3 if encoding == "float" else 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def encode_files(frames: DataFrame, rate: int = 48_000) -> DataFrame:
    """A 16-bit file per recording of (recording, frame, left, right): path, content. For short clips: a file is one row."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("frame", "left", "right"))), lambda x: F.array(x["left"], x["right"]))

    @F.pandas_udf("binary")
    def pack(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: wav_bytes(np.array([list(p) for p in r], float), rate))

    return frames.groupBy("recording").agg(pairs.alias("pairs")).select(F.format_string("rec/%d.wav", "recording").alias("path"), pack("pairs").alias("content"))
