"""MPEG audio: write bytes into valid Layer III streams, and read any such stream frame by frame.

The writer puts a payload into the ancillary bytes of silent mono frames: 192 bytes or two or
three times as many a frame, so the stream's bitrate varies. An ID3v2 tag holds the payload's
length, and a first frame the table of a variable-bitrate stream (frames, bytes, seek points).
The reader parses tag and table, finds frame headers (resynchronising after junk), verifies
checksums, and gives exact durations and the byte offset of every frame.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_batches, materialize

UNIT, RATE_HZ, FRAME_SAMPLES, LEAST = 192, 48_000, 1152, 23
# Fixed values of the format: kilobits a second by index, hertz by index.
BITRATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
SAMPLE_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
#: Bitrate index of a frame that carries one, two or three units: 80, 160 and 224 kbit/s.
CARRIES = {1: 6, 2: 10, 3: 12}
_CRC = []
for _byte in range(256):
    _value = _byte << 8
    for _ in range(8):
        _value = (_value << 1 ^ 0x8005 if _value & 0x8000 else _value << 1) & 0xFFFF
    _CRC.append(_value)


def crc16(data: bytes) -> int:
    value = 0xFFFF
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ _CRC[value >> 8 ^ byte]
    return value


@dataclass
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    hertz: int
    mono: bool
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information of a Layer III frame."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    def covered(self, mode: int) -> int:
        """Bytes after the checksum that it covers: side information, or Layer I's allocation of 4 bits; 0 for Layer II, whose tables are not read."""
        if self.layer == 1:
            bound = 4 * ((mode >> 4 & 3) + 1) if mode >> 6 == 1 else 32
            return 16 if self.mono else (bound + 32) // 2
        return self.side if self.layer == 3 else 0


def header(word: bytes) -> Header | None:
    """The four bytes of a frame header, or None if they are none (free format included)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate, hertz = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    kbps, hz, pad = BITRATES[1 if version == 3 else 2, layer][rate], SAMPLE_RATES[version][hertz], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12_000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    return Header(version, layer, not word[1] & 1, kbps, hz, word[3] >> 6 == 3, length, samples)


_headers: dict[bytes, Header | None] = {}


def _header_at(data: bytes, at: int) -> Header | None:
    word = data[at : at + 4]
    if word not in _headers:
        if len(_headers) > 4096:
            _headers.clear()
        _headers[word] = header(word)
    return _headers[word]


def _frame_head(units: int) -> bytes:
    word = bytes([0xFF, 0xFA, CARRIES[units] << 4 | 1 << 2, 0xC4])
    side = bytes(17)  # no main data: silence
    return word + crc16(word[2:] + side).to_bytes(2, "big") + side


_HEADS = {n: _frame_head(n) for n in CARRIES}
_LENGTHS = {n: header(h[:4]).length for n, h in _HEADS.items()}


def _synchsafe(n: int) -> bytes:
    return bytes(n >> shift & 0x7F for shift in (21, 14, 7, 0))


def write(data: bytes) -> bytes:
    """A stream that carries the bytes, padded by blanks to a positive multiple of 192."""
    units = max(1, -(-len(data) // UNIT))
    payload = data.ljust(units * UNIT, b" ")
    threes, rest = divmod(units, 3)
    frames = []
    if threes:
        block = np.zeros((threes, _LENGTHS[3]), np.uint8)
        block[:, :LEAST] = np.frombuffer(_HEADS[3], np.uint8)
        block[:, LEAST : LEAST + 3 * UNIT] = np.frombuffer(payload, np.uint8, threes * 3 * UNIT).reshape(threes, -1)
        frames.append(block.tobytes())
    if rest:
        frames.append((_HEADS[rest] + payload[threes * 3 * UNIT :]).ljust(_LENGTHS[rest], b"\0"))
    count, size = threes + (rest > 0), threes * _LENGTHS[3] + (_LENGTHS[rest] if rest else 0)
    first = _LENGTHS[1]
    marks = [min(count - 1, count * k // 100) for k in range(100)]
    points = bytes(min(255, 256 * (first + min(m, threes) * _LENGTHS[3]) // (first + size)) for m in marks)
    table = b"Xing" + (15).to_bytes(4, "big") + count.to_bytes(4, "big") + (first + size).to_bytes(4, "big") + points + (0).to_bytes(4, "big")
    text = b"\0payload_bytes\0" + str(len(data)).encode()
    item = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    tag = b"ID3\x03\0\0" + _synchsafe(len(item)) + item
    return tag + (_HEADS[1] + table).ljust(first, b"\0") + b"".join(frames)


@dataclass
class Stream:
    """What a stream holds; damage shows in ``skipped`` and ``bad_checksums``, never as an error."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    offsets: list[int] = field(default_factory=list)
    rates: dict[int, int] = field(default_factory=dict)
    samples: int = 0
    hertz: int = 0
    checked: int = 0
    bad_checksums: int = 0
    skipped: int = 0
    payload: bytes = b""

    @property
    def microseconds(self) -> int:
        return self.samples * 1_000_000 // self.hertz if self.hertz else 0


def _tag(data: bytes) -> tuple[int, dict[str, str]]:
    """End of a leading ID3v2 tag, and its text items."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    size = sum((b & 0x7F) << shift for b, shift in zip(data[6:10], (21, 14, 7, 0), strict=True))
    at, end, items = 10, min(10 + size, len(data)), {}
    while at + 10 <= end and data[at] != 0:
        name = data[at : at + 4].decode("latin-1")
        n = sum((b & 0x7F) << s for b, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0), strict=True)) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 11 : at + 10 + n]
        if name == "TXXX":
            key, _, value = body.partition(b"\0")
            items[key.decode("latin-1")] = value.decode("latin-1")
        elif name[:1] == "T":
            items[name] = body.decode("latin-1")
        at += 10 + n
    return end, items


def _rate_table(data: bytes, at: int, head: Header) -> dict | None:
    """The frame count, byte count and seek points of a variable-bitrate table, if this frame holds one."""
    start = at + 4 + 2 * head.protected + head.side
    if data[start : start + 4] in (b"Xing", b"Info"):
        flags, place, out = int.from_bytes(data[start + 4 : start + 8], "big"), start + 8, {}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[place : place + 4], "big")
                place += 4
        return out | {"points": list(data[place : place + 100])} if flags & 4 else out
    if data[at + 36 : at + 40] == b"VBRI":
        return {"bytes": int.from_bytes(data[at + 46 : at + 50], "big"), "frames": int.from_bytes(data[at + 50 : at + 54], "big")}
    return None


def read(data: bytes) -> Stream:
    """Parse a stream. A header counts if the frame ends at another header or at the stream's end."""
    out = Stream()
    at, out.tags = _tag(data)
    good: set[bytes] = set()
    payload, first, end = [], True, len(data)
    while at + 4 <= end:
        head = _header_at(data, at)
        after = at + head.length if head else 0
        if not head or after > end or (after + 4 <= end and not _header_at(data, after)):
            next_at = data.find(b"\xff", at + 1)
            next_at = end if next_at < 0 else next_at
            out.skipped += next_at - at
            at = next_at
            continue
        body = at + 4 + 2 * head.protected
        covered = head.covered(data[at + 3])
        if head.layer == 3:
            body += head.side * head.protected
        if head.protected and covered:
            seen = data[at + 2 : at + 6 + covered]
            out.checked += 1
            if seen not in good:
                if crc16(seen[:2] + seen[4:]) == int.from_bytes(seen[2:4], "big"):
                    good.add(seen)
                else:
                    out.bad_checksums += 1
        table = _rate_table(data, at, head) if first else None
        first = False
        if table is not None:
            out.table = table
        else:
            out.offsets.append(at)
            out.samples += head.samples
            out.hertz = head.hertz
            out.rates[head.kbps] = out.rates.get(head.kbps, 0) + 1
            payload.append(data[body : body + (after - body) // UNIT * UNIT])
        at = after
    out.skipped += end - at
    out.payload = b"".join(payload)
    return out


def store(docs: DataFrame) -> DataFrame:
    """doc_id, media (binary): the UTF-8 bytes of every whole text (null: empty) as a stream, written as a table."""

    def run(rows: dict) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(rows["text"]), 64):
            part = [write(t.encode()) for t in rows["text"][low : low + 64]]
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"][low : low + 64], pa.int64()), pa.array(part, pa.binary())], ["doc_id", "media"])

    return materialize(map_batches(documents(docs), run, "doc_id long, media binary"), "media")


_FEATURES = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("duration_us", pa.int64()), ("frame_offsets", pa.list_(pa.int64())), ("feature", pa.string())]
)


def _length(stream: Stream) -> int:
    """Bytes that the stream's own tag states, if it is a number that the payload can hold."""
    stated = stream.tags.get("payload_bytes", "")
    return int(stated) if re.fullmatch("[0-9]{1,18}", stated) and int(stated) <= len(stream.payload) else len(stream.payload)


def features(media: DataFrame) -> DataFrame:
    """Per stored stream: doc_id, n_bytes (from its tag), payload read back, media, duration_us, frame_offsets, feature.

    Null media give an empty stream's features. Streams of other origin are read as far as
    their frames go; without a length tag that fits, n_bytes is the payload's. Checksums of
    Layer II are skipped, not verified.
    """

    def run(rows: dict) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(rows["media"]), 64):
            out = []
            for doc_id, data in zip(rows["doc_id"][low : low + 64], rows["media"][low : low + 64], strict=True):
                s = read(data or b"")
                level = np.frombuffer(s.payload, np.uint8).astype(np.float64) - 128
                rms = round(float(np.sqrt((level**2).mean())), 6) if len(level) else 0.0
                rates = ",".join(f"{k}:{v}" for k, v in sorted(s.rates.items()))
                seek = zlib.crc32(np.array(s.offsets, "<i8").tobytes())
                feature = f"frames={len(s.offsets)};samples={s.samples};hz={s.hertz};rates={rates};table={(s.table or {}).get('frames', '')};bad={s.bad_checksums}/{s.checked};skipped={s.skipped};seek={seek};rms={rms}"
                out.append({"doc_id": doc_id, "n_bytes": _length(s), "payload": s.payload, "media": data, "duration_us": s.microseconds, "frame_offsets": s.offsets, "feature": feature})
            yield pa.RecordBatch.from_pylist(out, _FEATURES)

    kind = "doc_id long, n_bytes long, payload binary, media binary, duration_us long, frame_offsets array<long>, feature string"
    return map_batches(media.select("doc_id", "media"), run, kind)


def digests(docs: DataFrame) -> DataFrame:
    """Store all documents as streams, read them back, and describe each by lengths, digests, duration and feature."""
    return features(store(docs)).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "duration_us",
    )
