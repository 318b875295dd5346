"""WAV files of any layout: chunks far from both ends, many chunks, archives of good and bad files read by ranges."""

import struct

import numpy as np
import pytest

from tonearchive.sources import wav

RATE = 48_000


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def riff(*chunks):
    body = b"WAVE" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def fmt(rate=RATE, channels=1):
    return chunk(b"fmt ", struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16))


def pcm(n, seed=0):
    return np.random.default_rng(seed).integers(-30_000, 30_000, n).astype("<i2").tobytes()


LAYOUTS = {
    "far": riff(fmt(), chunk(b"LIST", b"x" * 200_001), chunk(b"data", pcm(200_000)), chunk(b"bext", b"y" * 150_000), chunk(b"cue ", b"")),
    "late": riff(chunk(b"JUNK", b"x" * 300_000), chunk(b"data", pcm(100_000)), chunk(b"LIST", b"y" * 90_000), fmt()),
    "many": riff(*[chunk(b"JUNK", bytes(k % 7)) for k in range(300)], fmt(), chunk(b"data", pcm(500))),
    "edge": riff(*[chunk(b"JUNK", bytes(3)) for k in range(wav.WALK - 2)], fmt(), chunk(b"data", pcm(50))),
    "cut": riff(fmt(), chunk(b"data", pcm(1000)))[:-501],
}


def test_chunks_wherever_they_lie(spark):
    files = spark.createDataFrame(list(LAYOUTS.items()), "path string, content binary")
    got = {r.path: r for r in wav.wav_inventory(files).collect()}
    assert {k: (r.status, r.frames, r.truncated) for k, r in got.items()} == {"far": ("ok", 200_000, False), "late": ("ok", 100_000, False), "many": ("ok", 500, False), "edge": ("ok", 50, False), "cut": ("ok", 749, True)}
    assert [c.id for c in got["far"].chunks] == ["fmt ", "LIST", "data", "bext", "cue "] and len(got["many"].chunks) == 302
    for path, content in LAYOUTS.items():
        assert wav.parse(wav._of(content), len(content))["data_offset"] == got[path].data_offset
    rows = {p: [] for p in LAYOUTS}
    for r in wav.wav_blocks(files, 0.5).orderBy("block_no").collect():
        rows[r.path] += r.samples
    assert {k: len(v) for k, v in rows.items()} == {k: r.frames for k, r in got.items()}
    assert (np.array(rows["far"]) * 32768 == np.frombuffer(pcm(200_000), "<i2")).all()


def test_archive(spark, tmp_path):
    """A folder of files with metadata before the samples, bad files, and one of three hours: inventory and blocks agree."""
    spark.dataSource.register(wav.WavSource)
    spark.dataSource.register(wav.WavInventory)
    (tmp_path / "a").mkdir()
    for name, content in LAYOUTS.items():
        (tmp_path / "a" / f"{name}.wav").write_bytes(content)
    (tmp_path / "bad.wav").write_bytes(b"RIFX" + LAYOUTS["far"][4:])
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "stereo.wav").write_bytes(riff(fmt(channels=2), chunk(b"data", pcm(RATE * 5))))
    hours = 3 * 3600 * RATE
    with open(tmp_path / "long.wav", "wb") as f:  # silence, not written out
        f.write(riff(fmt()) + b"data" + struct.pack("<I", 2 * hours))
        f.truncate(f.tell() + 2 * hours)
    found = {r.path.removeprefix(f"{tmp_path}/"): r for r in spark.read.format("wav_inventory").load(str(tmp_path)).collect()}
    assert {k: r.reason for k, r in found.items() if r.status != "ok"} == {"bad.wav": "not-wave", "empty.wav": "too-short"}
    assert found["long.wav"].frames == hours and found["a/cut.wav"].truncated
    read = spark.read.format("wav_blocks").option("path", str(tmp_path)).option("partition_bytes", 32 << 20).load()
    assert read.rdd.getNumPartitions() > 25  # three hours are shared
    sums = {(r.path.removeprefix(f"{tmp_path}/"), r.channel): r for r in read.selectExpr("path", "channel", "block_no", "size(samples) as n", "last").groupBy("path", "channel").agg({"n": "sum", "block_no": "max", "last": "count"}).collect()}
    assert {k: r["sum(n)"] for k, r in sums.items()} == {(k, c): r.frames for k, r in found.items() if r.status == "ok" for c in range(r.channels)}
    assert sums["long.wav", 0]["max(block_no)"] == 3 * 3600 - 1


@pytest.mark.parametrize("share", [1 << 12, 50_001, 1 << 26])
def test_ranges_give_every_block_once(spark, tmp_path, share):
    (tmp_path / "x.wav").write_bytes(riff(chunk(b"JUNK", bytes(777)), fmt(channels=2), chunk(b"data", pcm(50_000, 3))))
    spark.dataSource.register(wav.WavSource)
    got = spark.read.format("wav_blocks").option("path", f"{tmp_path}/*.wav").option("block_seconds", 0.01).option("halo_seconds", 0.003).option("partition_bytes", share).load().orderBy("channel", "block_no").collect()
    x = np.frombuffer(pcm(50_000, 3), "<i2").reshape(-1, 2).T / 32768
    assert [(r.channel, r.block_no, r.last) for r in got] == [(c, k, k == 52) for c in range(2) for k in range(53)]
    for r in got:
        assert r.samples == x[r.channel, r.start_frame : r.start_frame + 480].tolist() and r.halo == x[r.channel, max(0, r.start_frame - 144) : r.start_frame].tolist()
