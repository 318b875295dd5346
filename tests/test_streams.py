"""Live runs by event time and the newest result of each key, over micro-batches, timers and restarts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonearchive.streaming import live

RUN = "recording long, ts timestamp, holds boolean"


def feed(spark, path, rows):
    """Each list of (recording, second, holds) becomes a file, and so a micro-batch."""
    for k, part in enumerate(rows):
        frame = spark.createDataFrame([(r, s, h) for r, s, h in part], "recording long, s double, holds boolean").select("recording", F.timestamp_seconds("s").alias("ts"), "holds")
        frame.coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
    return spark.readStream.schema(RUN).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/*")


def plain_runs(rows, idle, mark):
    out = []
    for recording in {r for r, _, _ in rows}:
        own = sorted((s, h) for r, s, h in rows if r == recording and s <= mark)
        begin = count = last = None
        for s, h in own:
            if count and s - last > idle:
                out.append((recording, begin, last + idle, count))
                count = None
            if h:
                begin, count, last = (begin, count + 1, s) if count else (s, 1, s)
            elif count:
                out.append((recording, begin, s, count))
                count = None
        if count and last + idle <= mark:
            out.append((recording, begin, last + idle, count))
    return sorted(out)


def test_closed_runs():
    find = lambda rows, carried=None: live.closed_runs(np.array([t for t, _ in rows], np.int64), np.array([h for _, h in rows], bool), 10, carried)
    assert find([]) == ([], None) and find([], (1, 2, 3)) == ([], (1, 2, 3))
    assert find([(1, True), (2, True), (3, False), (9, True)]) == ([(1, 3, 2)], (9, 1, 9))
    assert find([(1, True), (20, True), (40, False)]) == ([(1, 11, 1), (20, 30, 1)], None)
    assert find([(5, False)], (1, 2, 3)) == ([(1, 5, 2)], None) and find([(50, False)], (1, 2, 3)) == ([(1, 13, 2)], None)
    assert find([(5, True)], (1, 2, 3)) == ([], (1, 3, 5)) and find([(50, True)], (1, 2, 3)) == ([(1, 13, 2)], (50, 1, 50))


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_do_not_depend_on_micro_batches(spark, tmp_path, seed):
    """Rows out of order within the lateness, cut in many ways; a recording that falls silent gives its open run."""
    rng = np.random.default_rng(seed)
    rows = [(int(r), float(t), bool(rng.random() < 0.7)) for r in (1, 2, 3) for t in np.sort(rng.choice(400, 60, replace=False))]
    rows += [(9, 5.0, True), (9, 6.0, True)]  # silent from then on
    rows.sort(key=lambda x: x[1] + rng.uniform(0, 20))  # arrival
    batches = np.array_split(np.arange(len(rows)), 4)
    stream = feed(spark, tmp_path / "in", [[rows[i] for i in b] for b in batches])
    got = live.drain(live.live_runs(stream, "25 seconds", 15.0), spark, "runs", live.STORE).collect()
    mark = max(s for _, s, _ in rows) - 25
    found = sorted((r.recording, r.start_us / 1e6, r.end_us / 1e6, r.length) for r in got)
    assert found == plain_runs(rows, 15.0, mark) and (9, 5.0, 21.0, 2) in found


def test_a_late_older_job_never_replaces_a_newer_one(spark, tmp_path, monkeypatch):
    """Over a restart, a repeated micro-batch, ties, and folds of the batches."""
    monkeypatch.setattr(live, "FOLD", 3)
    schema = "recording long, operation string, job long, part int, value double"
    parts = [[(1, "peak", 5, 0, 0.5), (2, "peak", 1, 0, 0.1)], [(1, "peak", 4, 9, 0.4)], [(2, "peak", 1, 1, 0.2), (1, "lufs", 1, 0, -20.0)], [(1, "peak", 5, 0, 0.5)], [(2, "peak", 3, 0, 0.3), (1, "peak", 2, 0, 9.9)]]
    keys, by, path = ["recording", "operation"], ["job", "part"], str(tmp_path / "out")

    def run(upto):
        for k in range(upto):
            if not (tmp_path / f"in/{k}").exists():
                spark.createDataFrame(parts[k], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        live.keep_newest(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), path, keys, by)
        return sorted(tuple(r) for r in live.newest_rows(spark, path, keys, by).select("recording", "operation", "job", "value").collect())

    assert run(2) == [(1, "peak", 5, 0.5), (2, "peak", 1, 0.1)]
    assert run(3) == [(1, "lufs", 1, -20.0), (1, "peak", 5, 0.5), (2, "peak", 1, 0.2)]
    last = sorted((tmp_path / "out/state/commits").iterdir(), key=lambda p: int(p.name) if p.name.isdigit() else -1)[-1]
    last.unlink()  # the commit of the last batch is lost: it is done again
    (last.parent / f".{last.name}.crc").unlink()
    assert run(5) == [(1, "lufs", 1, -20.0), (1, "peak", 5, 0.5), (2, "peak", 3, 0.3)]
