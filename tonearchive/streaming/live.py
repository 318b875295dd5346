"""Live metering: tumbling and sliding windows, runs by event time, repeats, and the newest result of each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources.documents import work_path


def live_steps(stream: DataFrame, length: str, late: str) -> DataFrame:
    """Tumbling aggregates of arriving samples (recording, ts, value): count, energy and peak per window."""
    return (
        stream.withWatermark("ts", late).groupBy(F.window("ts", length), "recording").agg(F.count("*").alias("n"), F.avg(F.col("value") * F.col("value")).alias("energy"), F.max(F.abs("value")).alias("peak"))
        .select("recording", F.col("window.start").alias("start"), "n", "energy", "peak")
    )


def live_rolling(stream: DataFrame, length: str, slide: str, late: str) -> DataFrame:
    """Sliding mean energy per recording."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "recording").agg(F.avg(F.col("value") * F.col("value")).alias("energy")).select("recording", F.col("window.start").alias("start"), "energy")


RUNS = "recording long, start_us long, end_us long, length long"


def closed_runs(ts: np.ndarray, holds: np.ndarray, idle: int, carried: tuple[int, int, int] | None) -> tuple[list[tuple[int, int, int]], tuple[int, int, int] | None]:
    """Runs (begin, end, rows) that rows in order of time close, and the run (begin, rows, last) that stays open, given the one that was.

    A run ends at the next row, if that does not hold and comes within ``idle``; otherwise ``idle`` after its last row.
    """
    if carried:
        begin, count, last = carried
        ts, holds = np.concatenate([[last], ts]), np.concatenate([[True], holds])
    if not len(ts):
        return [], None
    near = np.diff(ts) <= idle
    starts = np.flatnonzero(holds & ~np.append(False, holds[:-1] & near))
    ends = np.flatnonzero(holds & ~np.append(holds[1:] & near, False))
    begins, counts = ts[starts].copy(), ends - starts + 1
    if carried:
        begins[0], counts[0] = begin, counts[0] + count - 1
    following = np.append(np.where(near, ts[1:], ts[:-1] + idle), ts[-1] + idle)
    runs = list(zip(begins.tolist(), following[ends].tolist(), counts.tolist(), strict=True))
    if len(ends) and ends[-1] == len(ts) - 1:
        return runs[:-1], (runs[-1][0], runs[-1][2], int(ts[-1]))
    return runs, None


class _Runs(StatefulProcessor):
    """Per recording: rows that the watermark has not reached, and the open run. Timers close what waits."""

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "begin long, rows long, last long")
        self.waiting = handle.getListState("waiting", "ts long, holds boolean")

    def _advance(self, key: tuple, rows: list[tuple[int, bool]], watermark_us: int) -> pd.DataFrame:
        rows.sort()
        ready = [r for r in rows if r[0] <= watermark_us]
        rest = rows[len(ready) :]
        carried = self.open.get() if self.open.exists() else None
        found, carried = closed_runs(np.array([r[0] for r in ready], np.int64), np.array([r[1] for r in ready], bool), self.idle, tuple(carried) if carried else None)
        if carried and carried[2] + self.idle <= watermark_us:
            found, carried = [*found, (carried[0], carried[2] + self.idle, carried[1])], None
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        else:
            self.waiting.clear()
        if carried:
            self.open.update(carried)
            self.handle.registerTimer(-(-(carried[2] + self.idle) // 1000))
        else:
            self.open.clear()
        return pd.DataFrame([(key[0], *r) for r in found], columns=["recording", "start_us", "end_us", "length"])

    def _held(self) -> list[tuple[int, bool]]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = [(int(t), bool(h)) for pdf in rows for t, h in zip(pdf["us"], pdf["holds"], strict=True)]
        yield self._advance(key, self._held() + fresh, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._advance(key, self._held(), timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def live_runs(stream: DataFrame, late: str, idle_seconds: float) -> DataFrame:
    """Closed runs of ``holds`` per recording (recording, ts, holds), by event time: start, end and length.

    Rows count in the order of their times, once the watermark has reached them, however micro-batches cut the stream. A run ends at
    the next row that does not hold, or ``idle_seconds`` after its last row if none comes by then: a recording that falls
    silent gives its open run when the watermark passes, and leaves no state behind. Rows before the watermark are too late.
    """
    rows = stream.withWatermark("ts", late).select("recording", "ts", F.unix_micros("ts").alias("us"), F.coalesce("holds", F.lit(False)).alias("holds"))
    return rows.groupBy("recording").transformWithStateInPandas(_Runs(int(idle_seconds * 1_000_000)), RUNS, "Append", "EventTime")


def without_repeats(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row per key within the watermark; later repeats are dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


#: State of ``live_runs`` needs this store.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Micro-batches after which the newest rows are folded into one table.
FOLD = 16


def _newest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("newest"))
    return best.select(*keys, "newest.*")


def newest_rows(spark: SparkSession, path: str, keys: list[str], by: list[str], upto: int | None = None) -> DataFrame:
    """The newest row per key of what ``keep_newest`` has written: the last folded table and the micro-batches since."""
    parts = spark.read.parquet(f"{path}/batches").withColumn("folded", F.col("folded").cast("string") == "true")
    base = parts.where("folded").agg(F.max("batch")).first()[0]
    parts = parts if upto is None else parts.where(F.col("batch") <= upto)
    since = F.lit(True) if base is None else (F.col("batch") > base) | ((F.col("batch") == base) & F.col("folded"))
    return _newest(parts.where(since).drop("batch", "folded"), keys, by)


def keep_newest(stream: DataFrame, path: str, keys: list[str], by: list[str]) -> None:
    """Runs a stream of results over what there is and keeps the newest per key (greatest ``by``) under ``path``: older jobs never replace newer ones.

    Each micro-batch is cut to its newest rows and written under its number; when a batch is done again after a restart it overwrites
    itself, so nothing counts twice. Every ``FOLD`` batches the newest rows so far become one table. State is what there is on disk:
    no key is kept in memory, and no watermark forgets one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _newest(batch, keys, by).write.mode("overwrite").parquet(f"{path}/batches/batch={number}/folded=false")
        if number % FOLD == FOLD - 1:
            newest_rows(spark, path, keys, by, number).write.mode("overwrite").parquet(f"{path}/batches/batch={number}/folded=true")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, spark: SparkSession, name: str, store: tuple[str, str] | None = None) -> DataFrame:
    """Run a stream over what there is, into a table of the shared folder, and return that table; ``store`` is a setting that holds for this stream alone."""
    path = work_path(spark, name)
    before = spark.conf.get(store[0], None) if store else None
    if store:
        spark.conf.set(*store)
    try:
        running = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    finally:
        if store:
            spark.conf.unset(store[0]) if before is None else spark.conf.set(store[0], before)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
