"""Keyed state over streams of events: stalls and expiry by timers, entries with a time to live, bounded retention, resumed backfills.

Times are those of the events; what has passed is told by the watermark, so that a replay gives the same rows. State lives in RocksDB with
the query's checkpoint and goes on after a restart. Rows of a key without a time are passed over. A micro-batch's rows of one key are
sorted in one task where their order counts (``until``), so that the source's ``maxFilesPerTrigger`` bounds its memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> SparkSession:
    """A session beside the caller's whose streams keep their state in RocksDB."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return own


def _times(rows: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    for part in rows:
        part = part.dropna(subset=["t_ms"])
        if len(part):
            yield part[columns]


class _Timed(StatefulProcessor):
    """State of one row a key, and one timer, moved on by each row."""

    schema = ""

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.schema)

    def close(self) -> None:
        pass

    def keep(self, value: tuple, at: int) -> None:
        self.clear()
        self.state.update(value)
        self.handle.registerTimer(at)

    def clear(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.clear()


class _Stall(_Timed):
    schema = "last long, attempts int"

    def __init__(self, key: str, quiet: int, most: int):
        self.key, self.quiet, self.most = key, quiet, most

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, attempts = self.state.get() if self.state.exists() else (None, 0)
        done = None
        for part in _times(rows, ["t_ms", "done"]):
            last = max(int(part["t_ms"].max()), last if last is not None else -(1 << 62))
            ends = part.loc[part["done"], "t_ms"]
            done = max([int(ends.max())] + ([done] if done is not None else [])) if len(ends) else done
        if last is None:
            return
        if done is not None and done >= last:
            self.clear()
        else:
            self.keep((last, attempts), last + self.quiet)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        (last, attempts), now, out = self.state.get(), timerValues.getCurrentWatermarkInMs(), []
        while last + self.quiet <= now and attempts <= self.most:
            last, attempts = last + self.quiet, attempts + 1  # to queue it again is news as well
            out.append((key[0], "requeue" if attempts <= self.most else "fail", attempts, last))
        if attempts > self.most:
            self.clear()
        else:
            self.keep((last, attempts), last + self.quiet)
        if out:
            yield pd.DataFrame(out, columns=[self.key, "action", "attempt", "at_ms"])


class _Expiry(_Timed):
    schema = "born long, last long, budget double"

    def __init__(self, key: str, share: float, floor: int, stale: int):
        self.key, self.share, self.floor, self.stale = key, share, floor, stale

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        born, last, budget = self.state.get() if self.state.exists() else (1 << 62, -(1 << 62), 0.0)
        for part in _times(rows, ["t_ms", "budget"]):
            born, last, budget = min(born, int(part["t_ms"].min())), max(last, int(part["t_ms"].max())), budget + float(part["budget"].sum())
        if born < 1 << 62:
            self.keep((born, last, budget), max(born + max(int(budget * self.share * 1000), self.floor), last + self.stale))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            self.clear()
            yield pd.DataFrame({self.key: [key[0]], "expired_ms": [expiredTimerInfo.getExpiryTimeInMs()]})


class _Until(_Timed):
    schema = "until long"

    def __init__(self, span: int):
        self.span = span

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(_times(rows, ["t_ms", "event_id", "sets"]))
        if not parts:
            return
        part = pd.concat(parts).sort_values(["t_ms", "event_id"], kind="stable")
        until, inside = self.state.get()[0] if self.state.exists() else None, []
        for t, sets in zip(part["t_ms"].tolist(), part["sets"].tolist()):
            inside.append(until is not None and t <= until)
            if not inside[-1] and sets:
                until = t + self.span
        if until is not None:
            self.keep((until,), until + 1)
        yield pd.DataFrame({"event_id": part["event_id"], "inside": inside})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        yield from ()


class _Newest(StatefulProcessor):
    def __init__(self, key: str, most: int):
        self.key, self.most = key, most

    def init(self, handle) -> None:
        self.entries = handle.getListState("entries", "event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [int(e[0]) for e in self.entries.get()] if self.entries.exists() else []
        for part in rows:  # no more than the bound and one part at a time
            held = sorted(held + [int(i) for i in part["event_id"]])
            gone, held = held[: max(len(held) - self.most, 0)], held[max(len(held) - self.most, 0) :]
            if gone:
                yield pd.DataFrame({self.key: [key[0]] * len(gone), "event_id": gone})
        self.entries.put([(i,) for i in held])

    def close(self) -> None:
        pass


def _timed(stream: DataFrame, key: str, delay: str, **columns: Column) -> DataFrame:
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return rows.select(key, "ts", "event_id", F.unix_millis("ts").alias("t_ms"), *(c.alias(n) for n, c in columns.items()))


def _kind(stream: DataFrame, key: str) -> str:
    return f"{key} {dict(stream.dtypes)[key]}"


def stalled(stream: DataFrame, key: str, done: Column, minutes: int, most: int, delay: str = "0 seconds") -> DataFrame:
    """key, action, attempt, at_ms: without a row for ``minutes`` a key is queued again, ``most`` times, then failed and forgotten; a row
    where ``done`` holds, and none after it, ends the watch. Nothing need arrive for the key: the other keys' rows move the time on."""
    rows = _timed(stream, key, delay, done=F.coalesce(done, F.lit(False)))
    return rows.groupBy(key).transformWithStateInPandas(_Stall(key, minutes * 60_000, most), f"{_kind(stream, key)}, action string, attempt int, at_ms long", "Append", "EventTime")


def expired(stream: DataFrame, key: str, budget: Column, share: float, floor: int, stale: int, delay: str = "0 seconds") -> DataFrame:
    """key, expired_ms: older than ``share`` of its budgets' sum in seconds (``floor`` at least) and without a row for ``stale`` seconds."""
    rows = _timed(stream, key, delay, budget=F.coalesce(budget, F.lit(0.0)).cast("double"))
    return rows.groupBy(key).transformWithStateInPandas(_Expiry(key, share, floor * 1000, stale * 1000), f"{_kind(stream, key)}, expired_ms long", "Append", "EventTime")


def until(stream: DataFrame, key: str, sets: Column, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """event_id, inside: whether the row falls within ``seconds`` of the last row outside for which ``sets`` held.

    With ``sets`` true throughout this is a cache: a miss stores the key, a hit doesn't renew it. With the failures of a job it is their
    cooldown: a key that failed is passed over, then tried again. State goes when its time is over.
    """
    rows = _timed(stream, key, delay, sets=F.coalesce(sets, F.lit(False)))
    return rows.groupBy(key).transformWithStateInPandas(_Until(seconds * 1000), "event_id long, inside boolean", "Append", "EventTime")


def retired(stream: DataFrame, key: str, most: int) -> DataFrame:
    """key, event_id of what leaves a key's list of the ``most`` newest ids; what is not retired is held."""
    return stream.select(key, "event_id").where("event_id IS NOT NULL").groupBy(key).transformWithStateInPandas(_Newest(key, most), f"{_kind(stream, key)}, event_id long", "Append", "None")


def backfill(stream: DataFrame, out: str, checkpoint: str, run: int, written: Callable[[int], None] = lambda batch: None, rows_a_file: int = 0) -> None:
    """Takes what is new to ``checkpoint`` into ``out``, a folder a micro-batch (``batch=k``), with the number of this run.

    A batch that was written but not committed is written again in its place, so that a run that is killed in between leaves each row
    once. ``written`` is called between the write and the commit. ``rows_a_file`` bounds the rows of a file, as of a flushed buffer.
    """

    def sink(rows: DataFrame, batch: int) -> None:
        rows.withColumn("run", F.lit(run)).write.option("maxRecordsPerFile", rows_a_file).mode("overwrite").parquet(f"{out}/batch={batch}")
        written(batch)

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
