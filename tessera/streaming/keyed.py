"""Keyed state with variables of its own, event-time timers and time to live, on the RocksDB state store."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB (off heap, spilling to disk, changelog in the checkpoint), as state variables need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def merge_sessions(sessions: list[tuple], gap: int) -> list[tuple]:
    """(start, end, n, total) in order, those united that are at most ``gap`` apart."""
    out: list[tuple] = []
    for start, end, n, total in sorted(sessions):
        if out and start - out[-1][1] <= gap:
            s, e, m, t = out[-1]
            out[-1] = (s, max(e, end), m + n, t + total)
        else:
            out.append((start, end, n, total))
    return out


class SessionTimers(StatefulProcessor):
    """Sessions of one key: the open ones and how many have closed in a value, how many of each size in a map.

    Events may come in any order within the watermark's delay, so several sessions can be
    open at once and one event can unite two. A session is emitted once the watermark has passed
    its end by more than the gap, when no event can join it any more. A key has one timer, for the session
    that is due first; when it rings all that are due close together, so a batch costs a key a few
    calls to its state, however many sessions it holds.
    """

    def __init__(self, key: str, gap_micros: int, remembered: int = 3):
        self.key, self.gap, self.remembered = key, gap_micros, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sizes = handle.getMapState("sizes", "n bigint", "closed bigint")
        self.key_state = handle.getValueState("key", "closed bigint, timer bigint, open array<struct<start:bigint,end:bigint,n:bigint,total:double>>, lengths array<bigint>")

    def _timer(self, end: int) -> int:
        return -(-(end + self.gap) // 1000) + 1

    def _keep(self, sessions: list[tuple], lengths: list[int], closed: int, timer: int) -> None:
        """Store the open sessions and set the timer of the first that is due."""
        first = min((self._timer(s[1]) for s in sessions), default=0)
        if first != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if first:
                self.handle.registerTimer(first)
        self.key_state.update((closed, first, sessions, lengths))

    def _state(self) -> tuple[list[tuple], list[int], int, int]:
        known = self.key_state.get()
        return ([tuple(x) for x in known[2]], list(known[3]), known[0], known[1]) if known else ([], [], 0, 0)

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:
        sessions, lengths, closed, timer = self._state()
        fresh = [(int(us), int(us), 1, float(v)) for frame in rows for us, v in zip(frame["us"], frame["value"].fillna(0.0))]
        self._keep(merge_sessions(sessions + fresh, self.gap), lengths, closed, timer)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        sessions, lengths, closed, _ = self._state()
        mark = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        due = sorted(s for s in sessions if self._timer(s[1]) <= mark)
        sizes, out = {}, []
        for start, end, n, total in due:
            closed += 1
            lengths = [*lengths, end - start][-self.remembered :]
            if n not in sizes:
                sizes[n] = (self.sizes.getValue((n,)) or (0,))[0]
            sizes[n] += 1
            out.append((key[0], closed, start, end, n, total, sum(lengths) / len(lengths), sizes[n]))
        for n, many in sizes.items():
            self.sizes.updateValue((n,), (many,))
        self._keep([s for s in sessions if self._timer(s[1]) > mark], lengths, closed, 0)  # the timer that rang is gone
        if out:
            yield pd.DataFrame(out, columns=[self.key, "session", "start_us", "end_us", "n", "total", "recent_us", "same_size"])

    def close(self) -> None:
        pass


def timed_sessions(df: DataFrame, key: str, gap_seconds: int, column: str = "ts", value: str = "value") -> DataFrame:
    """Closed sessions of a watermarked stream: key, session (1, 2, ... per key), start_us, end_us, n, total, recent_us (mean length of
    the last three), same_size (how many of as many events the key has closed so far).

    Rows without a key or time are left out; a null value counts as zero. Run it inside rocksdb_state().
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.filter(F.col(key).isNotNull() & F.col(column).isNotNull()).withColumn("us", F.unix_micros(column)).select(key, column, "us", F.col(value).cast("double").alias("value"))
    schema = f"`{key}` {kind}, session bigint, start_us bigint, end_us bigint, n bigint, total double, recent_us double, same_size bigint"
    return rows.groupBy(key).transformWithStateInPandas(SessionTimers(key, gap_seconds * 1_000_000), schema, "Append", "EventTime")


class FirstSeen(StatefulProcessor):
    """Emits a key when it comes up for the first time, or again after its time to live has run out since the last time it was emitted."""

    def __init__(self, key: str, ttl_ms: int):
        self.key, self.ttl_ms = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n bigint", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        n = sum(len(frame) for frame in rows)
        if not self.seen.exists():
            self.seen.update((n,))
            yield pd.DataFrame({self.key: [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def first_seen(df: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """(key, n) once per key and time to live (processing time), n being its rows in the batch; forgotten keys free their state.

    Spark plans batches for processing time without end, so stop such a query: an availableNow trigger would never finish.
    """
    kind = df.schema[key].dataType.simpleString()
    return df.filter(F.col(key).isNotNull()).select(key).groupBy(key).transformWithStateInPandas(FirstSeen(key, ttl_ms), f"`{key}` {kind}, n bigint", "Append", "ProcessingTime")
