"""Streaming TTL duplicates (T3) and the hourly figures over them (T2 after T3), as chained
``transformWithState`` operators with one checkpoint.

``Buffer`` (key: slice of event time and one of ``BUCKETS`` by a row's id) only waits:
rows are appended to a typed list, never rewritten, until the watermark has passed the
end of their slice; then the list is emitted in event-time order and cleared.  What a
state costs to open, append to, time and clear is paid by bucket of a slice, however many
keys it has, and a busy key's waiting rows are many small states, dealt over all tasks.
``TtlFold`` (key: message key) sees every row once, in order, and keeps nothing but the
last miss.  ``HourTotals`` (key: hour) adds up and emits an hour when the watermark has
passed it.

Rows leave an operator after the watermark has passed their own time, so the event time
that is carried on (``settled_at``) is the first instant behind the watermark; their own
time stays in ``us``.  All state is in RocksDB; timers are event-time timers.
"""

from __future__ import annotations

import datetime
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import lexicon as L

US = 1_000_000
#: States that the waiting rows of a slice are dealt over.
BUCKETS = 8
#: Width of a slice of event time: a row is settled at most this long after the
#: watermark has passed it.  Divides an hour.
SLICE_SECONDS = 600
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ROW = "us long, msg_id long, event_type string, latency_ms double"
_WAITING = f"{_ROW}, msg_key string"
BUFFERED = f"settled_at timestamp, {_WAITING}"
SETTLED = f"msg_key string, settled_at timestamp, {_ROW}, is_hit boolean"
TOTALS = ("msg_key string, settled_at timestamp, hour_us long, requests long, errors long, latency_ns long, "
          "hits long, misses long")
HOURS = "hour_us long, requests long, errors long, latency_ns long, hits long, misses long"


def _row(schema: str) -> Row:
    """A Row with the field names of a schema, to be filled in order."""
    return Row(*[f.split()[0] for f in schema.split(", ")])


_BUFFERED_ROW, _SETTLED_ROW, _TOTALS_ROW, _HOURS_ROW = map(_row, (BUFFERED, SETTLED, TOTALS, HOURS))


def use_rocksdb(spark) -> None:
    """``transformWithState`` needs the RocksDB store; a session that names another keeps
    it, and Spark then says so."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(name, "HDFSBacked"):
        spark.conf.set(name, ROCKSDB)


def _behind(timer_values) -> datetime.datetime:
    """The first instant behind the watermark."""
    ms = timer_values.getCurrentWatermarkInMs() + 1
    return datetime.datetime.fromtimestamp(ms // 1000, datetime.UTC) + datetime.timedelta(milliseconds=ms % 1000)


def ttl_fold(us: list[int], last: int | None, ttl_us: int) -> tuple[list[bool], int | None]:
    """Hits of one key's rows in event-time order after a last miss: from a miss, the
    next one is the first row a TTL later (binary search); what lies between is hits."""
    hit = [True] * len(us)
    at = 0 if last is None else bisect_left(us, last + ttl_us)
    while at < len(us):
        hit[at], last = False, us[at]
        at = bisect_left(us, last + ttl_us, at)
    return hit, last


class Buffer(StatefulProcessor):
    """Rows of one (slice, bucket) until the watermark has passed the slice."""

    def __init__(self, slice_seconds: int = SLICE_SECONDS):
        self.slice_ms = slice_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", _WAITING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = not self.rows.exists()
        self.rows.appendList([(r.us, r.msg_id, r.event_type, r.latency_ms, r.msg_key) for r in rows])
        if fresh:
            self.handle.registerTimer((key[0] + 1) * self.slice_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = _behind(timerValues)
        rows = sorted(self.rows.get(), key=lambda r: r[0])
        self.rows.clear()
        for r in rows:
            yield _BUFFERED_ROW(at, *r)

    def close(self) -> None:
        pass


class TtlFold(StatefulProcessor):
    """Hits and misses of one key's rows, which come slice by slice."""

    def __init__(self, ttl_seconds: int, slice_seconds: int = SLICE_SECONDS):
        self.ttl_us, self.slice_ms = ttl_seconds * US, slice_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_miss", "us long")

    def settled(self, rows: Iterator[Row]) -> list[tuple[Row, bool]]:
        """The rows of this batch in order, with their verdicts; moves the last miss on."""
        ordered = sorted(rows, key=lambda r: (r.us, r.msg_id))
        before = self.last.get()
        hit, last = ttl_fold([r.us for r in ordered], None if before is None else before[0], self.ttl_us)
        if before is None or last != before[0]:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.last.update((last,))
            # rows still to come may be a slice older than the watermark
            self.handle.registerTimer((last + self.ttl_us) // 1000 + self.slice_ms)
        return list(zip(ordered, hit, strict=True))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at = _behind(timerValues)
        for r, hit in self.settled(rows):
            yield _SETTLED_ROW(key[0], at, r.us, r.msg_id, r.event_type, r.latency_ms, hit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


HOUR_US = 3600 * US


class TtlTotals(TtlFold):
    """As ``TtlFold``, but emits a key's sums per hour: what is combined before the shuffle by hour."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, sums = _behind(timerValues), {}
        for r, hit in self.settled(rows):
            s = sums.setdefault(r.us // HOUR_US * HOUR_US, [0] * 5)
            s[0] += 1
            if r.event_type == "error":
                s[1] += 1
            else:
                s[2] += r.latency_ns or 0
                s[3 if hit else 4] += 1
        for hour, s in sums.items():
            yield _TOTALS_ROW(key[0], at, hour, *s)


class HourTotals(StatefulProcessor):
    """Sums of one hour over all keys, emitted once ``delay_seconds`` after it in watermark time."""

    def __init__(self, delay_seconds: int):
        self.delay_ms = delay_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "requests long, errors long, latency_ns long, hits long, misses long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.sums.get()
        if held is None:
            self.handle.registerTimer((key[0] + HOUR_US) // 1000 + self.delay_ms)
        total = list(held or [0] * 5)
        for r in rows:
            for i, v in enumerate((r.requests, r.errors, r.latency_ns, r.hits, r.misses)):
                total[i] += v
        self.sums.update(tuple(total))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        total = self.sums.get()
        self.sums.clear()
        yield _HOURS_ROW(key[0], *total)

    def close(self) -> None:
        pass


def buffered(events: DataFrame, watermark: str, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``events`` (msg_key, ts timestamp, msg_id, event_type, latency_ms) once the watermark
    has passed their slice of event time."""
    use_rocksdb(events.sparkSession)
    rows = (events.withWatermark("ts", watermark).withColumn("us", F.unix_micros("ts"))
            .withColumn("slice", F.floor(F.col("us") / F.lit(slice_seconds * US)))
            .withColumn("bucket", F.pmod(F.xxhash64("msg_id"), F.lit(BUCKETS))))
    return rows.groupBy("slice", "bucket").transformWithState(
        Buffer(slice_seconds), BUFFERED, "append", "eventTime", eventTimeColumnName="settled_at")


def settled(events: DataFrame, watermark: str, ttl_seconds: int = L.CACHE_TTL_SECONDS,
            slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Every row of ``events`` that the watermark has passed, with ``is_hit``."""
    return buffered(events, watermark, slice_seconds).groupBy("msg_key").transformWithState(
        TtlFold(ttl_seconds, slice_seconds), SETTLED, "append", "eventTime", eventTimeColumnName="settled_at")


def hourly(events: DataFrame, watermark: str, latency_ns, ttl_seconds: int = L.CACHE_TTL_SECONDS,
           slice_seconds: int = SLICE_SECONDS, delay_seconds: int = 600) -> DataFrame:
    """T2 over T3 in one query: sums of every hour that the watermark has passed by
    ``delay_seconds``; ``latency_ns`` gives a row's latency as whole nanoseconds."""
    rows = buffered(events, watermark, slice_seconds).withColumn("latency_ns", latency_ns(F.col("latency_ms")))
    totals = rows.groupBy("msg_key").transformWithState(
        TtlTotals(ttl_seconds, slice_seconds), TOTALS, "append", "eventTime", eventTimeColumnName="settled_at")
    return totals.groupBy("hour_us").transformWithState(HourTotals(delay_seconds), HOURS, "append", "eventTime")
