"""Keyed state over streams: the trigger that fires once per token, and timers for social readings.

State is one small value per key in the RocksDB state store, kept in the stream's checkpoint folder,
so a batch costs what it holds, whatever was seen before, and a restart goes on where the last batch
ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidewatch.operators import social, trigger

TOKEN = ("chain", "contract")
MINUTE = 60_000
#: Tokens that a task holds while it reduces a batch to each token's earliest firing row.
HELD = 100_000
#: How long after a snapshot its readings are remembered.
REMEMBERED_MS = 7 * 24 * 60 * MINUTE

_FIRST = (
    "chain string, contract string, observed_at_ms bigint, pos bigint, trigger_kind string, "
    "mcap_usd double, holder_count bigint"
)
_READ = (
    "snapshot_id string, platform string, offset_minutes bigint, age_minutes bigint, "
    "mentions_window bigint, late boolean, error string"
)
_READ_NAMES = [field.split()[0] for field in _READ.split(", ")]


def with_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store."""
    name = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", name)


def earliest_in_task(firing: DataFrame) -> DataFrame:
    """At most one row per token and task (more if a task meets over ``HELD`` tokens): the earliest.

    A token that holds most of a batch then reaches its state as a handful of rows.
    """
    kind, names = to_arrow_schema(StructType.fromDDL(_FIRST)), StructType.fromDDL(_FIRST).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict] = {}
        for b in batches:
            for row in b.to_pylist():
                token = row["chain"], row["contract"]
                known = held.get(token)
                if known is None or (row["observed_at_ms"], row["pos"]) < (known["observed_at_ms"], known["pos"]):
                    held[token] = row
            if len(held) > HELD:
                yield pa.RecordBatch.from_pylist(list(held.values()), schema=kind)
                held = {}
        yield pa.RecordBatch.from_pylist(list(held.values()), schema=kind)

    ordered = firing.where("observed_at_ms is not null and pos is not null").select(*names)
    return ordered.mapInArrow(run, _FIRST)


class FireOnce(StatefulProcessor):
    """One flag per token: the first batch with a firing row passes its earliest one on, later ones
    pass nothing. With a time-to-live a flag is forgotten that long after it was set."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fired = handle.getValueState("fired", "observed_at_ms bigint", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: (r.observed_at_ms, r.pos))
        if not self.fired.exists():
            self.fired.update((first.observed_at_ms,))
            yield first

    def close(self) -> None:
        pass


def fired_once(observations: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """The first firing observation of each token of a stream, once ever (or once per ``keep_ms`` of
    processing time).

    Batches are taken in their order: of tokens met in several batches the earliest batch decides.
    With ``keep_ms`` Spark wakes the stream again and again to expire state, so a run over what has
    landed (``availableNow``) would not end; give it an interval, or ``once``.
    """
    with_state_store(observations.sparkSession)
    reduced = earliest_in_task(trigger.decide(observations).where("fired"))
    return reduced.groupBy(*TOKEN).transformWithState(
        FireOnce(keep_ms), _FIRST, "Append", "None" if keep_ms is None else "ProcessingTime"
    )


def _reading(key: tuple, *values) -> Row:
    return Row(**dict(zip(_READ_NAMES, (*key, *values))))


class Readings(StatefulProcessor):
    """The readings of one (snapshot, platform), and a row for each offset that had none in time.

    The snapshot sets a timer per offset, at the offset plus its tolerance in event time; a reading
    taken by then, failed or not, takes the timer away. A timer that goes off writes the missed row.
    A later reading is still written, marked late. Each offset's reading is written once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("offsets", "ts bigint, written int, in_time int, armed boolean")

    @staticmethod
    def _due(ts: int, k: int) -> int:
        # The minute of the tolerance itself is still in time.
        return ts + (social.OFFSETS[k] + social.TOLERANCE + 1) * MINUTE

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = [r for r in rows if r.ts is not None]
        if not rows:
            return
        ts, written, in_time, armed = self.state.get() if self.state.exists() else (None, 0, 0, False)
        announced = armed
        order = lambda r: (r.offset_minutes is not None, r.offset_minutes or 0, r.age_minutes or 0)
        for r in sorted(rows, key=order):
            ts = r.ts
            if r.offset_minutes is None:
                announced = True
            elif r.offset_minutes in social.OFFSETS:
                k = social.OFFSETS.index(r.offset_minutes)
                late = r.age_minutes - r.offset_minutes > social.TOLERANCE
                if not late and not in_time >> k & 1:
                    in_time |= 1 << k
                    if armed:
                        self.handle.deleteTimer(self._due(ts, k))
                if not written >> k & 1:
                    written |= 1 << k
                    yield _reading(key, r.offset_minutes, r.age_minutes, r.mentions_window, late, r.error)
        if announced and not armed:
            for k in range(len(social.OFFSETS)):
                if not in_time >> k & 1:
                    self.handle.registerTimer(self._due(ts, k))
            self.handle.registerTimer(ts + REMEMBERED_MS)
        self.state.update((ts, written, in_time, announced))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        ts, at = self.state.get()[0], expiredTimerInfo.getExpiryTimeInMs()
        if at == ts + REMEMBERED_MS:
            self.state.clear()
            return
        for k, offset in enumerate(social.OFFSETS):
            if self._due(ts, k) == at:
                yield _reading(key, offset, offset + social.TOLERANCE + 1, None, True, "missed")

    def close(self) -> None:
        pass


def readings_with_misses(feed: DataFrame, lateness: str) -> DataFrame:
    """(snapshot, platform, offset) rows of a feed of snapshots and readings, with missed rows.

    ``feed``: snapshot_id, platform, ts, offset_minutes (null in a snapshot's announcement),
    age_minutes, mentions_window, error, event_ms. Rows may come in any order within ``lateness``; a
    missed row is written once the stream's event time, less the lateness, has passed the offset's
    tolerance. A row without ``ts`` is a tick that only tells the time.
    """
    with_state_store(feed.sparkSession)
    timed = feed.withColumn("at", F.timestamp_millis("event_ms")).withWatermark("at", lateness)
    # Ticks are left to the processor: a filter would be moved below the watermark.
    return timed.groupBy("snapshot_id", "platform").transformWithState(
        Readings(), _READ, "Append", "EventTime"
    )
