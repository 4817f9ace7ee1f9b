"""The session fold and the day calendar over streams.

A stream of events gives the sessions that the batch fold gives. Events wait in state until the
watermark has passed them, so that those up to ``late`` behind are still put in the order of
the log; what comes later than that is dropped and counted by Spark. An open session is closed by an event,
as in the batch, or when the watermark is ``idle`` beyond its last event, which is the longest a session lasts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from playloom.functions.core import DAY_MS, LONGEST_S
from playloom.operators.ingest import Snapshots
from playloom.operators.reconstruct import ORDER, SESSION, Fold

#: Sessions last at most 31 days and offsets move them by at most two: later than that, a day is final.
FINAL = "33 days"
#: The state store that ``stream_sessions`` needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
EVENT = "kind string, detail string, local_ms long, source_id string, source_order int, line_number long, event_order int, score int, hint_ms long"
_FIELDS = [field.split()[0] for field in EVENT.split(", ")]


_NUMBERS = [field.endswith((" long", " int")) for field in EVENT.split(", ")]


def _plain(event: tuple) -> tuple:
    """The event with Python's own numbers, and None for what is missing: pandas gives floats and NaN."""
    return tuple(None if pd.isna(v) else int(v) if number else v for v, number in zip(event, _NUMBERS))


class SessionProcessor(StatefulProcessor):
    """State of an instance: the open session, and events that the watermark has not passed yet."""

    def __init__(self, idle_s: int):
        self.idle_ms = idle_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "fold string")
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [tuple(row) for row in self.waiting.get()]
        for part in rows:
            events += map(_plain, part[_FIELDS].itertuples(index=False, name=None))
        yield from self._advance(key, events, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [tuple(row) for row in self.waiting.get()], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, events: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        """Folds the events before the first one, in the log's order, that is beyond the watermark."""
        place = [_FIELDS.index(c) for c in ORDER]
        events.sort(key=lambda e: tuple(e[k] for k in place))
        at = _FIELDS.index("local_ms")
        ready = next((k for k, e in enumerate(events) if e[at] is not None and e[at] > watermark), len(events))
        fold = Fold(json.loads(self.open.get()[0]) if self.open.exists() else None)
        for kind, detail, ms, source, _, line, order, score, hint in events[:ready]:
            fold.take(kind, detail, ms, source, hint, line, order, score)
        rest = events[ready:]
        if not rest and fold.now is not None and watermark > fold.now.last_ms + self.idle_ms:
            fold.end()
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if fold.now is not None:
            self.open.update((json.dumps(fold.state()),))
        else:
            self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.handle.registerTimer(min(e[at] for e in rest if e[at] is not None))
        elif fold.now is not None:
            self.handle.registerTimer(fold.now.last_ms + self.idle_ms + 1)
        if fold.done:
            out = pd.DataFrame(fold.done)
            out.insert(0, "instance_id", key[0])
            yield out

    def close(self) -> None:
        pass


def stream_sessions(events: DataFrame, late: str = "10 minutes", idle_s: int = LONGEST_S) -> DataFrame:
    """Closed sessions from a stream of events (instance_id and the columns of ``EVENT``). The session needs ``STATE_STORE``."""
    timed = events.withColumn("at", F.timestamp_millis("local_ms")).withWatermark("at", late)
    kind = events.schema["instance_id"].dataType.simpleString()
    return timed.groupBy("instance_id").transformWithStateInPandas(SessionProcessor(idle_s), f"instance_id {kind}, {SESSION}", "append", "eventTime")


def day_slices(start_ms: Column, end_ms: Column, offset_min: Column) -> Column:
    """The days a session touches with its whole seconds on each: array<struct<day_ms, seconds>>, cut at local midnight."""
    shift = F.coalesce(offset_min, F.lit(0)).cast("long") * 60_000
    begin, end = start_ms + shift, F.greatest(end_ms, start_ms) + shift
    days = F.sequence(F.floor(begin / DAY_MS), F.floor(F.greatest(begin, end - 1) / DAY_MS))

    def one(day: Column) -> Column:
        low, high = F.greatest(begin, day * DAY_MS), F.least(end, (day + 1) * DAY_MS)
        return F.struct((day * DAY_MS).alias("day_ms"), F.floor(F.greatest(high - low, F.lit(0)) / 1000).alias("seconds"))

    return F.transform(days, one)


def stream_days(sessions: DataFrame, offset_min: int = 0) -> DataFrame:
    """day, instance_id, seconds, slices from a stream of closed sessions; a day is given once no session can reach it any more."""
    cut = sessions.select("instance_id", F.inline(day_slices(F.col("start_ms"), F.col("end_ms"), F.lit(offset_min))))
    at = cut.withColumn("at", F.timestamp_millis("day_ms")).withWatermark("at", FINAL)
    per = at.groupBy(F.window("at", "1 day").alias("window"), "instance_id").agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("slices"))
    return per.select(F.to_date("window.start").alias("day"), "instance_id", "seconds", "slices")


def promote_batch(rows: DataFrame, number: int, snapshots: Snapshots, fence: int | None = None) -> None:
    """Adds a micro-batch to the table ``sessions``: files for its rows alone. A batch that is run again adds nothing."""
    if snapshots.note().get("batch", -1) >= number or rows.isEmpty():
        return
    snapshots.commit({}, fence, append={"sessions": rows}, note={"batch": number})


def promote_stream(sessions: DataFrame, snapshots: Snapshots, checkpoint: str, fence: int | None = None):
    """Appends each micro-batch of sessions to the snapshot tables, in one pass over what is there."""
    writer = sessions.writeStream.foreachBatch(lambda rows, number: promote_batch(rows, number, snapshots, fence))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """What the streams of a session have done: rows read, rows dropped as too late, rows in state, by name of the query."""

    def __init__(self):
        self.seen: dict[str, dict[str, int]] = {}
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.seen[event.name or str(event.id)] = {"batches": 0, "rows": 0, "late": 0, "state": 0}

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        own = self.seen.setdefault(progress.name or str(progress.id), {"batches": 0, "rows": 0, "late": 0, "state": 0})
        own["batches"] += 1
        own["rows"] += progress.numInputRows
        own["late"] += sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        own["state"] = sum(s.numRowsTotal for s in progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception


class Run:
    """A named piece of batch work that another thread can cancel."""

    def __init__(self, spark: SparkSession, name: str):
        self.context, self.name = spark.sparkContext, name

    def __enter__(self) -> Run:
        self.context.setJobGroup(self.name, self.name, interruptOnCancel=True)
        return self

    def __exit__(self, *_) -> None:
        self.context.setLocalProperty("spark.jobGroup.id", None)

    def cancel(self) -> None:
        self.context.cancelJobGroup(self.name)
