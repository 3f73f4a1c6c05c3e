"""Calls as keyed state of a stream: claims and guarded transitions from value state, the reaper from event-time timers, resumption from the
state of both streams, or by a join of them where calls have no numbers.

All of it can stop and go on from its checkpoint. State lives in RocksDB on the executors and in the checkpoint folder; the
session that runs a stream is its own, so no other query's settings change.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from talkgrain.operators.lifecycle import LEGAL, MAX_RETRIES, STALE_SECONDS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams with state."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a batch saves its changes, not whole files of state
    own.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")  # a joined partition has one store, not four
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


#: 2 to this power neighbouring calls share a state, which is read and written once a batch: Spark spends over a millisecond on each key, whatever its rows.
SHARED_BITS = 8


def _together(events: DataFrame, *columns: str) -> DataFrame:
    """The columns, and as `calls` the number of each call's group."""
    return events.select(*columns, F.shiftright("call_id", SHARED_BITS).alias("calls"))


class CallLog(StatefulProcessor):
    """Events of calls (call_id, us, event_id, status) in their order: attempt (from 1), whether it won the claim, the status before and whether the step is legal.

    An event that is not after the last one seen of its call is a repeated delivery and says nothing, so each event counts
    once. A batch's events of a group of calls are sorted in memory.
    """

    row = Row("event_id", "call_id", "attempt", "won", "status", "previous", "legal")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "calls array<long>, attempts array<long>, status array<string>, us array<long>, event_id array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        log: dict[int | None, list] = {}
        for call, us, event_id, now, *_ in rows:
            log.setdefault(call, []).append((us, event_id, now))
        stored = self.last.get()
        last = {call: x for call, *x in zip(*stored)} if stored else {}
        for call, events in log.items():
            attempts, status, *seen = last.get(call, (0, None))
            for us, event_id, now in sorted(events):
                if seen and [us, event_id] <= seen:
                    continue
                attempts += 1
                yield self.row(event_id, call, attempts, attempts == 1, now, status, None if attempts == 1 else (status, now) in LEGAL)
                status, seen = now, [us, event_id]
            last[call] = [attempts, status, *seen]
        self.last.update(tuple(map(list, zip(*((call, *x) for call, x in last.items())))))

    def close(self) -> None:
        pass


def transitions(events: DataFrame) -> DataFrame:
    """A stream of events (event_id, call_id, at, status) through CallLog."""
    schema = "event_id long, call_id long, attempt long, won boolean, status string, previous string, legal boolean"
    log = _together(events.withColumn("us", F.unix_micros("at")), "call_id", "us", "event_id", "status")
    return log.groupBy("calls").transformWithState(CallLog(), schema, "append", "none")


class Reaper(StatefulProcessor):
    """A call that stays queued or processing for STALE_SECONDS of event time is requeued, released or failed; a later event of the call winds its time again.

    A group of calls has one timer, at the first time that a waiting call of it is due. A call that the watermark has passed is
    forgotten: older events of it come too late.
    """

    row = Row("call_id", "status", "action")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "timer long, calls array<long>, due array<long>, status array<string>, attempts array<long>")

    def stored(self) -> tuple[int | None, dict[int | None, tuple]]:
        timer, *columns = self.state.get() or (None,)
        return timer, {call: tuple(x) for call, *x in zip(*columns)} if columns else {}

    def store(self, timer: int | None, state: dict[int | None, tuple]) -> None:
        """Keeps the calls, with the timer moved to the first that waits; without any, to when all can be forgotten. timer: the one that is set."""
        waiting = [due for due, status, _ in state.values() if status in ("queued", "processing")]
        due = min(waiting) if waiting else max((x[0] for x in state.values()), default=None)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.state.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.state.update((due, *map(list, zip(*((call, *x) for call, x in state.items())))))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        timer, state = self.stored()
        batch: dict[int | None, tuple] = {}
        for call, us, status, attempts, *_ in rows:
            now = us // 1000 + STALE_SECONDS * 1000 + 1, status, attempts  # strictly longer than the limit
            batch[call] = max(batch[call], now) if call in batch else now
        for call, now in batch.items():
            if call not in state or state[call][0] <= now[0]:  # else an older event, delivered late or again
                state[call] = now
        self.store(timer, state)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        _, state = self.stored()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        for call, (due, status, attempts) in state.items():
            if due < now and status in ("queued", "processing"):
                yield self.row(call, status, "requeue" if status == "queued" else "fail" if attempts >= MAX_RETRIES + 1 else "release")
        self.store(None, {call: x for call, x in state.items() if x[0] >= now})  # Spark deletes the timer that has gone off

    def close(self) -> None:
        pass


def reaped(events: DataFrame, late: str) -> DataFrame:
    """A stream of events (call_id, at, status, attempts): what the reaper does to calls that the watermark left behind."""
    watched = events.withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    return _together(watched, "call_id", "us", "status", "attempts", "at").groupBy("calls").transformWithState(Reaper(), "call_id long, status string, action string", "append", "EventTime")


def resumptions(suspended: DataFrame, submissions: DataFrame, late: str, within: str) -> DataFrame:
    """Streams suspended (call_id, at) and submissions (call_id, at, submission_id): each pair of a suspended call and a submission that comes `within` that time, repeated deliveries once; calls without any come with nulls when the watermark has passed them."""
    s = suspended.withWatermark("at", late).dropDuplicatesWithinWatermark(["call_id"]).select(F.col("call_id"), F.col("at").alias("suspended_at"))
    r = submissions.withWatermark("at", late).dropDuplicatesWithinWatermark(["delivery_id"]).select(F.col("call_id").alias("_call"), F.col("at").alias("submitted_at"), "submission_id")
    inside = (F.col("call_id") == F.col("_call")) & (F.col("submitted_at") >= F.col("suspended_at")) & (F.col("submitted_at") <= F.col("suspended_at") + F.expr(f"interval {within}"))
    return s.join(r, inside, "leftOuter").drop("_call")


#: As SHARED_BITS, for groups whose rows are worked off as columns, and the bytes of rows that are packed at a time.
REVIEW_BITS, PACKED_BYTES = 13, 1 << 26
#: What a row of both streams is; other rows only move the watermark.
SUSPENDED, SUBMITTED, SUBMITTED_NULL, NOTHING = range(4)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: list[bytes]) -> pd.DataFrame:
    return pa.concat_tables([pa.ipc.open_stream(bytes(x)).read_all() for x in data]).to_pandas()


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a call_id as one row per group of calls, some bytes at a time: Spark hands a state's rows to Python one by one."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        group = rows["call_id"].to_numpy() >> REVIEW_BITS
        order = np.argsort(group, kind="stable")
        rows, group = rows.take(order).combine_chunks(), group[order]
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[start, len(group)])
        for at in range(0, len(start), 1024):
            blobs = [_packed(rows.slice(i, n).combine_chunks().to_batches()[0]) for i, n in zip(start[at : at + 1024].tolist(), size[at : at + 1024].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(group[start[at : at + 1024]]), pa.array(blobs, pa.binary())], ["calls", "packed"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.nbytes
        if n >= PACKED_BYTES:
            yield from packed(held)
            held, n = [], 0
    if held:
        yield from packed(held)


class Reviews(StatefulProcessor):
    """Packed rows of a group of calls (call_id, us, kind, submission_id, delivery): each pair of a suspended call and a submission that comes within a time, once, as soon as both are there; a call that gets none comes alone when the watermark has passed its time.

    The group's suspended calls and its submissions are packed columns of one value. A delivery is known, and a submission
    waits for its call, until the watermark is `late` past it; what comes later than that is left out. A group's rows are in
    memory while it is worked off.
    """

    def __init__(self, late: int, within: int):
        self.late, self.within = late, within  # in us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "timer long, suspended binary, submitted binary")

    def stored(self) -> tuple[int | None, pd.DataFrame | None, pd.DataFrame | None]:
        timer, *parts = self.state.get() or (None, None, None)
        return timer, *(_unpacked([x]) if x is not None else None for x in parts)

    def store(self, timer: int | None, suspended: pd.DataFrame | None, submitted: pd.DataFrame | None, now: int) -> None:
        """Keeps what the watermark, now, has not passed, with the timer at the end of the first call that still gets none; without any, at when all can be forgotten. timer: the one that is set."""
        ends, last = [], []
        if suspended is not None:
            until = suspended["us"] + max(self.within, self.late)
            suspended = suspended[(until > now) | ~suspended["found"]]
            ends, last = suspended.loc[~suspended["found"], "us"] + self.within, [until.max()]
        if submitted is not None:
            submitted = submitted[submitted["us"] + self.late > now]
            last = [*last, submitted["us"].max() + self.late]
        kept = [x if x is not None and len(x) else None for x in (suspended, submitted)]
        due = None
        if any(x is not None for x in kept):
            due = int(min(ends) if len(ends) else np.nanmax(last)) // 1000 + 1
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.state.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.state.update((due, *(None if x is None else _packed(pa.RecordBatch.from_pandas(x, preserve_index=False)) for x in kept)))

    def pairs(self, suspended: pd.DataFrame, submitted: pd.DataFrame) -> pd.DataFrame:
        """suspended (call_id, us), submitted (call_id, us, kind, submission_id): call_id, us, at (in suspended), submitted, kind, submission_id."""
        right = submitted[submitted["call_id"].isin(suspended["call_id"])]
        left = suspended[["call_id", "us"]].assign(at=np.arange(len(suspended)))
        both = left.merge(right[["call_id", "us", "kind", "submission_id"]].rename(columns={"us": "submitted"}), on="call_id")
        return both[(both["submitted"] >= both["us"]) & (both["submitted"] <= both["us"] + self.within)]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        new = _unpacked([x for f in rows for x in f["packed"]])
        new = new[(new["kind"] != NOTHING) & (new["us"] + self.late > now)]
        if not len(new):
            return
        timer, suspended, submitted = self.stored()
        calls = new["kind"] == SUSPENDED
        more_calls = new.loc[calls, ["call_id", "us"]].sort_values("us", kind="stable").drop_duplicates("call_id").assign(found=False)
        more = new.loc[~calls, ["call_id", "us", "kind", "submission_id", "delivery"]].drop_duplicates("delivery")
        if suspended is not None:
            known = suspended["call_id"][suspended["us"] + self.late > now]
            more_calls = more_calls[~more_calls["call_id"].isin(known)]
        if submitted is not None:
            more = more[~more["delivery"].isin(submitted["delivery"])]
        every_call = more_calls if suspended is None else pd.concat([suspended, more_calls]) if len(more_calls) else suspended
        every_call = every_call.reset_index(drop=True)
        met = [self.pairs(every_call, more)] if len(every_call) and len(more) else []
        if submitted is not None and len(more_calls):
            again = self.pairs(more_calls, submitted)
            met.append(again.assign(at=again["at"] + len(every_call) - len(more_calls)))
        for pairs in met:
            every_call.loc[pairs["at"].to_numpy(), "found"] = True
            if len(pairs):
                yield pairs.drop(columns="at")
        self.store(timer, every_call if len(every_call) else None, more if submitted is None else pd.concat([submitted, more]) if len(more) else submitted, now)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, suspended, submitted = self.stored()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        if suspended is not None:
            over = ~suspended["found"] & (suspended["us"] + self.within <= now)
            if over.any():
                yield suspended.loc[over, ["call_id", "us"]].assign(submitted=0, kind=SUSPENDED, submission_id=None)
            suspended["found"] |= over  # told once, also where it stays known
        self.store(None, suspended, submitted, now)  # Spark deletes the timer that has gone off

    def close(self) -> None:
        pass


def reviews(suspended: DataFrame, submissions: DataFrame, late: dt.timedelta, within: dt.timedelta) -> DataFrame:
    """As resumptions, for calls with whole numbers and deliveries with texts: call_id, suspended_at, submitted_at, submission_id, from a state that REVIEW_BITS neighbouring calls share, where a join of streams reads and writes each row of either by itself. Rows without a call say nothing."""
    us, kind = (lambda x: x // dt.timedelta(microseconds=1)), submissions.schema["submission_id"].dataType.simpleString()
    zero, is_row = F.lit("0").cast(kind), F.col("call_id").isNotNull() & F.col("at").isNotNull()
    whole = [F.coalesce("call_id", F.lit(0)).cast("long").alias("call_id"), F.coalesce(F.unix_micros("at"), F.lit(0)).alias("us")]  # null would turn whole numbers of pandas into doubles

    def rows(stream: DataFrame, what: Column, submission: Column, delivery: Column) -> DataFrame:
        marked = stream.withWatermark("at", f"{late // dt.timedelta(seconds=1)} seconds")
        return marked.select(*whole, F.when(is_row, what).otherwise(NOTHING).cast("int").alias("kind"), submission.alias("submission_id"), delivery.alias("delivery"))

    s = rows(suspended, F.lit(SUSPENDED), zero, F.lit(None).cast("string"))
    r = rows(submissions, F.when(F.col("submission_id").isNull(), SUBMITTED_NULL).otherwise(SUBMITTED), F.coalesce("submission_id", zero), F.col("delivery_id"))
    both = s.unionByName(r).mapInArrow(_by_group, "calls long, packed binary")
    found = both.groupBy("calls").transformWithStateInPandas(Reviews(us(late), us(within)), f"call_id long, us long, submitted long, kind int, submission_id {kind}", "append", "EventTime")
    submitted = F.when(F.col("kind") != SUSPENDED, F.timestamp_micros("submitted"))
    return found.select("call_id", F.timestamp_micros("us").alias("suspended_at"), submitted.alias("submitted_at"), F.when(F.col("kind") == SUBMITTED, F.col("submission_id")).alias("submission_id"))


def resumed(pairs: DataFrame) -> DataFrame:
    """What resumptions or reviews wrote, per call: its first submission, how many there were, and its status."""
    first = F.min(F.when(F.col("submission_id").isNotNull(), F.struct("submitted_at", "submission_id")))["submission_id"]
    out = pairs.groupBy("call_id").agg(first.alias("submission_id"), F.nullif(F.count("submission_id"), F.lit(0)).alias("submissions"))
    return out.withColumn("status", F.when(F.col("submission_id").isNotNull(), "completed").otherwise("awaiting_review"))


def run(stream: DataFrame, out: str, checkpoint: str) -> None:
    """All that is there now, appended to a folder; goes on where the checkpoint ended."""
    stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).option("path", out).format("parquet").trigger(availableNow=True).start().awaitTermination()
