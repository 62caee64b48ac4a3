"""The same rules on streams: deduplicated intake, metering windows, live scans and keyed state.

State is bounded per key and leaves by timer: admission keeps at most the limit's worth of
times until the last one is out of its span, the lifecycle one small row until a closed request
is forgotten, the cache one timestamp until its result is too old. Within a micro-batch a key's
events are sorted by event time before a rule is applied; what is held of them is two or three
numbers each, and verdicts leave in frames of FRAME rows or one by one. So size micro-batches with the source's own
limits (`maxFilesPerTrigger`, `maxBytesPerTrigger`); a key's verdicts do not depend on where they are cut,
as long as files come in order of time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from paperloom.functions import fixed
from paperloom.session import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FRAME = 10_000
STEP = Row("key", "event_id", "before", "state", "allowed")


def read_stream(spark: SparkSession, folder: str, table: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """A table's files as a stream; times without a zone are taken in the session's zone."""
    path = f"{folder}/{table}.parquet"
    # A stream's source is a folder: the table's own, or the one its single file lies in.
    single = [f.rsplit("/", 1)[-1] for f in spark.read.schema(schema).parquet(path).inputFiles()] == [f"{table}.parquet"]
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    rows = (
        reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder) if single else reader.parquet(path)
    )
    zoneless = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return rows.withColumns({name: F.col(name).cast("timestamp") for name in zoneless}) if zoneless else rows


def drain(stream: DataFrame, label: str, mode: str = "append", out: str | None = None) -> DataFrame:
    """Run a stream over all data now available into the shared folder (or `out`) and read the result.

    Checkpoint and output live in the shared folder, so a lost executor or driver resumes
    from the last committed micro-batch.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, label)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    run = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).format("parquet").start(f"{out}/rows")
    )
    try:
        run.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def intake(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """One row per idempotency key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def usage_windows(stream: DataFrame, keys: list[str], units: Column, every: str = "1 hour", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Metered units per interval; rows later than the watermark are dropped, open windows wait."""
    summed = stream.withWatermark(time, delay).groupBy(F.window(time, every), *keys).agg(
        F.sum(units).alias("units"), F.count(F.lit(1)).alias("records"))
    return summed.select(F.col("window.start").alias("window_start"), *keys, "units", "records")


def scan_stream(stream: DataFrame, scan: Callable[[DataFrame], DataFrame], key: str, label: str) -> DataFrame:
    """Scan rows as they arrive; a document scanned again replaces its findings.

    Each micro-batch writes its scanned keys and its findings under its own number, and a
    repeated batch overwrites exactly that folder. Reading keeps each key's newest batch.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        batch.select(key).distinct().write.mode("overwrite").parquet(f"{out}/keys/batch={number}")
        scan(batch).write.mode("overwrite").parquet(f"{out}/findings/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()
    newest = spark.read.parquet(f"{out}/keys").groupBy(key).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/findings").join(newest, [key, "batch"], "left_semi").drop("batch")


def by_time(rows: Iterator[pd.DataFrame]):
    """A key's events of a micro-batch in order: microseconds and ids as arrays."""
    times, ids = [], []
    for part in rows:
        times.append(part["ts"].astype("datetime64[us]").astype("int64").to_numpy())
        ids.append(part["event_id"].to_numpy(np.int64))
    at, number = np.concatenate(times), np.concatenate(ids)
    order = np.lexsort((number, at))
    return at[order], number[order]


def millis(micros: int) -> int:
    """The first millisecond not before a time; timers count in these."""
    return -(-int(micros) // 1000)


class Admission(StatefulProcessor):
    """At most `limit` accepted events per key in any `seconds`; refused ones do not count.

    A timer clears a key's times once the watermark is past the span of the last accepted event.
    """

    def __init__(self, limit: int = fixed.RATE_LIMIT, seconds: int = fixed.RATE_SECONDS):
        self.limit, self.span = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("accepted", "micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        accepted = deque(t[0] for t in self.times.get()) if self.times.exists() else deque()
        last = accepted[-1] if accepted else None
        at, number = by_time(rows)
        free, waits = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
        for n, now in enumerate(at.tolist()):
            while accepted and accepted[0] <= now - self.span:
                accepted.popleft()
            free[n] = len(accepted) < self.limit
            if free[n]:
                accepted.append(now)
            else:
                waits[n] = (accepted[0] + self.span - now) // 1_000_000
        if accepted:
            self.times.put([(t,) for t in accepted])
        else:
            self.times.clear()
        if last is not None and (not accepted or accepted[-1] != last):
            self.handle.deleteTimer(millis(last + self.span))
        if accepted and accepted[-1] != last:
            self.handle.registerTimer(millis(accepted[-1] + self.span))
        for start in range(0, len(at), FRAME):
            part = slice(start, start + FRAME)
            yield pd.DataFrame({"key": key[0], "event_id": number[part], "accepted": free[part], "retry_after": waits[part]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


def admit(stream: DataFrame, key: str, limit: int = fixed.RATE_LIMIT, seconds: int = fixed.RATE_SECONDS, delay: str = "1 hour") -> DataFrame:
    """Rolling admission per key (columns key, ts, event_id): accepted and whole seconds to wait.

    Events later than `delay` behind the newest are dropped; a key idle for its span and the delay leaves no state.
    """
    watched = stream.select(F.col(key).alias("key"), "ts", "event_id").withWatermark("ts", delay)
    return watched.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Admission(limit, seconds), outputStructType="key long, event_id long, accepted boolean, retry_after long",
        outputMode="Append", timeMode="EventTime")


class Lifecycle(StatefulProcessor):
    """Applies requested states in event-time order; open requests expire after a quiet span.

    A closed request (nothing may follow its state) is remembered for `memory` from its closing, so that
    steps asked of it are refused; then it is forgotten, by timer, and a later step finds a new request.
    """

    def __init__(self, allowed: dict[str, list[str]], initial: str, quiet_seconds: int, memory_seconds: int):
        self.allowed, self.initial = allowed, initial
        self.quiet, self.memory = quiet_seconds * 1_000_000, memory_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "state string, deadline long, closed long")

    def _timer(self, deadline: int | None, closed: int | None) -> int | None:
        due = deadline if deadline is not None else None if closed is None else closed + self.memory
        return None if due is None else millis(due)

    def _keep(self, state: str, deadline: int | None, closed: int | None, before: int | None) -> None:
        if state == self.initial:
            self.current.clear()
        else:
            self.current.update((state, deadline, closed))
        due = self._timer(deadline, closed)
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if due is not None and before != due:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, deadline, closed = self.current.get() or (self.initial, None, None)
        before = self._timer(deadline, closed)
        for now, event_id, wanted in sorted((r["micros"], r["event_id"], r["state"]) for r in rows):
            if deadline is not None and now >= deadline:
                yield STEP(key[0], None, state, "expired", True)
                state, deadline, closed = "expired", None, deadline
            if closed is not None and now >= closed + self.memory:
                state, closed = self.initial, None
            if wanted != state:
                ok = wanted in self.allowed.get(state, [])
                yield STEP(key[0], event_id, state, wanted, ok)
                if ok:
                    state, follows = wanted, self.allowed.get(wanted, [])
                    deadline = now + self.quiet if "expired" in follows else None
                    closed = None if follows else now
        self._keep(state, deadline, closed, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, deadline, closed = self.current.get() or (self.initial, None, None)
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        late = deadline is not None and millis(deadline) <= now
        if late:
            yield STEP(key[0], None, state, "expired", True)
            state, deadline, closed = "expired", None, deadline
        # The watermark may be past the end of its memory as well.
        if closed is not None and millis(closed + self.memory) <= now:
            self.current.clear()
        elif late:
            self._keep(state, deadline, closed, None)

    def close(self) -> None:
        pass


def lifecycle(stream: DataFrame, key: str, initial: str = "draft", quiet_seconds: int = 7 * 86400, delay: str = "1 hour",
              allowed: dict[str, list[str]] | None = None, memory_seconds: int = 30 * 86400) -> DataFrame:
    """State machine per key over requested states (key, ts, event_id, state).

    Every step comes out with the state before it and whether it was allowed; an open request
    that stays quiet past its deadline comes out as expired, by timer if nothing else arrives.
    """
    # Most keys have an event or two: as rows they need no frame of their own.
    watched = stream.select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("micros"), "event_id", "state").withWatermark("ts", delay)
    return watched.groupBy("key").transformWithState(
        statefulProcessor=Lifecycle(allowed or fixed.ALLOWED_TRANSITIONS, initial, quiet_seconds, memory_seconds),
        outputStructType="key long, event_id long, before string, state string, allowed boolean", outputMode="Append", timeMode="EventTime")


class CacheLookup(StatefulProcessor):
    """A lookup hits when the key's result is at most `hours` old; a miss stores a new one. Old results leave by timer."""

    def __init__(self, hours: int = fixed.CACHE_HOURS):
        self.span = hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.created = handle.getValueState("created", "micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        created = first = self.created.get()[0] if self.created.exists() else None
        at, number = by_time(rows)
        hits = np.zeros(len(at), bool)
        for n, now in enumerate(at.tolist()):
            hits[n] = created is not None and now <= created + self.span
            if not hits[n]:
                created = now
        if created != first:
            self.created.update((created,))
            if first is not None:
                self.handle.deleteTimer(millis(first + self.span) + 1)
            self.handle.registerTimer(millis(created + self.span) + 1)
        for start in range(0, len(at), FRAME):
            yield pd.DataFrame({"key": key[0], "event_id": number[start:start + FRAME], "hit": hits[start:start + FRAME]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.created.clear()
        return iter([])

    def close(self) -> None:
        pass


def cache_lookups(stream: DataFrame, key: str, hours: int = fixed.CACHE_HOURS, delay: str = "1 hour") -> DataFrame:
    """Per event (key, ts, event_id) whether a result of its key, made by an earlier event, is still fresh."""
    watched = stream.select(F.col(key).alias("key"), "ts", "event_id").withWatermark("ts", delay)
    return watched.groupBy("key").transformWithStateInPandas(
        statefulProcessor=CacheLookup(hours), outputStructType="key long, event_id long, hit boolean", outputMode="Append", timeMode="EventTime")


def stall_watch(stream: DataFrame, key: str, seconds: int = fixed.STALL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Stalled jobs of a status stream (key, ts, event_id, state, attempts, max_attempts) as event time passes their limit.

    A session of a job ends when no status comes for `seconds`: if the last one is still processing, the job is queued
    again or failed. State leaves when the watermark passes that end. No Python runs.
    """
    said = F.struct("state", "attempts", "max_attempts")
    watched = stream.select(F.col(key).alias("key"), F.date_trunc("millisecond", "ts").alias("at"), "ts", "event_id", said.alias("said")).withWatermark("at", delay)
    last = watched.groupBy(F.session_window("at", f"{seconds} seconds"), "key").agg(F.max_by("said", F.struct("ts", "event_id")).alias("last"))
    ready = F.when(F.col("last.attempts") < F.col("last.max_attempts"), "queued").otherwise("failed")
    return last.filter("last.state = 'processing'").select("key", F.col("last.attempts").alias("attempts"), ready.alias("next_state"))
