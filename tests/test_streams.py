"""Stateful streams: verdicts do not depend on how events are cut into batches, and idle state goes."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.session import scratch_path
from paperloom.streaming import streams as ST

STATES = ["draft", "sent", "viewed", "partially_signed", "completed", "declined"]
SCHEMA = "key long, ts timestamp, event_id long, state string"


def events(seed, rows, keys, hours):
    """One key holds a third of the events."""
    draw = random.Random(seed)
    out = []
    for i in range(rows):
        key = 0 if draw.random() < 0.33 else draw.randint(1, keys)
        at = 1_704_067_200 + draw.randint(0, hours * 3600)
        out.append((key, float(at), i, draw.choice(STATES)))
    return sorted(out, key=lambda r: (r[1], r[2]))


def written(spark, rows, files):
    """The events as files in order of time, so that each becomes a micro-batch of its own."""
    folder = scratch_path(spark, "stream-test")
    table = spark.createDataFrame(rows, "key long, at double, event_id long, state string").select("key", F.timestamp_seconds("at").alias("ts"), "event_id", "state").cache()
    cuts = sorted({rows[len(rows) * n // files][1] for n in range(1, files)}) if rows else []
    bounds = [float("-inf"), *cuts, float("inf")]
    for low, high in zip(bounds, bounds[1:]):
        seconds = F.unix_timestamp("ts")
        table.filter((seconds >= low) & (seconds < high)).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return folder


def run(spark, rows, files, make, out=None):
    folder = written(spark, rows, files)
    stream = ST.read_stream(spark, folder, "events", spark.read.parquet(f"{folder}/events.parquet").schema, files_per_trigger=1)
    return sorted(map(str, ST.drain(make(stream), "streams", out=out).collect()))


@pytest.mark.parametrize("make", [
    lambda s: ST.admit(s, "key", 4, 3600), lambda s: ST.lifecycle(s, "key", quiet_seconds=6 * 3600, memory_seconds=24 * 3600), lambda s: ST.cache_lookups(s, "key", 5)],
    ids=["admission", "lifecycle", "lookups"])
def test_batches_do_not_matter(spark, monkeypatch, make):
    monkeypatch.setattr(ST, "FRAME", 7)
    rows = events(3, 260, 5, 120)
    assert run(spark, rows, 1, make) == run(spark, rows, 5, make) != []


def states_of(spark, out, name):
    return {r.key for r in spark.read.format("statestore").option("stateVarName", name).load(f"{out}/checkpoint").select("key.key").collect()}


def test_idle_state_goes(spark):
    early = [(key, 1_704_067_200.0 + key, key, "sent") for key in range(1, 6)]
    late = [(9, 1_704_067_200.0 + 40 * 86400 + i, 100 + i, "sent") for i in range(3)]
    for make, name in ((lambda s: ST.admit(s, "key", 2, 60), "accepted"), (lambda s: ST.cache_lookups(s, "key", 1), "created"),
                       (lambda s: ST.lifecycle(s, "key", quiet_seconds=3600, memory_seconds=86400), "current")):
        out = scratch_path(spark, "idle")
        rows = run(spark, early + late, 2, make, out)
        assert states_of(spark, out, name) == {9}
        if name == "current":
            assert sum("expired" in r for r in rows) == 5


def test_closed_requests_refuse_and_are_forgotten(spark):
    day = 86400.0
    rows = [(1, 1_704_067_200.0, 1, "sent"), (1, 1_704_067_200.0 + 60, 2, "completed"), (1, 1_704_067_200.0 + day, 3, "viewed"), (1, 1_704_067_200.0 + 5 * day, 4, "sent")]
    for files in (1, 4):
        got = run(spark, rows, files, lambda s: ST.lifecycle(s, "key", quiet_seconds=int(9 * day), memory_seconds=int(3 * day)))
        assert [("completed" in g and "viewed" in g and "allowed=False" in g) for g in got].count(True) == 1
        assert sum("before='draft', state='sent', allowed=True" in g for g in got) == 2


def test_stalls_do_not_depend_on_batches(spark):
    """A status that comes after the limit does not undo the stall, in whatever batch it comes."""
    start = 1_704_067_200.0
    rows = [(1, start, 1, "processing"), (2, start + 1, 2, "processing"), (2, start + 500, 3, "sent"), (1, start + 3600, 4, "sent"), (3, start + 9000, 5, "processing")]
    for files in (1, 4):
        got = run(spark, rows, files, lambda s: ST.stall_watch(
            s.withColumns({"attempts": F.lit(1), "max_attempts": F.lit(3)}), "key", 900))
        assert got == ["Row(key=1, attempts=1, next_state='queued')"]


def test_keys_with_few_events_are_no_frames(spark):
    folder = written(spark, events(1, 20, 3, 5), 1)
    stream = ST.read_stream(spark, folder, "events", spark.read.parquet(f"{folder}/events.parquet").schema)
    plan = ST.lifecycle(stream, "key")._jdf.queryExecution().logical().toString()
    assert "TransformWithState" in plan and "pandas" not in plan.lower()
