"""Streams with state: they end with the rows of the batch queries, also when they stop and go on, with repeated and late events."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from talkgrain.operators import lifecycle
from talkgrain.streaming import states

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "event_id long, call_id long, at timestamp, status string, attempts long"


def events(spark, rows):
    made = [(e, c, START + dt.timedelta(seconds=s), status, attempts) for e, c, s, status, attempts in rows]
    return spark.createDataFrame(made, SCHEMA)


@pytest.fixture
def log(spark, tmp_path):
    """A folder to which events are added, and the stream over it."""
    home = str(tmp_path)
    own = states.session(spark)
    return home, lambda rows: events(spark, rows).coalesce(1).write.mode("append").parquet(f"{home}/in"), lambda: own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")


def test_transitions_go_on_after_a_stop(spark, log):
    home, add, stream = log
    first = [(1, 7, 0, "queued", 0), (2, 7, 5, "processing", 0), (3, 8, 1, "completed", 0)]
    second = [(2, 7, 5, "processing", 0), (4, 7, 9, "awaiting_review", 0), (5, 8, 9, "queued", 0), (6, 9, 9, "queued", 0)]  # one comes again
    for part in (first, second):
        add(part)
        states.run(states.transitions(stream()), f"{home}/out", f"{home}/checkpoint")
    got = spark.read.parquet(f"{home}/out")
    every = events(spark, first + second[1:])
    steps = lifecycle.transitions(every).select("event_id", "call_id", "status", "previous", "legal")
    claims = lifecycle.claims(every).select("event_id", F.col("attempt").cast("long").alias("attempt"), "won")
    want = steps.join(claims, "event_id")
    columns = ["event_id", "call_id", "status", "previous", "legal", "attempt", "won"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_timers_reap_and_are_wound_again(spark, log):
    home, add, stream = log
    add([(1, 1, 0, "queued", 0), (2, 2, 0, "processing", 1), (3, 3, 0, "processing", 4), (4, 4, 0, "queued", 0), (5, 5, 0, "completed", 0), (6, 6, 600, "processing", 0)])
    states.run(states.reaped(stream(), "0 seconds"), f"{home}/out", f"{home}/checkpoint")
    assert spark.read.schema("call_id long").parquet(f"{home}/out").count() == 0
    add([(7, 4, 800, "processing", 0), (8, 99, 901, "completed", 0)])  # call 4 moved on in time
    states.run(states.reaped(stream(), "0 seconds"), f"{home}/out", f"{home}/checkpoint")
    add([(9, 99, 1500, "completed", 0)])  # exactly the limit for call 6, whose timer is not due yet
    states.run(states.reaped(stream(), "0 seconds"), f"{home}/out", f"{home}/checkpoint")
    got = sorted((r.call_id, r.action) for r in spark.read.parquet(f"{home}/out").collect())
    assert got == [(1, "requeue"), (2, "release"), (3, "fail")]
    add([(10, 99, 1701, "completed", 0)])
    states.run(states.reaped(stream(), "0 seconds"), f"{home}/out", f"{home}/checkpoint")
    got = sorted((r.call_id, r.action) for r in spark.read.parquet(f"{home}/out").collect())
    assert got == [(1, "requeue"), (2, "release"), (3, "fail"), (4, "release"), (6, "release")]


def test_resumption_counts_a_delivery_once(spark, tmp_path):
    home, own = str(tmp_path), states.session(spark)
    when = lambda s: START + dt.timedelta(seconds=s)
    suspended, submitted = "call_id long, at timestamp", "call_id long, at timestamp, submission_id long, delivery_id string"
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{home}/{name}")
    put([(1, when(0)), (2, when(0)), (3, when(5))], suspended, "s")
    put([(1, when(50), 11, "a"), (1, when(40), 10, "b"), (1, when(50), 11, "a"), (3, when(1), 9, "early")], submitted, "r")
    put([(1, when(50), 11, "a"), (4, when(60), 12, "c")], submitted, "r")  # again in a later batch, and a call that is not suspended
    put([(None, when(9000))], suspended, "s")
    put([(None, when(9000), None, None)], submitted, "r")
    stream = lambda name, schema: own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/{name}")
    states.run(states.resumptions(stream("s", suspended), stream("r", submitted), "100 seconds", "500 seconds"), f"{home}/out", f"{home}/checkpoint")
    got = states.resumed(spark.read.parquet(f"{home}/out").filter("call_id is not null")).collect()
    assert sorted(map(tuple, got)) == [(1, 10, 2, "completed"), (2, None, None, "awaiting_review"), (3, None, None, "awaiting_review")]


def test_neighbouring_calls_share_a_state(spark, log):
    home, add, stream = log
    calls = [-300, -1, 0, *range(1, 1000)]
    add([(k, c, k, "queued", 0) for k, c in enumerate(calls)])
    add([(5000 + k, c, 2000 + k, "processing", 0) for k, c in enumerate(calls)])
    states.run(states.transitions(stream()), f"{home}/out", f"{home}/checkpoint")
    got = spark.read.parquet(f"{home}/out").groupBy("attempt", "status", "previous", "legal").count().collect()
    assert sorted(map(tuple, got)) == [(1, "queued", None, None, 1002), (2, "processing", "queued", True, 1002)]
    kept = states.session(spark).read.format("statestore").option("stateVarName", "last").load(f"{home}/checkpoint").count()
    assert kept == 6  # one for -300, one for -1, four for 0 to 999


def test_calls_of_a_group_are_due_one_by_one(spark, log):
    home, add, stream = log
    add([(k, k, 10 * k, "queued" if k % 2 else "completed", 0) for k in range(100)] + [(100, 9999, 1000, "completed", 0)])
    add([(101, 1, 1100, "processing", 0), (102, 9999, 1402, "completed", 0)])  # call 1 moves on before its time; 900.001 s after 502 s
    add([(103, 9999, 1403, "completed", 0)])
    states.run(states.reaped(stream(), "0 seconds"), f"{home}/out", f"{home}/checkpoint")
    due = lambda end: [(k, "requeue") for k in range(3, 100, 2) if 10 * k + 900.001 < end]
    assert sorted((r.call_id, r.action) for r in spark.read.parquet(f"{home}/out").collect()) == due(1403)
    add([(104, 9999, 5000, "completed", 0)])
    states.run(states.reaped(stream(), "0 seconds"), f"{home}/out", f"{home}/checkpoint")
    assert sorted((r.call_id, r.action) for r in spark.read.parquet(f"{home}/out").collect()) == sorted([(1, "release"), *due(9999)])
    kept = states.session(spark).read.format("statestore").option("stateVarName", "state").load(f"{home}/checkpoint")
    assert [tuple(r.value.calls) for r in kept.select("value").collect()] == [(9999,)]  # all others are forgotten


def test_submissions_wait_in_one_store_without_their_delivery(spark, tmp_path):
    home, own = str(tmp_path), states.session(spark)
    at = dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
    spark.createDataFrame([(1, at)], "call_id long, at timestamp").write.parquet(f"{home}/s")
    spark.createDataFrame([(1, at, 10, "d" * 50), (1, at, 10, "d" * 50), (2, at, 11, "e" * 50)], "call_id long, at timestamp, submission_id long, delivery_id string").write.parquet(f"{home}/r")
    stream = lambda name: own.readStream.schema(spark.read.parquet(f"{home}/{name}").schema).parquet(f"{home}/{name}")
    states.run(states.resumptions(stream("s"), stream("r"), "1 day", "5 days"), f"{home}/out", f"{home}/checkpoint")
    assert [tuple(r) for r in spark.read.parquet(f"{home}/out").select("call_id", "submission_id").collect()] == [(1, 10)]
    waiting = own.read.format("statestore").option("joinSide", "right").load(f"{home}/checkpoint")
    assert waiting.count() == 2 and "delivery_id" not in waiting.select("value.*").columns
    assert own.conf.get("spark.sql.streaming.join.stateFormatVersion") == "3"


def test_neighbouring_calls_share_their_reviews(spark, tmp_path):
    home, own = str(tmp_path), states.session(spark)
    when = lambda s: START + dt.timedelta(seconds=s)
    suspended, submitted = "call_id long, at timestamp", "call_id long, at timestamp, submission_id long, delivery_id string"
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{home}/{name}")
    stream = lambda name, schema: own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/{name}")
    big = 2**60 + 1  # no double
    go = lambda: states.run(states.reviews(stream("s", suspended), stream("r", submitted), dt.timedelta(seconds=100), dt.timedelta(seconds=500)), f"{home}/out", f"{home}/checkpoint")
    put([(c, when(c % 7)) for c in range(-3, 3000)] + [(7, when(0)), (9000, when(5)), (None, when(3))], suspended, "s")
    put([(1, when(50), 11, "a"), (1, when(40), big, "b"), (1, when(50), 11, "a"), (5, when(4), 9, "early"), (6, when(506), 13, "last"), (8, when(502), 14, "over"), (10, when(20), None, "n")], submitted, "r")
    go()
    pair = lambda r: (r.call_id, (r.suspended_at.timestamp() - START.timestamp()), r.submitted_at and r.submitted_at.timestamp() - START.timestamp(), r.submission_id)
    got = lambda: sorted(map(pair, spark.read.parquet(f"{home}/out").collect()), key=str)
    pairs = [(1, 1, 50, 11), (1, 1, 40, big), (6, 6, 506, 13), (10, 3, 20, None)]
    assert got() == sorted(pairs, key=str)  # at once, not at the end
    kept = own.read.format("statestore").option("stateVarName", "state").load(f"{home}/checkpoint")
    assert kept.count() == 3  # -3 to -1, 0 to 2999 and 9000; a join has one row for each call
    put([(1, when(60), 15, "d"), (1, when(50), 11, "a"), (20000, when(70), 12, "c")], submitted, "r")  # again in a later batch, and a call that is suspended later
    put([(20000, when(65))], suspended, "s")
    put([(20000, when(65)), (20001, when(66))], suspended, "s")
    put([(1, when(61), 16, "e")], submitted, "r")
    go()
    pairs += [(1, 1, 60, 15), (20000, 65, 70, 12), (1, 1, 61, 16)]
    assert got() == sorted(pairs, key=str)
    for end in (9000, 9500):
        put([(None, when(end))], suspended, "s")
        put([(None, when(end), None, None)], submitted, "r")
    go()
    alone = [(c, c % 7, None, None) for c in range(-3, 3000) if c not in (1, 6, 10)] + [(9000, 5, None, None), (20001, 66, None, None)]
    assert [(c, s) for c, s, _, _ in got() if c == 7] == [(7, 0)]
    assert got() == sorted(pairs + [(c, 0 if c == 7 else s, x, y) for c, s, x, y in alone], key=str)
    assert kept.sparkSession.read.format("statestore").option("stateVarName", "state").load(f"{home}/checkpoint").count() == 0
