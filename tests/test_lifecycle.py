"""Streams of tasks: attempts and their ends as rows, restarts, late events, and stages that meet their ends."""

import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.streaming import lifecycle as C

EVENTS = "task_id long, seq long, ts timestamp, kind string, stage string, reason string"
DAY = datetime.datetime(2024, 1, 1)


def at(minutes):
    return DAY + datetime.timedelta(minutes=minutes)


@pytest.fixture
def run(spark, tmp_path):
    """Adds a file of events and runs the stream until it has taken it; all rows so far."""
    for k, v in C.STATE_STORE.items():
        spark.conf.set(k, v)
    source, sink, point = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def more(*rows):
        spark.createDataFrame([(t, s, at(m), k, stage, reason) for t, s, m, k, stage, reason in rows], EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = C.lifecycle(spark.readStream.schema(EVENTS).parquet(source), "1 minute", timeout_ms=30 * 60_000, keep_ms=60 * 60_000, retry_ms=120_000, attempts=3)
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", point).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.task_id, r.attempt, r.outcome, int((r["at"] - DAY).total_seconds() // 60), r.reason, r.kept) for r in spark.read.parquet(sink).collect())

    return more


def test_life_of_tasks(run):
    """Retries wait longer each time, a cancel says what was kept, a restart goes on, late and repeated events change nothing."""
    got = run(
        (1, 1, 0, "START", None, None), (1, 2, 1, "STAGE", "parse", None), (1, 3, 2, "FAIL", None, "network"), (2, 1, 0, "START", None, None), (2, 2, 1, "STAGE", "parse", None),
        (2, 3, 2, "STAGE", "chunk", None), (2, 4, 3, "CANCEL", None, "asked"), (3, 1, 0, "START", None, None), (3, 2, 1, "FAIL", None, "parameter"), (4, 1, 0, "START", None, None), (None, 1, 0, "START", None, None),
    )
    assert got == [
        (1, 1, "RETRY", 4, "network", "parse"), (1, 1, "STARTED", 0, None, "parse"), (2, 1, "CANCELLED", 3, "asked", "chunk,parse"), (2, 1, "STARTED", 0, None, "chunk,parse"),
        (3, 1, "FAILED", 1, "parameter", ""), (3, 1, "STARTED", 0, None, ""), (4, 1, "STARTED", 0, None, ""),
    ]
    again = run((1, 3, 3, "FAIL", None, "network"), (1, 4, 5, "START", None, None), (1, 5, 6, "FAIL", None, "Timeout"), (2, 5, 6, "SUCCEED", None, None), (3, 3, 7, "START", None, None), (3, 4, 8, "SUCCEED", None, None))
    assert [r for r in again if r not in got] == [
        (1, 2, "RETRY", 10, "Timeout", "parse"), (1, 2, "STARTED", 5, None, "parse"), (3, 2, "STARTED", 7, None, ""), (3, 2, "SUCCEEDED", 8, None, ""),
    ]
    last = run((1, 6, 11, "START", None, None), (1, 7, 12, "FAIL", None, "network"))
    assert [r for r in last if r not in again] == [(1, 3, "FAILED", 12, "network", "parse"), (1, 3, "STARTED", 11, None, "parse")]
    assert run((9, 1, 12, "SUCCEED", None, None))[-1] == (9, 1, "SUCCEEDED", 12, None, "")


def test_tasks_that_never_end_time_out(run):
    run((1, 1, 0, "START", None, None), (2, 1, 0, "START", None, None), (2, 2, 20, "STAGE", "parse", None))
    run((7, 1, 41, "START", None, None))
    got = run((7, 2, 42, "SUCCEED", None, None))
    assert (1, 1, "TIMED_OUT", 30, "no event in time", "") in got and not [r for r in got if r[0] == 2 and r[2] == "TIMED_OUT"]
    run((8, 1, 70, "START", None, None))
    got = run((8, 2, 71, "SUCCEED", None, None), (1, 2, 71, "SUCCEED", None, None))
    assert (2, 1, "TIMED_OUT", 50, "no event in time", "parse") in got and [r[2] for r in got if r[0] == 1] == ["STARTED", "TIMED_OUT"]


def test_stages_meet_their_ends(spark, tmp_path):
    """The stream's rows are those of the batch join, with nulls for what never ended; given events as starts and ends."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    starts = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("started_at"))
    ends = events.where("event_type in ('purchase', 'error')").select("user_id", F.col("ts").alias("ended_at"), F.col("event_type").alias("status"))
    flush = events.agg(F.max("ts") + F.expr("interval 30 days")).first()[0]
    starts.unionByName(spark.createDataFrame([(-1, flush)], starts.schema)).coalesce(1).write.parquet(str(tmp_path / "starts"))
    ends.unionByName(spark.createDataFrame([(-2, flush, "x")], ends.schema)).coalesce(1).write.parquet(str(tmp_path / "ends"))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    stream = C.met_stages(read("starts", starts), read("ends", ends), ["user_id"], "12 hours", "1 hour")
    query = stream.writeStream.format("memory").queryName("met").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(str(tuple(r)) for r in spark.table("met").collect() if r.user_id >= 0)
    late = ends.withColumnRenamed("user_id", "u")
    want = starts.join(late, (F.col("user_id") == F.col("u")) & (F.col("ended_at") >= F.col("started_at")) & (F.col("ended_at") <= F.col("started_at") + F.expr("interval 12 hours")), "left")
    assert got == sorted(str(tuple(r)) for r in want.select("user_id", "started_at", "ended_at", "status").collect()) and any("None" in r for r in got)
