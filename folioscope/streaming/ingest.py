"""Structured Streaming: staged ingest, idempotent tasks, live task state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from folioscope.operators.activity import TERMINAL
from folioscope.operators.documents import chunks, paragraphs, section_chunks
from folioscope.sources.snapshots import Change, Snapshots


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_stage(source: DataFrame, sink: str, checkpoint: str, stage: str, size: int = 400, overlap: int = 50) -> StreamingQuery:
    """Run one ingest stage over all that is there, then stop; a restart goes on where it ended.

    Stages are ``parse``, ``chunk`` (of ``size`` characters with an ``overlap``) and ``sections`` (whole lines up to ``size``).
    """
    step = {"parse": paragraphs, "chunk": lambda df: chunks(df, size, overlap), "sections": lambda df: section_chunks(df, size)}[stage]
    return step(source).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(events: DataFrame, time_col: str, keys: list[str], delay: str) -> DataFrame:
    """Events once for each key while the watermark holds; the time is cast, as event time must be a timestamp."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return timed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time_col: str, key: str, size: str, delay: str) -> DataFrame:
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)
    return timed.groupBy(F.window(time_col, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def handle_once(source: DataFrame, log: Snapshots, checkpoint: str, key: Column, handle, table: str = "handled", buckets: int = 32, folders: int = 16) -> StreamingQuery:
    """Run ``handle`` on every row whose idempotent key was not handled before, then stop; a restart repeats nothing.

    ``handle`` turns the new rows of a batch into results that keep ``idem_key``. A batch's results are one snapshot of
    ``table``, which is also where keys are looked up, so a batch that comes again after a crash finds its own keys. Only the
    buckets of a batch's keys are read, and buckets of more than ``folders`` folders are put together.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.withColumn("idem_key", key).where("idem_key is not null").dropDuplicates(["idem_key"])

        def add(change: Change) -> None:
            known = change.rows_of(table, fresh.select("idem_key")) if table in change.tables else None
            rows = handle(fresh if known is None else fresh.join(known.select("idem_key").distinct(), "idem_key", "left_anti"))
            if known is None:
                change.create(table, rows, "idem_key", buckets)
            else:
                change.append(table, rows)
            change.depends(table)  # two streams must not handle one key at a time

        log.apply(add)
        log.apply(lambda change: change.compact(table, folders))

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: How long the state of a task is kept without a new event: one that has ended, and one that has not.
KEEP_ENDED_MS, KEEP_OPEN_MS = 3_600_000, 7 * 24 * 3_600_000


def task_states(events: DataFrame, time_col: str = "ts", delay: str = "1 hour", keep_ended_ms: int = KEEP_ENDED_MS, keep_open_ms: int = KEEP_OPEN_MS) -> DataFrame:
    """Each task's newest status and number of attempts, kept across batches: (task_id, status, attempts, seq).

    A task's state goes when the watermark is so far beyond its events, sooner once it has ended, so that the state
    doesn't grow for ever.
    """

    def update(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, status, attempts = state.get if state.exists else (-1, None, 0)
        latest = 0
        for part in rows:
            latest = max(latest, int(part[time_col].max().timestamp() * 1000))
            attempts += int((part["status"] == "RUNNING").sum())
            last = part.loc[part["seq"].idxmax()]
            if last["seq"] > seq:
                seq, status = int(last["seq"]), last["status"]
        state.update((seq, status, attempts))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + (keep_ended_ms if status in TERMINAL else keep_open_ms))
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "attempts": [attempts], "seq": [seq]})

    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp")).where(F.col(time_col).isNotNull()).withWatermark(time_col, delay)
    return timed.groupBy("task_id").applyInPandasWithState(
        update, "task_id long, status string, attempts long, seq long", "seq long, status string, attempts long", "update", GroupStateTimeout.EventTimeTimeout
    )
