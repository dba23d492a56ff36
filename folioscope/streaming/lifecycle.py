"""The life of tasks as a stream: attempts, retries, cancels and time-outs come out as rows.

Each task has its state in the stream's state store: where it stands, the stages that each attempt finished, and timers for
what should have happened by now. What comes in are events (task_id, seq, ts, kind, stage, reason):

* ``START`` begins an attempt, ``STAGE`` says that a stage of it is done, ``SUCCEED``, ``FAIL`` and ``CANCEL`` end it.

What comes out are rows (task_id, attempt, outcome, at, reason, kept): ``STARTED``, ``SUCCEEDED``, ``FAILED`` (no attempt is
left, or the reason is not to be tried again), ``RETRY`` (``at`` is when the next attempt is due, later each time),
``CANCELLED`` and ``TIMED_OUT``. ``kept`` are the stages that stay done, so a cancel says what stopped and what was kept,
and a next attempt need not repeat them. A failed attempt's input is never lost: its reason stands in its row.

Cases: events that come twice or late, by ``seq`` in the task, change nothing; events later than the watermark are dropped by
Spark; an event of a task that has ended is ignored, but for a START after FAILED, which is a new attempt asked for by
hand; an end without a START counts as that of a first attempt; rows without a task, a seq or a time are dropped. State goes
``keep_ms`` after a task's end, and a task that never ends gets a TIMED_OUT row, so the store doesn't grow for ever.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a stream needs that uses these operators.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "task_id long, attempt int, outcome string, at timestamp, reason string, kept string"
TIMEOUT_MS, KEEP_MS, RETRY_MS, ATTEMPTS = 3_600_000, 3_600_000, 60_000, 3
#: Reasons after which another attempt may help.
PASSING = ("network", "timeout", "rate_limit", "unavailable")


class Lifecycle(StatefulProcessor):
    """State of one task: (seq, attempt, status, due) and, by stage, the attempt that finished it."""

    def __init__(self, timeout_ms: int = TIMEOUT_MS, keep_ms: int = KEEP_MS, retry_ms: int = RETRY_MS, attempts: int = ATTEMPTS):
        self.timeout_ms, self.keep_ms, self.retry_ms, self.attempts = timeout_ms, keep_ms, retry_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "seq long, attempt int, status string, due long")
        self.stages = handle.getMapState("stages", "stage string", "attempt int")

    def _kept(self) -> str:
        return ",".join(sorted(k[0] for k in self.stages.keys()))

    def _timer(self, due: int) -> None:
        """One timer a task: it ends the task if nothing else has, or else forgets it."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, attempt, status, due = self.task.get() if self.task.exists() else (-1, 0, "NEW", 0)
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for e in events.itertuples(index=False):
            if e.seq <= seq:
                continue
            seq, at = int(e.seq), int(e.ts.value // 1_000_000)
            ended = status in ("SUCCEEDED", "CANCELLED", "TIMED_OUT", "FAILED")
            if e.kind == "START" and (not ended or status == "FAILED"):
                attempt, status, due = attempt + 1, "RUNNING", at + self.timeout_ms
                out.append((attempt, "STARTED", at, None))
            elif ended:
                continue
            elif e.kind == "STAGE" and e.stage:
                self.stages.updateValue((e.stage,), (max(attempt, 1),))
                due = max(due, at + self.timeout_ms)
            elif e.kind in ("SUCCEED", "CANCEL"):
                attempt, status, due = max(attempt, 1), "SUCCEEDED" if e.kind == "SUCCEED" else "CANCELLED", at + self.keep_ms
                out.append((attempt, status, at, e.reason))
            elif e.kind == "FAIL":
                attempt = max(attempt, 1)
                if (e.reason or "").lower() in PASSING and attempt < self.attempts:
                    wait = self.retry_ms * 2 ** (attempt - 1)
                    status, due = "WAITING", at + wait + self.timeout_ms
                    out.append((attempt, "RETRY", at + wait, e.reason))
                else:
                    status, due = "FAILED", at + self.keep_ms
                    out.append((attempt, "FAILED", at, e.reason))
        self.task.update((seq, attempt, status, due))
        self._timer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, attempt, status, due = self.task.get()
        if status in ("SUCCEEDED", "CANCELLED", "TIMED_OUT", "FAILED"):
            self.task.clear()
            self.stages.clear()
            return
        self.task.update((seq, attempt, "TIMED_OUT", due + self.keep_ms))
        self.handle.registerTimer(max(due + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._rows(key, [(max(attempt, 1), "TIMED_OUT", due, "no event in time")])

    def _rows(self, key, out: list[tuple]) -> pd.DataFrame:
        kept = self._kept() if out else ""
        frame = pd.DataFrame(out, columns=["attempt", "outcome", "at", "reason"])
        frame["at"] = pd.to_datetime(frame["at"], unit="ms")
        frame["kept"] = kept
        frame.insert(0, "task_id", key[0])
        return frame.astype({"task_id": "int64", "attempt": "int32"})

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, delay: str = "10 minutes", **limits: int) -> DataFrame:
    """Outcomes of the tasks of a stream of events (task_id, seq, ts, kind, stage, reason), as ``OUT``.

    The session's state store must be that of ``STATE_STORE``; ``limits`` are those of ``Lifecycle``.
    """
    timed = events.select(
        F.col("task_id").cast("long"), F.col("seq").cast("long"), F.col("ts").cast("timestamp"), F.upper("kind").alias("kind"), F.col("stage").cast("string"), F.col("reason").cast("string")
    )
    timed = timed.where("task_id is not null and seq is not null and ts is not null").withWatermark("ts", delay)
    return timed.groupBy("task_id").transformWithStateInPandas(Lifecycle(**limits), OUT, "Append", "EventTime")


def met_stages(starts: DataFrame, ends: DataFrame, keys: list[str], within: str, delay: str = "10 minutes") -> DataFrame:
    """(keys, started_at, ended_at, status): each start with its end in a stream of either, by an interval join.

    ``starts`` has the keys and started_at, ``ends`` the keys, ended_at and status. An end belongs to a start if it comes at the
    same time or up to ``within`` later. Once the watermark is beyond that, a start without an end comes out with nulls,
    and state of both sides goes. Rows without a key or time meet nothing; the former come out never, as no time tells when.
    """
    a = starts.select(*keys, F.col("started_at").cast("timestamp").alias("started_at")).withWatermark("started_at", delay)
    b = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("ended_at").cast("timestamp").alias("ended_at"), "status").withWatermark("ended_at", delay)
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    inside = (F.col("ended_at") >= F.col("started_at")) & (F.col("ended_at") <= F.col("started_at") + F.expr(f"interval {within}"))
    return a.join(b, same & inside, "left_outer").select(*keys, "started_at", "ended_at", "status")
