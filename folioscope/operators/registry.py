"""Handlers of tasks by kind: plain functions of DataFrames, looked up by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Handler = Callable[[DataFrame], DataFrame]


class Registry:
    """Which function handles tasks of which kind, and which columns they must hold."""

    def __init__(self) -> None:
        self._of: dict[str, tuple[Handler, tuple[str, ...]]] = {}

    def handles(self, kind: str, needs: tuple[str, ...] = ()) -> Callable[[Handler], Handler]:
        """Registers a function that turns tasks (task_id, ...) into (task_id, result)."""

        def keep(f: Handler) -> Handler:
            if kind in self._of:
                raise ValueError(f"{kind} has a handler")
            self._of[kind] = (f, needs)
            return f

        return keep

    def run(self, tasks: DataFrame) -> DataFrame:
        """(task_id, status, result, fail_reason) of every task (task_id, kind, ...).

        Each kind's tasks go to its handler as one table. Tasks without a handler, or without a column's value that theirs
        needs, fail with a reason and reach no handler.
        """
        none = F.lit(None).cast("string")
        failed = lambda df, reason: df.select("task_id", F.lit("FAILED").alias("status"), none.alias("result"), reason.alias("fail_reason"))
        unknown = tasks.where(~F.coalesce(F.col("kind").isin(list(self._of)), F.lit(False)))
        parts = [failed(unknown, F.concat(F.lit("no handler for "), F.coalesce("kind", F.lit("null"))))]
        for kind, (handler, needs) in self._of.items():
            mine = tasks.where(F.col("kind") == kind)
            missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in needs]) if needs else none
            parts.append(failed(mine.where(missing.isNotNull()), missing))
            done = handler(mine.where(missing.isNull()))
            parts.append(done.select("task_id", F.lit("SUCCEEDED").alias("status"), F.col("result").cast("string").alias("result"), none.alias("fail_reason")))
        return reduce(DataFrame.unionByName, parts)
