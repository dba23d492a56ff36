"""Conversations, practice, tasks, costs: order, state and totals over activity rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Amounts that the specification fixes, in USD a month.
ALERT, STOP = Decimal("4"), Decimal("5")

#: Allowed edges of the state machines; the names follow the specification's states in order.
EDGES: dict[str, tuple[tuple[str, str], ...]] = {
    "document": (
        ("to_upload", "uploading"), ("uploading", "parsing"), ("uploading", "failed"), ("parsing", "indexing"),
        ("parsing", "failed"), ("indexing", "ready"), ("indexing", "failed"), ("failed", "parsing"), ("failed", "to_upload"),
    ),
    "message": (("GENERATING", "COMPLETED"), ("GENERATING", "STOPPED"), ("GENERATING", "FAILED")),
    "conversation": (("ACTIVE", "ARCHIVED"),),
    "practice": (("CONFIGURING", "RUNNING"), ("RUNNING", "RUNNING"), ("RUNNING", "COMPLETED")),
    "task": (
        ("PENDING", "RUNNING"), ("PENDING", "CANCELLED"), ("RUNNING", "SUCCEEDED"), ("RUNNING", "FAILED"),
        ("RUNNING", "PARTIAL"), ("RUNNING", "CANCELLED"), ("FAILED", "PENDING"),
    ),
}
TERMINAL = ("SUCCEEDED", "FAILED", "PARTIAL", "CANCELLED")
#: What may be written to logs.
LOG_COLUMNS = ("task_id", "kind", "stage", "status", "started_at", "ended_at", "error_class", "retries")


def restore_conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, messages): every conversation's messages in order."""
    row = F.struct("turn", "role", "text")
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(row)).alias("messages"))


def message_page(messages: DataFrame, before: int, size: int) -> DataFrame:
    """Of every conversation the last ``size`` messages before a turn."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.where(F.col("turn") < before).withColumn("n", F.row_number().over(order)).where(F.col("n") <= size).drop("n")


def recent(df: DataFrame, by: str, id_col: str, n: int) -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(id_col).desc()).limit(n)


def latest(df: DataFrame, keys: list[str], by: str, id_col: str) -> DataFrame:
    """Of each key the row with the greatest (by, id)."""
    top = F.max_by(F.struct(*df.columns), F.struct(by, id_col))
    return df.groupBy(*keys).agg(top.alias("_row")).select("_row.*")


def fold_answer(deltas: DataFrame) -> DataFrame:
    """(conv_id, turn, text, status): received text in order, also where it was stopped; no terminal row: GENERATING."""
    parts = F.sort_array(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("delta"))))
    ends = F.max_by("status", "seq")
    folded = deltas.groupBy("conv_id", "turn").agg(parts.alias("parts"), ends.alias("status"))
    return folded.select("conv_id", "turn", F.array_join("parts.delta", "").alias("text"), F.coalesce("status", F.lit("GENERATING")).alias("status"))


def with_previous(rows: DataFrame, keys: list[str], order_by: list[str], values: list[str], bucket: Column | None = None) -> DataFrame:
    """``rows`` with previous_<value>: what the row before it has among those of its keys, null for the first.

    A key may have very many rows, so none is run through as a whole: rows follow each other inside buckets, which must grow
    with the order (of the first ordering column a day, or a thousand of a number, unless ``bucket`` says otherwise), and
    the first row of a bucket follows the last one of the key's bucket before it.
    """
    named = [F.col(v).alias(f"previous_{v}") for v in values]
    first = F.col(order_by[0])
    usual = F.date_trunc("day", first) if isinstance(rows.schema[order_by[0]].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.floor(first / 1000)
    keyed = rows.withColumn("_bucket", usual if bucket is None else bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order_by)
    lasts = keyed.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(*named), F.struct(*order_by)).alias("_last"))
    lasts = lasts.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket"))).drop("_last")
    lasts = lasts.withColumnsRenamed({k: f"_{k}" for k in [*keys, "_bucket"]})
    same = F.lit(True)
    for k in [*keys, "_bucket"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    met = keyed.withColumn("_row", F.lag(F.struct(*named)).over(inside)).join(lasts, same).withColumn("_row", F.coalesce("_row", "_before"))
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"_row.previous_{v}").alias(f"previous_{v}") for v in values])


def practice_gate(questions: DataFrame) -> DataFrame:
    """``questions`` (session_id, seq, answered, reviewed) with allowed: the one before is answered and reviewed."""
    done = questions.withColumn("_done", F.coalesce(F.col("answered") & F.col("reviewed"), F.lit(False)))
    gated = with_previous(done, ["session_id"], ["seq"], ["_done"])
    return gated.withColumn("allowed", F.coalesce("previous__done", F.lit(True))).drop("_done", "previous__done")


def practice_summary(questions: DataFrame) -> DataFrame:
    """Per session: questions, and how many have each result or none."""
    count = lambda x: F.count_if(F.coalesce(F.col("result") == x, F.lit(False)))
    return questions.groupBy("session_id").agg(
        F.count("*").alias("n"), count("correct").alias("n_correct"), count("partial").alias("n_partial"), count("wrong").alias("n_wrong"),
        F.count_if(F.col("result").isNull()).alias("n_open"),
    )


def monthly_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(month, cost): tokens times price a million, in decimals; ``prices`` (kind, usd_per_million) are few."""
    priced = usage.join(prices, "kind")
    cost = F.sum(F.col("tokens").cast("decimal(20,0)") * F.col("usd_per_million").cast("decimal(10,4)") / F.lit(1_000_000).cast("decimal(10,0)"))
    return priced.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(cost.cast("decimal(20,6)").alias("cost"))


def budget_state(cost: Column) -> Column:
    """STOP from the stop amount on, ALERT from the alert amount on, else OK."""
    return F.when(cost >= F.lit(STOP), "STOP").when(cost >= F.lit(ALERT), "ALERT").otherwise("OK")


def running_spend(usage: DataFrame, month: Column, cost_col: str, order_by: list[str], bucket: Column | None = None) -> DataFrame:
    """``usage`` with what its month spent before each row, and whether the row may still run.

    One budget holds for all rows of a month, so they are not run through in one task: sums of buckets of time (minutes
    of the first ordering column, unless ``bucket`` says otherwise) are added up first, and rows run inside theirs.
    """
    keyed = usage.withColumns({"month": month, "_bucket": F.date_trunc("minute", F.col(order_by[0])) if bucket is None else bucket})
    none = F.lit(0).cast("decimal(20,6)")
    sums = keyed.groupBy("month", "_bucket").agg(F.sum(cost_col).alias("_sum"))
    earlier = Window.partitionBy("month").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("month").alias("_month"), F.col("_bucket").alias("_start"), F.coalesce(F.sum("_sum").over(earlier), none).alias("_before"))
    inside = Window.partitionBy("month", "_bucket").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.col("_before") + F.coalesce(F.sum(cost_col).over(inside), none)
    joined = keyed.join(starts, keyed["month"].eqNullSafe(F.col("_month")) & keyed["_bucket"].eqNullSafe(F.col("_start")))
    return joined.withColumn("spent_before", spent).withColumn("allowed", F.col("spent_before") < F.lit(STOP)).drop("_bucket", "_month", "_start", "_before")


def illegal_transitions(spark: SparkSession, history: DataFrame, machine: str, id_col: str, order_by: list[str]) -> DataFrame:
    """Consecutive states of a resource that no edge allows: (id, from_status, to_status)."""
    edges = spark.createDataFrame(list(EDGES[machine]), "from_status string, to_status string")
    steps = with_previous(history, [id_col], order_by, ["status"]).where("previous_status is not null")
    steps = steps.select(id_col, F.col("previous_status").alias("from_status"), F.col("status").alias("to_status"))
    return steps.join(edges, ["from_status", "to_status"], "left_anti").select(id_col, "from_status", "to_status")


def restartable(tasks: DataFrame, resources: DataFrame) -> DataFrame:
    """Tasks to run again after a restart: not at an end, resource still there, safe to repeat."""
    open_ = tasks.where(~F.col("status").isin(*TERMINAL) & F.coalesce("repeatable", F.lit(False)))
    return open_.join(resources.select("resource_id").distinct(), "resource_id", "left_semi")


def new_tasks(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates, one for each idempotent key, whose key no known task has."""
    return candidates.dropDuplicates(["idem_key"]).join(known.select("idem_key").distinct(), "idem_key", "left_anti")


def diagnostics(events: DataFrame, key: str) -> DataFrame:
    """Per stage: runs, failures, retries and seconds (mean, greatest)."""
    seconds = F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return events.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "FAILED").alias("n_failed"), F.sum("retries").alias("n_retries"),
        F.avg(seconds / 1e6).alias("avg_s"), F.max(seconds / 1e6).alias("max_s"),
    )


def redacted(df: DataFrame, allowed: tuple[str, ...] = LOG_COLUMNS) -> DataFrame:
    """Only columns that logs may hold; what isn't named can't get through."""
    return df.select(*[c for c in allowed if c in df.columns])


def unexplained_failures(tasks: DataFrame) -> DataFrame:
    """Failed or cancelled tasks without a reason."""
    return tasks.where(F.col("status").isin("FAILED", "CANCELLED") & (F.length(F.trim(F.coalesce("fail_reason", F.lit("")))) == 0))


def calls_without_input(messages: DataFrame, asked: str = "user", answered: str = "assistant") -> DataFrame:
    """Answers of a conversation before which no question was stored: a question must be written before the call."""
    firsts = messages.where(F.col("role") == asked).groupBy(F.col("conv_id").alias("_conv")).agg(F.min("turn").alias("_first"))
    answers = messages.where(F.col("role") == answered)
    earlier = answers["conv_id"].eqNullSafe(F.col("_conv")) & (F.col("_first") < F.col("turn"))
    return answers.join(firsts, earlier, "left_anti")


def mixed_contexts(messages: DataFrame, conv_col: str, scope_col: str) -> DataFrame:
    """Conversations that hold more than one scope, with their number of scopes: a switch must open a new conversation."""
    scopes = messages.where(F.col(scope_col).isNotNull()).groupBy(conv_col).agg(F.count_distinct(scope_col).alias("n_scopes"))
    return scopes.where("n_scopes > 1")
