"""Durations that add up: counts in buckets of growing width, kept a day and merged on reading.

A duration is counted in the bucket of its logarithm, so that every bucket's middle is within ``accuracy`` of all
durations in it. Counts of days, stages or machines add up, in any order and number, to what counting everything at
once would give; a quantile of the sum is within ``accuracy`` of the exact one, whatever the distribution. A sketch
of a day has at most some thousand rows, so a report over years reads those and no events.

Cases: durations of 0 have a bucket of their own; null, negative and non-finite durations are not counted here but in
``n_unusable``; an empty table gives an empty sketch, and a group without a usable duration has null quantiles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 0.01
#: The bucket of durations of 0.
ZERO = -(1 << 30)


def _growth(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy must be between 0 and 1")
    return (1 + accuracy) / (1 - accuracy)


def bucket_of(seconds: Column, accuracy: float = ACCURACY) -> Column:
    return F.when(seconds == 0, F.lit(ZERO)).otherwise(F.ceil(F.log(seconds) / math.log(_growth(accuracy))).cast("int"))


def middle_of(bucket: Column, accuracy: float = ACCURACY) -> Column:
    growth = _growth(accuracy)
    return F.when(bucket == ZERO, F.lit(0.0)).otherwise(2 * F.pow(F.lit(growth), bucket) / (growth + 1))


def sketch(events: DataFrame, by: list[str], seconds: str, accuracy: float = ACCURACY) -> DataFrame:
    """(by, bucket, n, n_unusable): a row a group and bucket; unusable durations are in a row without a bucket."""
    usable = F.coalesce((F.col(seconds) >= 0) & (F.col(seconds) < float("inf")) & ~F.isnan(seconds), F.lit(False))
    keyed = events.select(*by, F.when(usable, bucket_of(F.col(seconds), accuracy)).alias("bucket"))
    counted = keyed.groupBy(*by, "bucket").agg(F.count("*").alias("all"))
    none = F.lit(0).cast("long")
    return counted.select(*by, "bucket", F.when(F.col("bucket").isNotNull(), F.col("all")).otherwise(none).alias("n"), F.when(F.col("bucket").isNull(), F.col("all")).otherwise(none).alias("n_unusable"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches added up to coarser groups."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.sum("n_unusable").alias("n_unusable"))


def quantiles(sketches: DataFrame, by: list[str], shares: list[float], accuracy: float = ACCURACY) -> DataFrame:
    """(by, n, n_unusable, q1, q2, ...): of each group's n durations in order that at floor(share * (n - 1)), from 0."""
    rows = merged(sketches, by)
    order = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_upto", F.sum("n").over(order)).withColumn("_n", F.sum("n").over(Window.partitionBy(*by)))
    found = [
        F.min(F.when(F.col("bucket").isNotNull() & (F.col("_upto") > F.floor(F.lit(float(share)) * (F.col("_n") - 1))), F.col("bucket"))).alias(f"q{k}")
        for k, share in enumerate(shares, 1)
    ]
    out = placed.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("n_unusable").alias("n_unusable"), *found)
    return out.withColumns({f"q{k}": middle_of(F.col(f"q{k}"), accuracy) for k in range(1, len(shares) + 1)})
