"""Top-k over an index of cells, each with a bound that no score in it exceeds.

A query reads its most promising cells first. Its k-th best score then rules out all cells whose bound is lower;
the rest are read in widening rounds, and when none is left the result is that of a full scan. What an index
knows of a cell (its rows, its bound for a query) is a small table, so rounds are planned without reading rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sources.scratch import settled

#: Each round reads up to so many times the cells of the one before.
WIDER = 4


def best_of(hits: DataFrame, k: int, id_col: str) -> DataFrame:
    """The best ``k`` (query_id, id, score) of every query with their rank; ties go to the smallest id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def probe(bounds: DataFrame, scan: Callable[[DataFrame], DataFrame], k: int, first: int, id_col: str, slack: float = 0.0, exact: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """(query_id, id, score, rank) of every query's best ``k``, and the (query_id, cell) pairs that each round read.

    ``bounds`` (query_id, cell, bound) has each cell that a query may read; ``scan`` turns pairs into hits. Bounds count
    as ``slack`` higher, for scores that are not exact. Without ``exact`` only the ``first`` cells are read.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), F.col("cell"))
    ranked = settled(bounds.withColumn("turn", F.row_number().over(order)))
    low, high, best, rounds = 0, first, None, []
    while True:
        due = ranked.where((F.col("turn") > low) & (F.col("turn") <= high))
        if best is not None:
            reached = best.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
            due = due.join(reached, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") + slack >= F.col("least")))
        due = settled(due.select("query_id", "cell"))
        if best is not None and due.isEmpty():
            return best, rounds
        found = scan(due)
        if best is not None:
            found = best.select(*found.columns).unionByName(found)
        best, low, high = settled(best_of(found, k, id_col)), high, high + WIDER * (high - low)
        rounds.append(due)
        if not exact:
            return best, rounds
