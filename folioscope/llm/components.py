"""Distributed connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.util import Stash


def _contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace both ends of each edge by their labels; drop loops and repeats."""
    for end in ("a", "b"):
        edges = (
            edges.join(labels.withColumnRenamed("node", end), end)
            .drop(end)
            .withColumnRenamed("label", end)
        )
    return (
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def connected_components(edges: DataFrame, jumps: int = 1) -> DataFrame:
    """Component of every node that has an edge: (node, component), component the smallest node.

    ``edges`` has two columns of one orderable type; loops, nulls and repeats are ignored.
    In each round a node points to its smallest neighbour if that is smaller than itself,
    pointers are followed ``jumps`` times further, and edges move to what their ends
    point to. Neighbours are reduced by a partial minimum before the shuffle, so a hub with
    very many edges gathers nowhere; nothing is collected. A star ends after one round, a
    chain after a logarithmic number. No edges give an empty table.
    """
    spark = edges.sparkSession
    stash = Stash(spark, "components")
    a, b = edges.columns[:2]
    kind = edges.schema[a].dataType
    current = stash.put(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct(),
        "edges",
    )
    maps: list[DataFrame] = []
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        up = up.select("node", F.least("node", "low").alias("label"))
        for _ in range(jumps):
            over = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            up = up.join(over, "label").select("node", F.col("next").alias("label"))
        labels = stash.put(up, "labels")
        maps.append(labels)
        following = stash.put(_contract(current, labels), "edges")
        stash.drop(current)
        current = following
    if not maps:
        return spark.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    out = maps[-1].withColumnRenamed("label", "component")
    for labels in reversed(maps[:-1]):
        later = out.withColumnRenamed("node", "label")
        out = labels.join(later, "label", "left").select(
            "node", F.coalesce("component", "label").alias("component")
        )
    return out
