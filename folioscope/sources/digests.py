"""Digests by part: a tree over a table's parts tells which differ, so that only those are read and restored.

Rows are dealt to parts by their key. A leaf of the tree holds a part's number of rows and an order-free digest of them; each
node above holds those of its ``FAN`` children. Two tables are compared from the root down, following only nodes that differ:
equal tables after one row, tables that differ in one row after one path. A backup keeps its parts in folders
and its tree beside them, so a repair fetches the folders of the parts that differ and no others.

Cases: null keys are in a part like any value; repeated rows count as often as they are there; parts without rows are
not in the tree and equal each other; an empty table has a root of no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.scalar import row_digest

PARTS, FAN = 4096, 16


def part_of(key: Column, parts: int) -> Column:
    """By the first digits of a digest of the key as text."""
    return F.pmod(F.conv(F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), 1, 12), 16, 10).cast("long"), F.lit(parts)).cast("int")


def _depth(parts: int) -> int:
    depth = 0
    while FAN**depth < parts:
        depth += 1
    return depth


def digest_tree(df: DataFrame, key: str, parts: int = PARTS, digest: Column | None = None) -> DataFrame:
    """(level, node, n, digest): the root is at level 0, the parts with rows at the last one.

    ``digest`` is a row's digest as a long, unless given a hash of the whole row. One pass over the rows; all above the
    parts is a small table.
    """
    hashed = df.select(part_of(F.col(key), parts).alias("node"), (row_digest(df) if digest is None else digest).alias("_h"))
    # the sum catches what comes twice and cancels out of the other
    low = F.col("_h").cast("decimal(38,0)")
    rows = hashed.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor("_h").alias("x"), F.sum(low).alias("s"))
    level = rows.select("node", "n", F.sha2(F.concat_ws(":", F.col("n"), F.col("x"), F.col("s")), 256).alias("digest"))
    depth = _depth(parts)
    tree = level.select(F.lit(depth).alias("level"), "node", "n", "digest")
    for at in reversed(range(depth)):
        children = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat_ws("=", c["node"], c["digest"])), ",")
        level = level.groupBy(F.expr(f"node div {FAN}").cast("int").alias("up")).agg(F.sum("n").alias("n"), F.sha2(children, 256).alias("digest")).withColumnRenamed("up", "node")
        tree = tree.unionByName(level.select(F.lit(at).alias("level"), "node", "n", "digest"))
    return tree


def differing_parts(ours: DataFrame, theirs: DataFrame, parts: int = PARTS) -> list[int]:
    """Parts that are not the same in both trees, found from the root down."""
    nodes = [0]
    for level in range(_depth(parts) + 1):
        if not nodes:
            break
        of = lambda tree, name: tree.where((F.col("level") == level) & F.col("node").isin(nodes)).select("node", F.struct("n", "digest").alias(name))
        unlike = of(ours, "a").join(of(theirs, "b"), "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        found = sorted(r.node for r in unlike.select("node").collect())  # at most one a part
        nodes = found if level == _depth(parts) else [FAN * n + k for n in found for k in range(FAN)]
    return nodes


def backup_parts(df: DataFrame, path: str, key: str, parts: int = PARTS) -> None:
    """Write the table in folders of parts, and the tree of what was written."""
    df.withColumn("_part", part_of(F.col(key), parts)).hint("rebalance", "_part").write.mode("errorifexists").partitionBy("_part").parquet(f"{path}/rows")
    stored = _stored(df.sparkSession, path, df.schema).drop("_part")
    digest_tree(stored, key, parts).coalesce(1).write.mode("errorifexists").parquet(f"{path}/tree")


def _stored(spark: SparkSession, path: str, schema, parts: list[int] | None = None) -> DataFrame:
    """The backup's rows with their ``_part``, of some parts only if they are named: other folders aren't read."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_part", T.IntegerType())])).parquet(f"{path}/rows")
    return rows if parts is None else rows.where(F.col("_part").isin(parts) if parts else F.lit(False))


def damaged_parts(spark: SparkSession, path: str, schema, key: str, parts: int = PARTS) -> list[int]:
    """Parts of the backup that are not what its tree says."""
    return differing_parts(digest_tree(_stored(spark, path, schema).drop("_part"), key, parts), spark.read.parquet(f"{path}/tree"), parts)


def repaired(df: DataFrame, path: str, key: str, parts: int = PARTS) -> tuple[DataFrame, list[int]]:
    """The table as the backup has it, and the parts that were taken from there; an error if those are damaged."""
    spark = df.sparkSession
    tree = spark.read.parquet(f"{path}/tree")
    unlike = differing_parts(digest_tree(df, key, parts), tree, parts)
    fetched = _stored(spark, path, df.schema, unlike).drop("_part")
    bad = [p for p in differing_parts(digest_tree(fetched, key, parts), tree.where((F.col("level") < _depth(parts)) | F.col("node").isin(unlike)), parts) if p in unlike] if unlike else []
    if bad:
        raise ValueError(f"restore refused: parts {bad} of the backup are damaged")
    kept = df.where(~part_of(F.col(key), parts).isin(unlike)) if unlike else df
    return kept.unionByName(fetched), unlike
