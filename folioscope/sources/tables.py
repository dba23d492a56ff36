"""Readers and writers: Parquet tables, text originals, backups with a manifest, version pointers."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.scalar import row_digest


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Text and Markdown originals, one row a file: path, name, file_type, size_bytes, modified_at, content.

    Bytes are decoded as UTF-8; a file that isn't is marked as damaged rather than dropped.
    Spark's scan leaves out files of no bytes; uploads of size 0 are refused with a reason before.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(
        "path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("file_type"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"), text.alias("content"), text.isNull().alias("damaged"),
    )


def write_version(df: DataFrame, path: str, version: str, partition_by: list[str] | None = None) -> str:
    """Write one version of a table beside the others; nothing reads it until ``activate``."""
    target = f"{path}/version={version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
    return target


def activate(spark: SparkSession, path: str, version: str) -> None:
    """Make a version the one that readers see: a new pointer row is appended."""
    row = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"), F.lit(uuid.uuid4().hex).alias("id"))
    row.write.mode("append").parquet(f"{path}/_pointers_")


def active_version(spark: SparkSession, path: str) -> str | None:
    """The version that was made active last; null where none was."""
    try:
        rows = spark.read.option("ignoreMissingFiles", "true").schema("version string, at timestamp, id string").parquet(f"{path}/_pointers_")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    top = rows.orderBy(F.col("at").desc(), F.col("id").desc()).limit(1).collect()
    return top[0].version if top else None


def read_active(spark: SparkSession, path: str) -> DataFrame:
    version = active_version(spark, path)
    if version is None:
        raise ValueError(f"no active version under {path}")
    return spark.read.parquet(f"{path}/version={version}")


MANIFEST = T.StructType(
    [
        T.StructField("format_version", T.IntegerType()),
        T.StructField("app_version", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("schema", T.StringType()),
    ]
)
FORMAT_VERSION = 1


def table_digest(df: DataFrame) -> DataFrame:
    """One row: rows and an order-free digest (count, and xor and sum of row hashes)."""
    return df.select(row_digest(df).alias("h")).agg(
        F.count("*").alias("rows"),
        F.concat_ws(":", F.hex(F.coalesce(F.bit_xor("h"), F.lit(0))), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string")).alias("digest"),
    )


def backup(tables: dict[str, DataFrame], path: str, app_version: str) -> DataFrame:
    """Write every table and a manifest of row counts and digests of what was written."""
    spark = next(iter(tables.values())).sparkSession
    entries = []
    for name, df in sorted(tables.items()):
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        found = table_digest(spark.read.parquet(f"{path}/{name}")).first()
        entries.append((FORMAT_VERSION, app_version, name, found.rows, found.digest, json.dumps(df.schema.jsonValue())))
    manifest = spark.createDataFrame(entries, MANIFEST)
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/_manifest_")
    return manifest


def verify_backup(spark: SparkSession, path: str) -> DataFrame:
    """Per table of the manifest: table, compatible, intact. Nothing is changed."""
    manifest = spark.read.schema(MANIFEST).json(f"{path}/_manifest_")
    out = []
    for entry in manifest.collect():
        schema = T.StructType.fromJson(json.loads(entry.schema))
        found = table_digest(spark.read.schema(schema).parquet(f"{path}/{entry.table}")).first()
        out.append((entry.table, entry.format_version == FORMAT_VERSION, (found.rows, found.digest) == (entry.rows, entry.digest)))
    return spark.createDataFrame(out, "table string, compatible boolean, intact boolean")


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The backup's tables, if all are compatible and intact; else an error names those that are not."""
    checked = verify_backup(spark, path).collect()
    bad = sorted(r.table for r in checked if not (r.compatible and r.intact))
    if bad:
        raise ValueError("restore refused: " + ", ".join(bad))
    return {r.table: spark.read.parquet(f"{path}/{r.table}") for r in checked}


def rebuild_index(documents: DataFrame, path: str, version: str, chunk, embed) -> DataFrame:
    """After a restore: chunks and vectors of all documents in a new version, which becomes active once both are whole.

    ``chunk`` makes chunks of documents, ``embed`` adds each chunk's vector. Rows are counted before the switch.
    """
    spark = documents.sparkSession
    chunks = chunk(documents)
    written = spark.read.parquet(write_version(embed(chunks), path, version))
    missing = chunks.count() - written.count()
    if missing:
        raise ValueError(f"{missing} chunks have no vector in version {version}")
    activate(spark, path, version)
    return read_active(spark, path)


def export_conversation(messages: DataFrame, path: str) -> None:
    """One JSON line a conversation, messages in order."""
    rows = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    rows.select(F.to_json(F.struct("conv_id", "messages")).alias("value")).write.text(path)
