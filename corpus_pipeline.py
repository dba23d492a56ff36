"""A corpus pipeline over ``documents``: quality, toxicity, near-dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept;
all but the last return the columns of ``documents``. ``run`` writes each stage's rows to
the shared folder and reads them again for the next, and removes what the stage wrote on its way.

Cases, for every stage: a null text counts as empty: it fails the base rule of quality, scores 0 for
toxicity, is alike to all other texts without a word, holds no secret and packs as its end id alone.
Rows without an id stay where rows are compared; of rows that repeat an id one stays in near-dedup, and
elsewhere each row is judged for itself. Very long texts are processed whole. Equal rows are judged
alike, and ties in a group go to the smallest id. Further columns, whatever their names, stay as they
are up to packing, which leaves them out. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import packing, quality, secrets, shingles, simhash, toxicity
from folioscope.llm.util import Stash, cleared


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules' posterior rejects go."""
    return quality.quality_filter(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores as toxic go; it learns from the labelled ones among these."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies by op1's contract the document with the smallest id stays; not a stage."""
    return simhash.keep_one_per_group(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by 5-word similarity of 0.8 the document with the smallest id stays."""
    return shingles.keep_one_per_group(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mask; n_chars follows the text."""
    masked = secrets.redact_secrets(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts' ids, packed into windows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_similar),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: A trained network and a tokenizer are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    stash = Stash(spark, "pipeline")
    rows, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with cleared(spark):
            rows, read = stash.put(stage(spark, rows, sf_dir), name), before
        if read is not None:
            stash.drop(read)
        before = rows
    return rows
