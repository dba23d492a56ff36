"""An inverted index in versions and ranked search in it, by bounds of its blocks.

A posting is a term's count in a document with the document's length. Documents are dealt to blocks of bounded
size within their scope; a block is one partition folder of the stored postings, and of every term in it the highest
weight that a document reaches is kept beside them. The sum of these over a query's terms bounds all scores of
the block, so a search reads its best blocks first and then only those that can still hold a better document;
the result is that of a full scan.

Scores follow Okapi BM25: a term's weight falls with the documents of the scope that hold it, its count saturates, and long
documents count less. A term's part is rounded down to millionths, so sums don't depend on the order of
adding and ties are ties; they go to the smallest id.

Terms are runs of letters, marks and digits in lower case. Runs of Chinese, Japanese or Korean signs, which have no spaces
between words, are cut into all pairs of neighbours (a single sign is a term of its own).

Cases: null or empty texts and those without a term are in no block and find nothing; rows without an id or a scope are
left out; rows that repeat an id are one document of all their words; an empty table gives an index in which nothing is found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators.probing import probe
from folioscope.sources.scratch import settled
from folioscope.sources.tables import activate, active_version, write_version

#: How fast counts saturate, and how much a document's length counts.
SATURATION, LENGTH_SHARE = 1.2, 0.75
DOCS_A_BLOCK = 4096
MILLION = 1_000_000
#: Signs of scripts without spaces: kana, ideographs, hangul.
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
RUN = rf"[{CJK}]+|[\p{{L}}\p{{M}}\p{{N}}&&[^{CJK}]]+"
#: What runs are where a text has no such sign.
PLAIN = r"[\p{L}\p{M}\p{N}]+"


def terms(text: Column) -> Column:
    """The terms of a text in order, with repeats; none for a null text."""
    pairs = lambda run: F.regexp_extract_all(run, F.lit("(?s)(?=(..))"), F.lit(1))
    cut = lambda run: F.when(run.rlike(f"^[{CJK}]") & (F.char_length(run) > 1), pairs(run)).otherwise(F.array(run))
    mixed = F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit(RUN), F.lit(0)), cut))
    plain = F.regexp_extract_all(F.lower(text), F.lit(PLAIN), F.lit(0))
    return F.coalesce(F.when(F.lower(text).rlike(f"[{CJK}]"), mixed).otherwise(plain), F.array().cast("array<string>"))


def _saturated(tf: Column, n: Column, docs: Column, words: Column) -> Column:
    return tf * (SATURATION + 1) / (tf + SATURATION * (1 - LENGTH_SHARE + LENGTH_SHARE * n * docs / words))


def _part(idf: Column, saturated: Column) -> Column:
    return F.floor(MILLION * idf * saturated).cast("long")


def _postings(spark: SparkSession, target: str, scope_kind: str) -> DataFrame:
    """Stored postings, also where there is none."""
    return spark.read.schema(f"id long, scope {scope_kind}, term string, tf long, n long, block string").parquet(target)


def build_index(docs: DataFrame, path: str, version: str, id_col: str = "doc_id", text_col: str = "text", scope_col: str | None = None, docs_a_block: int = DOCS_A_BLOCK) -> None:
    """Write a version of the index and, once it is whole, make it the active one."""
    spark = docs.sparkSession
    scope = F.lit("") if scope_col is None else F.col(scope_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), scope.alias("scope"), F.col(text_col).alias("text")).where("id is not null and scope is not null and text is not null")
    sizes = settled(rows.groupBy("scope").agg(F.ceil(F.count("*") / docs_a_block).cast("int").alias("blocks"), F.count("*").alias("n")))
    shared = max(1, math.ceil((sizes.where("blocks = 1").agg(F.sum("n")).first()[0] or 0) / docs_a_block))
    own = F.concat(F.lower(F.hex(F.xxhash64("scope"))), F.lit("-"), F.pmod(F.xxhash64("id"), F.col("blocks")))
    block = F.when(F.col("blocks") > 1, own).otherwise(F.concat(F.lit("shared-"), F.pmod(F.xxhash64("scope"), F.lit(shared))))
    # texts are dealt to their blocks once; counts and lengths then need no further shuffle
    dealt = rows.join(sizes, "scope").select("id", "scope", block.alias("block"), "text").repartition("block", "id")
    counts = dealt.select("block", "scope", "id", F.explode(terms(F.col("text"))).alias("term")).groupBy("block", "id", "scope", "term").agg(F.count("*").alias("tf"))
    length = F.sum("tf").over(Window.partitionBy("block", "id", "scope"))
    target = write_version(counts.withColumn("n", length).hint("rebalance", "block").sortWithinPartitions("block", "term"), f"{path}/postings", version, ["block"])
    postings = _postings(spark, target, rows.schema["scope"].dataType.simpleString())
    held = postings.groupBy("scope", "id").agg(F.first("n").alias("n")).groupBy("scope").agg(F.count("*").alias("docs"), F.sum("n").alias("words"))
    write_version(held, f"{path}/scopes", version)
    held = spark.read.parquet(f"{path}/scopes/version={version}")
    tops = postings.join(held, "scope").groupBy("scope", "term", "block").agg(
        F.max(_saturated(F.col("tf"), F.col("n"), F.col("docs"), F.col("words"))).alias("top"), F.count("*").alias("df")
    )
    write_version(tops, f"{path}/tops", version)
    activate(spark, path, version)


def search(
    spark: SparkSession, path: str, queries: DataFrame, k: int, first: int = 4, exact: bool = True, skip_self: bool = False,
    id_col: str = "query_id", text_col: str = "text", scope_col: str | None = None, seen: dict[str, int] | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best documents of each query's scope, from the active version; scores in millionths.

    With ``exact`` blocks are read until no other can hold a better document; without, the ``first`` blocks only. ``seen``, if
    given, gets the postings of the blocks that were read and of the whole index.
    """
    version = active_version(spark, path)
    if version is None:
        raise ValueError(f"no active version under {path}")
    of = lambda name: spark.read.parquet(f"{path}/{name}/version={version}")
    scope = F.lit("") if scope_col is None else F.col(scope_col)
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), scope.alias("scope"), F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term"))
    asked = asked.where("query_id is not null and scope is not null").distinct()
    met = settled(asked.join(of("tops"), ["scope", "term"]).join(of("scopes"), "scope"))
    df = met.groupBy("query_id", "scope", "term").agg(F.sum("df").alias("df"), F.first("docs").alias("docs"), F.first("words").alias("words"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = settled(df.select("query_id", "scope", "term", "docs", "words", idf.alias("idf")))
    keys = ["query_id", "scope", "term"]
    bounds = met.select(*keys, "block", "top").join(weighted, keys).groupBy("query_id", F.col("block").alias("cell")).agg(F.sum(_part(F.col("idf"), F.col("top"))).alias("bound"))

    def scan(due: DataFrame) -> DataFrame:
        names = [r.cell for r in due.select("cell").distinct().collect()]  # at most one row a block of the index
        wanted = due.withColumnRenamed("cell", "block").join(weighted, "query_id")
        postings = _postings(spark, f"{path}/postings/version={version}", of("scopes").schema["scope"].dataType.simpleString())
        postings = postings.where(F.col("block").isin(names) if names else F.lit(False))
        hits = postings.join(wanted, ["block", "scope", "term"])
        if skip_self:
            hits = hits.where("id <> query_id")
        part = _part(F.col("idf"), _saturated(F.col("tf"), F.col("n"), F.col("docs"), F.col("words")))
        return hits.groupBy("query_id", "id").agg(F.sum(part).alias("score"))

    best, rounds = probe(bounds, scan, k, first, "id", 0, exact)
    if seen is not None:
        rows_of = of("tops").groupBy(F.col("block").alias("cell")).agg(F.sum("df").alias("rows"))
        read = [due.select("cell").distinct().join(rows_of, "cell").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] for due in rounds]
        seen |= {"read": sum(read), "scan": rows_of.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]}
    return best
