"""Retrieval: scored candidates, refusal on thin evidence, context budget, citations, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.scalar import cosine


def score(vectors: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """``vectors`` with their cosine to the query, a literal of one vector; those without one are left out."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", cosine(F.col(column), literal)).where(F.col("score").isNotNull())


def top_k(scored: DataFrame, k: int, id_col: str) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), F.col(id_col)).limit(k)


def top_k_per_query(scored: DataFrame, k: int, query_col: str, id_col: str) -> DataFrame:
    """The best k of every query; Spark cuts each partition to k before the shuffle."""
    order = Window.partitionBy(query_col).orderBy(F.col("score").desc(), F.col(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def refusals(queries: DataFrame, hits: DataFrame, least: float, query_col: str = "query_id") -> DataFrame:
    """(query, best, refused): refused where no hit reaches ``least``; queries without a hit stay."""
    best = hits.groupBy(query_col).agg(F.max("score").alias("best"))
    return queries.select(query_col).distinct().join(best, query_col, "left").withColumn("refused", ~F.coalesce(F.col("best") >= least, F.lit(False)))


def score_in_scope(vectors: DataFrame, queries: DataFrame, scope_col: str, id_col: str, column: str = "embedding") -> DataFrame:
    """(query_id, id, scope, score) of every vector of each query's scope, without the query itself.

    An equi-join on the scope, which Spark splits where one is large; rows without a cosine are left out.
    """
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(scope_col).alias("_scope"), F.col(column).alias("_query"))
    met = vectors.join(asked, (F.col(scope_col) == F.col("_scope")) & (F.col(id_col) != F.col("query_id")))
    scored = met.select("query_id", id_col, scope_col, cosine(F.col(column), F.col("_query")).alias("score"))
    return scored.where(F.col("score").isNotNull())


def context_budget(hits: DataFrame, budget: int, group_col: str, length_col: str, order_by: list[Column], coarse: Column | None = None) -> DataFrame:
    """Per group the best hits whose running length stays within the budget; lengths are not negative.

    ``coarse`` is a column that the order goes by first: with it, lengths are summed by its values, and only
    rows up to the value at which a group's budget ends are gathered and run through one by one.
    """
    if coarse is not None:
        keyed = hits.withColumn("_coarse", coarse)
        steps = keyed.groupBy(group_col, "_coarse").agg(F.sum(length_col).alias("_n"))
        before = Window.partitionBy(group_col).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
        steps = steps.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") <= budget)
        last = steps.groupBy(group_col).agg(F.max("_coarse").alias("_last")).withColumnRenamed(group_col, "_group")
        hits = keyed.join(last, keyed[group_col].eqNullSafe(F.col("_group"))).where(F.col("_coarse") <= F.col("_last")).drop("_coarse", "_last", "_group")
    so_far = Window.partitionBy(group_col).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("used", F.sum(length_col).over(so_far)).where(F.col("used") <= budget)


def egress(questions: DataFrame, hits: DataFrame, budget: int, order_by: list[Column]) -> DataFrame:
    """(query_id, question, snippets): all that may leave for an outside call, and no other column.

    The question and, best first, its snippets as long as both together stay within ``budget`` characters. ``hits`` (query_id,
    text and what they are ordered by) are a query's few best already; a question over the budget goes without snippets.
    """
    asked = questions.select("query_id", F.col("question"), (F.lit(budget) - F.char_length("question")).alias("_left"))
    so_far = Window.partitionBy("query_id").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order_by))
    used = hits.withColumns({"_used": F.sum(F.char_length("text")).over(so_far), "_place": place}).select("query_id", "text", "_used", "_place")
    fits = used.join(asked.select("query_id", "_left"), "query_id").where(F.col("_used") <= F.col("_left"))
    lists = fits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_place", "text"))).alias("_all"))
    found = asked.join(lists, "query_id", "left")
    return found.select("query_id", "question", F.coalesce(F.transform("_all", lambda s: s["text"]), F.array().cast("array<string>")).alias("snippets"))


def citation_markers(answers: DataFrame) -> DataFrame:
    """(conv_id, turn, n, marker): markers like [3] in the order in which they stand, n from 1.

    A number that no passage can have, of more than 18 digits, is -1, so that it is reported like any forged one.
    """
    found = F.posexplode(F.regexp_extract_all("text", F.lit(r"\[0*([0-9]+)\]"), F.lit(1)))
    number = F.when(F.char_length("digits") <= 18, F.col("digits").cast("long")).otherwise(-1)
    return answers.select("conv_id", "turn", found.alias("pos", "digits")).select("conv_id", "turn", (F.col("pos") + 1).alias("n"), number.alias("marker"))


def bind_citations(markers: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(markers that name a passage given to the answer, with it; markers that name none)."""
    keys = ["conv_id", "turn", "marker"]
    return markers.join(evidence, keys), markers.join(evidence.select(*keys).distinct(), keys, "left_anti")


def fuse(rankings: list[DataFrame], id_col: str, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of tables (id, rank)."""
    parts = rankings[0].select(id_col, "rank")
    for other in rankings[1:]:
        parts = parts.unionByName(other.select(id_col, "rank"))
    return parts.groupBy(id_col).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))


def with_evidence(items: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Items with the list of their evidence, empty where there is none."""
    fields = [c for c in evidence.columns if c not in keys]
    lists = evidence.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("evidence"))
    return items.join(lists, keys, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(lists.schema["evidence"].dataType)))


def rerank(hits: DataFrame, second: Column, query_col: str, id_col: str) -> DataFrame:
    """Hits in the order of a second score, with their new rank."""
    order = Window.partitionBy(query_col).orderBy(F.col("second").desc(), F.col(id_col))
    return hits.withColumn("second", second).withColumn("rank", F.row_number().over(order))


def differing_sources(evidence: DataFrame, keys: list[str], source_col: str, value_col: str) -> DataFrame:
    """Where the sources of one question say different things: keys, and each value with its sources, apart.

    Questions on which all sources agree are left out.
    """
    said = evidence.where(F.col(value_col).isNotNull()).groupBy(*keys, value_col).agg(F.sort_array(F.collect_set(source_col)).alias("sources"))
    several = said.groupBy(*keys).agg(F.count("*").alias("n_values")).where("n_values > 1")
    return said.join(several, keys)


def answer_quality(answers: DataFrame) -> DataFrame:
    """Over ``answers`` (refused, n_markers, n_bound): refusal rate, and the share of markers and of answers that evidence supports."""
    given = ~F.col("refused")
    return answers.agg(
        F.count("*").alias("n"), F.avg(F.col("refused").cast("double")).alias("refusal_rate"),
        (F.sum("n_bound") / F.sum("n_markers")).alias("marker_support"),
        (F.count_if(given & (F.col("n_bound") > 0) & (F.col("n_bound") == F.col("n_markers"))) / F.count_if(given)).alias("answer_support"),
    )
