"""Importance resampling towards a target: bucketed word features, log gains, noise, an exact cut.

Features are runs of words, dealt to buckets by crc32. What a bucket gains is the log ratio of its share in
the target and in the documents; the gains form one array, with which tasks score documents. A document's score is
its floored mean gain and noise by its id, so that drawing the highest scores samples without
replacement in proportion to the weights.

The cut is found without sorting all scores: a quantile sketch gives a bracket of scores around it, an exact
count of the rows above and inside tells whether the cut lies there, else the bracket is widened, and only rows
inside are sorted. The rows drawn get their ranks by a sort in ranges and the counts of the ranges before, so no
task and no driver holds more than a range of them.

Documents are read twice, once for counts and once for weights; a count of each bucket is all that a task sends.

Cases: a null or empty text has no features and weight 0; a null id is hashed as the empty string and comes last
among ties; repeated rows are scored alike and ranked as rows of their own; an empty table gives an empty result,
an empty target the gains of no counts; documents under ``min_words`` are scored and never drawn; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.packing import slices
from folioscope.llm.util import Stash, quoted
from folioscope.llm.words import crc32_of, runs_of, words_of

BUCKETS, RUN_WORDS, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: Of the sketch: ranks are right to one part in so many. Brackets that are tried, in those parts to either side.
ACCURACY = 10_000
MARGINS = (2, 16, 128, 1024)
#: Rows of a range that is sorted in one task, about.
ROWS_A_RANGE = 1_000_000


def _buckets(texts: pa.Array, run_words: int, buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each size of run the bucket of each feature and how many each text has; and each text's words."""
    words, counts = words_of(texts)
    out = []
    for size in range(1, run_words + 1):
        runs, n = runs_of(words, counts, size)
        coded = runs.dictionary_encode()
        out.append(((crc32_of(coded.dictionary) % np.uint32(buckets)).astype(np.int64)[coded.indices.to_numpy()], n))
    return out, counts


def count_features(rows: DataFrame, text_col: str = "text", run_words: int = RUN_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all rows in each bucket that has one; a task sends one row a bucket."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in (p for batch in batches for p in slices(batch, 0)):
            for found, _ in _buckets(part.column(0), run_words, buckets)[0]:
                total += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["bucket", "n"])

    counted = rows.select(F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(of, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket gains: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), as an array.

    ``source`` and ``target`` are counts of buckets, so the array and what comes to the driver have one entry a bucket.
    """
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    counts = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    held = np.zeros((2, buckets), np.int64)
    for bucket, s, t in counts:
        held[:, bucket] = s, t
    all_s, all_t = held.sum(axis=1).tolist()
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))) for s, t in held.T.tolist()], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """(uid, doc_id, n_words, n_features, weight): the floored mean of the gains of a document's features."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for part in (p for batch in batches for p in slices(batch, 1)):
            parts, words = _buckets(part.column(1), run_words, len(gains))
            total, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for found, n in parts:
                upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(gains[found])])
                ends = np.cumsum(n)
                total += upto[ends] - upto[ends - n]
                count += n
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            uids = np.arange(uid, uid + len(words))
            uid += len(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids), part.column(0), *(pa.array(x.astype(np.int64)) for x in (words, count, weight))],
                ["uid", "doc_id", "n_words", "n_features", "weight"],
            )

    narrow = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return narrow.mapInArrow(of, "uid long, doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))), h being the first 8 hex digits of sha256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _order() -> list[Column]:
    """Highest score first, then the smallest id, rows without one last; rows that repeat an id by their number."""
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("uid").asc()]


def _place(score: Column, doc_id: Column, uid: Column) -> Column:
    """A value that grows in the same order, of columns or of literals."""
    return F.struct((-score).alias("a"), doc_id.isNull().alias("b"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("c"), uid.alias("d"))


def ranked(rows: DataFrame, count: int, stash: Stash, label: str) -> DataFrame:
    """``rows`` with their rank from 1 by ``_order``: sorted ranges, and the counts of those before.

    The sorted ranges are written once, so that a range that is lost and made again can't be cut elsewhere.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // ROWS_A_RANGE))
    dealt = rows.repartitionByRange(parts, *_order()).sortWithinPartitions(*_order()).withColumn("_at", F.monotonically_increasing_id())
    kept = stash.put(dealt, label)
    upto, starts = 0, []
    for part, n in sorted(kept.groupBy(F.shiftright("_at", 33).alias("part")).count().collect()):  # one row a range
        starts.append((part, upto))
        upto += n
    before = spark.createDataFrame(starts, "_part long, _before long")
    inside = kept.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part")
    return inside.withColumn("rank", F.expr("_before + (_at & 8589934591) + 1")).drop("_part", "_before", "_at")


def bracket(rows: DataFrame, drawn: int, count: int) -> tuple[int, int, int, int]:
    """Scores (low, high) between which the last row drawn lies, the number of rows above, and of those inside.

    One sketch gives all brackets; exact counts validate one or take the next wider, the last of which is all scores.
    """
    at = 1 - drawn / count
    shares = [x for m in MARGINS for x in (max(0.0, at - m / ACCURACY), min(1.0, at + m / ACCURACY))]
    found = rows.agg(F.percentile_approx("score", shares, ACCURACY).alias("q"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    for low, high in [*zip(found.q[::2], found.q[1::2]), (found.low, found.high)]:
        above, inside = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < drawn <= above + inside:
            return low, high, above, inside
    raise AssertionError("the range of all scores holds every cut")


def draw(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` (a written table with uid, doc_id, n_words, score) with the rank of the rows drawn, others null.

    Of the N rows with enough words floor(percent N / 100) are drawn.
    """
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    able = scored.where(F.col("n_words") >= min_words)
    count = able.count()
    drawn = percent * count // 100
    if not drawn:
        return none
    stash = Stash(scored.sparkSession, "importance")
    low, high, above, inside = bracket(able, drawn, count)
    between = ranked(able.where(F.col("score").between(low, high)).select("score", "doc_id", "uid"), inside, stash, "bracket")
    last = between.where(F.col("rank") == drawn - above).first()
    cut = _place(*(F.lit(x).cast("long") for x in (last.score, last.doc_id, last.uid)))
    taken = (F.col("n_words") >= min_words) & (_place(F.col("score"), F.col("doc_id"), F.col("uid")) <= cut)
    return none.where(~taken).unionByName(ranked(scored.where(taken), drawn, stash, "drawn"))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", run_words: int = RUN_WORDS,
    buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank, null where it isn't drawn."""
    gains = gains_of(count_features(docs, text_col, run_words, buckets), count_features(target, target_text_col, run_words, buckets), buckets)
    weights = weigh(docs, gains, id_col, text_col, run_words)
    scored = Stash(docs.sparkSession, "importance").put(weights.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    return draw(scored, min_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
