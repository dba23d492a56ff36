"""Ranked lexical search of a set of items over all documents, by blocked matrix products.

Two passes over the documents: the first counts documents, terms, and in how many documents each of the items'
terms occurs; the second scores. There a tile of documents is a dense matrix of term impacts, with a column for
each of the items' terms that the tile has, and the items are a dense matrix of term weights; their product, taken
in float64 a tile of terms at a time, gives all scores of the tile. Impacts are below 2**20, and a tile of terms is
no wider than keeps every partial sum below 2**53, so the products are exact; tiles are added up as integers. Each
task keeps an item's best rows as it goes, rows that tie with the last one kept until ids decide.

Items are a query set: they are worked through in blocks of a bounded number of rows and bytes, whose terms go to
all tasks. What a task returns is bounded by the block, and the best of all tasks are found in two steps, so that no
task sees the rows of one item from all others.

Cases: a null or empty text has no terms, finds nothing and isn't found; a null document id comes last among ties;
repeated documents are rows of their own, and repeated items are ranked each for itself; other columns are ignored;
empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.packing import slices
from folioscope.llm.util import Stash, quoted
from folioscope.llm.words import words_of

BEST = 10
#: Share of a document's length in its score, in hundredths.
LENGTH_SHARE = 90
#: Items and bytes of a block, and documents and terms of a tile.
ITEMS_A_BLOCK, BYTES_A_BLOCK, DOCS_A_TILE, TERMS_A_TILE = 2048, 16 << 20, 256, 1024
#: Candidates that a task gathers before it cuts them to the best.
GATHERED = 1 << 17
#: Parts that an item's candidates are dealt to for the first of two cuts.
SALTS = 32
EXACT = 1 << 53


def _pairs(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's number of terms; and text, term of the vocabulary, and count of all pairs that occur, by text."""
    words, counts = words_of(texts)
    term = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    there = term >= 0
    pair, times = np.unique(row[there] * len(vocabulary) + term[there], return_counts=True)
    return counts, pair // max(len(vocabulary), 1), pair % max(len(vocabulary), 1), times


def count_terms(docs: DataFrame, vocabulary: pa.Array) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms with repeats, and in how many documents each term of the vocabulary occurs.

    ``docs`` has text; a task sends one row a term at most, and the driver gets as many.
    """
    size = len(vocabulary)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for part in (p for batch in batches for p in slices(batch, 0)):
            counts, _, term, _ = _pairs(part.column(0), vocabulary)
            total[:size] += np.bincount(term, minlength=size)
            total[size:] += (counts > 0).sum(), counts.sum()
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["term", "n"])

    found = np.zeros(size + 2, np.int64)
    for term, n in docs.select("text").mapInArrow(of, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        found[term] = n
    return int(found[size]), int(found[size + 1]), found[:size]


def term_weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


class Best:
    """The best ``k`` rows (score, id) of each item so far; ties go to the smallest id, rows without one last."""

    def __init__(self, items: int, k: int):
        self.k, self.least, self.size = k, np.ones(items, np.int64), 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        """``scores`` has a row a document and a column an item; what can't be among the best is left out."""
        doc, item = np.nonzero(scores >= self.least)
        self.parts.append((item, scores[doc, item], ids[doc], nameless[doc]))
        self.size += len(doc)
        if self.size >= GATHERED:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        item, score, ids, nameless = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, nameless, -score, item))
        item, score, ids, nameless = (x[order] for x in (item, score, ids, nameless))
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        last = rank == self.k - 1
        self.least[item[last]] = score[last]
        self.parts = [tuple(x[keep] for x in (item, score, ids, nameless))]
        self.size = int(keep.sum())
        return self.parts[0]


def tile_scores(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, heads: np.ndarray, items_of: np.ndarray, weights: np.ndarray, items: int, width: int) -> np.ndarray:
    """Scores of a tile of documents and all items, as integers.

    ``doc``, ``term`` and ``impact`` are the tile's pairs; ``heads`` says where each term's items begin in ``items_of``.
    """
    out = np.zeros((docs, items), np.int64)
    used, column = np.unique(term, return_inverse=True)
    for at in range(0, len(used), width):
        terms, inside = used[at : at + width], (column >= at) & (column < at + width)
        left = np.zeros((docs, len(terms)))
        left[doc[inside], column[inside] - at] = impact[inside]
        n = heads[terms + 1] - heads[terms]
        right = np.zeros((len(terms), items))
        where = np.repeat(heads[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        right[np.repeat(np.arange(len(terms)), n), items_of[where]] = np.repeat(weights[terms], n)
        out += (left @ right).astype(np.int64)
    return out


def _block_best(docs: DataFrame, item: list[int], texts: list[str], k: int, share: int) -> DataFrame:
    """(item, doc_id, score): each task's best rows of each item of a block."""
    words, counts = words_of(pa.array(texts, pa.string()))
    coded = words.dictionary_encode()
    vocabulary = coded.dictionary
    holds = np.unique(coded.indices.to_numpy().astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), counts))
    heads = np.searchsorted(holds, np.arange(len(vocabulary) + 1) * len(texts))
    items_of = holds % max(len(texts), 1)
    documents, total, df = count_terms(docs, vocabulary)
    weights = term_weights(documents, df)
    width = max(1, min(TERMS_A_TILE, (EXACT - 1) // (10**6 * max(1, int(weights.max(initial=0))))))
    numbers = np.array(item, np.int64)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(numbers), k)
        for part in (p for batch in batches for p in slices(batch, 1)):
            n, doc, term, times = _pairs(part.column(1), vocabulary)
            length = np.array([100 - share + share * x * documents // total for x in n.tolist()], np.int64) if total else n
            impact = 10**9 * times // (1000 * times + 8 * length[doc])
            ids, nameless = pc.fill_null(part.column(0), 0).to_numpy(), part.column(0).is_null().to_numpy(zero_copy_only=False)
            edges = np.searchsorted(doc, np.arange(0, len(n) + DOCS_A_TILE, DOCS_A_TILE))
            for t, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                first = t * DOCS_A_TILE
                rows = slice(first, min(first + DOCS_A_TILE, len(n)))
                scores = tile_scores(doc[a:b] - first, term[a:b], impact[a:b], rows.stop - first, heads, items_of, weights, len(numbers), width)
                best.add(scores, ids[rows], nameless[rows])
        found, score, ids, nameless = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(numbers[found]), pa.array(ids, mask=nameless), pa.array(score)], ["item", "doc_id", "score"])

    return docs.mapInArrow(of, "item long, doc_id long, score long")


def _top(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    share: int = LENGTH_SHARE,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0."""
    stash = Stash(docs.sparkSession, "search")
    asked = stash.put(items.select(F.monotonically_increasing_id().alias("item"), F.col(quoted(item_col)).alias("item_id"), F.col(quoted(item_text_col)).cast("string").alias("text")), "items")
    narrow = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // ITEMS_A_BLOCK), -(-size.bytes // BYTES_A_BLOCK))
    parts = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "text").orderBy("item").collect()
        best = _block_best(narrow, [r.item for r in rows], [r.text for r in rows], k, share)
        parts = best if parts is None else parts.unionByName(best)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    best = _top(_top(salted, k, "item", "salt").drop("rank", "salt"), k, "item")
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
