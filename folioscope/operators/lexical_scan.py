"""The best documents by words for each query of a scope, by a scan in blocks: for many long queries that are asked once.

Scores and cases are those of ``lexical_index``. A long query shares words with nearly every document of its scope, so bounds of
blocks rule nothing out and the work is that of all queries with all documents, quadratic by nature; here no shared word becomes a row.
Texts are dealt to blocks of bounded size. First each block keeps, of the words that its scope's queries ask for, the
documents and counts (a row of arrays a block), from which a word's weight in the scope follows. Then a block meets its scope's
queries: a query's postings are added up by document in an array, and only its best are returned. Parts are whole millionths,
so their sums are exact below 2^53, whatever the order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.lexical_index import DOCS_A_BLOCK, LENGTH_SHARE, MILLION, SATURATION, terms
from folioscope.operators.probing import best_of
from folioscope.sources.scratch import settled

#: Characters of a block's texts, and queries that meet a block in one group.
CHARS_A_BLOCK, QUERIES_A_GROUP = 16 << 20, 4096
KEPT = "block long, part int, no long, ids array<long>, ns array<long>, terms array<string>, starts array<int>, at array<int>, tf array<int>"


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of sorted ``keys`` and where each begins, with the end."""
    values, starts = np.unique(keys, return_index=True)
    return values, np.append(starts, len(keys))


def _by_scope(table: pa.Table) -> dict[int, pa.Table]:
    number = table.column("no").to_numpy()
    order = np.argsort(number, kind="stable")
    table, (names, starts) = table.take(pa.array(order)), _runs(number[order])
    return {name: table.slice(low, high - low) for name, low, high in zip(names, starts, starts[1:])}


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Of lists: each row's number of items, and all items."""
    return pc.list_value_length(column).to_numpy(), pa.chunked_array([c.flatten() for c in column.chunks]).combine_chunks()


def _keep(key: tuple, texts: pa.Table, asked: pa.Table) -> pa.Table:
    """Of a block's documents the lengths, and the postings of the words that are asked for."""
    out = {c: [] for c in ("block", "part", "no", "ids", "ns", "terms", "starts", "at", "tf")}
    wanted = _by_scope(asked) if asked.num_rows else {}
    for no, rows in (_by_scope(texts) if texts.num_rows and wanted else {}).items():
        if no not in wanted:
            continue
        n, words = _flat(rows.column("terms"))
        ids, doc = np.unique(rows.column("id").to_numpy(), return_inverse=True)
        ns = np.bincount(doc, weights=n, minlength=len(ids)).astype(np.int64)
        ids, ns, doc = ids[ns > 0], ns[ns > 0], (np.cumsum(ns > 0) - 1)[doc]  # documents without a word are none
        names = wanted[no].column("term").combine_chunks()
        code = pc.fill_null(pc.index_in(words, names), -1).to_numpy(zero_copy_only=False)
        at = np.repeat(doc, n)[code >= 0]
        pairs, tf = np.unique(code[code >= 0].astype(np.int64) * max(1, len(ids)) + at, return_counts=True)
        codes, starts = _runs(pairs // max(1, len(ids)))
        row = (key[0].as_py(), key[1].as_py(), no, ids, ns, names.take(pa.array(codes)), starts.astype(np.int32), (pairs % max(1, len(ids))).astype(np.int32), tf.astype(np.int32))
        for name, value in zip(out, row):
            out[name].append(value)
    kinds = [pa.int64(), pa.int32(), pa.int64(), *map(pa.list_, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))]
    return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)})


def best_of_block(ids: np.ndarray, parts: np.ndarray, at: np.ndarray, starts: np.ndarray, query_id: int, codes: np.ndarray, k: int | None, skip_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of a query's best ``k`` documents, or of all that share a word; ``codes`` are its words' places."""
    spans = [slice(starts[c], starts[c + 1]) for c in codes]
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    docs, worth = np.concatenate([at[s] for s in spans]), np.concatenate([parts[s] for s in spans])
    score = np.bincount(docs, weights=worth, minlength=len(ids)).astype(np.int64)
    met = score > 0
    met[docs[worth == 0]] = True  # a part may round down to nothing
    if skip_self:
        met &= ids != query_id
    found = np.flatnonzero(met)
    if k is not None and len(found) > k:
        found = found[score[found] >= np.partition(score[found], -k)[-k]]
        found = found[np.lexsort((ids[found], -score[found]))][:k]
    return ids[found], score[found]


def _meet(k: int, skip_self: bool):
    """The best ``k`` documents of a block for each query of a group, within their scope."""

    def of(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        mine = _by_scope(queries) if queries.num_rows and blocks.num_rows else {}
        for block in blocks.to_batches() if mine else ():
            for i in range(block.num_rows):
                row = {name: block.column(name)[i] for name in block.schema.names}
                asked = mine.get(row["no"].as_py())
                if asked is None:
                    continue
                ids, ns, starts, at, tf = (row[c].values.to_numpy() for c in ("ids", "ns", "starts", "at", "tf"))
                n_words, words = _flat(asked.column("terms"))
                idfs = _flat(asked.column("idfs"))[1].to_numpy()
                code = pc.fill_null(pc.index_in(words, row["terms"].values), -1).to_numpy(zero_copy_only=False)
                idf = np.zeros(len(starts) - 1)
                idf[code[code >= 0]] = idfs[code >= 0]
                docs, total = asked.column("docs")[0].as_py(), asked.column("words")[0].as_py()
                count, length = tf.astype(np.float64), ns[at].astype(np.float64)
                saturated = count * (SATURATION + 1) / (count + SATURATION * (1 - LENGTH_SHARE + LENGTH_SHARE * length * docs / total))
                parts = np.floor(MILLION * np.repeat(idf, np.diff(starts)) * saturated)
                ends = np.cumsum(n_words)
                for query_id, several, low, high in zip(asked.column("query_id").to_numpy(), asked.column("several").to_pylist(), ends - n_words, ends):
                    codes = code[low:high]
                    best, score = best_of_block(ids, parts, at, starts, query_id, codes[codes >= 0], None if several else k, skip_self)
                    out.append((np.full(len(best), query_id), best, score))
        return pa.table(dict(zip(("query_id", "id", "score"), (np.concatenate(x) for x in zip(*out)))))

    return of


def search(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", scope_col: str = "label", skip_self: bool = True, length_col: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best documents of each query's scope; scores in millionths.

    ``length_col`` may hold the texts' lengths, so that texts that come from a join needn't pass it once more to be measured.
    """
    shaped = lambda df, *more: df.select(F.col(id_col).cast("long").alias("id"), F.col(scope_col).alias("scope"), F.col(text_col).alias("text"), *more).where("id is not null and scope is not null and text is not null")
    length = F.char_length(text_col) if length_col is None else F.col(length_col)
    rows, asking = shaped(docs, length.cast("double").alias("chars")), shaped(queries)
    sizes = rows.groupBy("scope").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    sizes = sizes.join(asking.groupBy("scope").agg(F.count("*").alias("m")), "scope")
    parts = F.ceil(F.greatest(F.col("n") / DOCS_A_BLOCK, F.col("chars") / CHARS_A_BLOCK, F.lit(1.0))).cast("int")
    sizes = settled(sizes.select("scope", "chars", "n", parts.alias("parts"), F.ceil(F.col("m") / QUERIES_A_GROUP).cast("int").alias("groups"), F.monotonically_increasing_id().alias("no")))
    few = (F.col("parts") == 1) & (F.col("groups") == 1)
    share = F.greatest(F.sum("chars") / CHARS_A_BLOCK, F.sum("n") / DOCS_A_BLOCK)
    shared = max(1, math.ceil(sizes.where(few).agg(share).first()[0] or 0))
    block = F.when(few, -1 - F.pmod(F.xxhash64("no"), F.lit(shared))).otherwise(F.col("no")).alias("block")
    sizes = sizes.select("scope", "parts", "groups", "no", block)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    dealt = rows.drop("chars").join(sizes, "scope").select("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "no", "id", "text")
    dealt = dealt.repartition("block", "part").select("block", "part", "no", "id", terms(F.col("text")).alias("terms"))
    said = settled(asking.join(sizes, "scope").select("no", F.col("id").alias("query_id"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct())
    asked = said.select("no", "term").distinct().join(sizes.select("no", "block", "parts"), "no").select(F.col("block").alias("_block"), all_of("parts").alias("_part"), "no", "term")
    kept = settled(dealt.groupBy("block", "part").cogroup(asked.groupBy("_block", "_part")).applyInArrow(_keep, KEPT))

    held = kept.groupBy("no").agg(F.sum(F.size("ids")).alias("docs"), F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda s, n: s + n)).alias("words"))
    df = kept.select("no", F.posexplode("terms").alias("at", "term"), "starts").groupBy("no", "term").agg(F.sum(F.expr("starts[at + 1] - starts[at]")).alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = said.join(df, ["no", "term"]).join(held, "no").select("no", "query_id", "term", "docs", "words", idf.alias("idf"))
    lists = weighted.groupBy("no", "query_id").agg(F.collect_list(F.struct("term", "idf")).alias("all"), F.first("docs").alias("docs"), F.first("words").alias("words"))
    # a query that asks in several scopes may meet a document in several, and sums only when all of them are there
    lists = lists.withColumn("several", F.count("*").over(Window.partitionBy("query_id")) > 1).join(sizes.select("no", "block", "parts", "groups"), "no")
    mine = lists.select(
        F.col("block").alias("_block"), F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int").alias("_group"), all_of("parts").alias("_part"), "no", "query_id",
        F.col("all.term").alias("terms"), F.col("all.idf").alias("idfs"), "docs", "words", "several",
    )
    there = kept.join(sizes.select("no", "groups"), "no").withColumn("group", all_of("groups")).select(*kept.columns, "group")
    met = there.groupBy("block", "part", "group").cogroup(mine.groupBy("_block", "_part", "_group"))
    found = met.applyInArrow(_meet(k, skip_self), "query_id long, id long, score long")
    return best_of(found.groupBy("query_id", "id").agg(F.sum("score").alias("score")), k, "id")
