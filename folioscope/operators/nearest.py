"""The nearest vectors of each query's scope by a scan in blocks, exact, distributed and in bounded memory; and the newest.

All queries of a scope meet all its vectors, which is quadratic by nature; so it is products of matrices. Vectors and queries of
a scope are dealt to blocks of bounded bytes, and each pair of blocks is a group of its own that returns the best of each query.
Products name the candidates, with a margin for the order of adding; only these get their cosine again, components added in
their order and held within -1 and 1, as SQL's list_cosine_similarity does it. So equal vectors tie to the last bit wherever
they lie, ties go to the smallest id, and ranks are SQL's.

Cases: rows without an id, a scope or a vector, with a null component or without length are left out, and vectors of other
lengths than the query are not compared; a cosine that is not a number comes first, as in SQL; rows and queries that repeat an
id count each for itself; small scopes share blocks; empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.retrieval import top_k_per_query
from folioscope.sources.scratch import settled

#: Bytes of the vectors, as doubles, that one side of a group holds; and of the products that are in memory at once.
BLOCK_BYTES, TILE_BYTES = 16 << 20, 8 << 20
#: Products and cosines in their order differ by less than this, and so do cosines rounded to 10 decimals or more.
MARGIN = 1e-9
PAIRS_AT_ONCE = 1 << 18


def _rounded(x: np.ndarray, decimals: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds."""
    y = x * 10.0**decimals
    whole = np.trunc(y)
    return (whole + np.where(np.abs(y - whole) >= 0.5, np.sign(y), 0.0)) / 10.0**decimals + 0.0


def _squares(columns: np.ndarray) -> np.ndarray:
    total = np.zeros(columns.shape[1])
    for c in columns:
        total += c * c
    return total


def _units(x: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and which have a length that products can be trusted with; the others are 0."""
    sound = (squares > 1e-200) & (squares < 1e200)
    return np.where(sound, x.T, 0.0).T / np.sqrt(np.where(sound, squares, 1.0))[:, None], sound


def best_of_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, decimals: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the row, cosine) of the best ``k`` rows of each query, itself left out."""
    with np.errstate(all="ignore"):
        columns, asked = np.ascontiguousarray(x.T), np.ascontiguousarray(q.T)
        xx, qq = _squares(columns), _squares(asked)
        (u, sound), (w, clear) = _units(x, xx), _units(q, qq)
        odd, n = np.flatnonzero(~sound), len(x)
        by_id = np.argsort(ids, kind="stable")
        own = [np.searchsorted(ids[by_id], query_ids, side) for side in ("left", "right")]
        groups = max(4 * k, 256)
        wide = n // groups
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, TILE_BYTES // (8 * n))
        for start in range(0, len(q), step):
            seen = w[start : start + step] @ u.T
            seen[:, odd] = -np.inf
            selves = [by_id[own[0][start + i] : own[1][start + i]] for i in range(len(seen))]
            for row, self_at in zip(seen, selves):
                row[self_at] = -np.inf
            # the k-th of some rows' scores is no more than the k-th of all: of the highest of each of many groups, or of all
            some = seen[:, : groups * wide].reshape(len(seen), wide, groups).max(axis=1) if wide > 1 else seen
            least = np.partition(some, -k, axis=1)[:, -k] - MARGIN if some.shape[1] >= k else np.full(len(seen), -np.inf)
            chosen = seen >= least[:, None]
            chosen[:, odd] = True
            chosen[~clear[start : start + step]] = True
            for row, self_at in zip(chosen, selves):
                row[self_at] = False
            query, at = np.nonzero(chosen)
            score = np.empty(len(at))
            for low in range(0, len(at), PAIRS_AT_ONCE):
                i, j = query[low : low + PAIRS_AT_ONCE] + start, at[low : low + PAIRS_AT_ONCE]
                total = np.zeros(len(i))
                for a, b in zip(asked, columns):
                    total += a[i] * b[j]
                length = np.sqrt(qq[i] * xx[j])
                score[low : low + PAIRS_AT_ONCE] = np.where(length == 0, -np.inf, np.clip(total / length, -1.0, 1.0))
            there = score != -np.inf
            query, at, score = query[there], at[there], score[there]
            if decimals is not None:
                score = _rounded(score, decimals)
            order = np.lexsort((ids[at], np.where(np.isnan(score), -np.inf, -score), query))
            query, at, score = query[order], at[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            out.append((query[place < k] + start, at[place < k], score[place < k]))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def _parts(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of each scope of a block."""
    number = table.column("no").to_numpy()
    order = np.argsort(number, kind="stable")
    sorted_, number = table.take(pa.array(order)), number[order]
    names, starts = np.unique(number, return_index=True)
    out = {}
    for name, low, high in zip(names, starts, [*starts[1:], len(number)]):
        part = sorted_.slice(low, high - low)
        flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in part.column("vector").chunks])
        out[name] = part.column("id").to_numpy(), flat.astype(np.float64).reshape(high - low, -1)
    return out


def _meet(k: int, decimals: int | None):
    """The best ``k`` rows of a block for each query of a block of queries, within their scope."""

    def of(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        there = _parts(rows) if rows.num_rows and queries.num_rows else {}
        for no, (query_ids, q) in _parts(queries).items() if there else ():
            if no in there:
                ids, x = there[no]
                query, at, score = best_of_block(ids, x, query_ids, q, k, decimals)
                out.append((query_ids[query], ids[at], score))
        return pa.table(dict(zip(("query_id", "id", "score"), (np.concatenate(parts) for parts in zip(*out)))))

    return of


def _shaped(df: DataFrame, id_col: str, scope_col: str, column: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(scope_col).alias("scope"), F.col(column).alias("vector"), F.size(column).alias("size"))
    return rows.where(F.col("id").isNotNull() & F.col("scope").isNotNull() & (F.col("size") > 0) & F.forall("vector", lambda x: x.isNotNull()))


def nearest_in_scope(vectors: DataFrame, queries: DataFrame, k: int, scope_col: str, id_col: str, column: str = "embedding", decimals: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest of each query's scope by cosine, without the query itself.

    With ``decimals`` (10 or more) cosines are rounded before they are compared.
    """
    keys = ["scope", "size"]
    rows, asked = (_shaped(df, id_col, scope_col, column) for df in (vectors, queries))
    blocks = lambda n: F.ceil(F.col(n) * F.col("size") * 8 / F.lit(float(BLOCK_BYTES))).cast("int")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).join(asked.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    sizes = settled(sizes.select(*keys, "n", blocks("n").alias("parts"), blocks("m").alias("groups"), F.monotonically_increasing_id().alias("no")))
    few = (F.col("parts") == 1) & (F.col("groups") == 1)
    shared = max(1, math.ceil((sizes.where(few).agg(F.sum(F.col("n") * F.col("size") * 8)).first()[0] or 0) / BLOCK_BYTES))
    block = F.when(few, -1 - F.pmod(F.xxhash64("no"), F.lit(shared))).otherwise(F.col("no")).alias("block")
    sizes = sizes.select(*keys, "parts", "groups", "no", block)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("group", all_of("groups"))
    right = asked.join(sizes, keys).withColumn("group", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")).withColumn("part", all_of("parts"))
    at = ["block", "part", "group"]
    right = right.select(*[F.col(c).alias(f"_{c}") for c in at], "no", "id", "vector")  # both sides have these columns from one table
    met = left.select(*at, "no", "id", "vector").groupBy(*at).cogroup(right.groupBy(*[f"_{c}" for c in at]))
    found = met.applyInArrow(_meet(k, decimals), "query_id long, id long, score double")
    return top_k_per_query(found.withColumnRenamed("id", id_col), k, "query_id", id_col)


def newest_in_scope(vectors: DataFrame, queries: DataFrame, k: int, scope_col: str, id_col: str, column: str = "embedding") -> DataFrame:
    """(query_id, id, rank): the ``k`` highest ids of each query's scope among the vectors that can be compared with it, without the query itself.

    Only a scope's ``k`` + 1 highest ids meet its queries, each as often as it is there and ``k`` times at most.
    """
    keys = ["scope", "size"]
    rows = _shaped(vectors, id_col, scope_col, column).where(F.exists("vector", lambda x: x != 0)).select(*keys, "id")
    asked = _shaped(queries, id_col, scope_col, column).where(F.exists("vector", lambda x: x != 0)).select(*keys, F.col("id").alias("query_id"))
    ranked = rows.withColumn("place", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col("id").desc()))).where(F.col("place") <= k + 1)
    tops = ranked.groupBy(*keys, "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    met = asked.join(tops, keys).where("id <> query_id").select("query_id", F.col("id").alias(id_col), F.explode(F.sequence(F.lit(1), "times")))
    return top_k_per_query(met.select("query_id", id_col, F.col(id_col).alias("score")), k, "query_id", id_col).drop("score")
