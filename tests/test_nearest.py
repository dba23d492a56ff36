"""The scan in blocks against SQL and against plain scores: repeats, ties, odd vectors, blocks of any size, and no pair by pair."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioscope.operators import nearest as N
from folioscope.operators import retrieval as R
from folioscope.plans.queries import ORACLE_SQL, QUERIES
from tests.test_queries import rows as plain_rows


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Vectors of three scopes that all come six times under shifted ids, some of them at other lengths, with documents of their numbers."""
    rng, d = np.random.default_rng(11), tmp_path_factory.mktemp("repeated")
    x = np.tile(rng.normal(size=(150, 16)), (6, 1)).astype(np.float32)
    x[450:600] *= 3
    pq.write_table(pa.table({"vec_id": np.arange(900), "embedding": list(x), "label": pa.array(np.arange(900) % 3, pa.int32())}), d / "embeddings.parquet")
    text = ["word " * int(n) for n in rng.integers(1, 80, 900)]
    pq.write_table(pa.table({"doc_id": np.arange(900), "text": text}), d / "documents.parquet")
    return str(d)


def against_sql(spark, d, name):
    con = duckdb.connect()
    for table in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet'")
    df = QUERIES[name](spark, d)
    assert plain_rows(df.toPandas()) == plain_rows(con.execute(ORACLE_SQL[name]).df())
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["recency_fusion", "egress_context", "vector_topk", "rerank_order", "retrieval_refusal"])
def test_repeated_vectors_rank_as_in_sql_and_are_not_compared_pair_by_pair(spark, repeated, name):
    assert "zip_with" not in against_sql(spark, repeated, name)


SCHEMA = "vec_id long, embedding array<double>, label string"


def ranked(df):
    return sorted((r.query_id, r.vec_id, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("block", [1 << 10, 1 << 24])
def test_blocks_of_any_size_give_plain_scores(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_BYTES", block)
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in x], "large") for i, x in enumerate(np.repeat(rng.normal(size=(100, 6)), 3, axis=0))]
    rows += [(1000 + i, [float(v) for v in x], f"s{i % 40}") for i, x in enumerate(rng.normal(size=(120, 6)))]
    rows += [(2000, [1.0, 2.0], "large"), (2001, [2.0, 1.0], "large"), (2002, [0.0] * 6, "large"), (2003, None, "large"), (2004, [1.0, None], "large"), (None, [1.0] * 6, "large")]
    rows += [(2005, [1.0] * 6, None), (5, rows[5][1], "large"), (7, rows[9][1], "large")]
    vectors = spark.createDataFrame(rows, SCHEMA)
    queries = vectors.where("vec_id % 5 = 0 or vec_id in (2001, 2002, 2003)")
    scored = R.score_in_scope(vectors, queries, "label", "vec_id").withColumn("score", F.round("score", 12))
    want = ranked(R.top_k_per_query(scored, 7, "query_id", "vec_id"))
    assert ranked(N.nearest_in_scope(vectors, queries, 7, "label", "vec_id", decimals=12)) == want
    newest = ranked(R.top_k_per_query(scored.withColumn("score", F.col("vec_id")), 7, "query_id", "vec_id"))
    assert ranked(N.newest_in_scope(vectors, queries, 7, "label", "vec_id")) == newest
    assert ranked(N.nearest_in_scope(vectors.where("vec_id < 0"), queries, 7, "label", "vec_id")) == []


def test_equal_and_odd_vectors_in_small_tiles(monkeypatch):
    """All alike: every row is a candidate; extreme lengths and what is no number are compared as they are."""
    monkeypatch.setattr(N, "TILE_BYTES", 8 * 3000 * 4)
    monkeypatch.setattr(N, "PAIRS_AT_ONCE", 1000)
    ids = np.random.default_rng(1).permutation(3000)
    query, at, score = N.best_of_block(ids, np.tile([0.1, 0.3, 0.7], (3000, 1)), np.arange(10), np.tile([0.3, 0.9, 2.1], (10, 1)), 4, None)
    assert list(query) == sorted(list(range(10)) * 4) and (score == 1).all()
    for i in range(10):
        assert list(ids[at[query == i]]) == [j for j in range(5) if j != i][:4]
    x = np.array([[1e-120, 0.0], [1.0, 0.0], [np.nan, 1.0], [0.0, 0.0], [1e120, 1e120]])
    query, at, score = N.best_of_block(np.arange(5), x, np.array([9]), np.array([[1.0, 1.0]]), 9, None)
    assert list(at) == [2, 4, 0, 1] and score[2] == score[3]
