"""The scan by words against the index and SQL: odd rows, blocks of any size, and no row for each document that a query meets."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folioscope.operators import lexical_index as L
from folioscope.operators import lexical_scan as W
from folioscope.plans.queries import ORACLE_SQL, QUERIES
from tests.test_queries import rows as plain_rows


def found(df):
    return sorted((r.query_id, r.id, r.score, r["rank"]) for r in df.collect())


def shuffled(spark):
    """Rows that all stages so far have written for a shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, *[getattr(store, f"stageList$default${i}")() for i in range(2, 6)])
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("docs_a_block, queries_a_group", [(4096, 4096), (7, 3)])
def test_blocks_of_any_size_give_what_the_index_gives(spark, monkeypatch, tmp_path, docs_a_block, queries_a_group):
    monkeypatch.setattr(W, "DOCS_A_BLOCK", docs_a_block)
    monkeypatch.setattr(W, "QUERIES_A_GROUP", queries_a_group)
    rng = np.random.default_rng(5)
    words = np.array(["alpha", "Beta", "gamma9", "ÉTÉ", "東京都", "delta", "eps", "zeta", "한국", "x"])
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 12))), "large" if i < 80 else f"s{i % 9}") for i in range(120)]
    rows += [(i, rows[i][1], rows[i][2]) for i in range(30)]  # ids that repeat
    rows += [(5, "alpha delta eps", "s1"), (6, "zeta x", "s1"), (6, "zeta", "s2"), (81, "alpha zeta", "large")]  # in several scopes
    rows += [(200, None, "large"), (201, "", "large"), (202, "?! -", "large"), (None, "alpha", "large"), (203, "alpha", None), (204, "alone", "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    asked = docs.where("doc_id % 3 = 0 or doc_id in (5, 6, 200, 202)")
    L.build_index(docs, str(tmp_path / "index"), "1", scope_col="label")
    want = found(L.search(spark, str(tmp_path / "index"), asked, 6, skip_self=True, id_col="doc_id", scope_col="label"))
    assert len(want) > 200 and found(W.search(docs, asked, 6)) == want
    assert found(W.search(docs.where("doc_id < 0"), asked, 6)) == found(W.search(docs, asked.where("doc_id < 0"), 6)) == []


def test_a_part_of_nothing_still_meets():
    ids, parts, at, starts = np.array([4, 2, 9, 7]), np.array([0.0, 5.0, 0.0]), np.array([0, 1, 2]), np.array([0, 1, 3])
    best, score = W.best_of_block(ids, parts, at, starts, 9, np.array([0, 1]), None, True)
    assert dict(zip(best, score)) == {4: 0, 2: 5}
    best, score = W.best_of_block(ids, parts, at, starts, 1, np.array([0, 1]), 2, True)
    assert (list(best), list(score)) == ([2, 4], [5, 0])


def test_hybrid_has_no_row_for_each_document_that_a_query_meets(spark, tmp_path):
    rng, n = np.random.default_rng(8), 12_000
    x = np.tile(rng.normal(size=(n // 2, 8)), (2, 1)).astype(np.float32)
    text = [" ".join(w) for w in rng.choice([f"w{i}" for i in range(60)], (n, 12))]
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(x), "label": pa.array(np.zeros(n), pa.int32())}), tmp_path / "embeddings.parquet")
    pq.write_table(pa.table({"doc_id": np.arange(n), "text": text}), tmp_path / "documents.parquet")
    before = shuffled(spark)
    got = QUERIES["hybrid_fusion"](spark, str(tmp_path)).toPandas()
    assert shuffled(spark) - before < 10 * n  # of 120 n pairs; by the indexes 21 n
    con = duckdb.connect()
    for table in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    assert plain_rows(got) == plain_rows(con.execute(ORACLE_SQL["hybrid_fusion"]).df())
