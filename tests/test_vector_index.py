"""The clustered index against a full scan: exact results, few rows read, edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import retrieval as R
from folioscope.operators import vector_index as V
from folioscope.sources.tables import active_version


def rows_of(x, scopes, start=0):
    return [(start + k, [float(v) for v in row], s) for k, (row, s) in enumerate(zip(x, scopes))]


SCHEMA = "vec_id long, embedding array<float>, label string"


@pytest.fixture(scope="module")
def clustered(spark):
    """60 tight groups in one scope, another scope of 90 rows, and one common vector many times."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 24))
    big = np.repeat(centres, 50, axis=0) + 0.15 * rng.normal(size=(3000, 24))
    rows = rows_of(big, ["big"] * 3000) + rows_of(rng.normal(size=(90, 24)), ["small"] * 90, 3000) + rows_of([centres[0]] * 400, ["big"] * 400, 4000)
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def plain(vectors, queries, k):
    return sorted((r.query_id, r.vec_id, r["rank"]) for r in R.top_k_per_query(R.score_in_scope(vectors, queries, "label", "vec_id").withColumn("score", F.round("score", 12)), k, "query_id", "vec_id").collect())


def found(df):
    return sorted((r.query_id, r.id, r["rank"]) for r in df.collect())


def test_exact_search_reads_few_rows(spark, clustered, tmp_path):
    path = str(tmp_path / "index")
    V.build_index(clustered, path, "1", rows_a_cell=60)
    queries = clustered.where("vec_id % 300 = 7 or vec_id = 4001")
    seen = {}
    got = V.search(spark, path, queries, 10, first=2, seen=seen)
    assert found(got) == plain(clustered, queries, 10)
    one = clustered.where("vec_id = 907")
    assert found(V.search(spark, path, one, 10, first=2, seen=seen)) == plain(clustered, one, 10)
    assert seen["scan"] == 3400 and seen["read"] < seen["scan"] / 5


def test_fixed_probes_have_recall(spark, clustered, tmp_path):
    path = str(tmp_path / "index")
    V.build_index(clustered, path, "1", rows_a_cell=60)
    queries = clustered.where("vec_id < 3000 and vec_id % 60 = 7")
    seen = {}
    want, got = set(plain(clustered, queries, 10)), set(found(V.search(spark, path, queries, 10, first=2, exact=False, seen=seen)))
    pairs = lambda rows: {r[:2] for r in rows}
    assert len(pairs(want) & pairs(got)) >= 0.9 * len(want)


def test_scattered_vectors_stay_exact(spark, tmp_path):
    """Independent directions: bounds rule out little, the result is still that of the scan."""
    x = np.random.default_rng(5).normal(size=(700, 48))
    vectors = spark.createDataFrame(rows_of(x, ["a"] * 500 + ["b"] * 200), SCHEMA)
    path = str(tmp_path / "index")
    V.build_index(vectors, path, "1", rows_a_cell=40)
    queries = vectors.where("vec_id % 100 = 0")
    assert found(V.search(spark, path, queries, 7)) == plain(vectors, queries, 7)


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.0, 0.0], "a"), (3, None, "a"), (4, [], "a"), (5, [math.nan, 1.0], "a"), (6, [1.0, None], "a"), (7, [1.0, 0.0], None), (None, [1.0, 0.0], "a"),
            (8, [2.0, 0.0], "a"), (9, [1.0, 0.0, 0.0], "a"), (10, [-1.0, 0.0], "a"), (11, [1e30, 1e30], "a"), (12, [1.0, 0.0], "b")]
    vectors = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "index")
    V.build_index(vectors, path, "1", rows_a_cell=2)
    got = V.search(spark, path, vectors, 3)
    assert [(r.query_id, r.id) for r in got.orderBy("query_id", "rank").collect()] == [(1, 8), (1, 11), (1, 10), (8, 1), (8, 11), (8, 10), (10, 11), (10, 1), (10, 8), (11, 1), (11, 8), (11, 10)]
    none = V.search(spark, path, vectors.where("vec_id = 4"), 3)
    assert none.count() == 0


def test_empty_index_and_versions(spark, clustered, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(ValueError, match="no active"):
        V.search(spark, path, clustered, 3)
    V.build_index(clustered.limit(0), path, "1")
    assert V.search(spark, path, clustered.limit(5), 3).count() == 0
    V.build_index(clustered, path, "2", rows_a_cell=500)
    assert active_version(spark, path) == "2" and V.search(spark, path, clustered.where("vec_id = 5"), 3).count() == 3


def test_blocks_of_a_hot_cell(spark, clustered, tmp_path, monkeypatch):
    """Rows and queries of one cell meet in many small tasks with the same result."""
    monkeypatch.setattr(V, "ROWS_A_TASK", 37)
    monkeypatch.setattr(V, "QUERIES_A_TASK", 3)
    path = str(tmp_path / "index")
    V.build_index(clustered, path, "1", rows_a_cell=600)
    queries = clustered.where("vec_id % 250 = 1")
    assert found(V.search(spark, path, queries, 12)) == plain(clustered, queries, 12)
