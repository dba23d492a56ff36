"""Changes of several tables at once: all or nothing, two writers, old snapshots, odd keys."""

import pytest
from pyspark.sql import functions as F

from folioscope.sources import snapshots as S


@pytest.fixture
def log(spark, tmp_path):
    log = S.Snapshots(spark, str(tmp_path / "lake"))
    change = log.change()
    change.create("documents", spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a").alias("name")), "doc_id", 8)
    change.create("chunks", spark.range(120).select(F.col("id").alias("chunk_id"), (F.col("id") % 40).alias("doc_id")), "chunk_id", 8)
    assert log.tables() == (0, {}) and change.commit() == 1
    return log


def ids(df, column):
    return sorted(r[0] for r in df.select(column).collect())


def gone(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "doc_id long")


def test_a_cascade_is_seen_whole_or_not_at_all(spark, log):
    change = log.change()
    change.delete("documents", gone(spark, 3, 5, None))
    change.delete("chunks", gone(spark, 3, 5, None), "doc_id")
    assert len(ids(log.read("documents"), "doc_id")) == 40 and len(ids(log.read("chunks"), "chunk_id")) == 120
    before = log.read("chunks")
    assert change.commit() == 2
    assert ids(log.read("documents"), "doc_id") == [k for k in range(40) if k not in (3, 5)]
    assert ids(log.read("chunks"), "chunk_id") == [k for k in range(120) if k % 40 not in (3, 5)]
    assert before.count() == 120 and log.read("documents", 1).count() == 40  # who began before reads on
    assert S.cascade(log, gone(spark, 7).withColumnRenamed("doc_id", "any"), {"documents": "doc_id", "chunks": "doc_id"}) == 3
    assert log.read("chunks").where("doc_id = 7").count() == 0 and log.read("chunks").join(log.read("documents"), "doc_id", "left_anti").count() == 0


def test_only_touched_buckets_are_rewritten(spark, log):
    before = log.tables()[1]
    change = log.change()
    change.delete("documents", gone(spark, 3))
    change.merge("chunks", spark.createDataFrame([(4, 99), (4, 98), (500, 1)], "chunk_id long, doc_id long"))
    change.commit()
    after = log.tables()[1]
    changed = lambda name: [b for b in before[name].parts if before[name].parts[b] != after[name].parts.get(b)]
    assert len(changed("documents")) == 1 and 1 <= len(changed("chunks")) <= 2
    rows = {r.chunk_id: r.doc_id for r in log.read("chunks").collect()}
    assert len(rows) == log.read("chunks").count() == 121 and rows[4] in (98, 99) and rows[500] == 1


def test_two_writers(spark, log):
    """Of two changes to the same rows the second is refused; changes to other buckets, and appends, both stay."""
    first, second, third = log.change(), log.change(), log.change()
    first.delete("documents", gone(spark, 3))
    second.merge("documents", spark.createDataFrame([(3, "b")], "doc_id long, name string"))
    other = next(k for k in range(40) if first._bucket is not None and spark.range(1).select(first._bucket(F.lit(k).cast("long"), 8) == first._bucket(F.lit(3).cast("long"), 8)).first()[0] is False)
    third.merge("documents", spark.createDataFrame([(other, "c")], "doc_id long, name string"))
    assert first.commit() == 2
    with pytest.raises(S.Conflict, match="bucket"):
        second.commit()
    assert third.commit() == 3
    rows = {r.doc_id: r.name for r in log.read("documents").collect()}
    assert 3 not in rows and rows[other] == "c" and len(rows) == 39
    assert log.versions() == [1, 2, 3]


def test_an_append_meets_a_cascade(spark, log):
    """A chunk added while its document is deleted: the cascade sees the table changed and is made again."""
    cascade, calls = log.change(), []
    cascade.delete("chunks", gone(spark, 3), "doc_id")
    late = log.change()
    late.append("chunks", spark.createDataFrame([(700, 3)], "chunk_id long, doc_id long"))
    late.commit()
    with pytest.raises(S.Conflict):
        cascade.commit()

    def again(change):
        calls.append(1)
        change.delete("chunks", gone(spark, 3), "doc_id")
        if len(calls) == 1:
            more = log.change()
            more.append("chunks", spark.createDataFrame([(701, 3)], "chunk_id long, doc_id long"))
            more.commit()

    log.apply(again)
    assert len(calls) == 2 and log.read("chunks").where("doc_id = 3").count() == 0
    with pytest.raises(S.Conflict):
        log.apply(lambda c: (c.depends("chunks"), c.append("documents", spark.createDataFrame([(90, "x")], "doc_id long, name string")),
                             log.apply(lambda d: d.append("chunks", spark.createDataFrame([(702, 9)], "chunk_id long, doc_id long")))), attempts=2)


def test_a_taken_number_is_not_overwritten(spark, log):
    tables = log.tables()[1]
    assert not log._publish(1, {}, "late") and log.tables() == (1, tables)


def test_appends_compaction_and_vacuum(spark, log):
    for k in range(4):
        log.apply(lambda c: c.append("documents", spark.range(100 + k * 50, 150 + k * 50).select(F.col("id").alias("doc_id"), F.lit("n").alias("name"))))
    want = ids(log.read("documents"), "doc_id")
    log.apply(lambda c: c.compact("documents", 2))
    assert ids(log.read("documents"), "doc_id") == want and all(len(f) == 1 for f in log.tables()[1]["documents"].parts.values())
    assert log.vacuum(1) > 0 and ids(log.read("documents"), "doc_id") == want and log.versions() == [6]
    assert log.read("chunks").count() == 120


def test_odd_keys_and_nothing(spark, log):
    change = log.change()
    change.create("odd", spark.createDataFrame([(None, 1), ("a", 2)], "`k.x` string, v int").withColumnRenamed("k.x", "k"), "k", 4)
    change.create("none", spark.createDataFrame([], "k string"), "k")
    change.commit()
    assert log.apply(lambda c: c.delete("odd", spark.createDataFrame([(None,), ("z",)], "k string"))) == 2
    assert log.read("odd").count() == 2 and log.read("none").count() == 0 and log.read("none").columns == ["k"]
    assert log.apply(lambda c: c.delete("odd", spark.createDataFrame([("a",)], "k string"))) == 3
    assert [tuple(r) for r in log.read("odd").collect()] == [(None, 1)]
    assert log.apply(lambda c: c.merge("none", spark.createDataFrame([("q",)], "k string"))) == 4 and log.read("none").count() == 1
    with pytest.raises(ValueError):
        log.change().create("odd", spark.range(1), "id")
