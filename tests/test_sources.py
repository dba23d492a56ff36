"""Files, versions, backups and streams."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions.scalar import normal_form, normalise, task_key
from folioscope.operators import documents as D
from folioscope.operators.activity import LOG_COLUMNS
from folioscope.operators.embedding import HashedWords, embed
from folioscope.operators.registry import Registry
from folioscope.sources import tables as S
from folioscope.sources.snapshots import Snapshots, append_log
from folioscope.streaming import ingest


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo\nthere")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "c.txt").write_text("")
    got = {r.name: r for r in S.read_text(spark, str(tmp_path)).collect()}
    assert got["a.txt"].content == "héllo\nthere" and got["a.txt"].file_type == "txt" and not got["a.txt"].damaged
    assert got["b.md"].damaged and got["b.md"].content is None
    assert set(got) == {"a.txt", "b.md"}


def test_versions(spark, tmp_path):
    path = str(tmp_path / "index")
    S.write_version(spark.range(3), path, "1")
    S.activate(spark, path, "1")
    S.write_version(spark.range(5), path, "2")
    assert S.read_active(spark, path).count() == 3
    S.activate(spark, path, "2")
    assert S.read_active(spark, path).count() == 5


def test_backup_and_restore(spark, tmp_path):
    path = str(tmp_path / "backup")
    tables = {"a": spark.createDataFrame([(1, "x"), (2, None)], "id int, t string"), "b": spark.createDataFrame([], "id int")}
    S.backup(tables, path, "1.0")
    assert {n: df.count() for n, df in S.restore(spark, path).items()} == {"a": 2, "b": 0}
    spark.createDataFrame([(3, "y")], "id int, t string").write.mode("append").parquet(f"{path}/a")
    with pytest.raises(ValueError, match="a"):
        S.restore(spark, path)


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "user", "b"), (1, 0, "user", "a")], "conv_id int, turn int, role string, text string")
    S.export_conversation(rows, str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first()[0]
    assert line.index('"a"') < line.index('"b"')


def test_stage_restarts_without_replay(spark, tmp_path):
    source, sink, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for k in range(2):
        spark.createDataFrame([(k, "one\n\ntwo")], "doc_id long, text string").write.mode("append").parquet(source)
        ingest.run_stage(ingest.read_stream(spark, source, "doc_id long, text string"), sink, at, "parse").awaitTermination()
        assert spark.read.parquet(sink).count() == 2 * (k + 1)
    for stage, n in (("chunk", 4), ("sections", 4)):
        ingest.run_stage(ingest.read_stream(spark, source, "doc_id long, text string"), f"{sink}-{stage}", f"{at}-{stage}", stage, 5, 1).awaitTermination()
        assert spark.read.parquet(f"{sink}-{stage}").count() == n


def test_streams(spark, tmp_path):
    schema = "task_id long, seq long, status string, ts timestamp_ntz"
    rows = [(1, 0, "RUNNING", "2024-01-01 00:00:00"), (1, 1, "FAILED", "2024-01-01 00:01:00"), (1, 2, "RUNNING", "2024-01-01 00:02:00"), (1, 2, "RUNNING", "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "task_id long, seq long, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))

    def drain(stream, mode):
        q = stream.writeStream.format("memory").queryName("q").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return [tuple(r) for r in spark.table("q").collect()]

    read = lambda: ingest.read_stream(spark, str(tmp_path / "in"), schema)
    assert drain(ingest.task_states(read()), "update") == [(1, "RUNNING", 3, 2)]
    assert len(drain(ingest.deduplicated(read(), "ts", ["task_id", "seq"], "1 hour"), "append")) == 3
    assert sum(r[2] for r in drain(ingest.windowed_counts(read(), "ts", "task_id", "1 minute", "0 seconds"), "update")) == 4


def test_rebuild_after_restore(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g")], "doc_id long, text string")
    chunk = lambda df: D.chunks(df, 4, 1)
    embed = lambda df: df.withColumn("vector", F.array(F.char_length("text").cast("double")))
    path = str(tmp_path / "index")
    first = S.rebuild_index(docs, path, "1", chunk, embed)
    assert first.count() == chunk(docs).count() and S.active_version(spark, path) == "1"
    with pytest.raises(ValueError, match="no vector"):
        S.rebuild_index(docs, path, "2", chunk, lambda df: embed(df).where("doc_id = 1"))
    assert S.active_version(spark, path) == "1"


def test_tasks_are_handled_once(spark, tmp_path):
    """Rows that come again, in the same batch, in a later one or after a lost checkpoint, are not handled again; files don't pile up."""
    source, log, calls = str(tmp_path / "in"), Snapshots(spark, str(tmp_path / "lake")), []
    key = task_key(F.col("doc_id"), F.col("text"))

    def handle(fresh):
        rows = fresh.select("idem_key", "doc_id").collect()
        calls.extend(r.doc_id for r in rows)
        return spark.createDataFrame(rows, "idem_key string, doc_id long")

    def run(checkpoint):
        stream = ingest.read_stream(spark, source, "doc_id long, text string")
        ingest.handle_once(stream, log, str(tmp_path / checkpoint), key, handle, buckets=4, folders=2).awaitTermination()

    def add(*rows):
        spark.createDataFrame(list(rows), "doc_id long, text string").write.mode("append").parquet(source)

    add((1, "a"), (1, "a"), (2, "b"))
    run("one")
    add((2, "b"), (3, "c"), (1, "changed"))
    run("one")
    assert sorted(calls) == [1, 1, 2, 3]
    run("lost")
    assert sorted(calls) == [1, 1, 2, 3] and sorted(r.doc_id for r in log.read("handled").collect()) == [1, 1, 2, 3]
    for k in range(4):
        add((10 + k, "x"))
        run("one")
    assert log.read("handled").count() == 8 and max(map(len, log.tables()[1]["handled"].parts.values())) <= 2


def test_log_sink(spark, tmp_path):
    log = Snapshots(spark, str(tmp_path / "lake"))
    events = spark.createDataFrame([(1, "parse", "secret text")], "task_id long, kind string, body string")
    for _ in range(3):
        append_log(log, "log", events, LOG_COLUMNS, "task_id")
    assert log.read("log").columns == ["task_id", "kind"] and log.read("log").count() == 3


def test_task_registry(spark):
    tasks = Registry()

    @tasks.handles("parse")
    def parse(rows):
        return rows.select("task_id", F.lit("parsed").alias("result"))

    @tasks.handles("count", needs=("text",))
    def count(rows):
        return rows.select("task_id", F.char_length("text").cast("string").alias("result"))

    rows = spark.createDataFrame([(1, "parse", "x"), (2, "count", "four"), (3, "count", None), (4, "other", "x"), (5, None, "x")], "task_id long, kind string, text string")
    got = {r.task_id: (r.status, r.result, r.fail_reason) for r in tasks.run(rows).collect()}
    assert got == {1: ("SUCCEEDED", "parsed", None), 2: ("SUCCEEDED", "4", None), 3: ("FAILED", None, "no text"), 4: ("FAILED", None, "no handler for other"), 5: ("FAILED", None, "no handler for null")}
    assert tasks.run(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tasks.handles("parse")(parse)


def test_embedding_port(spark):
    """The model is loaded in the tasks; rows it can't embed keep a reason; the stand-in puts like texts close."""
    rows = [(1, "the red house"), (2, "the red houses stand"), (3, "x y z"), (4, None), (5, ""), (6, "THE RED house")]
    df = spark.createDataFrame(rows, "chunk_id long, text string").repartition(3)
    got = {r.chunk_id: r for r in embed(df, HashedWords, 32).collect()}
    assert {k for k, r in got.items() if r.vector is None} == {4, 5} and got[4].reason == "empty" and len(got) == 6
    cos = lambda a, b: sum(x * y for x, y in zip(got[a].vector, got[b].vector))
    assert cos(1, 6) == pytest.approx(1, abs=1e-6) and cos(1, 2) > cos(1, 3) + 0.2 and all(len(got[k].vector) == 32 for k in (1, 2, 3))

    class Wrong(HashedWords):
        def embed(self, texts):
            return super().embed(texts)[:, :5]

    with pytest.raises(Exception, match="32"):
        embed(df, Wrong, 32).collect()
    assert embed(df.limit(0), HashedWords, 32).count() == 0


def test_normal_form(spark):
    df = spark.createDataFrame([("e\u0301 \u212b\r\nx  y ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(normalise(normal_form(F.col("t")))).collect()] == ["\u00e9 \u00c5\nx y", None, ""]
