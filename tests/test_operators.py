"""Operators on literal frames, with the boundary values that the specification fixes."""

import random
import re
import time
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions.scalar import cosine, normalise, retryable, snippet, task_key
from folioscope.operators import activity as A
from folioscope.operators import documents as D
from folioscope.operators import retrieval as R


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("bounds, n, ok", [
    (D.NAME_CHARS, 0, False), (D.NAME_CHARS, 1, True), (D.NAME_CHARS, 40, True), (D.NAME_CHARS, 41, False),
    (D.DESCRIPTION_CHARS, 0, True), (D.DESCRIPTION_CHARS, 200, True), (D.DESCRIPTION_CHARS, 201, False),
    (D.TITLE_CHARS, 60, True), (D.TITLE_CHARS, 61, False),
])
def test_length_bounds(spark, bounds, n, ok):
    df = spark.createDataFrame([("名" * n,)], "t string")
    assert df.select(D.length_ok(F.col("t"), bounds)).first()[0] is ok


def test_uploads(spark):
    top = D.MAX_FILE_BYTES
    rows = [(1, "pdf", top, False, False), (2, "PDF", top + 1, False, False), (3, "exe", 5, False, False), (4, "txt", 0, False, False),
            (5, "md", 1, True, False), (6, "docx", 1, None, True), (7, None, 1, False, False)]
    rows += [(8, "txt", 1, False, False)] * 6 + [(9, "txt", 1, False, False)] * 5
    df = spark.createDataFrame(rows, "batch_id int, file_type string, size_bytes long, encrypted boolean, damaged boolean")
    got = {r.batch_id: r.reason for r in D.validate_uploads(df).collect()}
    assert got == {1: None, 2: "size", 3: "type", 4: "empty", 5: "encrypted", 6: "damaged", 7: "type", 8: "too_many", 9: None}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(alphabet="ab 文\n", max_size=60), size=st.integers(1, 12), overlap=st.integers(0, 11))
def test_chunks_cover_the_text(spark, text, size, overlap):
    if overlap >= size:
        return
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = sorted(D.chunks(df, size, overlap).collect(), key=lambda r: r.pos)
    whole = ""
    for r in got:
        assert r.text == text[r.start : r.start + size] and (r.pos == 0 or len(r.text) > overlap or len(text) <= size)
        whole = whole[: r.start] + r.text
    assert whole == text


def test_chunks_refuse_a_bad_overlap(spark):
    with pytest.raises(ValueError):
        D.chunks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 5, 5)


def test_scope_never_leaks(spark):
    docs = spark.createDataFrame([(1, 1, "a", "ready"), (2, 2, "a", "ready"), (3, 1, "b", "ready"), (4, 1, "a", "failed")], "doc_id long, user_id int, kb_id string, status string")
    chunks = spark.createDataFrame([(k, d) for k, d in enumerate([1, 2, 3, 4, 5])], "chunk_id long, doc_id long")
    assert [r.doc_id for r in D.scoped_chunks(chunks, docs, 1, "a").collect()] == [1]
    assert D.scoped(docs, "a", []).count() == 0 and D.scoped(docs, "a", [1]).count() == 1


def test_delete_leaves_no_orphan(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    parts = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "chunk_id long, doc_id long")
    left = D.cascade_delete(docs, {"chunks": parts}, spark.createDataFrame([(2,), (None,)], "doc_id long"))
    assert sorted(r[0] for r in left["documents"].collect()) == [1, 3]
    assert left["chunks"].join(left["documents"], "doc_id", "left_anti").count() == 0


def test_citations(spark):
    answers = spark.createDataFrame([(1, 1, "a [2] b [9] c [2]"), (1, 2, "none"), (1, 3, None)], "conv_id long, turn long, text string")
    odd = spark.createDataFrame([(1, 1, "[0] [007] [1234567] [" + "9" * 40 + "] [x] [-1]")], "conv_id long, turn long, text string")
    assert [r.marker for r in R.citation_markers(odd).orderBy("n").collect()] == [0, 7, 1234567, -1]
    evidence = spark.createDataFrame([(1, 1, 2, 77)], "conv_id long, turn long, marker int, chunk_id long")
    bound, forged = R.bind_citations(R.citation_markers(answers), evidence)
    assert sorted((r.n, r.chunk_id) for r in bound.collect()) == [(1, 77), (3, 77)]
    assert [r.marker for r in forged.collect()] == [9]
    marked = D.mark_citations(spark.createDataFrame([(1, 5), (2, 6)], "marker int, doc_id long"), spark.createDataFrame([(5,)], "doc_id long"))
    assert {r.marker: r.source_deleted for r in marked.collect()} == {1: False, 2: True}


def test_refusal_keeps_a_query_without_hits(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    hits = spark.createDataFrame([(1, 0.5), (2, 0.4999)], "query_id int, score double")
    assert {r.query_id: r.refused for r in R.refusals(queries, hits, 0.5).collect()} == {1: False, 2: True, 3: True}


def test_monthly_cost_goldens(spark):
    """The specification's published cells, in decimals."""
    prices = {"A": ("0.07", "0.15", "0.47"), "B": ("0", "0.30", "1.20"), "D": ("0.02", "0.20", "1.20")}
    volumes = {(100_000, 300_000, 60_000): ("0.0802", "0.162", "0.134"), (2_000_000, 3_000_000, 600_000): ("0.872", "1.62", "1.36"),
               (10_000_000, 10_000_000, 2_000_000): None, (10_000_000, 30_000_000, 6_000_000): ("8.02", "16.20", "13.40")}
    for tokens, costs in volumes.items():
        usage = spark.createDataFrame([("2024-01-05 00:00:00", k, n) for k, n in zip(("embed", "in", "out"), tokens)], "ts string, kind string, tokens long")
        for option, cost in zip("ABD", costs or ()):
            table = spark.createDataFrame(list(zip(("embed", "in", "out"), prices[option])), "kind string, usd_per_million string")
            assert A.monthly_cost(usage.withColumn("ts", F.to_timestamp("ts")), table).first().cost == Decimal(cost)


def test_budget_boundaries(spark):
    df = spark.createDataFrame([(Decimal(x),) for x in ("3.999999", "4", "4.999999", "5")], "c decimal(20,6)")
    assert [r[0] for r in df.select(A.budget_state(F.col("c"))).collect()] == ["OK", "ALERT", "ALERT", "STOP"]


def test_practice(spark):
    rows = spark.createDataFrame([(1, 1, True, True), (1, 2, True, False), (1, 3, False, False)], "session_id int, seq int, answered boolean, reviewed boolean")
    assert [r.allowed for r in A.practice_gate(rows).orderBy("seq").collect()] == [True, True, False]
    results = spark.createDataFrame([(1, "correct"), (1, None), (1, "wrong")], "session_id int, result string")
    assert one(A.practice_summary(results)) == [(1, 3, 1, 0, 1, 1)]


def test_tasks(spark):
    tasks = spark.createDataFrame([(1, 1, "RUNNING", True, ""), (2, 2, "RUNNING", True, ""), (3, 1, "FAILED", True, " "), (4, 1, "PENDING", False, "")],
                                  "task_id int, resource_id int, status string, repeatable boolean, fail_reason string")
    assert [r.task_id for r in A.restartable(tasks, spark.createDataFrame([(1,)], "resource_id int")).collect()] == [1]
    assert [r.task_id for r in A.unexplained_failures(tasks).collect()] == [3]
    keyed = spark.createDataFrame([("a",), ("a",), ("b",)], "idem_key string")
    assert [r[0] for r in A.new_tasks(keyed, spark.createDataFrame([("b",)], "idem_key string")).collect()] == ["a"]
    keys = spark.createDataFrame([("a", None), (None, "a")], "x string, y string").select(task_key(F.col("x"), F.col("y"))).distinct()
    assert keys.count() == 2


def test_stage_completeness(spark):
    rows = [(1, s, "SUCCEEDED", 1) for s in ("chunk", "embed", "index")] + [(2, "chunk", "SUCCEEDED", 1), (2, "embed", "PARTIAL", 1)]
    rows += [(3, s, "SUCCEEDED", 1) for s in ("chunk", "embed", "index")] + [(3, "index", "FAILED", 2)]
    df = spark.createDataFrame(rows, "doc_id int, stage string, status string, attempt int")
    assert {r.doc_id: r.usable for r in D.stage_completeness(df).collect()} == {1: True, 2: False, 3: False}


def test_illegal_transitions(spark):
    rows = [(1, 1, "to_upload"), (1, 2, "uploading"), (1, 3, "ready"), (2, 1, "failed"), (2, 2, "parsing")]
    df = spark.createDataFrame(rows, "doc_id int, n int, status string")
    assert one(A.illegal_transitions(spark, df, "document", "doc_id", ["n"])) == [(1, "uploading", "ready")]


def test_index_and_restore(spark):
    chunks = spark.createDataFrame([(1, "f"), (2, "g")], "chunk_id int, fingerprint string")
    vectors = spark.createDataFrame([(1, "m", "1"), (2, "m", "0")], "chunk_id int, model string, index_version string")
    assert [r.chunk_id for r in D.stale_chunks(chunks, vectors, "m", "1").collect()] == [2]
    assert [r[0] for r in D.to_embed(chunks, spark.createDataFrame([("f", "1")], "fingerprint string, model_version string"), "1").collect()] == ["g"]
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, d string, at int")
    new = spark.createDataFrame([(2, "c", 5), (3, "d", 1)], "k int, d string, at int")
    assert {r.k: r.state for r in D.restore_conflicts(old, new, "k", "d").collect()} == {1: "only_existing", 2: "conflict", 3: "new"}
    assert {r.k: r.d for r in D.merge_restore(old, new, "k", "at").collect()} == {1: "a", 2: "b", 3: "d"}


def test_answers_and_log(spark):
    deltas = spark.createDataFrame([(1, 1, 2, "lo", None), (1, 1, 1, "Hel", None), (1, 1, 3, None, "STOPPED"), (1, 2, 1, "x", None)], "conv_id int, turn int, seq int, delta string, status string")
    assert sorted(one(A.fold_answer(deltas))) == [(1, 1, "Hello", "STOPPED"), (1, 2, "x", "GENERATING")]
    log = spark.createDataFrame([(1, "x", "secret")], "task_id int, kind string, body string")
    assert set(A.redacted(log).columns) <= set(A.LOG_COLUMNS)


def test_fusion_rerank_evidence(spark):
    a, b = (spark.createDataFrame(x, "id int, rank int") for x in ([(1, 1), (2, 2)], [(2, 1)]))
    got = {r.id: r.score for r in R.fuse([a, b], "id").collect()}
    assert got[2] == pytest.approx(1 / 62 + 1 / 61) and got[1] == pytest.approx(1 / 61)
    hits = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9)], "q int, id int, s double")
    assert [r.id for r in R.rerank(hits, F.col("s"), "q", "id").orderBy("rank").collect()] == [2, 1]
    items = R.with_evidence(spark.createDataFrame([(1,), (2,)], "q int"), hits.select("q", "id"), ["q"])
    assert {r.q: len(r.evidence) for r in items.collect()} == {1: 2, 2: 0}


def test_scalars(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], "a\r\nb \t c \n", "xxNEEDLEyy")], "a array<double>, z array<double>, t string, s string")
    row = df.select(cosine(F.col("a"), F.col("a")), cosine(F.col("a"), F.col("z")), normalise(F.col("t")), snippet(F.col("s"), F.lit("NEEDLE"), 1), snippet(F.col("s"), F.lit("no"), 1),
                    retryable(F.lit("Timeout")), retryable(F.lit("parameter")), retryable(F.lit(None).cast("string"))).first()
    assert tuple(row) == (1.0, None, "a\nb c", "xNEEDLEy", None, True, False, False)


def test_empty_inputs(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, kb_id string, status string, user_id int")
    assert D.paragraphs(docs).count() == D.chunks(docs, 5, 0).count() == D.ready(docs).count() == D.keyword_search(docs, "text", " ").count() == 0


def test_running_spend_in_buckets(spark):
    """Sums by buckets of time are those row by row, ties and nulls included."""
    rng = random.Random(9)
    rows = [(k, f"2024-0{rng.randint(1, 2)}-01 00:0{rng.randint(0, 3)}:00" if k % 17 else None, rng.randint(0, 400) / 100) for k in range(300)]
    usage = spark.createDataFrame(rows, "id int, t string, c double").select("id", F.to_timestamp("t").alias("ts"), F.col("c").cast("decimal(20,6)").alias("cost"))
    got = {r.id: r for r in A.running_spend(usage, F.date_format("ts", "yyyy-MM"), "cost", ["ts", "id"]).collect()}
    assert len(got) == 300
    for k, t, _ in rows:
        before = sum(Decimal(str(c)) for j, u, c in rows if (u or "")[:7] == (t or "")[:7] and ((u or ""), j) < ((t or ""), k))
        assert got[k].spent_before == before and got[k].allowed == (before < 5)


def test_context_budget_in_steps(spark):
    rows = [(g, k, (k * 7) % 23) for g in ("a", None) for k in range(60)] + [("b", 1, 500)]
    hits = spark.createDataFrame(rows, "g string, id int, n int")
    order = [F.col("n"), F.col("id")]
    plain = R.context_budget(hits, 100, "g", "n", order).collect()
    steps = R.context_budget(hits, 100, "g", "n", order, F.col("n")).collect()
    assert sorted(map(str, steps)) == sorted(map(str, plain)) and len(plain) > 20


def test_sources_that_differ(spark):
    rows = [(1, "a", "yes"), (1, "b", "no"), (1, "c", "no"), (2, "a", "yes"), (2, "b", "yes"), (3, "a", None), (3, "b", "no")]
    got = R.differing_sources(spark.createDataFrame(rows, "q int, source string, said string"), ["q"], "source", "said")
    assert sorted((r.q, r.said, r.sources) for r in got.collect()) == [(1, "no", ["b", "c"]), (1, "yes", ["a"])]


def test_empty_knowledge_bases_are_listed(spark):
    docs = spark.createDataFrame([(1, "a", "ready"), (2, "a", "failed")], "doc_id long, kb_id string, status string")
    kbs = spark.createDataFrame([("a",), ("b",)], "kb_id string")
    assert [tuple(r) for r in D.overview(kbs, docs).collect()] == [("a", 2, 1, 0, 1, 2), ("b", 0, 0, 0, 0, None)]


def plain_section_chunks(text, size):
    """Lines one by one: a path of headings, and greedy packing by the span that a chunk would cover."""
    out, path, now, at = [], [], None, 0
    for number, line in enumerate(text.split("\n")):
        m = re.match(r" {0,3}(#{1,6})[ \t]+(.*?)[ \t]*$", line)
        if m:
            path = [(n, t) for n, t in path if n < len(m[1])] + [(len(m[1]), m[2])]
            now = None
        elif line.strip(" \t\r\f\v"):
            for k in range(0, len(line), size):
                a, b = at + k, at + min(k + size, len(line))
                if now is None or b - now[2] > size:
                    now = [" / ".join(t for _, t in path), number, a, b]
                    out.append(now)
                now[3] = b
        at += len(line) + 1
    return [(k, s, n, a, text[a:b]) for k, (s, n, a, b) in enumerate(out)]


def test_section_chunks(spark):
    rng = random.Random(9)
    line = lambda: rng.choice(["", " \t", "# One", "## Two two  ", "###### Six", "####### seven", "#none", "   ### in", "    # code", "x" * rng.randint(1, 70), "文 字" * rng.randint(1, 9), "a # b"])
    texts = ["\n".join(line() for _ in range(rng.randint(0, 25))) for _ in range(150)] + [None, "", "\n\n", "# only", "x" * 1000, "a\r\nb\r\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for size in (1, 17, 60):
        got = sorted((r.doc_id, r.pos, r.section, r.paragraph, r.start, r.text) for r in D.section_chunks(df, size).collect())
        assert got == sorted((i, *c) for i, t in enumerate(texts) for c in plain_section_chunks(t or "", size))
        assert all(len(r[5]) <= size and texts[r[0]][r[4] :].startswith(r[5]) for r in got)
    with pytest.raises(ValueError):
        D.section_chunks(df, 0)


def test_chunks_take_time_by_length(spark):
    """Of a text of four million characters; before, its square: a fourth of it had not ended after a hundred seconds."""
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr("repeat('abcd efgh\n', 400000)").alias("text"))
    began = time.time()
    assert D.chunks(df, 1000, 100).agg(F.sum(F.char_length("text"))).first()[0] == 4_000_000 + 100 * (D.chunks(df, 1000, 100).count() - 1)
    assert D.section_chunks(df, 1000).count() == 4000 and time.time() - began < 60


def test_previous_rows_over_buckets(spark):
    """Rows follow each other across buckets, empty ones between them, and for a key that is null."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), k, f"s{rng.randint(0, 5)}" if rng.random() < 0.9 else None) for k in rng.sample(range(9000), 400)]
    df = spark.createDataFrame(rows, "k string, seq long, status string").repartition(4)
    got = {r.seq: r.previous_status for r in A.with_previous(df, ["k"], ["seq"], ["status"], F.floor(F.col("seq") / 100)).collect()}
    want, last = {}, {}
    for k, seq, status in sorted(rows, key=lambda r: r[1]):
        want[seq] = last.get(k)
        last[k] = status
    assert got == want


def test_calls_and_contexts(spark):
    rows = [(1, 0, "assistant"), (1, 1, "user"), (1, 2, "assistant"), (2, 0, "user"), (2, 1, "assistant"), (3, 5, "assistant"), (None, 1, "user"), (None, 2, "assistant"), (None, 0, "assistant")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string")
    assert sorted(map(tuple, A.calls_without_input(df).select("conv_id", "turn").collect()), key=str) == [(1, 0), (3, 5), (None, 0)]
    assert [tuple(r) for r in A.mixed_contexts(df, "conv_id", "role").where("conv_id = 1").collect()] == [(1, 2)]


def test_egress(spark):
    asked = spark.createDataFrame([(1, "why"), (2, "x" * 30), (3, "none")], "query_id int, question string").withColumn("secret", F.lit("key"))
    hits = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (1, 3, "third one too long"), (2, 1, "a")], "query_id int, rank int, text string").withColumn("path", F.lit("/home"))
    got = R.egress(asked, hits, 20, [F.col("rank")])
    assert got.columns == ["query_id", "question", "snippets"]
    assert {r.query_id: r.snippets for r in got.collect()} == {1: ["first", "second"], 2: [], 3: []}
