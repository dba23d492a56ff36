"""Documents and chunks: validation, scope, duplicates, chunking, deletion, index upkeep."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits that the specification fixes.
FILE_TYPES = ("pdf", "docx", "md", "txt")
MAX_FILE_BYTES = 20 * 1024 * 1024
MAX_FILES = 5
NAME_CHARS, DESCRIPTION_CHARS, TITLE_CHARS = (1, 40), (0, 200), (1, 60)
MAX_KBS_PER_USER, MAX_FILES_PER_KB = 10, 50
READY = "ready"


def length_ok(text: Column, bounds: tuple[int, int]) -> Column:
    """A null counts as empty."""
    return F.char_length(F.coalesce(text, F.lit(""))).between(*bounds)


def validate_uploads(files: DataFrame) -> DataFrame:
    """``files`` (batch_id, name, file_type, size_bytes, encrypted, damaged) with reason and ok; the first reason counts."""
    count = F.count("*").over(Window.partitionBy("batch_id"))
    reason = (
        F.when(~F.coalesce(F.lower("file_type").isin(*FILE_TYPES), F.lit(False)), "type")
        .when(F.coalesce(F.col("size_bytes"), F.lit(0)) <= 0, "empty")
        .when(F.col("size_bytes") > MAX_FILE_BYTES, "size")
        .when(F.coalesce("encrypted", F.lit(False)), "encrypted")
        .when(F.coalesce("damaged", F.lit(False)), "damaged")
        .when(F.col("batch_files") > MAX_FILES, "too_many")
    )
    return files.withColumn("batch_files", count).withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def owned(df: DataFrame, user_id: int) -> DataFrame:
    """Only the user's own rows; others' look as if they did not exist."""
    return df.where(F.col("user_id") == user_id)


def scoped(df: DataFrame, kb_id, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of one knowledge base and, if named, of some of its documents."""
    inside = df.where(F.col("kb_id") == kb_id)
    return inside if doc_ids is None else inside.where(F.col("doc_id").isin(*doc_ids)) if doc_ids else inside.where(F.lit(False))


def ready(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == READY)


def scoped_chunks(chunks: DataFrame, documents: DataFrame, user_id: int, kb_id) -> DataFrame:
    """Chunks of the user's ready documents in one knowledge base. Spark picks the join by the sides' sizes."""
    allowed = ready(scoped(owned(documents, user_id), kb_id)).select("doc_id").distinct()
    return chunks.join(allowed, "doc_id", "left_semi")


def keyword_search(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose column holds the query, whatever the letters' case; a blank query finds nothing."""
    if not query.strip():
        return df.where(F.lit(False))
    return df.where(F.lower(column).contains(query.lower()))


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, paragraph, text): lines that hold something, with their place from 0."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))
    return lines.where(F.length(F.trim("text")) > 0)


def chunks(documents: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, pos, start, text): pieces of ``size`` characters, each ``overlap`` into the one before.

    A text is cut once into steps and a chunk put together from neighbouring ones, in time that follows its length.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    steps = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    count = F.floor(F.greatest(F.char_length("text") - overlap - 1, F.lit(0)) / step).cast("int") + 1
    joined = lambda all_, pos: F.substring(F.array_join(F.slice(all_, pos + 1, -(-size // step)), ""), 1, size)
    # a one-element array binds the steps, so that they are cut once
    pieces = F.flatten(F.transform(F.array(F.struct(steps.alias("all"), count.alias("n"))), lambda x: F.transform(F.slice(x["all"], F.lit(1), x["n"]), lambda _, pos: joined(x["all"], pos))))
    return documents.where(F.char_length("text") > 0).select("doc_id", F.posexplode(pieces).alias("pos", "text")).select("doc_id", "pos", (F.col("pos") * step).alias("start"), "text")


#: Headings of Markdown, and what stands between the parts of a section's path.
HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)[ \t]*\Z")
BETWEEN = " / "
#: What a line without text consists of.
BLANK = " \t\r\f\v"


def _packed(text: str, size: int) -> Iterator[tuple[str, int, int, int]]:
    """(section, first paragraph, start, end) of a text's chunks, in one pass."""
    stack: list[tuple[int, str]] = []
    section, first, start, end, at, number = "", 0, -1, -1, 0, -1
    while at <= len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        low, high, number = at, stop, number + 1
        at = stop + 1
        line = text[low:high]
        if not line.strip(BLANK):
            continue
        heading = HEADING.match(line) if line.lstrip(" ").startswith("#") else None
        if heading:
            if start >= 0:
                yield section, first, start, end
            start = -1
            while stack and stack[-1][0] >= len(heading[1]):
                stack.pop()
            stack.append((len(heading[1]), heading[2]))
            section = BETWEEN.join(title for _, title in stack)
            continue
        for a in range(low, high, size):
            b = min(a + size, high)
            if start >= 0 and b - start <= size:
                end = b
                continue
            if start >= 0:
                yield section, first, start, end
            first, start, end = number, a, b
    if start >= 0:
        yield section, first, start, end


def section_chunks(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, pos, section, paragraph, start, text): whole lines packed into chunks of at most ``size`` characters.

    A chunk stays within one section, whose path of headings it carries ("Guide / Setup"); heading lines (``#`` to
    ``######``) are in the path and not in a chunk. Lines longer than ``size`` are cut every ``size`` characters. A chunk is
    the text's own stretch from ``start`` on, blank lines inside it included, and ``paragraph`` the number of its first line.
    Null and blank texts have no chunk. One pass over a text, in batches; a task holds one text's chunks beside it.
    """
    if size < 1:
        raise ValueError("size must be at least 1")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                text = batch.column(1)[k].as_py()
                found = list(_packed(text, size)) if text else []
                if found:
                    sections, firsts, starts, ends = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([k] * len(found))), pa.array(range(len(found)), pa.int32()), pa.array(sections, pa.string()),
                            pa.array(firsts, pa.int32()), pa.array(starts, pa.int32()), pa.array([text[a:b] for a, b in zip(starts, ends)], pa.string()),
                        ],
                        ["doc_id", "pos", "section", "paragraph", "start", "text"],
                    )

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(of, f"doc_id {kind}, pos int, section string, paragraph int, start int, text string")


def mark_duplicates(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Documents that share all keys with an earlier one: (doc_id, first_id). The first of each group is not listed."""
    firsts = documents.groupBy(*keys).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return documents.join(firsts, keys).where("doc_id <> first_id").select("doc_id", "first_id")


def cascade_delete(documents: DataFrame, dependents: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of the deleted documents (``gone`` has doc_id)."""
    ids = gone.select("doc_id").where("doc_id is not null").distinct()
    return {name: df.join(ids, "doc_id", "left_anti") for name, df in {"documents": documents, **dependents}.items()}


def mark_citations(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """Citations with source_deleted; none is dropped when its document is."""
    live = documents.select(F.col("doc_id").alias("live_id")).distinct()
    joined = citations.join(live, citations["doc_id"] == live["live_id"], "left")
    return joined.withColumn("source_deleted", F.col("live_id").isNull()).drop("live_id")


def stale_chunks(chunks_: DataFrame, vectors: DataFrame, model: str, version: str) -> DataFrame:
    """Chunks without a vector of this model and index version."""
    fresh = vectors.where((F.col("model") == model) & (F.col("index_version") == version)).select("chunk_id").distinct()
    return chunks_.join(fresh, "chunk_id", "left_anti")


def to_embed(chunks_: DataFrame, known: DataFrame, model_version: str) -> DataFrame:
    """Distinct fingerprints of chunks that no vector of this model version covers yet."""
    done = known.where(F.col("model_version") == model_version).select("fingerprint").distinct()
    return chunks_.select("fingerprint").distinct().join(done, "fingerprint", "left_anti")


def stage_completeness(stages: DataFrame, needed: tuple[str, ...] = ("chunk", "embed", "index")) -> DataFrame:
    """Per document: usable only if every needed stage's newest attempt succeeded."""
    newest = stages.where(F.col("stage").isin(*needed)).groupBy("doc_id", "stage").agg(F.max_by("status", "attempt").alias("status"))
    done = newest.groupBy("doc_id").agg(F.count_if(F.col("status") == "SUCCEEDED").alias("n"))
    return stages.select("doc_id").distinct().join(done, "doc_id", "left").select("doc_id", (F.coalesce("n", F.lit(0)) == len(needed)).alias("usable"))


def restore_conflicts(existing: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): new, only_existing, same or conflict."""
    a = existing.select(F.col(key), F.col(digest).alias("old"), F.lit(True).alias("here"))
    b = incoming.select(F.col(key), F.col(digest).alias("now"), F.lit(True).alias("there"))
    state = F.when(F.col("here").isNull(), "new").when(F.col("there").isNull(), "only_existing").when(F.col("old").eqNullSafe(F.col("now")), "same").otherwise("conflict")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def merge_restore(existing: DataFrame, incoming: DataFrame, key: str, updated: str) -> DataFrame:
    """Both tables' rows, of a key the newest; existing rows win a tie."""
    both = existing.withColumn("_side", F.lit(1)).unionByName(incoming.withColumn("_side", F.lit(0)))
    # structs with a null are smaller than without, so rows without a time lose to those with one
    top = F.max_by(F.struct(*[F.col(f"`{c}`") for c in existing.columns]), F.struct(updated, "_side"))
    return both.groupBy(F.col(key).alias("_key")).agg(top.alias("_row")).select("_row.*")


def capacity(documents: DataFrame) -> DataFrame:
    """Per knowledge base: files and whether they are over the target."""
    return documents.groupBy("kb_id").agg(F.count("*").alias("n_files")).withColumn("over", F.col("n_files") > MAX_FILES_PER_KB)


def user_capacity(kbs: DataFrame) -> DataFrame:
    """Per user: knowledge bases and whether they are over the target; ``kbs`` has user_id and kb_id."""
    return kbs.groupBy("user_id").agg(F.count_distinct("kb_id").alias("n_kbs")).withColumn("over", F.col("n_kbs") > MAX_KBS_PER_USER)


def with_tag(df: DataFrame, tag: str, column: str = "tags") -> DataFrame:
    """Rows that carry the tag, whatever the letters' case; rows without tags have none."""
    return df.where(F.coalesce(F.exists(column, lambda x: F.lower(x) == tag.strip().lower()), F.lit(False)))


def overview(kbs: DataFrame, documents: DataFrame) -> DataFrame:
    """Every knowledge base, those without a file too, with its files by state, the latest first; ``kbs`` are distinct."""
    of = lambda s: F.count_if(F.col("status") == s)
    counts = documents.groupBy("kb_id").agg(
        F.count("*").alias("n_files"), of(READY).alias("n_ready"), of("parsing").alias("n_processing"), of("failed").alias("n_failed"),
        F.max("doc_id").alias("last_doc"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_files", "n_ready", "n_processing", "n_failed")}
    return kbs.select("kb_id").join(counts, "kb_id", "left").withColumns(zero).orderBy(F.col("last_doc").desc_nulls_last(), "kb_id")
