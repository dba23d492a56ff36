"""Packing of token sequences into windows by non-negative least squares.

Documents become ids and an end id. Whole windows of a document are sequences of their own;
what is left of each (its tail, shorter than a window) is packed. Shallow combinations of tail
lengths that fill a window exactly are enumerated, and non-negative least squares finds how often
to use each so that they use up the histogram of lengths. The counts are rounded to what is
there, and what is left is solved again while that helps. The residual tails (a few hundredths at
most on the given tables) are laid end to end, greedily, by length and cut at window edges,
so only the very last window has padding.

The histogram has at most one row a length, and each solution at most two combinations a length,
however many documents there are: the plan is made on the driver and broadcast. Tails find their
place by their rank among tails of their length: a count within each of a number of buckets
that follows the rows, plus the counts of the buckets before, so that a length that very
many copies share is ranked in many tasks.

Cases: null or empty text is its end id alone; texts longer than a window fill several;
repeated rows and null ids are packed as rows of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.util import Stash

WINDOW = 2048
END_ID = 1
#: Rows that are ranked together at most, about, of a length that all share.
ROWS_A_SALT = 200_000
#: Combinations tried for each length and number of parts, their most parts, and how often the rest is solved again.
CHOICES, MOST_PARTS, SOLUTIONS = 8, 8, 12
#: A remainder under this isn't rounded up.
LEAST_SHARE = 0.02
#: Bytes of text whose distinct words are encoded together in a task.
SLICE_BYTES = 3 << 20

#: Latin letters that lower-casing leaves single, and ASCII signs but the apostrophe: what simple words consist of.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SIMPLE = f"^[{LETTERS}]*[{re.escape(SIGNS)}]*$"
#: Words on which the shorter way must agree with the tokenizer, or it isn't taken.
PROBES = ["Word", "Été", "ǅ", "one,", "...", "x*%", "a_", "|", "Straße.)"]


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``pool`` that ``index`` names, one behind the other, and each one's size."""
    n = sizes[index]
    ends = np.cumsum(n)
    at = np.repeat(starts[index] - (ends - n), n)
    return pool[at + np.arange(len(at))], n


class WordIds:
    """Ids by a tokenizer that drops white space.

    Texts are split at ASCII spaces and each distinct word is encoded once. Simple words (letters, then
    signs) are cut into these two units, whose distinct ones go to the tokenizer's model many at a
    time, without its normaliser and pattern; other words take the tokenizer as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.units = None
        if suffix:
            spec = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "added_tokens": []}
            level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}
            #: Which ids end a unit.
            self.ends = np.zeros(1 << 16, bool)
            self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True
            self.units = Tokenizer.from_str(json.dumps(spec))
            whole = [self._encode(self.tokenizer, [w])[0].tolist() for w in PROBES]
            pool, starts, sizes = self._words(pa.array(PROBES))
            if [pool[a : a + n].tolist() for a, n in zip(starts, sizes)] != whole:
                self.units = None

    @staticmethod
    def _encode(tokenizer, texts: list[str]) -> list[np.ndarray]:
        many = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        return [np.array(e.ids, "<u2") for e in many(texts, add_special_tokens=False)]

    def _units(self, units: list[str], at_once: int = 100) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of units of letters or signs, and how many each has."""
        found = self._encode(self.units, [" ".join(units[k : k + at_once]) for k in range(0, len(units), at_once)])
        last = np.flatnonzero(self.ends[np.concatenate(found)]) if found else np.zeros(0, np.int64)
        if len(last) != len(units):
            raise ValueError("a unit's ids have no end or more than one")
        return found, np.diff(last, prepend=-1)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: all of them, and each word's start and size there."""
        simple = pc.match_substring_regex(words, SIMPLE) if self.units else pa.array(np.zeros(len(words), bool))
        plain, rest = words.filter(simple), words.filter(pc.invert(simple)).to_pylist()
        letters, signs = pc.utf8_lower(pc.utf8_rtrim(plain, SIGNS)), pc.replace_substring_regex(plain, f"^[{LETTERS}]+", "")
        both = pa.concat_arrays([letters, signs]).dictionary_encode()
        units = both.dictionary.to_pylist()
        some = np.array([bool(u) for u in units], bool)
        parts, counts = self._units([u for u in units if u]) if self.units else ([], np.zeros(0, np.int64))
        others = self._encode(self.tokenizer, rest)
        sizes = np.zeros(len(units) + len(rest) + 1, np.int64)  # the last one is nothing
        sizes[: len(units)][some] = counts
        sizes[len(units) : -1] = [len(x) for x in others]
        pool = np.concatenate([*parts, *others, np.zeros(0, "<u2")])
        use = np.full((len(words), 2), len(sizes) - 1)
        mask = simple.to_numpy(zero_copy_only=False)
        use[mask] = both.indices.to_numpy().reshape(2, -1).T
        use[~mask, 0] = len(units) + np.arange(len(rest))
        ids, n = _gather(pool, np.cumsum(sizes) - sizes, sizes, use.ravel())
        n = n.reshape(-1, 2).sum(axis=1)
        return ids, np.cumsum(n) - n, n

    def batch(self, texts: pa.Array, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with ``end`` behind each, and where each text ends."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        counts = pc.list_value_length(split).to_numpy()
        words = split.flatten().dictionary_encode()
        pool, starts, sizes = self._words(words.dictionary)
        starts, sizes, pool = np.append(starts, len(pool)), np.append(sizes, 1), np.append(pool, np.uint16(end))
        stops = np.cumsum(counts) + np.arange(len(counts))  # where the end ids stand among the words
        index = np.full(len(words) + len(counts), len(starts) - 1)
        inside = np.ones(len(index), bool)
        inside[stops] = False
        index[inside] = words.indices.to_numpy()
        ids, n = _gather(pool, starts, sizes, index)
        return ids, np.cumsum(n)[stops]


@lru_cache(maxsize=2)
def load(path: str) -> WordIds:
    return WordIds(path)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many bytes of that column, or of one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    total, start = np.cumsum(size), 0
    while start < len(size):
        before = total[start] - size[start]
        stop = max(start + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").data)


def _tokenized(docs: DataFrame, tokenizer: str, window: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: uid, doc_id, n (its ids), crcs of its whole windows, the tail's length, crc and ids."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, uid = load(tokenizer), TaskContext.get().partitionId() << 33
        for part in (p for batch in batches for p in slices(batch, 1)):
            ids, ends = words.batch(part.column(1))
            wide = memoryview(ids.astype("<u4"))
            n = np.diff(ends, prepend=0)
            length = n % window
            first = ends - length
            crcs = [[zlib.crc32(wide[a : a + window]) for a in range(e - m, f, window)] for e, m, f in zip(ends.tolist(), n.tolist(), first.tolist())]
            spans = list(zip(first.tolist(), ends.tolist()))
            uids = np.arange(uid, uid + len(n))
            uid += len(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uids), part.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(length, pa.int32()),
                    pa.array([zlib.crc32(wide[a:b]) for a, b in spans], pa.int64()), pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()),
                ],
                ["uid", "doc_id", "n", "crcs", "length", "crc", "tail"],
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(of, "uid long, doc_id long, n long, crcs array<long>, length int, crc long, tail binary")


def combinations(histogram: np.ndarray, window: int, choices: int = CHOICES, seed: int = 0) -> np.ndarray:
    """Combinations of lengths that fill the window exactly, one a row, zeros in front.

    All pairs; and for every length and each number of parts from three on, ``choices`` combinations
    that begin with it: the parts between are drawn as often as the histogram has them, the last is what
    is missing. As many parts are tried as a window holds of the mean length and one more.
    """
    lengths = np.flatnonzero(histogram)
    if not len(lengths):
        return np.zeros((0, 2), np.int64)
    mean = (lengths * histogram[lengths]).sum() / histogram[lengths].sum()
    depth = int(min(MOST_PARTS, max(3, math.ceil(window / mean) + 1)))
    share = np.cumsum(histogram) / histogram.sum()
    rng = np.random.default_rng(seed)
    out = []
    for parts in range(2, depth + 1):
        first = np.repeat(lengths, choices if parts > 2 else 1)
        drawn = [first, *(np.searchsorted(share, rng.random(len(first)), side="right") for _ in range(parts - 2))]
        rest = window - np.sum(drawn, axis=0)
        fits = (rest > 0) & (histogram[np.maximum(rest, 0)] > 0)
        found = np.sort(np.stack([*drawn, rest], axis=1)[fits], axis=1)
        out.append(np.pad(found, ((0, 0), (depth - parts, 0))))
    return np.unique(np.concatenate(out), axis=0)


def solve(histogram: np.ndarray, combos: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Non-negative least squares: how often to use each combination so that the histogram is used up.

    Accelerated projected gradient; a combination is a column with a one for each part.
    """
    if not len(combos):
        return np.zeros(0)
    use = combos > 0
    scale = max(1.0, float(histogram.max()))
    target = histogram / scale

    def apply(x: np.ndarray) -> np.ndarray:
        out = np.bincount(combos.ravel(), weights=np.repeat(x, combos.shape[1]), minlength=len(target))
        out[0] = 0
        return out

    v = np.ones(len(combos))
    for _ in range(12):
        w = (apply(v)[combos] * use).sum(axis=1)
        bound = np.linalg.norm(w) / np.linalg.norm(v)
        v = w / np.linalg.norm(w)
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(rounds):
        slope = ((apply(y) - target)[combos] * use).sum(axis=1)
        new = np.maximum(0, y - slope / (1.05 * bound))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def _rounded(shares: np.ndarray, combos: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(parts, times) of the combinations used: whole shares first, then one more each by the largest remainder.

    ``left`` is lowered by what they use; a combination is used as often as its parts are still there.
    """
    times: dict[int, int] = {}
    whole = np.floor(shares + 1e-6).astype(np.int64)
    fraction = shares - whole
    due = [(k, int(whole[k])) for k in np.argsort(-whole, kind="stable") if whole[k]]
    due += [(k, 1) for k in np.argsort(-fraction, kind="stable") if fraction[k] > LEAST_SHARE]
    for k, wanted in due:
        parts, each = np.unique(combos[k][combos[k] > 0], return_counts=True)
        n = int(min(wanted, (left[parts] // each).min()))
        if n > 0:
            left[parts] -= n * each
            times[k] = times.get(k, 0) + n
    return [(combos[k][combos[k] > 0], n) for k, n in times.items()]


def plan(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple], int]:
    """Places of tails by length and rank, and the number of sequences.

    A row is (length, low, high, sequence, offset, stream): tails with ranks from low up to
    high lie at ``offset`` of sequences from ``sequence`` on, one each; or, where stream is
    not null, end to end from that position of the residual stream on. What one solution leaves
    is solved again with combinations of its own, while that places a fiftieth of it.
    """
    left = np.zeros(window + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    used, rows, sequence = np.zeros(window + 1, np.int64), [], 0
    for again in range(SOLUTIONS):
        before = left.sum()
        combos = combinations(left, window, seed=again)
        shares = solve(left.astype(float), combos)
        if len(combos) > 2 * window:  # the plan stays small, however many combinations there are
            combos = combos[np.argsort(-shares, kind="stable")[: 2 * window]]
            shares = solve(left.astype(float), combos)
        for parts, times in _rounded(shares, combos, left):
            offset = 0
            for p in parts[::-1].tolist():
                rows.append((p, int(used[p]), int(used[p]) + times, sequence, offset, None))
                used[p] += times
                offset += p
            sequence += times
        if before - left.sum() <= before / 50:
            break
    stream = 0
    for p in np.flatnonzero(left)[::-1].tolist():
        rows.append((p, int(used[p]), int(used[p] + left[p]), sequence, 0, stream))
        stream += p * int(left[p])
    return rows, sequence + -(-stream // window)


def _salts(rows: int) -> int:
    """Parts that rows of one key are dealt to, so that a part stays of one size whatever the input."""
    return max(64, -(-rows // ROWS_A_SALT))


def _ranked(tails: DataFrame, salts: int) -> DataFrame:
    """``tails`` with each row's rank among the rows of its length, from 0."""
    salted = tails.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")
    starts = counts.select("length", "salt", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1
    return salted.withColumn("inside", inside).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inside"))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    stash = Stash(spark, "packing")
    rows = stash.put(_tokenized(docs, tokenizer, window, id_col, text_col), "tokens")
    tails = rows.where("length > 0")
    counts = {r[0]: r[1] for r in tails.groupBy("length").count().collect()}
    slots, sequences = plan(counts, window)
    table = spark.createDataFrame(slots, "len int, low long, high long, sequence long, place int, stream long")
    ranked = _ranked(tails.select("uid", "doc_id", "n", "length", "crc"), _salts(sum(counts.values())))
    placed = ranked.join(
        F.broadcast(table), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    ).select(
        "uid", "doc_id", "n", "length", "crc",
        F.when(F.col("stream").isNull(), F.col("sequence") + F.col("rank") - F.col("low")).otherwise(F.col("sequence")).alias("sequence"),
        "place",
        (F.col("stream") + (F.col("rank") - F.col("low")) * F.col("length")).alias("at"),
    )
    placed = stash.put(placed, "placed")

    first = F.col("n") - F.col("length")
    cut = "at is not null and at % {0} + length > {0}".format(window)
    uncut = placed.where(f"not coalesce({cut}, false)").select(
        "doc_id", first.alias("start"), F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        F.expr(f"sequence + coalesce(at div {window}, 0)").alias("sequence_id"),
        F.expr(f"cast(coalesce(at % {window}, place) as long)").alias("offset"),
    )

    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tail, edge = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            both = [(_crc(ids[:e]), _crc(ids[e:])) for t, e in zip(tail, edge) for ids in (np.frombuffer(t, "<u2"),)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([b[k] for b in both], pa.int64()) for k in (0, 1))], ["uid", "left", "right"])

    edge = F.expr(f"cast({window} - at % {window} as long)")
    split = stash.put(placed.where(cut).withColumn("edge", edge), "split")  # few: Spark joins by the size that was written
    sums = split.select("uid", "edge").join(rows.select("uid", "tail"), "uid").select("uid", "tail", "edge")
    halves = split.join(sums.mapInArrow(crcs, "uid long, left long, right long"), "uid").select(
        "doc_id", first.alias("first"), "length", "n", "edge", F.expr(f"sequence + at div {window}").alias("sequence"), F.expr(f"at % {window}").alias("at"),
        F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("left").alias("crc")), F.struct(F.lit(1).alias("k"), F.col("right").alias("crc")))).alias("half"),
    )
    halves = halves.select(
        "doc_id", F.expr("first + half.k * edge").alias("start"), F.expr("if(half.k = 0, edge, length - edge)").alias("length"),
        F.col("half.crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), F.expr("sequence + half.k").alias("sequence_id"),
        F.expr("if(half.k = 0, at, 0L)").alias("offset"),
    )

    wide = rows.where(f"n >= {window}")
    wide = wide.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(_salts(wide.count()))))
    per_salt = wide.groupBy("salt").agg(F.sum(F.size("crcs")).alias("windows"))
    upto, start_of = sequences, []
    for salt, windows in sorted(per_salt.collect()):
        start_of.append((salt, upto))
        upto += windows
    starts = spark.createDataFrame(start_of, "salt long, base long")
    own = F.sum(F.size("crcs")).over(Window.partitionBy("salt").orderBy("uid")) - F.size("crcs")
    numbered = wide.select("salt", "uid", "doc_id", "n", "crcs").withColumn("own", own).join(F.broadcast(starts), "salt")
    whole = numbered.select("doc_id", "n", (F.col("base") + F.col("own")).alias("sequence"), F.posexplode("crcs").alias("k", "crc")).select(
        "doc_id", (F.col("k") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), (F.col("sequence") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return uncut.unionByName(halves).unionByName(whole)
