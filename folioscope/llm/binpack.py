"""Packing of whole documents into few windows: length patterns, non-negative least squares, best fit.

Documents become ids and an end id. Only documents longer than a window are cut, from their end, into whole
windows; what is left at their front and all shorter documents are pieces that stay whole. Patterns of few pieces
that fill a window, or fall short of it by a small slack, are enumerated by length; non-negative least squares
fits how often to repeat each so that they use up the histogram of lengths; the counts are rounded to what is
there, and what is left is solved again with more slack. The residual pieces go, longest first, to the window in
which they leave the least room, those of patterns with slack included, or to a new one.

The histogram has a row a length, and patterns and open windows are kept as runs of equal ones, so the plan is
bounded by the lengths, whatever the number of documents: it is made on the driver and broadcast. Pieces find their
place by their rank among those of their length, which is counted in parts (``packing``).

Cases: null or empty text is its end id alone; repeated rows and null ids are packed as rows of their own; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.packing import _gather, _ranked, _rounded, _salts, slices, solve
from folioscope.llm.util import Stash, quoted
from folioscope.llm.words import bytes_of, strings

WINDOW, END_ID = 2048, 0
#: Patterns tried for each length and number of parts, their most parts, and the slack allowed in each solution.
CHOICES, MOST_PARTS = 8, 8
SLACKS = (0, 0, 1, 2, 4, 8, 16, 32, 64)
#: Patterns begin with pieces over such a part of the window, and have so many parts: first those of which each takes a
#: window of its own, with as few others as will do, as these are short of partners.
BANDS = ((2, 2), (2, 3), (2, MOST_PARTS), (3, MOST_PARTS), (None, MOST_PARTS))
#: Bytes that a word which is kept for later may have, and how many words and ids are kept in a worker.
WORD_BYTES, WORDS_KEPT, IDS_KEPT = 64, 250_000, 2_500_000
#: Bytes of text that are encoded at once in a task.
SLICE_BYTES = 3 << 20
#: Bytes that can't begin a white space: visible ASCII, and first bytes of characters under which none is white.
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = SOLID[0xC3:] = True
SOLID[[0xE1, 0xE2, 0xE3]] = False
LETTER = np.zeros(256, bool)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = True
#: Words that are encoded in one string.
TOGETHER = 100
#: Texts on which encoding word by word must agree with the tokenizer, or whole texts are encoded.
PROBES = ["One two,  three\n four\t five. (a-b) c_d's x.'s y, z 's it's    x 　y", " a  b ", "x\n\n  y <|endoftext|> z<|endoftext|>", "été 日本語 🙂 12 34", "  "]


class WordIds:
    """Ids by a byte-level tokenizer, whose words begin with the space before them.

    Before a space with a visible character behind it such a tokenizer always cuts, and so it does between an ASCII
    letter and a sign; texts are cut there too and each distinct word is encoded once, many in one string: their
    ids fall apart again at those that begin with a space. Words are kept for later texts, up to a bound.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Signs before which a word is cut; no special token is, and an apostrophe may belong to the letters behind it.
        self.signs = np.zeros(256, bool)
        self.signs[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'" + "".join(added)]] = True
        #: Which ids begin with a space.
        self.spaced = np.zeros(1 << 16, bool)
        self.spaced[[i for piece, i in self.tokenizer.get_vocab().items() if piece.startswith("Ġ") and piece not in added]] = True
        self.cut = True
        self._forget()
        ids, ends = self.batch(pa.array(PROBES))
        whole = [self.tokenizer.encode(t, add_special_tokens=False).ids + [END_ID] for t in PROBES]
        self.cut = [ids[a:b].tolist() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())] == whole

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.starts, self.sizes = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one behind the other, and how many each has."""
        found = [np.array(e.ids, np.uint16) for e in self.many(words, add_special_tokens=False)] if words else []
        return np.concatenate([*found, np.zeros(0, np.uint16)]), np.array([len(x) for x in found], np.int64)

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of a space and visible characters, with many in one string."""
        ids, _ = self._encode(["".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)])
        first = np.flatnonzero(self.spaced[ids])
        if len(first) != len(words):
            return self._encode(words)
        return ids, np.diff(first, append=len(ids))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: a pool of ids, and where each word's begin there and how many it has."""
        if len(self.known) > WORDS_KEPT or len(self.pool) > IDS_KEPT:
            self._forget()
        fresh = [w for w in words if w not in self.known and len(w) <= WORD_BYTES]
        plain = [w for w in fresh if w[0] == " " and w.split() == [w[1:]]] if self.cut else []
        rest = list(set(fresh).difference(plain))
        (ids, sizes), (others, counts) = self._spaced(plain), self._encode(rest)
        fresh, ids, sizes = plain + rest, np.concatenate([ids, others]), np.concatenate([sizes, counts])
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids])
        index = np.array([self.known.get(w, -1) for w in words], np.int64)
        long = np.flatnonzero(index < 0)
        ids, sizes = self._encode([words[k] for k in long.tolist()])
        index[long] = len(self.starts) + np.arange(len(long))
        starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        return np.concatenate([self.pool, ids]), starts[index], np.concatenate([self.sizes, sizes])[index]

    def batch(self, texts: pa.Array, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with ``end`` behind each, and where each text ends."""
        data, at = bytes_of(texts)
        mark = np.zeros(len(data) + 1, bool)
        if self.cut and len(data):
            mark[:-2] = (data[:-1] == 0x20) & SOLID[data[1:]]
            mark[1:-1] |= LETTER[data[:-1]] & self.signs[data[1:]]
        mark[at[:-1]] = True
        begins = np.flatnonzero(mark[:-1])
        counts = np.diff(np.searchsorted(begins, at))
        coded = strings(data, begins).dictionary_encode()
        pool, starts, sizes = self._words(coded.dictionary.to_pylist())
        starts, sizes, pool = np.append(starts, len(pool)), np.append(sizes, 1), np.append(pool, np.uint16(end))
        stops = np.cumsum(counts) + np.arange(len(counts))  # where the end ids stand among the words
        index = np.full(len(coded) + len(counts), len(starts) - 1)
        inside = np.ones(len(index), bool)
        inside[stops] = False
        index[inside] = coded.indices.to_numpy()
        ids, n = _gather(pool, starts, sizes, index)
        return ids, np.cumsum(n)[stops]


@lru_cache(maxsize=2)
def load(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: uid, doc_id, piece, start, length, ids_crc32; a document's first piece may be shorter than a window."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, uid = load(tokenizer), TaskContext.get().partitionId() << 33
        for part in (p for batch in batches for p in slices(batch, 1, SLICE_BYTES)):
            ids, ends = words.batch(part.column(1))
            wide = memoryview(ids.astype("<u4"))
            n = np.diff(ends, prepend=0)
            count = (n - 1) // window + 1
            row = np.repeat(np.arange(len(n)), count)
            number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = (n - 1) % window + 1
            start = np.where(number > 0, first[row] + (number - 1) * window, 0)
            length = np.where(number > 0, window, first[row])
            begin = (ends - n)[row] + start
            crcs = [zlib.crc32(wide[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            uids = np.arange(uid, uid + len(row))
            uid += len(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids), part.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(length, pa.int32()), pa.array(crcs, pa.int64())],
                ["uid", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    narrow = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return narrow.mapInArrow(of, "uid long, doc_id long, piece int, start long, length int, ids_crc32 long")


def patterns(histogram: np.ndarray, window: int, slack: int = 0, over: int = 0, most: int = MOST_PARTS, choices: int = CHOICES, seed: int = 0) -> np.ndarray:
    """Patterns of lengths that fill the window but for ``slack`` at most, one a row, zeros in front.

    For each number of parts and every length above ``over`` some patterns begin with it (one of two parts): the
    parts between are drawn as often as the histogram has them, the last is the longest there is that still fits.
    """
    lengths = np.flatnonzero(histogram)
    if not len(lengths):
        return np.zeros((0, 2), np.int64)
    upto = np.maximum.accumulate(np.where(histogram > 0, np.arange(len(histogram)), 0))
    mean = (lengths * histogram[lengths]).sum() / histogram[lengths].sum()
    depth = int(min(most, max(3, math.ceil(window / mean) + 1)))
    share = np.cumsum(histogram) / histogram.sum()
    rng = np.random.default_rng(seed)
    out = []
    for parts in range(2, depth + 1):
        first = np.repeat(lengths[lengths > over], choices if parts > 2 else 1)
        drawn = [first, *(np.searchsorted(share, rng.random(len(first)), side="right") for _ in range(parts - 2))]
        rest = window - np.sum(drawn, axis=0)
        last = upto[np.maximum(rest, 0)]
        fits = (last > 0) & (rest - last <= slack)
        found = np.sort(np.stack([*drawn, last], axis=1)[fits], axis=1)
        out.append(np.pad(found, ((0, 0), (depth - parts, 0))))
    return np.unique(np.concatenate(out), axis=0)


def best_fit(left: np.ndarray, used: np.ndarray, window: int, sequence: int, room: dict[int, list[tuple[int, int]]]) -> tuple[list[tuple], int]:
    """Slots of the residual pieces, longest first, each in the open window where it leaves the least room.

    ``room`` has, by what is free in them, runs (sequence, count) of windows; equal windows and equal pieces are
    placed together. The slots' ranks go on from ``used``. Returns slots and the number of sequences.
    """
    rows = []

    def put(length: int, first: int, count: int, each: int, free: int) -> None:
        for j in range(each):
            rows.append((length, int(used[length]), int(used[length]) + count, first, window - free + j * length))
            used[length] += count
        if free - each * length:
            room.setdefault(free - each * length, []).append((first, count))

    for length in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[length])
        while todo:
            free = min((r for r, runs in room.items() if r >= length and runs), default=window)
            first, count = room[free].pop() if room.get(free) else (sequence, todo)
            each = min(free // length, todo)
            whole = min(count, todo // each)
            if first == sequence:
                sequence += whole
            elif whole < count:
                room[free].append((first + whole, count - whole))
            put(length, first, whole, each, free)
            todo -= whole * each
    return rows, sequence


def plan(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple], int, int]:
    """Slots of pieces by length and rank, the number of sequences, and how many pieces the patterns placed.

    A slot (length, low, high, sequence, offset) says that pieces with ranks from low up to high lie at ``offset``
    of the sequences from ``sequence`` on, one each.
    """
    left = np.zeros(window + 1, np.int64)
    for length, count in counts.items():
        left[length] = count
    used, rows, sequence, room = np.zeros(window + 1, np.int64), [], 0, {}
    for again, ((band, most), slack) in enumerate((b, s) for b in BANDS for s in SLACKS):
        combos = patterns(left, window, slack, window // band if band else 0, most, seed=again)
        shares = solve(left.astype(float), combos)
        if len(combos) > 2 * window:  # the plan stays small, however many patterns there are
            combos = combos[np.argsort(-shares, kind="stable")[: 2 * window]]
            shares = solve(left.astype(float), combos)
        for parts, times in _rounded(shares, combos, left):
            offset = 0
            for p in parts[::-1].tolist():
                rows.append((p, int(used[p]), int(used[p]) + times, sequence, offset))
                used[p] += times
                offset += p
            if offset < window:
                room.setdefault(window - offset, []).append((sequence, times))
            sequence += times
    placed = int(used.sum())
    rest, sequence = best_fit(left, used, window, sequence, room)
    return rows + rest, sequence, placed


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = Stash(spark, "binpack").put(pieces(docs, tokenizer, window, id_col, text_col), "pieces")
    parts = rows.where(F.col("length") < window)
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # one row a length
    slots, sequences, _ = plan(counts, window)
    table = spark.createDataFrame(slots, "_length int, _low long, _high long, _sequence long, _offset long")
    inside = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_low")) & (F.col("rank") < F.col("_high"))
    placed = _ranked(parts, _salts(sum(counts.values()))).join(F.broadcast(table), inside)
    of = lambda df, sequence, offset: df.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))
    whole = of(rows.where(F.col("length") == window), F.col("uid") + sequences, F.lit(0).cast("long"))
    return of(placed, F.col("_sequence") + F.col("rank") - F.col("_low"), F.col("_offset")).unionByName(whole)
