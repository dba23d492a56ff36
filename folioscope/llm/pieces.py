"""SentencePiece encoding and decoding by vectorised merge rounds.

Texts are cut before each run of word-start marks; no piece goes over such a cut, so the
parts ("words") of many texts are merged side by side. All words' symbols lie in one flat
array. A round finds the best pair rank of every word (a segmented minimum), merges its
leftmost pairs of that rank at once and compacts the array; words without a pair leave it.
Merging several equal pairs at once gives what one at a time gives unless a merged symbol
makes a pair that is at least as good; such words take their leftmost pair only.

Words met before are looked up in a bounded cache, so that frequent words are merged once.

Cases: null or empty text has no ids and decodes to ""; characters outside the vocabulary
become byte pieces; very long texts and words without a space are merged like any (rounds
grow with the word, memory with the batch); repeated rows, empty tables and other columns
need nothing special. The model must be BPE with byte fallback and without a normaliser
table, or ``load`` raises.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NONE = np.int32(2**31 - 1)
#: Words that a Python worker keeps in each of two generations, and the longest one that is kept.
CACHE_WORDS, CACHE_CHARS = 200_000, 64
#: Words merged at once.
ROUND_WORDS = 20_000


class Pieces:
    """A model's tables: symbols are pieces, then characters that only longer pieces hold."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        proto.ParseFromString(processor.serialized_model_proto())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
        self.prefix = norm.add_dummy_prefix
        kinds = [p.type for p in proto.pieces]
        names = [p.piece for p in proto.pieces]
        if any(k in (4, 5) for k in kinds) or any(MARK in n.lstrip(MARK) for n, k in zip(names, kinds) if k == 1):
            raise ValueError("user-defined and unused pieces, and pieces over several words, are not served")
        self.byte_id = {int(n[1:-1], 16): i for i, (n, k) in enumerate(zip(names, kinds)) if k == 6}
        self.text = [b"" if k == 3 else bytes([int(n[1:-1], 16)]) if k == 6 else n.replace(MARK, " ").encode() for n, k in zip(names, kinds)]
        self.digits = [b"%d" % i for i in range(len(names))]
        self.text[names.index("<unk>")] = " ⁇ ".encode()

        symbol = {n: i for i, (n, k) in enumerate(zip(names, kinds)) if k == 1}
        self.known = len(names)
        for name in [n for n, k in zip(names, kinds) if k == 1]:
            for c in name:
                symbol.setdefault(c, self.known + len(symbol))
        self.width = max(symbol.values()) + 2
        self.of_char = np.full(0x110000, -1, np.int32)
        for name, i in symbol.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i
        scores = sorted({p.score for p in proto.pieces if p.type == 1}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        keys, ranks, merged = [], [], []
        for i, (name, kind) in enumerate(zip(names, kinds)):
            for cut in range(1, len(name)) if kind == 1 else ():
                a, b = symbol.get(name[:cut]), symbol.get(name[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    ranks.append(rank[proto.pieces[i].score])
                    merged.append(i)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self._build(np.array(keys, np.int64), np.array(ranks, np.int32), np.array(merged, np.int32), bits)
        self.cache: dict[str, tuple[bytes, int, bytes]] = {}
        self.older: dict[str, tuple[bytes, int, bytes]] = {}

    def _build(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray, bits: int) -> None:
        """An open-addressed table of pairs: linear probing, at most a quarter full."""
        self.shift = np.uint64(64 - bits)
        self.slots = np.full((1 << bits) + 64, -1, np.int64)
        self.at_rank = np.full(len(self.slots), NONE, np.int32)
        self.at_merged = np.full(len(self.slots), -1, np.int32)
        left = np.arange(len(keys))
        step = 0
        while len(left):
            where = self._home(keys[left]) + step
            free = self.slots[where] < 0
            _, first = np.unique(where[free], return_index=True)
            took = left[free][first]
            spot = where[free][first]
            self.slots[spot], self.at_rank[spot], self.at_merged[spot] = keys[took], ranks[took], merged[took]
            left = np.setdiff1d(left, took, assume_unique=True)
            step += 1
        self.probes = max(1, step)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or NONE, merged symbol) of each pair; a negative symbol pairs with nothing."""
        keys = np.where((a < 0) | (b < 0), np.int64(-2), a.astype(np.int64) * self.width + b)
        spot = self._home(keys)
        open_ = np.flatnonzero(keys >= 0)
        found = np.full(len(keys), -1, np.int64)
        for _ in range(self.probes):
            if not len(open_):
                break
            held = self.slots[spot[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = spot[open_[hit]]
            open_ = open_[~hit & (held >= 0)]
            spot[open_] += 1
        ok = found >= 0
        return np.where(ok, self.at_rank[found], NONE), np.where(ok, self.at_merged[found], -1)

    def _pair_ranks(self, sym: np.ndarray, seg: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs (i, i + 1) for i in ``at``; none at the end of a word."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        inside = (at + 1 < len(sym)) & (seg[nxt] == seg[at])
        rank, merged = self.lookup(np.where(inside, sym[at], -1), sym[nxt])
        return rank, merged

    def merge(self, words: list[str]) -> list[list[int]]:
        """The symbols of each word as ids; unknown characters as negative code points less one."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        sym = self.of_char[code]
        sym = np.where(sym < 0, -1 - code, sym).astype(np.int64)
        seg = np.repeat(np.arange(len(words)), lengths)
        rank, merged = self._pair_ranks(sym, seg, np.arange(len(sym)))
        done_sym, done_seg = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            sizes = np.diff(np.append(starts, len(seg)))
            best = np.minimum.reduceat(rank, starts)
            open_ = best < NONE
            if not open_.all():
                stay = np.repeat(open_, sizes)
                done_sym.append(sym[~stay])
                done_seg.append(seg[~stay])
                sym, seg, rank, merged = sym[stay], seg[stay], rank[stay], merged[stay]
                if not len(sym):
                    break
                sizes, best = sizes[open_], best[open_]
            word = np.repeat(np.arange(len(sizes)), sizes)
            hit = rank == best[word]
            at = np.flatnonzero(hit)
            # of touching pairs (a run of one symbol) every second, from the left
            fresh = np.concatenate(([True], at[1:] != at[:-1] + 1))
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            counts = np.bincount(word[at], minlength=len(sizes))
            if (counts > 1).any():
                at = self._safe(sym, seg, rank, merged, word, best, counts, at)
            sym[at] = merged[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, seg, rank, merged = sym[keep], seg[keep], rank[keep], merged[keep]
            spot = moved[at]
            redo = np.unique(np.concatenate([spot, np.maximum(spot - 1, 0)]))
            rank[redo], merged[redo] = self._pair_ranks(sym, seg, redo)
        flat = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        owner = np.concatenate(done_seg) if done_seg else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(words) + 1))
        flat = flat[order].tolist()
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _safe(self, sym, seg, rank, merged, word, best, counts, at) -> np.ndarray:
        """``at`` without all but the first of a word where merging makes a pair at least as good."""
        many = at[counts[word[at]] > 1]
        new = merged[many]
        after = np.minimum(many + 2, len(sym) - 1)
        right = np.where((many + 2 < len(sym)) & (seg[after] == seg[many]), sym[after], -1)
        before = np.maximum(many - 1, 0)
        was_merged = np.isin(many - 2, many)
        left = np.where(was_merged, new, sym[before])
        left = np.where((many > 0) & (seg[before] == seg[many]), left, -1)
        worst = np.minimum(self.lookup(new, right)[0], self.lookup(left, new)[0])
        bad = np.unique(word[many[worst <= best[word[many]]]])
        first = np.concatenate(([True], word[at][1:] != word[at][:-1]))
        return at[first | ~np.isin(word[at], bad)]

    def _ids(self, symbols: list[int]) -> list[int]:
        """Byte pieces for what the vocabulary lacks."""
        if not symbols or (min(symbols) >= 0 and max(symbols) < self.known):
            return symbols
        out: list[int] = []
        for s in symbols:
            if 0 <= s < self.known:
                out.append(s)
            else:
                c = chr(-1 - s) if s < 0 else self._char(s)
                out += [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]
        return out

    def _char(self, symbol: int) -> str:
        return chr(int(np.flatnonzero(self.of_char == symbol)[0]))

    def learn(self, words: list[str]) -> dict[str, tuple[bytes, int, bytes]]:
        """(ids joined by commas, their number, their text) of words that start with a mark or a text."""
        out = {}
        for k in range(0, len(words), ROUND_WORDS):
            some = words[k : k + ROUND_WORDS]
            for w, symbols in zip(some, self.merge([w.replace(" ", MARK) for w in some])):
                ids = self._ids(symbols)
                out[w] = (b",".join([self.digits[i] for i in ids]), len(ids), self.decode_bytes(ids))
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.text[i] for i in ids])

    def words(self, text: str) -> list[str]:
        """The text's words, each with the spaces before it."""
        if not text:
            return []
        whole = (" " if self.prefix else "") + text
        return re.findall(r" +[^ ]*|[^ ]+", whole)

    def encode(self, text: str) -> list[int]:
        return [i for symbols in self.merge([w.replace(" ", MARK) for w in self.words(text.replace(MARK, " "))]) for i in self._ids(symbols)] if text else []

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes joined, one leading space of the prefix taken off; bad UTF-8 is replaced."""
        out = self.decode_bytes(ids).decode("utf-8", "replace")
        return out[1:] if self.prefix and out.startswith(" ") else out

    def batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(ids' number, digest of ids, digest of decoded text) of each text."""
        split = [self.words(t.replace(MARK, " ")) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        known = [list(map(self.cache.get, words)) for words in split]
        new = {w for words, rows in zip(split, known) if None in rows for w, r in zip(words, rows) if r is None}
        found = {w: self.older[w] for w in new if w in self.older}
        found |= self.learn(sorted(new.difference(found), key=len))
        self.cache.update((w, v) for w, v in found.items() if len(w) <= CACHE_CHARS)
        out = []
        for words, rows in zip(split, known):
            if None in rows:
                rows = [found[w] if r is None else r for w, r in zip(words, rows)]
            text = b"".join([r[2] for r in rows])
            text = text[1:] if self.prefix and text.startswith(b" ") else text
            out.append((sum([r[1] for r in rows]), hashlib.sha256(b",".join([r[0] for r in rows])).hexdigest(), hashlib.sha256(text).hexdigest()))
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """The model's tables, once per Python worker."""
    return Pieces(path)


def encode_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = 500) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            for k in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(k, rows_at_once)
                rows = pieces.batch([t or "" for t in part.column(1).to_pylist()])
                n, ids, text = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            ids = [pieces.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(of, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give ""."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            texts = [pieces.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(of, "doc_id long, text string")
