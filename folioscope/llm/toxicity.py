"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Each word enters as a word embedding (hashed) beside the mean of its character n-gram
embeddings (hashed, with the word's edges). A text is cut into overlapping windows of
``STEPS`` words, from its first word to its last; both directions of a gated recurrent
layer run over a window, attention pools their states, and a linear layer gives the window's
logit. A document's score comes from its highest window and the share of its windows that
look toxic, by a fitted logistic curve.

Training is in numpy, by back-propagation through time on a bounded, documented sample of
labelled documents. The smoothed log-odds of its hash row among toxic and clean documents are
added to the first value of each embedding; while training, those of a document come from other
documents than it. Labels are given to documents, not windows: at first all windows
of a toxic document count as toxic, later those that the network finds so and the highest
one.

Cases: text without a word (null, empty, or signs alone) scores 0 and is not learned from; very long texts are scored whole, windows in bounded groups; a label that is null or
belongs to no document is not learned from; no toxic or no clean example makes a model that
scores everything 0 (no toxic) or 1 (no clean); repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.sampling import labelled_sample
from folioscope.llm.util import is_held_out

#: Labelled documents learned from at most for each label, characters of each at most (in stretches from all over it)
#: and windows of each.
SAMPLE_PER_LABEL, MOST_CHARS, WINDOWS_PER_DOCUMENT = 1000, 32_768, 8
#: The score of a text without a word, which no curve decides.
NO_WORDS = 0.0
STEPS, STRIDE = 32, 24
WORD_ROWS, WORD_SIZE = 1 << 14, 8
GRAM_ROWS, GRAM_SIZE = 1 << 17, 16
HIDDEN, ATTENTION = 8, 8
GRAMS = (3, 4, 5)
ROUNDS, BATCH, RATE = 200, 256, 0.05
#: Rounds before which windows are chosen anew by what the network finds, and after which documents aside are looked at.
REVIEWS, CHECK_EVERY = (60, 110, 160), 40
#: Hash rows met in fewer documents of the sample stay zero: they say little about other documents.
LEAST_DOCUMENTS = 3
#: Scale of the log-odds that embeddings start from.
ODDS = 0.5
#: Parts that a label's examples go to in turn: 0 and 1 train the network, each with log-odds counted in the other;
#: 2 fits the curve and picks the round.
PARTS = (0, 1, 0, 1, 2)
TABLES, TABLE_RATE = ("word", "gram"), 1
#: Windows scored at once in a task, and distinct words kept.
GROUP = 8192
LEXICON_WORDS = 200_000

_TABLE = bytes(
    x + 32 if 0x41 <= x <= 0x5A else 0x20 if x <= 0x2F or 0x3A <= x <= 0x60 or 0x7B <= x <= 0x7F else x for x in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Vocabulary:
    """Distinct words as hash rows: one word row each, and flat n-gram rows with their word."""

    def __init__(self, words: list[bytes]):
        self.word = np.fromiter((zlib.crc32(w) % WORD_ROWS for w in words), np.int64, len(words))
        flat = np.frombuffer(b"".join([b"<%b>" % w for w in words]), np.uint8).astype(np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        rows, owners = [], []
        h = flat
        for n in range(2, max(GRAMS) + 1):
            if len(flat) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) ^ flat[n - 1 :]
            if n in GRAMS:
                inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
                mixed = (h[inside] ^ np.uint32(n)) * np.uint32(0x9E3779B1)
                rows.append((mixed >> np.uint32(15)).astype(np.int32))
                owners.append(owner[: len(owner) - n + 1][inside])
        self.gram = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.gram_of = np.concatenate(owners) if owners else np.zeros(0, np.int32)
        order = np.argsort(self.gram_of, kind="stable")
        self.gram, self.gram_of = self.gram[order], self.gram_of[order]
        self.counts = np.maximum(1, np.bincount(self.gram_of, minlength=len(words)))

    def inputs(self, net: dict[str, np.ndarray]) -> np.ndarray:
        """Each word's input: its embedding beside the mean of its n-grams'."""
        sums = np.zeros((len(self.word), GRAM_SIZE), np.float32)
        if len(self.gram):
            starts = np.flatnonzero(np.concatenate(([True], self.gram_of[1:] != self.gram_of[:-1])))
            sums[self.gram_of[starts]] = np.add.reduceat(net["gram"][self.gram], starts, axis=0)
        return np.concatenate([net["word"][self.word], sums / self.counts[:, None].astype(np.float32)], axis=1)


def word_inputs(words: list[bytes], net: dict[str, np.ndarray], at_once: int = 10_000) -> np.ndarray:
    """Inputs of many words, in parts that take little memory."""
    parts = [Vocabulary(words[k : k + at_once]).inputs(net) for k in range(0, len(words), at_once)]
    return np.concatenate(parts) if parts else np.zeros((0, WORD_SIZE + GRAM_SIZE), np.float32)


def windows_of(count: int) -> list[int]:
    """First words of a text's windows: every STRIDE words, until the last word is in one."""
    return list(range(0, max(1, count - STEPS + STRIDE), STRIDE)) if count > STEPS else [0]


def _window_words(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, none: int) -> np.ndarray:
    """Word numbers of each window, a column a step; ``none`` beyond a text's end."""
    at = starts[None, :] + np.arange(STEPS)[:, None]
    inside = at < ends[None, :]
    return np.where(inside, ids[np.minimum(at, max(0, len(ids) - 1))] if len(ids) else none, none)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def fresh(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = WORD_SIZE + GRAM_SIZE
    draw = lambda *shape, by: rng.normal(scale=by, size=shape).astype(np.float32)
    # zero: what training has not met says nothing
    net = {"word": np.zeros((WORD_ROWS, WORD_SIZE), np.float32), "gram": np.zeros((GRAM_ROWS, GRAM_SIZE), np.float32)}
    for side in ("f", "b"):
        net[f"in_{side}"] = draw(size, 3 * HIDDEN, by=size**-0.5)
        net[f"re_{side}"] = draw(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5)
        net[f"bias_{side}"] = np.zeros(3 * HIDDEN, np.float32)
    net |= {"att": draw(2 * HIDDEN, ATTENTION, by=0.3), "att_bias": np.zeros(ATTENTION, np.float32), "att_to": draw(ATTENTION, by=0.3)}
    net |= {"out": draw(2 * HIDDEN, by=0.3), "out_bias": np.zeros(1, np.float32)}
    return net


def _gates(x: np.ndarray, h: np.ndarray, re: np.ndarray) -> tuple:
    """One step: reset, update, the recurrent part of the candidate, the candidate."""
    n = HIDDEN
    back = h @ re
    both = _sigmoid(x[:, : 2 * n] + back[:, : 2 * n])
    r, z = both[:, :n], both[:, n:]
    c = np.tanh(x[:, 2 * n :] + r * back[:, 2 * n :])
    return r, z, back[:, 2 * n :], c


def _states(projected: dict[str, np.ndarray], words: np.ndarray, mask: np.ndarray, net: dict, keep: list | None = None) -> np.ndarray:
    """(steps, windows, both directions' states); a step without a word leaves the state as it is."""
    out = np.empty((STEPS, words.shape[1], 2 * HIDDEN), np.float32)
    for side, order, at in (("f", range(STEPS), 0), ("b", range(STEPS - 1, -1, -1), HIDDEN)):
        h = np.zeros((words.shape[1], HIDDEN), np.float32)
        for t in order:
            x = projected[side][words[t]]
            r, z, back, c = _gates(x, h, net[f"re_{side}"])
            new = z * h + (1 - z) * c
            new = np.where(mask[t][:, None], new, h)
            if keep is not None:
                keep.append((side, t, h, r, z, back, c))
            h = new
            out[t, :, at : at + HIDDEN] = h
    return out


def _pooled(states: np.ndarray, mask: np.ndarray, net: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hidden = np.tanh(states @ net["att"] + net["att_bias"])
    scores = np.where(mask, hidden @ net["att_to"], np.float32(-1e9))
    weights = np.exp(scores - scores.max(axis=0))
    weights = weights * mask
    weights = weights / np.maximum(weights.sum(axis=0), np.float32(1e-9))
    return hidden, weights, np.einsum("tn,tnk->nk", weights, states)


def _project(inputs: np.ndarray, net: dict) -> dict[str, np.ndarray]:
    """Each distinct word's share of the gates, and a zero row for no word."""
    out = {}
    for side in ("f", "b"):
        rows = inputs @ net[f"in_{side}"] + net[f"bias_{side}"]
        out[side] = np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)]).astype(np.float32)
    return out


def logits(net: dict, projected: dict[str, np.ndarray], words: np.ndarray, none: int) -> np.ndarray:
    mask = words != none
    pooled = _pooled(_states(projected, words, mask, net), mask, net)[2]
    return pooled @ net["out"] + net["out_bias"][0]


def _gradients(net: dict, vocabulary: Vocabulary, words: np.ndarray, none: int, target: np.ndarray) -> dict[str, np.ndarray]:
    """Of the log loss, by back-propagation through time."""
    inputs = vocabulary.inputs(net)
    projected = _project(inputs, net)
    mask, keep = words != none, []
    states = _states(projected, words, mask, net, keep)
    hidden, share, pooled = _pooled(states, mask, net)
    error = (_sigmoid(pooled @ net["out"] + net["out_bias"][0]) - target) / len(target)
    out = {"out": pooled.T @ error, "out_bias": np.array([error.sum()])}
    d_pool = error[:, None] * net["out"]
    d_share = np.einsum("tnk,nk->tn", states, d_pool)
    d_score = share * (d_share - (share * d_share).sum(axis=0))
    out["att_to"] = np.einsum("tna,tn->a", hidden, d_score)
    d_hidden = d_score[:, :, None] * net["att_to"] * (1 - hidden**2)
    out["att"] = np.einsum("tnk,tna->ka", states, d_hidden)
    out["att_bias"] = d_hidden.sum(axis=(0, 1))
    d_states = share[:, :, None] * d_pool + d_hidden @ net["att"].T

    d_rows = {}
    for side in ("f", "b"):
        at = 0 if side == "f" else HIDDEN
        re, d_re = net[f"re_{side}"], np.zeros_like(net[f"re_{side}"])
        d_h = np.zeros((words.shape[1], HIDDEN), np.float32)
        d_all = np.zeros((*words.shape, 3 * HIDDEN), projected[side].dtype)
        for _, t, h, r, z, back, c in reversed([k for k in keep if k[0] == side]):
            d_new = (d_h + d_states[t, :, at : at + HIDDEN]) * mask[t][:, None]
            passed = (d_h + d_states[t, :, at : at + HIDDEN]) * ~mask[t][:, None]
            d_c = d_new * (1 - z) * (1 - c**2)
            d_z = d_new * (h - c) * z * (1 - z)
            d_r = d_c * back * r * (1 - r)
            d_x = np.concatenate([d_r, d_z, d_c], axis=1)
            d_back = np.concatenate([d_r, d_z, d_c * r], axis=1)
            d_re += h.T @ d_back
            d_h = d_new * z + d_back @ re.T + passed
            d_all[t] = d_x
        d_rows[side] = _summed(words.ravel(), d_all.reshape(-1, 3 * HIDDEN), len(projected[side]))
        out[f"re_{side}"] = d_re
    d_inputs = np.zeros_like(inputs)
    for side in ("f", "b"):
        rows = d_rows[side][:-1]
        out[f"in_{side}"], out[f"bias_{side}"] = inputs.T @ rows, rows.sum(axis=0)
        d_inputs += rows @ net[f"in_{side}"].T
    out["word"] = _summed(vocabulary.word, d_inputs[:, :WORD_SIZE], WORD_ROWS)
    d_grams = d_inputs[:, WORD_SIZE:] / vocabulary.counts[:, None].astype(np.float32)
    out["gram"] = _summed(vocabulary.gram, d_grams[vocabulary.gram_of], GRAM_ROWS)
    return out


def _summed(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """For each of ``rows`` the sum of the values that ``index`` sends there."""
    out = np.zeros((rows, values.shape[1]), values.dtype)
    if len(index):
        order = np.argsort(index, kind="stable")
        index = index[order]
        starts = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
        out[index[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


@dataclass
class Model:
    """A network and the curve from a document's features to its score; no network: a constant score."""

    net: dict[str, np.ndarray] | None
    curve: np.ndarray | None = None
    constant: float = 0.0
    loss: float = 0.0

    def score(self, texts: list[str | None], lexicon: Lexicon | None = None) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.constant)
        owner, found, counts = window_logits(self.net, texts, lexicon or Lexicon(self.net))
        x = document_features(len(texts), owner, found)
        scores = 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -60, 60)))
        return np.where(counts > 0, scores, NO_WORDS)


class Lexicon:
    """Words met before, numbered, with their share of the gates; emptied when it gets large."""

    def __init__(self, net: dict):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.known = 0
        self.rows = {s: np.zeros((LEXICON_WORDS + 1, 3 * HIDDEN), np.float32) for s in ("f", "b")}

    def take_in(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's words as numbers from 1 (0 is no word), and where texts end."""
        if self.known > LEXICON_WORDS // 2:
            self.forget()
        ids, ends = _number(texts, self.number)
        new = list(islice(self.number, self.known, None))
        if new:
            projected = _project(word_inputs(new, self.net), self.net)
            while len(self.rows["f"]) <= len(self.number):
                self.rows = {s: np.concatenate([r, np.zeros_like(r)]) for s, r in self.rows.items()}
            for side, rows in self.rows.items():
                rows[self.known + 1 : len(self.number) + 1] = projected[side][:-1]
            self.known = len(self.number)
        return ids + 1, ends


def _number(texts: list[str | None], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words as numbers by ``number``, which learns new words, and where texts end."""
    ids, ends, total = [], [], 0
    for text in texts:
        words = words_of(text)
        for w in set(words).difference(number):
            number[w] = len(number)
        ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        total += len(words)
        ends.append(total)
    return np.concatenate(ids) if ids else np.zeros(0, np.int64), np.array(ends, np.int64)


def _all_windows(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, text's end) of every window."""
    begins = np.concatenate(([0], ends[:-1]))
    firsts = [b + np.array(windows_of(int(e - b))) for b, e in zip(begins, ends)]
    owner = np.repeat(np.arange(len(ends)), [len(f) for f in firsts])
    return owner, np.concatenate(firsts) if firsts else np.zeros(0, np.int64), ends[owner]


def window_logits(net: dict, texts: list[str | None], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window's text and logit, and every text's number of words."""
    ids, ends = lexicon.take_in(texts)
    owner, starts, stops = _all_windows(ends)
    out = [
        logits(net, lexicon.rows, _window_words(ids, starts[k : k + GROUP], stops[k : k + GROUP], 0), 0)
        for k in range(0, len(starts), GROUP)
    ]
    return owner, np.concatenate(out) if out else np.zeros(0, np.float32), np.diff(ends, prepend=0)


def document_features(texts: int, owner: np.ndarray, found: np.ndarray) -> np.ndarray:
    """A document's highest logit, and the share of its windows that look toxic, smoothed."""
    top = np.full(texts, -np.inf)
    np.maximum.at(top, owner, found)
    count = np.bincount(owner, minlength=texts)
    share = np.bincount(owner, weights=_sigmoid(found), minlength=texts) / np.maximum(count, 1)
    return np.stack([top, np.log(share + 0.01)], axis=1)


def train(examples: list[tuple[str, int]], seed: int = 5) -> Model:
    """``examples`` are (text, toxic); those without a word are left out."""
    examples = [(t, y) for t, y in examples if words_of(t)]
    labels = np.array([int(y) for _, y in examples], np.float32)
    if not len(labels) or not labels.any():
        return Model(None)
    if labels.all():
        return Model(None, constant=1.0)
    rng = np.random.default_rng(seed)
    part = np.zeros(len(labels), np.int64)
    for y in (0, 1):
        part[labels == y] = np.resize(PARTS, int((labels == y).sum()))
    texts = [t for t, _ in examples]
    if any(len(set(labels[part == k])) < 2 for k in range(3)):  # too few for parts of their own
        texts, labels, part = 3 * texts, np.tile(labels, 3), np.repeat([0, 1, 2], len(labels))
    checks, check_labels = [t for t, p in zip(texts, part) if p == 2], labels[part == 2]
    texts, labels, part = [t for t, p in zip(texts, part) if p != 2], labels[part != 2], part[part != 2]
    number: dict[bytes, int] = {}
    ids, ends = _number(texts, number)
    distinct = list(number)
    owner, starts, stops = _all_windows(ends)
    target, side = labels[owner], part[owner]
    use = _first_of_each(owner, rng.random(len(owner)))
    net = fresh(seed)
    moved = {k: np.float32(0) if k in TABLES else np.zeros_like(v) for k, v in net.items()}
    odds, live = _log_odds(distinct, ids, ends, labels, part)
    best: Model | None = None
    for step in range(ROUNDS):
        if step in REVIEWS:
            found = np.zeros(len(owner), np.float32)
            for k in (0, 1):
                mine = side == k
                found[mine] = _logits_at(_with_odds(net, odds[k]), distinct, ids, starts[mine], stops[mine])
            toxic = (found > 0) | _first_of_each(owner, -found, 1)
            hard = _first_of_each(owner, -found, WINDOWS_PER_DOCUMENT // 2) | _first_of_each(owner, rng.random(len(owner)), WINDOWS_PER_DOCUMENT // 2)
            use = np.where(target == 1, toxic & _first_of_each(owner, rng.random(len(owner)) - toxic), hard)
        # as many windows of either label, whatever their numbers; the two parts take turns
        at = np.concatenate([rng.choice(np.flatnonzero(use & (target == y) & (side == step % 2)), BATCH // 2) for y in (0, 1)])
        words = _window_words(ids, starts[at], stops[at], -1)
        seen, local = np.unique(words, return_inverse=True)
        known = seen[seen >= 0]
        local = np.where(words < 0, len(known), local.reshape(words.shape) - (len(seen) - len(known)))
        grads = _gradients(_with_odds(net, odds[step % 2]), Vocabulary([distinct[w] for w in known]), local, len(known), target[at])
        rate = RATE * (1 - 0.8 * step / ROUNDS)
        for name, g in grads.items():
            if name in TABLES:
                g *= live[name][:, None]
                # one pace for the whole table, so that a row met once hardly moves
                moved[name] += np.float32((g * g).sum(axis=1).max())
                net[name] -= (TABLE_RATE * rate * g / (np.sqrt(moved[name]) + 1e-6)).astype(np.float32)
            else:
                moved[name] += g * g
                net[name] -= (rate * g / (np.sqrt(moved[name]) + 1e-6)).astype(np.float32)
        if (step + 1) % CHECK_EVERY == 0 and step >= REVIEWS[0]:
            now = _calibrated(_with_odds(net, odds[2]), checks, check_labels)
            if best is None or now.loss < best.loss:
                best = now
    return best


def _with_odds(net: dict, odds: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The network with log-odds added to each embedding's first value."""
    out = net | {name: net[name].copy() for name in TABLES}
    for name in TABLES:
        out[name][:, 0] += odds[name]
    return out


def _log_odds(distinct: list[bytes], ids: np.ndarray, ends: np.ndarray, labels: np.ndarray, part: np.ndarray) -> tuple[list[dict], dict[str, np.ndarray]]:
    """Hash rows' log-odds for documents of part 0 (counted in part 1), of part 1 (in part 0) and for others (in both).

    Also says which rows enough documents have.
    """
    vocabulary = Vocabulary(distinct)
    first = np.searchsorted(vocabulary.gram_of, np.arange(len(distinct) + 1))
    seen = {name: np.zeros((2, 2, rows)) for name, rows in (("word", WORD_ROWS), ("gram", GRAM_ROWS))}
    for start, end, label, k in zip(np.concatenate(([0], ends[:-1])), ends, labels.astype(int), part):
        words = np.unique(ids[start:end])
        seen["word"][k, label][np.unique(vocabulary.word[words])] += 1
        spans = [vocabulary.gram[first[w] : first[w + 1]] for w in words]
        seen["gram"][k, label][np.unique(np.concatenate(spans)) if spans else []] += 1
    documents = np.array([[((part == k) & (labels == y)).sum() for y in (0, 1)] for k in (0, 1)])
    live = {name: (n.sum(axis=(0, 1)) >= LEAST_DOCUMENTS).astype(np.float32) for name, n in seen.items()}
    out = []
    for counted in ([1], [0], [0, 1]):
        total, odds = documents[counted].sum(axis=0), {}
        for name, n in seen.items():
            clean, toxic = n[counted].sum(axis=0)
            heard = toxic + clean >= min(LEAST_DOCUMENTS, LEAST_DOCUMENTS * len(counted) / 2)
            odds[name] = (ODDS * heard * (np.log((toxic + 0.5) / (total[1] + 1)) - np.log((clean + 0.5) / (total[0] + 1)))).astype(np.float32)
        out.append(odds)
    return out, live


def _first_of_each(owner: np.ndarray, by: np.ndarray, most: int = WINDOWS_PER_DOCUMENT) -> np.ndarray:
    """Marks the first windows of each document in the order of ``by``."""
    order = np.lexsort((by, owner))
    place = np.arange(len(owner)) - np.searchsorted(owner[order], owner[order])
    out = np.zeros(len(owner), bool)
    out[order[place < most]] = True
    return out


def _logits_at(net: dict, distinct: list[bytes], ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    projected = _project(word_inputs(distinct, net), net)
    none = len(distinct)
    parts = [_window_words(ids, starts[k : k + GROUP], stops[k : k + GROUP], none) for k in range(0, len(starts), GROUP)]
    return np.concatenate([logits(net, projected, p, none) for p in parts])


def _calibrated(net: dict, texts: list[str], labels: np.ndarray) -> Model:
    """A logistic curve over documents' features, slightly smoothed at the ends, by Newton's steps."""
    x = document_features(len(texts), *window_logits(net, texts, Lexicon(net))[:2])
    middle, width = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.concatenate([(x - middle) / width, np.ones((len(x), 1))], axis=1)
    y = labels * 0.99 + 0.005
    curve = np.array([1.0, 1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        ridge = np.diag([1e-2, 1e-2, 1e-6])
        slope = x.T @ (p - y) + ridge @ curve
        bend = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge
        curve = curve - np.clip(np.linalg.solve(bend, slope), -1, 1)
    rates = curve[:2] / width
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ curve, -30, 30))), 1e-6, 1 - 1e-6)
    loss = -(labels * np.log(p) + (1 - labels) * np.log(1 - p))
    weight = np.where(labels == 1, 1 / max(1, labels.sum()), 1 / max(1, (1 - labels).sum()))
    return Model({k: v.copy() for k, v in net.items()}, np.append(rates, curve[2] - rates @ middle), loss=float((weight * loss).sum()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of ``labels`` (doc_id, toxic), from a bounded sample of labelled documents."""
    marks = labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return train(labelled_sample(named, marks, SAMPLE_PER_LABEL, MOST_CHARS))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = 250) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value.net) if shared.value.net else None
        for batch in batches:
            for k in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(k, rows_at_once)
                scores = shared.value.score(part.column(1).to_pylist(), lexicon)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = narrow.mapInArrow(of, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with the columns they came with."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(shared.value.net) if shared.value.net else None
        for texts in parts:
            some = [t if isinstance(t, str) else None for t in texts]
            yield pd.Series(np.concatenate([shared.value.score(some[k : k + 250], lexicon) for k in range(0, len(some), 250)] or [np.zeros(0)]))

    return docs.where(score(F.col(text_col).cast("string")) < threshold)
