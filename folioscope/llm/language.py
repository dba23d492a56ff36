"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's letters are lower-cased and everything else becomes one gap; its 2-, 3- and
4-grams of characters are hashed to embedding rows, whose mean goes through a linear softmax.
Embeddings and weights are trained together by stochastic gradient descent in numpy on
snippets of a bounded sample; as both are linear, what is sent to the tasks is one small
table with a value for each hash row and language.

Calibrated rejection: a temperature is fitted on sample documents that training did not
see, and so is the least probability at which ``REJECT_ERROR`` of the answers are wrong at most;
answers below it are marked as rejected (``accepted`` false), with the language still named.

Cases: null text or one without a letter is ``und`` with score 0; very long texts are read
whole, in stretches; texts without a gram of letters can't occur (a letter with its gaps
makes one); ties go to the first language in order; no learned language (an empty or
unlabelled table) makes everything ``und``; repeated rows are predicted alike; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.sampling import labelled_sample
from folioscope.llm.util import is_held_out

#: Documents learned from at most, for each language, and characters of each at most, in stretches from all over it.
SAMPLE_PER_LANGUAGE, MOST_CHARS = 250, 16_384
#: Characters of a snippet at most, and about how many snippets are learned from.
SNIPPET, SNIPPETS = 240, 6000
ROWS, DIMENSIONS = 1 << 15, 16
EPOCHS, RATE = 3, 0.6
REJECT_ERROR = 0.01
#: Code points looked at together.
STRETCH = 1 << 19


@cache
def _folds() -> np.ndarray:
    """For each code point its lower case, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low[0])
    return out


def grams(text: str) -> Iterator[np.ndarray]:
    """Hash rows of the text's grams, a stretch at a time; none if it has no letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    carry = np.zeros(1, np.uint32)
    for start in range(0, len(codes), STRETCH):
        last = start + STRETCH >= len(codes)
        x = np.concatenate([carry, _folds()[codes[start : start + STRETCH]], np.zeros(int(last), np.uint32)])
        x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
        carry = x[-3:]
        if x.any():
            yield _hashed(x)


def _hashed(x: np.ndarray) -> np.ndarray:
    """2-grams, then 3- and 4-grams, of lower-case letters and gaps (0)."""
    prime = np.uint32(0x9E3779B1)
    h = x[:-1] * prime + x[1:]
    out = [h * prime]
    for n in (3, 4):
        if len(x) < n:
            break
        h = h[:-1] * prime + x[n - 1 :]
        out.append((h * prime) ^ np.uint32(n))
    return np.concatenate(out) >> np.uint32(32 - 15)


@dataclass
class Model:
    """``table`` has each hash row's share of each language's logit."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, text: str) -> np.ndarray | None:
        total, count = np.zeros(len(self.languages)), 0
        for rows in grams(text):
            total += self.table[rows].sum(axis=0, dtype=np.float64)
            count += len(rows)
        return total / count + self.bias if count else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        z = self.logits(text) if text and self.languages else None
        if z is None:
            return "und", 0.0, False
        p = _softmax(z / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.least)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _snippets(text: str, rng: np.random.Generator, count: int) -> list[str]:
    """Stretches of words from all over the text, of mixed lengths."""
    out = []
    for _ in range(count):
        size = int(rng.integers(12, SNIPPET))
        start = int(rng.integers(0, max(1, len(text) - size)))
        out.append(text[start : start + size])
    return out


def train(examples: list[tuple[str, str]], seed: int = 11) -> Model:
    """``examples`` are (text, language); every fifth is kept for calibration."""
    languages = sorted({lang for _, lang in examples})
    if not languages:
        return Model([], np.zeros((ROWS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    fit = [x for k, x in enumerate(examples) if k % 5] or examples
    checks = [x for k, x in enumerate(examples) if not k % 5]
    each = max(1, SNIPPETS // len(fit))
    pieces = [(s, languages.index(lang)) for text, lang in fit for s in [*_snippets(text, rng, each), text[:SNIPPET]]]
    data = [(np.concatenate(rows), y) for s, y in pieces if (rows := list(grams(s)))]
    e = rng.normal(scale=0.1, size=(ROWS, DIMENSIONS))
    w = rng.normal(scale=0.3, size=(DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    steps, step = EPOCHS * len(data), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            rows, y = data[k]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = e[rows].mean(axis=0)
            error = _softmax(mean @ w + bias)
            error[y] -= 1
            push = w @ error
            w -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            np.subtract.at(e, rows, rate * push / len(rows) * 20)
    model = Model(languages, (e @ w).astype(np.float32), bias)
    return _calibrated(model, checks, rng)


def _calibrated(model: Model, checks: list[tuple[str, str]], rng: np.random.Generator) -> Model:
    seen = [(z, model.languages.index(lang)) for text, lang in checks for s in [text, *_snippets(text, rng, 2)] if (z := model.logits(s)) is not None]
    if not seen:
        return model
    z, y = np.stack([a for a, _ in seen]), np.array([b for _, b in seen])
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = _softmax(z / model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top)
    wrong = np.cumsum(~right[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(wrong <= REJECT_ERROR)
    model.least = float(top[order[fine[-1]]]) if len(fine) else 1.0
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages of learnable documents, from a bounded sample."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("label"))
    return train(labelled_sample(named.select("id", "text"), named.select("id", "label"), SAMPLE_PER_LANGUAGE, MOST_CHARS))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "accepted"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = narrow.mapInArrow(of, "doc_id long, lang_pred string, score double, accepted boolean")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
