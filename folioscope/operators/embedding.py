"""The port for local embedding models: loaded once a worker, fed in batches of bounded size.

No model is shipped. ``HashedWords`` stands in for one in tests and trials: it needs no weights, and texts with words in
common come out close, nothing more.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts and characters that a model gets at once.
TEXTS_AT_ONCE, CHARS_AT_ONCE = 256, 1 << 20


class Model(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray:
        """A row a text."""


def embed(chunks: DataFrame, load: Callable[[int], Model], dims: int, text_col: str = "text") -> DataFrame:
    """``chunks`` with vector (array<float> of ``dims``) and reason, which says why a row has none: ``empty``.

    ``load(dims)`` makes the model, in each task that has a text to embed. A model that returns another shape is an error.
    """
    out = T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("reason", T.StringType())])
    names = chunks.columns
    place = names.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            texts = batch.column(place).to_pylist()
            vectors: list[np.ndarray | None] = [None] * len(texts)
            due = [k for k, t in enumerate(texts) if t and t.strip()]
            groups: list[list[int]] = []
            chars = 0
            for k in due:
                chars += len(texts[k])
                if not groups or len(groups[-1]) == TEXTS_AT_ONCE or chars > CHARS_AT_ONCE:
                    groups.append([])
                    chars = len(texts[k])
                groups[-1].append(k)
            for some in groups:
                model = model or load(dims)
                found = np.asarray(model.embed([texts[k] for k in some]), np.float32)
                if found.shape != (len(some), dims):
                    raise ValueError(f"the model made {found.shape}, not {(len(some), dims)}")
                for k, v in zip(some, found):
                    vectors[k] = v
            reasons = ["empty" if v is None else None for v in vectors]
            arrays = [*batch.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "vector", "reason"])

    return chunks.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(of, out)


class HashedWords:
    """Unit sums of a fixed random direction for each word, whatever its letters' case."""

    def __init__(self, dims: int):
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for k, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()) or [text]:
                out[k] += np.random.default_rng(zlib.crc32(word.encode())).normal(size=self.dims)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)
