"""Words of whole texts as Arrow columns: runs of letters and digits, A-Z lower-cased.

A word is a maximal run of ASCII letters, ASCII digits and characters beyond ASCII. Texts are worked
through as bytes, many at once; all bytes of characters beyond ASCII are from 0x80 on, so bytes decide.
A null text has no words.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
INSIDE = np.zeros(256, bool)
INSIDE[ord("0") : ord("9") + 1] = INSIDE[ord("A") : ord("Z") + 1] = INSIDE[ord("a") : ord("z") + 1] = INSIDE[0x80:] = True

#: crc32 of a byte's eight steps.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1).astype(np.uint32)
#: Bytes from which on a word's crc is computed by itself.
LONG_WORD = 64


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, one behind the other, and where each begins and the last ends."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def strings(data: np.ndarray, starts: np.ndarray) -> pa.StringArray:
    """The stretches of ``data`` that begin at ``starts``, each up to the next one's start."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def words_of(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts in order, and how many each text has."""
    data, at = bytes_of(texts)
    inside = INSIDE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = inside[heads]
    counts = np.diff(np.searchsorted(np.flatnonzero(first), at))
    return strings(LOWER[data[inside]], np.flatnonzero(first[inside])), counts


def runs_of(words: pa.StringArray, counts: np.ndarray, size: int) -> tuple[pa.StringArray, np.ndarray]:
    """All runs of ``size`` consecutive words of a text, joined by a space, and how many each text has."""
    if size == 1:
        return words, counts
    n = np.maximum(counts - size + 1, 0)
    heads = np.repeat(np.cumsum(counts) - counts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    parts = [words.take(pa.array(heads + k)) for k in range(size)]
    return pc.binary_join_element_wise(*parts, " "), n


def crc32_of(words: pa.StringArray) -> np.ndarray:
    """Unsigned crc32 of each word's UTF-8 bytes, a byte of all words at a time."""
    data, at = bytes_of(words)
    sizes = np.diff(at)
    out = np.zeros(len(sizes), np.uint32)
    long = np.flatnonzero(sizes > LONG_WORD)
    out[long] = [zlib.crc32(data[at[k] : at[k + 1]].tobytes()) for k in long]
    order = np.argsort(-np.where(sizes > LONG_WORD, 0, sizes), kind="stable")
    left = np.where(sizes > LONG_WORD, 0, sizes)[order]
    starts, crc = at[:-1][order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))
        crc[:n] = CRC[(crc[:n] ^ data[starts[:n] + k]) & 255] ^ (crc[:n] >> 8)
    short = sizes[order] <= LONG_WORD
    out[order[short]] = ~crc[short]
    return out
