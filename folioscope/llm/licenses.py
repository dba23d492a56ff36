"""License scans: fixed phrases, and an exact set-similarity join of text blocks with templates.

A block is any run of at most ``SPREAD`` times a template's words in a text. A template's
label is given if some block holds at least ``CONTAINMENT`` of its distinct words.
The join is exact and prunes in this order: template words are put in one global order,
rarest in the documents first; a block that holds k of a template's n words must hold one
of its first n - k + 1 (the prefix). An inverted index from prefix words to templates is joined with
each text's distinct words, so a text meets only the templates of whose rare words it has one, however
many there are; a text with fewer than k distinct words of such a template can't qualify (length), nor
can blocks whose reach ends before the next prefix word (position). All blocks that qualify are
returned, overlapping ones as one stretch.

The index goes to every task, so its words are counted first: more than ``MOST_WORDS`` are an error.

Documents that hold a template's word are counted over all documents, for template words only, so the table is
bounded by the templates and may go to the driver and back to every task.

Cases: null or empty text has no words, no label and no block; templates or texts with repeated words
count each once; a very long text takes time in proportion to its length, also where it repeats a phrase all
along; equal shares don't matter, the best one is the score; repeated rows are scanned
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the query's contract: phrase and label.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Openings of well-known license notices, with the labels they get.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)
CONTAINMENT = 0.8
SPREAD = 1.5
#: Words of all templates together, at most.
MOST_WORDS = 2_000_000

#: Words are runs of what isn't listed here as a separator; A-Z become a-z.
_TABLE = bytes(
    x + 32 if 0x41 <= x <= 0x5A else 0x20 if x <= 0x2F or 0x3A <= x <= 0x60 or 0x7B <= x <= 0x7F else x for x in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    """A template's distinct words, rarest first, and what a block of it needs."""

    label: str
    words: tuple[bytes, ...]
    needed: int
    span: int

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.words[: len(self.words) - self.needed + 1]


def prepare(templates: tuple[tuple[str, str], ...], frequency: dict[bytes, int], containment: float, spread: float) -> list[Template]:
    out = []
    for text, label in templates:
        words = words_of(text)
        ordered = tuple(sorted(set(words), key=lambda w: (frequency.get(w, 0), w)))
        out.append(Template(label, ordered, math.ceil(containment * len(ordered)), math.ceil(spread * len(words))))
    return out


def prefix_index(templates: list[Template]) -> dict[bytes, list[int]]:
    """The templates, by number, of whose prefix a word is part."""
    out: dict[bytes, list[int]] = {}
    for k, t in enumerate(templates):
        for w in t.prefix:
            out.setdefault(w, []).append(k)
    return out


def qualifying_blocks(places: dict[bytes, list[int]], template: Template) -> list[tuple[int, int, float]]:
    """(first word, behind the last, best share) of every stretch of text made of blocks that reach the threshold.

    ``places`` has where each template word stands, for all templates' words. Blocks that overlap are one stretch.
    """
    if sum(1 for w in template.words if w in places) < template.needed:
        return []
    anchors = sorted(p for w in template.prefix for p in places.get(w, ()))
    if not anchors:
        return []
    hits = sorted((p, w) for w in template.words for p in places.get(w, ()))
    out: list[list] = []
    held: Counter[bytes] = Counter()
    low = near = 0
    for p, w in hits:
        # position: a block that ends here and holds a prefix word begins no later than the last one of these
        while near < len(anchors) and anchors[near] < p - template.span + 1:
            near += 1
        held[w] += 1
        while p - hits[low][0] >= template.span:
            gone = hits[low][1]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            low += 1
        if near == len(anchors) or anchors[near] > p or len(held) < template.needed:
            continue
        start = hits[low][0]
        if out and start < out[-1][1]:
            out[-1][1], out[-1][2] = p + 1, max(out[-1][2], len(held))
        else:
            out.append([start, p + 1, len(held)])
    return [(start, end, most / len(template.words)) for start, end, most in out]


def phrase_places(words: list[bytes], phrases: tuple[tuple[str, str], ...]) -> list[tuple[int, str]]:
    """(index of the first word, label) of every place of a phrase."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases:
        sought = b" " + phrase.encode() + b" "
        at, seen, index = joined.find(sought), 0, 0
        while at >= 0:
            index += joined.count(b" ", seen, at)
            out.append((index, label))
            seen, at = at, joined.find(sought, at + 1)
    return sorted(out)


def word_counts(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How many documents hold each word of the vocabulary, by built-in functions."""
    words = F.split(F.lower(F.col(text_col).cast("string")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    known = F.array(*[F.lit(w.decode()) for w in sorted(vocabulary)])
    found = docs.select(F.explode(F.array_intersect(words, known)).alias("word")).groupBy("word").count()
    return {r[0].encode(): r[1] for r in found.collect()}


def scan_licenses(
    docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES,
    containment: float = CONTAINMENT, spread: float = SPREAD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    Words are counted from 0; score is 1 where a phrase stands, else the best template's share; blocks are
    (label, first word, behind the last word, share), by place.
    """
    vocabulary = frozenset(w for text, _ in templates for w in words_of(text))
    if sum(len(words_of(text)) for text, _ in templates) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words")
    known = prepare(templates, word_counts(docs, vocabulary, text_col), containment, spread)
    index = prefix_index(known)

    def scan(text: str | None) -> tuple:
        words = words_of(text)
        found = phrase_places(words, phrases)
        present = vocabulary.intersection(words)
        blocks = []
        if present:
            places: dict[bytes, list[int]] = {}
            met = {k for w in present if w in index for k in index[w]}
            due = [t for t in (known[k] for k in sorted(met)) if sum(1 for w in t.words if w in present) >= t.needed]
            if due:
                for p, w in enumerate(words):
                    if w in present:
                        places.setdefault(w, []).append(p)
            blocks = sorted((start, end, t.label, share) for t in due for start, end, share in qualifying_blocks(places, t))
        base = {label for _, label in found}
        return (
            len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None,
            ",".join(sorted(base)), ",".join(sorted(base | {b[2] for b in blocks})), 1.0 if base else max((b[3] for b in blocks), default=0.0),
            [{"label": label, "start": start, "end": end, "share": share} for start, end, label, share in blocks],
        )

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    kinds.append(pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(
        of, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "blocks array<struct<label: string, start: long, end: long, share: double>>",
    )
