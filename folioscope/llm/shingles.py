"""Near-dedup by the similarity of whole texts: Jaccard of their sets of 5-word shingles, at least 0.8.

SimHash with deletion variants (``simhash.py``) proposes first: a class is compared with the first one of
those whose fingerprints its own reaches by 4 or fewer differing bits. At 0.8 about ten bits differ, so
MinHash proposes what is still apart: ``BANDS`` keys of ``ROWS`` minima each; a pair at exactly 0.8 shares a
key with a chance of 0.9996. The shingles themselves decide on both, so no pair below 0.8 links.
Texts of the same words, case aside, are one class from the start.

Work on pairs is kept linear in a group of near copies: each class is compared with the most central
class of its keys (the hub), and only what is left apart after that with the rest of the key, if enough
of its shingles are in another class at all, and in one of the other's size. Pairs whose sizes rule out 0.8, or whose sketches (one bit
of each minimum) differ far more than at 0.8, are left out before any words are fetched; these are kept
compressed, a copy a class, and the index holds numbers only.

Cases: null or empty text, or text without a word, is one class; fewer than five words make
one shingle; rows without an id stay; of rows that repeat an id one stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import connected_components
from folioscope.llm.packing import slices
from folioscope.llm.simhash import _LOWER, fingerprint_components, majority
from folioscope.llm.util import Stash, quoted

WIDTH = 5
#: At least this many hundredths of all shingles of a pair are in both.
PERCENT = 80
BANDS, ROWS = 20, 5
SEED = 17
#: Bits of two sketches that differ at most: of a pair at 0.8 ten of a hundred do, three more or less, and four times that are let through.
MOST_BITS = 22
#: Pairs of one hub that meet in one place, and bytes of text that a task works on at once.
BLOCK, SLICE_BYTES = 256, 4 << 20
#: Numbers of 64 bits that map a class's shingles where classes are still apart: with a bit or more a shingle they tell pairs apart well.
MAP_LONGS = 16
MAPS = [f"m{k}" for k in range(MAP_LONGS)]

_DRAWN = np.random.default_rng(SEED).integers(0, 2**63, size=(3, BANDS * ROWS), dtype=np.uint64)
_MIX, _FLIP, _FOLD = _DRAWN[0] << np.uint64(1) | np.uint64(1), _DRAWN[1] << np.uint64(1), _DRAWN[2] << np.uint64(1) | np.uint64(1)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def shingles(words: list[bytes]) -> set[bytes]:
    joined = b" ".join(words)
    if len(words) <= WIDTH:
        return {joined}
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-WIDTH].tolist()]
    return {joined[a:b] for a, b in zip(starts, (ends[WIDTH - 1 :] - 1).tolist())}


def keys(found: set[bytes]) -> tuple[np.ndarray, int, int, int]:
    """One key a band, a sketch (one bit of each minimum, in two numbers), and the fingerprint of the shingles."""
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))
    low = np.array([((h ^ b) * a).min() for a, b in zip(_MIX, _FLIP)], np.uint64)
    mixed = (low ^ low >> np.uint64(29)) * _FOLD
    bits = np.packbits((mixed >> np.uint64(63)).astype(np.uint8))
    first, second = np.frombuffer(bits.tobytes().ljust(16, b"\0"), np.int64).tolist()
    return mixed.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64), first, second, majority(h)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, hash, n, s, t, fp, keys, packed): also a hash of the text's words, how many shingles it has, its sketch, its fingerprint,
    its bands' keys, and the words themselves, compressed."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for part in (p for batch in batches for p in slices(batch, 1, SLICE_BYTES)):
            rows = []
            for text in part.column(1):
                words = _words(text.as_py())
                found, joined = shingles(words), b" ".join(words)
                band, s, t, fp = keys(found)
                rows.append((xxhash.xxh3_128_digest(joined, SEED), len(found), s, t, fp, band, pack.compress(joined)))
            kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], ["doc_id", "hash", "n", "s", "t", "fp", "keys", "packed"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.where("doc_id is not null").mapInArrow(of, "doc_id long, hash binary, n int, s long, t long, fp long, keys array<long>, packed binary")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs whose texts are similar enough."""
    known: tuple[int | None, set[bytes]] = (None, set())
    unpack = zstandard.ZstdDecompressor()
    of = lambda packed: shingles(unpack.decompress(packed.as_py()).split())
    for batch in batches:
        a, b, packed_a, packed_b = (batch.column(c) for c in ("a", "b", "packed_a", "packed_b"))
        good = []
        for k in range(len(batch)):
            if known[0] != (name := b[k].as_py()):
                known = (name, of(packed_b[k]))
            mine = of(packed_a[k])
            both = len(mine & known[1])
            good.append(100 * both >= PERCENT * (len(mine) + len(known[1]) - both))
        mask = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])


def _allowed(a: str, b: str) -> Column:
    """Whether two classes, structs with n, s and t, can be similar enough by their sizes and sketches."""
    x, y = F.col(a), F.col(b)
    bits = F.bit_count(x["s"].bitwiseXOR(y["s"])) + F.bit_count(x["t"].bitwiseXOR(y["t"]))
    return (100 * F.least(x["n"], y["n"]) >= PERCENT * F.greatest(x["n"], y["n"])) & (bits <= MOST_BITS)


def _linked(pairs: DataFrame, classes: DataFrame, stash: Stash) -> DataFrame:
    """Those of ``pairs`` (a, b; many may share b) that the shingles confirm. Words are fetched only for pairs that sizes and sketches allow."""
    heads = lambda name: classes.select(F.col("cid").alias(name), F.struct("n", "s", "t").alias(f"of_{name}"))
    able = pairs.distinct().join(heads("a"), "a").join(heads("b"), "b").where(_allowed("of_a", "of_b")).select("a", "b")
    able = stash.put(able, "pairs")
    packed = classes.select("cid", "packed")
    blocks = stash.put(able.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    left = able.join(packed.select(F.col("cid").alias("a"), F.col("packed").alias("packed_a")), "a").join(blocks, "b")
    left = left.select("a", "b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), "packed_a")
    right = blocks.join(packed.select(F.col("cid").alias("b"), F.col("packed").alias("packed_b")), "b")
    right = right.select("b", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "packed_b")
    met = left.join(right, ["b", "block"]).select("a", "b", "packed_a", "packed_b")
    return stash.put(met.mapInArrow(_alike, "a long, b long"), "confirmed")


def _placed(classes: DataFrame, components: DataFrame, stash: Stash) -> DataFrame:
    """(key, c, own, main): classes under keys that several components share, with their own component and the key's first one."""
    own = components.select(F.col("node").alias("cid"), F.col("component").alias("own"))
    owned = classes.select("cid", "n", "s", "t", "keys").join(own, "cid", "left")
    index = owned.select(F.struct("cid", "n", "s", "t").alias("c"), F.coalesce("own", "cid").alias("own"), F.explode("keys").alias("key"))
    spans = index.groupBy("key").agg(F.min("own").alias("main"), F.max("own").alias("last")).where("main < last").select("key", "main")
    return stash.put(index.join(spans, "key"), "placed")


def _shared_enough(placed: DataFrame, classes: DataFrame, stash: Stash) -> DataFrame:
    """(cid, lone) of the placed classes that can be similar enough to another one; lone: shingles that no other placed class has.

    Such a class has at least ``PERCENT`` hundredths of its own shingles in common with the other, so not more than the rest
    may be in no other class that is placed. Shingles are counted as hashes; where two meet, a class is left in.
    """
    ids = stash.put(placed.select("c.cid", "c.n").distinct(), "ids")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(len(batch)):
                found = shingles(unpack.decompress(batch.column(1)[k].as_py()).split())
                hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in found), np.uint64, len(found)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), batch.column(0)[k].as_py())), pa.array(hashes)], ["cid", "h"])

    grams = ids.join(classes.select("cid", "packed"), "cid").select("cid", "packed").mapInArrow(of, "cid long, h long")
    lone = grams.groupBy("h").agg(F.count("*").alias("held"), F.min("cid").alias("cid")).where("held = 1").groupBy("cid").agg(F.count("*").alias("lone"))
    counted = ids.join(lone, "cid", "left").select("cid", "n", F.coalesce("lone", F.lit(0)).alias("lone"))
    return stash.put(counted.where(100 * (F.col("n") - F.col("lone")) >= PERCENT * F.col("n")).select("cid", "lone"), "able")


def _mapped(able: DataFrame, classes: DataFrame, stash: Stash) -> DataFrame:
    """(cid, lone, map): also ``MAP_LONGS`` numbers with one bit set for each shingle, by its hash."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            maps = np.zeros((len(batch), MAP_LONGS * 64), np.uint8)
            for k in range(len(batch)):
                found = shingles(unpack.decompress(batch.column(2)[k].as_py()).split())
                maps[k, [xxhash.xxh64_intdigest(x, SEED) % (MAP_LONGS * 64) for x in found]] = 1
            longs = np.packbits(maps, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(longs[:, k]) for k in range(MAP_LONGS))], ["cid", "lone", *MAPS])

    known = able.join(classes.select("cid", "packed"), "cid").select("cid", "lone", "packed")
    return stash.put(known.mapInArrow(of, f"cid long, lone long, {', '.join(f'{m} long' for m in MAPS)}"), "maps")


def _common_enough(a: str, b: str) -> Column:
    """Whether two classes, structs with n, lone and maps, have enough shingles that they can have in common.

    Neither lone shingles nor those behind bits that the other's map lacks are; so no pair that is alike enough is left out.
    """
    x, y = F.col(a), F.col(b)
    apart = lambda u, v: reduce(add, (F.bit_count(u[m].bitwiseAND(F.bitwise_not(v[m]))) for m in MAPS))
    most = F.least(x["n"] - x["lone"], y["n"] - y["lone"], x["n"] - apart(x, y), y["n"] - apart(y, x))
    return 100 * most >= PERCENT * (x["n"] + y["n"] - most)


def class_components(classes: DataFrame, stash: Stash) -> DataFrame:
    """(node, component) of the classes that have a link to another; ``component`` is one of its classes.

    First classes whose fingerprints are linked are compared with the first of these. Then every class is compared with the most
    central one under each of its keys (the one that shares its keys with most others: of texts that were changed here and there
    the one without changes); then all classes under a key that are still in different components, as far as
    ``_shared_enough`` and ``_common_enough`` leave them.
    """
    pair = lambda a, b: (F.col(a).alias("a"), F.col(b).alias("b"))
    near = fingerprint_components(stash.put(classes.select("fp").distinct(), "prints")).withColumnRenamed("component", "reached")
    grouped = classes.select("cid", "fp").join(near, "fp", "left").select("cid", F.coalesce("reached", "fp").alias("group"))
    ahead = grouped.groupBy("group").agg(F.min("cid").alias("first"), F.max("cid").alias("last")).where("first < last").select("group", "first")
    links = _linked(grouped.join(ahead, "group").where("cid <> first").select(*pair("cid", "first")), classes, stash)
    early = stash.put(connected_components(links), "early").select(F.col("node").alias("cid"), F.col("component").alias("own"))

    index = classes.select("cid", "keys").join(early, "cid", "left").select("cid", F.coalesce("own", "cid").alias("own"), F.explode("keys").alias("key"))
    sizes = index.groupBy("key").agg(F.count("*").alias("rows"), F.min("own").alias("first"), F.max("own").alias("last")).where("first < last").select("key", "rows")
    shared = stash.put(index.join(stash.put(sizes, "sizes"), "key"), "shared")
    central = shared.groupBy("cid").agg(F.sum("rows").alias("met"))
    hubs = shared.join(central, "cid").groupBy("key").agg(F.max_by(F.struct("cid", "own"), F.struct("met", -F.col("cid"))).alias("hub"))
    star = shared.join(hubs, "key").where(F.col("own") != F.col("hub.own")).select(*pair("cid", "hub.cid"))
    links = links.unionByName(_linked(star, classes, stash))

    placed = _placed(classes, stash.put(connected_components(links), "first"), stash)
    alive = _mapped(_shared_enough(placed, classes, stash), classes, stash)
    held = F.struct("c.cid", "c.n", "c.s", "c.t", "lone", *MAPS).alias("c")
    placed = stash.put(placed.join(alive, F.col("c.cid") == F.col("cid")).select("key", held, "own", "main"), "alive")
    strays = placed.where("own <> main").select("key", F.col("c").alias("a"), F.col("own").alias("own_a"))
    rest = placed.select(F.col("key").alias("key_b"), F.col("c").alias("b"), F.col("own").alias("own_b"), "main")
    pairs = strays.join(
        rest,
        (F.col("key") == F.col("key_b"))
        & (F.col("own_a") != F.col("own_b"))
        & ((F.col("own_b") == F.col("main")) | (F.col("own_a") < F.col("own_b")))
        & _allowed("a", "b")
        & _common_enough("a", "b"),
    )
    return connected_components(links.unionByName(_linked(pairs.select(*pair("a.cid", "b.cid")), classes, stash)))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row with an id; component_id is the smallest doc_id reachable by links."""
    stash = Stash(docs.sparkSession, "shingles")
    seen = stash.put(_classes(docs, id_col, text_col), "seen")
    classes = seen.groupBy("hash").agg(F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in ("n", "s", "t", "fp", "keys", "packed")])
    classes = stash.put(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    linked = stash.put(class_components(classes, stash).withColumnRenamed("node", "cid"), "components")
    lows = linked.join(classes.select("cid", "low"), "cid").groupBy("component").agg(F.min("low").alias("reached"))
    reached = stash.put(linked.join(lows, "component").select("cid", "reached"), "reached")
    each = classes.select("hash", "cid", "low").join(reached, "cid", "left").select("hash", F.coalesce("reached", "low").alias("component_id"))
    return seen.select("doc_id", "hash").join(each, "hash").select("doc_id", "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of every group, with the columns it came with; rows without an id stay."""
    found = similar_components(docs, id_col, text_col).groupBy(F.col("doc_id").alias(id_col))
    found = found.agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"), (F.count("*") > 1).alias("repeated")).where("kept")
    # whole texts are shuffled only where an id repeats
    own = [F.col(f"d.{quoted(c)}") for c in docs.columns]
    named = docs.where(F.col(id_col).isNotNull()).alias("d").join(found.alias("f"), F.col(f"d.{quoted(id_col)}") == F.col(f"f.{quoted(id_col)}"))
    once, again = (named.where(which).select(*own) for which in (~F.col("f.repeated"), F.col("f.repeated")))
    return once.unionByName(again.dropDuplicates([id_col])).unionByName(docs.where(F.col(id_col).isNull()))
