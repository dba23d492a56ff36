"""SimHash near-dedup with deletion-variant signatures.

Fingerprints: XXH64 (seed 42) of 4-word shingles, one bit each where over half the
shingles have it. Two fingerprints link if at most ``MAX_BITS`` of 64 bits differ. Cut into
three segments, one of them then differs by one bit at most, so both have that segment itself or a
variant of it with the same bit wiped: 3 segments and 64 variants per distinct fingerprint are the index
keys. Equal segments meet under the segment alone: under a variant only rows that differ in the wiped bit
are compared, and a variant whose rows agree in it is left out.

Chance candidates grow with the square of the distinct fingerprints over two to the power of a key's
fixed bits, so keys are lengthened with them (``cutting_for``): cut into more segments, some choice of two or
three differs by one bit at most, and keys are the variants of every such choice. The links found are
the same whatever the cutting.

A key of two or three fingerprints, as chance makes most, is settled where it is counted: its smallest,
its largest and the exclusive or of all tell which they are. Under larger keys every fingerprint is first
compared with the key's smallest one (the hub); those links form components. Only rows of a key that lie
outside its hub's component are then compared with the rest of the key, and a pair is taken under the
first piece it shares alone. So a group that its hubs reach takes work in proportion; what no hub reaches
is compared pair by pair under the keys it shares. No key is gathered in one task: keys are met by joins,
which Spark splits where they are skewed, and partial aggregates.

Cases: null or empty text, or text without a word, has fingerprint zero and links like any
other; fewer than four words make one shingle; a null id gets a fingerprint and no
component; repeated ids are one document; an empty table gives an empty result; other
columns are ignored by ``simhash_components`` and kept by ``keep_one_per_group``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import connected_components
from folioscope.llm.util import Stash, quoted

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
BITS = 64
#: (segments, segments a key takes) to choose from: keys of 20, 24 and 30 fixed bits at least, in 64, 256 and 640 variants.
CUTTINGS = ((3, 1), (5, 2), (6, 3))
#: Fingerprints that share a key by chance, on average, before longer keys are taken.
CROWD = 4

_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_BITS = np.array([[v >> k & 1 for k in range(8)] for v in range(256)], dtype=np.int64)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint, signed as Spark's long."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined, count = b" ".join(words), max(1, len(words) - width + 1)
    if count == 1:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).view(np.int64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: count - 1])).tolist()
    hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of some 64-bit hashes have, signed."""
    octets, count = hashes.view(np.uint8).reshape(-1, 8), len(hashes)
    if count < 1000:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(of, "doc_id long, fp long")


def pieces(cutting: tuple[int, int]) -> list[int]:
    """The bits that each key is made of, as a mask: every choice of segments."""
    count, taken = cutting
    edges = [round(k * BITS / count) for k in range(count + 1)]
    masks = [((1 << high) - 1) & ~((1 << low) - 1) for low, high in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, taken)]


def serves(cutting: tuple[int, int], max_bits: int) -> bool:
    """Whether two fingerprints so near always have a choice of segments that differs by one bit at most.

    The r segments with the fewest of d differing bits hold the most of them when the bits are dealt out evenly.
    """
    count, taken = cutting
    return sum(sorted(max_bits // count + (k < max_bits % count) for k in range(count))[:taken]) <= 1


def cutting_for(distinct: int) -> tuple[int, int]:
    """The cutting with the fewest keys under which chance matches stay few among so many distinct fingerprints."""
    for cutting in CUTTINGS:
        if distinct <= CROWD << (min(bin(m).count("1") for m in pieces(cutting)) - 1):
            return cutting
    return CUTTINGS[-1]


def _runs(mask: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each run of ones."""
    out, low = [], None
    for bit in range(BITS + 1):
        if mask >> bit & 1 and low is None:
            low = bit
        elif not mask >> bit & 1 and low is not None:
            out.append((low, bit - low))
            low = None
    return out


def _packed(value: Column, mask: int) -> Column:
    """The bits under the mask side by side."""
    out, at = F.lit(0).cast("long"), 0
    for low, bits in _runs(mask):
        part = F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(part, at))
        at += bits
    return out


#: A key's lower bits hold its piece's bits (33 at most), the next ones the wiped bit, the upper ones the piece's number.
KEY_BITS = 40
WIPED_BITS = 7
#: In place of the wiped bit, where a key is the piece as it is.
WHOLE = BITS


def _variants(fp: str, masks: list[int]) -> Column:
    """Keys: (piece, wiped bit or none) above the piece's other bits."""
    keys = []
    for number, mask in enumerate(masks):
        piece, kept = _packed(F.col(fp), mask), (1 << bin(mask).count("1")) - 1
        places = [bit for bit in range(BITS) if mask >> bit & 1]
        for wiped, others in [(WHOLE, kept), *((bit, kept & ~(1 << k)) for k, bit in enumerate(places))]:
            top = (number << WIPED_BITS | wiped) << KEY_BITS
            keys.append(F.lit(top).cast("long").bitwiseOR(piece.bitwiseAND(F.lit(others).cast("long"))))
    return F.array(*keys)


def _wiped(key: str) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS).bitwiseAND(F.lit((1 << WIPED_BITS) - 1)).cast("int")


def _at(value: str, bit: Column) -> Column:
    return F.call_function("shiftright", F.col(value), bit).bitwiseAND(F.lit(1)).cast("int")


def _differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _first_shared_piece(a: str, b: str, masks: list[int]) -> Column:
    """The number of the first piece in which a pair within the bits of a cutting differs by one bit at most."""
    x = F.col(a).bitwiseXOR(F.col(b))
    out: Column = F.lit(-1)
    for number, mask in reversed(list(enumerate(masks))):
        under = x.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> BITS - 1 else mask).cast("long"))
        out = F.when(F.bit_count(under) <= 1, F.lit(number)).otherwise(out)
    return out


def fingerprint_components(fps: DataFrame, max_bits: int = MAX_BITS, cutting: tuple[int, int] | None = None) -> DataFrame:
    """(fp, component) of the distinct fingerprints that have a link to another; ``component`` is the smallest fp.

    Without ``cutting`` it follows from their number.
    """
    cutting = cutting or cutting_for(fps.count())
    if max_bits < 0 or not serves(cutting, max_bits):
        raise ValueError(f"{cutting[0]} segments, {cutting[1]} a key, don't serve {max_bits} differing bits")
    masks = pieces(cutting)
    stash = Stash(fps.sparkSession, "simhash")
    # a fingerprint becomes many rows: dealt out first, so that no task makes most of them
    dealt = fps.repartition("fp")
    index = dealt.select("fp", F.explode(_variants("fp", masks)).alias("key"))
    met = index.groupBy("key").agg(
        F.count("*").alias("n"), F.min("fp").alias("hub"), F.max("fp").alias("last"), F.bit_xor("fp").alias("all"), F.bit_or("fp").alias("some"), F.bit_and("fp").alias("each")
    )
    # rows that agree in the wiped bit have an equal piece, and meet under that
    parted = (_wiped("key") == WHOLE) | (_at("some", _wiped("key")) != _at("each", _wiped("key")))
    met = met.where("hub < last").where(parted).withColumn("mid", F.col("all").bitwiseXOR(F.col("hub")).bitwiseXOR(F.col("last")))
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    several = F.when(F.col("n") == 2, F.array(pair("hub", "last"))).when(F.col("n") == 3, F.array(pair("hub", "last"), pair("hub", "mid"), pair("mid", "last")))
    links = F.filter(several, lambda e: F.bit_count(e["a"].bitwiseXOR(e["b"])) <= max_bits)
    # of keys with two or three fingerprints only the links are left, and nothing where there is none
    met = stash.put(met.select("key", "n", "hub", links.alias("links")).where("n > 3 or size(links) > 0"), "met")
    # written apart, so that Spark sees how few they are
    heads = stash.put(met.where("n > 3").select("key", "hub"), "heads")
    crowded = stash.put(index.join(heads, "key"), "crowded")
    star = crowded.where((F.col("fp") != F.col("hub")) & (_differing("fp", "hub") <= max_bits)).select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    first = stash.put(connected_components(star.unionByName(met.where("n < 4").select(F.explode("links").alias("l")).select("l.a", "l.b")).distinct()), "first")

    # a key's main component is its hub's
    of_fp = first.select(F.col("node").alias("fp"), F.col("component").alias("own"))
    of_hub = first.select(F.col("node").alias("hub"), F.col("component").alias("main"))
    placed = crowded.join(of_fp, "fp", "left").join(of_hub, "hub", "left")
    placed = stash.put(placed.select("key", "fp", F.coalesce("own", "fp").alias("own"), F.coalesce("main", "hub").alias("main")), "placed")
    wiped = _wiped("key")
    side = F.when(wiped == WHOLE, 0).otherwise(_at("fp", wiped))
    other = F.when(wiped == WHOLE, 0).otherwise(1 - _at("fp", wiped))
    strays = placed.where("own <> main").select("key", other.alias("side"), F.col("fp").alias("fp_a"), F.col("own").alias("own_a"))
    rest = placed.select(F.col("key").alias("key_b"), side.alias("side_b"), F.col("fp").alias("fp_b"), F.col("own").alias("own_b"), "main")
    pairs = strays.join(
        rest,
        (F.col("key") == F.col("key_b"))
        & (F.col("side") == F.col("side_b"))
        & (F.col("own_a") != F.col("own_b"))
        & ((F.col("own_b") == F.col("main")) | (F.col("own_a") < F.col("own_b")))
        & (_differing("fp_a", "fp_b") <= max_bits)
        & (F.shiftrightunsigned("key", KEY_BITS + WIPED_BITS) == _first_shared_piece("fp_a", "fp_b", masks)),
    )
    second = stash.put(connected_components(pairs.select("own_a", "own_b")), "second")
    stash.drop(placed)

    singles = second.join(first.select("node"), "node", "left_anti")
    own = first.unionByName(singles.select("node", F.col("node").alias("component")))
    later = second.select(F.col("node").alias("component"), F.col("component").alias("last"))
    return own.join(later, "component", "left").select(F.col("node").alias("fp"), F.coalesce("last", "component").alias("component"))


def simhash_components(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable by links."""
    stash = Stash(docs.sparkSession, "simhash")
    rows = stash.put(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = stash.put(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    linked = stash.put(fingerprint_components(fps.select("fp"), max_bits), "linked")
    lows = linked.join(fps, "fp").groupBy("component").agg(F.min("low").alias("low"))
    reached = stash.put(linked.join(lows, "component").select("fp", F.col("low").alias("reached")), "reached")
    each = fps.join(reached, "fp", "left").select("fp", F.coalesce("reached", "low").alias("component_id"))
    return rows.join(each, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one_per_group(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of every group, with the columns it came with; rows without an id stay.

    Of rows that repeat an id, one stays.
    """
    found = simhash_components(docs, max_bits, id_col, text_col)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return named.select(*[F.col(quoted(c)) for c in docs.columns]).unionByName(docs.where(F.col(id_col).isNull()))
