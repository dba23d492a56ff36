"""Embedding near-dedup by sorted projection passes.

In each pass the vectors of a label are ordered lexicographically by concatenated random
hashes (signs of projections, then a projection as it is) and each is compared with the
next ``window`` ones; what later passes find is joined to what earlier ones did, by
connected components. A label's mean is taken away before hashing only, so that vectors which
lie close together are told apart by what differs. How many passes a label gets is measured on all
its vectors: each has a made-up partner at the threshold, which goes along in the passes until a window
shows it a vector it would link with, and a label is done when ``RECALL`` of its partners have met one.
Labels that ``MOST_PASSES`` passes don't bring there are compared whole, in blocks. Exact copies
are one class from the start, so a very common vector costs no more than any other.

Links are then counted exactly within each component, so a bounded window loses none in a
group of near copies. Members within half the linking angle of the component's mean are all
linked to each other by the triangle inequality of angles, and are counted, not compared;
the rest are compared with every member, in blocks.

Cases: a vector that is null, empty or zero, or has a null or non-finite component, and one
without a label, links with nothing and is its own component; vectors of different lengths
don't link; a null id is in no component (null) and not kept; rows that repeat an id count
as vectors of their own; an empty table gives an empty result; other columns are ignored.

Windows end at the edges of Spark's partitions; other passes cut elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import connected_components
from folioscope.llm.util import Stash

THRESHOLD = 0.93
#: The fewest passes, and those after which a label is compared whole.
PASSES, MOST_PASSES = 8, 96
#: Share of lone pairs with a cosine of exactly ``THRESHOLD`` that all passes together should find, in each label.
RECALL = 0.96
#: A partner's single precision.
SLACK = 1e-6
#: For ``passes_for``, which tells beforehand how many passes some vectors will need: pairs and passes tried.
PROBES, TRIALS = 400, 6
#: The chance of a pass falls with this power of the rows, where the sample is too small to tell; so simulated for random vectors.
HIT_POWER = 0.19
#: Copies of the vectors, partners among them, in the passes that share one shuffle: they are on disk together.
COPIES_AT_ONCE = 4.5
#: Windows to choose from, and the passes up to which the narrower one is kept.
WINDOWS, MANY = (32, 128), 20
HASH_BITS = 32
SEED = 7
#: Rows of a component on either side of one comparison, at least and at most: blocks get larger with the root of the
#: component, so that a vector's copies do too, and not with the component.
BLOCK, MOST_BLOCK = 256, 8192
#: Rows on either side of one comparison where a label is compared whole.
WHOLE_BLOCK = 2048


def hit_rate(sample: np.ndarray, threshold: float, seed: int = SEED) -> float:
    """How often one pass puts a vector and one at ``threshold`` to it next to each other among the sample's vectors.

    ``sample`` are unit vectors of one label; partners are made in random directions. A sample of a ``window``-th of the
    label's rows so tells how often a partner is within the window.
    """
    rng = np.random.default_rng(seed)
    x = sample[rng.permutation(len(sample))]
    mine = x[:PROBES]
    side = rng.normal(size=mine.shape)
    side -= np.einsum("ij,ij->i", side, mine)[:, None] * mine
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    theirs = threshold * mine + math.sqrt(1 - threshold**2) * side
    mean, hits = x.mean(axis=0), 0
    for trial in range(TRIALS):
        planes = _planes(-1 - trial, x.shape[1])
        ends = [_place(v - mean, planes) for v in (x, mine, theirs)]
        key, tie = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
        order = np.lexsort((tie, key))
        # of vectors equal in place the sample's come first or last alike; what counts are the sample's rows strictly between
        upto = np.cumsum(order < len(x))
        at = np.empty(len(order), np.int64)
        at[order] = upto
        low, high = np.sort(np.stack([at[len(x) : len(x) + len(mine)], at[len(x) + len(mine) :]]), axis=0)
        hits += int((high - low <= 1).sum())
    return hits / (TRIALS * len(mine))


def passes_for(samples: list[tuple[int, np.ndarray]], threshold: float = THRESHOLD) -> tuple[int, int]:
    """(passes, window) that find ``RECALL`` of the lone pairs at ``threshold``, for all of some labels: (rows, sample).

    A forecast; ``near_duplicates`` measures on all rows instead. The narrower window is taken if few passes do with it.
    Samples are cut to a ``window``-th of the rows; smaller ones are carried on by the rate's fall with the rows.
    """
    need = {}
    for window in WINDOWS:
        most = PASSES
        for rows, sample in samples:
            size = max(2, -(-rows // window))
            if rows > window and len(sample) > 1:
                found = min(size, len(sample))
                hit = max(hit_rate(sample[:found], threshold), 0.5 / (TRIALS * PROBES)) * (size / found) ** -HIT_POWER
                most = max(most, 1 if hit >= 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - hit)))
        need[window] = most
        if most <= MANY:
            break
    window = min(need, key=lambda w: need[w])
    return need[window], window


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index in each index's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, root):
            return root
        root = new


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one length, scaled to length 1, in double precision."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(lists), -1)
    # a power of two first: no square overflows or vanishes
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    x = np.ldexp(x, -exponent)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _planes(number: int, size: int) -> np.ndarray:
    """The random directions of a pass; trials have numbers below 0."""
    return np.random.default_rng([SEED, number % (1 << 32), size]).normal(size=(size, HASH_BITS + 1))


def _place(x: np.ndarray, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash key and projection of each vector, by which a pass orders them."""
    seen = x @ planes
    return (seen[:, :HASH_BITS] > 0) @ (1 << np.arange(HASH_BITS, dtype=np.int64)[::-1]), seen[:, HASH_BITS]


def _means(classes: DataFrame, stash: Stash) -> DataFrame:
    """(label, size, rows, mean) of the distinct unit vectors of each label and length; tasks add up what they see."""
    label = classes.schema["label"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                x, coded = _matrix(part.column("embedding")), part.column("label").dictionary_encode()
                at = coded.indices.to_numpy()
                sums = np.zeros((len(coded.dictionary), size))
                np.add.at(sums, at, x)
                n = np.bincount(at, minlength=len(sums))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.full(len(n), size, np.int32)), pa.array(n.astype(np.int64)), pa.array(list(sums), pa.list_(pa.float64()))], ["label", "size", "n", "sums"])

    sums = stash.put(classes.select("label", "size", "embedding").mapInArrow(of, f"label {label}, size int, n long, sums array<double>"), "sums")
    keys = ["label", "size"]
    rows = sums.groupBy(*keys).agg(F.sum("n").alias("rows"))
    added = sums.select(*keys, F.posexplode("sums").alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("x"))
    listed = added.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("all"))  # as many as the vector is long
    means = listed.join(rows, keys).select(*keys, "rows", F.transform("all", lambda e: e["x"] / F.col("rows")).alias("mean"))
    return stash.put(means, "means")


def _partners(x: np.ndarray, cid: np.ndarray, threshold: float) -> np.ndarray:
    """For each unit vector another at the threshold to it, in a direction that follows from its class's number."""
    with np.errstate(over="ignore"):
        z = cid.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, x.shape[1] + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    side = np.where(z >> np.uint64(63), 1.0, -1.0)
    side -= np.einsum("ij,ij->i", side, x)[:, None] * x
    length = np.sqrt(np.einsum("ij,ij->i", side, side))[:, None]
    # where there is no other direction the vector is its own partner
    return np.where(length > 1e-9, threshold * x + math.sqrt(1 - threshold**2) * side / np.maximum(length, 1e-9), x)


def _keyed(classes: DataFrame, passes: range, threshold: float) -> DataFrame:
    """Each class once for each pass, with the pass's hash key and projection of what sets it apart from its label's mean.

    Where ``probed`` is set its partner comes along, in ``partner`` instead of ``embedding``.
    """
    kind = classes.schema["embedding"].dataType

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                x, mean = _matrix(part.column("embedding")), part.column("mean").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                at = np.flatnonzero(part.column("probed").to_numpy(zero_copy_only=False))
                probed, partner = part.take(pa.array(at)), _partners(x[at], part.column("cid").to_numpy()[at], threshold)
                vectors = part.column("embedding")
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * size, pa.int32()), pa.array(partner.ravel().astype(np.float32)))
                for p in passes:
                    if (p, size) not in planes:
                        planes[p, size] = _planes(p, size)
                    for rows, v, m, first, second in ((part, x, mean, vectors, pa.nulls(len(x), listed.type)), (probed, partner, mean[at], pa.nulls(len(at), vectors.type), listed)):
                        key, tie = _place(v - m, planes[p, size])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(v), p, np.int32)), rows.column("label"), rows.column("size"), pa.array(key), pa.array(tie), rows.column("cid"), first, second],
                            ["pass", "label", "size", "key", "tie", "cid", "embedding", "partner"],
                        )

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "size", "cid", "embedding", "mean", "probed").mapInArrow(
        of, f"pass int, label {label}, size int, key long, tie double, cid long, embedding {kind.simpleString()}, partner array<float>"
    )


def _forest(cid_a: np.ndarray, cid_b: np.ndarray) -> pa.RecordBatch:
    """(a, b): each class that some pair holds, with its group's first class there."""
    nodes, both = np.unique(np.concatenate([cid_a, cid_b]), return_inverse=True)
    root = _roots(len(nodes), both[: len(cid_a)], both[len(cid_a) :])
    mine = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[mine], pa.int64()), pa.array(nodes[root[mine]], pa.int64())], ["a", "b"])


def _window_links(threshold: float, window: int):
    """(a, b): in one sorted partition, each class that links in a window, with its group's first class there.

    b is null for classes whose partner is met by a vector that it would link with.
    """

    def met(partners: np.ndarray, before: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Which of some partners link with one of the ``window`` vectors before and after them."""
        found = np.zeros(len(partners), bool)
        for k in range(-window, window):
            at = np.flatnonzero(~found & (before + k >= 0) & (before + k < len(x)))
            found[at] = np.einsum("ij,ij->i", partners[at], x[before[at] + k]) >= threshold - SLACK
        return found

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if tail is None else pa.concat_tables([tail, rows])
            rows = rows.combine_chunks()
            given = rows.column("partner").is_null().to_numpy()
            # with the vectors that a window reaches back to go the partners that lie among them
            last = np.flatnonzero(given)[-window:]
            tail = rows.slice(int(last[0]) if len(last) == window else 0)
            group = pd.MultiIndex.from_arrays([rows.column(c).to_pandas() for c in ("pass", "label", "size")])
            group = pd.factorize(group)[0]
            cid = rows.column("cid").to_numpy()
            ends_a, ends_b, found = [], [], []
            for start, stop in _runs(group):
                part, real = rows.slice(start, stop - start), given[start:stop]
                here, probes = start + np.flatnonzero(real), start + np.flatnonzero(~real)
                if not len(here):
                    continue
                x = _matrix(part.column("embedding").filter(pa.array(real)).combine_chunks())
                for k in range(1, min(window, len(here) - 1) + 1):
                    at = np.flatnonzero(np.einsum("ij,ij->i", x[:-k], x[k:]) >= threshold)
                    ends_a.append(cid[here[at]])
                    ends_b.append(cid[here[at + k]])
                if len(probes):
                    partners = _matrix(part.column("partner").filter(pa.array(~real)).combine_chunks())
                    found.append(cid[probes[met(partners, np.searchsorted(here, probes), x)]])
            if ends_a:
                yield _forest(np.concatenate(ends_a), np.concatenate(ends_b))
            if found:
                hits = np.unique(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array(hits), pa.nulls(len(hits), pa.int64())], ["a", "b"])

    return of


def _runs(group: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(group)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(group)])) if len(group) else []


def _unit(v: Column) -> Column:
    """The vector in double precision, scaled by its largest component and then to length 1."""
    wide = F.transform(v, lambda x: x.cast("double") / F.array_max(F.transform(v, lambda y: F.abs(y.cast("double")))))
    norm = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x))
    return F.get(F.transform(F.array(wide), lambda w: F.transform(w, lambda x: x / norm(w))), F.lit(0))


def _whole_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) from comparing all classes of a label with each other, in blocks."""
    blocks = F.ceil(F.col("rows") / WHOLE_BLOCK).cast("int")
    placed = classes.select("label", "size", "cid", "embedding", blocks.alias("blocks"), F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("block"))
    left = placed.select("label", "size", F.col("block").alias("i"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("j"), "cid", "embedding")
    right = placed.select("label", "size", F.explode(F.expr("sequence(0, block)")).alias("i"), F.col("block").alias("j"), "cid", "embedding")
    right = right.toDF(*right.columns)  # columns of its own, as Spark needs here

    def compare(one: pa.Table, other: pa.Table) -> pa.Table:
        if not len(one) or not len(other):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        x, y = (_matrix(t.column("embedding").combine_chunks()) for t in (one, other))
        a, b = np.nonzero(x @ y.T >= threshold)
        return pa.Table.from_batches([_forest(one.column("cid").to_numpy()[a], other.column("cid").to_numpy()[b])])

    keys = ["label", "size", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "a long, b long")


def _links(classes: DataFrame, stash: Stash, threshold: float, passes: int | None, window: int | None) -> Iterator[DataFrame]:
    """(a, b) of each group of passes: as many as asked for, or until each label has met ``RECALL`` of its partners.

    ``rows`` of a class are its label's; labels that are done go no further.
    """
    order = ["pass", "label", "size", "key", "tie", "cid"]
    kept, width = ["label", "size", "cid", "rows"], window or WINDOWS[0]
    several = classes.where("rows > 1")
    due, unmet, done, copies = several, None, 0, 1.0 if passes else 2.0
    while done < (passes or MOST_PASSES):
        if passes:
            probed = due.withColumn("probed", F.lit(False))
        elif unmet is None:
            probed = due.withColumn("probed", F.lit(True))
        else:
            probed = due.join(unmet.select("cid", F.lit(True).alias("probed")), "cid", "left").withColumn("probed", F.coalesce("probed", F.lit(False)))
        upto = min(passes or MOST_PASSES, done + int(COPIES_AT_ONCE / copies))
        ordered = _keyed(probed, range(done, upto), threshold).repartitionByRange(*order).sortWithinPartitions(*order)
        found = stash.put(ordered.mapInArrow(_window_links(threshold, width), "a long, b long"), "links")
        yield found.where("b is not null")
        done = upto
        if passes:
            continue
        hits = found.where("b is null").select(F.col("a").alias("cid"))
        unmet = stash.put((due if unmet is None else unmet).select(*kept).join(hits, "cid", "left_anti"), "unmet")
        if done < PASSES:
            copies = 1 + unmet.count() / max(1, due.count())
        else:
            behind = unmet.groupBy("label", "size", "rows").agg(F.count("*").alias("left")).where(F.col("left") > (1 - RECALL) * F.col("rows"))
            behind = stash.put(behind, "behind")
            worst = behind.agg(F.max(F.col("left") / F.col("rows"))).first()[0]
            if worst is None:
                return
            if window is None and (worst == 1 or done * math.log(1 - RECALL) / math.log(worst) > MANY):
                width = WINDOWS[-1]
            copies = 1 + worst
            due, unmet = (t.join(behind.select("label", "size"), ["label", "size"], "left_semi") for t in (several, unmet))
    if not passes:
        yield stash.put(_whole_links(due, threshold), "whole")


def _components(classes: DataFrame, stash: Stash, threshold: float, passes: int | None, window: int | None) -> DataFrame:
    return connected_components(reduce(DataFrame.unionByName, _links(classes, stash, threshold, passes, window)))


def _outside_links(members: DataFrame, threshold: float, stash: Stash) -> DataFrame:
    """(cid, links) from comparing the members outside their component's ball with every member, in blocks.

    A member outside counts all its links; one inside counts those with members outside.
    """
    rows, outside = F.count("*"), F.count_if(~F.col("inside"))
    block = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST_BLOCK), F.ceil(4 * F.sqrt(rows))))
    sizes = members.groupBy("component").agg(F.ceil(rows / block).cast("int").alias("blocks"), F.ceil(outside / block).cast("int").alias("chunks"))
    due = members.join(stash.put(sizes.where("chunks > 0"), "sizes"), "component")
    place = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    left = due.select("component", place("blocks").alias("block"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), "cid", "copies", "inside", "unit")
    right = due.where("not inside").select(
        "component", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), place("chunks").alias("chunk"), "cid", "copies", "unit"
    )
    right = right.toDF(*right.columns)  # columns of its own, as Spark needs here

    def compare(all_: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        if all_.empty or out.empty:
            return pd.DataFrame({"cid": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})
        linked = np.stack(out.unit) @ np.stack(all_.unit).T >= threshold
        linked &= out.cid.to_numpy()[:, None] != all_.cid.to_numpy()[None, :]
        mine = pd.DataFrame({"cid": out.cid, "links": linked @ all_.copies.to_numpy()})
        theirs = pd.DataFrame({"cid": all_.cid, "links": out.copies.to_numpy() @ linked})[all_.inside.to_numpy(dtype=bool)]
        return pd.concat([mine, theirs]).astype("int64")

    keys = ["component", "block", "chunk"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "cid long, links long")
    return pairs.groupBy("cid").agg(F.sum("links").alias("links"))


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, window: int | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest id reachable), kept (that id is its own).

    Without ``passes`` each label gets as many as its own vectors need; without ``window`` it follows from how these fare.
    """
    stash = Stash(vectors.sparkSession, "embeddings")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = rows.where("vec_id is not null and label is not null and embedding is not null").where(
        finite & F.exists("embedding", lambda x: x != 0)
    )
    classes = stash.put(
        fit.groupBy("label", "embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies")).withColumn("size", F.size("embedding")),
        "classes",
    )
    means = _means(classes, stash)
    centred = classes.join(means, ["label", "size"])
    placed = stash.put(_components(centred, stash, threshold, passes, window).withColumnRenamed("node", "cid"), "placed")

    members = stash.put(classes.join(placed, "cid").select("component", "cid", "copies", _unit(F.col("embedding")).alias("unit")), "members")
    sums = members.select("component", F.posexplode("unit").alias("at", "x")).groupBy("component", "at").agg(F.sum("x").alias("x"))
    # tables of one row a component are written, so that the joins with them can be split where a component is large
    means = stash.put(sums.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("mean")), "means")
    near = math.cos(math.acos(threshold) / 2) + 1e-6
    to_mean = F.aggregate(F.zip_with("unit", "mean", lambda x, m: x * m["x"]), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, m: s + m["x"] * m["x"]))
    balled = stash.put(
        members.join(means, "component").select("component", "cid", "copies", "unit", (to_mean >= near * length).alias("inside")), "balled"
    )
    outside = _outside_links(balled, threshold, stash)
    weight = stash.put(balled.where("inside").groupBy("component").agg(F.sum("copies").alias("weight")), "weight")
    counted = stash.put(
        balled.join(weight, "component", "left").join(outside, "cid", "left").select(
            "cid", "component",
            (F.col("copies") - 1 + F.when(F.col("inside"), F.col("weight") - F.col("copies")).otherwise(0) + F.coalesce("links", F.lit(0))).alias("links"),
        ),
        "counted",
    )
    of_class = classes.join(counted, "cid", "left").select(
        "label", "embedding", F.coalesce("links", F.col("copies") - 1).alias("links"), F.coalesce("component", "cid").alias("component")
    )
    known = fit.join(of_class, ["label", "embedding"]).select("vec_id", "links", "component")
    rest = rows.where("vec_id is null or label is null or embedding is null").unionByName(
        rows.where("vec_id is not null and label is not null and embedding is not null").where(~(finite & F.exists("embedding", lambda x: x != 0)))
    )
    every = known.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component")))
    return every.select(
        "vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"),
    )
