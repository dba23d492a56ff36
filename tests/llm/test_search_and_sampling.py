"""Importance resampling, best-fit packing and ranked search against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import binpack, importance, search, words
from folioscope.llm.util import Stash

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [
    None, "", " \n\t ", "one", "ONE Two, two;É É\x00é 日本語🙂x", "a_b-c`d{e}~f\x7fg", "z" * 20000, "w " * 9000, "x" * 63 + " " + "y" * 64 + " " + "z" * 65,
    "Tail <|endoftext|> and <|endoftext|>x", "  two  spaces \n\n  and  no-break　wide  ", "it's we'll 12,345.6 !!", " lead", "trail ",
]


def words_of(t):
    return WORD.findall((t or "").translate(LOWER))


@pytest.fixture(scope="module")
def texts():
    return ODD + pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist()


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Ids, a null id, repeated rows, and columns with names that the operators use inside."""
    rows = [(k, t, 1, "x", None, 2) for k, t in enumerate(texts)] + [(None, texts[-1], 1, "x", None, 2), (3, "one", 1, "x", None, 2), (20, texts[20], 1, "x", None, 2), (20, texts[20], 1, "x", None, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, uid int, score string, rank int, `a.b` int").repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_words(texts):
    parts = pa.array(["gone", *texts])[1:]
    found, counts = words.words_of(parts)
    assert counts.tolist() == [len(words_of(t)) for t in texts]
    assert found.to_pylist() == [w for t in texts for w in words_of(t)]
    assert words.crc32_of(found).tolist() == [zlib.crc32(w.encode()) for w in found.to_pylist()]
    for size in (2, 3):
        runs, n = words.runs_of(found, counts, size)
        plain = [[" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] for w in map(words_of, texts)]
        assert n.tolist() == list(map(len, plain)) and runs.to_pylist() == [r for p in plain for r in p]
    assert words.words_of(pa.array([], pa.string()))[1].tolist() == [] and len(words.crc32_of(pa.array([], pa.string()))) == 0


def plain_resample(rows, target, run_words=1, buckets=10000, min_words=20, percent=10):
    def features(t):
        w = words_of(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, run_words + 1) for i in range(len(w) - n + 1)]

    held = [features(t) for _, t in rows]
    s, t = collections.Counter(b for f in held for b in f), collections.Counter(b for x in target for b in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for (k, text), f in zip(rows, held):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    able = sorted((x for x in out if x[4] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = able[: percent * len(able) // 100]
    ranks = collections.Counter((x, n) for n, x in enumerate(drawn, 1))
    rest = collections.Counter(out) - collections.Counter(drawn)
    return sorted(str((*x[:4], n)) for x, n in [*ranks.elements(), *((x, None) for x in rest.elements())])


@pytest.mark.parametrize("run_words, percent", [(1, 10), (1, 100), (2, 37)])
def test_resample(spark, docs, run_words, percent):
    target = pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist()
    items = spark.createDataFrame([(t, 1) for t in [*target, None]], "text string, bucket int")
    got = importance.resample(docs, items, run_words=run_words, percent=percent).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(str(tuple(r)) for r in got) == plain_resample(rows, [*target, None], run_words, percent=percent)


def test_resample_of_nothing(spark, docs, none):
    assert importance.resample(none, docs).count() == 0
    got = importance.resample(docs.limit(5), none).collect()
    assert len(got) == 5 and all(r.rank is None for r in got)


def test_ties_at_the_cut(spark):
    """All scores equal: the bracket is everything, and ids decide; no row is lost or drawn twice."""
    rows = spark.range(30000).select((F.col("id") * 7919 % 30000).alias("doc_id"), F.lit(30).cast("long").alias("n_words"), (F.col("id") % 2 * 0).alias("score"), F.col("id").alias("uid"))
    got = importance.draw(Stash(spark, "test").put(rows.repartition(6), "ties")).where("rank is not null").collect()
    assert sorted((r["rank"], r.doc_id) for r in got) == [(k + 1, k) for k in range(3000)]


def test_a_bad_sketch_is_widened(spark, monkeypatch):
    """Brackets that miss the cut are found by the exact counts, up to the range of all scores."""
    rows = Stash(spark, "test").put(spark.range(5000).select("id", F.col("id").alias("score")), "skew")
    monkeypatch.setattr(importance, "MARGINS", (-3000, -1500))
    assert importance.bracket(rows, 2500, 5000) == (0, 4999, 0, 5000)
    monkeypatch.undo()
    low, high, above, inside = importance.bracket(rows, 500, 5000)
    assert low <= 4500 <= high and above < 500 <= above + inside and inside < 100


def test_word_ids(texts):
    ids, ends = binpack.load(BYTES).batch(pa.array(["gone", *texts])[1:])
    tokenizer = Tokenizer.from_file(BYTES)
    assert binpack.load(BYTES).cut
    rng = random.Random(3)
    odd = ["".join(rng.choice(" \t\n\r\x0b\x1c\x85\xa0   　a'sé1!日🙂") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for many in (texts, odd, odd):
        ids, ends = binpack.load(BYTES).batch(pa.array(many, pa.string()))
        starts = [0, *ends[:-1].tolist()]
        for t, a, b in zip(many, starts, ends.tolist()):
            assert ids[a:b].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [0]


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(binpack, "WORDS_KEPT", 50)
    own = binpack.WordIds(BYTES)
    for k in range(20):
        own.batch(pa.array([f"w{k}a w{k}b w{k}c " * 3 + " ".join(map(str, range(k * 40, k * 40 + 40)))]))
    assert len(own.known) < 120


@pytest.mark.parametrize("window", [2048, 64])
def test_packing(spark, docs, none, window):
    got = binpack.pack(docs, BYTES, window).collect()
    assert binpack.pack(none, BYTES, window).count() == 0
    tokenizer = Tokenizer.from_file(BYTES)
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % window + 1
        for piece, start in enumerate([0, *range(first, len(ids), window)]):
            part = ids[start : first if not piece else start + window]
            want[r.doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(n for _, n in parts) <= window


def plain_best_fit(lengths, window):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = min((k for k, r in enumerate(room) if r >= n), key=lambda k: room[k], default=None)
        if fit is None:
            room.append(window - n)
        else:
            room[fit] -= n
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_take_no_more_windows_than_best_fit(seed):
    """Of even lengths up to a window a two-hundredth more at most, of all others no more."""
    rng = random.Random(seed)
    lengths = [min(2047, max(1, int(f(rng)))) for f in [lambda r: r.uniform(1, 2047), lambda r: r.gauss(700, 60), lambda r: r.lognormvariate(5, 1), lambda r: r.choice([900, 1100, 500, 1025]), lambda r: r.gauss(1100, 200), lambda r: 700][seed : seed + 1] for _ in range(3000)]
    slots, sequences, placed = binpack.plan(collections.Counter(lengths))
    held = collections.defaultdict(list)
    ranks = collections.defaultdict(list)
    for length, low, high, sequence, offset in slots:
        ranks[length].append((low, high))
        for k in range(high - low):
            held[sequence + k].append((offset, length))
    for length, n in collections.Counter(lengths).items():
        assert [x for a, b in sorted(ranks[length]) for x in range(a, b)] == list(range(n))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(parts[-1]) <= 2048
    assert len(held) == sequences <= plain_best_fit(lengths, 2048) * (1.005 if seed == 0 else 1)
    assert placed > 0.5 * len(lengths) or seed == 5  # of one length alone none fills a window with little slack


def plain_search(rows, items, k=10):
    held = [(i, collections.Counter(words_of(t))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 90 + 90 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(words_of(text)) if c[w])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, docs, texts, small, monkeypatch):
    """Also with blocks, tiles and gathered candidates so small that all borders are crossed."""
    if small:
        for name, value in (("ITEMS_A_BLOCK", 9), ("DOCS_A_TILE", 3), ("TERMS_A_TILE", 5), ("GATHERED", 20)):
            monkeypatch.setattr(search, name, value)
    target = pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist()[:12]
    items = [*enumerate(target), (90, None), (91, ""), (92, "W nothingatall"), (93, texts[20]), (None, "one"), (94, "ONE one"), (94, "ONE one")]
    asked = spark.createDataFrame([(*x, 7, "x") for x in items], "item_id long, text string, item int, doc_id string").repartition(3)
    got = search.rank_documents(docs, asked).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(str(tuple(r)) for r in got) == plain_search(rows, items)


def test_search_of_nothing(spark, docs, none):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert search.rank_documents(none, items).count() == 0
    assert search.rank_documents(docs.where("text is null"), items).count() == 0
    assert search.rank_documents(docs, items.limit(0)).count() == 0


def test_many_ties_keep_the_smallest_ids(spark):
    """Thousands of equal documents over many partitions: ids decide, also among rows without one."""
    rows = spark.range(6000).select(F.when(F.col("id") % 1000 > 3, F.col("id") * 7 % 6000).alias("doc_id"), F.lit("same words here").alias("text")).repartition(7)
    items = spark.createDataFrame([(1, "words"), (2, "here same")], "item_id long, text string")
    ids = sorted(r.doc_id for r in rows.where("doc_id is not null").collect())
    others = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("none of them").alias("text"))
    got = search.rank_documents(rows.unionByName(others), items, k=25).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in got) == [(i, k + 1, ids[k]) for i in (1, 2) for k in range(25)]


def test_tile_sums_are_exact():
    """Weights and impacts as large as they get: float64 products, a narrow tile at a time, lose nothing."""
    rng = np.random.default_rng(1)
    terms, items = 3000, 4
    weights, impact = rng.integers(20000, 40000, terms), rng.integers(900000, 10**6, (2, terms))
    width = min(search.TERMS_A_TILE, (search.EXACT - 1) // (10**6 * int(weights.max())))
    heads, items_of = np.arange(terms + 1) * items, np.tile(np.arange(items), terms)
    doc, term = np.repeat([0, 1], terms), np.tile(np.arange(terms), 2)
    got = search.tile_scores(doc, term, impact.ravel(), 2, heads, items_of, weights, items, width)
    assert got.tolist() == [[int((impact[d] * weights).sum())] * items for d in (0, 1)]
