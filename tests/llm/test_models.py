"""Language identification and toxicity: held-out accuracy, gradients, edge cases."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import language, sampling, toxicity

SF = "/root/testdata/sf0.1"


def learnable(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 != 0


@pytest.fixture(scope="module")
def labelled():
    sql = f"SELECT doc_id, text, lang, toxic FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id) ORDER BY hash(doc_id)"
    return duckdb.connect().execute(sql).fetchall()


def test_language_on_documents_not_seen(labelled):
    model = language.train([(t, lang) for k, t, lang, _ in labelled if learnable(k)][:800])
    unseen = [(t, lang) for k, t, lang, _ in labelled if not learnable(k)]
    right = [model.predict(t)[0] == lang for t, lang in unseen]
    assert sum(right) / len(right) > 0.97
    sure = [ok for ok, (t, _) in zip(right, unseen) if model.predict(t)[2]]
    assert not sure or sum(sure) / len(sure) >= sum(right) / len(right)


def test_language_edges(spark):
    docs = spark.createDataFrame(
        [(k, t, lang, "x") for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
        + [(100, None, "en", "x"), (101, "", None, "x"), (102, "12 .!", None, "x"), (None, "the dog", "en", "x"), (1, "der hund", "de", "x"), (103, "é " * 300000, None, "x")],
        "doc_id long, text string, lang string, label string",
    )
    model = language.fit(docs)
    got = language.identify(docs, model).collect()
    assert len(got) == docs.count()
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(of[k].lang_pred == "und" and of[k].score == 0 for k in (100, 101, 102))
    assert of[0].lang_pred == "en" and 0 < of[0].score <= 1 and of[103].lang_pred in ("en", "de")
    assert all(of[k].held_out == (not learnable(k)) for k in of)
    nothing = language.fit(docs.where("lang = 'zz'"))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_grams_do_not_depend_on_stretches(monkeypatch):
    text = "Añadir, también: la niña x " * 20
    whole = np.bincount(np.concatenate(list(language.grams(text))), minlength=language.ROWS)
    monkeypatch.setattr(language, "STRETCH", 37)
    parts = np.bincount(np.concatenate(list(language.grams(text))), minlength=language.ROWS)
    assert np.abs(whole - parts).sum() <= 0.5 * whole.sum() and (parts >= whole).all()


def plain_language(model, text):
    """The language and its probability gram by gram, from the table alone."""
    folded, total, count = "\0", np.zeros(len(model.languages)), 0
    for c in text:
        c = c.lower()[0] if c.isalpha() else "\0"
        folded += c if c != "\0" or folded[-1] != "\0" else ""
    folded += "\0" if folded[-1] != "\0" else ""
    if folded == "\0":
        return "und", 0.0
    for size in (2, 3, 4):
        for k in range(len(folded) - size + 1):
            h = ord(folded[k])
            for c in folded[k + 1 : k + size]:
                h = (h * 0x9E3779B1 + ord(c)) % 2**32
            h = h * 0x9E3779B1 % 2**32
            total += model.table[(h ^ size if size > 2 else h) >> 17].astype(float)
            count += 1
    z = (total / count + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.languages[p.argmax()], p.max()


def test_language_of_whole_texts_gram_by_gram(labelled):
    model = language.train([(t, lang) for k, t, lang, _ in labelled if learnable(k)][:200])
    for text in [t for _, t, _, _ in labelled[:40]] + ["", "12 .!", "a", "É", "ab-cd"]:
        lang, p = plain_language(model, text)
        got = model.predict(text)
        assert got[0] == lang and got[1] == pytest.approx(p, abs=1e-4)


def test_sample(spark):
    """The smallest hashes of learnable ids, whatever the cut; long texts in stretches."""
    rows = [(k, f"text {k} " + "x" * (k % 7 * 100), k % 10 == 0) for k in range(1, 3000)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(4, "a copy"), (None, "none"), (9999, None)], "id long, text string")
    marks = spark.createDataFrame([(k, int(y)) for k, _, y in rows] + [(None, 1), (7, None), (5, 1), (9999, 1), (8888, 1)], "id long, label int")
    hashes = {r.id: r.h for r in docs.select("id", F.shiftrightunsigned(F.xxhash64("id"), 11).alias("h")).distinct().collect() if r.id}
    label_of = {k: int(y) for k, _, y in rows} | {5: 1, 9999: 1}
    for most in (5, 100, 5000):
        got = sampling.labelled_sample(docs, marks, most, 80)
        text_of = {k: t for k, t, _ in rows} | {4: "a copy"}
        for y in (0, 1):
            want = sorted((k for k in label_of if label_of[k] == y and learnable(k)), key=hashes.get)[:most]
            assert [t[:8] for t, v in got if v == y] == [text_of[k][:8] for k in sorted(want) if k in text_of]
        assert all(len(t) <= 88 for t, _ in got)
    assert sampling.labelled_sample(docs, marks.limit(0), 5, 80) == sampling.labelled_sample(docs.limit(0), marks, 5, 80) == []
    long = spark.createDataFrame([("".join(chr(97 + k // 100) for k in range(2600)),)], "text string")
    cut = long.select(sampling.stretches(F.col("text"), 80)).first()[0]
    assert cut.startswith("a" * 10) and cut.endswith("z" * 10) and len(set(cut)) == 9


def test_gradients():
    """Back-propagation agrees with differences of the loss."""
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in toxicity.fresh(1).items()}
    words = [b"one", b"two", b"three"]
    vocabulary = toxicity.Vocabulary(words)
    net["word"][vocabulary.word] = rng.normal(size=(3, toxicity.WORD_SIZE))
    net["gram"][vocabulary.gram] = rng.normal(size=(len(vocabulary.gram), toxicity.GRAM_SIZE))
    steps = rng.integers(0, 3, size=(toxicity.STEPS, 4))
    steps[20:, 1] = 3
    steps[:, 3] = 3
    target = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        z = toxicity.logits(net, toxicity._project(vocabulary.inputs(net), net), steps, 3)
        return np.mean(np.log1p(np.exp(-np.where(target == 1, z, -z))))

    grads = toxicity._gradients(net, vocabulary, steps, 3, target)
    for name in ("out", "att", "att_to", "re_f", "re_b", "in_f", "in_b", "bias_f", "word", "gram"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        keep, h = net[name][at], 1e-2
        net[name][at] = keep + h
        up = loss()
        net[name][at] = keep - h
        down = loss()
        net[name][at] = keep
        assert (up - down) / (2 * h) == pytest.approx(grads[name][at], rel=0.08, abs=2e-4), name


def test_windows_cover_every_word():
    for n in (0, 1, toxicity.STEPS, toxicity.STEPS + 1, 100, 1000):
        starts = toxicity.windows_of(n)
        assert starts[-1] + toxicity.STEPS >= n and all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_toxicity_on_documents_not_seen(labelled):
    model = toxicity.train([(t, y) for k, t, _, y in labelled if learnable(k)])
    texts, y = zip(*[(t, y) for k, t, _, y in labelled if not learnable(k)])
    found, y = model.score(list(texts)) >= 0.5, np.array(y, bool)
    assert (found & y).sum() / y.sum() > 0.85 and (found & ~y).sum() / (~y).sum() < 0.05
    lexicon = toxicity.Lexicon(model.net)
    parts = np.concatenate([model.score(list(texts[k : k + 7]), lexicon) for k in range(0, 70, 7)])
    assert np.allclose(parts, model.score(list(texts[:70])), atol=1e-5)
    few = model.score(["", None, "you idiot stupid scum idiot", "the and of", "w " * 200000])
    assert ((0 <= few) & (few <= 1)).all() and few[0] == few[1] and few[2] > 0.5 > few[0]
    assert (model.score(["...", " \n", "?! #"]) == toxicity.NO_WORDS).all()
    some = [t for t in texts[:25]] + [max(texts, key=len), "x", "idiot", ""]
    assert np.allclose([plain_score(model, t) for t in some], model.score(some), atol=1e-4)


def plain_score(model, text):
    """A text's score word by word and window by window, from the network's formulas alone."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0.0
    net, sigmoid = model.net, lambda x: 1 / (1 + np.exp(-x))
    n = toxicity.HIDDEN

    def vector(word):
        marked = f"<{word}>".encode()
        rows = []
        for size in toxicity.GRAMS:
            for k in range(len(marked) - size + 1):
                h = marked[k]
                for c in marked[k + 1 : k + size]:
                    h = (h * 0x01000193 % 2**32) ^ c
                rows.append(((h ^ size) * 0x9E3779B1 % 2**32) >> 15)
        grams = net["gram"][rows].mean(axis=0) if rows else np.zeros(toxicity.GRAM_SIZE)
        return np.concatenate([net["word"][zlib.crc32(word.encode()) % toxicity.WORD_ROWS], grams])

    def run(vectors, side):
        h, out = np.zeros(n), []
        for x in vectors:
            a, b = x @ net[f"in_{side}"] + net[f"bias_{side}"], h @ net[f"re_{side}"]
            r, z = sigmoid(a[:n] + b[:n]), sigmoid(a[n : 2 * n] + b[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(a[2 * n :] + r * b[2 * n :])
            out.append(h)
        return out

    logits, start = [], 0
    while True:
        vectors = [vector(w) for w in words[start : start + toxicity.STEPS]]
        states = np.concatenate([run(vectors, "f"), run(vectors[::-1], "b")[::-1]], axis=1)
        weights = np.exp(np.tanh(states @ net["att"] + net["att_bias"]) @ net["att_to"])
        logits.append(weights @ states / weights.sum() @ net["out"] + net["out_bias"][0])
        if start + toxicity.STEPS >= len(words):
            break
        start += toxicity.STRIDE
    logits = np.array(logits)
    return sigmoid(np.array([logits.max(), np.log(sigmoid(logits).mean() + 0.01), 1]) @ model.curve)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 5), (None, "c", 5), (1, "a b", 5)], "doc_id long, text string, score int")
    marks = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    none = toxicity.fit(docs, marks([]))
    assert [r.score for r in toxicity.score_toxicity(docs, none).collect()] == [0.0] * 4
    assert toxicity.fit(docs, marks([(1, 1), (None, 1), (2, None)])).constant == 1.0
    assert toxicity.drop_toxic(docs, none).columns == docs.columns and toxicity.drop_toxic(docs, none).count() == 4
    small = toxicity.train([("you idiot", 1), ("hello there", 0)])
    assert toxicity.drop_toxic(docs.limit(0), small).count() == 0 and toxicity.score_toxicity(docs, small).count() == 4


def test_a_column_of_very_many_labels_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MOST_LABELS", 3)
    rows = [(k, f"l{k}" if k >= 60 else "abc"[k % 3]) for k in range(200)]
    marks = spark.createDataFrame(rows, "id long, label string")
    got = sampling.labelled_sample(marks.select("id", F.lit("text").alias("text")), marks, 5, 1000)
    assert {label for _, label in got} == set("abc") and len(got) == 15
