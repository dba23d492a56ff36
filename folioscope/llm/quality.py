"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (0) or abstains (2). The votes of a document form one
pattern; there are at most 3 ** len(RULES) patterns whatever the number of documents.
Expectation-maximisation over the counted patterns estimates how often each rule says
good about good and about bad documents, and a document is judged by the posterior
probability that it is good, not by passing every rule: rules overlap, so bad documents break
several, and one bad vote among good ones is outweighed. The counts and the posteriors are
of all documents; those that fail the base rule are never kept, whatever their posterior.

Cases: null text counts as empty; no words give zero features, and rules that divide by
them abstain; repeated rows are judged alike; an empty table gives an empty result; other
columns, whatever their names, are passed through by ``quality_filter`` untouched.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.util import Stash, let, quoted, text_or_empty

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Words of symbols alone, words that end in symbols, and runs of ASCII signs.
LONE = r"(?<![^\x20\x09-\x0D])[#*$%&|<>]+(?![^\x20\x09-\x0D])"
STUCK = r"[^\x20\x09-\x0D#*$%&|<>][#*$%&|<>]+(?![^\x20\x09-\x0D])"
SIGNS = r"[!-/:-@\[-`{-~]+"
GOOD, BAD, ABSTAIN = 1, 0, 2

#: name: (good if, bad if), over the features; otherwise the rule abstains.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words >= 80", "n_words < 50"),
    "word_length": (
        "word_chars >= 3 * n_words and word_chars <= 9 * n_words and n_words > 0",
        "word_chars < 2 * n_words or word_chars > 14 * n_words",
    ),
    "symbols": ("50 * n_symbols <= n_words", "20 * n_symbols > n_words"),
    "line_copies": ("10 * n_dup_lines <= n_lines", "2 * n_dup_lines > n_lines"),
    "repeated_words": ("10 * n_repeat_words <= n_words", "100 * n_repeat_words > 45 * n_words"),
    "word_runs": ("50 * n_same_next <= n_words", "5 * n_same_next > n_words"),
    "lone_symbols": ("50 * n_lone_symbols <= n_words", "10 * n_lone_symbols > n_words"),
    "stuck_symbols": ("50 * n_stuck_symbols <= n_words", "10 * n_stuck_symbols > n_words"),
    "signs": ("10 * n_signs <= 3 * n_words", "10 * n_signs > 4 * n_words"),
    "sentence_ends": ("n_words <= 60 * n_sentence_ends", "n_words > 100 * n_sentence_ends"),
}
FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_same_next", "n_sentence_ends", "n_lone_symbols", "n_stuck_symbols", "n_signs",
)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are sorted by hash with their place, so equal ones stand side by side: linear
    but for the sort, however repetitive the text.
    """
    count = F.size(words)
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(count - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.when(j == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(at, j - 1))))
        return F.aggregate(gaps, F.lit(0), lambda total, g: total + g)

    def repeated(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, j: (
                F.coalesce(F.get(ordered, j + 1)["h"] == x["h"], F.lit(False))
                | ((j > 0) & F.coalesce(F.get(ordered, j - 1)["h"] == x["h"], F.lit(False)))
            ),
        )
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    return F.when(count < 4, F.lit(0)).otherwise(let(F.sort_array(windows), repeated))


def features(text: Column) -> Column:
    """A struct of ``FEATURES``, all long."""

    def of_words(words: Column) -> Column:
        same = F.filter(words, lambda w, i: F.coalesce(F.get(words, i + 1) == w, F.lit(False)))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(same).cast("long").alias("n_same_next"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    def times(symbols: Column, pattern: str) -> Column:
        return F.when(symbols > 0, F.regexp_count(text, F.lit(pattern))).otherwise(0).cast("long")

    def joined(w: Column, symbols: Column) -> Column:
        return let(
            let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines),
            lambda n: F.struct(
                w["n_words"].alias("n_words"),
                w["word_chars"].alias("word_chars"),
                symbols.alias("n_symbols"),
                n["n_dup_lines"].alias("n_dup_lines"),
                w["n_repeat_words"].alias("n_repeat_words"),
                n["n_lines"].alias("n_lines"),
                w["n_same_next"].alias("n_same_next"),
                F.regexp_count(text, F.lit(r"[.!?](?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_sentence_ends"),
                times(symbols, LONE).alias("n_lone_symbols"),
                times(symbols, STUCK).alias("n_stuck_symbols"),
                F.regexp_count(text, F.lit(SIGNS)).cast("long").alias("n_signs"),
            ),
        )

    counted = F.regexp_count(text, F.lit(SYMBOLS)).cast("long")
    return let(let(F.array_remove(F.split(text, SPACE + "+"), ""), of_words), lambda w: let(counted, lambda n: joined(w, n)))


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def vote_pattern() -> Column:
    """The rules' votes as one integer in base 3."""
    code: Column = F.lit(0)
    for k, (good, bad) in enumerate(RULES.values()):
        vote = F.when(F.expr(good), GOOD).when(F.expr(bad), BAD).otherwise(ABSTAIN)
        code = code + vote * 3**k
    return code.cast("int")


#: What is believed before any document is seen: how often a rule says bad about a good and about a bad document,
#: the share of good documents, and as how many documents these beliefs count, whatever the size of the table.
BREAKS_GOOD, BREAKS_BAD, SHARE_GOOD, BELIEF = 0.02, 0.3, 0.9, 100.0
#: A vote multiplies the odds by this at most, so that it takes two rules to reject, and is never held to say the opposite.
MOST_ODDS = 10.0
#: Bad documents are held to be such a share at least, so that a text's verdict doesn't turn with how few are like it.
LEAST_BAD = 0.05


def fit_votes(counts: dict[int, int], rules: int = len(RULES), rounds: int = 60) -> dict[int, float]:
    """Posterior probability of good for each pattern, by expectation-maximisation.

    Starts from the beliefs above, under which one bad vote is no verdict; the rounds then estimate the share of
    good documents and the rules' accuracies from the documents. A group that breaks one rule only, however large,
    is thus drawn to the good documents, and the bad ones are those that several rules agree on.
    """
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], float)
    votes = patterns[:, None] // 3 ** np.arange(rules) % 3
    bad, good = (votes == BAD).astype(float), (votes == GOOD).astype(float)
    post = np.zeros((len(n), 2))  # of good, of bad
    weights = BELIEF * np.array([SHARE_GOOD, 1 - SHARE_GOOD])
    breaks = np.array([BREAKS_GOOD, BREAKS_BAD])
    for _ in range(rounds + 1):
        held = n[:, None] * post
        share_bad = max(LEAST_BAD, (held[:, 1].sum() + weights[1]) / (held.sum() + BELIEF))
        says_bad = bad.T @ held + breaks * weights
        says_good = good.T @ held + (1 - breaks) * weights
        rate = says_bad / (says_bad + says_good)
        most = math.log(MOST_ODDS)
        for_bad = np.clip(np.log(rate[:, 0] / rate[:, 1]), -most, 0)
        for_good = np.clip(np.log((1 - rate[:, 0]) / (1 - rate[:, 1])), 0, most)
        odds = math.log((1 - share_bad) / share_bad) + bad @ for_bad + good @ for_good
        post = np.stack([1 / (1 + np.exp(-odds)), 1 / (1 + np.exp(odds))], axis=1)
    return dict(zip(patterns.tolist(), post[:, 0].tolist()))


def _judged(rows: DataFrame, pattern: str) -> DataFrame:
    """``rows`` with their quality; the table of patterns is bounded by the rules, so it is broadcast."""
    spark = rows.sparkSession
    counts = {r[0]: r[1] for r in rows.groupBy(pattern).count().collect()}
    table = [(p, float(q)) for p, q in fit_votes(counts).items()]
    known = spark.createDataFrame(table, "pattern int, quality double")
    return rows.join(F.broadcast(known), F.col(pattern) == known["pattern"], "left").drop(known["pattern"])


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Features and verdict of every row: id, ``FEATURES``, base_failed, quality, kept."""
    stash = Stash(docs.sparkSession, "quality")
    seen = docs.select(F.col(id_col).alias("doc_id"), features(text_or_empty(text_col)).alias("f")).select("doc_id", "f.*")
    rows = stash.put(seen.withColumns({"base_failed": base_failed(), "vote_pattern": vote_pattern()}), "features")
    return _judged(rows, "vote_pattern").select(
        "doc_id", *FEATURES, "base_failed", "quality",
        (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"),
    )


def quality_filter(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text is kept, with the columns they came with."""
    stash = Stash(docs.sparkSession, "quality")
    seen = docs.select(
        F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), features(text_or_empty(text_col)).alias("f")
    ).select("row", "f.*")
    rows = stash.put(seen.select("row", base_failed().alias("base_failed"), vote_pattern().alias("vote_pattern")), "rows")
    good = _judged(rows, "vote_pattern").where(~F.col("base_failed") & (F.col("quality") >= threshold))
    return good.select("row.*")
