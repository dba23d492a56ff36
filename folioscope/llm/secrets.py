"""Secret scans over a trigram inverted index, in DataFrame functions only.

Every rule's regular expression is parsed and turned into a Boolean query over the
trigrams (lower case) that each match must hold, as an OR of ANDs. The index lists, for
the trigrams that any query names, the documents that hold them; counting a clause's
postings for each document intersects them, and only documents that meet a clause are
verified with that rule's expression. Rules without mandatory trigrams scan every text.

Only ids and postings are shuffled, and the texts that hold some clause's rarest trigram; all other
texts can't be candidates and are scanned where they are read.

Cases: null text counts as empty and has no span; a null id can't be indexed, so such
rows are verified with every rule; rows that repeat an id share their candidates, a
superset for each, and are verified apart; equal starts are ordered by the rules' order;
very long texts and texts with very many spans take time in proportion to their length, as running
sums go by blocks and no expression starts inside a run of its own letters; an empty table gives an empty
result; other columns don't matter to ``scan_secrets`` and pass through ``redact_secrets``.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.util import Stash, let, quoted, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``pattern`` is used by Spark and parsed here; ``group`` must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    @property
    def regex(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


#: A run of one set of characters that is too short holds no longer one, so the last two state their least
#: length in the expression; a short value of the first still ends its match, so it is dropped afterwards.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"(?<![a-z])[a-z]+://[^\s:/@]+:[^\s:/@]+@"),
)
RULES = BASE_RULES + MORE_RULES

Clauses = frozenset[frozenset[str]]
NOTHING: Clauses = frozenset([frozenset()])
#: Sets of exact strings larger than this are given up, and so are queries with more clauses.
MOST = 24


def _either(a: Clauses, b: Clauses) -> Clauses:
    both = a | b
    return NOTHING if frozenset() in both or len(both) > MOST else frozenset(x for x in both if not any(y < x for y in both))


def _both(a: Clauses, b: Clauses) -> Clauses:
    crossed = frozenset(x | y for x, y in product(a, b))
    return crossed if len(crossed) <= MOST else max(a, b, key=lambda c: min(map(len, c)))


def _of_strings(strings: set[str]) -> Clauses:
    out: Clauses = frozenset()
    for s in strings:
        out = _either(out, frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))])) if out != NOTHING else out
    return out


def _walk(parsed) -> tuple[set[str] | None, Clauses]:
    """(every string that can match, if few; else None and the trigrams that each match must hold)."""
    run, query, whole = {""}, NOTHING, True
    for op, arg in parsed:
        part, inner = _part(op, arg)
        if part is not None and len(run) * len(part) <= MOST:
            run = {a + b for a, b in product(run, part)}
        else:
            query = _both(_both(query, _of_strings(run)), inner)
            run, whole = part or {""}, False
    return (run, NOTHING) if whole else (None, _both(query, _of_strings(run)))


def _part(op, arg) -> tuple[set[str] | None, Clauses]:
    """The same for one item of a parsed expression."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, NOTHING
    if op is sre.IN and len(arg) <= MOST and all(o is sre.LITERAL for o, _ in arg):
        return {chr(v).lower() for _, v in arg}, NOTHING
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, NOTHING
    if op is sre.SUBPATTERN:
        return _walk(arg[3])
    if op is sre.BRANCH:
        kinds = [_walk(x) for x in arg[1]]
        if all(k[0] is not None for k in kinds) and len(strings := set().union(*[k[0] for k in kinds])) <= MOST:
            return strings, NOTHING
        query: Clauses = frozenset()
        for strings, inner in kinds:
            query = _either(query, inner if strings is None else _of_strings(strings)) if query != NOTHING else query
        return None, query
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, sub = arg
        strings, inner = _walk(sub)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, NOTHING
        if strings is not None and low == high and len(strings) ** low <= MOST:
            return {"".join(x) for x in product(strings, repeat=low)}, NOTHING
        return None, NOTHING if not low else inner if strings is None else _of_strings(strings)
    return None, NOTHING


def trigram_query(pattern: str) -> Clauses:
    """An OR of ANDs of lower-case trigrams; ``NOTHING`` (one empty AND) if none is mandatory."""
    strings, query = _walk(sre_parse.parse(pattern))
    return _of_strings(strings) if strings is not None else query


@dataclass(frozen=True)
class Term:
    """A trigram of one clause of a rule's query; ``needed`` is how many trigrams the clause has."""

    trigram: str
    rule: int
    clause: int
    needed: int


def query_terms(rules: tuple[Rule, ...]) -> list[Term]:
    queries = [(r, trigram_query(rule.pattern)) for r, rule in enumerate(rules)]
    clauses = [(r, c, clause) for r, q in queries if q != NOTHING for c, clause in enumerate(sorted(map(sorted, q)))]
    return [Term(t, r, c, len(clause)) for r, c, clause in clauses for t in clause]


def any_of(names: list[str]) -> str:
    """An expression for any of the trigrams, common beginnings first, so that a place in a text is looked at once."""
    tree: dict[str, dict[str, list[str]]] = {}
    for x in sorted(names):
        tree.setdefault(x[0], {}).setdefault(x[1], []).append(x[2])
    either = lambda parts: f"(?:{'|'.join(parts)})" if len(parts) > 1 else parts[0]
    word = re.escape
    return either([word(a) + either([word(b) + either([word(c) for c in last]) for b, last in rest.items()]) for a, rest in tree.items()])


def inverted_index(docs: DataFrame, terms: list[Term], id_col: str, text_col: str) -> DataFrame:
    """Postings (trigram, id), for the trigrams of the queries; trigrams may overlap in a text, so nothing is taken in while finding one."""
    every = F.lit(f"(?=({any_of(sorted({x.trigram for x in terms}))}))")
    held = F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(text_col)), every, F.lit(1)))
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col)).where("id is not null")
    return named.select("id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, terms: list[Term]) -> DataFrame:
    """(id, rules): per document, the indexes of the rules whose trigram query it meets.

    The table of queries is bounded by the rules and broadcast.
    """
    rows = [(x.trigram, x.rule, x.clause, x.needed) for x in terms]
    queries = index.sparkSession.createDataFrame(rows, "trigram string, rule int, clause int, needed int")
    met = (
        index.join(F.broadcast(queries), "trigram")
        .groupBy("id", "rule", "clause", "needed")
        .agg(F.count_distinct("trigram").alias("n"))
        .where("n = needed")
    )
    return met.groupBy("id").agg(F.collect_set("rule").alias("rules"))


def rarest(index: DataFrame, terms: list[Term]) -> list[str]:
    """The trigram with the fewest postings of each clause; there are as many postings lists as trigrams in the queries."""
    sizes = {r[0]: r[1] for r in index.groupBy("trigram").count().collect()}
    clauses: dict[tuple[int, int], list[str]] = {}
    for x in terms:
        clauses.setdefault((x.rule, x.clause), []).append(x.trigram)
    return sorted({min(clause, key=lambda t: (sizes.get(t, 0), t)) for clause in clauses.values()})


#: Values that a running sum or maximum goes through at once; blocks are then put together.
RUN_BLOCK = 256
#: Characters of a piece that texts are cut from.
PIECE = 4096
NO_SPANS = "cast(array() as array<struct<start: int, rank: int, kind: string, end: int>>)"


def running(values: Column, over) -> Column:
    """For each integer its sum, or whatever ``over`` makes of two, with all before it, in blocks: no long array is grown by one again and again."""

    def scan(xs: Column) -> Column:
        def step(out: Column, x: Column) -> Column:
            return F.concat(out, F.array(F.when(F.size(out) == 0, x).otherwise(over(F.get(out, F.size(out) - 1), x))))

        return F.aggregate(xs, F.expr("cast(array() as array<int>)"), step)

    def joined(blocks: Column) -> Column:
        tops = let(scan(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1))), lambda t: F.transform(blocks, lambda b, k: F.struct(b.alias("b"), F.get(t, k - 1).alias("before"))))
        return F.flatten(F.transform(tops, lambda x: F.transform(x["b"], lambda v: F.when(x["before"].isNull(), v).otherwise(over(x["before"], v)))))

    def cut(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / RUN_BLOCK).cast("int")), lambda k: scan(F.slice(xs, k * RUN_BLOCK + 1, F.lit(RUN_BLOCK))))
        return F.when(F.size(xs) > 0, let(blocks, joined)).otherwise(F.expr("cast(array() as array<int>)"))

    return let(values, cut)


def _spans(text: Column, rules: tuple[Rule, ...], due) -> Column:
    """The spans of the rules for which ``due`` of the rule's index isn't false: (start, rank, kind, end), in code points, end exclusive.

    Matches and the pieces between them alternate, so their lengths give the places. A text without a match is
    gone through once by a rule. ``due`` is null for rules that are never due.
    """
    texts = F.expr("cast(array() as array<string>)")
    tried = [(r, rule, due(r)) for r, rule in enumerate(rules) if due(r) is not None]
    if not tried:
        return F.expr(NO_SPANS)
    found = F.array(*[F.when(asked, F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))).otherwise(texts) for _, rule, asked in tried])

    def cut(every: Column) -> Column:
        pieces = F.array(*[F.when(F.size(F.get(every, F.lit(k))) > 0, F.split(text, rule.regex, -1)).otherwise(texts) for k, (_, rule, _) in enumerate(tried)])
        return let(pieces, lambda p: F.flatten(F.transform(every, lambda matches, k: place(matches, F.get(p, k), k))))

    def place(matches: Column, pieces: Column, k: Column) -> Column:
        steps = F.transform(matches, lambda m, i: F.char_length(m) + F.char_length(F.get(pieces, i)))
        spans = F.zip_with(matches, running(steps, lambda a, b: a + b), lambda m, end: F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("m")))
        ranks, kinds = F.array(*[F.lit(r) for r, _, _ in tried]), F.array(*[F.lit(rule.kind) for _, rule, _ in tried])

        def fitting(s: Column) -> Column:
            out: Column = F.lit(True)
            for n, (_, rule, _) in enumerate(tried):
                if rule.least:
                    out = out & ((k != n) | (F.char_length(F.regexp_extract(s["m"], rule.regex, rule.group)) >= rule.least))
            return out

        return F.transform(
            F.filter(spans, fitting),
            lambda s: F.struct(s["start"].alias("start"), F.get(ranks, k).alias("rank"), F.get(kinds, k).alias("kind"), s["end"].alias("end")),
        )

    return F.sort_array(let(found, cut))


def _with_spans(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(row, text, spans): each row as it came, its text or "", and its spans by start, then rule."""
    terms = query_terms(rules)
    rows = docs.select(
        F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.col(quoted(id_col)).alias("key"), text_or_empty(quoted(text_col)).alias("text")
    )
    indexed = {x.rule for x in terms}

    def scanned(some: DataFrame, due) -> DataFrame:
        return some.select("row", "text", _spans(F.col("text"), rules, lambda r: due(r) if r in indexed else F.lit(True)).alias("spans"))

    if not terms:
        return scanned(rows, lambda r: None)
    index = Stash(docs.sparkSession, "secrets").put(inverted_index(docs, terms, quoted(id_col), quoted(text_col)), "index")
    possible = F.lower("text").rlike(any_of(rarest(index, terms)))
    named = rows.where("key is not null").withColumn("possible", possible)
    few = named.where("possible").join(candidates(index, terms), F.col("key") == F.col("id"), "left").select("row", "text", "rules")
    every = F.array(*[F.lit(r) for r in range(len(rules))])
    nameless = rows.where("key is null").select("row", "text", every.alias("rules"))
    return scanned(few.unionByName(nameless), lambda r: F.coalesce(F.array_contains("rules", r), F.lit(False))).unionByName(
        scanned(named.where("not possible"), lambda r: None)
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and its spans, an array of (start, rank, kind, end)."""
    return _with_spans(docs, rules, id_col, text_col).select(F.col("row." + quoted(id_col)).alias("doc_id"), "spans")


def span_digest(scanned: DataFrame) -> DataFrame:
    """Counts and digests of ``scan_secrets``: base kinds are those of ``BASE_RULES``."""
    base = [r.kind for r in BASE_RULES]
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in base],
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mask: str = "[secret]", rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (overlapping spans by one), other columns untouched.

    Texts without a span, null ones too, stay as they are.
    """
    scanned = _with_spans(docs, rules, id_col, text_col)

    def piece(chunks: Column, start: Column, end: Column) -> Column:
        """Characters from start up to end, from the chunks that hold them."""
        a, b = (start / PIECE).cast("int"), (end / PIECE).cast("int")
        first, last = F.coalesce(F.get(chunks, a), F.lit("")), F.coalesce(F.get(chunks, b), F.lit(""))
        across = F.concat(F.substring(first, start % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(last, F.lit(1), end % PIECE))
        return F.when(a == b, F.substring(first, start % PIECE + 1, end - start)).otherwise(across)

    def cut(chunks: Column, reach: Column) -> Column:
        """What stands before each group of overlapping spans, with a mask behind it, and what stands after the last."""
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        opens = F.transform(F.col("spans"), lambda s, i: F.when((i == 0) | (s["start"] >= before(i)), F.struct(before(i).alias("from"), s["start"].alias("to"))))
        parts = F.transform(F.array_compact(opens), lambda o: F.concat(piece(chunks, o["from"], o["to"]), F.lit(mask)))
        return F.concat(F.array_join(parts, ""), piece(chunks, F.get(reach, F.size(reach) - 1), F.char_length("text")))

    chunked = F.regexp_extract_all(F.col("text"), F.lit("(?s).{1,%d}" % PIECE), F.lit(0))
    masked = let(chunked, lambda c: let(running(F.transform("spans", lambda s: s["end"]), F.greatest), lambda r: cut(c, r)))
    text = F.when(F.size("spans") > 0, masked).otherwise(F.col("row." + quoted(text_col)))
    return scanned.select(*[(text if c == text_col else F.col("row." + quoted(c))).alias(c) for c in docs.columns])
