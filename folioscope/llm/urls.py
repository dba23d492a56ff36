"""URL filters with redirect equivalence.

Host and path rules judge a URL by themselves: a rule fits its host and all subdomains
where the path starts with the rule's, and the longest fitting rule wins. Pages that no
rule judges take the decision of their alias class: the connected component over redirect
(``meta refresh``) and canonical-link edges of the pages' HTML. In a class, an explicit
allow goes before any block; a class without a judged page allows.

Cases: a null URL or one without ``://`` has empty host and path, joins no class and is
allowed unless a rule fits; null HTML has no edge; repeated URLs are one node; pages that
only others link to count as nodes and are judged by the rules like any; an empty table
gives an empty result; relative addresses are resolved against the page's ``<base>`` or else its own; links
inside comments are none, nor are tags longer than ``TAG_CHARS``; very long HTML is searched whole, in time
that follows its length. Rules are few by contract and sent as literals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import connected_components
from folioscope.llm.util import Stash, let


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed by the query's contract.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``, else null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """(name, verdict) of the longest rule that fits, else null; equal lengths: the longer host."""
    out: Column = F.lit(None).cast("struct<name: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        on_host = (host == rule.host) | host.endswith("." + rule.host)
        mine = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(on_host & path.startswith(rule.path), mine).otherwise(out)
    return out


#: A tag is searched for its end so far at most and not beyond another one's begin, so a search takes time by its text's length.
TAG_CHARS = 4096
#: One attribute of a tag; quoted values are part of it, so names inside them are none.
ATTRIBUTE = r"""[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))?"""


def _without_comments(html: Column) -> Column:
    """A comment ends at its first ``-->``, or at once; one that never ends takes the rest."""

    def rest(part: Column, k: Column) -> Column:
        end = F.instr(part, "-->")
        short = F.when(part.startswith(">"), 1).when(part.startswith("->"), 2).when(end > 0, end + 2)
        return F.when(k == 0, part).when(short.isNull(), F.lit("")).otherwise(F.substring(part, short + 1, F.char_length(part)))

    cut = F.array_join(F.transform(F.split(html, "<!--", -1), rest), "")
    return F.when(F.contains(html, F.lit("<!--")), cut).otherwise(html)


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}(?=[\s/])[^<>]{{0,{TAG_CHARS}}}>"), F.lit(0))


def _attribute(tag: Column, name: str) -> Column:
    """The value of the tag's first attribute of that name; null without one."""
    found = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda x: x.rlike(rf"(?i)^{name}\s*="))
    value = F.regexp_replace(F.get(found, F.lit(0)), r"^[^=]*=\s*", "")
    quoted = value.startswith('"') | value.startswith("'")
    return F.trim(F.when(quoted, F.substring(value, F.lit(2), F.char_length(value) - 2)).otherwise(value))


def _targets(html: Column) -> Column:
    """(base, addresses): the page's ``<base>`` or null, and what it names as its canonical form or sends its readers to."""

    def of(text: Column) -> Column:
        canonical = F.filter(_tags(text, "link"), lambda t: F.coalesce(F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"), F.lit(False)))
        refresh = F.filter(_tags(text, "meta"), lambda t: F.coalesce(F.lower(_attribute(t, "http-equiv")) == "refresh", F.lit(False)))
        sent = F.transform(refresh, lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?i)\burl\s*=\s*['"]?([^"'>\s]+)""", 1))
        base = F.get(F.filter(F.transform(_tags(text, "base"), lambda t: _attribute(t, "href")), lambda x: x != ""), F.lit(0))
        named = F.filter(F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), sent), lambda x: x != "")
        return F.struct(base.alias("base"), named.alias("named"))

    return let(_without_comments(html), of)


def _node(url: Column) -> Column:
    """URLs are one node if they differ in their fragment only, or in the case of scheme and host."""

    def of(u: Column) -> Column:
        scheme = F.lower(F.substring_index(u, "://", 1))
        after = F.regexp_extract(_rest(u), r"^[^/?#]*([^#]*)", 1)
        return F.when(F.instr(u, "://") > 0, F.concat(scheme, F.lit("://"), host_of(u), after))

    return let(url, of)


def _folded(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments, from its first slash."""

    def step(kept: Column, part: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    def of(parts: Column) -> Column:
        last = F.get(parts, F.size(parts) - 1)
        kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
        return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))

    return let(F.split(path, "/", -1), of)


def _resolved(target: Column, base: Column) -> Column:
    """The target as an address of its own: absolute, or resolved against the page's; null for other schemes and bare fragments."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    root = F.concat(F.substring_index(base, "://", 1), F.lit("://"), host_of(base))
    path = F.when(path_of(base) == "", "/").otherwise(path_of(base))
    query = F.regexp_extract(target, r"^[^?#]*([^#]*)", 1)
    own = F.regexp_extract(target, r"^([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | target.startswith("#"), F.lit(None))
        .when(target.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, _folded(own), query))
        .when(target.startswith("?"), F.concat(root, path, query))
        .otherwise(F.concat(root, _folded(F.concat(folder, own)), query))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes that are aliases by a redirect or a canonical link."""
    linked = pages.where("instr(url, '://') > 0 and html is not null").where(
        F.expr("html ilike '%canonical%' or html ilike '%refresh%'")
    )
    found = linked.select("url", _targets(F.col("html")).alias("t"))
    based = found.select("url", F.coalesce(_resolved(F.col("t.base"), F.col("url")), "url").alias("base"), F.explode("t.named").alias("target"))
    return based.select(_node(F.col("url")).alias("a"), _node(_resolved(F.col("target"), F.col("base"))).alias("b")).where("b is not null").distinct()


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, alias_class (null outside any class).

    ``edges`` (a, b as URLs) can name further redirects, such as a crawler's log.
    """
    stash = Stash(pages.sparkSession, "urls")
    fit = let(F.col("url"), lambda u: let(F.struct(host_of(u).alias("h"), path_of(u).alias("p")), lambda x: rule_for(x["h"], x["p"], rules)))
    seen = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), _node(F.col("url")).alias("node"), fit.alias("fit")
    )
    links = link_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(_node(F.col("a")).alias("a"), _node(F.col("b")).alias("b")))
    members = stash.put(connected_components(links), "classes")
    judged = members.withColumnRenamed("node", "url").withColumn("fit", fit)
    decided = judged.groupBy("component").agg(
        F.when(F.bool_or(F.col("fit.verdict") == "allow"), "allow").when(F.bool_or(F.col("fit.verdict") == "block"), "block").alias("class_verdict")
    )
    aliases = members.join(decided, "component")
    # pages without a node meet nothing: left out of the join, they don't gather in one task
    named = seen.where("node is not null").join(aliases, "node", "left")
    rows = named.unionByName(seen.where("node is null"), allowMissingColumns=True)
    return rows.select(
        "page_id",
        "host",
        "path",
        F.col("fit.name").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.col("class_verdict"), F.lit("allow")).alias("verdict"),
        F.col("component").alias("alias_class"),
    )
