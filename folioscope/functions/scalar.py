"""Scalar helpers, built-in expressions but for Unicode's composed form, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def task_key(*parts: Column) -> Column:
    """An idempotent key of a task's resource, fingerprint, pipeline version and kind; nulls keep their place."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]), 256)


def row_digest(df: DataFrame) -> Column:
    """A 64-bit hash of the whole row, nulls and order of columns included."""
    return F.xxhash64(*[F.struct(F.col(f"`{c}`")) for c in df.columns], *[F.col(f"`{c}`").isNull() for c in df.columns])


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for a zero vector or different lengths."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    length = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)


def snippet(text: Column, needle: Column, around: int) -> Column:
    """The needle with up to ``around`` characters on either side; null if it is not there."""
    at = F.instr(text, needle)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.char_length(needle) + around))


def normalise(text: Column) -> Column:
    """Line ends to \\n, runs of spaces and tabs to one space, spaces at line ends and outer blank lines off."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(lines, r" *\n *", "\n"), r"^\s+|\s+$", "")


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normal_form(text: Column) -> Column:
    """Unicode's composed form; texts of ASCII alone never leave the JVM's side of the expression."""
    plain = text.rlike("^[\\x00-\\x7F]*$")
    return F.when(plain, text).otherwise(_composed(F.when(~plain, text)))


def blank(text: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)) == 0, F.lit(True))


def retryable(error_class: Column) -> Column:
    """Network trouble and timeouts may be tried again; wrong parameters or missing rights may not."""
    return F.coalesce(F.lower(error_class).isin("network", "timeout", "rate_limit", "unavailable"), F.lit(False))
