"""Corpus curation, statistics and variant derivation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskforge.functions import lexer as L


def loc(text: Column) -> Column:
    """Parts after splitting on runs of newlines (blank lines collapse)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\n+")) + F.lit(1)


def corpus_stats(df: DataFrame, by: str, text_col: str, extra: dict | None = None) -> DataFrame:
    """Files and LOC per group; partial aggregation happens map-side."""
    aggs = [F.count(F.lit(1)).alias("files"), F.sum(loc(F.col(text_col))).alias("loc")]
    aggs += [c.alias(n) for n, c in (extra or {}).items()]
    return df.groupBy(by).agg(*aggs)


def repo_count(files: DataFrame) -> DataFrame:
    """Distinct repositories = distinct first path segment."""
    repo = F.split(F.col("path"), "/").getItem(0)
    return files.agg(F.count_distinct(repo).alias("repos"), F.count(F.lit(1)).alias("files"))


def significant_tokens(text: Column) -> Column:
    """Tokens without whitespace and line terminators (comments stay)."""
    return F.filter(L.tokenize(text),
                    lambda x: ~x["type"].isin(L.WHITESPACE, L.LINE_TERMINATOR))


def declaration_slots(t: Column) -> Column:
    """D10 for variable declarations over a materialised token-array column ``t``
    (see :func:`significant_tokens`).

    Returns STRUCT<decls INT, annotated INT>: a ``const``/``let``/``var`` keyword is
    one slot; it is annotated when the next three tokens are identifier, ``:``,
    identifier (comments are not removed first, so a comment breaks the pattern).
    ``t`` must be a column reference: it is indexed inside a lambda.
    """

    def is_decl(x):
        return (x["type"] == L.IDENTIFIER) & x["value"].isin("const", "let", "var")

    def annotated(x, i):
        a, b, c = F.get(t, i + 1), F.get(t, i + 2), F.get(t, i + 3)
        return (is_decl(x) & (a["type"] == L.IDENTIFIER) & (b["type"] == L.PUNCTUATOR)
                & (b["value"] == ":") & (c["type"] == L.IDENTIFIER))

    decls = F.size(F.filter(t, is_decl))
    ann = F.size(F.filter(F.transform(t, lambda x, i: annotated(x, i)), lambda f: f))
    return F.struct(decls.alias("decls"), ann.alias("annotated"))
