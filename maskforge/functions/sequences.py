"""Sequence primitives on token arrays, as bounds per row.

A token array is an ARRAY<STRUCT<type, value>>; places are numbered from 0.  Every primitive is one
pass of built-in array functions inside the row's projection, so a corpus is matched without a
shuffle and without a token leaving the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _is(token: Column, kind: str, value: str | None) -> Column:
    same = token["type"] == kind
    return same if value is None else same & (token["value"] == value)


def typed_prefix(tokens: Column, kinds: list[str], start: Column | int = 0) -> Column:
    """The first ``len(kinds)`` tokens from ``start`` on if their classes are ``kinds`` in order,
    else an empty array (too few tokens as well).  No kinds: an empty array."""
    start = F.lit(start) if isinstance(start, int) else start
    head = F.slice(tokens, start + 1, len(kinds)) if kinds else F.slice(tokens, 1, 0)
    wanted = F.array(*[F.lit(k) for k in kinds]).cast("array<string>")
    return F.when(F.transform(head, lambda t: t["type"]) == wanted, head).otherwise(F.slice(tokens, 1, 0))


def places(tokens: Column, kind: str, value: str | None = None) -> Column:
    """Ascending places of a token."""
    found = F.transform(tokens, lambda t, i: F.when(_is(t, kind, value), i))
    return F.filter(found, lambda i: i.isNotNull())


def between(tokens: Column, left: tuple[str, str], right: tuple[str, str], start: Column | int = 0) -> Column:
    """STRUCT<left, right>: places of the first ``left`` token from ``start`` on and of the first
    ``right`` token after it, or the array's size where none follows; null without a ``left``."""
    start = F.lit(start) if isinstance(start, int) else start
    at = F.get(F.filter(places(tokens, *left), lambda i: i >= start), 0)
    end = F.coalesce(F.get(F.filter(places(tokens, *right), lambda i: i > at), 0), F.size(tokens))
    return F.when(at.isNotNull(), F.struct(at.alias("left"), end.alias("right")))


def inner(tokens: Column, bounds: Column) -> Column:
    """The tokens strictly between the places of :func:`between`; null without bounds."""
    return F.slice(tokens, bounds["left"] + 2, F.greatest(bounds["right"] - bounds["left"] - 1, F.lit(0)))


def split_on(tokens: Column, kind: str, value: str) -> Column:
    """ARRAY<STRUCT<from, to>>: bounds (end exclusive) of the parts between the given tokens.
    There is one part more than such tokens; parts may be empty."""
    at = places(tokens, kind, value)
    starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda i: i + 1))
    ends = F.concat(at, F.array(F.size(tokens)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("from"), b.alias("to")))


def part(tokens: Column, bounds: Column) -> Column:
    """The tokens of one part of :func:`split_on`."""
    return F.slice(tokens, bounds["from"] + 1, bounds["to"] - bounds["from"])
