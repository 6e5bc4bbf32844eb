"""Potential-type spans, and P14 function-body bounds.

Grouping "potential types" is an ordered fold with global bracket depths that are
never reset and a rescan after an unterminated span, so it is not a regular
language.  The fold runs in an Arrow-batched pandas UDF, but only over the compact
list of bracket/terminator punctuators of each document (index + value), which the
JVM extracts; the UDF returns span bounds, and the JVM regroups the tokens.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskforge.functions import lexer as L

# --- fixed values -----------------------------------------------------------
OPENERS = "{<[("
CLOSERS = "}>])"
TERMINATORS = "=,;"
# ---------------------------------------------------------------------------
RELEVANT = tuple(OPENERS + CLOSERS + TERMINATORS + ":")
_STEP = dict.fromkeys(RELEVANT, 0) | {c: 1 << 32 * i for i, c in enumerate(OPENERS)} | {
    c: -(1 << 32 * i) for i, c in enumerate(CLOSERS)}


def fold_spans(idx, vals) -> list[int]:
    """Flat [start, end, start, end, ...] token-index spans (inclusive).

    A span starts at a ``:`` and ends before the first ``=``, ``,`` or ``;`` found while
    every bracket depth is zero; closers only lower a depth (they never end a span).  Depths
    carry over from a span that never ended, after which the next ``:`` may start one.

    Brackets count inside spans only, so the depths at a place are those at the span's start
    plus the difference of running totals; the place that brings all to zero is looked up
    among the terminators by its running total.
    """
    # the four depths are fields of one number, so they add up together
    total = list(accumulate(map(_STEP.__getitem__, vals), initial=0))
    ends: dict[int, list[int]] = {}
    for m, v in enumerate(vals):
        if v in TERMINATORS:
            ends.setdefault(total[m], []).append(m)
    out: list[int] = []
    depth, after = 0, 0
    for k, v in enumerate(vals):
        if v != ":" or k < after:
            continue
        found = ends.get(total[k] - depth, ())
        at = bisect_right(found, k)
        if at < len(found):
            out += (int(idx[k]), int(idx[found[at]]) - 1)
            depth, after = 0, found[at]
        else:
            depth += total[-1] - total[k]
    return out


def span_heads(n: int, spans: list[int]) -> np.ndarray:
    """For each of ``n`` tokens: the last token of the span it starts, its own number if it
    is in no span, -1 inside a span."""
    out = np.arange(n)
    for s, e in zip(spans[::2], spans[1::2]):
        out[s + 1:e + 1] = -1
        out[s] = e
    return out


#: a token as one character: its bracket or terminator, a line end, maskable or other
MASKABLE_CODE, OTHER_CODE, LINE_CODE = "m", "o", "n"
_PLAIN_CODES = MASKABLE_CODE + OTHER_CODE + LINE_CODE


def token_code(tok: Column) -> Column:
    return (F.when((tok["type"] == L.PUNCTUATOR) & tok["value"].isin(*RELEVANT), tok["value"])
            .when(tok["type"] == L.LINE_TERMINATOR, F.lit(LINE_CODE))
            .when(L.is_maskable(tok), F.lit(MASKABLE_CODE)).otherwise(F.lit(OTHER_CODE)))


def value_code(v: Column) -> Column:
    """:func:`token_code` of a token text; its class is not named on the way."""
    def code(cls):
        if cls == L.PUNCTUATOR:
            return F.when(v.isin(*RELEVANT), v).otherwise(F.lit(MASKABLE_CODE))
        return F.lit(LINE_CODE if cls == L.LINE_TERMINATOR else MASKABLE_CODE if cls in L.MASKABLE else OTHER_CODE)

    return L.classify(v, code)


def value_codes():
    """:func:`value_code` of whole token arrays, in Python."""
    from maskforge.functions import values as V
    classes = {c: LINE_CODE if c == L.LINE_TERMINATOR else MASKABLE_CODE if c in L.MASKABLE else OTHER_CODE for c in V.CLASSES}
    return V.Codes({v: v for v in RELEVANT}, classes)


def code_spans(code: str) -> list[int]:
    """Spans of a token-code string."""
    if ":" not in code:
        return []
    idx = [i for i, c in enumerate(code) if c not in _PLAIN_CODES]
    return fold_spans(idx, [code[i] for i in idx])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _heads_udf(code: pd.Series) -> pd.Series:
    return pd.Series([span_heads(len(c), code_spans(c)).astype(np.int32) for c in code])


def with_grouped_tokens(df, content: str, out: str):
    """``out``, the tokens of ``content`` with each potential-type span as one token."""
    df = L.with_tokens(df, content, "__tk")
    df = df.withColumn("__va", F.transform("__tk", lambda t: t["value"]))
    df = df.withColumn("__hd", _heads_udf(F.array_join(F.transform("__tk", token_code), "")))
    each = F.filter(F.zip_with("__tk", F.transform("__hd", lambda h, i: F.struct(i.alias("i"), h.alias("h"))),
                               lambda t, h: F.struct(t.alias("t"), h.alias("h"))), lambda x: x["h"]["h"] >= 0)
    grouped = F.transform(each, lambda x: F.when(
        x["h"]["h"] > x["h"]["i"], F.struct(F.lit(L.POTENTIAL_TYPE).alias("type"), F.array_join(
            F.slice("__va", x["h"]["i"] + 1, x["h"]["h"] - x["h"]["i"] + 1), "").alias("value"))).otherwise(x["t"]))
    return df.withColumn(out, grouped).drop("__tk", "__va", "__hd")


def function_body_bounds(tokens: Column) -> Column:
    """STRUCT<start INT, end INT> of the last balanced ``{...}`` (token indices).

    ``end`` is the last ``}``; ``start`` is the ``{`` where the brace depth, counted
    from the right, returns to zero.  Null when there is no ``}``.
    """
    found = F.filter(
        F.transform(tokens, lambda t, i: F.when(
            (t["type"] == L.PUNCTUATOR) & t["value"].isin("{", "}"),
            F.struct(i.alias("i"), F.when(t["value"] == "}", 1).otherwise(-1).alias("d")))),
        lambda x: x.isNotNull())

    def bounds(rev):
        # running depth from the right; the opener that brings it back to 0 is the start
        depth = F.aggregate(
            rev, F.struct(F.lit(0).alias("d"), F.lit(-1).alias("start")),
            lambda acc, x: F.when(acc["start"] >= 0, acc).otherwise(
                F.struct((acc["d"] + x["d"]).alias("d"),
                         F.when((x["d"] < 0) & (acc["d"] + x["d"] == 0), x["i"])
                         .otherwise(F.lit(-1)).alias("start"))))
        end = F.get(F.filter(rev, lambda x: x["d"] > 0), 0)["i"]
        return F.when(end.isNotNull(), F.struct(depth["start"].alias("start"), end.alias("end")))

    return L.once(F.reverse(found), bounds)
