"""Type slots of code, counted on one character per token.

A file's tokens without blanks become a string (declaration keyword ``V``, ``function``
``F``, other names ``i``, the five punctuators that matter, anything else ``o``), so that
counting is a few regular-expression scans in the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskforge.functions import lexer as L
from maskforge.functions import values as V
from maskforge.operators import ordered
from maskforge.session import small_batches

_NAME = "[iVF]"


def slot_code(text: Column) -> Column:
    """One character per significant token (comments count as tokens) of a folded text."""
    def code(t):
        name, value = t["type"] == L.IDENTIFIER, t["value"]
        return (F.when(t["type"].isin(L.WHITESPACE, L.LINE_TERMINATOR), F.lit(""))
                .when(name & value.isin("const", "let", "var"), F.lit("V"))
                .when(name & (value == "function"), F.lit("F")).when(name, F.lit("i"))
                .when((t["type"] == L.PUNCTUATOR) & value.isin(":", ",", "(", ")"), value).otherwise(F.lit("o")))

    return F.array_join(F.transform(L.tokenize(text), code), "")


def _codes() -> V.Codes:
    """:func:`slot_code` of whole token arrays, in Python."""
    classes = dict.fromkeys(V.CLASSES, "o") | {L.WHITESPACE: "", L.LINE_TERMINATOR: "", L.IDENTIFIER: "i"}
    return V.Codes({c: c for c in ":,()"} | dict.fromkeys(("const", "let", "var"), "V") | {"function": "F"}, classes)


_CODES = _codes()


@F.pandas_udf(T.StringType())
def _code_udf(values: pd.Series) -> pd.Series:
    return pd.Series([_CODES.of(v) for v in values], dtype=object)


def with_slots(df: DataFrame, text: str) -> DataFrame:
    """Adds ``potential`` and ``annotations``.

    A declaration keyword is a slot, annotated when name, colon and name follow.  A
    ``function`` with a bracket somewhere after it has a slot for each parameter up to the
    closing bracket, annotated alike, and one for its return type, which counts as given when
    any colon comes later."""
    small_batches(df.sparkSession)
    df = L.with_token_values(df, text, "__values").withColumn("__code", _code_udf("__values")).drop("__values")
    code = F.col("__code")
    between = F.regexp_extract_all(code, F.lit(r"F(?=[^(]*\(([^)]*))"), F.lit(1))
    params = F.flatten(F.transform(F.filter(between, lambda b: b != ""), lambda b: F.split(b, ",")))
    typed = F.size(F.filter(params, lambda p: p.rlike(f"^{_NAME}:{_NAME}")))
    potential = F.regexp_count(code, F.lit("V")) + F.size(params) + F.size(between)
    annotations = (F.regexp_count(code, F.lit(f"V(?={_NAME}:{_NAME})")) + typed
                   + F.regexp_count(code, F.lit(r"F(?=[^(]*\([^)]*\)[^:]*:)")))
    return (df.withColumn("potential", potential.cast("bigint"))
            .withColumn("annotations", annotations.cast("bigint")).drop("__code"))


def explicitness(annotations: Column, potential: Column) -> Column:
    """Share of annotated slots in percent, two decimals; null without slots."""
    return F.round(100.0 * annotations / F.when(potential > 0, potential), 2)


def running_explicitness(slots: DataFrame, order: str, every: int = 10_000) -> DataFrame:
    """Running totals and percentage over files in ``order``, every ``every`` files and
    at the end."""
    run = ordered.cumulative(slots, [], [order], ["annotations", "potential"], count_col="files")
    last = slots.count()  # one number
    run = run.where((F.col("files") % every == 0) | (F.col("files") == last))
    return run.select("files", F.col("run_annotations").alias("annotations"), F.col("run_potential").alias("potential"),
                      explicitness(F.col("run_annotations"), F.col("run_potential")).alias("explicitness"))
