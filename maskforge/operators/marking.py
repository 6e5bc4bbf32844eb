"""K1-K8: marker insertion, type variants, marker validation and task assembly.

All per-file work happens inside one row with higher-order functions: the three
type variants of a file are columns of the same row (they are derived from the
marked ``normal`` text), so the cross-variant marker intersection (K5) and the
per-file cap (K6) need no join and no shuffle.  The only exchanges in the task
plan are the ones that build the input corpus itself.

Randomness is replaced by md5 ranking of ``path-seed-...`` keys, which is
partition-independent and reproducible in any engine.
"""

from __future__ import annotations

import re
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskforge import config as C
from maskforge.functions import lexer as L
from maskforge.functions import normalize as N
from maskforge.functions import spans as S
from maskforge.functions import untype
from maskforge.functions import values as V
from maskforge.operators import sampling
from maskforge.session import small_batches

SEED = str(C.RANDOM_SEED)
_MARK = r"(?:/\*<marker:\d+>\*/)?"


def hash_key(*parts: Column | str) -> Column:
    """md5 hex of ``p1-p2-...``; string comparison of these orders like a shuffle."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("-", *[c.cast("string") for c in cols]))


#: a token inside a potential-type span, not its first
_INSIDE = "x"


def marked_places(path: str, code: str) -> tuple[int, int, list[int]]:
    """P12 + K1 for one file: how many non-empty terminated lines it has, how many of them
    hold a maskable token, and the tokens that get a marker, in order.

    ``code`` has a character per token (see ``spans.token_code``).  A potential-type span is
    one token that is not maskable and ends no line; the first and the last token are left
    out; what follows the last line end is no line.
    """
    if not code:
        return 0, 0, []
    spans = S.code_spans(code)
    first, last = 1, len(code) - 1
    if spans:
        # a span becomes one token of another class, its other tokens are passed over
        parts, at = [], 0
        for s, e in zip(spans[::2], spans[1::2]):
            parts += (code[at:s], S.OTHER_CODE, _INSIDE * (e - s))
            at = e + 1
        code = "".join(parts) + code[at:]
        first = spans[1] + 1 if spans[0] == 0 else first
        last = spans[-2] if spans[-1] == last else last
    lines, suitable, begin = 0, [], first
    # what stands behind the last line end is no line
    for piece in code[first:last].split(S.LINE_CODE)[:-1]:
        if piece:
            lines += 1
            if piece.strip(S.OTHER_CODE + _INSIDE):
                suitable.append((begin, piece))
        begin += len(piece) + 1
    n = len(suitable)
    count = min(max(int(n * C.LINE_MASK_CHANCE), 1), n)
    key = f"{path}-{SEED}-line-".encode()
    chosen = sorted(sorted((md5(key + b"%d" % k).digest(), k) for k in range(n))[:count], key=lambda x: x[1])
    picks = []
    for _, k in chosen:
        begin, piece = suitable[k]
        # tokens are numbered with a span as one
        number = begin - code.count(_INSIDE, 0, begin)
        key, best = f"{path}-{SEED}-token-{k}-".encode(), None
        for at, c in enumerate(piece, begin):
            if c == _INSIDE:
                continue
            if c != S.OTHER_CODE:
                found = md5(key + b"%d" % number).digest()
                if best is None or found < best[0]:
                    best = found, at
            number += 1
        picks.append(best[1])
    return lines, n, picks


_CODES = S.value_codes()
_PLACES = T.StructType([T.StructField("lines", T.IntegerType()), T.StructField("suitable", T.IntegerType()),
                        T.StructField("picks", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_PLACES)
def _places_udf(path: pd.Series, values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([marked_places(p, _CODES.of(v)) for p, v in zip(path, values)], columns=["lines", "suitable", "picks"])


def line_places(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``df`` with ``__values`` (token texts) and ``__places`` (see :func:`marked_places`)."""
    small_batches(df.sparkSession)
    df = L.with_token_values(df, content, "__values")
    return df.withColumn("__places", _places_udf(F.col(path).cast("string"), F.col("__values")))


def marked_text(values, picks: list[int]) -> str:
    """The text of ``values`` with a numbered marker before each picked token."""
    parts, last = [], 0
    for i, at in enumerate(picks):
        parts += values[last:at]
        parts.append(C.MARKER_TEMPLATE.format(i=i))
        last = at
    parts += values[last:]
    return "".join(parts)


_MARKED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())])


@F.pandas_udf(_MARKED)
def _marked_udf(path: pd.Series, values: pd.Series) -> pd.DataFrame:
    rows = []
    for p, v in zip(path, values):
        v = list(v)
        picks = marked_places(p, _CODES.of(v))[2]
        rows.append((marked_text(v, picks), len(picks)))
    return pd.DataFrame(rows, columns=["text", "n"])


def add_markers(df: DataFrame, path: str = "path", content: str = "content",
                out: str = "marked") -> DataFrame:
    """K1: insert ``/*<marker:i>*/`` before one maskable token in a hash-chosen
    ``clamp(1, n, floor(0.4 n))`` of the n lines that have a maskable token.

    Markers are numbered from 0 in document order.  Adds ``out`` (marked text) and
    ``n_markers``.  Places are found and the text is joined where the tokens are read.
    """
    small_batches(df.sparkSession)
    df = L.with_token_values(df, content, "__values")
    df = df.withColumn("__marked", _marked_udf(F.col(path).cast("string"), F.col("__values")))
    return df.withColumn(out, F.col("__marked.text")).withColumn("n_markers", F.col("__marked.n")).drop("__values", "__marked")


def add_annotations_for_corpus(text: Column) -> Column:
    """Explicit variant of the derived corpus (stands in for compiler type
    inference, which is an input table in general): strings on ``let s<N>`` and
    numbers on the untyped parameter plus a ``string`` return type."""
    t = F.regexp_replace(text, r"(\blet " + _MARK + r"s\d+)", "$1: string")
    return F.regexp_replace(t, r"(, " + _MARK + r"b)(" + _MARK + r"\))", "$1: number$2: string")


_MARKER = re.compile(r"/\*<marker:[0-9]+>\*/")
_MARKER_AT = re.compile(r"(?=(/\*<marker:[0-9]+>\*/))")
_LINE = re.compile(r"[^\n\r\u2028\u2029]*+")
#: a line of blanks and comments alone
_NO_CODE = re.compile(N.JS_SPACE + r"*+(?:(?:/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/" + N.JS_SPACE + r"*+)*+(?:/[*/].*+)?+)", re.S)


def valid_names(content: str) -> list[str]:
    """:func:`valid_markers` of one text."""
    found, seen, repeated = [], set(), set()
    for m in _MARKER.finditer(content):
        name = m[0]
        (repeated if name in seen else seen).add(name)
        line = _LINE.match(content, m.end())[0]
        if line and not content.startswith(name) and not _NO_CODE.fullmatch(line):
            found.append(name)
    return [m for m in dict.fromkeys(found) if m not in repeated]


def capped(path: str | None, common: list[str], k: int = C.NUM_MARKERS) -> list[str]:
    """K6: at most ``k`` markers per file, hash-chosen, original order kept."""
    if len(common) <= k:
        return common
    head = "" if path is None else path + "-"
    ranked = sorted(range(len(common)), key=lambda i: (md5(f"{head}{SEED}-{common[i]}".encode()).hexdigest(), i))
    return [common[i] for i in sorted(ranked[:k])]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _valid_udf(content: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else valid_names(c) for c in content], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _common_udf(path: pd.Series, *variants: pd.Series) -> pd.Series:
    out = []
    for p, first, *others in zip(path, *variants):
        if first is None or None in others:
            out.append(None)
            continue
        common = valid_names(first)
        for text in others:
            also = set(valid_names(text))
            common = [m for m in common if m in also]
        out.append(capped(p, common))
    return pd.Series(out, dtype=object)


def truth_lines(text: str, common: list[str]) -> list[str] | None:
    """The line after each of the ``common`` markers in order of the text, cut at the next of them; None where
    a marker is not found once or a line is empty."""
    known, places = set(common), []
    last = 0
    for m in _MARKER_AT.finditer(text):
        if m[1] in known and m.start() >= last:
            last = m.end(1)
            places.append((m.start(), last))
    if len(places) != len(common):
        return None
    ends = [s for s, _ in places[1:]] + [len(text)]
    lines = [_LINE.match(text, begin, end)[0] for (_, begin), end in zip(places, ends)]
    return lines if all(lines) else None


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _truths_udf(common: pd.Series, *variants: pd.Series) -> pd.Series:
    out = []
    for names, *texts in zip(common, *variants):
        # a file's variants stand in one row, so a truth missing in one of them is seen before the explode
        each = [truth_lines(t, list(names)) for t in texts] if names is not None and len(names) else [None]
        out.append(None if None in each else each)
    return pd.Series(out, dtype=object)


def valid_markers(content: Column) -> Column:
    """K2-K4: distinct markers that occur once, with a non-empty left context and
    a non-empty ground truth (first line after it, comments removed, trimmed)."""
    return _valid_udf(content)


def variant_frame(spark_df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Marked ``normal`` text plus derived ``explicit`` and ``untyped`` variants, in one pass over the files."""
    marked = add_markers(spark_df, path, content, "normal").select(path, "normal")
    wide = untype.with_untyped(L.held(marked, "normal", F.col("normal")), "normal", "untyped")
    return L.held(wide, "explicit", add_annotations_for_corpus(F.col("normal"))).select(path, "normal", "explicit", "untyped")


def test_files(files: DataFrame, path: str = "path") -> DataFrame:
    """K9: the files of the test split; completion tasks are made from these only."""
    return files.where(sampling.weighted_split(F.col(path)) == "test")


def common_markers(wide: DataFrame, path: str = "path",
                   variants=C.TYPE_VARIANTS) -> DataFrame:
    """K2-K6: per file, markers valid in every variant, capped at NUM_MARKERS."""
    small_batches(wide.sparkSession)
    return wide.withColumn("common", _common_udf(F.col(path).cast("string"), *[F.col(v) for v in variants]))


def raw_tasks(wide: DataFrame, path: str = "path", variants=C.TYPE_VARIANTS) -> DataFrame:
    """K3/K7 before normalisation: one row per (path, variant) with the token texts ``tokens`` of the variant,
    its ``markers`` and the token texts of their raw ground ``truths``; a file with an empty truth in any
    variant contributes nothing.

    The model input of a task is what stands before its marker without the other markers,
    so it is a prefix of the tokens and the text is tokenised once per variant.
    """
    w = common_markers(wide, path, variants)
    w = w.withColumn("__lines", _truths_udf(F.col("common"), *[F.col(v) for v in variants]))
    made = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("text"), F.get("__lines", i).alias("lines"))
                     for i, v in enumerate(variants)])
    rows = w.select(path, F.col("common").alias("markers"), F.explode(F.when(F.col("__lines").isNotNull(), made)).alias("v"))
    rows = rows.select(path, "v.variant", "markers", F.col("v.text").alias("__text"), F.col("v.lines").alias("__lines"))
    rows = L.with_token_values(rows, "__text", "tokens").drop("__text")

    def truth(line):  # a line without a slash has no comment
        return N.js_trim(F.when(line.contains("/"), L.remove_comments(line)).otherwise(line))

    rows = L.held(rows, "__gts", F.transform("__lines", truth))
    return L.held(rows, "truths", F.transform("__gts", L.token_values)).select(path, "variant", "tokens", "markers", "truths")


#: characters of tasks in one Arrow batch that goes back to the JVM
_OUT_CHARS = 4 << 20


def _text_lists(column) -> list[list[str]]:
    """A list column of texts, row by row."""
    flat, ends = column.flatten().to_pylist(), np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    return [flat[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _grid_rows(tokens: list[str], markers: list[str], truths, literals: bool, masks) -> list[tuple[int, str, list[str]]]:
    """``(ordinal, marker, inputs and truths by class)`` of every task of a text."""
    places: dict[str, int] = {}
    for i, v in enumerate(tokens):
        if v.startswith("/*<"):
            places.setdefault(v, i)
    inputs = V.ClassTexts(tokens, literals, masks).heads([places.get(m, 0) for m in markers])
    return [(j, m, [*[texts[j] for texts in inputs], *V.ClassTexts(truths[j], literals, masks).whole()])
            for j, m in enumerate(markers)]


def task_grids(raw: DataFrame, replace_literals: bool = True, classes=C.COMMENT_CLASSES) -> DataFrame:
    """K7/K8 with a row per task: ``grid`` has its ``comments``, normalised ``input`` and ``gt`` of every
    comment class.

    The tokens of a text are rendered once and filtered once per comment class; the input of a task is what the
    tokens before its marker make of that.  Rows go back in batches of some ``_OUT_CHARS``."""
    small_batches(raw.sparkSession)
    keys = [c for c in raw.columns if c not in ("tokens", "markers", "truths")]
    masks = [mask for _, mask in classes]
    schema = T.StructType([raw.schema[c] for c in keys] + [
        T.StructField("ordinal", T.IntegerType()), T.StructField("marker", T.StringType()),
        T.StructField("__texts", T.ArrayType(T.StringType()))])

    def made(batch, rows):
        at = pa.array([r for r, _ in rows], pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column(c).take(at) for c in keys] + [
                pa.array([t[0] for _, t in rows], pa.int32()), pa.array([t[1] for _, t in rows], pa.string()),
                pa.array([t[2] for _, t in rows], pa.list_(pa.string()))], names=[*keys, "ordinal", "marker", "__texts"])

    def run(batches):
        for batch in batches:
            column = {c: batch.column(c) for c in ("tokens", "markers", "truths")}
            truths = iter(_text_lists(column["truths"].flatten()))
            rows, chars = [], 0
            for r, (tokens, markers) in enumerate(zip(_text_lists(column["tokens"]), _text_lists(column["markers"]))):
                for task in _grid_rows(tokens, markers, [next(truths) for _ in markers], replace_literals, masks):
                    rows.append((r, task))
                    chars += sum(map(len, task[2]))
                    if chars > _OUT_CHARS:
                        yield made(batch, rows)
                        rows, chars = [], 0
            if rows:
                yield made(batch, rows)

    grids = raw.mapInArrow(run, schema)
    texts, n = F.col("__texts"), len(classes)
    grid = F.array(*[F.struct(F.lit(name).alias("comments"), F.get(texts, i).alias("input"), F.get(texts, n + i).alias("gt"))
                     for i, (name, _) in enumerate(classes)])
    return grids.select(*keys, "ordinal", "marker", grid.alias("grid"))


def tasks(raw: DataFrame, replace_literals: bool = True, classes=C.COMMENT_CLASSES) -> DataFrame:
    """K7/K8: normalised ``input`` and ``gt`` of every task for every comment class."""
    grids = task_grids(raw, replace_literals, classes)
    keys = [c for c in grids.columns if c != "grid"]
    return grids.select(*keys, F.explode("grid").alias("c")).select(*keys, "c.comments", "c.input", "c.gt")
