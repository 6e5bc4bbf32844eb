"""Chunks, padded samples and packed blocks of token streams.

Where a cut falls depends on the positions of line ends or word starts only, so the
Arrow UDFs read those positions and return ``[start, stop)`` bounds; tokens are sliced in
the JVM and never leave it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskforge.functions import lexer as L
from maskforge.functions import normalize as N
from maskforge.operators import ordered

BOUNDS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def chunk_bounds(ends: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """T5: bounds of the chunks of a document whose lines end before the positions ``ends``.

    A chunk takes as many whole lines as fit ``limit`` tokens; of a line that does not fit it
    takes the last ``limit`` tokens.  What follows the last line end is no chunk.
    """
    out, start = [], 0
    while len(ends) and start < ends[-1]:
        fit = int(np.searchsorted(ends, start + limit, side="right")) - 1
        if fit >= 0 and ends[fit] > start:
            stop = int(ends[fit])
        else:
            stop = int(ends[fit + 1])
            start = stop - limit
        out.append((start, stop))
        start = stop
    return out


def sample_bounds(cuts: np.ndarray, places: np.ndarray, n: int, size: int) -> list[tuple[int, int]]:
    """Bounds of samples of at most ``size`` tokens.

    ``places`` are the positions of word starts and special tokens, ``cuts`` where a sample
    that reaches them ends.  A full sample ends at the cut of the last such position in it;
    one without a cut behind its start stays whole, and so does the last, shorter one.
    """
    out, start = [], 0
    while start < n:
        stop = min(start + size, n)
        if stop - start == size:
            last = int(np.searchsorted(places, stop)) - 1
            if last >= 0 and cuts[last] > start and places[last] >= start:
                stop = int(cuts[last])
        out.append((start, stop))
        start = stop
    return out


def _where(tokens: Column, test) -> Column:
    return F.filter(F.transform(tokens, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())


def line_chunks(df: DataFrame, tokens: str, limit: int, end: str = "</s>") -> DataFrame:
    """T5: one row per chunk (``chunk`` number, ``piece`` tokens) of the token column."""
    @F.pandas_udf(BOUNDS)
    def bounds(ends: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "stop": b} for a, b in chunk_bounds(np.asarray(e) + 1, limit)] for e in ends])

    df = df.withColumn("__ends", _where(F.col(tokens), lambda t: t == end))
    df = df.select("*", F.posexplode(bounds("__ends")).alias("chunk", "__b"))
    piece = F.slice(tokens, F.col("__b.start") + 1, F.col("__b.stop") - F.col("__b.start"))
    return df.withColumn("piece", piece).drop("__ends", "__b")


def padded_samples(df: DataFrame, tokens: str, word_starts: str, size: int, pad: str = "<pad>",
                   bos: str = "<s>", specials: tuple[str, ...] = ("</s>", "<EOL>")) -> DataFrame:
    """One row per sample (``block`` number, ``sample`` of exactly ``size`` tokens).

    ``word_starts`` holds the positions where a word starts.  A sample is cut before a word
    start or ``bos`` and after another special token.
    """
    @F.pandas_udf(BOUNDS)
    def bounds(n: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        out = []
        for length, b, a in zip(n, before, after):
            if b is None:  # short of a full sample
                out.append([{"start": 0, "stop": int(length)}] if length > 0 else [])
                continue
            places = np.concatenate([np.asarray(b, np.int64), np.asarray(a, np.int64)])
            cuts = np.concatenate([np.asarray(b, np.int64), np.asarray(a, np.int64) + 1])
            order = np.argsort(places, kind="stable")
            found = sample_bounds(cuts[order], places[order], int(length), size)
            out.append([{"start": s, "stop": e} for s, e in found])
        return pd.Series(out)

    # only a full sample is cut, so a row that fills none needs no places
    full = F.size(tokens) >= size
    df = df.withColumn("__after", F.when(full, _where(F.col(tokens), lambda t: t.isin(*specials))))
    df = df.withColumn("__bos", F.when(full, _where(F.col(tokens), lambda t: t == bos)))
    df = df.withColumn("__before", F.when(full, F.array_except(F.array_union(word_starts, "__bos"), "__after")))
    df = df.select("*", F.posexplode(bounds(F.size(tokens), "__before", "__after")).alias("block", "__b"))
    cut = F.slice(tokens, F.col("__b.start") + 1, F.col("__b.stop") - F.col("__b.start"))
    return df.withColumn("sample", F.concat(cut, F.array_repeat(F.lit(pad), F.lit(size) - F.size(cut)))).drop(
        "__after", "__bos", "__before", "__b")


def packed_blocks(df: DataFrame, order: str, tokens: str, size: int, shards: int) -> DataFrame:
    """T6 over T8's contiguous shards: ``(shard, block_id, tokens)``.

    The token stream in ``order`` is cut into ``shards`` equal runs (the remainder goes), each
    run into blocks of ``size`` tokens; a run's last block goes even when it is full.  A
    document contributes one slice to each block it touches, so a block gathers ``size``
    tokens and no more.
    """
    # held: the filter on their number would be pushed below and make the tokens twice
    sized = L.held(df.select(order, F.col(tokens).alias("__t")), "__t", F.col("__t"))
    sized = sized.select(order, "__t", F.size("__t").cast("long").alias("__n")).where("__n > 0")
    sized = ordered.stage(sized.withColumn("__row", F.monotonically_increasing_id()), "token-rows")
    # only numbers are ranged and added up; the tokens move once, to their places
    places = ordered.cumulative(sized.select(order, "__row", "__n"), [], [order, "__row"], sums=["__n"])
    total = places.agg(F.max("run___n")).first()[0] or 0  # one number
    run = total // shards
    if run == 0:
        return df.sparkSession.createDataFrame([], "shard bigint, block_id bigint, tokens array<string>")
    begin = F.col("run___n") - F.col("__n")
    last = F.least(F.col("run___n"), F.lit(run * shards))
    # units: a run has ceil(run / size) of them, the last one possibly short
    per = -(-run // size)
    unit = lambda at: F.floor(at / run) * per + F.floor(F.pmod(at, F.lit(run)) / size)
    placed = sized.select("__row", "__t").join(places.select("__row", "__n", "run___n"), "__row")
    placed = placed.where(begin < run * shards).withColumn("__u", F.explode(F.sequence(unit(begin), unit(last - 1))))
    shard, block = F.floor(F.col("__u") / per), F.pmod("__u", F.lit(per))
    lo = shard * run + block * size
    hi = F.least(lo + size, (shard + 1) * run)
    first = F.greatest(begin, lo)
    piece = F.slice("__t", (first - begin + 1).cast("int"), (F.least(last, hi) - first).cast("int"))
    pieces = placed.select(shard.alias("shard"), block.alias("block_id"), first.alias("__at"), piece.alias("__p"))
    pieces = pieces.where(F.col("block_id") * size < run - size)
    return pieces.groupBy("shard", "block_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("__at", "__p"))), lambda x: x["__p"])).alias("tokens"))


def task_examples(rows: DataFrame) -> DataFrame:
    """T1 for tasks: ``(id, source, target)`` of rows ``(input, gt, id, row_id)``.  ``<EOL>`` becomes
    a line end and blanks collapse in the source; a row without an id has its row number; rows with
    an empty source go."""
    words = N.js_trim(F.regexp_replace(F.replace("input", F.lit("<EOL>"), F.lit(" </s> ")), N.JS_SPACE + "+", " "))
    return rows.select(F.coalesce("id", "row_id").alias("id"), words.alias("source"), F.col("gt").alias("target")).where(
        F.length("source") > 0)


def fixed_line(line: Column, training: bool) -> Column:
    """Blanks around every ``<EOL>`` and a leading ``<s>``; in training lines a last ``<EOL>``
    goes and ``</s>`` is added."""
    s = N.js_trim(F.replace(N.js_trim(line), F.lit("<EOL>"), F.lit(" <EOL> ")))
    s = F.when(s.startswith("<s>"), s).otherwise(F.concat(F.lit("<s> "), s))
    if training:
        s = F.when(s.endswith("<EOL>"), N.js_trim(s.substr(F.lit(1), F.length(s) - 5))).otherwise(s)
        s = F.concat(s, F.lit(" </s>"))
    return s
