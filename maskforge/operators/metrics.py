"""Pairing, normalisation and per-row completion metrics, plus rollups.

Exact match, emptiness, token projection and the rollups are built-in
expressions.  Edit similarity, BLEU-4, ROUGE-L and METEOR need a per-row
dynamic programme or greedy alignment; they run in one Arrow-batched pandas UDF
(bit-parallel LCS on Python integers), the only Python in the evaluation plan.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskforge.functions import lexer as L
from maskforge.functions import normalize as N
from maskforge.functions.stem import stem
from maskforge.session import small_batches


def lcs_len(a, b) -> int:
    """Length of the longest common subsequence (bit-parallel, O(|a|·|b|/w))."""
    if len(a) == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def edit_similarity(a: str, b: str) -> float:
    """Indel similarity: (|a|+|b|-d)/(|a|+|b|) with substitution cost 2 = 2·LCS/(|a|+|b|)."""
    tot = len(a) + len(b)
    return 1.0 if tot == 0 else 2.0 * lcs_len(a, b) / tot


def rouge_l(ref, hyp) -> float:
    if len(ref) == 0 or len(hyp) == 0:
        return 0.0
    m = lcs_len(ref, hyp)
    p, r = m / len(hyp), m / len(ref)
    return 0.0 if p + r == 0 else 2 * p * r / (p + r)


def bleu4(ref, hyp) -> float:
    """Sentence BLEU-4, one reference; add-one smoothing on n >= 2 only; 0 without
    a unigram match; brevity penalty exp(1 - r/c) when c < r."""
    ref, hyp = list(ref), list(hyp)
    nums = []
    for n in range(1, 5):
        if n > 1 and not nums[-1]:
            nums.append(0)  # without a common gram there is no longer one
            continue
        r: dict = {}
        for g in zip(*[ref[i:] for i in range(n)]):
            r[g] = r.get(g, 0) + 1
        found = 0
        for g in zip(*[hyp[i:] for i in range(n)]):
            left = r.get(g)
            if left:
                found += 1
                r[g] = left - 1
        nums.append(found)
        if not found and n == 1:
            return 0.0
    dens = [max(1, len(hyp) - n) for n in range(4)]
    c, rl = len(hyp), len(ref)
    bp = 1.0 if c > rl else (0.0 if c == 0 else math.exp(1 - rl / c))
    logs = [math.log(nums[0] / dens[0])]
    logs += [math.log((nums[i] + 1) / (dens[i] + 1)) for i in range(1, 4)]
    return bp * math.exp(sum(0.25 * x for x in logs))


def _paired(hyp: list, ref: list, to: list[int], keys) -> None:
    """One alignment stage: free words with an equal key are paired, later words first, each with
    the last free place of its key.  ``keys`` gives a word's keys; it may have several."""
    free: dict = {}
    taken = {place for place in to if place >= 0}
    for place, word in enumerate(ref):
        if place not in taken:
            for key in keys(word):
                free.setdefault(key, []).append(place)
    if not free:
        return
    for place in range(len(hyp) - 1, -1, -1):
        if to[place] >= 0:
            continue
        best = -1
        for key in keys(hyp[place]):
            places = free.get(key, [])
            while places and places[-1] in taken:
                places.pop()
            best = max(best, places[-1] if places else -1)
        if best >= 0:
            to[place] = best
            taken.add(best)


def _same_words(hyp: list, ref: list) -> list[int]:
    """The stage of equal words: a word has one key, so places are taken from the end of its list."""
    free: dict = {}
    for place, word in enumerate(ref):
        free.setdefault(word, []).append(place)
    to = [-2] * len(hyp)
    for place in range(len(hyp) - 1, -1, -1):
        places = free.get(hyp[place])
        if places:
            to[place] = places.pop()
    return to


def meteor(ref, hyp, synonyms: dict | None = None, stems: bool = True, alpha=0.9, beta=3.0, gamma=0.5) -> float:
    """METEOR of lower-cased words, aligned in stages: equal words, then equal stems, then words
    that share a synonym group.  A stage pairs what the stages before left free; the fragmentation
    penalty is gamma * (chunks / matches) ** beta over the whole alignment.
    """
    if len(hyp) == 0 or len(ref) == 0:
        return 0.0
    hyp, ref = [w.lower() for w in hyp], [w.lower() for w in ref]
    to = _same_words(hyp, ref)
    if stems and min(to) < 0:
        _paired(hyp, ref, to, lambda w: (stem(w),))
    if synonyms and min(to) < 0:
        _paired(hyp, ref, to, lambda w: synonyms.get(w, ()))
    m = joined = 0
    last = -9
    for place in to:
        if place >= 0:
            m += 1
            joined += place == last + 1
            last = place
        else:
            last = -9
    if m == 0:
        return 0.0
    p, rc = m / len(hyp), m / len(ref)
    fmean = p * rc / (alpha * p + (1 - alpha) * rc)
    return (1 - gamma * ((m - joined) / m) ** beta) * fmean


def meteor_exact(ref, hyp) -> float:
    """METEOR with the stage of equal words alone."""
    return meteor(ref, hyp, stems=False)


@F.pandas_udf(T.DoubleType())
def _meteor_udf(ref: pd.Series, hyp: pd.Series, groups: pd.Series) -> pd.Series:
    out = []
    for r, h, g in zip(ref, hyp, groups):
        out.append(None if r is None or h is None else meteor(
            list(r), list(h), {x["word"]: tuple(x["groups"]) for x in g} if g is not None else None))
    return pd.Series(out, dtype=float)


def with_meteor(pairs: DataFrame, keys: list[str], ref: str, hyp: str, synonyms: DataFrame | None = None,
                out: str = "meteor") -> DataFrame:
    """Staged METEOR of two token arrays in ``out`` (null arrays: null).

    ``synonyms(word, grp)`` is optional: the distinct words of a pair are joined with it, and the
    groups come back as one array per pair, so the table may be of any size.  ``keys`` name a pair;
    rows that repeat them must agree in their words.
    """
    small_batches(pairs.sparkSession)
    if synonyms is None:
        none = F.lit(None).cast("array<struct<word:string,groups:array<string>>>")
        return pairs.withColumn(out, _meteor_udf(ref, hyp, none))
    both = F.array_distinct(F.transform(F.concat(F.coalesce(ref, F.array()), F.coalesce(hyp, F.array())), F.lower))
    words = pairs.select(*keys, F.explode(both).alias("word")).distinct()
    known = synonyms.where("word IS NOT NULL AND grp IS NOT NULL").select(F.lower("word").alias("word"), "grp").distinct()
    found = (words.join(known, "word").groupBy(*keys, "word").agg(F.collect_set("grp").alias("groups"))
             .groupBy(*keys).agg(F.collect_list(F.struct("word", "groups")).alias("__groups")))
    right = found.select(*[F.col(k).alias(f"__key_{k}") for k in keys], "__groups")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    joined = pairs.join(right, same, "left").withColumn(out, _meteor_udf(ref, hyp, "__groups"))
    return joined.drop("__groups", *[f"__key_{k}" for k in keys])


METRIC_TYPE = T.StructType([
    T.StructField("levenshtein", T.DoubleType()),
    T.StructField("bleu", T.DoubleType()),
    T.StructField("rouge", T.DoubleType()),
    T.StructField("meteor", T.DoubleType()),
])


@F.pandas_udf(METRIC_TYPE)
def _metric_udf(gt: pd.Series, pred: pd.Series, gtt: pd.Series, prt: pd.Series) -> pd.DataFrame:
    # the comment classes of a task stand next to each other and often agree
    rows, known = [], {}
    for a, b, ta, tb in zip(gt, pred, gtt, prt):
        ta = tuple(ta) if ta is not None else ()
        tb = tuple(tb) if tb is not None else ()
        key = (a, b, ta, tb)
        if key not in known:
            known[key] = edit_similarity(a or "", b or ""), bleu4(ta, tb), rouge_l(ta, tb), meteor(ta, tb)
        rows.append(known[key])
    return pd.DataFrame(rows, columns=["levenshtein", "bleu", "rouge", "meteor"])


def token_texts(text: Column) -> Column:
    """All token texts (whitespace included)."""
    return L.token_values(text)


def whitespace_split(s: Column) -> Column:
    """Python ``str.split()``: Unicode whitespace runs, no empty pieces."""
    t = N.js_trim(s)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(
        F.split(t, N.JS_SPACE + "+"))


def score(pairs: DataFrame, single_token: bool = False) -> DataFrame:
    """Postprocess ``gt``/``prediction``, project tokens, compute metrics.

    Expects columns ``gt`` and ``prediction`` (raw) plus any keys; returns keys +
    ``empty`` + five metrics (null when ``empty``, E11).
    """
    keys = [c for c in pairs.columns if c not in ("gt", "prediction", "input")]
    pp = pairs.select(*keys, "gt", "prediction")
    for side in ("gt", "prediction"):
        pp = L.held(pp, f"__{side}", N.postprocess(F.col(side)))
    tk = pp.select(*keys, F.col("__gt").alias("gt"), F.col("__prediction").alias("prediction"))
    tk = L.held(L.held(tk, "gtt", token_texts(F.col("gt"))), "prt", token_texts(F.col("prediction")))
    if single_token:  # E10
        tk = tk.select(*keys, F.slice("gtt", 1, 1).alias("gtt"), F.slice("prt", 1, 1).alias("prt"))
        tk = tk.select(*keys, F.array_join("gtt", "").alias("gt"),
                       F.array_join("prt", "").alias("prediction"), "gtt", "prt")
    empty = F.col("prediction") == ""
    em = (whitespace_split(F.col("gt")) == whitespace_split(F.col("prediction"))).cast("int")
    m = tk.withColumn("__m", _metric_udf("gt", "prediction", "gtt", "prt"))
    return m.select(
        *keys, empty.alias("empty"),
        F.when(~empty, em).alias("exact_match"),
        *[F.when(~empty, F.col("__m")[c]).alias(c)
          for c in ("levenshtein", "bleu", "rouge", "meteor")])


def score_members(groups: DataFrame, members: str, single_token: bool = False) -> DataFrame:
    """:func:`score` of rows whose ``members`` are an array of ``STRUCT<name, gt, prediction>``: one
    metric row per member, with its ``name``.  Equal pairs of a row are scored once."""
    keys = [c for c in groups.columns if c != members]
    once = F.array_distinct(F.transform(members, lambda m: F.struct(m["gt"].alias("gt"), m["prediction"].alias("prediction"))))
    rows = L.held(groups, members, F.col(members)).select(*keys, members, F.explode(once).alias("__pair"))
    names = F.transform(F.filter(members, lambda m: m["gt"].eqNullSafe(F.col("__pair.gt"))
                                 & m["prediction"].eqNullSafe(F.col("__pair.prediction"))), lambda m: m["name"])
    rows = score(rows.select(*keys, names.alias("__names"), "__pair.gt", "__pair.prediction"), single_token)
    return rows.select(*keys, F.explode("__names").alias("name"), *[c for c in rows.columns if c not in (*keys, "__names")])


def averages(metric_rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean over non-empty rows x 100, rounded half-even to 2 decimals."""
    return metric_rows.groupBy(*by).agg(
        F.sum((~F.col("empty")).cast("int")).alias("n"),
        *[F.bround(F.avg(c) * 100, 2).alias(c)
          for c in ("exact_match", "levenshtein", "bleu", "rouge", "meteor")])


def dimension_codes(dataset: Column) -> tuple[Column, Column]:
    """``<variant>-<comments>`` -> (types code, comments code); an unknown name
    raises, as in the study."""
    from maskforge import config as C
    parts = F.split(dataset, "-")
    v, c = F.get(parts, 0), F.get(parts, 1)
    types = None
    for name, code in C.TYPE_CODES:
        types = F.when(v == name, F.lit(code)) if types is None else types.when(v == name, code)
    types = types.otherwise(F.raise_error(F.concat(F.lit("Unknown types "), dataset)))
    comm = None
    for name, code in C.COMMENT_CODES:
        comm = F.when(c == name, F.lit(code)) if comm is None else comm.when(c == name, code)
    comm = comm.otherwise(F.raise_error(F.concat(F.lit("Unknown comments "), dataset)))
    return types, comm


def last_line_baseline(model_input: Column) -> Column:
    """A "repeat the previous line" predictor: the last non-blank ``<EOL>`` line."""
    lines = F.filter(F.split(model_input, "<EOL>"), lambda x: F.trim(x) != "")
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
