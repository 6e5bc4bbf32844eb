"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Each text gives a vector of transformed statistics.  For every (language, source), every
language and the whole table, concentration steps look for the share ``CORE`` of rows whose
covariance has the least determinant: distances under the present estimate are counted in
fixed bins, and the moments of the bins that hold the nearest ``CORE`` of the rows give the
next estimate.  The last step makes it of all rows whose distance, brought to that of a normal
core, is below ``NEAR``, so a group may hold up to half junk.  A step is one partial aggregate of (group, bin) rows, so a group may hold
any share of the table.  A text is rejected when its squared Mahalanobis distance from its
own group's estimate exceeds ``CUTOFF``; groups with fewer than ``MIN_ROWS`` rows use their
language, or else the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskforge.llm.common import RangeHash, buffer_of, combine, mix, ready, slices, staged, word_spans

STATS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VECTOR = ("word_length", "symbols", "upper", "punctuation", "digits", "repeats", "dup_lines", "size")
#: least standard deviation of each entry, so that a constant entry rejects nobody alone
FLOOR = np.array([0.05, 0.03, 0.03, 0.04, 0.08, 0.15, 0.30, 0.50])
CORE = 0.5
#: squared distance: the 0.999 quantile of chi-square with 8 entries (26.12) times 2.68, as the entries have tails
CUTOFF = 70.0
#: rows nearer than this to the core's estimate make the final one: chi-square's 0.975 quantile
NEAR = 17.5345
MEDIAN = 7.3441  # chi-square's median with 8 entries
MIN_ROWS = 100
STEPS = 8
#: distance bins: BINS_PER_OCTAVE for each doubling of the squared distance
BINS_PER_OCTAVE = 16
_PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i, len(VECTOR))]

_IS = {name: np.zeros(256, bool) for name in ("symbol", "upper", "punct", "digit")}
_IS["symbol"][list(b"#*$%&|<>")] = True
_IS["upper"][65:91] = True
_IS["punct"][list(b".,;:!?\"'()-")] = True
_IS["digit"][48:58] = True


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts per text of a slice: words, code points in words, symbols, repeated lines,
    words in repeated 3-word windows, and character classes."""
    data, offsets = buffer_of(texts)
    n = len(texts)
    starts, ends, docs = word_spans(data, offsets)

    def per_text(flag):
        total = np.r_[0, np.cumsum(flag, dtype=np.int64)]
        return total[offsets[1:]] - total[offsets[:-1]]

    word = np.zeros(len(data) + 1, np.int8)
    np.add.at(word, starts, 1)
    np.add.at(word, ends, -1)
    in_word = np.cumsum(word[:-1]) > 0
    # adjacent texts: a word may end where the next begins; the running sum stays right
    out = {"n_words": np.bincount(docs, minlength=n),
           "word_chars": per_text(in_word & ((data & 0xC0) != 0x80))}
    for name, is_kind in _IS.items():
        out[f"n_{name}s"] = per_text(is_kind[data])
    # 3-word windows found twice or more in one text
    grams, at = combine(RangeHash(data)(starts, ends), 3, docs)
    repeat = np.zeros(len(starts) + 1, np.int64)
    if len(at):
        _, which, times = np.unique(mix(grams ^ mix(docs[at].astype(np.uint64) + np.uint64(1))),
                                    return_inverse=True, return_counts=True)
        again = at[times[which] > 1]
        np.add.at(repeat, again, 1)
        np.add.at(repeat, again + 3, -1)
    covered = np.cumsum(repeat[:-1]) > 0
    out["n_repeat_words"] = np.bincount(docs[covered], minlength=n)
    dup = np.zeros(n, np.int64)
    raw = data.tobytes()
    for i, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if raw.find(b"\n", s, e) >= 0:
            lines = [x for x in raw[s:e].split(b"\n") if x.strip()]
            dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    return out


def vector(c: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics, one row per text; a text without words is all zeros."""
    words = np.maximum(c["n_words"], 1).astype(float)
    chars = np.maximum(c["word_chars"], 1).astype(float)
    some = (c["n_words"] > 0).astype(float)
    cols = [np.log(chars / words), np.sqrt(c["n_symbols"] / chars), np.sqrt(c["n_uppers"] / chars),
            np.sqrt(c["n_puncts"] / chars), np.sqrt(c["n_digits"] / chars),
            np.sqrt(c["n_repeat_words"] / words), np.log1p(c["n_dup_lines"]), np.log(words)]
    return np.stack([x * some for x in cols], axis=1)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               group_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``(id, lang, source, n_words, <counts>, x ARRAY<DOUBLE>)`` for every row."""
    ready(docs)
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(n) for c, n in
                                                    zip(group_cols, ("lang", "source"))],
                       F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    counts = ("n_words", *STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                c = text_statistics(part["t"])
                x = vector(c)
                cut = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["lang"], part["source"], *(pa.array(c[k].astype(np.int64)) for k in counts),
                     pa.ListArray.from_arrays(cut, pa.array(x.ravel()))],
                    ["id", "lang", "source", *counts, "x"])

    return rows.mapInArrow(run, f"id {kind}, lang string, source string, "
                           + ", ".join(f"{k} bigint" for k in counts) + ", x array<double>")


# --- estimates --------------------------------------------------------------------

def _groups() -> Column:
    """The three groups a row belongs to; null languages and sources are groups of their own."""
    lang, source = F.coalesce("lang", F.lit("\0")), F.coalesce("source", F.lit("\0"))
    return F.array(F.concat_ws("\1", F.lit("s"), lang, source), F.concat_ws("\1", F.lit("l"), lang), F.lit("a"))


def _distance(x: str, mean: str, inverse: str) -> Column:
    """Squared Mahalanobis distance; ``inverse`` is the upper triangle, off-diagonals doubled."""
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        total = total + (F.col(inverse)[k] * (F.col(x)[i] - F.col(mean)[i]) * (F.col(x)[j] - F.col(mean)[j]))
    return total


def _estimate(n: float, s: np.ndarray, ss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = len(VECTOR)
    mean = s / n
    cov = np.zeros((p, p))
    for k, (i, j) in enumerate(_PAIRS):
        cov[i, j] = cov[j, i] = ss[k] / n - mean[i] * mean[j]
    return mean, cov


def _packed(cov: np.ndarray) -> list[float]:
    cov = cov + np.diag(np.maximum(FLOOR ** 2 - np.diag(cov), 0))
    inv = np.linalg.inv(cov + 1e-9 * np.eye(len(VECTOR)))
    return [float(inv[i, j] * (1 if i == j else 2)) for i, j in _PAIRS]


_STATE = "g string, n bigint, mean array<double>, inverse array<double>, logdet double"


def _start(pdf: pd.DataFrame) -> pd.DataFrame:
    """Medians and scaled median absolute deviations from the binned entries of a group."""
    mean, scale = np.zeros(len(VECTOR)), FLOOR.copy()
    for k, part in pdf.groupby("k"):
        q, n = part["q"].to_numpy(), part["n"].to_numpy()
        o = np.argsort(q)
        mid = q[o][np.searchsorted(np.cumsum(n[o]), n.sum() / 2)] / 64
        off = np.abs(q / 64 - mid)
        o = np.argsort(off)
        mean[k] = mid
        scale[k] = max(FLOOR[k], 1.4826 * off[o][np.searchsorted(np.cumsum(n[o]), n.sum() / 2)])
    return pd.DataFrame([[pdf["g"].iloc[0], int(pdf.loc[pdf["k"] == 0, "n"].sum()), mean.tolist(),
                          _packed(np.diag(scale ** 2)), float("inf")]],
                        columns=["g", "n", "mean", "inverse", "logdet"])


def _shrinkage(limit: float) -> float:
    """Variance of normal rows whose squared distance is below ``limit``, to that of all rows."""
    h = limit / 2
    below = [1 - math.exp(-h) * sum(h ** i / math.factorial(i) for i in range(k)) for k in (4, 5)]
    return below[1] / below[0]


def _concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
    """Next estimate of a group from its distance bins (at most some hundred rows)."""
    return _next(pdf, False)


def _reweighted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Last estimate of a group: of the rows near the half core, made consistent at the normal."""
    return _next(pdf, True)


def _next(pdf: pd.DataFrame, final: bool) -> pd.DataFrame:
    pdf = pdf.sort_values("bin")
    n = pdf["n"].to_numpy()
    last = int(np.searchsorted(np.cumsum(n), min(CORE * n.sum() + (len(VECTOR) + 1) / 2, n.sum())))
    if final:
        top = 2.0 ** ((pdf["bin"].to_numpy() + 1) / BINS_PER_OCTAVE) * _shrinkage(MEDIAN)
        last = max(last, int((top <= NEAR).sum()) - 1)
    core = pdf.iloc[:last + 1]
    mean, cov = _estimate(core["n"].sum(), np.stack(core["s"]).sum(axis=0), np.stack(core["ss"]).sum(axis=0))
    if final:
        cov = cov / _shrinkage(NEAR)
    floored = cov + np.diag(np.maximum(FLOOR ** 2 - np.diag(cov), 0))
    logdet = float(np.linalg.slogdet(floored + 1e-9 * np.eye(len(VECTOR)))[1])
    return pd.DataFrame([[pdf["g"].iloc[0], int(n.sum()), mean.tolist(), _packed(cov), logdet]],
                        columns=["g", "n", "mean", "inverse", "logdet"])


def estimates(stats: DataFrame, steps: int = STEPS) -> DataFrame:
    """MCD location and inverse scatter of every group: one row per group."""
    member = stats.where("n_words > 0").select(F.explode(_groups()).alias("g"), "x")
    entry = F.explode(F.transform("x", lambda v, i: F.struct(i.alias("k"), F.round(v * 64).cast("int").alias("q"))))
    binned = (member.select("g", entry.alias("e")).groupBy("g", "e.k", "e.q")
              .agg(F.count(F.lit(1)).alias("n")))
    state = staged(binned.groupBy("g").applyInPandas(_start, _STATE), "mcd")
    for step in range(steps + 1):
        # one row per group: Spark broadcasts it while it is small and shuffles otherwise
        far = member.join(state.select("g", "mean", "inverse"), "g").select(
            "g", "x", _distance("x", "mean", "inverse").alias("d"))
        far = far.withColumn("bin", F.floor(F.log2(F.greatest(F.col("d"), F.lit(2.0 ** -20))) * BINS_PER_OCTAVE))
        sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(len(VECTOR))]
        squares = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"q{k}") for k, (i, j) in enumerate(_PAIRS)]
        bins = far.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"), *sums, *squares)
        bins = bins.select("g", "bin", "n", F.array(*[f"s{i}" for i in range(len(VECTOR))]).alias("s"),
                           F.array(*[f"q{k}" for k in range(len(_PAIRS))]).alias("ss"))
        state = staged(bins.groupBy("g").applyInPandas(_concentrate if step < steps else _reweighted, _STATE), "mcd")
    return state


def outliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             group_cols: tuple[str, str] = ("lang", "source"), min_rows: int = MIN_ROWS,
             cutoff: float = CUTOFF) -> DataFrame:
    """Statistics of every row with the verdict of the base rules and of the MCD distance.

    Returns ``(<id_col>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance DOUBLE, kept)``, one row per input row.  Null and empty texts have
    zero counts and fail the base rules; null languages and sources form groups of their
    own; repeated rows stay; an empty table gives an empty result; other columns are not read.
    A group of fewer than ``min_rows`` rows with words takes its language's estimate, or else
    the whole table's; where that has fewer as well nothing is estimated, the distance is 0 and
    the base rules alone decide.
    """
    stats = staged(statistics(docs, id_col, text_col, group_cols), "mcd-stats")
    found = staged(estimates(stats), "mcd-groups").where(F.col("n") >= min_rows)
    # which groups are large enough, as one small row per (language, source)
    names = stats.select("lang", "source").distinct().withColumn("gs", _groups())
    usable = (names.select("lang", "source", F.posexplode("gs").alias("level", "g"))
              .join(found.select("g", "mean", "inverse"), "g")
              .groupBy("lang", "source").agg(F.min_by(F.struct("mean", "inverse"), "level").alias("m")))
    scored = stats.join(usable, stats["lang"].eqNullSafe(usable["lang"])
                        & stats["source"].eqNullSafe(usable["source"]), "left").drop(usable["lang"]).drop(usable["source"])
    scored = scored.withColumn("mean", F.col("m.mean")).withColumn("inverse", F.col("m.inverse"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = F.coalesce(_distance("x", "mean", "inverse"), F.lit(0.0))
    return scored.select(F.col("id").alias(id_col), "n_words", *STATS, failed.alias("base_failed"),
                         far.alias("distance"), (~failed & (far <= cutoff)).alias("kept"))
