"""Hash-based sampling, splitting, shuffling and batching.

A sequential seeded PRNG depends on input order; these operators instead derive
every random draw from md5 of (key, seed), which is reproducible, independent of
partitioning, and identical in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskforge import config as C
from maskforge.operators import ordered


def uniform(*parts: Column | str) -> Column:
    """u in [0, 1): first 32 bits of md5(p1-p2-...) over 2^32."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    h = F.md5(F.concat_ws("-", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def weighted_split(key: Column, weights=C.SPLIT_WEIGHTS, seed: int = C.RANDOM_SEED) -> Column:
    """K9: train/test/dev by cumulative weights over a hash uniform."""
    u = uniform(key, str(seed))
    out, acc = None, 0.0
    for name, w in weights:
        acc += w
        out = F.when(u < F.lit(acc), F.lit(name)) if out is None else out.when(u < F.lit(acc), name)
    return out.otherwise(F.lit(weights[-1][0]))


def shuffle_key(key: Column, seed: int = C.RANDOM_SEED) -> Column:
    """Order by this for a reproducible shuffle."""
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))))


def sample_per_group(df: DataFrame, group: str, key: str, n: int,
                     seed: int = C.RANDOM_SEED) -> DataFrame:
    """N hash-chosen rows per group (a top-k window; Catalyst plans a
    WindowGroupLimit so each task keeps only k rows per group before the shuffle)."""
    from pyspark.sql import Window
    w = Window.partitionBy(group).orderBy(shuffle_key(F.col(key), seed))
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def batches(df: DataFrame, order: str, size: int, out: str = "batch") -> DataFrame:
    """Fixed-size batches in ``order``: batch = (row_number - 1) div size.

    The row number is a distributed prefix count (no global window)."""
    ranked = ordered.cumulative(df, [], [order], count_col="__rn")
    return ranked.withColumn(out, F.floor((F.col("__rn") - 1) / size).cast("long")).drop("__rn")


#: rows of the last hash bucket that are sorted to find the sample's end
LAST_BUCKET = 10_000
_DIGITS = 4


def global_sample(df: DataFrame, key: str, n: int, seed: int = C.RANDOM_SEED) -> DataFrame:
    """``n`` rows of the whole frame without replacement: those with the least
    (hash of ``key``, ``key``); all rows where there are no more than ``n``.

    The end of the sample is found by counting rows per hash prefix, ``16 ** 4`` counts at a time,
    into the bucket that holds the n-th row until that bucket is small; then one filter takes the
    sample.  No window and no sort of the frame, and ``n`` may be as large as the frame.  Rows that
    repeat the key of the last row all stay, so a unique key gives exactly ``n`` rows.
    """
    h = shuffle_key(F.col(key), seed)
    if n <= 0:
        return df.limit(0)
    prefix, before = "", 0
    while True:
        inside = df.where(h.startswith(prefix)) if prefix else df
        step = F.substring(h, len(prefix) + 1, _DIGITS).alias("p")
        counts = sorted((r["p"], r["count"]) for r in inside.groupBy(step).count().collect())
        for p, c in counts:
            if before + c >= n:
                prefix, size = prefix + p, c
                break
            before += c
        else:
            return df  # no more than n rows
        if size <= LAST_BUCKET or len(prefix) == 32:
            break
    bucket = df.where(h.startswith(prefix)).select(h.alias("h"), F.col(key).alias("k"))
    if size > LAST_BUCKET:  # rows of one hash: copies of a key
        return df.where(h <= prefix)
    last = bucket.orderBy("h", "k").limit(n - before).agg(F.max(F.struct("h", "k")).alias("m")).first()["m"]
    return df.where((h < last["h"]) | ((h == last["h"]) & F.coalesce(F.col(key) <= F.lit(last["k"]), F.lit(True))))
