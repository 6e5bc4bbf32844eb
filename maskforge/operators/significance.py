"""Paired significance tests and effect sizes on metric rows.

Ranks are never computed with a window over raw rows: rows are first reduced to counts
per distinct value (partial aggregation), then a distributed prefix sum over the sorted
distinct values gives average ranks, so no task ever holds a whole population.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskforge import config as C
from maskforge.operators import ordered


def norm_sf(z: Column) -> Column:
    """Upper tail of the standard normal via an erf approximation (|error| < 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741
                                                      + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-x * x)
    upper = 0.5 * (1.0 - erf)
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


#: number of differences up to which an untied signed-rank test takes the exact distribution
EXACT_ROWS = 50


def rank_sum_counts(n: int) -> list[int]:
    """How many of the sign patterns of ranks 1..n have each positive rank sum 0..n(n+1)/2: a
    pattern with rank k is one without it, moved up by k."""
    counts = [1]
    for k in range(1, n + 1):
        longer = counts + [0] * k
        for w, c in enumerate(counts):
            longer[w + k] += c
        counts = longer
    return counts


def exact_tails(spark, most: int = EXACT_ROWS) -> DataFrame:
    """``(n, w, exact_p)``: two-sided p of the smaller rank sum ``w``; some 20,000 rows at most 50."""
    rows = []
    for n in range(1, most + 1):
        below = 0
        for w, c in enumerate(rank_sum_counts(n)[:n * (n + 1) // 4 + 1]):
            below += c
            rows.append((n, w, min(1.0, 2 * below / 2 ** n)))
    return spark.createDataFrame(rows, "n bigint, w bigint, exact_p double")


def average_ranks(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``counts(keys, value, c, ...)`` with the average rank of each distinct value."""
    run = ordered.cumulative(counts, keys, [value], sums=["c"])
    return run.withColumn("avg_rank", (F.col("run_c") - F.col("c")).cast("double") + (F.col("c") + 1) / 2.0)


def wilcoxon(paired: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """A5: two-sided Wilcoxon signed-rank test (zeros dropped, average ranks for ties) per ``keys``
    group.  Up to ``EXACT_ROWS`` differences without ties, ``p_value`` is that of the exact
    distribution (``exact_p``); else of the normal approximation with tie correction."""
    d = paired.select(*keys, (F.col(x) - F.col(y)).alias("d")).where(F.col("d") != 0)
    counts = d.groupBy(*keys, F.abs("d").alias("ad")).agg(
        F.count(F.lit(1)).alias("c"), F.sum((F.col("d") > 0).cast("long")).alias("pos"))
    r = average_ranks(counts, keys, "ad")
    c, pos = F.col("c").cast("double"), F.col("pos").cast("double")
    agg = r.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum(pos * F.col("avg_rank")).alias("w_plus"),
        F.sum((c - pos) * F.col("avg_rank")).alias("w_minus"), F.sum(c * c * c - c).alias("ties"))
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4.0
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0)
    z = (F.least("w_plus", "w_minus") - mean) / spread
    out = agg.select(*keys, "n", "w_plus", "w_minus", "ties", z.alias("z"), (2 * norm_sf(F.abs(z))).alias("near"))
    tails = exact_tails(paired.sparkSession).select(F.col("n").alias("__n"), "w", "exact_p")
    untied = (F.col("ties") == 0) & (F.col("n") == F.col("__n")) & (
        F.least("w_plus", "w_minus").cast("bigint") == F.col("w"))
    out = out.join(F.broadcast(tails), untied, "left")  # a fixed number of rows
    return out.select(*keys, "n", "w_plus", "w_minus", "z", F.coalesce("exact_p", "near").alias("p_value"), "exact_p")


def samples_delta(samples: DataFrame, keys: list[str], value: str, is_first: str) -> DataFrame:
    """``(#x>y - #x<y) / (m k)`` over all cross pairs of two samples, marked by the
    boolean ``is_first``, from pooled average ranks; null where a sample is empty."""
    counts = samples.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"),
                                              F.sum(F.col(is_first).cast("long")).alias("cx"))
    r = average_ranks(counts, keys, value)
    agg = r.groupBy(*keys).agg(F.sum("cx").cast("double").alias("m"),
                               F.sum(F.col("c") - F.col("cx")).cast("double").alias("k"),
                               F.sum(F.col("cx") * F.col("avg_rank")).alias("r1"))
    u = F.col("r1") - F.col("m") * (F.col("m") + 1) / 2.0
    some = (F.col("m") > 0) & (F.col("k") > 0)
    return agg.select(*keys, F.when(some, 2 * u / (F.col("m") * F.col("k")) - 1).alias("delta"))


def cliffs_delta(paired: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """A6 for the two columns of paired rows."""
    samples = paired.select(*keys, F.col(x).alias("v"), F.lit(True).alias("first")).unionByName(
        paired.select(*keys, F.col(y).alias("v"), F.lit(False).alias("first")))
    return samples_delta(samples, keys, "v", "first")


def catalogue(spark, pairs=C.COMPARISONS, metrics=C.METRICS) -> DataFrame:
    """A1: the planned comparisons, one row per population pair and metric (fixed size)."""
    rows = [(a, b, m) for a, b in pairs for m in metrics]
    return spark.createDataFrame(rows, "pop1 string, pop2 string, metric string")


def report(metric_long: DataFrame, planned: DataFrame, keys: list[str],
           alpha: float = C.SIGNIFICANCE) -> DataFrame:
    """One row per planned comparison.

    ``metric_long(population, metric, value, empty, keys...)``.  Rows of the two populations
    are aligned by ``keys`` and kept where both are non-empty.  A comparison whose population
    has no row at all is listed with ``missing`` set and no figures (A2); ``significant`` is
    p <= alpha (A7).
    """
    # the rows of a population are no small side, however small their compressed files are
    a, b = metric_long.alias("a"), metric_long.hint("merge").alias("b")
    present = metric_long.select("population", "metric").distinct()
    small = F.broadcast(planned)  # the catalogue has a fixed number of rows
    joined = (a.join(small, (F.col("pop1") == F.col("a.population")) & (F.col("a.metric") == planned["metric"]))
              .join(b, (F.col("pop2") == F.col("b.population")) & (F.col("a.metric") == F.col("b.metric")) & _matched(keys))
              .where(~F.col("a.empty") & ~F.col("b.empty"))
              .select("pop1", "pop2", F.col("a.metric").alias("metric"),
                      F.col("a.value").alias("x"), F.col("b.value").alias("y")))
    return _figures(joined, present, planned, alpha)


def report_rows(rows: DataFrame, planned: DataFrame, keys: list[str], metrics, alpha: float = C.SIGNIFICANCE) -> DataFrame:
    """:func:`report` of ``rows(population, empty, <metrics>, keys...)``: a pair of rows is joined once and taken
    apart by metric afterwards."""
    a, b = rows.alias("a"), rows.hint("merge").alias("b")
    present = rows.select("population").distinct().select("population", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    small = F.broadcast(planned.select("pop1", "pop2").distinct())  # fixed numbers of rows
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").cast("double").alias("x"),
                                F.col(f"b.{m}").cast("double").alias("y")) for m in metrics])
    joined = (a.join(small, F.col("pop1") == F.col("a.population"))
              .join(b, (F.col("pop2") == F.col("b.population")) & _matched(keys))
              .where(~F.col("a.empty") & ~F.col("b.empty")).select("pop1", "pop2", F.explode(values).alias("v"))
              .select("pop1", "pop2", "v.*").join(F.broadcast(planned), ["pop1", "pop2", "metric"]))
    return _figures(joined, present, planned, alpha)


def _matched(keys: list[str]) -> Column:
    return reduce(and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])


def _figures(joined: DataFrame, present: DataFrame, planned: DataFrame, alpha: float) -> DataFrame:
    """The table of :func:`report` from ``joined(pop1, pop2, metric, x, y)`` and the populations ``present``."""
    joined = ordered.stage(joined, "paired")
    on = ["pop1", "pop2", "metric"]
    sizes = joined.groupBy(*on).agg(F.count(F.lit(1)).alias("pairs"))
    out = (planned.join(sizes, on, "left").join(wilcoxon(joined, on, "x", "y"), on, "left")
           .join(cliffs_delta(joined, on, "x", "y"), on, "left"))
    for side in ("pop1", "pop2"):
        out = out.join(present.select(F.col("population").alias(side), "metric", F.lit(True).alias(f"has_{side}")),
                       [side, "metric"], "left")
    missing = F.concat_ws(",", F.when(F.col("has_pop1").isNull(), F.col("pop1")),
                          F.when(F.col("has_pop2").isNull(), F.col("pop2")))
    return out.select(*on, F.coalesce("pairs", F.lit(0)).alias("pairs"), "n", "z", "p_value",
                      "delta", (F.col("p_value") <= alpha).alias("significant"), missing.alias("missing"))


def published(table: DataFrame) -> DataFrame:
    """Of a :func:`report`, the significant comparisons, p and delta to three decimals; a pair is
    listed if any of its metrics is, with ``of`` metrics tested."""
    tested = table.groupBy("pop1", "pop2").agg(F.count("p_value").alias("of"))
    kept = table.where("significant").select("pop1", "pop2", "metric", "pairs", F.bround("p_value", 3).alias("p"),
                                             F.bround("delta", 3).alias("delta"))
    return kept.join(tested, ["pop1", "pop2"])
