"""Paired statistics (A1-A8): metric rows of two evaluation modes of the same
prediction pairs (line vs first token) are the two populations."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskforge import config as C
from maskforge.operators import metrics as E
from maskforge.operators import ordered
from maskforge.operators import significance as A
from maskforge.plans.q_metrics import pairs
from maskforge.plans import duck_marking as M
from maskforge.plans.registry import register


def _long(rows, population, metrics):
    # Unpivot the metric subset to long form
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"),
                                         F.col(m).cast("double").alias("value")) for m in metrics]))
    return rows.select("conv_id", "turn", "empty", F.lit(population).alias("population"),
                       stack.alias("mv")).select("conv_id", "turn", "empty", "population",
                                                 "mv.metric", "mv.value")


@register("a5_a6_line_vs_token")
def a5_a6_line_vs_token(spark, sf_dir):
    """Wilcoxon p and Cliff's delta, line mode vs first-token mode."""
    p = pairs(spark, sf_dir)
    long = _long(E.score(p), "line", C.SINGLE_TOKEN_METRICS).unionByName(
        _long(E.score(p, single_token=True), "token", C.SINGLE_TOKEN_METRICS))
    planned = A.catalogue(spark, (("line", "token"),), C.SINGLE_TOKEN_METRICS)
    return A.report(ordered.stage(long, "metric-rows"), planned, ["conv_id", "turn"])


def _task_report(spark, sf_dir, metrics, single_token: bool = False):
    """The comparisons over the metric rows of the fifteen test datasets."""
    from maskforge.plans.q_metrics import task_metric_rows
    rows = task_metric_rows(spark, sf_dir, single_token).select(
        "path", "ordinal", F.col("dataset").alias("population"), "empty", *metrics)
    return A.report_rows(rows, A.catalogue(spark, metrics=metrics), ["path", "ordinal"], metrics)


@register("a1_a8_exact_match", M.significance())
def a1_a8_exact_match(spark, sf_dir):
    """A1-A6 for exact match: the twelve comparisons over the fifteen test datasets."""
    out = _task_report(spark, sf_dir, ("exact_match",))
    return out.select("pop1", "pop2", "pairs", "n", F.round("z", 6).alias("z"), F.round("delta", 9).alias("delta"))


@register("a1_a8_significance")
def a1_a8_significance(spark, sf_dir):
    """All twelve comparisons x five metrics over the metric rows of the fifteen
    test datasets (the previous-line baseline), missing populations listed."""
    out = _task_report(spark, sf_dir, C.METRICS)
    return out.select("pop1", "pop2", "metric", "pairs", F.bround("p_value", 3).alias("p"),
                      F.bround("delta", 3).alias("delta"), "significant", "missing")


@register("a6_cliffs_delta_lengths", """
WITH t AS (SELECT conv_id, turn, length(text) AS len, role FROM conversations),
x AS (SELECT len FROM t WHERE role = 'user'), y AS (SELECT len FROM t WHERE role = 'assistant')
SELECT round(((SELECT count(*) FROM x, y WHERE x.len > y.len)
            - (SELECT count(*) FROM x, y WHERE x.len < y.len))
            / ((SELECT count(*) FROM x) * (SELECT count(*) FROM y)), 9) AS delta""")
def a6_cliffs_delta_lengths(spark, sf_dir):
    """Cliff's delta of text length, user vs assistant turns (rank form, no
    m x n pairs; the oracle uses the pairwise definition)."""
    from maskforge.sources import tables as T
    c = T.read(spark, sf_dir, "conversations", "role", "text")
    samples = c.where(F.col("role").isin("user", "assistant")).select(
        F.lit("g").alias("g"), F.length("text").cast("double").alias("v"), (F.col("role") == "user").alias("first"))
    return A.samples_delta(samples, ["g"], "v", "first").select(F.round("delta", 9).alias("delta"))


@register("a5_wilcoxon_lengths", """
WITH pairs AS (
  SELECT a.conv_id, a.turn, a.text AS gt, p.text AS prediction
  FROM conversations a JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1
  WHERE a.role = 'assistant'),
d AS (SELECT CAST(length(gt) - length(prediction) AS DOUBLE) AS d FROM pairs
      WHERE length(gt) <> length(prediction)),
r AS (SELECT d, CAST(rank() OVER (ORDER BY abs(d)) AS DOUBLE)
               + (CAST(count(*) OVER (PARTITION BY abs(d)) AS DOUBLE) - 1.0) / 2.0 AS rk FROM d),
s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0.0 END) AS w_plus,
             sum(CASE WHEN d < 0 THEN rk ELSE 0.0 END) AS w_minus FROM r),
t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties
      FROM (SELECT count(*) AS c FROM d GROUP BY abs(d)))
SELECT n, w_plus, w_minus,
       round((least(w_plus, w_minus) - n * (n + 1) / 4.0)
             / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 9) AS z
FROM s, t""")
def a5_wilcoxon_lengths(spark, sf_dir):
    """A5: signed-rank test of answer length vs the preceding turn's length
    (paired by conversation and turn; zero differences dropped, tied ranks
    averaged, normal approximation with tie correction)."""
    p = pairs(spark, sf_dir)
    df = p.select(F.lit("g").alias("g"), F.length("gt").cast("double").alias("x"),
                  F.length("prediction").cast("double").alias("y"))
    w = A.wilcoxon(df, ["g"], "x", "y")
    return w.select("n", "w_plus", "w_minus", F.round("z", 9).alias("z"))


@register("a5_exact_orders", """
WITH d AS (SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(d)) AS rk, d,
             count(*) OVER (PARTITION BY o_custkey) AS n, count(*) OVER (PARTITION BY o_custkey, abs(d)) AS same
           FROM (SELECT o_custkey, CAST(o_orderkey % 9973 AS DOUBLE) - CAST(o_custkey % 9973 AS DOUBLE) AS d FROM orders) WHERE d <> 0),
g AS (SELECT key, n, CAST(sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS BIGINT) AS up,
        CAST(sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS BIGINT) AS down
      FROM d GROUP BY key, n HAVING max(same) = 1 AND n <= 12),
s AS (SELECT n, CAST(list_sum(list_transform(range(1, n + 1), lambda k: CASE WHEN (m >> (k - 1)) % 2 = 1 THEN k ELSE 0 END)) AS BIGINT) AS w
      FROM (SELECT n, unnest(range(0, CAST(pow(2, n) AS BIGINT))) AS m FROM (SELECT DISTINCT n FROM g))),
c AS (SELECT n, w, count(*) AS c FROM s GROUP BY n, w)
SELECT key, n, CAST(up AS DOUBLE) AS w_plus, CAST(down AS DOUBLE) AS w_minus,
  round(least(1.0, 2 * (SELECT sum(c) FROM c WHERE c.n = g.n AND c.w <= least(up, down)) / pow(2, n)), 9) AS p
FROM g""")
def a5_exact_orders(spark, sf_dir):
    """A5: exact signed-rank tests of every customer with up to twelve untied differences (the
    oracle tries every pattern of signs)."""
    from maskforge.sources import tables as T
    o = T.read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(
        F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 9973).cast("double").alias("x"),
        (F.col("o_custkey") % 9973).cast("double").alias("y"))
    w = A.wilcoxon(o, ["key"], "x", "y").where("exact_p IS NOT NULL AND n <= 12")
    return w.select("key", "n", "w_plus", "w_minus", F.round("p_value", 9).alias("p"))


@register("a7_a8_single_token")
def a7_a8_single_token(spark, sf_dir):
    """The single-token mode's two metrics over the fifteen datasets; comparisons with
    p <= 0.05, p and delta to three decimals."""
    return A.published(_task_report(spark, sf_dir, C.SINGLE_TOKEN_METRICS, single_token=True))
