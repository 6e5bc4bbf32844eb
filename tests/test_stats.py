from pyspark.sql import functions as F

from maskforge.operators import significance as A


def _brute_delta(x, y):
    gt = sum(1 for a in x for b in y if a > b)
    lt = sum(1 for a in x for b in y if a < b)
    return (gt - lt) / (len(x) * len(y))


def test_cliffs_delta_fixture_and_antisymmetry(spark):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip([1, 2, 3, 5, 5, 0],
                                                                  [2, 2, 2, 5, 1, 0]))]
    df = spark.createDataFrame(rows, "id int, x double, y double").withColumn("g", F.lit("g"))
    d = A.cliffs_delta(df, ["g"], "x", "y").collect()[0]["delta"]
    assert abs(d - _brute_delta([1, 2, 3, 5, 5, 0], [2, 2, 2, 5, 1, 0])) < 1e-12
    d2 = A.cliffs_delta(df, ["g"], "y", "x").collect()[0]["delta"]
    assert abs(d + d2) < 1e-12
    small = spark.createDataFrame([(0, 1.0, 2.0), (1, 2.0, 2.0), (2, 3.0, 2.0)],
                                  "id int, x double, y double").withColumn("g", F.lit("g"))
    assert abs(A.cliffs_delta(small, ["g"], "x", "y").collect()[0]["delta"]) < 1e-12


def test_wilcoxon_normal_approximation(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0]
    y = [1.5, 1.0, 3.5, 2.0, 5.5, 4.0, 7.5, 6.0, 9.5, 8.0]
    df = spark.createDataFrame([(a, b) for a, b in zip(x, y)], "x double, y double") \
        .withColumn("g", F.lit("g"))
    r = A.wilcoxon(df, ["g"], "x", "y").collect()[0]
    # d = -.5,1,-.5,2,-.5,2,-.5,2,-.5,2 ; |d| ranks: 0.5 x5 -> 3, 1 -> 6, 2 x4 -> 8.5
    assert r["n"] == 10 and abs(r["w_plus"] - (6 + 4 * 8.5)) < 1e-9
    assert abs(r["w_minus"] - 15) < 1e-9
    assert 0 < r["p_value"] < 1


def test_ranks_at_volume(spark):
    """200,000 distinct values over many ranges equal numpy's ranks."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(8)
    x, y = rng.normal(0, 1, 200_000), rng.normal(0.1, 1, 200_000)
    df = spark.createDataFrame(pd.DataFrame({"g": "g", "x": x, "y": y}), "g string, x double, y double")
    r = A.wilcoxon(df, ["g"], "x", "y").collect()[0]
    d = x - y
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    assert np.isclose(r.w_plus, ranks[d > 0].sum()) and np.isclose(r.w_minus, ranks[d < 0].sum())
    n = len(d)
    assert np.isclose(r.w_plus + r.w_minus, n * (n + 1) / 2)
    both = pd.Series(np.r_[x, y]).rank().to_numpy()
    u = both[:n].sum() - n * (n + 1) / 2
    assert np.isclose(A.cliffs_delta(df, ["g"], "x", "y").collect()[0].delta, 2 * u / n / n - 1)


def test_five_million_pairs_do_not_overflow(spark):
    df = spark.range(5_000_000).select(F.lit("g").alias("g"), (F.col("id") % 1000).cast("double").alias("x"),
                                       (F.col("id") % 7 * 100).cast("double").alias("y"))
    r = A.wilcoxon(df, ["g"], "x", "y").collect()[0]
    assert r.n > 4_000_000 and abs(r.w_plus + r.w_minus - r.n * (r.n + 1) / 2) < 1
    assert -1 <= A.cliffs_delta(df, ["g"], "x", "y").collect()[0].delta <= 1


def test_report_lists_missing_populations(spark):
    rows = [(i, p, "m", float(i % 5 + k), i == 3) for k, p in enumerate(("a", "b")) for i in range(30)]
    long = spark.createDataFrame(rows, "id long, population string, metric string, value double, empty boolean")
    planned = A.catalogue(spark, (("a", "b"), ("a", "c"), ("c", "d")), ("m",))
    got = {(r.pop1, r.pop2): r for r in A.report(long, planned, ["id"]).collect()}
    assert got["a", "b"].pairs == 29 and got["a", "b"].significant and got["a", "b"].missing == ""
    assert got["a", "c"].missing == "c" and got["c", "d"].missing == "c,d" and got["a", "c"].p_value is None


def test_exact_distribution_equals_enumeration():
    for n in range(1, 15):
        brute = [0] * (n * (n + 1) // 2 + 1)
        for m in range(1 << n):
            brute[sum(k + 1 for k in range(n) if m >> k & 1)] += 1
        assert A.rank_sum_counts(n) == brute
    assert sum(A.rank_sum_counts(20)) == 2 ** 20 and A.rank_sum_counts(20)[60] == A.rank_sum_counts(20)[150]


def test_exact_p_up_to_fifty_untied_differences(spark):
    def p(values):
        df = spark.createDataFrame([("g", float(v), 0.0) for v in values], "g string, x double, y double")
        return A.wilcoxon(df, ["g"], "x", "y").first()

    assert p(range(1, 6)).p_value == 2 / 2 ** 5 and p([1, 2, 3, -4, 5, 0, 0]).p_value == 2 * 7 / 2 ** 5
    assert p([1, -2]).p_value == 1.0
    assert p([1, 1, 2]).exact_p is None and 0 < p([1, 1, 2]).p_value < 1  # ties
    fifty, more = p(range(1, 51)), p(range(1, 52))
    assert fifty.p_value == 2 / 2 ** 50 and more.exact_p is None and more.p_value < 1e-6


def test_published_keeps_significant_rows_alone(spark):
    rows = [(i, p, m, float(i % 7 + (k if m == "m" else 0)), False) for k, p in enumerate(("a", "b")) for i in range(40) for m in ("m", "o")]
    long = spark.createDataFrame(rows, "id long, population string, metric string, value double, empty boolean")
    got = A.published(A.report(long, A.catalogue(spark, (("a", "b"), ("a", "c")), ("m", "o")), ["id"])).collect()
    assert [(r.pop1, r.pop2, r.metric, r.pairs, r.p, r.of) for r in got] == [("a", "b", "m", 40, 0.0, 1)]
