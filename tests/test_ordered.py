import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from maskforge.operators import ordered, sampling


def test_cumulative_matches_pandas(spark):
    rng = np.random.default_rng(3)
    # one hot group holding most rows, plus small ones
    keys = rng.choice(["hot", "a", "b"], size=3000, p=[0.8, 0.1, 0.1])
    vals = rng.normal(size=3000).round(3)
    rows = [(str(k), i, float(v)) for i, (k, v) in enumerate(zip(keys, vals))]
    df = spark.createDataFrame(rows, "k string, o long, v double")
    out = ordered.cumulative(df, ["k"], ["o"], sums=["v"], maxes=["v"], count_col="n",
                             partitions=7).toPandas().sort_values(["k", "o"])
    import pandas as pd
    ref = pd.DataFrame(rows, columns=["k", "o", "v"]).sort_values(["k", "o"])
    ref["run"] = ref.groupby("k")["v"].cumsum()
    ref["mx"] = ref.groupby("k")["v"].cummax()
    ref["n"] = ref.groupby("k").cumcount() + 1
    assert np.allclose(out["run_v"].values, ref["run"].values)
    assert np.allclose(out["runmax_v"].values, ref["mx"].values)
    assert (out["n"].values == ref["n"].values).all()


def test_sliding_window_matches_pandas(spark):
    rows = [("g" if i % 5 else "h", i, float(i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, v double")
    out = ordered.sliding_window(df, ["k"], ["o"], "v", 10, "w", partitions=6) \
        .toPandas().sort_values(["k", "o"])
    import pandas as pd
    ref = pd.DataFrame(rows, columns=["k", "o", "v"]).sort_values(["k", "o"])
    ref["s"] = ref.groupby("k")["v"].transform(lambda s: s.rolling(10, min_periods=1).sum())
    assert np.allclose(out["w_sum"].values, ref["s"].values)


def test_split_independent_of_partitioning(spark):
    df = spark.range(2000).select(F.concat(F.lit("f/"), F.col("id").cast("string")).alias("p"))
    a = df.repartition(1).select("p", sampling.weighted_split(F.col("p")).alias("s"))
    b = df.repartition(8).select("p", sampling.weighted_split(F.col("p")).alias("s"))
    assert sorted(a.collect()) == sorted(b.collect())
    counts = {r["s"]: r["count"] for r in a.groupBy("s").count().collect()}
    assert set(counts) == {"train", "test", "dev"} and counts["train"] > counts["test"]


def test_running_values_over_many_ranges_with_and_without_exchange_reuse(spark):
    rng = np.random.default_rng(5)
    n = 200_000
    keys = rng.choice(["hot", "a", None], size=n, p=[0.7, 0.2, 0.1])
    pdf = pd.DataFrame({"k": keys, "o": rng.permutation(n), "v": rng.integers(-5, 9, n), "extra": rng.random(n)})
    df = spark.createDataFrame(pdf, "k string, o long, v long, extra double")
    ref = pdf.sort_values("o")
    group = ref["k"].fillna("~")
    want = dict(zip(ref["o"], zip(ref.groupby(group)["v"].cumsum(), ref.groupby(group)["v"].cummax(),
                                  ref.groupby(group).cumcount() + 1)))
    for reuse, parts in (("true", 3), ("false", 8), ("true", 64)):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        out = ordered.cumulative(df, ["k"], ["o"], sums=["v"], maxes=["v"], count_col="n", partitions=parts)
        got = out.select("o", "run_v", "runmax_v", "n", "extra").toPandas()
        spark.conf.set("spark.sql.exchange.reuse", "true")
        assert len(got) == n
        assert dict(zip(got["o"], zip(got["run_v"], got["runmax_v"], got["n"]))) == want


def test_leading_nulls_have_no_maximum(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 4.0), (4, None), (5, 2.0)], "o long, v double")
    got = {r.o: (r.run_v, r.runmax_v) for r in ordered.cumulative(df, [], ["o"], ["v"], ["v"], partitions=3).collect()}
    assert got == {1: (0.0, None), 2: (0.0, None), 3: (4.0, 4.0), 4: (4.0, 4.0), 5: (6.0, 4.0)}


def test_sliding_window_longer_than_blocks(spark):
    rows = [("g", i, float(i % 13)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v double")
    got = ordered.sliding_window(df, ["k"], ["o"], "v", 5, "w", partitions=9).toPandas().sort_values("o")
    want = pd.DataFrame(rows, columns=["k", "o", "v"])["v"].rolling(5, min_periods=1)
    assert np.allclose(got["w_sum"], want.sum()) and (got["w_n"].to_numpy() == want.count().to_numpy()).all()
    assert len(got) == 3000


def test_staged_folders_can_be_dropped(spark):
    from maskforge.session import drop_stages, stage_path
    path = stage_path(spark, "unit-test")
    spark.range(3).write.parquet(path)
    assert drop_stages(spark) >= 1 and drop_stages(spark) == 0
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def test_global_sample_equals_sort_and_limit(spark, monkeypatch):
    import hashlib

    from maskforge.operators import sampling
    monkeypatch.setattr(sampling, "LAST_BUCKET", 3)
    df = spark.range(2000).repartition(7)
    order = sorted(range(2000), key=lambda i: hashlib.md5(f"{i}-42".encode()).hexdigest())
    for n in (0, 1, 17, 500, 1999, 2000, 5000):
        assert sorted(r.id for r in sampling.global_sample(df, "id", n).collect()) == sorted(order[:n])
    copies = df.where("id < 5").unionByName(spark.range(1000).selectExpr("3 AS id"))
    got = [r.id for r in sampling.global_sample(copies, "id", 3).collect()]
    assert len(got) >= 3 and (3 not in got or got.count(3) == 1001)
    assert sampling.global_sample(df.limit(0), "id", 3).count() == 0


def test_broken_json_lines_are_put_aside(spark, tmp_path):
    from maskforge.sources import sinks
    lines = ['{"input": "a", "gt": "b", "marker": "m"}', '{"input": "a", "gt"', "[1]", "", "  ", "7", '{"input": 5}', "{}", "null",
             '{"gt": null, "more": [1, {"x": 2}]}']
    (tmp_path / "in.json").write_text("\n".join(lines))
    rows = sinks.read_json_lines(spark, str(tmp_path / "in.json"), sinks.TASK_SCHEMA)
    good = sinks.quarantine(rows, str(tmp_path / "broken"))
    assert sorted((r.input or "", r.gt or "", r.marker or "") for r in good.collect()) == [
        ("", "", ""), ("", "", ""), ("5", "", ""), ("a", "b", "m")]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "broken")).collect()) == sorted([lines[1], "[1]", "7", "null"])
