"""Work that is done once: tokens of a row, renderings of a text, scores of equal pairs."""

import pandas as pd
from pyspark.sql import functions as F

from maskforge import config as C
from maskforge.functions import lexer as L
from maskforge.functions import normalize as N
from maskforge.operators import metrics as E


def test_tokens_stay_out_of_filters(spark):
    df = L.with_tokens(spark.createDataFrame([("a = b / c",), (None,)], "t string"), "t", "k")
    few = df.where(F.size("k") > 2).select(F.size("k").alias("n"), F.get("k", 0)["value"].alias("v"))
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1
    assert "regexp_extract_all" not in plan.split("Generate explode")[0]
    assert [(r.n, r.v) for r in few.collect()] == [(9, "a")]


def test_rendered_once_is_every_class(spark):
    text = "/** d\n * e\n */\n/* m */ a  = 'x' // s\n\n/*<marker:0>*/b(1, `${c}`);\n"
    df = L.with_tokens(spark.createDataFrame([(text,)], "t string"), "t", "k")
    shown = L.held(df, "s", N.rendered(F.col("k"), True))
    for _, mask in C.COMMENT_CLASSES:
        row = shown.select(N.class_text(F.col("s"), mask).alias("a"), N.preprocess(F.col("t"), mask, True).alias("b")).first()
        assert row.a == row.b


def test_equal_pairs_are_scored_once(monkeypatch):
    calls = []
    monkeypatch.setattr(E, "bleu4", lambda r, h: calls.append(1) or 0.5)
    gt, words = pd.Series(["a b"] * 3 + ["c"]), pd.Series([["a", "b"]] * 3 + [["c"]])
    out = E._metric_udf.func(gt, gt, words, words)
    assert len(calls) == 2 and list(out["levenshtein"]) == [1.0] * 4
