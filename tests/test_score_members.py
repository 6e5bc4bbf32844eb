"""Metric rows of tasks whose comment classes agree are those of every class scored alone."""

from pyspark.sql import functions as F

from maskforge.operators import metrics as E

PAIRS = [("line", "a = 1;", "a = 2;"), ("doc", "a = 1;", "a = 2;"), ("none", "f(x) /* c */", "f(x)"), ("all", "a", ""), ("nul", None, "b c")]


def _groups(spark):
    rows = [(1, PAIRS), (2, PAIRS[:2] * 2), (2, PAIRS[2:]), (3, [])]
    return spark.createDataFrame(rows, "k long, m array<struct<name:string,gt:string,prediction:string>>")


def test_members_score_like_rows(spark):
    groups = _groups(spark)
    for single in (False, True):
        got = E.score_members(groups, "m", single)
        want = E.score(groups.select("k", F.explode("m").alias("m")).select("k", "m.*"), single)
        assert got.columns == want.columns
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
        assert want.count() == 12


def test_equal_members_are_lexed_once(spark, monkeypatch):
    asked = []
    score = E.score
    monkeypatch.setattr(E, "score", lambda pairs, single=False: (asked.append(pairs.count()), score(pairs, single))[1])
    assert E.score_members(_groups(spark), "m").count() == 12
    assert asked == [8]
