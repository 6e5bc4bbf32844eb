"""Scores made with less work are the scores of the definitions; pairs of rows are joined once."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from maskforge.functions import lexer as L
from maskforge.functions.stem import stem
from maskforge.operators import metrics as E
from maskforge.operators import significance as A
from maskforge.operators import slots as O

WORDS = ["a", "b", "run", "running", "runs", "A", "", " ", "cat", "cats"]


def _bleu(ref, hyp):
    nums, dens = [], []
    for n in range(1, 5):
        h, r = (Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in (hyp, ref))
        nums.append(sum(min(c, r[g]) for g, c in h.items()))
        dens.append(max(1, sum(h.values())))
    if nums[0] == 0:
        return 0.0
    bp = 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    logs = [math.log(nums[0] / dens[0])] + [math.log((nums[i] + 1) / (dens[i] + 1)) for i in range(1, 4)]
    return bp * math.exp(sum(0.25 * x for x in logs))


def _meteor(ref, hyp, synonyms):
    if not hyp or not ref:
        return 0.0
    hyp, ref = [w.lower() for w in hyp], [w.lower() for w in ref]
    to = {}
    for keys in (lambda w: {w}, lambda w: {stem(w)}, lambda w: set(synonyms.get(w, ()))):
        for i in reversed(range(len(hyp))):
            fits = [j for j in range(len(ref)) if j not in to.values() and keys(hyp[i]) & keys(ref[j])]
            if i not in to and fits:
                to[i] = max(fits)
    if not to:
        return 0.0
    p, r = len(to) / len(hyp), len(to) / len(ref)
    chunks = len(to) - sum(to.get(i + 1) == j + 1 for i, j in to.items())
    return (1 - 0.5 * (chunks / len(to)) ** 3.0) * (p * r / (0.9 * p + 0.1 * r))


def test_kernels_by_definition():
    rng = random.Random(5)
    synonyms = {"cat": ("x",), "a": ("x", "y"), "b": ("y",)}
    for _ in range(3000):
        ref, hyp = (rng.choices(WORDS, k=rng.randint(0, 9)) for _ in range(2))
        assert E.bleu4(ref, hyp) == _bleu(ref, hyp)
        assert math.isclose(E.meteor(ref, hyp, synonyms), _meteor(ref, hyp, synonyms), abs_tol=1e-12)


def test_longer_grams_are_made_only_where_shorter_agree():
    class Word(str):
        made = 0

        def __hash__(self):
            Word.made += 1
            return super().__hash__()

    words = [Word(w) for w in "abcdefgh"]
    assert E.bleu4(words, words[::-1]) > 0  # every word is common, no pair of words
    assert Word.made <= 100


def _rows(spark):
    rng = random.Random(1)
    rows = [(k, pop, rng.random() < 0.1, rng.randint(0, 1), rng.choice([0.0, 0.5, 1.0, None]))
            for k in [*range(12), None, 3] for pop in ("a", "b", "c") if rng.random() < 0.9]
    return spark.createDataFrame(rows, "id long, population string, empty boolean, m int, o double")


def test_rows_are_compared_as_their_metrics(spark, monkeypatch):
    rows = _rows(spark)
    long = rows.select("id", "population", "empty", F.explode(F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("m", "o")])).alias("v")).select("id", "population", "empty", "v.*")
    planned = A.catalogue(spark, (("a", "b"), ("b", "c"), ("a", "d")), ("m", "o"))
    want = sorted(map(repr, A.report(long, planned, ["id"]).collect()))
    plans, stage = [], A.ordered.stage
    monkeypatch.setattr(A.ordered, "stage", lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), stage(df, name))[1])
    assert sorted(map(repr, A.report_rows(rows, planned, ["id"], ("m", "o")).collect())) == want and len(want) == 6
    plan = dict(plans)["paired"]
    assert plan[plan.index("Generate"):].count("Join") == 2  # metrics are parted above the join of rows


def test_slots_are_coded_by_text(spark):
    texts = ["const a: b = function (c: d, e): f { let g; }\nvar h /* i */: j // k\n", "", "x ? `${y}` : #z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(L.token_values(F.col("t")).alias("v"), O.slot_code(F.col("t")).alias("c")).collect():
        assert O._CODES.of(r.v) == r.c
    plan = O.with_slots(df, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert L.REGEX not in plan  # no class is named on the way
