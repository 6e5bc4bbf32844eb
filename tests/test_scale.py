"""Work per row stays small: what is made once, what is not made at all, and that results agree."""

import random

from hashlib import md5

from pyspark.sql import functions as F

from maskforge.functions import lexer as L
from maskforge.functions import normalize as N
from maskforge.functions import spans as S
from maskforge.operators import marking as K
from maskforge.operators import metrics as E
from maskforge.operators import packing as P
from maskforge.plans import q_packing

TEXT = ("/** d\n * e */\nlet a = `x${b}`, c = 'q\\'' + 1_0 + .5 + 0x1F; // s\r\n#p #; /* m */ d?.e => f <= g >> 1\n"
        "h = /r[/]/g.test(`t`); \u00e9 \u2028\u3000\uFEFF \x07 \\ @ i : j < k /* open")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _one(spark, *columns):
    return spark.createDataFrame([(TEXT,)], "t string").select(*[c(F.col("t")) for c in columns]).first()


def test_token_texts_tell_what_tokens_tell(spark):
    codes, texts = _one(spark, lambda t: F.transform(L.tokenize(t), S.token_code),
                        lambda t: F.transform(L.token_values(t), S.value_code))
    assert codes == texts and set("mon=,;:<") <= set(codes)
    classes, comments = _one(spark, lambda t: F.transform(L.tokenize(t), lambda x: x["type"].contains("LineComment")),
                             lambda t: F.transform(L.token_values(t), L.is_comment))
    assert classes == comments and sum(comments) == 4


def test_rendering_by_token_text(spark):
    for literals in (True, False):
        for preserved in range(8):
            one, other = _one(spark, lambda t: N.preprocess(t, preserved, literals),
                              lambda t: N.preprocess_tokens(L.tokenize(t), preserved, literals))
            assert one == other
    df = spark.createDataFrame([(TEXT,)], "t string").select(N.preprocess(F.col("t"), 0, True))
    assert "RegularExpressionLiteral" not in _plan(df)  # no class is named on the way


def test_words_collapse_a_text_once(spark):
    texts = ["", " ", "a", " a  b ", "a\t\tb\x1c", "\u3000a\u00a0 b\x85\u2003", "a b\n c\r\n\x0b\x0cd ", "\x1f\u2029 \u1680 x\u200by"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = df.select("t", q_packing._words(F.col("t")).alias("w"))
    assert {r.t: r.w for r in words.collect()} == {t: t.split() for t in texts}
    assert _plan(words).count("regexp_replace") == 1
    assert _plan(df.select(q_packing._source_tokens(F.col("t")).alias("w"))).count("regexp_replace") == 2


def test_packing_makes_tokens_once(spark):
    df = spark.createDataFrame([(i, "a b c " * i) for i in range(9)], "id long, t string")
    made = df.select("id", q_packing._words(F.col("t")).alias("w"))
    plans = []
    keep = P.ordered.stage
    P.ordered.stage = lambda d, name: (plans.append(_plan(d)), keep(d, name))[1]
    try:
        assert P.packed_blocks(made, "id", "w", 4, 2).count() > 0
    finally:
        P.ordered.stage = keep
    assert plans[0].count("regexp_replace") == 1


def test_places_of_short_rows_are_not_looked_for(spark):
    df = spark.createDataFrame([(["a"] * n, [0]) for n in (0, 1, 3, 4, 9)], "k array<string>, s array<int>")
    out = P.padded_samples(df, "k", "s", 4).select(F.size("k").alias("n"), "block", F.size(F.array_remove("sample", "<pad>")).alias("m"))
    assert "CASE WHEN (size(k" in _plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, 0, 1), (3, 0, 3), (4, 0, 4), (9, 0, 4), (9, 1, 4), (9, 2, 1)]


def test_marked_places_by_groups():
    def slow(path, code):
        heads = S.span_heads(len(code), S.code_spans(code))
        token = [i for i in range(len(code)) if heads[i] >= 0]
        begins = set(S.code_spans(code)[::2])
        kind = ["o" if i in begins else code[i] for i in token]
        lines, suitable, line = 0, [], []
        for g in range(1, len(token) - 1):
            if kind[g] != "n":
                line.append(g)
                continue
            fit = [x for x in line if kind[x] not in "on"]
            lines, line, suitable = lines + bool(line), [], suitable + [fit] * bool(fit)
        n = len(suitable)
        hashed = lambda *x: md5("-".join(map(str, x)).encode()).hexdigest()
        count = min(max(int(n * 0.4), 1), n)
        chosen = sorted(sorted(range(n), key=lambda k: (hashed(path, "42", "line", k), k))[:count])
        return lines, n, [token[min(suitable[k], key=lambda g: hashed(path, "42", "token", k, g))] for k in chosen]

    rng = random.Random(3)
    for k in range(2000):
        code = "".join(rng.choice("{<[(}>])=,;:::mmmmoonnn") for _ in range(rng.randint(1, 40)))
        assert K.marked_places(str(k), code) == slow(str(k), code)


def test_meteor_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(64 << 20))
    df = spark.createDataFrame([(1, ["a"], ["a"])], "id long, r array<string>, h array<string>")
    assert E.with_meteor(df, ["id"], "r", "h").count() == 1
    assert int(spark.conf.get(name).removesuffix("b")) <= 8 << 20
