"""Token texts read in Python tell what expressions over tokens tell, and files are made after the shuffle."""

import random

from pyspark.sql import functions as F

from maskforge import config as C
from maskforge.functions import lexer as L
from maskforge.functions import normalize as N
from maskforge.functions import spans as S
from maskforge.functions import untype
from maskforge.functions import values as V
from maskforge.operators import marking as K
from maskforge.sources import tables as T

TEXTS = [
    "/** d\n * e */\nlet a = `x${b}`, c = 'q\\'' + 1_0 + .5 + 0x1F; // s\r\n#p #; /* m */ d?.e => f <= g >>= 1\n",
    "h = /r[/]/g.test(`t`); é  　﻿ \x07 \\ @ i : j < k... /* open", "`${ ", "`open", "'", "a /*<marker:1>*/  /* \n */ b",
    "\n\n  \t\n \n/**\n*/  x /* y */ /**\n z */ w\r\r\n", "a ﷐ b﷑\n\n // ﷐ c\n\n\nd", "", "﷑\n\n /* ﷐  */  e",
    "type T<U> = A; class C extends D { k!: E } export default async (f?: G) => h as I satisfies J | keyof K & typeof l;",
]


def _values(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    return df.select("i", "t", L.tokenize(F.col("t")).alias("k"))


def test_classes_and_codes_of_texts(spark):
    rows = _values(spark).select("k", F.transform("k", S.token_code).alias("c"), F.transform("k", untype.syntax_code).alias("u")).collect()
    seen = set()
    for r in rows:
        values = [t.value for t in r.k]
        assert [V.token_class(v) for v in values] == [t.type for t in r.k]
        assert S.value_codes().of(values) == "".join(r.c)
        assert untype._CODES.of(values) == "".join(r.u)
        seen |= {t.type for t in r.k}
    assert len(seen) >= 13


def test_class_texts_are_those_of_expressions(spark):
    df = _values(spark)
    for literals in (True, False):
        masks = list(range(8))
        whole = df.select("i", "k", *[N.preprocess_tokens(F.col("k"), m, literals).alias(f"m{m}") for m in masks]).collect()
        for r in whole:
            texts = V.ClassTexts([t.value for t in r.k], literals, masks)
            assert texts.whole() == [r[f"m{m}"] for m in masks]
        for n in (0, 1, 3, 6):
            heads = df.select("k", *[N.preprocess_tokens(F.slice("k", 1, n), m, literals).alias(f"m{m}") for m in masks]).collect()
            for r in heads:
                got = V.ClassTexts([t.value for t in r.k], literals, masks).heads([len(r.k), min(n, len(r.k))])
                assert [g[1] for g in got] == [r[f"m{m}"] for m in masks]


def test_scans_pass_over_what_decides_nothing():
    class Slow(untype.Scan):
        def __init__(self, code):
            super().__init__(code)
            n = len(code)
            self.line, self.next, self.before = [n] * (n + 2), [n] * (n + 2), [-1] * (n + 1)
            for i in range(n - 1, -1, -1):
                self.line[i] = self.line[i + 1] if code[i] == "w" else i
                self.next[i] = self.next[i + 1] if code[i] in "wn" else i
            for i in range(1, n + 1):
                self.before[i] = self.before[i - 1] if code[i - 1] in "wn" else i - 1

    rng = random.Random(2)
    for _ in range(2000):
        code = "".join(rng.choices("VFiKwwnnl()[]{}<>:,;=", k=rng.randint(0, 30)))
        fast, slow = untype.Scan(code), Slow(code)
        assert (fast.line, fast.next, fast.before) == (slow.line, slow.next, slow.before)


def test_markers_of_a_text():
    text = ("/*<marker:0>*/a /*<marker:1>*/b\n/*<marker:2>*/\n/*<marker:3>*/ /* c */ // d\n/*<marker:4>*/ /* c */ e\n"
            "/*<marker:5>*//re/.f /*<marker:6>*/g /*<marker:6>*/h\n/*<marker:7>*/")
    assert K.valid_names(text) == ["/*<marker:1>*/", "/*<marker:4>*/", "/*<marker:5>*/"]
    assert K.truth_lines(text, ["/*<marker:1>*/", "/*<marker:4>*/"]) == ["b", " /* c */ e"]
    assert K.truth_lines(text, ["/*<marker:1>*/", "/*<marker:2>*/"]) is None
    assert K.truth_lines(text, ["/*<marker:6>*/"]) is None
    assert K.capped("p", list("abc"), 2) == K.capped("p", list("abc"), 2) and len(K.capped(None, list("abc"), 2)) == 2


def test_files_are_made_after_the_shuffle(spark, tmp_path):
    rows = [(1, 2, 20, 5, "R", "O"), (1, 1, 10, 6, "A", "F"), (2, 1, 7, 7, None, "F"), (None, 3, 9, 9, "N", "O"), (1, 1, 10, 6, "A", "F")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string") \
        .write.parquet(str(tmp_path / "lineitem.parquet"))
    files = T.code_corpus(spark, str(tmp_path))
    plan = files._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange", 1)[1]
    assert plan.count("Exchange") == 1 and "collect_list" not in below and "concat" not in below
    got = {r.path: r.content for r in files.collect()}
    line = lambda n, p, s, f, o: (f"const q{n}: number = {p}; // {f}\n/* {o} */ let s{s} /* k */ = \"{f}\";\n"
                                  + (f"function f{p}(a: number, b) {{\n  return `${{a}}-{s}`;\n}}\n" if n == 3 else "") + "\n" * (n == 2))
    order = "/**\n * order 1\n */\n"
    assert got[1] == (order + line(1, 10, 6, "A", "F")) * 2 + line(2, 20, 5, "R", "O")
    assert got[2] == "" and got[None] == line(3, 9, 9, "N", "O")


def test_variants_are_not_written(spark, monkeypatch):
    from maskforge.operators import ordered
    monkeypatch.setattr(ordered, "stage", lambda df, name: 1 / 0)
    files = spark.createDataFrame([("p", "let a: A = 1;\nlet b = `${c}`;\nlet d;\n")], "path string, content string")
    raw = K.raw_tasks(K.variant_frame(files))
    assert "RegularExpressionLiteral" not in raw._jdf.queryExecution().optimizedPlan().toString()  # no class is named
    assert K.tasks(raw).count() == 15 * K.add_markers(files).first().n_markers > 0
    assert K.tasks(K.raw_tasks(K.variant_frame(files.limit(0)))).count() == 0


def test_a_batch_of_tasks_goes_back_in_parts(spark, monkeypatch):
    monkeypatch.setattr(K, "_OUT_CHARS", 40)
    text = "let a /*<marker:0>*/= 1;\nlet b /*<marker:1>*/= 'q';\n"
    wide = spark.createDataFrame([(i, text, text, text) for i in range(3)], "path long, normal string, explicit string, untyped string")
    rows = K.tasks(K.raw_tasks(wide), False, C.COMMENT_CLASSES).collect()
    assert len(rows) == 3 * 3 * 2 * 5 and {(r.ordinal, r.input, r.gt) for r in rows} == {
        (0, "let a ", "= 1;"), (1, "let a = 1;\nlet b ", "= 'q';")}
