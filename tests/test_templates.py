"""Nested templates: texts without plain slashes are read in long jumps, with the automaton's result."""

import random

from pyspark.sql import functions as F

from maskforge.functions import lexer as L
from maskforge.functions import templates
from maskforge.plans import q_syntax


def nested(depth):
    return "`it's ${f({k: '`', l: {m: 1}}, " * depth + "x" + ") /* ` */} or }`" * depth


def test_plain_texts_have_the_same_templates():
    rng = random.Random(6)
    parts = ["`", "${", "}", "{", "'", '"', "a b ", "\n", "\\", "/*", "*/", "//", "$", "(", "*", "/", "\r\n", "é", "return ", "=", "}`"]
    plain = 0
    for k in range(6000):
        some = [p for p in parts if p != "/" or k % 2]
        text = "".join(rng.choices(some, k=rng.randint(1, 40)))
        found = templates.plain_templates(text, L._JUMPS)
        if found is not None:
            plain += 1
            assert found == templates.outer_templates(text, L._JUMPS), text
    assert plain > 3000


def test_plain_texts_need_no_tokens(monkeypatch):
    def used(*_):
        raise AssertionError("the automaton over tokens was asked")

    text = "a = " + nested(12) + " + 'b`${' + `c`; // `${"
    want = templates.fold_text(text, L._JUMPS)
    assert want.count(templates.MARK) == 12
    monkeypatch.setattr(templates, "outer_templates", used)
    assert templates.fold_text(text, L._JUMPS) == want


def test_long_strings_are_one_token(spark):
    """A text's plain characters are one step of the pattern, not one each."""
    text = "'" + "x" * 200_000 + "' + `" + "y" * 200_000 + "${a}`"
    df = spark.createDataFrame([(text,)], "t string").select(L.token_values(F.col("t")).alias("v"))
    assert [len(v) for v in df.first().v] == [200_002, 1, 1, 1, 200_006]


def test_template_groups_of_own_rows(spark, tmp_path):
    rows = [(k, k % 7 + 1, k * 3, k % 10, "ANR"[k % 3], "OF"[k % 2]) for k in range(40)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, "
                               "l_linestatus string")
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.flag, r.depth): (r.files, r.templates, r.template_chars, r.strings_outside)
           for r in q_syntax.p2_template_groups(spark, str(tmp_path)).collect()}
    want = {}
    for _, n, part, supp, flag, _ in rows:
        depth = n + supp % 6
        chars = len("`it's ${f({k: \"") * depth + len(flag + '`"}, ') * depth + len(str(part)) + len(") /* ` */} or }`") * depth
        f, t, c, s = want.get((flag, depth), (0, 0, 0, 0))
        want[flag, depth] = f + 1, t + 2, c + chars + 2, s + 3
    assert got == want
