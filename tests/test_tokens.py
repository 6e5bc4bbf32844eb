import random
import time

from pyspark.sql import functions as F

from conftest import one
from maskforge.functions import lexer as L
from maskforge.functions import normalize as N
from maskforge.functions import spans as S
from maskforge.operators import curation as D
from maskforge.operators import marking as K


def test_round_trip(spark):
    cases = ["const x: number = 1", "x = `a${b + `c${d}`}e` + 'q' + /re[/]x/g / 2 // t\r\nz",
             "/** doc\n * l\n */\nlet y = 'open\n$$ héllo", "a = b / c / d; f(/x/)"]
    for c in cases:
        assert one(spark, lambda t: L.join_values(L.tokenize(t)), c) == c


def test_remove_comments_fixtures(spark):
    assert one(spark, L.remove_comments, "run(); // 7 x") == "run(); "
    assert one(spark, L.remove_comments, "a /* b 9 */ c = d") == "a  c = d"


def _grouped_types(spark, text):
    df = spark.createDataFrame([(text,)], "content string")
    g = S.with_grouped_tokens(df, "content", "toks")
    return [(t["type"], t["value"]) for t in g.collect()[0]["toks"]]


def test_potential_type_fixtures(spark):
    want = ["IdentifierName", "WhiteSpace", "IdentifierName", "PotentialType", "Punctuator",
            "WhiteSpace", "NumericLiteral"]
    for text in ("const x: number = 1", "const x: Record<string, number> = 1"):
        toks = _grouped_types(spark, text)
        assert [t for t, _ in toks] == want
        assert "".join(v for _, v in toks) == text


def test_maskable_equal_with_and_without_annotation(spark):
    a = _grouped_types(spark, "const x = [1,2,3,4];")
    b = _grouped_types(spark, "const x: number[] = [1,2,3,4];")
    m = [v for t, v in a if t in L.MASKABLE]
    n = [v for t, v in b if t in L.MASKABLE]
    assert m == n


def test_fold_spans_carried_depth():
    # closers do not terminate; depth carries after an unterminated span
    vals = [":", ")", ";", "(", ","]
    assert S.fold_spans(list(range(5)), vals) == [0, 3]


def test_loc(spark):
    assert one(spark, D.loc, "a\n\nb\n") == 3


def test_preprocess_fixtures(spark):
    assert one(spark, lambda t: N.preprocess(t, 0, True), "x = 'a' + 12\n") == \
        "x = '<STR_LIT>' + <NUM_LIT><EOL>"
    assert one(spark, lambda t: N.preprocess(t, 0, False), "a\n\nb") == "a\nb"
    assert one(spark, lambda t: N.preprocess(t, 0, False), "a\n \nb") == "a\n \nb"
    # whitespace after a removed comment collapses, indentation is kept
    assert one(spark, lambda t: N.preprocess(t, 0, False), "a /* c */ b\n  /* d */ x") == \
        "a b\n   x"
    # docblock survives DOCBLOCK, plain multi-line does not
    assert one(spark, lambda t: N.preprocess(t, 4, False), "/** d */a/* m */") == "/** d */a"
    assert one(spark, lambda t: N.preprocess(t, 2, False), "/** d */a/* m */") == "/** d */a/* m */"


def _wide(spark, *texts):
    return spark.createDataFrame([(i, t, t, t) for i, t in enumerate(texts)],
                                 "path long, normal string, explicit string, untyped string")


def test_tasks_of_a_marked_text(spark):
    raw = K.raw_tasks(_wide(spark, "ab/*<marker:0>*/cd // e\nef", "x/*<marker:0>*/\ny", "/*<marker:0>*/z"))
    got = sorted((r.path, r.variant, r.comments, r.input, r.gt) for r in K.tasks(raw, False).collect())
    assert len(got) == 15 and {(p, i, g) for p, _, _, i, g in got} == {(0, "ab", "cd")}
    dup = spark.createDataFrame([("a/*<marker:0>*/b/*<marker:0>*/c/*<marker:1>*/d\n",)], "c string")
    assert dup.select(K.valid_markers(F.col("c")).alias("r")).collect()[0]["r"] == ["/*<marker:1>*/"]


def test_inputs_leave_out_other_markers_and_classes(spark):
    text = "// one\nlet a /*<marker:0>*/= 1; /* two */\nlet b /*<marker:1>*/= 'q';\n"
    rows = {(r.comments, r.ordinal): r for r in K.tasks(K.raw_tasks(_wide(spark, text))).collect()
            if r.variant == "normal"}
    assert rows["all", 1].input == "// one<EOL>let a = <NUM_LIT>; /* two */<EOL>let b "
    assert rows["none", 1].input == "<EOL>let a = <NUM_LIT>; <EOL>let b "
    assert rows["single_line", 0].input == "// one<EOL>let a " and rows["none", 1].gt == "= '<STR_LIT>';"


def test_a_file_keeps_fifteen_markers_of_many(spark):
    text = "\n".join(f"let v{i} = {i};" for i in range(80)) + "\n"
    files = spark.createDataFrame([("p/1", text), ("p/2", "let a = 1;\nlet b = 2;\nlet c = 3;\n")], "path string, content string")
    wide = K.variant_frame(files)
    common = {r.path: r.common for r in K.common_markers(wide).collect()}
    assert len(common["p/1"]) == 15 and common["p/1"] == sorted(common["p/1"], key=lambda m: int(m[10:-3]))
    tasks = K.tasks(K.raw_tasks(wide)).groupBy("path", "variant", "comments").count().collect()
    assert {r["count"] for r in tasks if r.path == "p/1"} == {15} and len(tasks) == 30


def test_spans_carry_depth_and_never_rescan():
    def slow(idx, vals):
        depth, out, k = dict.fromkeys("{<[(", 0), [], 0
        pair = dict(zip("}>])", "{<[("))
        while k < len(vals):
            end = None
            if vals[k] == ":":
                for m in range(k + 1, len(vals)):
                    v = vals[m]
                    if v in depth:
                        depth[v] += 1
                    elif v in pair:
                        depth[pair[v]] -= 1
                    elif v in "=,;" and not any(depth.values()):
                        end = m
                        break
            if end is None:
                k += 1
            else:
                out += [idx[k], idx[end] - 1]
                k = end
        return out

    rng = random.Random(4)
    for _ in range(500):
        vals = [rng.choice(":{}<>[]()=,;:::") for _ in range(rng.randint(0, 25))]
        assert S.fold_spans(list(range(len(vals))), vals) == slow(list(range(len(vals))), vals)


def test_marking_is_linear():
    code = ("mon" * 8 + ":m=" + "n") * 4000
    took = []
    for n in (len(code) // 2, len(code)):
        begin = time.process_time()
        K.marked_places("p", code[:n])
        took.append(time.process_time() - begin)
    assert took[1] < 4 * took[0] + 0.05


def test_marker_count_rule(spark):
    for n, want in ((1, 1), (2, 1), (5, 2), (10, 4)):
        text = "\n".join(f"v{i}" for i in range(n + 2)) + "\n"
        df = spark.createDataFrame([(1, text)], "path long, content string")
        assert K.add_markers(df).collect()[0]["n_markers"] == want


def test_function_body_bounds(spark):
    text = "function f() { if (a) { b(); } /* } */ return `}`; }"
    df = spark.createDataFrame([(text,)], "c string")
    r = df.select(L.tokenize(F.col("c")).alias("t")).select(
        S.function_body_bounds(F.col("t")).alias("b"), "t").collect()[0]
    toks = r["t"]
    assert toks[r["b"]["start"]]["value"] == "{" and toks[r["b"]["end"]]["value"] == "}"
    assert r["b"]["start"] == 6 and r["b"]["end"] == len(toks) - 1


def _tokens(spark, text):
    return [(t["type"], t["value"]) for t in one(spark, L.tokenize, text)]


def test_regular_expressions_by_the_token_before(spark):
    def expressions(text):
        toks = _tokens(spark, text)
        assert "".join(v for _, v in toks) == text
        return [v for t, v in toks if t == L.REGEX]

    assert expressions("a++ / b / c") == []
    assert expressions("x = a / b / c") == []
    assert expressions("f(/[/]x/g, y)") == ["/[/]x/g"]
    assert expressions("x =\n\n" + " " * 4000 + "/q'/.test(z)") == ["/q'/"]
    assert expressions("return /* why / so */ // t\n /a b/i") == ["/a b/i"]
    assert expressions("  /first/.exec(t) / 2") == ["/first/"]
    assert expressions("(a) / b / c; d = [/e/, 1 / 2 / 3]") == ["/e/"]
    assert expressions("returned / b / c") == []


def test_noncharacters_of_the_text_stay(spark):
    text = "a \uFDD0\uFDD0 b\uFDD1  \uFDD1\n\nc\uFDD0"
    assert one(spark, lambda t: N.preprocess(t, 0, False), text) == "a \uFDD0\uFDD0 b\uFDD1  \uFDD1\nc\uFDD0"
