import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import one
from maskforge.functions import lexer as L
from maskforge.functions import normalize as N
from maskforge.functions import sequences as Q
from maskforge.functions import spans as S
from maskforge.functions import templates
from maskforge.functions import untype


def tokens_of(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return L.with_tokens(df, "text", "toks")


def values(spark, text):
    return [t.value for t in tokens_of(spark, text).first().toks]


def bounds(spark, text):
    return tokens_of(spark, text).select(S.function_body_bounds(F.col("toks")).alias("b")).first().b


# --- P2, P4 -----------------------------------------------------------------------------------
def nested(depth, core="x"):
    return "`it's ${f({k: '`', l: {m: 1}}, " * depth + core + ") /* ` */} or }`" * depth


@pytest.mark.parametrize("depth", [1, 2, 3, 10, 40])
def test_nested_templates_are_one_token(spark, depth):
    text = "a = " + nested(depth) + " + 'b`${' + `c`;"
    got = values(spark, text)
    assert "".join(got) == text
    assert got[4] == nested(depth) and got[-2] == "`c`" and "'b`${'" in got
    clean = tokens_of(spark, text).select(N.preprocess_tokens(F.col("toks"), 0, True).alias("s")).first().s
    assert clean == "a = `<STR_LIT>` + '<STR_LIT>' + `<STR_LIT>`;"


def test_what_only_looks_like_a_template(spark):
    for text, want in [
        ("/[`]/.test(`${a}`)", "`${a}`"),
        ("x = /`${/; y = `${a}`", "`${a}`"),
        ("// `${\n`${b}`", "`${b}`"),
        ("'`${' + `${c}`", "`${c}`"),
        ("{ /`/ } `${d /* } */ + '}' + /}/}`", "`${d /* } */ + '}' + /}/}`"),
        ("`\\${ \\` $ {` + `${e}`", "`${e}`"),
    ]:
        got = values(spark, text)
        assert "".join(got) == text and want in got, (text, got)


def test_unclosed_templates_stay(spark):
    for text in ("`${a", "`a ${b} c", "x `${`${`", "`${a}`} `${b}`", "`${a}\\"):
        assert "".join(values(spark, text)) == text


def test_random_templates_keep_their_text(spark):
    random.seed(4)
    parts = ["`", "${", "}", "{", "'", '"', "/", "a", " ", "\n", "\\", "/*", "*/", "//", "$", "(", ")"]
    texts = ["".join(random.choices(parts, k=random.randint(1, 40))) for _ in range(400)]
    df = L.with_tokens(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "v")
    assert all("".join(x.value for x in r.v) == r.t for r in df.collect())


def test_automaton_is_linear():
    def seconds(n):
        text = nested(3) * n + "{" * n + "`${" * n
        begin = time.perf_counter()
        templates.outer_templates(text, L._JUMPS)
        return time.perf_counter() - begin

    seconds(100)
    assert seconds(16000) < 12 * max(seconds(4000), 1e-3)


# --- P14 --------------------------------------------------------------------------------------
@pytest.mark.parametrize("body", [
    "{}", "{ return 1; }", "{ if (a) { b(); } }", "{ /* } */ }", "{ // }\n }", "{ return `}`; }",
    "{ return `${a}`; }", "{ return `${ {b: 1}.b }`; }", "{ const s = '}{'; }", "{ x = { y: { z: 1 } }; }",
])
def test_body_bounds(spark, body):
    head = "function f(a, b = {c: 1}) "
    b = bounds(spark, head + body + " // {")
    toks = values(spark, head + body + " // {")
    assert "".join(toks[:b.start]) == head and "".join(toks[b.start:b.end + 1]) == body


def test_body_bounds_without_braces(spark):
    assert bounds(spark, "a = 1") is None and bounds(spark, "} a }").start == -1


# --- P15 --------------------------------------------------------------------------------------
def tokens(t):
    return F.filter(L.tokenize(t), lambda x: x["type"] != L.WHITESPACE)


def test_typed_prefix(spark):
    name, sign = L.IDENTIFIER, L.PUNCTUATOR

    def got(text, kinds, start=0):
        return [x.value for x in one(spark, lambda t: Q.typed_prefix(tokens(t), kinds, start), text)]

    assert got("a : b = 1", [name, sign, name]) == ["a", ":", "b"]
    assert got("a : b", [name, name]) == [] and got("a :", [name, sign, name]) == [] and got("", [name]) == []
    assert got("a : b", []) == [] and got("let a : b", [name, sign, name], 1) == ["a", ":", "b"]


def test_between_and_split(spark):
    left, right = (L.PUNCTUATOR, "("), (L.PUNCTUATOR, ")")

    def got(text):
        df = spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t")).alias("k"))
        df = df.withColumn("b", Q.between(F.col("k"), left, right)).withColumn("in", Q.inner(F.col("k"), F.col("b")))
        r = df.withColumn("s", Q.split_on(F.col("in"), L.PUNCTUATOR, ",")).select(
            "b", "in", F.transform("s", lambda x: F.transform(Q.part(F.col("in"), x), lambda t: t["value"])).alias("s")).first()
        return r.b and tuple(r.b), r.s

    assert got("f(a, b: c) + (d)") == ((1, 7), [["a"], ["b", ":", "c"]])
    assert got("f()") == ((1, 2), [[]]) and got("f(a") == ((1, 3), [["a"]])
    assert got(") (a, (b) c)") == ((1, 6), [["a"], ["(", "b"]]) and got("a b")[0] is None
    assert got("f(,)") == ((1, 3), [[], []])


# --- D12 --------------------------------------------------------------------------------------
CASES = [
    # variables
    ("const x: number = 1", "const x = 1"),
    ("let a: A<B<C>>= 1, b, c: D = f(x, y) ? z : w;", "let a= 1, b, c = f(x, y) ? z : w;"),  # one >>= token
    ("let a: A<B<C<D>>> = 1, b: (x: number) => string;", "let a = 1, b;"),
    ("let { a, b: c }: { a: number; b: string } = o, [d]: number[] = e", "let { a, b: c } = o, [d] = e"),
    ("var x: typeof import('y').z[0]['k'] = 1;", "var x = 1;"),
    ("var x: A\n  | B\n  & C\nfoo: bar", "var x\nfoo: bar"),
    ("let x: keyof typeof o = 1, y: readonly string[] = [], z: unique symbol = s", "let x = 1, y = [], z = s"),
    ("let f: new (...a: any[]) => T = g", "let f = g"),
    ("let f: <T>(a: T) => T = g", "let f = g"),
    ("let t: -1 | 'a' | `b${c}` = 1", "let t = 1"),
    ("for (const x: T of y) {}", "for (const x of y) {}"),
    ("try {} catch (e: any) {}", "try {} catch (e) {}"),
    ("const o = { a: number, let: 1 }; x = c ? y : z;", "const o = { a: number, let: 1 }; x = c ? y : z;"),
    ("let x /* k */ : /* t */ T /* u */ = 1", "let x /* k */  /* u */ = 1"),
    # functions
    ("function f<T>(a: T, b?: U, ...c: V[]): W<T> { return a }", "function f(a, b?, ...c) { return a }"),
    ("function f<T>() {}", "function f<T>() {}"),
    ("function f<T>(): void {}", "function f() {}"),
    ("function* g(a: A = b as C<D>): E {}", "function* g(a = b as C<D>) {}"),
    ("function f(cb: (e: E) => void, { a, b }: P = {}): asserts x is T {}", "function f(cb, { a, b } = {}) {}"),
    ("export default function (a: A): B {}", "export default function (a) {}"),
    ("x = function (a: A): B { let c: D; };", "x = function (a: A): B { let c; };"),
    ("function f(a: A): B;\nfunction f(a: any) {}", "function f(a);\nfunction f(a) {}"),
    ("function f(x: unknown): x is string { return y ? (a) : b }", "function f(x) { return y ? (a) : b }"),
    # arrow functions
    ("const f = (a: A, b: B): C => a", "const f = (a, b) => a"),
    ("const f = async <T>(a: T): Promise<T> => { let b: T = a }", "const f = async (a) => { let b = a }"),
    ("f((a: A) => (b: B) => c)", "f((a) => (b) => c)"),
    ("f((): A => b, x => y)", "f(() => b, x => y)"),
    ("f((a: (x: X) => Y): ((z: Z) => W) => a)", "f((a) => a)"),
    ("c ? (a: A): B => d : e", "c ? (a: A): B => d : e"),  # read as a conditional: the colon may be its own
    ("f(a ? (b) : c)", "f(a ? (b) : c)"),
    # what keeps its types
    ("class A { x: T = 1; m(a: B, f: (c: C) => D): E { let y: F; } n = (a: B): C => a; }",
     "class A { x: T = 1; m(a: B, f: (c: C) => D): E { let y; } n = (a) => a; }"),
    ("interface I { f(a: A): B; g: (c: C) => D }", "interface I { f(a: A): B; g: (c: C) => D }"),
    ("type T<U> = (a: A) => B;", "type T<U> = (a: A) => B;"),
    ("o = { m(a: A): B { return c }, n: (d: D) => e }", "o = { m(a: A): B { return c }, n: (d) => e }"),
    ("x = y as (a: A) => B; z = <T>w;", "x = y as (a: A) => B; z = <T>w;"),
    ("switch (a) { case b: let c: D; default: e() }", "switch (a) { case b: let c; default: e() }"),
    ("", ""), ("let", "let"), ("let x:", "let x:"), ("function f(", "function f("), ("(a: A", "(a: A"), (")]}", ")]}"),
]


def test_untyped_cases(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)] + [(-1, None)], "i int, t string")
    got = {r.i: r.u for r in untype.with_untyped(df, "t", "u").collect()}
    assert [(CASES[i][0], got[i]) for i in range(len(CASES))] == CASES
    assert got[-1] == ""


def test_untyping_ends_on_any_text_and_only_drops():
    random.seed(6)
    signs = "VFCKXESTIYktrilnwo()[]{}<>:,;=?.|&-!*@AD23"
    for _ in range(4000):
        code = "".join(random.choices(signs, k=random.randint(0, 60)))
        flat = untype.dropped_ranges(code)
        assert flat == sorted(flat) and all(0 <= x <= len(code) for x in flat)


def test_untyping_is_linear():
    def seconds(n):
        code = "Vwi:i<i<i2w=w(i:i,wi:(i:i)Ai):iwAw{riwowi;}nFwi<i>(i:i=(i),{i:i}:i):i{Vi:(i:i)Ai=i;}n" * n + "(" * n
        begin = time.perf_counter()
        untype.dropped_ranges(code)
        return time.perf_counter() - begin

    seconds(50)
    assert seconds(4000) < 12 * max(seconds(1000), 1e-3)
