"""Syntax queries: P2/P4 nested templates, P14 body bounds, P15 sequences, D12 untyping.

The corpora are derived from ``lineitem`` by SQL that runs in both engines.  Where the oracle
cannot parse, it builds the expected text from the same columns, so it never sees the code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskforge.functions import lexer as L
from maskforge.functions import normalize as N
from maskforge.functions import sequences as Q15
from maskforge.functions import spans as S
from maskforge.functions import untype
from maskforge.plans import duck as Q
from maskforge.plans.registry import register
from maskforge.sources import tables as T

CODE = f"WITH code AS ({T.duck_code_corpus_cte()})"

# --- templates nested as deep as a line's number and supplier say ----------------------------
_DEPTH = "(l_linenumber + l_suppkey % 6)"
_NESTED = f"""concat(repeat(concat('`it''s $', '{{f({{k: "', l_returnflag, '`"}}, '), CAST({_DEPTH} AS INT)),
  CAST(l_partkey AS STRING), repeat(concat(') /* ` */', '}} or }}`'), CAST({_DEPTH} AS INT)))"""


def _lines(spark, sf_dir: str, **columns: str) -> DataFrame:
    """Columns of ``lineitem`` rows by SQL expressions."""
    li = T.read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                "l_returnflag", "l_linestatus")
    return li.select(*[F.expr(e).alias(n) for n, e in columns.items()])


@register("p2_template_groups", f"""
SELECT l_returnflag AS flag, {_DEPTH} AS depth, count(*) AS files, 2 * count(*) AS templates,
  CAST(sum(length(t) + length('``')) AS BIGINT) AS template_chars, 3 * count(*) AS strings_outside
FROM (SELECT *, {_NESTED} AS t FROM lineitem) GROUP BY ALL""")
def p2_template_groups(spark, sf_dir):
    """Templates nested one to twelve levels deep are one token each; what stands outside
    them stays apart."""
    code = _lines(spark, sf_dir, flag="l_returnflag", depth=_DEPTH, nested=_NESTED)
    text = F.concat(F.lit("let a = '`', b = "), F.col("nested"), F.lit(" + \"${\" + ``; f('}`');"))
    toks = L.with_token_values(L.held(code, "text", text), "text", "toks")
    of_class = lambda *names: F.filter("toks", lambda v: L.classify(v, lambda name: F.lit(name in names)))
    toks = L.held(toks.select("flag", "depth", "toks"), "templates", of_class(L.TEMPLATE_STRING, L.NO_SUB_TEMPLATE))
    per = toks.select(
        "flag", "depth", F.size("templates").alias("n"), F.length(F.array_join("templates", "")).alias("chars"),
        F.size(of_class(L.STRING)).alias("strings"))
    return per.groupBy("flag", "depth").agg(
        F.count(F.lit(1)).alias("files"), F.sum("n").alias("templates"), F.sum("chars").alias("template_chars"),
        F.sum("strings").alias("strings_outside"))


@register("p4_template_replace", """
SELECT l_orderkey AS path, count(*) AS lines,
  md5(string_agg(concat('a', CAST(l_linenumber AS VARCHAR), ' = `<STR_LIT>`;<EOL>b(<NUM_LIT>);<EOL>'), ''
      ORDER BY l_linenumber, l_partkey, l_suppkey)) AS digest
FROM lineitem GROUP BY 1""")
def p4_template_replace(spark, sf_dir):
    """Nested templates become empty ones in the normalised text of every file."""
    code = _lines(spark, sf_dir, path="l_orderkey", o="struct(l_linenumber, l_partkey, l_suppkey)",
                  t=f"concat('a', CAST(l_linenumber AS STRING), ' = ', {_NESTED}, ';', chr(10), 'b(',"
                    " CAST(l_partkey AS STRING), '); // `$', '{', chr(10))")
    files = code.groupBy("path").agg(F.collect_list(F.struct("o", "t")).alias("ls"))
    text = F.array_join(F.transform(F.array_sort("ls"), lambda x: x["t"]), "")
    plain = L.held(files.select("path", "ls", F.size("ls").cast("bigint").alias("lines")), "text", text).drop("ls")
    clean = L.folded(plain, "text", "text").select("path", "lines", N.preprocess(F.col("text"), 0, True).alias("s"))
    return clean.select("path", "lines", F.md5(F.regexp_replace("s", " <EOL>", "<EOL>")).alias("digest"))


# --- P14 -------------------------------------------------------------------------------------
@register("p14_body_bounds", CODE + """
, tok AS (SELECT path, i - 1 AS i, t FROM (SELECT path, """ + Q.tokenize("content") + """ AS ts FROM code),
    LATERAL (SELECT unnest(range(1, len(ts) + 1)) AS i, unnest(ts) AS t)),
brace AS (SELECT path, i, t.value AS v FROM tok WHERE t.type = 'Punctuator' AND t.value IN ('{', '}')),
run AS (SELECT path, i, v, sum(CASE WHEN v = '}' THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY i DESC) AS depth FROM brace)
SELECT path, CAST(max(i) FILTER (WHERE v = '{' AND depth = 0) AS INT) AS body_start,
  CAST(max(i) FILTER (WHERE v = '}') AS INT) AS body_end
FROM run GROUP BY path HAVING max(i) FILTER (WHERE v = '}') IS NOT NULL""")
def p14_body_bounds(spark, sf_dir):
    """Token bounds of the last balanced braces of every file that closes one."""
    code = L.with_tokens(T.code_corpus(spark, sf_dir), "content", "toks")
    # no filter on the bounds: it would be pushed below and tokenise every file again
    found = F.filter(F.array(S.function_body_bounds(F.col("toks"))), lambda b: b.isNotNull())
    b = code.select("path", F.explode(found).alias("b"))
    return b.select("path", F.when(F.col("b.start") >= 0, F.col("b.start")).alias("body_start"),
                    F.col("b.end").alias("body_end"))


# --- P15 -------------------------------------------------------------------------------------
_PREFIX = [L.MULTI_LINE_COMMENT, L.LINE_TERMINATOR, L.IDENTIFIER]


@register("p15_sequences", CODE + """
, tok AS (SELECT path, """ + Q.tokenize("content") + """ AS ts FROM code),
keyed AS (SELECT path, ts, list_transform(ts, lambda t: t.type || ':' || t.value) AS k FROM tok),
lo AS (SELECT *, list_position(k, 'Punctuator:(') AS l FROM keyed),
hi AS (SELECT *, CASE WHEN l > 0 THEN coalesce(nullif(list_position(k[l + 1:], 'Punctuator:)'), 0) + l, len(ts) + 1) END AS r FROM lo),
args AS (SELECT *, k[l + 1:r - 1] AS a FROM hi)
SELECT path,
  CASE WHEN list_transform(ts[1:3], lambda t: t.type) = ['MultiLineComment', 'LineTerminatorSequence', 'IdentifierName']
    THEN ts[3].value END AS first_word,
  CAST(CASE WHEN l > 0 THEN l - 1 END AS INT) AS bracket_left, CAST(r - 1 AS INT) AS bracket_right,
  CAST(CASE WHEN l > 0 THEN len(list_filter(a, lambda x: x = 'Punctuator:,')) + 1 END AS INT) AS parameters,
  CAST(len(list_filter(k, lambda x: x = 'Punctuator:;')) + 1 AS INT) AS statements,
  CAST(len(ts) - coalesce(list_max(list_filter(range(1, len(ts) + 1), lambda i: k[i] = 'Punctuator:;')), 0) AS INT) AS last_statement
FROM args""")
def p15_sequences(spark, sf_dir):
    """Typed prefix of a file, bounds of its first bracket pair, the parts of what stands in
    it, and its parts between semicolons."""
    code = L.with_tokens(T.code_corpus(spark, sf_dir), "content", "t")
    head = Q15.typed_prefix(F.col("t"), _PREFIX)
    b = code.select("path", "t", F.get(head, 2)["value"].alias("first_word"))
    b = L.held(b, "b", Q15.between(F.col("t"), (L.PUNCTUATOR, "("), (L.PUNCTUATOR, ")")))
    b = L.held(b, "s", Q15.split_on(F.col("t"), L.PUNCTUATOR, ";"))
    b = b.withColumn("a", Q15.inner(F.col("t"), F.col("b")))
    last = F.element_at("s", -1)
    return b.select("path", "first_word", F.col("b.left").alias("bracket_left"), F.col("b.right").alias("bracket_right"),
                    F.when(F.col("b").isNotNull(), F.size(Q15.split_on(F.col("a"), L.PUNCTUATOR, ","))).alias("parameters"),
                    F.size("s").alias("statements"), (last["to"] - last["from"]).alias("last_statement"))


# --- D12 -------------------------------------------------------------------------------------
# every pair: text with types, text without; {p} {s} {f} stand for a line's numbers and flag
_TYPED = [
    ("const a{p}: Map<string, Array<Array<number>>> = new Map();", "const a{p} = new Map();"),
    ("let b{p}!: number | undefined, c{p}: {{ k: string; f(x: number): void }} = g({s}, '{f}: x'), d{p}: A<B, C>[];",
     "let b{p}!, c{p} = g({s}, '{f}: x'), d{p};"),
    ("export async function f{p}<T extends K{s}, U>(this: Window, a?: T, ...r: U[]): Promise<Map<T, U>> {{ return a ? b : r; }}",
     "export async function f{p}(this, a?, ...r) {{ return a ? b : r; }}"),
    ("const h{p}: (a: number, b: (c: string) => void) => x is string = <T,>(a: T = {s}, {{ k, l }}: P<T> = {{ k: 1 }}): a is T => a;",
     "const h{p} = (a = {s}, {{ k, l }} = {{ k: 1 }}) => a;"),
    ("xs{p}.map((x: X): [A, B] => x).filter(async (y?: Y) => y ? z : (w: W) => w);",
     "xs{p}.map((x) => x).filter(async (y?) => y ? z : (w) => w);"),
    ("class C{s}<T> extends D<T> {{ k: Map<string, T> = new Map(); m(a: (b: B) => void): R {{ const q: Q = a; return q; }} }}",
     "class C{s}<T> extends D<T> {{ k: Map<string, T> = new Map(); m(a: (b: B) => void): R {{ const q = a; return q; }} }}"),
    ("type F{p}<T> = (a: T) => T extends string ? A : B; interface I{p} {{ f: (x: number) => void }}",
     "type F{p}<T> = (a: T) => T extends string ? A : B; interface I{p} {{ f: (x: number) => void }}"),
    ("try {{ o = {{ k: v, l: (n: number) => n }} }} catch (e: unknown) {{ const w = e as (a: A) => B; }} // {f}: x",
     "try {{ o = {{ k: v, l: (n) => n }} }} catch (e) {{ const w = e as (a: A) => B; }} // {f}: x"),
    ("for (const [k, v]: [string, number] of es) {{ let u: T extends U ? X : Y = k < v, z = function (a: A): B {{ return a }}; }}",
     "for (const [k, v] of es) {{ let u = k < v, z = function (a: A): B {{ return a }}; }}"),
]


def _line_sql(which: int) -> str:
    """SQL of the ``which`` form (0 typed, 1 untyped) of a line, by its number and part."""
    def text(s):
        parts = s.replace("{{", "\0").replace("}}", "\1")
        for name, column in (("{p}", "l_partkey"), ("{s}", "l_suppkey"), ("{f}", "l_returnflag")):
            parts = parts.replace(name, f"\2CAST({column} AS STRING)\2")
        quoted = [x if k % 2 else Q.q(x.replace("\0", "{").replace("\1", "}")) for k, x in enumerate(parts.split("\2"))]
        return "concat(" + ", ".join([*quoted, "chr(10)"]) + ")"

    return ("CASE (l_linenumber + l_partkey) % " + str(len(_TYPED))
            + "".join(f" WHEN {k} THEN {text(pair[which])}" for k, pair in enumerate(_TYPED)) + " END")


@register("d12_untyped", f"""
SELECT l_orderkey AS path, md5(string_agg({_line_sql(1)}, '' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS digest
FROM lineitem GROUP BY 1""")
def d12_untyped(spark, sf_dir):
    """Files with generic, function, object and conditional types, untyped."""
    files = T.line_files(spark, sf_dir, _line_sql(0), "text")
    return untype.with_untyped(L.held(files, "text", F.col("text")), "text", "untyped").select("path", F.md5("untyped").alias("digest"))
