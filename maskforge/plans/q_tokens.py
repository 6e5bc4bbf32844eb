"""Token-level queries (P1, P5-P11) over the code corpus and the document corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskforge import config as C
from maskforge.functions import lexer as L
from maskforge.functions import normalize as N
from maskforge.functions import values as V
from maskforge.plans import duck as Q
from maskforge.plans import duck_marking as M
from maskforge.plans.registry import register
from maskforge.session import small_batches
from maskforge.sources import tables as T

CODE = f"WITH code AS ({T.duck_code_corpus_cte()})"


def _class_counts(df, by: str, text: str):
    # a class is found in a row of its own: compiled code, where a function over an array is not
    toks = df.select(by, F.explode(L.token_values(F.col(text))).alias("v")).select(by, L.classify(F.col("v")).alias("type"))
    # partial (map-side) aggregation leaves one row per (group, class) per task
    return toks.groupBy(by, "type").agg(F.count(F.lit(1)).alias("tokens"))


@register("p1_doc_token_classes", """
SELECT lang, t.type AS type, count(*) AS tokens
FROM (SELECT lang, unnest(""" + Q.tokenize("text") + """) AS t FROM documents)
GROUP BY lang, t.type""")
def p1_doc_token_classes(spark, sf_dir):
    """Tokens per lexical class and language over all documents."""
    return _class_counts(T.read(spark, sf_dir, "documents", "lang", "text"), "lang", "text")


@register("p1_code_token_classes", CODE + """
SELECT repo, t.type AS type, count(*) AS tokens
FROM (SELECT repo, unnest(""" + Q.tokenize("content") + """) AS t FROM code)
GROUP BY repo, t.type""")
def p1_code_token_classes(spark, sf_dir):
    """Tokens per lexical class and repository over the derived code corpus."""
    return _class_counts(L.folded(T.code_corpus(spark, sf_dir), "content", "content"), "repo", "content")


@register("p5_comment_classes", CODE + """
, c AS (SELECT unnest(list_filter(""" + Q.tokenize("content") + """,
          lambda x: x.type IN ('MultiLineComment', 'SingleLineComment'))) AS t FROM code)
SELECT CASE WHEN t.type = 'SingleLineComment' THEN 'single_line'
            WHEN """ + Q.is_marker("t") + """ THEN 'marker'
            WHEN """ + Q.is_docblock("t") + """ THEN 'docblock'
            ELSE 'multi_line' END AS class, count(*) AS comments
FROM c GROUP BY 1""")
def p5_comment_classes(spark, sf_dir):
    """P5: comments per class (single-line, multi-line, docblock, marker)."""
    code = L.folded(T.code_corpus(spark, sf_dir), "content", "content")
    com = code.select(F.explode(F.filter(L.token_values(F.col("content")), L.is_comment)).alias("v"))
    t = F.struct(L.classify(F.col("v")).alias("type"), F.col("v").alias("value"))
    cls = (F.when(t["type"] == L.SINGLE_LINE_COMMENT, "single_line")
           .when(N.is_marker_comment(t), "marker")
           .when(N.is_docblock(t), "docblock").otherwise("multi_line"))
    return com.groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("comments"))


@register("p7_strip_comments", CODE + """
SELECT path, length(s) AS n_chars, md5(s) AS digest
FROM (SELECT path, """ + Q.remove_comments("content") + """ AS s FROM code)""")
def p7_strip_comments(spark, sf_dir):
    """Every file with all comments removed (length and digest per file)."""
    code = L.folded(T.code_corpus(spark, sf_dir), "content", "content")
    s = code.select("path", L.remove_comments(F.col("content")).alias("s"))
    return s.select("path", F.length("s").alias("n_chars"), F.md5("s").alias("digest"))


_GRID = ", ".join(f"('{n}', {m})" for n, m in C.COMMENT_CLASSES)


@register("p11_preprocess", CODE + f"""
, g AS (SELECT * FROM (VALUES {_GRID}) AS g(comments, preserved))
SELECT path, comments, length(s) AS n_chars, md5(s) AS digest
FROM (SELECT path, comments, """ + Q.preprocess("content", "preserved", True) + """ AS s
      FROM code CROSS JOIN g)""")
def p11_preprocess(spark, sf_dir):
    """Whole normalisation (templates, comment class filter, whitespace and
    newline dedupe, literal masking) of every file for all five comment classes."""
    small_batches(spark)
    code = L.with_token_values(T.code_corpus(spark, sf_dir), "content", "toks")
    code = code.select("path", V.class_texts(F.col("toks"), True, [mask for _, mask in C.COMMENT_CLASSES]).alias("texts"))
    grid = F.array(*[F.struct(F.lit(name).alias("comments"), F.get("texts", i).alias("s"))
                     for i, (name, _) in enumerate(C.COMMENT_CLASSES)])
    s = code.select("path", F.explode(grid).alias("c")).select("path", "c.comments", "c.s")
    return s.select("path", "comments", F.length("s").alias("n_chars"), F.md5("s").alias("digest"))


@register("p10_doc_literal_mask", """
SELECT doc_id, length(s) AS n_chars, md5(s) AS digest
FROM (SELECT doc_id, """ + Q.preprocess("text", "0", True) + """ AS s FROM documents)""")
def p10_doc_literal_mask(spark, sf_dir):
    """P8-P10 on prose: literal masking and whitespace/newline dedupe per document."""
    d = T.read(spark, sf_dir, "documents", "doc_id", "text")
    s = d.select("doc_id", N.preprocess(F.col("text"), 0, True).alias("s"))
    return s.select("doc_id", F.length("s").alias("n_chars"), F.md5("s").alias("digest"))


_SCRIPT_RE = r"(?i)<script[^>]*>([\s\S]*?)</script>"


@register("p1_page_script_tokens", """
SELECT t.type AS type, count(*) AS tokens FROM (
  SELECT unnest(""" + Q.tokenize("s") + """) AS t FROM (
    SELECT unnest(regexp_extract_all(html, """ + Q.q(_SCRIPT_RE) + """, 1)) AS s FROM pages))
GROUP BY 1""")
def p1_page_script_tokens(spark, sf_dir):
    """P1/S3 on web pages: tokens per class of every ``<script>`` body."""
    pg = T.read(spark, sf_dir, "pages", "page_id", "html")
    scripts = pg.select(F.explode(F.regexp_extract_all("html", F.lit(_SCRIPT_RE), 1)).alias("s"))
    return _class_counts(scripts.withColumn("g", F.lit(1)), "g", "s").drop("g") \
        .groupBy("type").agg(F.sum("tokens").alias("tokens"))


@register("p12_line_spans", M.LINE_SPANS)
def p12_line_spans(spark, sf_dir):
    """Per file, non-empty terminated lines (first/last token excluded) and
    lines that hold a maskable token (potential types grouped first)."""
    from maskforge.operators import marking as K
    g = K.line_places(T.code_corpus(spark, sf_dir))
    return g.select("path", F.col("__places.lines").alias("lines"), F.col("__places.suitable").alias("maskable_lines"))
