"""Corpus statistics queries (D6-D8, D11) over documents and the code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskforge.functions import lexer as L
from maskforge.operators import curation as D
from maskforge.plans import duck as Q
from maskforge.plans.registry import register
from maskforge.sources import tables as T

CODE = f"WITH code AS ({T.duck_code_corpus_cte()})"


@register("d7_doc_stats", f"""
SELECT lang, count(*) AS files,
       sum(len(regexp_extract_all(text, '\\n+')) + 1) AS loc,
       sum(n_chars) AS n_chars
FROM documents GROUP BY lang""")
def d7_doc_stats(spark, sf_dir):
    """Files, lines (runs of newlines collapse) and characters per language."""
    docs = T.read(spark, sf_dir, "documents", "lang", "text", "n_chars")
    return D.corpus_stats(docs, "lang", "text", extra={"n_chars": F.sum("n_chars")})


@register("d6_repo_count", """
SELECT count(DISTINCT source) AS repos, count(*) AS files FROM documents""")
def d6_repo_count(spark, sf_dir):
    """Distinct repositories (first path segment) over the document corpus."""
    files = T.read(spark, sf_dir, "documents", "doc_id", "source").select(
        "doc_id", T.file_path())
    return D.repo_count(files)


@register("d7_code_stats", CODE + """
, toks AS (SELECT path, list_filter(""" + Q.tokenize("content") + """,
         lambda t: t.type NOT IN ('WhiteSpace', 'LineTerminatorSequence')) AS t FROM code),
slots AS (
  SELECT path, len(list_filter(list_transform(t, lambda x, i: CASE
           WHEN x.type = 'IdentifierName' AND x.value IN ('const', 'let', 'var') THEN 1 ELSE 0 END),
           lambda f: f = 1)) AS decls,
         len(list_filter(list_transform(t, lambda x, i: CASE
           WHEN x.type = 'IdentifierName' AND x.value IN ('const', 'let', 'var')
            AND t[i + 1].type = 'IdentifierName' AND t[i + 2].type = 'Punctuator'
            AND t[i + 2].value = ':' AND t[i + 3].type = 'IdentifierName' THEN 1 ELSE 0 END),
           lambda f: f = 1)) AS annotated
  FROM toks)
SELECT 'normal' AS variant, count(*) AS files,
       sum(len(regexp_extract_all(c.content, '\\n+')) + 1) AS loc,
       sum(s.decls) AS type_slots, sum(s.annotated) AS type_annotations
FROM code c JOIN slots s USING (path)""")
def d7_code_stats(spark, sf_dir):
    """LOC, files, declaration slots and annotated slots of the code corpus.

    Only variable declarations are counted here; ``d10_type_slots`` counts functions too.
    """
    code = T.code_corpus(spark, sf_dir).select(F.lit("normal").alias("variant"), "content")
    code = L.held(code, "toks", D.significant_tokens(F.col("content")))
    slots = D.declaration_slots(F.col("toks"))
    per_file = code.select("variant", "content", slots["decls"].alias("decls"),
                           slots["annotated"].alias("annotated"))
    return per_file.groupBy("variant").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(D.loc(F.col("content"))).alias("loc"),
        F.sum("decls").alias("type_slots"),
        F.sum("annotated").alias("type_annotations"),
    )
