"""Evaluation queries (E1-E20) on prediction/ground-truth pairs derived from the
``conversations`` table: the ground truth is an assistant turn, the prediction is
the preceding turn of the same conversation (a "repeat the context" baseline)."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskforge.functions import normalize as N
from maskforge.operators import metrics as E
from maskforge.operators import ordered
from maskforge.plans import duck as Q
from maskforge.plans import duck_marking as M
from maskforge.plans.registry import register
from maskforge.sources import tables as T

PAIRS_SQL = """pairs AS (
  SELECT a.conv_id, a.turn, a.text AS gt, p.text AS prediction
  FROM conversations a JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1
  WHERE a.role = 'assistant')"""


def pairs(spark, sf_dir):
    """Pair each assistant turn with the turn before it (join on the row key)."""
    c = T.read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    gt = c.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("gt"))
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prediction"))
    return gt.join(prev, ["conv_id", "turn"])


def duck_postprocess(x: str) -> str:
    cut1 = f"CASE WHEN strpos({x}, '<s>') > 0 THEN substr({x}, strpos({x}, '<s>') + 3) ELSE {x} END"
    cut2 = f"CASE WHEN strpos(c1, '</s>') > 0 THEN substr(c1, 1, strpos(c1, '</s>') - 1) ELSE c1 END"
    mapped = (f"array_to_string(list_transform(list_filter({Q.tokenize('c2')}, lambda tk_: tk_.type "
              f"NOT IN ('SingleLineComment', 'MultiLineComment')), lambda tk_: CASE "
              f"WHEN tk_.type = 'NumericLiteral' THEN '0' WHEN tk_.type IN ('StringLiteral', "
              f"'NoSubstitutionTemplate') THEN '\"\"' WHEN tk_.type = 'WhiteSpace' THEN ' ' "
              f"ELSE tk_.value END), '')")
    s = f"regexp_replace({mapped}, '[''\"`]<STR_LIT>[''\"`]', '\"\"', 'g')"
    s = f"replace({s}, '<NUM_LIT>', '0')"
    s = f"regexp_replace({s}, {Q.q(Q.JS_SPACE + '+')}, ' ', 'g')"
    return cut1, cut2, Q.js_trim(Q.remove_comments(s))


def postprocess_sql(col: str, alias: str) -> str:
    cut1, cut2, final = duck_postprocess(col)
    return (f"(SELECT {final} FROM (SELECT {cut2} AS c2 FROM (SELECT {cut1} AS c1)))"
            f" AS {alias}")


@register("e2_postprocess", "WITH " + PAIRS_SQL + """
SELECT conv_id, turn, md5(g) AS gt_digest, md5(p) AS pred_digest, length(g) AS gt_chars
FROM (SELECT conv_id, turn, """ + postprocess_sql("gt", "g") + """, """ + postprocess_sql("prediction", "p") + """
      FROM pairs)""")
def e2_postprocess(spark, sf_dir):
    """Paired rows with both sides normalised (digests per row)."""
    p = pairs(spark, sf_dir)
    s = p.select("conv_id", "turn", N.postprocess(F.col("gt")).alias("g"),
                 N.postprocess(F.col("prediction")).alias("p"))
    return s.select("conv_id", "turn", F.md5("g").alias("gt_digest"),
                    F.md5("p").alias("pred_digest"), F.length("g").alias("gt_chars"))


@register("e5_exact_match_raw", "WITH " + PAIRS_SQL + """,
pp AS (SELECT """ + postprocess_sql("gt", "g") + """, """ + postprocess_sql("prediction", "p") + """ FROM pairs)
SELECT count(*) AS pairs, sum(CASE WHEN p <> '' AND regexp_replace(g, """ + Q.q(Q.JS_SPACE + "+") + """, ' ', 'g')
         = regexp_replace(p, """ + Q.q(Q.JS_SPACE + "+") + """, ' ', 'g') THEN 1 ELSE 0 END) AS exact,
       sum(CASE WHEN p = '' THEN 1 ELSE 0 END) AS empty_predictions
FROM pp""")
def e5_exact_match_raw(spark, sf_dir):
    """Exact matches after a whitespace split of the normalised sides, and empty
    predictions (which match nothing)."""
    p = pairs(spark, sf_dir)
    p = p.select(N.postprocess(F.col("gt")).alias("g"), N.postprocess(F.col("prediction")).alias("p"))
    em = (F.col("p") != "") & (E.whitespace_split(F.col("g")) == E.whitespace_split(F.col("p")))
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.sum(em.cast("int")).alias("exact"),
                 F.sum((F.col("p") == "").cast("int")).alias("empty_predictions"))


@register("e3_token_counts", "WITH " + PAIRS_SQL + """
SELECT conv_id, turn, len(""" + Q.token_values("gt") + """) AS gt_tokens,
       len(""" + Q.token_values("prediction") + """) AS pred_tokens FROM pairs""")
def e3_token_counts(spark, sf_dir):
    """Token-array projection of both sides (whitespace tokens included)."""
    p = pairs(spark, sf_dir)
    return p.select("conv_id", "turn", F.size(E.token_texts(F.col("gt"))).alias("gt_tokens"),
                    F.size(E.token_texts(F.col("prediction"))).alias("pred_tokens"))


def _bleu_sql() -> str:
    grams, nums, logs = [], [], []
    for n in range(1, 5):
        for side in "hr":
            grams.append(f"[array_to_string({side}[i:i + {n - 1}], chr(1)) for i in range(1, len({side}) - {n - 2})] AS {side}{n}")
        nums.append(f"coalesce(list_sum([least(len([x for x in h{n} if x = q]), len([x for x in r{n} if x = q])) "
                    f"for q in list_distinct(h{n})]), 0) AS m{n}")
        logs.append("ln(m1 / greatest(1, len(h1)))" if n == 1 else f"ln((m{n} + 1) / (greatest(1, len(h{n})) + 1))")
    return f"""
tk AS (SELECT conv_id, turn, {Q.token_values("g")} AS r, {Q.token_values("p")} AS h FROM pp WHERE p <> ''),
gr AS (SELECT conv_id, turn, h, r, {", ".join(grams)} FROM tk),
cn AS (SELECT *, {", ".join(nums)} FROM gr)
SELECT conv_id, turn, round(CASE WHEN m1 = 0 THEN 0.0 ELSE CASE WHEN len(h) > len(r) THEN 1.0
  ELSE exp(1 - len(r) / len(h)) END * exp(0.25 * ({" + ".join(logs)})) END, 9) AS bleu FROM cn"""


@register("e7_bleu4", "WITH " + PAIRS_SQL + """,
pp AS (SELECT conv_id, turn, """ + postprocess_sql("gt", "g") + """, """ + postprocess_sql("prediction", "p") + """ FROM pairs),"""
          + _bleu_sql())
def e7_bleu4(spark, sf_dir):
    """Smoothed sentence BLEU-4 of every non-empty prediction."""
    rows = E.score(pairs(spark, sf_dir)).where(~F.col("empty"))
    return rows.select("conv_id", "turn", F.round("bleu", 9).alias("bleu"))


@register("e_metric_rows")
def e_metric_rows(spark, sf_dir):
    """One metric row per pair (empty rows kept for alignment)."""
    return E.score(pairs(spark, sf_dir))


@register("e10_single_token_rows")
def e10_single_token_rows(spark, sf_dir):
    """First-token mode metric rows."""
    return E.score(pairs(spark, sf_dir), single_token=True)


@register("e10_single_token_scores", "WITH " + PAIRS_SQL + """,
pp AS (SELECT conv_id, turn, """ + postprocess_sql("gt", "g") + """, """ + postprocess_sql("prediction", "p") + """ FROM pairs),
tk AS (SELECT conv_id, turn, """ + Q.token_values("g") + """ AS r, """ + Q.token_values("p") + """ AS h FROM pp WHERE p <> ''),
one AS (SELECT conv_id, turn, coalesce(r[1], '') AS r, h[1] AS h FROM tk)
SELECT conv_id, turn, CAST(r = h AS INT) AS exact_match, round(CASE WHEN r = h THEN pow(0.5, 0.75) ELSE 0 END, 9) AS bleu,
  CAST(CASE WHEN r = h THEN 1 ELSE 0 END AS DOUBLE) AS rouge FROM one""")
def e10_single_token_scores(spark, sf_dir):
    """Exact match, BLEU-4 and ROUGE-L of the first tokens of every pair with a prediction."""
    rows = E.score(pairs(spark, sf_dir), single_token=True).where(~F.col("empty"))
    return rows.select("conv_id", "turn", "exact_match", F.round("bleu", 9).alias("bleu"), "rouge")


@register("e12_leaderboard")
def e12_leaderboard(spark, sf_dir):
    """Mean metrics x 100 per mode and turn, sorted."""
    p = pairs(spark, sf_dir)
    rows = E.score(p).withColumn("mode", F.lit("line")).unionByName(
        E.score(p, single_token=True).withColumn("mode", F.lit("token")))
    return E.averages(rows, ["mode", "turn"]).orderBy("mode", "turn")


@register("e15_placeholder_cleanup", """
SELECT conv_id, turn, md5(regexp_replace(replace(replace(replace(replace(replace(replace(text,
  '<string', '<STR_LIT'), '<number', '<NUM_LIT'), '<char', '<CHAR_LIT'), '<NUM_LIT>', '0'),
  '<STR_LIT>', ''), '<CHAR_LIT>', ''), '<(STR|NUM|CHAR)_LIT:(.*?)>', '\\2', 'gs')) AS digest
FROM conversations""")
def e15_placeholder_cleanup(spark, sf_dir):
    """Placeholder clean-up of model text."""
    c = T.read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return c.select("conv_id", "turn", F.md5(N.placeholder_cleanup(F.col("text"))).alias("digest"))


@register("e18_first_line_empty_share", """
SELECT role, total, empty, round(empty * 1.0 / total, 9) AS empty_share FROM (
  SELECT role, row_number() OVER w AS total, count(*) OVER (PARTITION BY role) AS n,
         sum(CASE WHEN """ + Q.js_trim("split_part(" + Q.js_trim("text") + ", chr(10), 1)") + """ = '' THEN 1 ELSE 0 END) OVER w AS empty
  FROM conversations WINDOW w AS (PARTITION BY role ORDER BY conv_id, turn
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE total % 100 = 0 OR total = n""")
def e18_first_line(spark, sf_dir):
    """Running share of empty first lines, reported every 100 rows and at the end of
    each role."""
    c = T.read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    first = N.js_trim(F.split(N.js_trim(F.col("text")), "\n").getItem(0))
    c = c.select("conv_id", "turn", "role", (F.coalesce(first, F.lit("")) == "").cast("long").alias("e"))
    r = ordered.cumulative(c, ["role"], ["conv_id", "turn"], sums=["e"], count_col="total")
    sizes = c.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    r = r.join(sizes, "role").where((F.col("total") % 100 == 0) | (F.col("total") == F.col("n")))
    return r.select("role", "total", F.col("run_e").alias("empty"),
                    F.round(F.col("run_e") / F.col("total"), 9).alias("empty_share"))


@register("e13_e17_dev_scores", "WITH " + PAIRS_SQL + """,
pp AS (SELECT gt, prediction, """ + postprocess_sql("prediction", "p") + """ FROM pairs)
SELECT count(*) AS pairs, sum(len(""" + Q.token_values("prediction") + """)) AS input_tokens,
       avg(CASE WHEN prediction = gt THEN 1 ELSE 0 END) AS strict_em
FROM pp WHERE p <> ''""")
def e13_e17_dev_scores(spark, sf_dir):
    """Tokens of the model input (the preceding turn, which the baseline repeats)
    over rows with a prediction, and strict string exact match."""
    p = pairs(spark, sf_dir).select("gt", "prediction", F.col("prediction").alias("input")).where(
        N.postprocess(F.col("prediction")) != "")
    return p.agg(F.count(F.lit(1)).alias("pairs"),
                 F.sum(F.size(E.token_texts(F.col("input")))).alias("input_tokens"),
                 F.avg((F.col("prediction") == F.col("gt")).cast("int")).alias("strict_em"))


@register("e16_dev_scores")
def e16_dev_scores(spark, sf_dir):
    """Development scores -- whitespace-split exact match and the integer
    fuzzy ratio round(100 x edit similarity), averaged over non-empty rows."""
    rows = E.score(pairs(spark, sf_dir)).filter(~F.col("empty"))
    return rows.agg(F.count(F.lit(1)).alias("n"),
                    F.avg("exact_match").alias("em"),
                    F.avg(F.round(F.col("levenshtein") * 100)).alias("fuzzy_ratio"))


def task_metric_rows(spark, sf_dir, single_token: bool = False):
    """Metric rows of the previous-line baseline on every test task of the 15 datasets, by line or
    by first token, scored once and written to the shared folder."""
    from maskforge.operators import marking as K
    raw = K.raw_tasks(K.variant_frame(K.test_files(T.code_corpus(spark, sf_dir))))
    t = K.task_grids(raw, replace_literals=True)
    # most comment classes of a task agree, so a task's classes stand in one row
    pr = t.select("path", "ordinal", F.transform("grid", lambda c: F.struct(
        F.concat_ws("-", "variant", c["comments"]).alias("name"), c["gt"].alias("gt"),
        E.last_line_baseline(c["input"]).alias("prediction"))).alias("members"))
    return ordered.stage(E.score_members(pr, "members", single_token).withColumnRenamed("name", "dataset"), "metric-rows")


@register("e14_task_leaderboard")
def e14_task_leaderboard(spark, sf_dir):
    """E1/E4/E12/E14 on the completion tasks: a "repeat the previous line" baseline scored on
    every test task of the 15 datasets; means x 100 per (types, comments)."""
    rows = task_metric_rows(spark, sf_dir)
    types, comm = E.dimension_codes(F.col("dataset"))
    rows = rows.select(F.lit("last-line").alias("model"), types.alias("types"), comm.alias("comments"),
                       *[c for c in rows.columns if c not in ("path", "ordinal", "dataset")])
    return E.averages(rows, ["model", "types", "comments"]).orderBy("model", "types", "comments")


@register("e14_exact_match_hits", M.leaderboard())
def e14_exact_match_hits(spark, sf_dir):
    """Non-empty predictions and exact matches of the baseline on every test
    task, per (types, comments)."""
    rows = task_metric_rows(spark, sf_dir)
    types, comments = E.dimension_codes(F.col("dataset"))
    return rows.groupBy(types.alias("types"), comments.alias("comments")).agg(
        F.sum((~F.col("empty")).cast("long")).alias("n"),
        F.coalesce(F.sum(F.col("exact_match").cast("long")), F.lit(0)).alias("hits"))


@register("e14_margins", "WITH cells AS (" + M.leaderboard() + """)
SELECT coalesce(types, 'all') AS types, coalesce(comments, 'all') AS comments, CAST(sum(n) AS BIGINT) AS n,
  CAST(sum(hits) AS BIGINT) AS hits
FROM cells GROUP BY CUBE (types, comments)""")
def e14_margins(spark, sf_dir):
    """The leaderboard's cells with the margins of both dimensions and the total, from one
    aggregate over grouping sets."""
    rows = task_metric_rows(spark, sf_dir)
    types, comments = E.dimension_codes(F.col("dataset"))
    cube = rows.select(types.alias("types"), comments.alias("comments"), "empty", "exact_match").cube("types", "comments")
    out = cube.agg(F.sum((~F.col("empty")).cast("long")).alias("n"),
                   F.coalesce(F.sum(F.col("exact_match").cast("long")), F.lit(0)).alias("hits"),
                   F.grouping("types").alias("gt"), F.grouping("comments").alias("gc"))
    return out.select(F.when(F.col("gt") == 1, "all").otherwise(F.col("types")).alias("types"),
                      F.when(F.col("gc") == 1, "all").otherwise(F.col("comments")).alias("comments"), "n", "hits")


@register("e9_meteor_stages")
def e9_meteor_stages(spark, sf_dir):
    """METEOR of every answer against the turn before it, with equal words alone, with stems,
    and with a synonym table made of the corpus (words that share their first four letters)."""
    p = pairs(spark, sf_dir).select("conv_id", "turn", E.whitespace_split(F.col("gt")).alias("r"),
                                    E.whitespace_split(F.col("prediction")).alias("h"))
    words = p.select(F.explode(F.concat("r", "h")).alias("word")).select(F.lower("word").alias("word")).distinct()
    table = words.where(F.length("word") > 4).select("word", F.substring("word", 1, 4).alias("grp"))
    scored = E.with_meteor(E.with_meteor(p, ["conv_id", "turn"], "r", "h", out="stems"), ["conv_id", "turn"], "r", "h",
                           table, out="synonyms")
    return scored.select("conv_id", "turn", "stems", "synonyms")
