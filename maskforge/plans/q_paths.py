"""Path, line and sink queries (S4-S6, S8, S10-S12, S15, D3, K12) and type slots."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as _types
from pyspark.sql import types as TT

from maskforge.functions import normalize as N
from maskforge.operators import curation as D
from maskforge.functions import untype
from maskforge.operators import marking as K
from maskforge.operators import metrics as E
from maskforge.operators import paths as P
from maskforge.operators import slots as O
from maskforge.operators.ordered import stage
from maskforge.plans import duck as Q
from maskforge.plans import duck_marking as M
from maskforge.plans.registry import register
from maskforge.sources import sinks
from maskforge.sources import tables as T
from maskforge.streaming.ingest import new_place

# pages as files: the address without scheme, query and fragment
_URL = r"^[a-z]+://|[?#].*$"
_PAGES = "SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages"


def _pages(spark, sf_dir):
    return T.read(spark, sf_dir, "pages", "page_id", "url").select("page_id", F.regexp_replace("url", _URL, "").alias("path"))


@register("s5_folders_at_depth", f"""
SELECT DISTINCT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS folder
FROM ({_PAGES}) WHERE len(string_split(path, '/')) > 2""")
def s5_folders_at_depth(spark, sf_dir):
    """Folders at depth 2 of the page tree."""
    return P.folders_at_depth(_pages(spark, sf_dir), "path", 2)


_CONFIGS = """SELECT CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'p' || l_suppkey || '/'
  ELSE 'p' || l_suppkey || '/q' || l_partkey || '/' END
  || CASE WHEN l_returnflag = 'N' THEN 'tsconfig.json' ELSE 'index.ts' END AS path, l_orderkey FROM lineitem"""


@register("s4_deepest_configs", f"""
WITH f AS ({_CONFIGS}), m AS (SELECT DISTINCT path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM f
  WHERE path LIKE '%tsconfig.json'),
above AS (SELECT DISTINCT array_to_string(string_split(dir, '/')[1:k], '/') AS dir
  FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')))) AS k FROM m WHERE dir <> ''))
SELECT path FROM m WHERE dir NOT IN (SELECT dir FROM above)""")
def s4_deepest_configs(spark, sf_dir):
    """The deepest ``tsconfig.json`` of every subtree of a tree made from lineitem."""
    li = T.read(spark, sf_dir, "lineitem", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")
    top = F.concat(F.lit("p"), F.col("l_suppkey").cast("string"), F.lit("/"))
    folder = (F.when(F.col("l_linenumber") % 3 == 0, "").when(F.col("l_linenumber") % 3 == 1, top)
              .otherwise(F.concat(top, F.lit("q"), F.col("l_partkey").cast("string"), F.lit("/"))))
    name = F.when(F.col("l_returnflag") == "N", "tsconfig.json").otherwise("index.ts")
    files = li.select(F.concat(folder, name).alias("path")).distinct()
    return P.deepest(files, "path", "tsconfig.json")


@register("s6_line_source", """
SELECT doc_id, len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END AS n_lines,
       md5(array_to_string(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END, '|')) AS digest
FROM (SELECT doc_id, string_split_regex(replace(text, chr(10), chr(13) || chr(10)), '\\r?\\n') AS l FROM documents)""")
def s6_line_source(spark, sf_dir):
    """Lines of every document written with carriage returns."""
    d = T.read(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", P.lines(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("l"))
    return d.select("doc_id", F.size("l").cast("bigint").alias("n_lines"), F.md5(F.array_join("l", "|")).alias("digest"))


@register("s8_restructure", """
SELECT doc_id, source || '/f' || doc_id || '/' || lang || '.ts' AS path FROM documents""")
def s8_restructure(spark, sf_dir):
    """``source/f<id>.<lang>`` becomes ``source/f<id>/<lang>.ts``."""
    d = T.read(spark, sf_dir, "documents", "doc_id", "source", "lang")
    old = F.concat("source", F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return d.select("doc_id", P.restructured(old).alias("path"))


@register("d3_valid_sources", """
SELECT source || '/' || doc_id || '.ts' AS path FROM documents
WHERE doc_id % 5 <> 0 AND doc_id IN (SELECT doc_id FROM labels)""")
def d3_valid_sources(spark, sf_dir):
    """D3: source files (a fifth of the documents are declaration files) that the labelled
    variant has too."""
    d = T.read(spark, sf_dir, "documents", "doc_id", "source")
    ends = F.when(F.col("doc_id") % 5 == 0, ".d.ts").otherwise(".ts")
    files = d.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ends).alias("path"))
    other = files.join(T.read(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_semi")
    return P.valid_sources(files.select("path"), other, "path")


@register("k12_batches_by_amount", """
SELECT (rn - 1) // CAST(ceil(n / 7.0) AS BIGINT) AS batch, count(*) AS jobs, min(o_orderkey) AS first_key
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders) GROUP BY 1""")
def k12_batches_by_amount(spark, sf_dir):
    """Seven batches of equal size, the last one possibly shorter."""
    from maskforge.operators import sampling as S
    o = T.read(spark, sf_dir, "orders", "o_orderkey")
    size = max(1, -(-o.count() // 7))  # one number
    return S.batches(o, "o_orderkey", size).groupBy("batch").agg(
        F.count(F.lit(1)).alias("jobs"), F.min("o_orderkey").alias("first_key"))


# --- sinks, written and read again --------------------------------------------------

@register("s11_task_sink", M.SINK)
def s11_task_sink(spark, sf_dir):
    """Test tasks as JSON lines by (variant, comments), read with the task schema."""
    t = K.tasks(K.raw_tasks(K.variant_frame(K.test_files(T.code_corpus(spark, sf_dir)))))
    place = new_place(spark, "tasks")
    sinks.write_partitioned_json(t.select("variant", "comments", "input", "gt", "marker"), place, "variant", "comments")
    schema = TT.StructType(sinks.TASK_SCHEMA.fields + [TT.StructField("variant", TT.StringType()),
                                                       TT.StructField("comments", TT.StringType())])
    back = sinks.read_json(spark, place, schema)
    return back.groupBy("variant", "comments").agg(F.count(F.lit(1)).alias("tasks"),
                                                   F.sum(F.length("input")).alias("input_chars"))


@register("s12_text_sink", """
SELECT count(*) AS lines, sum(length(s)) AS chars, bit_xor(CAST('0x' || left(md5(s), 15) AS BIGINT)) AS digest
FROM (SELECT """ + Q.preprocess("text", "7", True) + """ AS s FROM documents WHERE text IS NOT NULL)""")
def s12_text_sink(spark, sf_dir):
    """Every document as one processed line of training text, written and read."""
    d = T.read(spark, sf_dir, "documents", "text").where("text is not null")
    place = new_place(spark, "training-text")
    sinks.write_text(d.select(N.preprocess(F.col("text"), 7, True).alias("value")), place)
    digest = F.conv(F.substring(F.md5("value"), 1, 15), 16, 10).cast("bigint")
    return spark.read.text(place).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("chars"),
                                      F.bit_xor(digest).alias("digest"))


@register("s15_metric_sink")
def s15_metric_sink(spark, sf_dir):
    """Metric rows as JSON lines by population, read with the metric schema."""
    from maskforge.plans.q_metrics import pairs
    p = pairs(spark, sf_dir)
    rows = E.score(p).withColumn("population", F.lit("line")).unionByName(
        E.score(p, single_token=True).withColumn("population", F.lit("token")))
    place = new_place(spark, "metric-rows")
    sinks.write_partitioned_json(rows.drop("conv_id", "turn"), place, "population")
    schema = TT.StructType(sinks.METRIC_SCHEMA.fields + [TT.StructField("population", TT.StringType())])
    back = sinks.read_json(spark, place, schema)
    return back.groupBy("population").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("empty").cast("int")).alias("empty"),
        *[F.round(F.avg(m), 6).alias(m) for m in ("exact_match", "levenshtein", "bleu", "rouge", "meteor")])


# --- type slots ---------------------------------------------------------------------

# the derived corpus has a known grammar: per line an annotated const and a let broken by a
# comment; every third line a function (a: number, b), whose return type counts as given
# when a later line brings another colon
_SLOTS = """lines AS (SELECT l_orderkey AS path, l_linenumber % 3 = 0 AS fn,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1 AS last
  FROM lineitem),
slots AS (SELECT path, CAST(sum(2 + CASE WHEN fn THEN 3 ELSE 0 END) AS BIGINT) AS potential,
  CAST(sum(1 + CASE WHEN fn THEN 1 + CASE WHEN last THEN 0 ELSE 1 END ELSE 0 END) AS BIGINT) AS annotations,
  CAST(sum(2 + CASE WHEN fn THEN 3 ELSE 0 END) AS BIGINT) AS explicit_annotations FROM lines GROUP BY path)"""


def _slots(spark, sf_dir):
    return O.with_slots(T.code_corpus(spark, sf_dir).select("path", "content"), "content").select(
        "path", "potential", "annotations")


@register("d10_type_slots", f"WITH {_SLOTS} SELECT path, potential, annotations FROM slots")
def d10_type_slots(spark, sf_dir):
    """Type slots and annotations of every file, functions included."""
    return _slots(spark, sf_dir)


@register("d7_variant_stats", f"""WITH {_SLOTS}, code AS ({T.duck_code_corpus_cte()}),
loc AS (SELECT count(*) AS files, sum(len(regexp_extract_all(content, '\\n+')) + 1) AS loc FROM code),
v AS (SELECT 'normal' AS variant, sum(potential) AS s, sum(annotations) AS a FROM slots
  UNION ALL SELECT 'explicit', sum(potential), sum(explicit_annotations) FROM slots
  UNION ALL SELECT 'untyped', sum(potential), 0 FROM slots)
SELECT variant, files, loc, s AS type_slots, a AS type_annotations, round(100.0 * a / s, 2) AS explicitness FROM v, loc""")
def d7_variant_stats(spark, sf_dir):
    """Files, lines, slots, annotations and their percentage for each type variant."""
    code = T.code_corpus(spark, sf_dir).select("path", F.col("content").alias("normal"))
    variants = untype.with_untyped(code, "normal", "untyped").select(F.explode(F.array(
        F.struct(F.lit("normal").alias("variant"), F.col("normal").alias("text")),
        F.struct(F.lit("explicit").alias("variant"), K.add_annotations_for_corpus(F.col("normal")).alias("text")),
        F.struct(F.lit("untyped").alias("variant"), F.col("untyped").alias("text")))).alias("v"))
    per = O.with_slots(variants.select("v.variant", "v.text"), "text")
    out = per.groupBy("variant").agg(
        F.count(F.lit(1)).alias("files"), F.sum(D.loc(F.col("text"))).alias("loc"),
        F.sum("potential").alias("type_slots"), F.sum("annotations").alias("type_annotations"))
    return out.withColumn("explicitness", O.explicitness(F.col("type_annotations"), F.col("type_slots")))


@register("d11_running_explicitness", f"""WITH {_SLOTS},
r AS (SELECT row_number() OVER w AS files, sum(annotations) OVER w AS annotations, sum(potential) OVER w AS potential,
      count(*) OVER () AS n FROM slots WINDOW w AS (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT files, annotations, potential, round(100.0 * annotations / potential, 2) AS explicitness
FROM r WHERE files % 10000 = 0 OR files = n""")
def d11_running_explicitness(spark, sf_dir):
    """Running explicitness of the code corpus, every 10,000 files and at the end."""
    return O.running_explicitness(stage(_slots(spark, sf_dir), "slots"), "path")


_TURN = ("'{\"conv_id\": ' || CAST(conv_id AS STRING) || ', \"role\": \"' || role || '\", \"size\": ' "
         "|| CAST(length(text) AS STRING) || '}'")


@register("s9_tolerant_jsonl", """
SELECT role, count(*) FILTER (WHERE k <> 0 AND k <> 3) AS good, CAST(sum(length(text)) FILTER (WHERE k <> 0 AND k <> 3) AS BIGINT) AS size,
  0 AS broken FROM (SELECT *, (conv_id + turn) % 7 AS k FROM conversations) GROUP BY role
HAVING count(*) FILTER (WHERE k <> 0 AND k <> 3) > 0
UNION ALL SELECT NULL, 0, NULL, count(*) FROM conversations WHERE (conv_id + turn) % 7 IN (0, 3)""")
def s9_tolerant_jsonl(spark, sf_dir):
    """JSON lines, some cut off and some no object, read with their schema; broken lines are
    counted from where they were put aside."""
    c = T.read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    line = F.expr(_TURN)
    k = (F.col("conv_id") + F.col("turn")) % 7
    place = new_place(spark, "jsonl")
    c.select(F.when(k == 0, F.expr("substring(" + _TURN + ", 1, 14)")).when(k == 3, F.concat(F.lit("["), line, F.lit("]")))
             .otherwise(line).alias("value")).write.text(f"{place}/in")
    schema = _types.StructType([_types.StructField("conv_id", _types.LongType()), _types.StructField("role", _types.StringType()),
                                _types.StructField("size", _types.LongType())])
    good = sinks.quarantine(sinks.read_json_lines(spark, f"{place}/in", schema), f"{place}/broken")
    per = good.groupBy("role").agg(F.count(F.lit(1)).alias("good"), F.sum("size").alias("size"), F.lit(0).alias("broken"))
    aside = spark.read.text(f"{place}/broken").agg(F.count(F.lit(1)).alias("broken"))
    return per.unionByName(aside.select(F.lit(None).cast("string").alias("role"), F.lit(0).alias("good"),
                                        F.lit(None).cast("bigint").alias("size"), "broken"))


@register("k10_global_sample", """
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, l_orderkey * 1000003 + l_partkey * 1009 + l_suppkey * 7 + l_linenumber AS id FROM lineitem)
WHERE (md5(concat_ws('-', CAST(id AS VARCHAR), '42')), id) <= (
  SELECT (h, id) FROM (SELECT id, md5(concat_ws('-', CAST(id AS VARCHAR), '42')) AS h, row_number() OVER (
    ORDER BY md5(concat_ws('-', CAST(id AS VARCHAR), '42')), id) AS rn
    FROM (SELECT l_orderkey * 1000003 + l_partkey * 1009 + l_suppkey * 7 + l_linenumber AS id FROM lineitem)) WHERE rn = 5000)""")
def k10_global_sample(spark, sf_dir):
    """5,000 line items of the whole table without replacement, by hash."""
    from maskforge.operators import sampling
    li = T.read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn(
        "id", F.col("l_orderkey") * 1000003 + F.col("l_partkey") * 1009 + F.col("l_suppkey") * 7 + F.col("l_linenumber"))
    return sampling.global_sample(li, "id", 5000).select("l_orderkey", "l_linenumber", "l_partkey")
