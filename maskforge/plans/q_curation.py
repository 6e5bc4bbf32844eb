"""Sampling (K9-K12) and curation joins (D1-D5, D13) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskforge.operators import sampling as S
from maskforge.plans import duck as Q
from maskforge.plans.registry import register
from maskforge.sources import tables as T


@register("k9_split_counts", """
SELECT CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'test' ELSE 'dev' END AS split,
       count(*) AS files, sum(n_chars) AS n_chars
FROM (SELECT n_chars, """ + Q.uniform("concat_ws('-', source || '/' || doc_id, '42')") + """ AS u
      FROM documents)
GROUP BY 1""")
def k9_split_counts(spark, sf_dir):
    """K9: weighted 0.8/0.1/0.1 file split by hash of the path (partition-independent)."""
    d = T.read(spark, sf_dir, "documents", "doc_id", "source", "n_chars")  # one pruned scan
    files = d.select(T.file_path(), "n_chars")
    return (files.withColumn("split", S.weighted_split(F.col("path")))
            .groupBy("split").agg(F.count(F.lit(1)).alias("files"),
                                  F.sum("n_chars").alias("n_chars")))


@register("k9_split_files", """
SELECT source || '/' || doc_id AS path,
       CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'test' ELSE 'dev' END AS split
FROM (SELECT source, doc_id, """ + Q.uniform("concat_ws('-', source || '/' || doc_id, '42')")
                                + """ AS u FROM documents)""")
def k9_split_files(spark, sf_dir):
    """The split assignment of every file (one row per file)."""
    files = T.read(spark, sf_dir, "documents", "doc_id", "source").select(
        "doc_id", T.file_path())
    return files.select("path", S.weighted_split(F.col("path")).alias("split"))


@register("k11_shuffle_keys", """
SELECT o_orderkey, md5(concat_ws('-', o_orderkey, '42')) AS shuffle_key FROM orders""")
def k11_shuffle_keys(spark, sf_dir):
    """Reproducible shuffle order key of every order."""
    o = T.read(spark, sf_dir, "orders", "o_orderkey")
    return o.select("o_orderkey", S.shuffle_key(F.col("o_orderkey")).alias("shuffle_key"))


@register("k12_batches", """
SELECT (rn - 1) // 250 AS batch, count(*) AS jobs, min(o_orderkey) AS first_key,
       max(o_orderkey) AS last_key
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)
GROUP BY 1""")
def k12_batches(spark, sf_dir):
    """Fixed-size batches of 250 jobs in key order (distributed row numbers)."""
    o = T.read(spark, sf_dir, "orders", "o_orderkey")
    b = S.batches(o, "o_orderkey", 250)
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("jobs"),
                                  F.min("o_orderkey").alias("first_key"),
                                  F.max("o_orderkey").alias("last_key"))


@register("k10_sample_per_source", """
SELECT source, doc_id FROM (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source
         ORDER BY md5(concat_ws('-', doc_id, '42'))) AS r FROM documents) WHERE r <= 5""")
def k10_sample_per_source(spark, sf_dir):
    """Five hash-chosen documents per source (a sampling operator: the limit
    is the feature)."""
    d = T.read(spark, sf_dir, "documents", "source", "doc_id")
    return S.sample_per_group(d, "source", "doc_id", 5)


@register("d1_valid_projects", """
SELECT c_custkey FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def d1_valid_projects(spark, sf_dir):
    """Projects (customers) whose dependency check (an order with status F,
    standing in for exit code 0) passed: a left semi join."""
    c = T.read(spark, sf_dir, "customer", "c_custkey")
    ok = T.read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").filter(
        F.col("o_orderstatus") == "F")
    return c.join(ok, c.c_custkey == ok.o_custkey, "left_semi")


@register("d2_missing_projects", """
SELECT DISTINCT o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def d2_missing_projects(spark, sf_dir):
    """Referential check -- projects required by the task list (orders) that
    are missing from the variant (customers with a non-negative balance)."""
    o = T.read(spark, sf_dir, "orders", "o_custkey")
    c = T.read(spark, sf_dir, "customer", "c_custkey", "c_acctbal").filter(F.col("c_acctbal") >= 0)
    return o.join(c, o.o_custkey == c.c_custkey, "left_anti").distinct()


@register("d4_manifest_dedup", """
SELECT count(*) AS files, count(DISTINCT path) AS distinct_files FROM (
  SELECT source || '/' || doc_id AS path FROM documents
  UNION ALL SELECT source || '/' || doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""")
def d4_manifest_dedup(spark, sf_dir):
    """Union of per-project file lists with first-seen dedup, counted."""
    files = T.read(spark, sf_dir, "documents", "doc_id", "source").select(
        "doc_id", T.file_path()).select("path", "doc_id")
    labeled = files.join(T.read(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_semi")
    both = files.select("path").unionAll(labeled.select("path"))
    return both.agg(F.count(F.lit(1)).alias("files"),
                    F.count_distinct("path").alias("distinct_files"))


@register("d5_resume_pending", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def d5_resume_pending(spark, sf_dir):
    """Resume -- documents not yet processed (no row in the done log)."""
    d = T.read(spark, sf_dir, "documents", "doc_id")
    done = T.read(spark, sf_dir, "labels", "doc_id")
    return d.join(done, "doc_id", "left_anti")


@register("d13_source_union", """
SELECT source FROM documents UNION SELECT 'lang:' || lang FROM documents""")
def d13_source_union(spark, sf_dir):
    """Set union of two distinct key sets."""
    d = T.read(spark, sf_dir, "documents", "source", "lang")
    return d.select("source").union(
        d.select(F.concat(F.lit("lang:"), "lang").alias("source"))).distinct()


@register("s16_variant_copy", """
SELECT source || '/' || doc_id AS path, 'explicit' AS variant, n_chars
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def s16_variant_copy(spark, sf_dir):
    """Copy only manifest files (here: quality-labelled) into a variant."""
    files = T.read(spark, sf_dir, "documents", "doc_id", "source", "n_chars").select(
        "doc_id", T.file_path(), "n_chars")
    manifest = T.read(spark, sf_dir, "labels", "doc_id", "quality").filter(F.col("quality") == 1)
    return (files.join(manifest, "doc_id", "left_semi")
            .select("path", F.lit("explicit").alias("variant"), "n_chars"))


@register("s13_split_sink_roundtrip", """
SELECT CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'test' ELSE 'dev' END AS split,
       count(*) AS files, sum(length(path)) AS path_chars
FROM (SELECT source || '/' || doc_id AS path,
             """ + Q.uniform("concat_ws('-', source || '/' || doc_id, '42')") + """ AS u
      FROM documents) GROUP BY 1""")
def s13_split_sink_roundtrip(spark, sf_dir):
    """Fan the file list out by split into partitioned JSON under the shared
    checkpoint folder, read it back with an explicit schema, count per split."""
    from pyspark.sql import types as TT

    from maskforge.session import stage_path
    from maskforge.sources import sinks
    files = T.read(spark, sf_dir, "documents", "doc_id", "source").select(
        "doc_id", T.file_path()).select(
        "path", S.weighted_split(F.col("path")).alias("split"))
    out = stage_path(spark, "splits")
    sinks.write_partitioned_json(files, out, "split")
    back = sinks.read_json(spark, out, TT.StructType([TT.StructField("path", TT.StringType()),
                                                      TT.StructField("split", TT.StringType())]))
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("files"),
                                     F.sum(F.length("path")).alias("path_chars"))
