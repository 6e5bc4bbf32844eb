"""Readers for the driver tables and the corpus views derived from them (S-operators).

Every reader names the columns it needs, so the parquet scan prunes columns and
Catalyst can push filters into it.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table's columns; how a scan is split is left to Spark's file settings."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def file_path() -> "Column":
    """``path = source/doc_id`` of a document row."""
    return F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(path, repo, content, lang)`` view of ``documents``: repo = source."""
    d = read(spark, sf_dir, "documents", "doc_id", "source", "text", "lang")
    return d.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.col("doc_id"),
        F.col("source").alias("repo"),
        F.col("text").alias("content"),
        F.col("lang"),
    )


# --- derived TypeScript-like corpus ------------------------------------------
# One file per l_orderkey, lines ordered by (l_linenumber, l_partkey, l_suppkey).
# The same expression text runs in Spark and DuckDB, so code operators get a
# real oracle.  Only integers and strings are used (double formatting differs).
CODE_LINE_SQL = """concat(
  CASE WHEN l_linenumber = 1 THEN concat('/**', chr(10), ' * order ', CAST(l_orderkey AS STRING),
       chr(10), ' */', chr(10)) ELSE '' END,
  'const q', CAST(l_linenumber AS STRING), ': number = ', CAST(l_partkey AS STRING),
  '; // ', l_returnflag, chr(10),
  '/* ', l_linestatus, ' */ let s', CAST(l_suppkey AS STRING), ' /* k */ = "', l_returnflag,
  '";', chr(10),
  CASE WHEN l_linenumber % 3 = 0 THEN concat('function f', CAST(l_partkey AS STRING),
       '(a: number, b) {', chr(10), '  return `$', '{a}-', CAST(l_suppkey AS STRING), '`;', chr(10),
       '}', chr(10)) ELSE '' END,
  CASE WHEN l_linenumber = 2 THEN chr(10) ELSE '' END)"""

CODE_REPOS = 20


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code(path BIGINT, repo STRING, content STRING)``: the ``normal`` variant."""
    return line_files(spark, sf_dir, CODE_LINE_SQL, "content").select(
        "path", (F.col("path") % CODE_REPOS).cast("string").alias("repo"), "content")


#: bytes of lines, as Spark estimates them, whose texts one task makes
PART_BYTES = 1 << 20


def parts_of(df: DataFrame) -> int:
    """Parts to deal ``df`` into: one for each ``PART_BYTES``, as many as there are cores at least and as the
    session's shuffle partitions at most.  Texts take many times the room of the rows they are made
    of, so the parts that follow from the size of the shuffle are too few."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, max(spark.sparkContext.defaultParallelism, size // PART_BYTES)))


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey")
LINE_COLUMNS = (*LINE_ORDER, "l_returnflag", "l_linestatus")


def line_files(spark: SparkSession, sf_dir: str, line_sql: str, out: str) -> DataFrame:
    """``(path, out)``: per l_orderkey the texts ``line_sql`` makes of its lineitem rows, joined in their order.

    Rows are grouped by their columns and the texts made afterwards, so no text is shuffled or sorted."""
    columns = [c for c in LINE_COLUMNS if c in LINE_ORDER or c in line_sql]
    li = read(spark, sf_dir, "lineitem", "l_orderkey", *columns)
    files = li.repartition(parts_of(li), "l_orderkey").groupBy(F.col("l_orderkey").alias("path")).agg(
        F.collect_list(F.struct(*columns)).alias("ls"))
    line = re.sub(r"\bl_orderkey\b", "path", re.sub("|".join(rf"\b{c}\b" for c in columns), r"x.\g<0>", line_sql))
    made = F.expr(f"transform(ls, x -> struct(x.l_linenumber, x.l_partkey, x.l_suppkey, {line} AS t))")
    return files.select("path", F.array_join(F.transform(F.array_sort(made), lambda x: x["t"]), "").alias(out))


def duck_code_corpus_cte() -> str:
    """DuckDB twin of :func:`code_corpus` as a CTE body."""
    return f"""SELECT l_orderkey AS path, CAST(l_orderkey % {CODE_REPOS} AS VARCHAR) AS repo,
  string_agg({CODE_LINE_SQL}, '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS content
FROM lineitem GROUP BY l_orderkey"""
