"""Partitioned JSON / text sinks and schema-checked readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASK_SCHEMA = T.StructType([
    T.StructField("input", T.StringType()),
    T.StructField("gt", T.StringType()),
    T.StructField("marker", T.StringType()),
])
METRIC_SCHEMA = T.StructType([
    T.StructField("empty", T.BooleanType()),
    T.StructField("meteor", T.DoubleType()),
    T.StructField("bleu", T.DoubleType()),
    T.StructField("levenshtein", T.DoubleType()),
    T.StructField("rouge", T.DoubleType()),
    T.StructField("exact_match", T.IntegerType()),
])


def write_partitioned_json(df: DataFrame, path: str, *partition_cols: str,
                           mode: str = "overwrite") -> None:
    """One JSON-lines directory per partition value (no driver loop)."""
    df.write.mode(mode).partitionBy(*partition_cols).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with an explicit schema (never inferred); partition
    columns of the directory layout are discovered as extra columns."""
    return spark.read.schema(schema).json(path)


CORRUPT = "_corrupt_record"


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S9/S10 for files that may hold broken lines: the schema's columns of every line, the file it
    came from (``_file``) and the line itself in ``_corrupt_record`` where it is no JSON object of
    that schema (its columns are null then).  Blank lines are left out."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).where(F.trim("value") != "")
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = lines.select(parsed.alias("j"), "_file", "value")
    # a line that is JSON but no object parses to nothing at all
    lost = F.col("j").isNull() | ~F.col("value").rlike(r"^\s*\{")
    return rows.select(*[F.when(~lost, F.col("j")[f.name]).alias(f.name) for f in schema.fields], "_file",
                       F.when(lost, F.col("value")).otherwise(F.col("j")[CORRUPT]).alias(CORRUPT))


def quarantine(rows: DataFrame, folder: str) -> DataFrame:
    """Write the broken lines of :func:`read_json_lines` to ``folder`` (text, one a line) and return
    the good rows without the helper columns."""
    rows.where(F.col(CORRUPT).isNotNull()).select(CORRUPT).write.mode("overwrite").text(folder)
    return rows.where(F.col(CORRUPT).isNull()).drop("_file", CORRUPT)


def write_text(df: DataFrame, path: str, *partition_cols: str) -> None:
    """One document per line (the single string column of ``df``)."""
    df.write.mode("overwrite").partitionBy(*partition_cols).text(path)
