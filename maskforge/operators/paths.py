"""Path and line operators on file manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def deepest(files: DataFrame, path: str, name: str) -> DataFrame:
    """Files called ``name`` without one of that name in a folder further down.

    Every match names its ancestors' folders; a match whose folder is named is dropped, an
    equi anti-join."""
    found = files.where(F.element_at(F.split(path, "/"), -1) == name).withColumn("__dir", directory(F.col(path)))
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    named = found.select(F.explode(F.when(F.col("__dir") != "", above)).alias("__dir")).distinct()
    return found.join(named, "__dir", "left_anti").drop("__dir")


def folders_at_depth(files: DataFrame, path: str, depth: int) -> DataFrame:
    """Distinct folders with exactly ``depth`` segments."""
    parts = F.split(path, "/")
    return files.where(F.size(parts) > depth).select(F.array_join(F.slice(parts, 1, depth), "/").alias("folder")).distinct()


def lines(text: Column) -> Column:
    """Lines ended by a line feed, with or without a carriage return; what follows the
    last one is a line unless it is empty."""
    parts = F.split(text, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def restructured(path: Column) -> Column:
    """``folder/name.fn`` becomes ``folder/name/fn.ts``."""
    file = F.element_at(F.split(path, "/"), -1)
    parts = F.split(file, r"\.")
    return F.concat_ws("/", F.when(directory(path) != "", directory(path)), F.get(parts, F.lit(0)),
                       F.concat(F.get(parts, F.lit(1)), F.lit(".ts")))


def valid_sources(files: DataFrame, other: DataFrame, path: str) -> DataFrame:
    """D3: TypeScript files that declare no types only and exist in the other variant too;
    all missing files go."""
    sources = files.where(F.col(path).endswith(".ts") & ~F.col(path).endswith(".d.ts"))
    return sources.join(other.select(path).distinct(), path, "left_semi")
