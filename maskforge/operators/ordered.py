"""Distributed ordered scans: prefix sums and running extrema without a global window.

A ``Window`` without ``partitionBy`` (or partitioned by a low-cardinality key such as a
language that may hold a third of all rows) sends every row of a group through one task.
Instead:

1. the frame is range-partitioned on (group keys, order keys), tagged with its range
   number and written once to the shared folder; everything below reads that one table, so
   all parts agree on where each row is;
2. running values are taken inside each (range, group), which is never more than a range;
3. per-(range, group) totals are summed over earlier ranges and added.  Only the first and
   the last group of a range can continue elsewhere, so this table has at most two rows
   per range and is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskforge.session import stage_path

_RANGE = "__range"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str],
           partitions: int | None = None) -> DataFrame:
    """``df`` with the number of its key range, written once."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(n, *keys, *order).withColumn(_RANGE, F.spark_partition_id())
    return stage(out, "ranges")


def _same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    cond = left[_RANGE] == right[_RANGE]
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[str],
               sums: Sequence[str] = (), maxes: Sequence[str] = (),
               count_col: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add running sums (``run_<c>``), running maxima (``runmax_<c>``) and a running row
    number (``count_col``) per group ``keys`` in ``order``; inclusive of the row.

    Null keys are a group; null values add nothing and leave a maximum as it was (null
    before the first value).  Integer sums stay integers.
    """
    keys, order, sums, maxes = list(keys), list(order), list(sums), list(maxes)
    names = df.columns
    table = ranged(df, keys, order, partitions)
    here = Window.partitionBy(_RANGE, *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = table.select("*", *[F.coalesce(F.sum(c).over(here), F.lit(0)).alias(f"run_{c}") for c in sums],
                         *[F.max(c).over(here).alias(f"runmax_{c}") for c in maxes],
                         F.count(F.lit(1)).over(here).alias("__rows"))
    totals = table.groupBy(_RANGE, *keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"__s_{c}") for c in sums],
        *[F.max(c).alias(f"__m_{c}") for c in maxes], F.count(F.lit(1)).alias("__n"))
    if keys:
        group = F.struct(*keys)
        in_range = Window.partitionBy(_RANGE)
        totals = totals.withColumn("__first", F.min(group).over(in_range)).withColumn(
            "__last", F.max(group).over(in_range))
        totals = totals.where(group.eqNullSafe(F.col("__first")) | group.eqNullSafe(F.col("__last")))
    earlier = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        _RANGE, *keys, *[F.sum(f"__s_{c}").over(earlier).alias(f"__s_{c}") for c in sums],
        *[F.max(f"__m_{c}").over(earlier).alias(f"__m_{c}") for c in maxes],
        F.sum("__n").over(earlier).alias("__n"))
    # at most two rows per range
    joined = local.join(F.broadcast(before), _same(local, before, keys), "left")
    out = [local[c] for c in names]
    out += [(F.col(f"run_{c}") + F.coalesce(F.col(f"__s_{c}"), F.lit(0))).alias(f"run_{c}") for c in sums]
    out += [F.greatest(F.col(f"runmax_{c}"), F.col(f"__m_{c}")).alias(f"runmax_{c}") for c in maxes]
    if count_col:
        out.append((F.col("__rows") + F.coalesce(F.col("__n"), F.lit(0))).cast("long").alias(count_col))
    return joined.select(*out)


def sliding_window(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                   width: int, out: str, partitions: int | None = None) -> DataFrame:
    """Sum (``<out>_sum``) and row count (``<out>_n``) of ``value`` over the current and
    ``width - 1`` preceding rows per group (their ratio is the sliding mean).

    Rows are dealt into blocks of ``64 * width`` neighbours by their running number; the
    last ``width - 1`` rows of a block are repeated before the next one, so a window reads
    one block and a 64th of the rows is copied.
    """
    names = df.columns
    block = 64 * width
    numbered = cumulative(df, keys, order, count_col="__i", partitions=partitions)
    at = F.floor((F.col("__i") - 1) / block)
    ahead = F.pmod(F.col("__i") - 1, F.lit(block)) > block - width
    dealt = numbered.withColumn("__at", F.explode(F.when(ahead, F.array(at, at + 1)).otherwise(F.array(at))))
    window = Window.partitionBy(*keys, "__at").orderBy("__i").rowsBetween(1 - width, Window.currentRow)
    return (dealt.withColumn(f"{out}_sum", F.sum(value).over(window))
            .withColumn(f"{out}_n", F.count(F.lit(1)).over(window))
            .where(F.col("__at") == at).select(*names, f"{out}_sum", f"{out}_n"))
