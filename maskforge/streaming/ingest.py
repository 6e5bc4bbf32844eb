"""Incremental ingestion with Structured Streaming.

X1 resumable ingestion: a file-source stream whose checkpoint, at a place the caller names, is the
log of done files; a later run with the same place reads only files that came since.

X2 merges partial statistics: a streaming aggregation in update mode hands on only the keys that a
batch changed.  Every batch writes a folder of its own number; the table is the newest row of each
key, and ``compact`` folds old folders into one.

X3 keeps the first record of each key, append-only: ``transformWithState`` holds one row per key
and emits a key once, so a batch writes its new keys and nothing else.  Which record of one batch is
first is decided by the order columns; a record of a later batch never replaces an emitted one.

A batch that is replayed after a failure replaces what it wrote, in all three.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from maskforge.session import stage_path

_BATCH = "__batch"
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of ``folder`` that match ``pattern``, as they come."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def new_place(spark: SparkSession, name: str) -> str:
    """A fresh place for a stream's checkpoint and table below the shared folder."""
    return stage_path(spark, f"stream-{name}")


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def run_to_table(stream: DataFrame, mode: str, place: str, keys: list[str] | None = None) -> DataFrame | None:
    """Drive a stream over all data there is and return its table.

    ``append``: all batches so far.  ``update``: the newest row of each of ``keys``; a batch writes
    changed keys only.  ``complete``: the last batch, which holds the whole state.  The checkpoint
    and the table live below ``place``; running again resumes there.  None when no batch was ever
    written.
    """
    def sink(batch: DataFrame, number: int):
        batch.withColumn(_BATCH, F.lit(number)).write.mode("overwrite").parquet(f"{place}/table/batch={number}")

    spark = stream.sparkSession
    before = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, _ROCKS)  # state on disk; a query keeps the settings of its start
    try:
        query = (stream.writeStream.outputMode(mode).foreachBatch(sink)
                 .option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start())
    finally:
        spark.conf.unset(_STATE_STORE) if before is None else spark.conf.set(_STATE_STORE, before)
    query.awaitTermination()
    return read_table(spark, mode, place, keys)


def _all_batches(spark: SparkSession, place: str) -> DataFrame | None:
    system, path = _folder(spark, f"{place}/table")
    if not system.exists(path):
        return None
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{place}/table")


def newest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key's last batch: one aggregate, no window over a key's history."""
    rest = [c for c in table.columns if c not in keys]
    row = F.max(F.struct(_BATCH, *[c for c in rest if c != _BATCH])).alias("r")
    return table.groupBy(*keys).agg(row).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def read_table(spark: SparkSession, mode: str, place: str, keys: list[str] | None = None) -> DataFrame | None:
    table = _all_batches(spark, place)
    if table is None:
        return None
    if mode == "complete":
        last = table.agg(F.max(_BATCH)).first()[0]  # one number
        table = table.where(F.col(_BATCH) == last)
    elif mode == "update":
        table = newest(table, keys)
    return table.drop(_BATCH)


def compact(spark: SparkSession, place: str, keys: list[str]) -> int:
    """Fold an update-mode table's folders into the newest one's number; returns how many folders
    went.  The folded rows are written before any folder goes, and reading both gives the same
    newest rows, so a failure in between loses and doubles nothing."""
    table = _all_batches(spark, place)
    if table is None:
        return 0
    last = table.agg(F.max(_BATCH)).first()[0]
    system, root = _folder(spark, f"{place}/table")
    stay = (f"batch={last}", f"base={last}")  # the second: folded already, nothing came since
    old = [s.getPath() for s in system.listStatus(root) if s.getPath().getName() not in stay]
    if not old:
        return 0
    # rows of the last batch stay where they are: a replay overwrites that folder whole
    earlier = newest(table.where(F.col(_BATCH) < last), keys)
    kept = f"{place}/table/base={last}"
    earlier.write.mode("overwrite").parquet(kept)
    for path in old:
        system.delete(path, True)
    return len(old)


# --- first record of each key ---------------------------------------------------------------

class FirstRecord(StatefulProcessor):
    """Emits a key's least record, by the order columns, of the first batch that holds the key."""

    def __init__(self, key: str, order: list[str], columns: list[str]):
        self.key, self.order, self.columns = key, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            for _ in rows:
                pass
            return
        best = None
        for part in rows:  # one row of each Arrow batch is kept
            part = part if best is None else pd.concat([best, part])
            best = part.sort_values(self.order, kind="stable").head(1)
        if best is not None:
            self.seen.update((True,))
            yield best[self.columns]

    def close(self) -> None:
        pass


def first_per_key(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first record of every key as an append-only stream of ``stream``'s columns.

    Null keys are a key.  The state has one flag per key ever seen, on disk; run it by
    ``run_to_table``, which chooses the state store that this needs."""
    return stream.groupBy(key).transformWithStateInPandas(
        FirstRecord(key, order, stream.columns), outputStructType=stream.schema, outputMode="Append", timeMode="None")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    return file_stream(spark, sf_dir, "events.parquet", schema)


def ingest_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken in by a stream that is run again after it ended; the second run
    finds every file in the log and adds nothing."""
    place = new_place(spark, "ingest")
    columns = ["event_id", "event_type", "value"]
    run_to_table(_events(spark, sf_dir).select(*columns), "append", place)
    return run_to_table(_events(spark, sf_dir).select(*columns), "append", place)


def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + X2: running per-type statistics over the events file stream; a batch writes the types
    it changed."""
    agg = _events(spark, sf_dir).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("value_sum"))
    return run_to_table(agg, "update", new_place(spark, "stats"), ["event_type"])


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of every user, written once when the user is first seen."""
    events = _events(spark, sf_dir).select("user_id", "ts", "event_id")
    firsts = run_to_table(first_per_key(events, "user_id", ["ts", "event_id"]), "append", new_place(spark, "first-seen"))
    return firsts.select("user_id", F.col("event_id").alias("first_event"), F.col("ts").alias("first_ts"))
