import os

from pyspark.sql import functions as F

from maskforge.streaming import ingest


def folders(place):
    return sorted(n for n in os.listdir(f"{place}/table") if not n.startswith("."))


def test_second_run_adds_only_new_files(spark, tmp_path):
    folder, place = str(tmp_path / "in"), str(tmp_path / "place")
    part = lambda lo, hi: spark.range(lo, hi).withColumn("v", F.col("id") * 2)
    part(0, 10).write.parquet(folder)
    read = lambda: ingest.file_stream(spark, folder, "*.parquet", "id long, v long")
    assert ingest.run_to_table(read(), "append", place).count() == 10
    assert ingest.run_to_table(read(), "append", place).count() == 10
    part(10, 15).write.mode("append").parquet(folder)
    ids = sorted(r.id for r in ingest.run_to_table(read(), "append", place).collect())
    assert ids == list(range(15))


def test_running_state_survives_a_restart(spark, tmp_path):
    folder, place = str(tmp_path / "in"), str(tmp_path / "place")
    total = lambda: ingest.file_stream(spark, folder, "*.parquet", "id long").agg(F.sum("id").alias("s"))
    spark.range(0, 10).coalesce(1).write.parquet(folder)
    assert ingest.run_to_table(total(), "complete", place).collect()[0].s == 45
    spark.range(10, 12).coalesce(1).write.mode("append").parquet(folder)
    assert ingest.run_to_table(total(), "complete", place).collect()[0].s == 66


def test_update_mode_writes_changed_keys_and_compacts(spark, tmp_path):
    folder, place = str(tmp_path / "in"), str(tmp_path / "place")

    def add(rows):
        spark.createDataFrame(rows, "k string, v long").coalesce(1).write.mode("append").parquet(folder)

    def run():
        agg = ingest.file_stream(spark, folder, "*.parquet", "k string, v long").groupBy("k").agg(F.sum("v").alias("s"))
        return {r.k: r.s for r in ingest.run_to_table(agg, "update", place, ["k"]).collect()}

    add([("a", 1), ("b", 2), (None, 5)])
    assert run() == {"a": 1, "b": 2, None: 5}
    add([("b", 3)])
    assert run() == {"a": 1, "b": 5, None: 5}
    second = spark.read.parquet(f"{place}/table/{folders(place)[-1]}")
    assert [r.k for r in second.collect()] == ["b"]  # the changed key alone
    last = folders(place)[-1]
    before = spark.read.parquet(f"{place}/table/{last}").collect()
    # a replayed batch replaces its folder and changes nothing
    spark.createDataFrame(before, second.schema).write.mode("overwrite").parquet(f"{place}/table/{last}")
    assert run() == {"a": 1, "b": 5, None: 5}
    assert ingest.compact(spark, place, ["k"]) >= 1 and run() == {"a": 1, "b": 5, None: 5}
    add([("a", 10), ("c", 7)])
    assert run() == {"a": 11, "b": 5, "c": 7, None: 5}
    assert ingest.compact(spark, place, ["k"]) >= 1 and ingest.compact(spark, place, ["k"]) <= 1
    assert run() == {"a": 11, "b": 5, "c": 7, None: 5}


def test_first_records_are_written_once(spark, tmp_path):
    folder, place = str(tmp_path / "in"), str(tmp_path / "place")
    schema = "k string, at long, v string"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = ingest.first_per_key(ingest.file_stream(spark, folder, "*.parquet", schema), "k", ["at", "v"])
        return sorted((r.k or "", r.at, r.v) for r in ingest.run_to_table(stream, "append", place).collect())

    add([("a", 3, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 9, "q")])
    assert run() == [("a", 1, "y"), ("b", 9, "q")]
    # a restart knows the keys; an earlier time in a later batch comes too late
    add([("a", 0, "late"), ("c", 5, "n"), ("c", 4, "m")])
    assert run() == [("a", 1, "y"), ("b", 9, "q"), ("c", 4, "m")]
    written = [r.k for f in folders(place) for r in spark.read.parquet(f"{place}/table/{f}").collect()]
    assert sorted(written) == ["a", "b", "c"]  # each batch wrote its new keys alone
    assert run() == [("a", 1, "y"), ("b", 9, "q"), ("c", 4, "m")]
