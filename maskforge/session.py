"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "maskforge") -> SparkSession:
    """Session for the engine; whatever the launcher has set already wins.

    On a cluster the launcher decides master, memory and shuffle partitions; here we
    only fill gaps so local runs and tests behave like the cluster plan.
    """
    if SparkContext._gateway is None:  # heap size counts only before the JVM starts
        heap = os.environ.get("MASKFORGE_DRIVER_MEMORY", "12g")
        os.environ.setdefault("PYSPARK_SUBMIT_ARGS", f"--driver-memory {heap} pyspark-shell")
    given = dict(SparkConf().getAll())
    running = SparkSession.getActiveSession()
    if running is not None:
        given |= dict(running.sparkContext.getConf().getAll())
    gaps = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # text stages are CPU-bound per byte: keep post-shuffle partitions small
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master:
        gaps["spark.master"] = master
    if shuffle_partitions:
        gaps["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    elif os.environ.get("BENCH_CPUS"):
        gaps["spark.sql.shuffle.partitions"] = os.environ["BENCH_CPUS"]
    builder = SparkSession.builder.appName(app)
    for key, value in gaps.items():
        if key not in given:
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised intermediates.

    The cluster names it in ``spark.checkpoint.dir``.  A single-process master
    (``local[..]``, as in tests) gets a folder of its own when the setting is absent;
    anywhere else the absence is an error, as executors do not share local folders.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="maskforge-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


#: bytes of one Arrow batch whose rows hold arrays; their Python objects take many times as much
ARROW_BYTES = 8 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``ARROW_BYTES`` (a smaller setting stays)."""
    if int(str(spark.conf.get(_ARROW, str(64 << 20))).removesuffix("b")) > ARROW_BYTES:
        spark.conf.set(_ARROW, str(ARROW_BYTES))


_STAGED: dict[str, list[str]] = {}


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for a staged table below the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/maskforge/{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_stages(spark: SparkSession) -> int:
    """Delete the folders this application staged so far; results that still read them
    must have been written elsewhere.  Returns how many there were."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    return len(paths)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``maskforge`` importable in Python workers (pandas UDFs) by shipping a
    zip of the package with ``addPyFile``; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import shutil

    import maskforge
    pkg_dir = os.path.dirname(os.path.abspath(maskforge.__file__))
    out = tempfile.mkdtemp(prefix="maskforge-py-")
    zpath = shutil.make_archive(os.path.join(out, "maskforge"), "zip",
                                root_dir=os.path.dirname(pkg_dir), base_dir="maskforge")
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
