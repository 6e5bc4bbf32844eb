"""Marking and task queries (K1-K8) over the derived code corpus.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from maskforge.operators import marking as K
from maskforge.plans import duck_marking as M
from maskforge.plans.registry import register
from maskforge.sources import tables as T


@register("k1_markers", M.MARKERS)
def k1_markers(spark, sf_dir):
    """K1: marker count and marked-text digest per file of the code corpus."""
    code = T.code_corpus(spark, sf_dir)
    m = K.add_markers(code, "path", "content", "marked")
    return m.select("path", "n_markers", F.md5("marked").alias("digest"))


@register("k5_common_markers", M.COMMON)
def k5_common_markers(spark, sf_dir):
    """K2-K6: per file, markers valid in all three type variants, capped at 15."""
    c = K.common_markers(K.variant_frame(T.code_corpus(spark, sf_dir)))
    return c.select("path", F.size("common").alias("n_common"),
                    F.array_join("common", ",").alias("markers"))


def _test_tasks(spark, sf_dir, replace_literals):
    files = K.test_files(T.code_corpus(spark, sf_dir))
    return K.tasks(K.raw_tasks(K.variant_frame(files)), replace_literals)


@register("k7_tasks", M.TASKS)
def k7_tasks(spark, sf_dir):
    """K7/K8/K9: completion tasks of the test split for every (type variant x comment class)
    dataset."""
    t = _test_tasks(spark, sf_dir, True)
    return t.select("path", F.lit("test").alias("split"), "variant", "comments", "ordinal", "marker",
                    F.md5("input").alias("input_digest"), "gt")


@register("k8_dataset_sizes", M.SIZES)
def k8_dataset_sizes(spark, sf_dir):
    """K8: number of test tasks per output dataset ``<variant>-<comments>``."""
    t = _test_tasks(spark, sf_dir, False)
    return (t.groupBy(F.concat_ws("-", "variant", "comments").alias("dataset"))
            .agg(F.count(F.lit(1)).alias("tasks"), F.sum(F.length("gt")).alias("gt_chars")))
