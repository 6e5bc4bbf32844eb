"""Training-corpus pipeline over ``documents``: each stage is one operator of ``maskforge.llm``.

Stages take ``(spark, docs, sf_dir)`` and work on all that their predecessor kept; every
result is written as Parquet and read again.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskforge.llm import decontaminate, mixing, nbsvm, simhash, tokens
from maskforge.llm.common import stage_path, staged, table
from maskforge.llm.queries import MIX_EPOCHS, MIX_SEED, domain, mix_weights, quality_model

#: score below which the quality classifier rejects a document
LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents it rejects go."""
    model = quality_model(docs.select("doc_id", "text"), spark, sf_dir)
    return nbsvm.score(docs, model, score_col="__score").where(F.col("__score") >= LEAST_QUALITY).drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: the document with the smallest id of each class stays."""
    return simhash.simhash_dedup(docs, shingle_words=4, max_distance=4)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a copy of a test item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixture by domain, language and source; a document stands once for each epoch it is in."""
    levels = {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mixed_documents(docs, levels, mix_weights(spark), 1.0, MIX_EPOCHS, MIX_SEED)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back into offsets and checksums."""
    path = stage_path(spark, "pipeline-token-files")
    tokens.write_tokens(docs, path, "byte_bpe_50k.json")
    return tokens.token_digest(tokens.token_files(spark, path))


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_copies),
    ("hierarchical_mixing", mix),
    ("token_ids", write_token_ids),
]

#: the classifier and the tokenizer have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
