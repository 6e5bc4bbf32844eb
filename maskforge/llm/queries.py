"""The numbered queries ``opN_*``: thin digests over the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskforge.llm import decontaminate, digest, fuzzylines, licenses, longmatch, mixing, nbsvm, phrases, robust, secrets, simhash, tokens, whitening
from maskforge.llm.common import stage_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of every document, read back into offsets and checksums."""
    path = stage_path(spark, "token-files")
    tokens.write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), path, "byte_bpe_50k.json")
    return tokens.token_digest(tokens.token_files(spark, path))


@query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents (4-word shingles, 4 bits)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.simhash_components(docs).select("doc_id", "fingerprint", "component_id")


@query
def op3_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality rules and the MCD verdict for every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return robust.outliers(docs)


def quality_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> nbsvm.Model:
    """Model learnt from the labelled rows of ``docs`` that are not held out."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(~nbsvm.held_out())
    return nbsvm.train(docs, labels)


@query
def op9_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels are learnt outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = nbsvm.score(docs, quality_model(docs, spark, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", nbsvm.held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document with corpus-wide ownership."""
    return secrets.secret_spans(table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"))


ORACLES["op4_secret_ownership"] = secrets.oracle()


@query
def op7_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best licence template of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return licenses.license_scan(docs, licenses.templates(spark))


ORACLES["op7_license_dice"] = licenses.oracle()

#: mixture of the query and the pipeline: three domains by source, then language, then source
MIX_WEIGHTS = {"d0": 2, "d1": 1, "d2": 1, "d0/en": 3, "d1/en": 2, "d2/en": 2}
MIX_EPOCHS = 4
MIX_SEED = 42


def domain(source="source"):
    """The domain of a source: a stable third of the sources."""
    first = F.substring(F.md5(F.coalesce(F.col(source), F.lit(""))), 1, 1)
    return F.concat(F.lit("d"), (F.ascii(first) % 3).cast("string"))


def mix_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(MIX_WEIGHTS.items()), "path string, weight bigint")


@query
def op10_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and epochs of the mixture over domain, language and source."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").withColumn("domain", domain())
    return mixing.mixed_ids(docs, ["domain", "lang", "source"], mix_weights(spark), 1.0, MIX_EPOCHS, MIX_SEED)


ORACLES["op10_hierarchical_mix"] = mixing.oracle(
    MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED,
    "'d' || CAST(ascii(substr(md5(coalesce(source, '')), 1, 1)) % 3 AS VARCHAR)")


@query
def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat strings of 400 bytes, removed and digested."""
    out = longmatch.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op5_repeated_strings"] = longmatch.oracle()


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, with the item and similarity."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


@query
def op8_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document and those removed as near copies of an earlier line."""
    out = fuzzylines.removed_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"),
                      F.array_join("removed", ",").alias("removed_lines"))


@query
def op11_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, with their likeness."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return digest.edit_study(docs, digest.entropy_ranks(docs))


@query
def op12_son_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best collocations of two to four words of every language."""
    return phrases.phrase_collocations(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


ORACLES["op12_son_phrases"] = phrases.oracle()


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading whitened components of every usable embedding."""
    out = whitening.whitened_components(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return out.withColumn("deviation", F.col("deviation").cast("bigint"))
