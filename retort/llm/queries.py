"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, licenses, passages, quality, secrets, shards, simhash, storage, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its bytes."""
    return bpe.encoded(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that rejects each document, if any, of a list learned from ``labels``."""
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in each document."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate secrets of each document, with how many owners have each; a document stands for a repository, its source for the owner."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence spans of each document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of each document, and which document of it stays."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages have a listed domain."""
    listed = spark.createDataFrame([(d,) for d in urlfilter.DOMAINS], "key string")
    return urlfilter.filtered(_table(spark, sf_dir, "pages"), listed)


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one stream of BPE token ids, cut into sequences, each read back from its slot of a shard in the shared folder."""
    end = bpe.vocabulary_size()  # the ids after the vocabulary's: end, then pad
    docs = _table(spark, sf_dir, "documents")
    pieces, layout = shards.materialised(docs, encode=bpe.id_encoder(docs), width=shards.id_width(end + 2), end=end, pad=end + 1)
    folder = storage.shared_folder(spark, "training-order")
    return shards.read_back(shards.write_shards(pieces, layout, folder), layout, folder)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of each document, by a classifier fitted on ``labels``."""
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur twice or more in the corpus."""
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_secrets": op4_secrets,
    "op5_licenses": op5_licenses,
    "op6_simhash": op6_simhash,
    "op7_url_filter": op7_url_filter,
    "op8_training_order": op8_training_order,
    "op9_toxicity": op9_toxicity,
    "op10_passages": op10_passages,
}

ORACLES: dict[str, str] = {
    "op3_decontamination": decontaminate.ORACLE,
    "op4_secrets": secrets.ORACLE,
    "op7_url_filter": urlfilter.ORACLE,
    "op10_passages": passages.ORACLE,
}
