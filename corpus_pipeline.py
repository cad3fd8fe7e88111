"""The corpus pipeline: each stage's rows are written and read as the next one's docs.

All stages take documents with null in any column, empty and very long texts,
repeated rows and ids, further columns and no rows; each says what it makes of
them.  An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retort.llm import bpe, decontaminate, quality, secrets, simhash
from retort.llm.storage import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned quality rule rejects.

    Null and empty texts and texts without words go; repeated rows stay or go
    together; ids may be null or repeat.  Without labels of both classes all
    others stay.
    """
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least by id (null last), then text hash.

    Repeated rows are copies, and one stays.  Texts without words, null and empty
    ones among them, are groups of their own; of those that share an id one stays.
    """
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs.

    Null and empty texts stay; repeated rows stay or go together; ids don't
    matter.  Null items, and those of under five words, are not searched for.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with owner-specific secrets masked and ``n_chars`` set anew.

    Null and empty texts stay as they are; repeated rows are masked alike and
    count as one repository; a null source is an owner of its own.
    """
    return secrets.redacted(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: null for null text, none for empty text; repeated rows alike."""
    return bpe.encoded(docs)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("decontamination", decontamination), ("secret scan", secret_scan), ("bpe encoding", bpe_encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "_"))
    return docs
