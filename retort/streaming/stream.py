"""Micro-batch forms of pipelines [M2, M4, A8].

``dedup_stream`` keeps Spark's own state by key.  ``run_stream`` runs any
pipeline on each micro-batch and writes its rows under the batch's id, so a
repeated batch replaces its own output; with ``unique_key`` keys of earlier
batches are read from what was written and dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import first_by_key


def dedup_stream(stream: DataFrame, keys: list[str], event_time: str | None = None, watermark: str | None = None) -> DataFrame:
    """First row of each key; a watermark bounds the state to recent keys."""
    if event_time and watermark:
        return stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def seen_keys(spark, path: str, key: str, before: int) -> DataFrame | None:
    """Keys that batches before ``before`` have written."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(where):
        return None
    done = [s.getPath().getName() for s in fs.listStatus(where)]
    parts = [f"{path}/{n}" for n in done if n.startswith("batch=") and int(n[6:]) < before and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))]
    return spark.read.parquet(*parts).select(key) if parts else None


def run_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, unique_key: str | None = None, order: str | None = None, **trigger):
    """Starts the query; ``trigger`` defaults to ``availableNow=True``."""

    def one(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch)
        if unique_key:
            seen = seen_keys(batch.sparkSession, path, unique_key, batch_id)
            if seen is not None:
                out = out.join(seen.distinct().withColumnRenamed(unique_key, "_seen"), F.col(unique_key) == F.col("_seen"), "left_anti")
            out = first_by_key(out, [unique_key], order or unique_key)
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
