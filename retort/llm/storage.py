"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where the setting is absent, a local master gets a temporary folder of its
    own (tests); on a cluster its absence is an error, as a machine-local folder
    would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = getattr(shared_dir, "own", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="shared-")
    return own


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    The files go when the JVM ends, or with :func:`discard`.  A lost executor
    costs nothing: no task of a later stage depends on the tasks that wrote them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table from :func:`written` that no plan still to be run reads."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df._written)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder in the shared one, for files that tasks write themselves; they stay."""
    root = shared_dir(spark)
    return f"{root if '://' in root else 'file://' + root.removeprefix('file:')}/{name}-{uuid.uuid4().hex}"
