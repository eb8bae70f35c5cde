"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


TASK_BYTES = 8 << 20  # of text in a task
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="newsatlas-code-"), "newsatlas"), "zip", os.path.dirname(home), os.path.basename(home)
    )
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings every operator relies on; sizing stays with the caller."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    if spark.conf.get(BATCH_ROWS, None) is None:
        spark.conf.set(BATCH_ROWS, "1000")  # whole pages travel to Python: keep a batch of them small
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The reliable folder of the session; a temporary one only on a local master."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="newsatlas-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Lost executors then replay reads, not the lineage; readers keep column pruning, filter pushdown and
    true sizes, from which Spark picks its joins. Texts make up most of what is written, so it is packed well.
    """
    path = scratch_dir(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, where the order and borders of partitions must be kept."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Inputs of fewer splits than the cluster has cores are dealt out, since text work is bound by CPU.

    Large inputs have more splits than that and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def spread_text(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Rows dealt out by the bytes of their text: no task has much more than TASK_BYTES of it, or one row, however large
    the splits and row groups of the files are. With keys, equal keys meet, so that a join on them moves no text again.
    """
    total = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES)), *keys)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by key with the configured number of partitions.

    The number is given outright, so that adaptive execution does not merge partitions whose rows are few
    now and many after the explode that follows.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
