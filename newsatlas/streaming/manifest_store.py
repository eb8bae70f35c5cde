"""The manifest of a stream: a compacted base in buckets of links, and a tail of batches.

A batch overwrites its own folder of the tail, so a replay leaves the same rows. When the tail has ``TAIL`` finished batches,
they are merged into the base: only buckets that they touch are written again, under a new version, and a pointer that is
written last names the version of every bucket. A batch that asks for its links reads the buckets of these links and the
tail, whatever the length of the history.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsatlas.operators.keys import one_per_key
from newsatlas.session import cut
from newsatlas.sources import schemas

BUCKETS = 256
TAIL = 16
ROWS = schemas.MANIFEST + ", batch BIGINT"
POINTER = "bucket INT, version BIGINT, upto BIGINT, made BIGINT"


def bucket(link: Column | str = "link") -> Column:
    return F.pmod(F.xxhash64(link), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, schema: str, path: str, *paths: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path, *paths)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass
class Pointer:
    """Version of each bucket, the last batch that is in the base, and the number of the pointer."""

    versions: dict[int, int] = field(default_factory=dict)
    upto: int = -1
    made: int = 0


def pointer(spark: SparkSession, folder: str) -> Pointer:
    """The newest pointer: at most ``BUCKETS`` rows."""
    rows = _read(spark, POINTER, f"{folder}/pointer")
    last = rows.agg(F.max("made")).first()[0]
    if last is None:
        return Pointer()
    found = rows.where(F.col("made") == last).collect()
    return Pointer({r["bucket"]: r["version"] for r in found if r["bucket"] >= 0}, max(r["upto"] for r in found), last)


def base(spark: SparkSession, folder: str, at: Pointer, buckets: list[int] | None = None) -> DataFrame:
    """Rows of the base, of all buckets or of some."""
    kept = sorted((b, v) for b, v in at.versions.items() if buckets is None or b in set(buckets))
    if not kept:
        return spark.createDataFrame([], ROWS)
    return _read(spark, ROWS, *[f"{folder}/base/version={v}/bucket={b}" for b, v in kept])


def tail(spark: SparkSession, folder: str, at: Pointer) -> DataFrame:
    return _read(spark, ROWS, f"{folder}/tail").where(F.col("batch") > at.upto)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Current manifest: the latest row of each link."""
    at = pointer(spark, folder)
    rows = base(spark, folder, at).unionByName(tail(spark, folder, at))
    return one_per_key(rows, ["link"], [F.desc("batch")]).drop("batch")


def finished(spark: SparkSession, folder: str, links: DataFrame, batch: int) -> DataFrame:
    """Which of the links are extracted by their latest row; rows that a failed run of this batch left do not count."""
    at = pointer(spark, folder)
    touched = [r[0] for r in links.select(bucket()).distinct().collect()]  # at most BUCKETS
    rows = base(spark, folder, at, touched).unionByName(tail(spark, folder, at))
    asked = rows.where(F.col("batch") != batch).join(links, "link", "left_semi")
    return one_per_key(asked, ["link"], [F.desc("batch")]).where(F.col("status") == schemas.OK).select("link")


def append(rows: DataFrame, folder: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/tail/batch={batch}")


def compact(spark: SparkSession, folder: str, before: int, least: int = TAIL) -> bool:
    """Merge the batches below ``before`` into the base, if there are ``least`` of them. They are committed, so none is replayed."""
    at = pointer(spark, folder)
    old = tail(spark, folder, at).where(F.col("batch") < before)
    batches = [r[0] for r in old.select("batch").distinct().collect()]  # fewer than 2 * TAIL while every batch compacts
    if len(batches) < max(1, least):
        return False
    version = at.made + 1
    fresh = cut(old.withColumn("bucket", bucket()))
    touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
    rows = base(spark, folder, at, touched).withColumn("bucket", bucket()).unionByName(fresh)
    merged = one_per_key(rows, ["bucket", "link"], [F.desc("batch")])
    merged.repartition("bucket").sortWithinPartitions("bucket", "link").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/base/version={version}")
    versions = at.versions | {b: version for b in touched}
    made = [(b, v, max(batches)) for b, v in versions.items()] or [(-1, version, max(batches))]
    spark.createDataFrame(made, "bucket INT, version BIGINT, upto BIGINT").coalesce(1).write.mode("overwrite").parquet(f"{folder}/pointer/made={version}")
    return True
