"""Article bodies in few large files.

Every append writes one segment: files sorted by path, in row groups of a few megabytes with a Bloom filter of the paths.
A directory has one row per file with its least and greatest path. Bodies are looked up by path: the directory names the
files that may hold them, and the statistics in these files name the row groups. No listing ever has a file per article.
A path in a later segment replaces the earlier body. Writing a segment again replaces it, so a repeated step is harmless.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsatlas.operators.keys import one_per_key
from newsatlas.session import cut

FILE_BYTES = 128 << 20
ROW_GROUP_BYTES = 8 << 20
FEW = 200  # paths that are asked for one by one; more are met by a join
BODY = "markdown_path STRING, markdown_text STRING"
DIRECTORY = "file STRING, low STRING, high STRING, bodies BIGINT, segment BIGINT"


def append(bodies: DataFrame, folder: str, segment: int, file_bytes: int = FILE_BYTES) -> None:
    """Write (markdown_path, markdown_text), one row per path, as a segment."""
    spark = bodies.sparkSession
    rows = cut(bodies.select("markdown_path", "markdown_text").where("markdown_path IS NOT NULL"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("markdown_text")), F.lit(0))).first()[0]
    files = max(1, -(-size // file_bytes))
    path = f"{folder}/segments/segment={segment}"
    placed = rows.repartitionByRange(files, "markdown_path").sortWithinPartitions("markdown_path")
    placed.write.mode("overwrite").options(**{"parquet.block.size": str(ROW_GROUP_BYTES), "parquet.bloom.filter.enabled#markdown_path": "true"}).parquet(path)
    kept = spark.read.schema(BODY).parquet(path)
    listed = kept.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("markdown_path").alias("low"), F.max("markdown_path").alias("high"), F.count(F.lit(1)).alias("bodies"))
    listed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/directory/segment={segment}")


def directory(spark: SparkSession, folder: str) -> DataFrame | None:
    """One row per file, or nothing where the folder is no store."""
    try:
        return spark.read.schema(DIRECTORY).parquet(f"{folder}/directory")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _files(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """(markdown_path, markdown_text, segment) of the files named."""
    base = f"{folder}/segments"
    paths = [f"{base}/segment={r['segment']}/{r['file']}" for r in listed.select("segment", "file").distinct().collect()]
    schema = BODY + ", segment BIGINT"
    return spark.read.schema(schema).option("basePath", base).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _newest(rows: DataFrame, segments: int) -> DataFrame:
    return (one_per_key(rows, ["markdown_path"], [F.desc("segment")]) if segments > 1 else rows).drop("segment")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All bodies. With a single segment no row moves."""
    listed = directory(spark, folder)
    return _newest(_files(spark, folder, listed), listed.select("segment").distinct().count())


def get(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Bodies of the wanted paths (column ``markdown_path``), from the files that may hold them."""
    keys = cut(wanted.select("markdown_path").where("markdown_path IS NOT NULL").distinct())
    listed = directory(spark, folder)
    held = listed.join(keys, (F.col("markdown_path") >= F.col("low")) & (F.col("markdown_path") <= F.col("high")), "left_semi")
    found = _files(spark, folder, cut(held))
    some = [r[0] for r in keys.limit(FEW + 1).collect()]
    if not some:
        return found.drop("segment").limit(0)
    if len(some) <= FEW:
        rows = found.where(reduce(lambda a, b: a | b, [F.col("markdown_path") == k for k in some]))
    else:
        rows = found.join(keys, "markdown_path", "left_semi")
    return _newest(rows, 2)


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths only; the texts are not read."""
    return _files(spark, folder, directory(spark, folder)).select("markdown_path").distinct()


def compact(spark: SparkSession, folder: str, target: str, file_bytes: int = FILE_BYTES) -> None:
    """The newest bodies as one segment of another folder."""
    append(read(spark, folder), target, 0, file_bytes)
