"""Readers for the index, the manifest, article bodies and stored artifacts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsatlas.functions.series import ui_label
from newsatlas.functions.text import unpack_list
from newsatlas.sources import body_store, csv_records, schemas


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, columns matched by name, quotes doubled and line breaks kept in cells."""
    text = csv_records.read(spark, path)
    wanted = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    return text.select(
        *[
            (F.col(f"`{name}`").try_cast(kind) if name in text.columns else F.lit(None).cast(kind)).alias(name)
            for name, kind in wanted.items()
        ]
    )


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows; a missing file or a missing ``link`` column is an error."""
    try:
        header = csv_records.header(spark, path)
    except AnalysisException as exc:
        raise FileNotFoundError(f"index not found: {path}") from exc
    if "link" not in header:
        raise ValueError("the index needs a 'link' column")
    return read_csv(spark, path, schemas.INDEX)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows; an absent file is an empty manifest."""
    try:
        return read_csv(spark, path, schemas.MANIFEST)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.MANIFEST)


def read_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """(markdown_path, markdown_text): the newest bodies of a packed store, else one row per file below the folder."""
    if body_store.directory(spark, folder) is not None:
        return body_store.read(spark, folder)
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    path = F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), r"^file:/*", "/")
    return files.select(path.alias("markdown_path"), F.col("value").alias("markdown_text"))


def list_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Paths only: no content is read."""
    if body_store.directory(spark, folder) is not None:
        return body_store.paths(spark, folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_replace(F.url_decode(F.col("path")), r"^file:/*", "/").alias("markdown_path"))


def usable_manifest(manifest: DataFrame, bodies: DataFrame) -> DataFrame:
    """Rows with status ok, a path, and a body at that path."""
    done = manifest.where((F.col("status") == schemas.OK) & (F.coalesce("markdown_path", F.lit("")) != ""))
    return done.join(bodies.select("markdown_path").distinct(), "markdown_path", "left_semi")


def missing_bodies(manifest: DataFrame, bodies: DataFrame) -> DataFrame:
    """How many otherwise usable rows have no body."""
    done = manifest.where((F.col("status") == schemas.OK) & (F.coalesce("markdown_path", F.lit("")) != ""))
    gone = done.join(bodies.select("markdown_path").distinct(), "markdown_path", "left_anti")
    return gone.agg(F.count(F.lit(1)).alias("missing"))


def reload_corpus(stored: DataFrame) -> DataFrame:
    """Stored corpus with the helper columns of the browsing queries; packed lists become arrays."""
    arrays = {
        c: (F.col(c) if dict(stored.dtypes)[c].startswith("array") else unpack_list(c))
        for c in ("crime_labels", "modus_labels", "ufs_mencionadas", "estados_mencionados")
    }
    return stored.withColumns(
        {
            **{f"{c}_list": expr for c, expr in arrays.items()},
            "tags_list": unpack_list("tags"),
            "year": F.year("data_publicacao_dt"),
            "month": F.coalesce(F.date_format("data_publicacao_dt", "yyyy-MM"), F.lit("NaT")),
            "has_series": F.col("semantic_series_id").isNotNull(),
        }
    )


def reload_series(stored: DataFrame) -> DataFrame:
    """Stored series with the label fallbacks applied."""
    label = F.coalesce("series_label", "operation_names", "crime_modes", "sample_titles", F.lit("serie_sem_nome"))
    return (
        stored.withColumn("series_label", label)
        .withColumn("operation_names", F.coalesce("operation_names", F.lit("")))
        .withColumn("series_ui_label", ui_label())
    )
