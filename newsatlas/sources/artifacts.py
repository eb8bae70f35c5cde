"""A folder of artifact tables that is replaced as a whole.

Each run writes its tables to a folder of its own and names it in a log as its last step. Readers follow the newest entry
of the log, so they see all tables of one run, and never those of a run that failed or is still writing. Reading checks the
columns and types of every table.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsatlas.sources import schemas, tables

LOG = "number BIGINT, run STRING, tables ARRAY<STRING>, written TIMESTAMP"


def log(spark: SparkSession, folder: str) -> DataFrame:
    """Finished runs, one row each."""
    try:
        return spark.read.schema(LOG).parquet(f"{folder}/log")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def publish(tables_: dict[str, DataFrame], folder: str) -> str:
    """Write the tables as one run and make it the newest; returns the run's folder."""
    spark = next(iter(tables_.values())).sparkSession
    run = uuid.uuid4().hex
    path = f"{folder}/runs/{run}"
    for name, df in tables_.items():
        df.write.parquet(f"{path}/{name}")
    number = (log(spark, folder).agg(F.max("number")).first()[0] or 0) + 1
    entry = spark.createDataFrame([(number, run, sorted(tables_))], "number BIGINT, run STRING, tables ARRAY<STRING>")
    entry.withColumn("written", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return path


def newest(spark: SparkSession, folder: str) -> tuple[str, list[str]]:
    """Folder and tables of the newest finished run."""
    rows = log(spark, folder).orderBy(F.desc("number"), F.desc("run")).limit(1).collect()
    if not rows:
        raise FileNotFoundError(f"no finished run in {folder}")
    return f"{folder}/runs/{rows[0]['run']}", rows[0]["tables"]


def differences(found: T.StructType, wanted: T.StructType) -> list[str]:
    """Columns that are missing, unknown, or of another type."""
    a, b = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (found, wanted))
    return [f"{c}: {a.get(c, 'missing')} instead of {b.get(c, 'none')}" for c in [*b, *(x for x in a if x not in b)] if a.get(c) != b.get(c)]


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every table of the newest run, checked against its schema, with the report lines."""
    path, names = newest(spark, folder)
    wanted = {**schemas.ARTIFACTS, schemas.REPORT[0]: schemas.REPORT[1]}
    missing = sorted(set(wanted) - set(names))
    if missing:
        raise ValueError(f"tables missing in {path}: {', '.join(missing)}")
    out = {}
    for name, ddl in wanted.items():
        df = spark.read.parquet(f"{path}/{name}")
        wrong = differences(df.schema, _schema(ddl))
        if wrong:
            raise ValueError(f"{name} in {path}: {'; '.join(wrong)}")
        out[name] = df
    return out


def read_csvs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a folder of CSV exports, typed; list cells stay packed text, as ``tables.reload_corpus`` takes them."""
    return {name: tables.read_csv(spark, f"{folder}/{name}", ddl.replace("ARRAY<STRING>", "STRING")) for name, ddl in schemas.ARTIFACTS.items()}


def reload(stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the helper columns that browsing needs."""
    out = dict(stored)
    out["corpus_enriquecido"] = tables.reload_corpus(stored["corpus_enriquecido"])
    out["series_semanticas"] = tables.reload_series(stored["series_semanticas"])
    return out
