"""Registration, the shape of results, and stage tables shared by queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsatlas.session import cut, prepare

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_STAGES: dict[tuple[str, str, str], object] = {}


def plain(df: DataFrame) -> DataFrame:
    """Result columns in types both engines print alike."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"registered twice: {name}")
        _QUERIES[name] = lambda spark, sf_dir: plain(fn(prepare(spark), sf_dir))
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def stage(name: str, write: Callable = cut) -> Callable[[Query], Query]:
    """A table that several queries read: written out once per application and input folder.

    ``write`` None: the function writes its result itself and returns what reads it.
    """

    def wrap(fn: Query) -> Query:
        def read(spark: SparkSession, sf_dir: str):
            key = (spark.sparkContext.applicationId, sf_dir, name)
            if key not in _STAGES:
                made = fn(spark, sf_dir)
                _STAGES[key] = made if write is None else write(made)
            return _STAGES[key]

        return read

    return wrap


def forget_stages() -> None:
    """Make the next query compute its stage tables again (used when timing)."""
    _STAGES.clear()


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
