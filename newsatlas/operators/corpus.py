"""Enriched corpus: joins, derived columns, row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsatlas.functions import gazetteer as geo, lexicon
from newsatlas.functions.dates import parse_datetime, year_month
from newsatlas.functions.labels import keyword_labels, operation_name
from newsatlas.functions.text import contains_pattern, fold, strip, strip_markdown
from newsatlas.operators.keys import require_unique


def join_corpus(index: DataFrame, manifest: DataFrame, require_rows: bool = False) -> DataFrame:
    """Index joined one-to-one with the manifest on link; a repeated link fails the job."""
    joined = require_unique(index, "link").join(require_unique(manifest, "link"), "link")
    if require_rows and joined.isEmpty():
        raise ValueError("no article with status 'ok' and a body is available")
    return joined


def with_text(df: DataFrame) -> DataFrame:
    """Clean, search, folded, geography-free and weighted texts."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    search = strip(
        F.concat_ws(" ", blank("titulo"), blank("subtitulo"), F.replace(blank("tags"), F.lit("|"), F.lit(" ")), blank("texto_limpo"))
    )
    title, sub = F.concat(blank("titulo"), F.lit(" ")), F.concat(blank("subtitulo"), F.lit(" "))
    return (
        df.withColumn("texto_limpo", strip_markdown("markdown_text"))
        .withColumn("texto_busca", search)
        .withColumn("texto_busca_normalizado", fold("texto_busca"))
        .withColumn("texto_sem_geo", geo.without_geography("texto_busca"))
        .withColumn("texto_ponderado", strip(F.concat(F.repeat(title, F.lit(3)), F.repeat(sub, F.lit(2)), F.col("texto_sem_geo"))))
    )


def with_dates(df: DataFrame, stamp: str = "data_publicacao_dt") -> DataFrame:
    return df.withColumns(
        {
            "data_publicacao_dt": F.col(stamp),
            "ano": F.year(stamp),
            "mes": F.month(stamp),
            "ano_mes": year_month(stamp),
        }
    )


def parse_dates(df: DataFrame, raw: str = "publicado_em_extraido") -> DataFrame:
    return with_dates(df.withColumn("data_publicacao_dt", parse_datetime(raw)))


def with_labels(df: DataFrame, crimes: dict = lexicon.CRIMES, modus: dict = lexicon.MODUS) -> DataFrame:
    return df.withColumns(
        {
            "nome_operacao": operation_name("titulo"),
            "crime_labels": keyword_labels("texto_busca_normalizado", crimes),
            "modus_labels": keyword_labels("texto_busca_normalizado", modus),
        }
    )


def with_states(df: DataFrame) -> DataFrame:
    sources = df.withColumn("__m", geo.mention_sources("titulo", "subtitulo", "tags", "markdown_text"))
    mentions = sources.withColumn("ufs_mencionadas", geo.state_mentions("__m")).drop("__m")
    return mentions.withColumn("estados_mencionados", geo.state_names("ufs_mencionadas"))


def enrich(df: DataFrame, crimes: dict = lexicon.CRIMES, modus: dict = lexicon.MODUS) -> DataFrame:
    """All derived columns in one pass over the rows, without a shuffle."""
    return with_states(with_labels(with_text(df), crimes, modus))


# Row filters -----------------------------------------------------------------------------------

def by_uf(df: DataFrame, uf: str, column: str = "ufs_mencionadas") -> DataFrame:
    return df if uf == geo.ALL else df.where(F.array_contains(column, uf))


def by_state(df: DataFrame, state: str, column: str = "ufs_mencionadas") -> DataFrame:
    """Rows that mention the state; an unknown name selects nothing."""
    if state == geo.ALL:
        return df
    uf = next((u for u, name in geo.STATE_OF.items() if name == state), None)
    return df.where(F.lit(False)) if uf is None else by_uf(df, uf, column)


def by_label(df: DataFrame, column: str, label: str) -> DataFrame:
    return df.where(F.array_contains(column, label))


def by_pattern(df: DataFrame, pattern: str, *columns: str) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | contains_pattern(c, pattern)
    return df.where(hit)


def of_cluster(df: DataFrame, cluster_id: int) -> DataFrame:
    """Articles of one cluster, newest first."""
    return df.where(F.col("cluster_id") == cluster_id).orderBy(F.col("data_publicacao_dt").desc_nulls_last(), "link")


def of_series(df: DataFrame, series_id: int) -> DataFrame:
    """Articles of one series, oldest first."""
    return df.where(F.col("semantic_series_id") == series_id).orderBy(F.col("data_publicacao_dt").asc_nulls_last(), "link")
