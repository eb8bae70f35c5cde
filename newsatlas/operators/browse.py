"""Series catalog and the lookups behind the browsing screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsatlas.functions.series import BY_CRIME, NAMED, STRONG, series_strength, series_type
from newsatlas.functions.text import excerpt
from newsatlas.operators.corpus import by_pattern
from newsatlas.operators.neighbours import pairs_of

STRENGTH, SIZE, SPAN, LATEST = "Força", "Tamanho", "Amplitude temporal", "Mais recente"


def series_catalog(series: DataFrame) -> DataFrame:
    """Series with type, strength score and band, first and last year."""
    return series.withColumns(
        {
            "series_type": series_type(),
            "strength_score": (F.coalesce("size", F.lit(0)) * F.coalesce("active_years", F.lit(0))).cast("long"),
            "strength_band": series_strength(),
            "start_year": F.year("first_date"),
            "end_year": F.year("last_date"),
        }
    )


def sort_keys(mode: str) -> list:
    """Ascending sort keys of a ranking; unknown dates come last, ties go to the smaller id."""
    down = lambda c: -F.col(c)
    first, last = (F.unix_timestamp(c) for c in ("first_date", "last_date"))
    late = F.lit(2**62)
    orders = {
        STRENGTH: [down("strength_score"), down("size"), down("active_years")],
        SIZE: [down("size"), down("active_years"), F.coalesce(first, late)],
        SPAN: [down("active_years"), down("size"), F.coalesce(first, late)],
    }
    return orders.get(mode, [F.coalesce(-last, late), down("size")]) + [F.col("semantic_series_id")]


def sort_catalog(catalog: DataFrame, mode: str = STRENGTH) -> DataFrame:
    return catalog.orderBy(*sort_keys(mode))


def series_metrics(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("series_type") == NAMED).alias("nomeadas"),
        F.count_if(F.col("series_type") == BY_CRIME).alias("por_crime"),
        F.count_if(F.col("strength_band") == STRONG).alias("fortes"),
    )


def browse_series(catalog: DataFrame, kind: str = "Todas", min_size: int = 3, search: str = "", mode: str = STRENGTH) -> DataFrame:
    rows = catalog.where(F.col("size") >= min_size)
    if kind != "Todas":
        rows = rows.where(F.col("series_type") == kind)
    if search.strip():
        rows = by_pattern(rows, search.strip(), "series_ui_label", "crime_modes", "operation_names")
    return sort_catalog(rows, mode)


def executive_series(catalog: DataFrame, k: int = 15, min_size: int = 5) -> DataFrame:
    """The strongest series of some size; all sizes when none is large enough."""
    largest = catalog.agg(F.max("size")).scalar()
    rows = catalog.where((F.col("size") >= min_size) | (F.coalesce(largest, F.lit(0)) < min_size))
    return sort_catalog(rows, STRENGTH).limit(k)


def neighbours_of(corpus: DataFrame, pairs: DataFrame, pattern: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """First article whose title matches, with its opening; and its best pairs."""
    article = by_pattern(corpus, pattern, "titulo").orderBy("link").limit(1).withColumn("trecho", excerpt("markdown_text"))
    found = article.select("link").first()
    return article, pairs_of(pairs, found["link"], k) if found else pairs.limit(0)
