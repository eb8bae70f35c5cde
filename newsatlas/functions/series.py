"""Labels, keys and classes of a recurring series."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsatlas.functions import as_col
from newsatlas.functions.text import normalize_label

NAMED, BY_CRIME, OTHER = "Com operação nomeada", "Por crime", "Outras"
STRONG, MEDIUM, WEAK = "Forte", "Média", "Fraca"


def _head(values: Column, n: int) -> Column:
    return F.array_join(F.slice(values, 1, n), " | ")


def series_label(operations: Column | str, crimes: Column | str, titles: Column | str, modes: Column | str) -> Column:
    """First available: operations, crimes, a title, a cluster, a constant. Arrays are ranked."""
    ops, cri, tit, mod = (as_col(c) for c in (operations, crimes, titles, modes))
    return (
        F.when(F.size(ops) > 0, _head(ops, 3))
        .when(F.size(cri) > 0, F.concat(F.lit("serie_por_crime_"), _head(cri, 2)))
        .when(F.size(tit) > 0, F.left(F.try_element_at(tit, F.lit(1)), F.lit(90)))
        .when(F.size(mod) > 0, F.concat(F.lit("serie_cluster_"), F.try_element_at(mod, F.lit(1)).cast("string")))
        .otherwise(F.lit("serie_sem_nome"))
    )


def series_key(operations: Column | str, crimes: Column | str, label: Column | str) -> Column:
    ops, cri = as_col(operations), as_col(crimes)
    return (
        F.when(F.size(ops) > 0, F.concat(F.lit("operation::"), normalize_label(_head(ops, 5))))
        .when(F.size(cri) > 0, F.concat(F.lit("crime::"), normalize_label(_head(cri, 5))))
        .otherwise(F.concat(F.lit("label::"), normalize_label(label)))
    )


def display_label(label, first_date, last_date, mode, size, series_id) -> Column:
    """'label | years | cluster | n | id'; an unknown year shows as 0, an unknown cluster as '?'."""
    years = F.concat(
        F.coalesce(F.year(as_col(first_date)), F.lit(0)).cast("string"),
        F.lit("-"),
        F.coalesce(F.year(as_col(last_date)), F.lit(0)).cast("string"),
    )
    return F.concat_ws(
        " | ",
        as_col(label),
        years,
        F.concat(F.lit("c"), F.coalesce(F.nullif(as_col(mode).cast("string"), F.lit("")), F.lit("?"))),
        F.concat(F.lit("n="), as_col(size).cast("string")),
        F.concat(F.lit("id="), as_col(series_id).cast("string")),
    )


def first_mode(cluster_modes: Column | str) -> Column:
    return F.element_at(F.split(F.coalesce(as_col(cluster_modes), F.lit("")), r" \| "), 1)


def ui_label() -> Column:
    """Display label over the series columns; crime-keyed series show all their crimes."""
    crimes = F.coalesce(F.col("crime_modes"), F.lit(""))
    by_crime = F.col("series_group_key").startswith("crime::") & (F.trim(crimes) != "")
    base = F.when(F.coalesce(by_crime, F.lit(False)), F.concat(F.lit("serie_por_crime_"), F.trim(crimes))).otherwise(
        F.coalesce(F.col("series_label"), F.lit(""))
    )
    return display_label(
        base, "first_date", "last_date", first_mode("cluster_modes"),
        F.coalesce(F.col("size"), F.lit(0)), F.coalesce(F.col("semantic_series_id"), F.lit(0)),
    )


def series_type() -> Column:
    named = F.coalesce(F.trim(F.col("operation_names")), F.lit(""))
    return (
        F.when((named != "") & (F.lower(named) != "nan"), F.lit(NAMED))
        .when(F.col("series_group_key").startswith("crime::"), F.lit(BY_CRIME))
        .otherwise(F.lit(OTHER))
    )


def series_strength(size: Column | str = "size", years: Column | str = "active_years") -> Column:
    n, y = (F.coalesce(as_col(c), F.lit(0)) for c in (size, years))
    return (
        F.when((n >= 20) | (n * y >= 60) | ((n >= 10) & (y >= 4)), F.lit(STRONG))
        .when((n >= 5) | (y >= 3) | (n * y >= 15), F.lit(MEDIUM))
        .otherwise(F.lit(WEAK))
    )
