"""Publication dates and day gaps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsatlas.functions import as_col
from newsatlas.functions.text import clean_text, strip

# How the pages write their dates.
BYLINE = r"(?iU)publicado\s+(\d{2}/\d{2}/\d{4})\s+(\d{2}h\d{2})\s+(\S+)"
ARTICLE_DATES = r"(?iU)Publicado em\s+(\d{2}/\d{2}/\d{4}\s+\d{2}h\d{2})(?:\s+Atualizado em\s+(\d{2}/\d{2}/\d{4}\s+\d{2}h\d{2}))?"


def parse_datetime(value: Column | str) -> Column:
    """'dd/mm/yyyy HHhMM' to a timestamp; anything else is null."""
    return F.try_to_timestamp(F.nullif(strip(value), F.lit("")), F.lit("d/M/yyyy H'h'm"))


def year_month(ts: Column | str) -> Column:
    """'yyyy-MM', with the text 'NaT' standing for an unknown date."""
    return F.coalesce(F.date_format(as_col(ts), "yyyy-MM"), F.lit("NaT"))


def gap_days(source: Column | str, target: Column | str) -> Column:
    """Days from source to target: floored first, then made positive."""
    delta = F.unix_timestamp(as_col(target)) - F.unix_timestamp(as_col(source))
    return F.abs(F.floor(delta / F.lit(86400))).cast("int")


def span_days(first: Column | str, last: Column | str) -> Column:
    return F.floor((F.unix_timestamp(as_col(last)) - F.unix_timestamp(as_col(first))) / F.lit(86400)).cast("int")


def parse_byline(value: Column | str) -> Column:
    """Listing byline as struct(publicado_em, data_publicacao, hora_publicacao)."""
    text = clean_text(value)
    hit = text.rlike(BYLINE)
    date, time = F.regexp_extract(text, BYLINE, 1), F.regexp_extract(text, BYLINE, 2)
    return F.struct(
        F.when(hit, F.concat_ws(" ", date, time)).otherwise(text).alias("publicado_em"),
        F.when(hit, date).alias("data_publicacao"),
        F.when(hit, time).alias("hora_publicacao"),
    )


def content_type(value: Column | str) -> Column:
    """Last word of the byline."""
    return F.element_at(F.split(clean_text(value), " "), -1)


def parse_article_dates(value: Column | str) -> Column:
    """Article header as struct(published_at, updated_at)."""
    text = clean_text(value)
    part = lambda group: F.nullif(F.regexp_extract(text, ARTICLE_DATES, group), F.lit(""))
    return F.struct(part(1).alias("published_at"), part(2).alias("updated_at"))
