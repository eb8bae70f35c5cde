"""Links, slugs, file names and packed tags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsatlas.functions import as_col
from newsatlas.functions.text import clean_text, strip


def normalize_link(value: Column | str) -> Column:
    return F.nullif(strip(value), F.lit(""))


def slug(url: Column | str) -> Column:
    """Last path segment in lower case; a digest of the link when there is none."""
    link = as_col(url)
    path = F.regexp_extract(link, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    name = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    name = F.lower(F.btrim(F.regexp_replace(name, "[^a-zA-Z0-9_-]+", "-"), F.lit("-")))
    return F.when(name != "", name).otherwise(F.concat(F.lit("noticia-"), F.left(F.md5(link), F.lit(10))))


def file_name(url: Column | str) -> Column:
    return F.concat(slug(url), F.lit("-"), F.left(F.md5(as_col(url)), F.lit(8)), F.lit(".md"))


def resolve_path(path: Column | str, folder: str, url: Column | str) -> Column:
    """The recorded path, or the generated one when none is recorded."""
    return F.coalesce(F.nullif(strip(path), F.lit("")), F.concat(F.lit(folder.rstrip("/") + "/"), file_name(url)))


def page_number(offset: Column | str, step: int = 60) -> Column:
    return (F.floor(as_col(offset) / F.lit(step)) + 1).cast("int")


def keep_tags(tags: Column | str) -> Column:
    return F.array_compact(F.transform(as_col(tags), clean_text))
