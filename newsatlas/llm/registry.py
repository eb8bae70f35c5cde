"""All registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from newsatlas.llm import (  # noqa: F401
    collocations, decontaminate, html_text, jaccard_join, language, line_templates, mixing, quality, resampling, scoring, sharding, token_files, warc,
)
from newsatlas.llm.frames import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
