"""Whitespace, folding, markdown and label normalisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, functions as F

from newsatlas.functions import as_col

# White space as Unicode text processing sees it, control separators included.
WS = r"[\s\x1c-\x1f]"


def strip(value: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(as_col(value), rf"(?U)\A{WS}+|{WS}+\z", "")


def collapse(value: Column | str) -> Column:
    # Most white space is one blank, which stays as it is.
    return F.trim(F.regexp_replace(as_col(value), rf"(?U)(?: {WS}|[\s\x1c-\x1f&&[^ ]]){WS}*", " "))


def clean_text(value: Column | str) -> Column:
    """Collapse white space; blank becomes null."""
    return F.nullif(collapse(value), F.lit(""))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str], str]:
    """Characters whose compatibility form has ASCII letters: one-to-one, and longer.

    The last item finds the longer ones: ranges, tried on characters beyond ASCII only.
    """
    source, target, longer, spans = [], [], {}, []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(chr(code))
            target.append(plain)
        elif plain:
            longer[chr(code)] = plain
            if spans and spans[-1][1] == code - 1:
                spans[-1][1] = code
            else:
                spans.append([code, code])
    ranges = "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in spans)
    return "".join(source), "".join(target), longer, rf"(?=[^\x00-\x7F])[{ranges}]"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often the expression names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(value: Column | str) -> Column:
    """Lower-case ASCII form: accents removed, other characters dropped."""
    source, target, longer, finder = _fold_tables()
    pairs = "\x02".join(f"{k}\x01{v}" for k, v in longer.items())
    table = F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x01"))
    plain = lambda t: F.octet_length(t) == F.length(t)
    ascii_only = lambda t: F.regexp_replace(t, r"[^\x00-\x7F]+", "")

    def other(text: Column) -> Column:
        spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
        return F.when(plain(text), text).when(text.rlike(finder), ascii_only(spelled)).otherwise(ascii_only(text))

    folded = lambda t: _once(F.translate(F.replace(t, F.lit("…"), F.lit("...")), source, target), other)
    return F.lower(_once(as_col(value), lambda t: F.when(plain(t), t).otherwise(folded(t))))


def strip_markdown(value: Column | str) -> Column:
    text = F.regexp_replace(as_col(value), r"(?s)`{1,3}.*?`{1,3}", " ")
    text = F.regexp_replace(text, r"(?d)\[(.*?)\]\((.*?)\)", "$1")
    text = F.regexp_replace(text, r"[*_>#-]+", " ")
    return collapse(text)


def normalize_label(value: Column | str) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(as_col(value)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(slug == "", F.lit("sem_rotulo")).otherwise(slug)


def pretty_label(value: Column | str) -> Column:
    return F.initcap(F.replace(as_col(value), F.lit("_"), F.lit(" ")))


def html_escape(value: Column | str) -> Column:
    text = as_col(value)
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def excerpt(value: Column | str, limit: int = 6000) -> Column:
    """The opening shown beside an article; the message stands in for a missing body."""
    text = as_col(value)
    return F.when(text.isNull(), F.lit("Conteúdo markdown não encontrado.")).otherwise(
        F.concat(F.left(text, F.lit(limit)), F.when(F.length(text) > limit, F.lit("...")).otherwise(F.lit("")))
    )


QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""


def unpack_list(value: Column | str) -> Column:
    """Cell holding a quoted list or a '|'-separated list, as an array.

    Items of a quoted list stand in single or double quotes, and each sign may occur inside the other.
    """
    text = strip(value)
    piped = F.filter(F.transform(F.split(text, r"\|"), strip), lambda part: part != "")
    items = F.regexp_extract_all(text, F.lit(QUOTED), 0)
    inside = F.transform(items, lambda item: F.regexp_replace(F.substring(item, F.lit(2), F.length(item) - 2), r"\\(.)", "$1"))
    empty = text.rlike(r"(?s)\A\[\s*\]\z")
    listed = F.when(text.rlike(r"(?s)\A\[.*\]\z") & (empty | (F.size(items) > 0)), inside).otherwise(piped)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(listed)


def pack_list(value: Column | str, separator: str = " | ") -> Column:
    return F.array_join(as_col(value), separator)


def contains_pattern(value: Column | str, pattern: str) -> Column:
    """Case-insensitive regular expression; a pattern that the JVM does not accept is taken literally."""
    text = as_col(value)
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile("(?iu)" + pattern)
        hit = text.rlike("(?iu)" + pattern)
    except IllegalArgumentException:
        hit = F.contains(F.lower(text), F.lower(F.lit(pattern)))
    return F.coalesce(hit, F.lit(False))
