"""Rule labels and operation names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from newsatlas.functions import as_col
from newsatlas.functions.lexicon import OPERATION_PHASE_WORDS, OPERATION_STOP_WORDS
from newsatlas.functions.text import fold

INLINE = 300  # keywords that are looked for one by one


def keyword_labels(folded: Column | str, rules: dict[str, list[str]], inline: int = INLINE) -> Column:
    """Labels, in rule order, with any keyword inside the folded text.

    The rules become one projection: no join with the lexicon, so no row is multiplied. Up to ``inline`` keywords are
    looked for one by one in the JVM; larger lexicons become an automaton that reads each text once, whatever their size.
    """
    text = as_col(folded)
    if sum(map(len, rules.values())) > inline:
        return automaton_labels(rules)(text)
    picks = []
    for label, keywords in rules.items():
        hit = F.contains(text, F.lit(keywords[0]))
        for keyword in keywords[1:]:
            hit = hit | F.contains(text, F.lit(keyword))
        picks.append(F.when(hit, F.lit(label)))
    return F.coalesce(F.array_compact(F.array(*picks)), F.array().cast("array<string>"))


def automaton(rules: dict[str, list[str]]):
    """Aho-Corasick automaton over all keywords; a match gives the places of its labels."""
    import ahocorasick

    places: dict[str, list[int]] = {}
    for i, keywords in enumerate(rules.values()):
        for keyword in keywords:
            places.setdefault(keyword, []).append(i)
    out = ahocorasick.Automaton()
    for keyword, labels in places.items():
        if keyword:
            out.add_word(keyword, labels)
    if len(out):
        out.make_automaton()
    return out, places.get("", [])


def automaton_labels(rules: dict[str, list[str]]):
    """The labels of a text from one walk over it, in batches of rows."""
    names = list(rules)

    @F.pandas_udf("array<string>")
    def labels(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found, always = automaton(rules)  # once per task

        def of(text: str | None) -> list[str]:
            if text is None:
                return []
            hits = set(always)
            for _, places in found.iter(text) if len(found) else ():
                hits.update(places)
            return [names[i] for i in sorted(hits)]

        for batch in batches:
            yield batch.map(of)

    return labels


def operation_name(title: Column | str) -> Column:
    """Up to three words after 'operacao', ended by a stop word or a phase word."""
    tail = F.regexp_extract(fold(F.coalesce(as_col(title), F.lit(""))), r"operacao[\s\x1c-\x1f]+([a-z0-9\s\x1c-\x1f-]{2,60})", 1)
    words = F.filter(F.split(tail, r"[\s\x1c-\x1f]+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("done"))

    def step(acc: Column, word: Column) -> Column:
        held = F.size(acc["kept"])
        stop = acc["done"] | (held >= 3) | ((held > 0) & word.isin(OPERATION_STOP_WORDS + OPERATION_PHASE_WORDS))
        bare = F.btrim(word, F.lit("-"))
        kept = F.when(stop | (bare == ""), acc["kept"]).otherwise(F.array_append(acc["kept"], bare))
        return F.struct(kept.alias("kept"), stop.alias("done"))

    kept = F.aggregate(words, start, step, lambda acc: acc["kept"])
    first = F.try_element_at(words, F.lit(1))
    named = first.isNotNull() & ~first.isin(OPERATION_STOP_WORDS) & (F.size(kept) > 0)
    return F.when(named, F.initcap(F.array_join(kept, " ")))
