"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger holds the measurements and one bit per rule (1: failed).
Policies are versioned masks over these bits, so a changed policy, or the question what a rule alone costs, needs
no second look at any text.

Defined results: null or empty text has no words and fails ``few_words``; repeated rows are judged alike; an empty
table gives an empty ledger; input columns named like an output column give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsatlas.llm.frames import arrow_map, query, table, without
from newsatlas.llm.words import per_text, repeated, runs, slices, split, utf8, windows

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals"]

#: Bit i belongs to rule i. New rules go to the end, so that stored ledgers stay readable.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines",
    "capitals": "n_letters >= 20 AND 100 * n_capitals > 50 * n_letters",
    "short_words": "10 * word_chars < 15 * n_words",
    "long_words": "word_chars > 25 * n_words",
}
#: Version of a policy: the rules whose failure rejects a document.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "2": ["few_words", "repeated_windows", "symbols", "duplicate_lines", "capitals", "short_words", "long_words"],
}
CURRENT = "2"


def _measures(column: pa.Array) -> list[np.ndarray]:
    data, offsets = utf8(column)
    found = split(data, offsets)
    bounds = found.bounds
    n_words = np.diff(bounds)

    def mark(values: bytes | range) -> np.ndarray:
        return np.isin(np.arange(256), list(values))[data]

    starts_char = (data & 0xC0) != 0x80
    inside = ~mark(range(9, 14)) & (data != 32)
    first, hashes = windows(found.hashes(), bounds, WINDOW)
    again = first[repeated(hashes, found.texts()[first])]
    cover = np.zeros(len(found.ids) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)

    breaks = data == 10
    begin, end = runs(~breaks, offsets)  # an empty line has no word
    lines = slices(data, ~breaks, end - begin).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    word_at = np.flatnonzero(runs_begin(inside, offsets))
    worded = np.searchsorted(word_at, begin) < np.searchsorted(word_at, end)
    line_text = np.searchsorted(offsets, begin, "right") - 1
    lines, line_text = lines[worded], line_text[worded]
    twice = repeated(lines, line_text, "first")
    count = len(column)
    capitals, small = mark(range(65, 91)), mark(range(97, 123))
    return [
        n_words, per_text(inside & starts_char, offsets), per_text(mark(SYMBOLS), offsets), np.bincount(line_text, minlength=count),
        np.bincount(line_text[twice], minlength=count), per_text(np.cumsum(cover)[:-1] > 0, bounds), per_text(capitals | small, offsets), per_text(capitals, offsets),
    ]


def runs_begin(inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    marks = np.zeros(len(inside), bool)
    marks[runs(inside, offsets)[0]] = True
    return marks


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and the measurements of ``text``, in one pass and without a shuffle."""
    docs = without(docs, *MEASURES)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, T.LongType()) for name in MEASURES]])

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = [pa.array(x.astype(np.int64)) for x in _measures(piece.column(text))]
        return pa.RecordBatch.from_arrays([*piece.columns, *found], names=[*piece.schema.names, *MEASURES])

    return arrow_map(docs, work, schema, text)


def failed_bits() -> Column:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def mask(policy: str) -> int:
    return sum(1 << i for i, name in enumerate(RULES) if name in POLICIES[policy])


def ledger(docs: DataFrame, text: str = "text", into: str = "failed") -> DataFrame:
    """All columns, the measurements, and the failure bits of every rule in ``into``."""
    return measure(without(docs, into), text).withColumn(into, failed_bits())


def passes(policy: str = CURRENT, bits: str = "failed") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def kept(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns and nothing else."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    judged = ledger(own, names[docs.columns.index(text)], "failed").where(passes(policy))
    return judged.select(*names).toDF(*docs.columns)


def ablations(entries: DataFrame, policy: str = CURRENT, bits: str = "failed") -> DataFrame:
    """(rule, failed, only_this): documents that fail the rule, and those that the policy would keep without it.

    Counts each bit pattern first, of which there are few; what follows reads only these.
    """
    patterns = entries.select(F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("rule")) for i, name in enumerate(RULES)]))
    bit = F.expr("shiftleft(1L, r.i)")
    return patterns.select("p", "n", rules.alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(F.col("p").bitwiseAND(bit) != 0, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("p") == bit, F.col("n"))), F.lit(0)).alias("only_this"),
    )


@query("op3_quality_rules")
def op3(spark, sf_dir):
    entries = ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), passes().alias("kept"), "failed", "n_lines", "n_letters", "n_capitals",
    )
