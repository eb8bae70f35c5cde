"""Importance resampling of documents towards a target text, drawn by a distributed radix sort.

Weights: features (runs of words) are hashed into buckets. Both texts are counted once, bucket by bucket; the floored
log ratio of their shares is the bucket's gain. The gains lie in one array, and a document's weight is the sum of the
entries that its features point at. Gumbel noise from a hash of the id turns the highest scores into a draw without
replacement.

Ranks: a least-significant-digit radix sort over the key (score descending, id ascending). A pass takes one digit. Rows
are cut into blocks of neighbouring places; every block counts its rows per digit; running sums of these counts, first
over lower digits, then over earlier blocks, give each block its first destination for each digit; inside a block rows
of the same digit keep their order. So every pass is stable, moves each row once, and holds no more than a block in a
place. Digits that are equal in all rows are left out.

Defined results: a null text has no words, so its weight is 0 and it isn't drawn; a null id is hashed like the empty
text and comes after all ids of the same score; rows that agree in score and id take neighbouring ranks in any order;
repeated rows count each; an empty target or an empty table leaves gains that only tell the sizes apart; ids must be
whole numbers; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsatlas.llm.frames import query, table
from newsatlas.llm.words import LOWER, Words, pieces, split, utf8
from newsatlas.session import cut, spread

BUCKETS = 10_000
LONGEST = 1
SEED = "2024"
MIN_WORDS = 20
PERCENT = 10
DIGIT = 12  # bits of a pass
BLOCK = 14  # bits of a place inside its block
#: Bytes of words are 0-9, a-z and all of U+0080 and above, after A-Z are lower case.
IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def cut_words(column: pa.Array) -> Words:
    data, offsets = utf8(column)
    data = LOWER[data]
    return split(data, offsets, IS_WORD[data])


def features(found: Words, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the text and the bucket of every run of so many words."""
    texts, ids = found.texts(), found.ids
    for size in range(1, longest + 1):
        n = max(0, len(ids) - size + 1)
        first = np.flatnonzero(texts[:n] == texts[size - 1 : size - 1 + n])
        if size == 1:
            names, at = found.names, ids
        else:
            joined = pc.binary_join_element_wise(*[found.names.take(pa.array(ids[first + k])) for k in range(size)], pa.scalar(b" ", found.names.type))
            coded = joined.dictionary_encode()
            names, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        bucket = np.fromiter((zlib.crc32(x) % buckets for x in names.to_pylist()), np.int64, len(names))
        yield texts[first], bucket[at] if len(names) else np.zeros(0, np.int64)


def histogram(docs: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """Features in each bucket, over all texts. The driver sees one row per bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for piece in pieces(batches, text):
            for _, bucket in features(cut_words(piece.column(text)), longest, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some), "n": pa.array(total[some])})

    counts = spread(docs.select(text)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the shares of each bucket in thousandths, one added to every count."""
    size, raw_all, target_all = len(raw), int(raw.sum()), int(target.sum())
    ratio = ((t + 1) * (raw_all + size) / ((s + 1) * (target_all + size)) for s, t in zip(raw.tolist(), target.tolist()))
    return np.array([floor(1000 * log(x)) for x in ratio], np.int64)


def noise(key: str, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """(key, n_features, weight, score, n_words) of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for piece in pieces(batches, text):
            found = cut_words(piece.column(text))
            count, weight = np.zeros(piece.num_rows, np.int64), np.zeros(piece.num_rows, np.int64)
            for owner, bucket in features(found, longest, len(gain)):
                bounds = np.searchsorted(owner, np.arange(piece.num_rows + 1))
                count += np.diff(bounds)
                weight += np.diff(np.r_[0, np.cumsum(gain[bucket])][bounds])
            columns = [piece.column(key), pa.array(count), pa.array(weight), pa.array(np.diff(found.bounds).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_features", "weight", "n_words"])

    kind = docs.schema[key].dataType.simpleString()
    out = spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, n_features long, weight long, n_words long")
    return out.withColumn("score", F.col("weight") + noise(key, seed))


def ordered(value: Column, descending: bool = False) -> Column:
    """A whole number as bits whose unsigned order is the wanted one."""
    bits = value.cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.bitwise_not(bits) if descending else bits


def varying(rows: DataFrame, names: list[str]) -> list[int]:
    """How many low bits of each column are not the same in all rows."""
    sums = [f(c).alias(f"{c}{i}") for c in names for i, f in enumerate((F.bit_and, F.bit_or))]
    found = rows.agg(*sums).first()
    return [((found[f"{c}0"] or 0) ^ (found[f"{c}1"] or 0)) % (1 << 64) for c in names]


def counting_pass(rows: DataFrame, digit: Column) -> DataFrame:
    """Rows in the stable order of one digit: ``__at`` becomes the place 0, 1, ... of each row."""
    marked = rows.withColumn("__digit", digit).withColumn("__block", F.shiftright("__at", BLOCK))
    counts = marked.groupBy("__digit", "__block").agg(F.count(F.lit(1)).alias("__n"))
    lower = counts.groupBy("__digit").agg(F.sum("__n").alias("__all"))
    lower = lower.select("__digit", (F.sum("__all").over(Window.orderBy("__digit")) - F.col("__all")).alias("__lower"))  # a row per digit value
    earlier = F.sum("__n").over(Window.partitionBy("__digit").orderBy("__block")) - F.col("__n")
    offsets = counts.withColumn("__earlier", earlier).join(F.broadcast(lower), "__digit").select("__digit", "__block", (F.col("__lower") + F.col("__earlier")).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__digit", "__block").orderBy("__at")) - 1
    placed = marked.withColumn("__inside", inside).join(offsets, ["__digit", "__block"])
    return placed.withColumn("__at", F.col("__offset") + F.col("__inside")).select(*rows.columns)


def radix_places(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows with ``__place``: 0, 1, ... in the order of the keys, the first of which weighs most."""
    names = [f"__key{i}" for i in range(len(keys))]
    state = cut(rows.withColumns(dict(zip(names, keys))).withColumn("__at", F.monotonically_increasing_id()))
    numbered = False
    for name, bits in reversed(list(zip(names, varying(state, names)))):
        for low in range(0, bits.bit_length(), DIGIT):
            if (bits >> low) % (1 << DIGIT):
                digit = F.shiftrightunsigned(name, low).bitwiseAND(F.lit((1 << DIGIT) - 1))
                state, numbered = cut(counting_pass(state, digit)), True
    if not numbered:  # all keys are equal
        state = counting_pass(state, F.lit(0).cast("long"))
    return state.withColumnRenamed("__at", "__place").drop(*names)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text",
    target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED,
) -> DataFrame:
    """(key, n_features, weight, score, rank): rank is 1, 2, ... for the drawn documents, else null."""
    gain = gains(histogram(docs, text, longest, buckets), histogram(target, target_text, longest, buckets))
    rows = cut(scored(docs, gain, key, text, longest, seed))
    able = rows.where(F.col("n_words") >= min_words)
    draws = able.count() * percent // 100
    keys = [ordered(F.col("score"), True), F.col(key).isNull().cast("long"), ordered(F.coalesce(F.col(key), F.lit(0)))]
    placed = radix_places(able, keys).withColumn("rank", F.when(F.col("__place") < draws, F.col("__place") + 1))
    rest = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    columns = [key, "n_features", "weight", "score", "rank"]
    return placed.select(columns).unionByName(rest.select(columns))


@query("op11_resampling")
def op11(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
