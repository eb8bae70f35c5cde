"""Phrases whose words keep together, mined by partitions (SON) and counted exactly.

First part: documents are dealt into ``SHARDS`` shards by the hash of their id. A phrase that occurs ``MIN_COUNT`` times
in a language occurs at least ``MIN_COUNT / SHARDS`` times in one of its shards, whatever their sizes. So each shard is
mined completely at that support, length by length: a run of words is only counted if its first and its last words are
frequent in the same shard. Tasks know those from a bit table of hashes, whose false hits cost counting and nothing
else. A shard is mined by all tasks that hold documents of it; no task needs all of a shard.

Second part: the phrases that are frequent in any shard form one bit table, and one pass over all texts counts these
phrases, spelled out, in all shards. Only these exact counts decide.

Cohesion: a phrase is cut in two in every way; the least cohesive cut gives its score. Phrases that mostly occur inside
a longer one give way to it.

Defined results: a null or empty text has no words; a null language is ``und``; repeated rows count each; phrases of
equal score and count are ordered by their bytes; an empty table has no phrases; other input columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from newsatlas.llm.frames import query, table
from newsatlas.llm.words import LOWER, ODD, mixed, pieces, runs, slices, utf8
from newsatlas.operators.keys import top_per_key
from newsatlas.session import cut, spread

LONGEST = 4
MIN_COUNT = 30
SHARDS = 6
SCALE = 2_000_000
INSIDE_PERCENT = 80
TOP = 2000
UNKNOWN = "und"
PIECE = 8 << 20
BITS_PER_PHRASE = 16
LEAST_BITS, MOST_BITS = 20, 29  # of a bit table: 128 KB to 64 MB, more phrases only make it less selective
BUCKET_BITS = 15  # of a bitmap of Spark
PLACES = 4096  # of bytes in a word that weigh differently in its hash
BYTES, POWERS = (np.random.default_rng(seed).integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed, n in ((1, 256), (2, PLACES)))
#: Bytes that end a piece, and bytes that part words inside it.
BREAKS = np.isin(np.arange(256), list(b".,;:!?") + [10, 11, 12, 13])
BLANKS = np.isin(np.arange(256), [9, 32])


class Runs:
    """Words of a batch of texts, their hashes, and the number of the piece each stands in.

    A hash is a sum over the bytes of a word, weighed by their places (modulo ``PLACES``), so no word is looked at alone.
    """

    def __init__(self, column: pa.Array, langs: list[str]):
        data, offsets = utf8(column)
        data = LOWER[data]
        inside = ~(BREAKS | BLANKS)[data]
        starts, ends = runs(inside, offsets)
        self.lengths = ends - starts
        self.bytes = data[inside]
        self.bounds = np.searchsorted(starts, offsets)
        self.text = np.repeat(np.arange(len(column)), np.diff(self.bounds))
        self.piece = np.searchsorted(np.flatnonzero(BREAKS[data]), starts) + self.text  # both only grow, so equal sums are equal pairs
        self.lang = np.array([xxhash.xxh64_intdigest(x) for x in langs], np.uint64)[self.text] if len(langs) else np.zeros(0, np.uint64)
        first = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(self.bytes), dtype=np.int32) - np.repeat(first.astype(np.int32), self.lengths)
        self.hash = mixed(np.add.reduceat(BYTES[self.bytes] * POWERS[place & (PLACES - 1)], first)) if len(first) else np.zeros(0, np.uint64)

    def spelled(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words, and which of them each word is."""
        coded = slices(self.bytes, np.ones(len(self.bytes), bool), self.lengths).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: at which words a phrase of it begins, and the hash of the phrase in its language."""
        total = self.hash
        for size in range(1, longest + 1):
            if size > 1:
                total = total[:-1] * ODD + self.hash[size - 1 :] if len(total) else total
            n = len(total)
            yield size, self.piece[:n] == self.piece[size - 1 : size - 1 + n], mixed(total ^ self.lang[:n])


def has(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bits of the keys are set."""
    at = keys & np.uint64(len(table) * 8 - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def follows(fits: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places where a phrase fits whose first and last words are known phrases."""
    n = len(fits)
    return fits & known[:n] & known[1 : n + 1]


def bit_table(keys: DataFrame) -> Broadcast:
    """One bit for each key (column ``key``), in at most 64 MB; a larger set has more false hits, no other effect."""
    sc = keys.sparkSession.sparkContext
    bits = min(MOST_BITS, max(LEAST_BITS, (keys.count() * BITS_PER_PHRASE).bit_length()))
    at = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    bitmap = F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)))
    out = np.zeros(1 << bits - 3, np.uint8)
    width = 1 << BUCKET_BITS - 3
    for number, part in keys.groupBy(F.shiftright(at, BUCKET_BITS).alias("b")).agg(bitmap).collect():
        out[number * width : (number + 1) * width] = np.frombuffer(part, np.uint8)
    return sc.broadcast(out)


def _langs(batch: pa.RecordBatch) -> list[str]:
    return [UNKNOWN if x is None else x for x in batch.column("lang").to_pylist()]


def locally(docs: DataFrame, size: int, known: Broadcast | None, support: int, salts: np.ndarray) -> DataFrame:
    """(shard, phrase): hashes of phrases of one length that are frequent in a shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            cut_up = Runs(piece.column("text"), _langs(piece))
            shard = piece.column("shard").to_numpy()[cut_up.text] if len(cut_up.text) else np.zeros(0, np.int32)
            before = None
            for length, fits, hashes in cut_up.phrases(size):
                if length == size:
                    at = np.flatnonzero(fits if before is None else follows(fits, before))
                elif length == size - 1:
                    before = has(known.value, hashes ^ salts[shard[: len(hashes)]])
            codes, own = pd.factorize(hashes[at] ^ salts[shard[at]])
            first = np.empty(len(own), np.int64)
            first[codes[::-1]] = at[::-1]
            columns = [pa.array(shard[first].astype(np.int32)), pa.array(hashes[first].view(np.int64)), pa.array(np.bincount(codes, minlength=len(own)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "phrase", "n"])

    counts = docs.mapInArrow(run, "shard int, phrase long, n long").groupBy("phrase", "shard").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= support).select("shard", "phrase")


def mined(docs: DataFrame, longest: int, support: int, shards: int) -> DataFrame:
    """(key): hashes of the phrases of 1 to ``longest`` words that are frequent in any shard."""
    known, levels = None, []
    salts = np.array([xxhash.xxh64_intdigest(str(s)) for s in range(shards)], np.uint64)
    salt = F.element_at(F.array(*[F.lit(s) for s in salts.view(np.int64).tolist()]), F.col("shard") + 1)
    for size in range(1, longest + 1):
        found = cut(locally(docs, size, known, support, salts))
        levels.append(found)
        if size < longest:
            known = bit_table(found.select(F.col("phrase").bitwiseXOR(salt).alias("key")))
    union = levels[0]
    for found in levels[1:]:
        union = union.unionByName(found)
    return cut(union.select(F.col("phrase").alias("key")).distinct())


def counted(docs: DataFrame, candidates: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, words, f): exact counts of the candidates; phrase null: all words of the language."""
    known = bit_table(candidates)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            langs = _langs(piece)
            cut_up = Runs(piece.column("text"), langs)
            names, ids = cut_up.spelled()
            seen = pa.array(langs, pa.string())
            sizes = pd.Series(np.diff(cut_up.bounds)).groupby(langs).sum()
            yield _rows(pa.array(sizes.index, pa.string()), pa.nulls(len(sizes), pa.string()), 0, sizes.to_numpy(np.int64))
            before = None
            for size, fits, hashes in cut_up.phrases(longest):
                ok = (fits if before is None else follows(fits, before)) & has(known.value, hashes)
                before = ok
                at = np.flatnonzero(ok)
                # equal hashes are counted as one only if their words are equal: the first of each is compared with all
                codes, first = _distinct(at, hashes[at], cut_up.lang[at], ids, size)
                if len(first):
                    words = [names.take(pa.array(ids[first + k])) for k in range(size)]
                    phrase = words[0] if size == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", names.type))
                    yield _rows(seen.take(pa.array(cut_up.text[first])), phrase.cast(pa.large_string()).cast(pa.string()), size, np.bincount(codes, minlength=len(first)))

    rows = docs.mapInArrow(run, "lang string, phrase string, words int, f long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def _distinct(at: np.ndarray, hashes: np.ndarray, langs: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the phrase of each place and the first place of each phrase; phrases are equal if language and words are."""
    codes, uniques = pd.factorize(hashes)
    first = np.full(len(uniques), -1, np.int64)
    first[codes[::-1]] = at[::-1]
    same = np.ones(len(at), bool)
    for k in range(size):
        same &= ids[at + k] == ids[first[codes] + k]
    if same.all():
        return codes, first
    exact = pd.DataFrame({"l": langs} | {f"w{k}": ids[at + k] for k in range(size)})
    codes = exact.groupby(list(exact.columns), sort=False).ngroup().to_numpy()
    first = np.full(codes.max() + 1, -1, np.int64)
    first[codes[::-1]] = at[::-1]
    return codes, first


def _rows(lang: pa.Array, phrase: pa.Array, words: int, f: np.ndarray) -> pa.RecordBatch:
    columns = [lang, phrase, pa.array(np.full(len(lang), words, np.int32)), pa.array(f.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "f"])


def cohesion(a: Column, first: Column, rest: Column, scale: int = SCALE) -> Column:
    """floor(scale * a / (first + rest)), exact beyond 64 bits."""
    whole = [x.cast("decimal(19,0)") for x in (a, first, rest)]
    return F.call_function("div", F.lit(scale).cast("decimal(10,0)") * whole[0], whole[1] + whole[2])


def parts(words: Column, size: Column) -> Column:
    """Every way to cut a phrase after its first k words."""
    return F.transform(
        F.sequence(F.lit(1), size - 1),
        lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(words, k + 1, size - k), " ").alias("rest")),
    )


def inner(words: Column, size: Column) -> Column:
    """All shorter runs of two words or more."""
    lengths = F.sequence(F.lit(2), size - 1)
    runs = F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")))
    return F.when(size > 2, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))


def collocations(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT,
    shards: int = SHARDS, inside_percent: int = INSIDE_PERCENT, top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language."""
    narrow = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"))
    rows = spread(narrow)
    exact = counted(rows, mined(rows, longest, -(-min_count // shards), shards), longest)
    frequent = cut(exact.where((F.col("f") >= min_count) | F.col("phrase").isNull()))
    known = frequent.where(F.col("phrase").isNotNull()).select("lang", "phrase", "words", "f")
    phrases = known.where(F.col("words") > 1).withColumn("list", F.split("phrase", " "))
    each = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(parts(F.col("list"), F.col("words"))).alias("c")).select("lang", "phrase", "a", "c.*")
    heads, tails = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = each.join(heads, ["lang", "first"]).join(tails, ["lang", "rest"]).withColumn("score", cohesion(F.col("a"), F.col("l"), F.col("r")))
    least = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), least)
    longer = phrases.select("lang", F.col("f").alias("b"), F.explode(inner(F.col("list"), F.col("words"))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    swallowed = F.lit(100).cast("decimal(10,0)") * F.col("b") >= F.lit(inside_percent).cast("decimal(10,0)") * F.col("a")
    own = scored.join(longer, ["lang", "phrase"], "left").where(F.col("b").isNull() | ~swallowed)
    totals = frequent.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    ranked = top_per_key(own.select("lang", "phrase", "a", "cut.*"), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query("op12_collocations")
def op12(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
