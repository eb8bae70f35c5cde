"""Benchmark passages in documents, by pigeonhole edit matching over words.

A test item may occur with up to ``budget`` word errors (insertions, deletions, substitutions). It is split into
budget + 1 pieces, so an occurrence holds one piece without an error. Hashed windows of the documents find exact piece
hits; around each hit Myers' bit-parallel distance, over words, decides.

Items travel to the tasks in blocks of about ``BLOCK_WORDS`` words; each block is one pass over the documents, so the
memory of a task does not grow with the benchmark.

Defined results: case of A-Z and white space are ignored; null or empty texts and items match nothing; an item of fewer
than ``MIN_WORDS`` words identifies nothing and is left out; equal items each match; of several occurrences of an item
in a document the one with the least distance, then the first, is reported; repeated documents are reported alike; empty
tables give no rows; input columns named like an output column give way to it.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from newsatlas.llm.frames import arrow_map, query, table, without
from newsatlas.llm.words import windows, words

ERROR_SHARE = 0.12  # errors allowed per word of an item
MIN_WORDS = 5
BLOCK_WORDS = 1 << 17
FILTER_BITS = 22


def budget(n_words: int, share: float = ERROR_SHARE) -> int:
    return int(share * n_words)


def bounds(n_words: int, errors: int) -> list[tuple[int, int]]:
    """errors + 1 pieces of near equal length."""
    cuts = [n_words * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts, cuts[1:]))


@dataclass
class Item:
    item_id: object
    hashes: list[int]
    errors: int
    forward: dict[int, int] = field(default_factory=dict)
    backward: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        n = len(self.hashes)
        for i, h in enumerate(self.hashes):
            self.forward[h] = self.forward.get(h, 0) | 1 << i
            self.backward[h] = self.backward.get(h, 0) | 1 << (n - 1 - i)


def myers(masks: dict[int, int], length: int, text: list[int], anchored: bool = False) -> list[int]:
    """Distance of the pattern to the best piece of ``text`` that ends at each position.

    The piece may begin anywhere or, if anchored, only at the beginning.
    """
    full, last = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, out = full, 0, length, []
    for word in text:
        same = masks.get(word, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        up = minus | (~(diagonal | plus) & full)
        down = plus & diagonal
        score += bool(up & last) - bool(down & last)
        up = (up << 1 | (1 if anchored else 0)) & full
        down = down << 1 & full
        plus = down | (~(diagonal | up) & full)
        minus = up & diagonal
        out.append(score)
    return out


class Matcher:
    """Looks up all items of a block in a batch of texts."""

    def __init__(self, items: list[tuple[object, str]], share: float = ERROR_SHARE):
        found = words(pa.array([t for _, t in items], pa.string()), lower=True)
        hashes = found.hashes()
        self.items: list[Item] = []
        for i, (item_id, _) in enumerate(items):
            own = hashes[found.bounds[i] : found.bounds[i + 1]].tolist()
            if len(own) >= MIN_WORDS:
                self.items.append(Item(item_id, own, budget(len(own), share)))
        pieces = [(k, a, b) for k, item in enumerate(self.items) for a, b in bounds(len(item.hashes), item.errors)]
        self.size = min((b - a for _, a, b in pieces), default=0)
        places = defaultdict(list)
        for k, a, b in pieces:
            start = np.array(self.items[k].hashes[a : a + self.size], np.uint64)
            places[int(windows(start, np.array([0, self.size]), self.size)[1][0])].append((k, a, b))
        self.keys = np.array(sorted(places), np.uint64)
        self.places = [places[int(k)] for k in self.keys]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, column: pa.Array) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item): (distance, first word, words) of the best occurrence."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not self.size:
            return best
        found = words(column, lower=True)
        hashes = found.hashes()
        first, keys = windows(hashes, found.bounds, self.size)
        likely = np.flatnonzero(self.filter[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = np.searchsorted(self.keys, keys[likely])
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == keys[likely]
        done: dict[tuple[int, int], int] = {}  # (text, item): where the last verified stretch ends
        for word, place in zip(first[likely[hit]].tolist(), at[hit].tolist()):
            text = int(np.searchsorted(found.bounds, word, "right")) - 1
            low, high = int(found.bounds[text]), int(found.bounds[text + 1])
            for k, a, b in self.places[place]:
                item = self.items[k]
                if hashes[word : min(word + b - a, high)].tolist() != item.hashes[a:b]:
                    continue
                begin, end = max(low, word - a - item.errors), min(high, word - a + len(item.hashes) + item.errors)
                begin, seen = max(begin, low), done.get((text, k))
                if seen is not None and seen[0] <= begin and end <= seen[1]:
                    continue
                done[text, k] = (begin, end)
                part = hashes[begin:end].tolist()
                scores = myers(item.forward, len(item.hashes), part)
                least = min(scores, default=len(item.hashes))
                if least > item.errors:
                    continue
                stop = scores.index(least) + 1
                back = myers(item.backward, len(item.hashes), part[:stop][::-1], anchored=True)
                length = back.index(least) + 1
                match = (least, begin + stop - length - low, length)
                if (text, k) not in best or match[:2] < best[text, k][:2]:
                    best[text, k] = match
        return best


def blocks(benchmark: DataFrame, item: str, text: str, block_words: int = BLOCK_WORDS) -> list[list[tuple]]:
    """The items in blocks of about ``block_words`` words; one block at a time passes through the driver."""
    named = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    total = named.agg(F.coalesce(F.sum(F.char_length("t")), F.lit(0))).first()[0] // 5
    count = max(1, -(-total // block_words))
    for k in range(count):
        yield [(r["i"], r["t"]) for r in named.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k).orderBy("i", "t").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = ERROR_SHARE) -> DataFrame:
    """(key, item, distance, first_word, n_words): the best occurrence of each item in each document."""
    schema = T.StructType([
        docs.schema[key], benchmark.schema[item], T.StructField("distance", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()),
    ])
    own = docs.select(key, text)

    def passed(items: list[tuple]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(Matcher(items, share))

        def work(piece: pa.RecordBatch) -> pa.RecordBatch | None:
            found = shared.value.find(piece.column(text))
            if not found:
                return None
            rows = sorted(found.items())
            ids = piece.column(key).take(pa.array([t for (t, _), _ in rows]))
            items = [shared.value.items[k].item_id for (_, k), _ in rows]
            numbers = [pa.array([m[i] for _, m in rows], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([ids, pa.array(items), *numbers], names=schema.names)

        return arrow_map(own, work, schema, text)

    out = None
    for items in blocks(benchmark, item, item_text):
        part = passed(items)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", share: float = ERROR_SHARE) -> DataFrame:
    """The documents that hold no item, with all their columns; nothing is shuffled."""
    for items in blocks(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Matcher(items, share))

        def work(piece: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            keep = np.ones(piece.num_rows, bool)
            keep[[t for t, _ in shared.value.find(piece.column(text))]] = False
            return piece.filter(pa.array(keep))

        docs = arrow_map(docs, work, docs.schema, text)
    return docs


@query("op8_decontamination")
def op8(spark, sf_dir):
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
