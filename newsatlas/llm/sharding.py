"""Shards of near equal bytes by a histogram sort.

Rows are ordered by a 64-bit key: 40 bits of the text's hash, then 24 bits of the document's, so that equal texts lie
together and a text that fills several shards can still be cut. Each round counts the exact bytes below evenly spaced
probes inside the intervals that are still open, until every splitter meets the tolerance or its interval is one key.
Then the rows are exchanged once, into ranges of bounded rows, and numbered.

Defined results: a null text has no bytes (size 1) and the checksum of the empty text; a null id is hashed like any
other value; repeated rows follow each other in one shard; an empty table gives no rows; input columns named like an
output column give way to it. Rows with the same key take their slots in the order of id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsatlas.llm.frames import query, table, without
from newsatlas.session import cut

SHARDS = 8
TOLERANCE = 0.0005  # of a shard's bytes
STEP = 12  # bits by which a round refines an open interval
LEAF_SHARE = 0.001  # a range of the exchange with more than this share of the rows is refined
LEAF_ROWS = 1000  # and holds more than so many rows
OUTPUT = ["size", "text_crc32", "shard", "slot"]


def _key(text: str, key: str) -> Column:
    return F.expr(f"(xxhash64(coalesce(`{text}`, '')) & -16777216L) | (xxhash64(`{key}`) & 16777215L)")


def _size(text: str) -> Column:
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")


def _prefix(bits: int) -> Column:
    return F.shiftright("__key", 64 - bits)


def _within(col: Column, values: set[int]) -> Column:
    return col.isin(sorted(values)) if values else F.lit(False)


def plan(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[int], list[tuple[int, set[int]]]]:
    """Splitters, and for each round its bits and the intervals whose ranges are refined further.

    ``rows`` has ``__key`` and ``size``. The driver only sees counts of intervals, ``2**STEP`` per open interval.
    """
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    slack = tolerance * total / shards
    found: dict[int, int] = {}
    open_goals = {i: (0, 0) for i in range(1, shards)} if count else {}  # goal: (interval, bytes below it)
    parents, heavy, bits, refined = {0}, {0} if count else set(), 0, []
    while (open_goals or heavy) and bits < 64:
        last, bits = bits, min(64, bits + STEP)
        seen = rows.where(_within(_prefix(last), parents)) if last else rows
        counts = seen.groupBy(_prefix(bits).alias("p")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        children: dict[int, list[tuple[int, int]]] = {}
        for p, b, n in sorted(counts):
            children.setdefault(p >> (bits - last) if last else 0, []).append((p, b))
        still = {}
        for i, (interval, below) in open_goals.items():
            goal = total * i / shards
            for p, b in children[interval]:
                if below + b > goal or p == children[interval][-1][0]:
                    break
                below += b
            low, high = abs(goal - below), abs(below + b - goal)
            if min(low, high) <= slack or bits == 64:
                found[i] = (p if low <= high else p + 1) << (64 - bits)
            else:
                still[i] = (p, below)
        open_goals = still
        if heavy:
            limit = max(LEAF_ROWS, LEAF_SHARE * count)
            heavy = {p for p, _, n in counts if n > limit and (p >> (bits - last) if last else 0) in heavy}
            refined.append((bits, heavy))
        parents = heavy | {interval for interval, _ in open_goals.values()}
    return [found[i] for i in sorted(found)], refined


def assign(rows: DataFrame, splitters: list[int], refined: list[tuple[int, set[int]]]) -> DataFrame:
    """Adds ``shard`` and the range ``__leaf``, named by its first key."""
    above = [(F.col("__key") >= F.lit(s)).cast("int") for s in splitters if s < 1 << 63]
    leaf = F.lit(0).cast("long")
    for bits, heavy in reversed(refined):
        own = F.shiftleft(_prefix(bits), 64 - bits)
        leaf = F.when(_within(_prefix(bits), heavy), leaf).otherwise(own) if heavy else own
    return rows.withColumn("shard", reduce(lambda a, b: a + b, above, F.lit(0))).withColumn("__leaf", leaf)


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id", tolerance: float = TOLERANCE) -> DataFrame:
    """All columns and size, text_crc32, shard, slot (0, 1, ... inside each shard)."""
    docs = without(docs, *OUTPUT)
    keyed = docs.withColumn("__key", _key(text, key)).withColumn("size", _size(text))
    narrow = cut(keyed.select("__key", "size"))
    splitters, refined = plan(narrow, shards, tolerance)
    ranges = assign(narrow, splitters, refined).groupBy("shard", "__leaf").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__leaf")) - F.col("__n")
    starts = ranges.select("shard", "__leaf", before.alias("__start"))
    place = F.row_number().over(Window.partitionBy("shard", "__leaf").orderBy("__key", key))
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    placed = assign(keyed.withColumn("text_crc32", crc), splitters, refined).withColumn("__place", place)
    return placed.join(starts, ["shard", "__leaf"]).withColumn("slot", F.col("__start") + F.col("__place") - 1).drop("__leaf", "__place", "__start", "__key")


@query("op9_sharding")
def op9(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
