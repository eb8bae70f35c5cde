"""Mixing sources to target weights by blocks of words.

The words of a source form one stream, cut into blocks of fixed length. A source gets as many slots as its target asks
for; a multinomial draw spreads them over the output shards, so that the counts of a shard vary while the totals are
exact. Slot k of a source takes block perm(k), where perm is a pseudorandom permutation of the block numbers (one per
pass over the source), computed from k alone. Slots and blocks meet in a join by index.

Targets: the sources, by code point with null last, weigh 5, 2, 1, 5, 2, 1, ... and share ``SHARE`` of all words. A
target stops at ``MOST`` times its source's words; the excess is shared again by weight.

Defined results: a null or empty text has no words and is never taken; documents with a null source form a source of
their own; repeated rows are documents of their own; an empty table gives no rows; input columns named like an output
column give way to it. Draws depend on the seed, the sources and the ids alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsatlas.llm.frames import query, table, without
from newsatlas.session import by_key, cut

WEIGHTS = [5.0, 2.0, 1.0]
SHARE = 1.5
MOST = 2.0
BLOCK = 64
SHARD_SLOTS = 8192
ROUNDS = 12
SEED = 20
CHUNK = 4096  # slots that one row of the slot generator makes
BUCKET_ROWS = 5000  # documents summed in one window
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], share: float = SHARE, most: float = MOST) -> list[tuple[int, str | None, int, float]]:
    """(number, source, size, target) of every source."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    weight = {i: WEIGHTS[i % len(WEIGHTS)] for i in range(len(ordered))}
    left, free, out = share * sum(n for _, n in ordered), set(weight), {}
    while free:
        unit = left / sum(weight[i] for i in sorted(free))
        over = {i for i in free if unit * weight[i] > most * ordered[i][1]}
        for i in sorted(over or free):
            out[i] = most * ordered[i][1] if over else unit * weight[i]
        if not over:
            break
        left -= sum(out[i] for i in sorted(over))
        free -= over
    return [(i, source, n, float(out[i])) for i, (source, n) in enumerate(ordered)]


def permuted(k: Column, n: Column, *salt: Column, rounds: int = ROUNDS) -> Column:
    """Image of k under a pseudorandom permutation of 0..n-1 (swap-or-not rounds)."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*salt, r), n) - x, n)
        return F.when(F.xxhash64(*salt, r, F.greatest(x, other)).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), k, step)


def sources(spark: SparkSession, sized: DataFrame, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """One row per source: no, source, source_size, target, blocks, slots. The driver holds one row per source."""
    rows = [(r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    out = []
    for no, source, n, target in targets(rows, share, most):
        blocks = -(-n // block)
        out.append((no, source, n, target, blocks, min(int(most * blocks), round(target / n * blocks)) if n else 0))
    return spark.createDataFrame(out, "no int, source string, source_size long, target double, blocks long, slots long")


def placed(sized: DataFrame, info: DataFrame) -> DataFrame:
    """Each document's first word in the stream of its source, by running sums over small buckets."""
    docs = sized.join(info.select("no", F.col("source").alias("__s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    buckets = F.greatest(F.lit(1), F.ceil(sized.agg(F.count(F.lit(1))).scalar() / BUCKET_ROWS))
    docs = docs.withColumn("__b", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), buckets))
    ahead = F.sum("size").over(Window.partitionBy("no", "__b").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    sums = docs.groupBy("no", "__b").agg(F.sum("size").alias("__n"))
    base = F.sum("__n").over(Window.partitionBy("no").orderBy("__b")) - F.col("__n")
    starts = sums.select("no", "__b", base.alias("__base"))
    return docs.withColumn("__ahead", ahead).join(starts, ["no", "__b"]).withColumn("start", F.col("__base") + F.col("__ahead")).drop("__b", "__ahead", "__base")


def slots(info: DataFrame, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(no, k, shard, block): every slot of the mix. A source's slots are made in chunks, on many tasks."""
    shards = F.greatest(F.lit(1), F.ceil(info.agg(F.sum("slots")).scalar() / shard_slots))
    chunks = info.where("slots > 0").select("no", "blocks", "slots", F.explode(F.sequence(F.lit(0), F.expr(f"(slots - 1) div {CHUNK}"))).alias("c"))
    spread = by_key(chunks, "no", "c")
    k = F.explode(F.sequence(F.col("c") * CHUNK, F.least(F.col("c") * CHUNK + CHUNK, F.col("slots")) - 1))
    each = spread.select("no", "blocks", k.alias("k"))
    turn = F.expr("k div blocks")
    return each.select(
        "no", "k", F.pmod(F.xxhash64(F.lit(seed), "no", "k", F.lit("shard")), shards).alias("shard"),
        permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("no"), turn).alias("block"),
    )


def draws(taken: DataFrame) -> DataFrame:
    """(shard, no, n): how many slots of each source fell on each output shard."""
    return taken.groupBy("shard", "no").agg(F.count(F.lit(1)).alias("n"))


def with_size(docs: DataFrame, text: str = "text") -> DataFrame:
    return without(docs, "size").withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def pieces(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The part of each document that lies in each block: words lo..hi-1 of the stream."""
    span = F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    cut_up = docs.where("size > 0").withColumn("block", span)
    return cut_up.withColumn("lo", F.greatest("start", F.col("block") * block)).withColumn(
        "hi", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    )


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, no, k, block, doc_id, first_word, n_words): the words of each slot, by document."""
    sized = cut(with_size(docs).select("doc_id", "source", "size"))
    info = sources(docs.sparkSession, sized)
    parts = pieces(placed(sized, info))
    return slots(info, seed).hint("merge").join(parts, ["no", "block"]).select(
        "shard", "no", "k", "block", "doc_id", (F.col("lo") - F.col("start")).alias("first_word"), (F.col("hi") - F.col("lo")).alias("n_words")
    )


def shares(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, shards (the output shards that its words were drawn
    for), and copies (slots that take its first word)."""
    sized = cut(with_size(docs).select("doc_id", "source", "size"))
    info = sources(docs.sparkSession, sized)
    put = placed(sized, info)
    # a merge join: the size of what slots makes is not known beforehand, and no bound allows a broadcast
    times = slots(info, seed).groupBy("no", "block").agg(F.count(F.lit(1)).alias("times"), F.collect_set("shard").alias("to"))  # a block has MOST slots at most
    keys = ["no", "start", "doc_id", "source", "size", "source_size", "target"]
    used = pieces(put).join(times.hint("merge"), ["no", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    summed = used.groupBy(*keys).agg(
        F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("to")))).alias("shards"), F.max(F.when(F.col("lo") == F.col("start"), F.col("times"))).alias("copies")
    )
    none = put.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"), F.array().cast("array<long>").alias("shards"), F.lit(0).cast("long").alias("copies"))
    return summed.unionByName(none).drop("no", "start")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Whole documents, each as often as its first word is taken; rows of one id share the fate of the first."""
    copies = shares(docs, seed).groupBy("doc_id").agg(F.max("copies").alias("__copies")).where("__copies > 0").withColumnRenamed("doc_id", "__id")
    joined = docs.join(copies, docs["doc_id"].eqNullSafe(F.col("__id")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


@query("op6_mixing")
def op6(spark, sf_dir):
    return shares(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")
