"""N-gram Jaccard join with token-combination prefixes; near-duplicate documents by component.

A document is the set of its distinct word shingles. Two sets link at a Jaccard similarity of 0.8 or more. Equal sets
are one class. In a fixed order of tokens, the first tokens of a set (its prefix, extended by ``near.EXTRA``) share a
known number of tokens with the prefix of any partner. From those that other documents have as well, rare tokens are
signatures, and frequent tokens are signatures in combinations of two, within groups that each extend the prefix by a
token. Documents with a common signature are candidates, and whole sets are compared.

Components need no list of all pairs. Each round compares every set with a pivot of its buckets; buckets whose sets
have come into one component are done. What is left is compared in blocks of sets of similar size, so that neither a
row per pair nor a group in one task arises, and no link between two components is missed.

Moves: pieces of the input deal out each distinct prefix token once, with its count; sets are only sent for documents
with signatures. Frequencies cover all documents.

Defined results: a null or empty text has no shingle and is linked with nothing; a text of 1 to 4 words has one shingle;
case of A-Z and white space are ignored; repeated rows form one component; rows with a null id get the component of
their set, whose smallest id it may share; an empty table gives no rows; other input columns are ignored, whatever their
names. Shingles are told apart by 64-bit hashes, sets by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from newsatlas.llm import near
from newsatlas.llm.frames import arrow_map, query, table
from newsatlas.llm.scoring import index, mod, packed, unpacked
from newsatlas.llm.words import mixed, pieces
from newsatlas.operators.graph import components
from newsatlas.operators.keys import lookup
from newsatlas.session import cut

PIVOT_ROUNDS = 2
BLOCK = 128  # sets in a block of the last comparison
PIECE = 4 << 20
PIECE_ROWS = 1 << 15
FILTER_BITS = 25  # of the filter that tells which sets are worth sending; its size is fixed
EDGE = "a binary, b binary"


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    data = memoryview(values.tobytes())
    return [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_hash, fp, n): the hash of each document's text, the fingerprint and the size of its set."""
    schema = T.StructType([docs.schema[key], T.StructField("text_hash", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("n", T.LongType())])

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        values, bounds = near.shingles(piece.column(text))
        columns = [piece.column(key), piece.column("text_hash"), pa.array(fingerprints(values, bounds), pa.binary()), pa.array(np.diff(bounds))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrow_map(docs.select(key, text, F.xxhash64(text).alias("text_hash")), work, schema, text)


def dealt(docs: DataFrame, text: str, parts: int) -> DataFrame:
    """(piece, part, data): the prefix tokens of each piece by part; part -1 has the prefixes of its sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_no = TaskContext.get().partitionId() << 24
        for piece in pieces(batches, text, PIECE, PIECE_ROWS):
            values, bounds = near.shingles(piece.column(text))
            n = np.diff(bounds)
            length = near.prefix_length(n)
            place = np.arange(len(values)) - np.repeat(bounds[:-1], n)
            prefix = values[place < np.repeat(length, n)]
            tokens, at, count = np.unique(prefix, return_inverse=True, return_counts=True)
            part = mod(mixed(tokens), parts)
            order = np.argsort(part, kind="stable")
            rank = np.empty(len(tokens), np.int64)
            rank[order] = np.arange(len(tokens))
            tokens, count, part = tokens[order], count[order], part[order]
            fps = np.frombuffer(b"".join(fingerprints(values, bounds)), np.uint8)
            yield batch_of(piece_no, -1, packed(n, length.astype(np.int64), rank[at].astype(np.int32), fps))
            for p in np.unique(part).tolist():
                i, j = np.searchsorted(part, [p, p + 1])
                yield batch_of(piece_no, p, packed(np.array([i]), tokens[i:j], count[i:j].astype(np.int32)))
            piece_no += 1

    return cut(docs.select(text).mapInArrow(run, "piece long, part int, data binary"))


def batch_of(piece: int, part: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["piece", "part", "data"])


def shared_tokens(group: pd.DataFrame) -> pd.DataFrame:
    """For each piece its tokens of a part that other documents have too, and in how many they are."""
    blobs = [unpacked(d) for d in group["data"]]
    tokens, counts = np.concatenate([b[1] for b in blobs]), np.concatenate([b[2] for b in blobs])
    seen, at = np.unique(tokens, return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(seen)).astype(np.int64)[at]
    out, begin = [], 0
    for piece, (first, own, _) in zip(group["piece"], blobs):
        mine = total[begin : begin + len(own)]
        begin += len(own)
        more = np.flatnonzero(mine > 1)
        if len(more):
            out.append((piece, packed((first[0] + more).astype(np.int32), own[more], mine[more])))
    return pd.DataFrame(out, columns=["piece", "data"])


def signed(group: pd.DataFrame) -> pd.DataFrame:
    """(fp, n, signatures) of the sets of a piece that can have a partner."""
    is_head = group["head"]
    n, length, token, fps = unpacked(group["data"][is_head].iloc[0])
    fps = fps.tobytes()
    back = [unpacked(d) for d in group["data"][~is_head]]
    size = int(token.max()) + 1 if len(token) else 0
    value, often = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    for at, tokens, total in back:
        value[at], often[at] = tokens, total
    bounds = np.r_[0, np.cumsum(length)]
    common = often[token] > 1
    enough = np.diff(np.r_[0, np.cumsum(common)][bounds]) >= near.least_common(n)
    rows = []
    for i in np.flatnonzero(enough & (n > 0)).tolist():
        own = token[bounds[i] : bounds[i + 1]][common[bounds[i] : bounds[i + 1]]]
        found = near.signatures(value[own], often[own], int(n[i]))
        if len(found):
            rows.append((fps[16 * i : 16 * i + 16], int(n[i]), found.view(np.int64)))
    return pd.DataFrame(rows, columns=["fp", "n", "signatures"])


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """(fp, n, signatures), once per set."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces_ = dealt(docs, text, parts)
    back = pieces_.where("part >= 0").groupBy("part").applyInPandas(shared_tokens, "piece long, data binary")
    both = back.withColumn("head", F.lit(False)).unionByName(pieces_.where("part = -1").select("piece", "data", F.lit(True).alias("head")))
    found = both.groupBy("piece").applyInPandas(signed, "fp binary, n long, signatures array<long>")
    return cut(found.dropDuplicates(["fp"]))


def set_filter(nodes: DataFrame) -> np.ndarray:
    """Bits of the fingerprints in a filter of fixed size: a set outside it has no signature."""
    low = F.xxhash64("fp").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    slots = nodes.select(F.shiftright(low, 18).alias("page"), low.bitwiseAND((1 << 18) - 1).cast("int").alias("bit")).distinct()

    def page(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 18, bool)
        bits[group["bit"]] = True
        return pd.DataFrame({"page": [group["page"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros((1 << FILTER_BITS - 18, 1 << 15), np.uint8)
    for r in slots.groupBy("page").applyInPandas(page, "page long, bits binary").collect():
        out[r["page"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def sets(docs: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """(fp, data): the whole sets of the nodes."""
    shared = docs.sparkSession.sparkContext.broadcast(set_filter(nodes.select("fp")))

    def work(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        values, bounds = near.shingles(piece.column(text))
        fps = fingerprints(values, bounds)
        at = np.fromiter((xxhash.xxh64_intdigest(f, seed=42) for f in fps), np.uint64, len(fps)) & np.uint64((1 << FILTER_BITS) - 1)
        kept = np.flatnonzero(shared.value[(at >> np.uint64(3)).astype(np.int64)] & (128 >> (at & np.uint64(7)).astype(np.int64)))
        data = [packed(values[bounds[i] : bounds[i + 1]]) for i in kept.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([fps[i] for i in kept.tolist()], pa.binary()), pa.array(data, pa.binary())], names=["fp", "data"])

    found = arrow_map(docs.select(text), work, "fp binary, data binary", text)
    return cut(found.join(nodes.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]))


def alike(n: int, m: int, common: int) -> bool:
    return 100 * common >= near.PERCENT * (n + m - common)


def compared(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = whole.select(F.col("fp").alias("a"), F.col("data").alias("x"))
    right = whole.select(F.col("fp").alias("b"), F.col("data").alias("y"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = unpacked(x)[0], unpacked(y)[0]
                keep.append(alike(len(x), len(y), int((index(y, x) >= 0).sum())))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, EDGE)


def buckets(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, fp, n, label) of every signature."""
    return nodes.join(labels, "fp").select("fp", "n", "label", F.explode("signatures").alias("sig"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the links: components of the graph of labels, which shrinks from round to round."""
    ends = [labels.select(F.col("fp").alias(e), F.col("label").alias(f"{e}_label")) for e in ("a", "b")]
    between = cut(links.join(ends[0], "a").join(ends[1], "b").where("a_label <> b_label").select("a_label", "b_label").distinct())
    if between.isEmpty():
        return labels
    found = components(between, "a_label", "b_label").select(F.col("node").alias("label"), F.col("component").alias("lower"))
    return cut(lookup(labels, found, "label").select("fp", F.coalesce("lower", "label").alias("label")))


def open_buckets(rows: DataFrame, number: int) -> DataFrame:
    """(sig, pivot, pivot_n, pivot_label) of the buckets that hold more than one component."""
    pivot = F.min(F.struct(F.xxhash64("fp", F.lit(number)).alias("h"), "fp", "n", "label")).alias("p")
    found = rows.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), pivot).where("low <> high")
    return found.select("sig", F.col("p.fp").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.label").alias("pivot_label"))


def near_size(n: str, m: str):
    return (F.lit(100) * F.col(n) >= F.lit(near.PERCENT) * F.col(m)) & (F.lit(100) * F.col(m) >= F.lit(near.PERCENT) * F.col(n))


def packed_blocks(group: pd.DataFrame) -> pd.DataFrame:
    head = group.iloc[0]
    values = [unpacked(d)[0] for d in group["data"]]
    names = np.frombuffer(b"".join(group["fp"]), np.uint8)
    labels = np.frombuffer(b"".join(group["label"]), np.uint8)
    data = packed(np.array([len(v) for v in values]), np.concatenate(values), names, labels)
    return pd.DataFrame({"coarse": [head["coarse"]], "class": [head["class"]], "sub": [head["sub"]], "block": [data]})


def block_sets(data: bytes) -> tuple[list[np.ndarray], list[bytes], list[bytes]]:
    lengths, values, names, labels = unpacked(data)
    names, labels = names.tobytes(), labels.tobytes()
    each = range(0, len(names), 16)
    return np.split(values, np.cumsum(lengths)[:-1]), [names[i : i + 16] for i in each], [labels[i : i + 16] for i in each]


def compared_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different components, one for each pair of components and blocks."""
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (left, a, p), (right, b, q) = block_sets(x), block_sets(y)
            n, m = np.array([len(s) for s in left]), np.array([len(s) for s in right])
            number = {label: i for i, label in enumerate({*p, *q})}
            apart = np.array([number[v] for v in p])[:, None] != np.array([number[v] for v in q])[None]
            apart &= (100 * n[:, None] >= near.PERCENT * m) & (100 * m >= near.PERCENT * n[:, None])
            rows, columns = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
            if not len(rows):
                continue
            common = near.overlaps([left[i] for i in rows], [right[j] for j in columns])
            linked = (100 * common >= near.PERCENT * (n[rows, None] + m[columns] - common)) & apart[np.ix_(rows, columns)]
            edges = {}
            for i, j in np.argwhere(linked).tolist():
                i, j = rows[i], columns[j]
                edges[min(p[i], q[j]), max(p[i], q[j])] = (a[i], b[j])
            found = list(edges.values())
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.binary()), pa.array([e[1] for e in found], pa.binary())], names=["a", "b"])


def remaining(rows: DataFrame, open_: DataFrame, whole: DataFrame) -> DataFrame:
    """Links between components that still meet in a bucket: all sets of these buckets, block against block."""
    inside = cut(rows.join(open_.select("sig", "pivot_label"), "sig").select("fp", "n", "label", "pivot_label").distinct())
    groups = components(inside.where("label <> pivot_label").select("label", "pivot_label").distinct(), "label", "pivot_label").select(F.col("node").alias("label"), F.col("component").alias("coarse"))
    size_class = F.floor(F.log("n") / F.log(F.lit(100 / near.PERCENT))).cast("int")
    members = cut(lookup(inside.select("fp", "n", "label").distinct(), cut(groups), "label").withColumn("class", size_class))
    counts = members.groupBy("coarse", "class").agg(F.count(F.lit(1)).alias("c"))
    placed = members.join(counts, ["coarse", "class"]).withColumn("sub", F.pmod(F.xxhash64("fp"), F.ceil(F.col("c") / BLOCK)).cast("int"))
    blocks = cut(placed.join(whole, "fp").select("coarse", "class", "sub", "fp", "label", "data").groupBy("coarse", "class", "sub").applyInPandas(packed_blocks, "coarse binary, class int, sub int, block binary"))
    left = blocks.select("coarse", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"), F.col("class").alias("from"), F.col("sub").alias("first"), F.col("block").alias("x"))
    pairs = left.join(blocks, ["coarse", "class"]).where("from < class OR first <= sub").select("x", F.col("block").alias("y"))
    return pairs.mapInArrow(compared_blocks, EDGE)


def grouped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_hash, fp, n, label): equal labels for the sets that reach each other by links."""
    known = cut(described(docs, key, text))
    nodes = candidates(docs, text)
    whole = sets(docs, nodes, text)
    labels = cut(nodes.select("fp", F.col("fp").alias("label")))
    for number in range(PIVOT_ROUNDS + 1):
        rows = buckets(nodes, labels)
        open_ = cut(open_buckets(rows, number))
        if open_.isEmpty():
            break
        if number < PIVOT_ROUNDS:
            pairs = rows.join(open_, "sig").where("label <> pivot_label").where(near_size("n", "pivot_n")).select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct()
            links = compared(pairs, whole)
        else:
            links = remaining(rows, open_, whole)
        labels = merged(labels, cut(links))
    return lookup(known, labels, "fp").withColumn("label", F.coalesce("label", "fp"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): the smallest key that each document reaches by links, itself included."""
    named = grouped(docs, key, text)
    some = cut(named.where("n > 0").select(key, "n", "label"))
    smallest = cut(some.groupBy("label").agg(F.min(key).alias("least")))
    out = lookup(some, smallest, "label").select(key, F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return out.unionByName(named.where("n = 0").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id")))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with all its columns: that of the smallest key, null last.

    Of one key's texts in a component the one of the smallest hash stays, of repeated rows one. Documents without words are
    linked with nothing and stay.
    """
    named = cut(grouped(docs, key, text))
    order = F.struct(F.col(key).isNull().alias("blank"), F.col(key).alias("__id"), F.col("text_hash").alias("__text"))
    first = named.where("n > 0").groupBy("label").agg(F.min(order).alias("b")).select("b.__id", "b.__text", F.lit(True).alias("__one"))
    bare = named.where("n = 0").select(F.col(key).alias("__id"), F.col("text_hash").alias("__text"), F.lit(False).alias("__one")).distinct()
    chosen = first.unionByName(bare)
    marked = docs.withColumn("__hash", F.xxhash64(text))
    kept = marked.join(chosen, marked[key].eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text")))
    single = kept.where("__one").dropDuplicates([key, "__hash"])
    return single.unionByName(kept.where("NOT __one")).select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op7_jaccard_join")
def op7(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"))
