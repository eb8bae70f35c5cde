"""Exact nearest neighbours by cosine, and the recurring pairs drawn from them.

The search is exact but does not compare everything with everything. Vectors are placed in cells around pivots, and
cells are cut into blocks: rings of similar angle to the pivot. A first bound, the k-th best similarity so far, comes
from the block of a query and from the buckets of random hyperplanes. Then one row per pair of blocks is decided: a pair
is visited when the angles of the two blocks to the pivot of one leave room for a similarity above the least bound of
the other. Blocks meet by pairs of tiles, once for both directions, in a task that asks the same question for each row
before it compares. It multiplies in single precision, computes what may be among the best again in double precision, and
hands on at most k targets of each row, so that what is moved grows with the number of tiles and not of blocks.
Entries are numbered in the order of their keys. Equal vectors are searched once: copies of a vector, however many, form one entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsatlas.functions.dates import gap_days
from newsatlas.operators.keys import consecutive_ids, lookup, one_per_key, top_per_key
from newsatlas.session import by_key, cut

BLOCK = 2048  # vectors per block, about; the least size of a bucket
TILE = 8  # blocks of this size in a tile, of which one task holds two; up to WIDE times as many
WIDE = 4  # tiles are larger where there would be more than TILES of them: each row is sent to every tile that it meets
TILES = 24
CHUNK = 1024  # rows compared at once, on either side
HITS = 1 << 16  # pairs computed again at once
MAX_PIVOTS = 1024
RINGS = 256  # steps by which angles to a pivot are counted
TABLES = 2  # sets of random hyperplanes
SEED = 5
DIGITS = 6
SLACK = 2e-6  # covers the rounding of similarities
SCHEMA = "source long, target long, sim double"


def unit(vec: Column | str) -> Column:
    """Vector divided by its length; a zero vector stays zero."""
    arr = F.transform(F.col(vec) if isinstance(vec, str) else vec, lambda x: x.cast("double"))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y * y))
    scaled = lambda v, n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)
    # Vector and length are bound by arrays of one: an expression inside a lambda is computed again for each element.
    return F.transform(F.array(arr), lambda v: F.transform(F.array(length(v)), lambda n: scaled(v, n))[0])[0]


def _scaled(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _units(batch: pd.Series) -> np.ndarray:
    return _scaled(np.stack([np.asarray(v, dtype=float) for v in batch]))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of vectors, which must be of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = set(pc.unique(pc.list_value_length(column)).to_pylist())
    if len(sizes) != 1 or None in sizes:
        raise ValueError("vectors must have the same length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))


def _distinct(vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Members (key, code) and one entry per distinct vector (rep, code, vec)."""
    code = F.concat(F.hex(F.xxhash64("vec")), F.hex(F.xxhash64(F.lit("b"), "vec")))
    coded = vectors.select(F.col(key), code.alias("code"), "vec")
    entries = coded.groupBy("code").agg(F.min(key).alias("rep"), F.any_value("vec").alias("vec"))
    return coded.select(key, "code"), entries.select("rep", "code", "vec")


def _cells(entries: DataFrame, kind: str, n: int, block: int) -> tuple[DataFrame, np.ndarray, int]:
    """Entries with cell, angle, block and the codes of their hyperplane buckets; pivots; number of blocks."""
    count = int(min(MAX_PIVOTS, max(1, round((n / block) ** 0.5) * 4 if n > block else 1)))
    chosen = entries.orderBy(F.xxhash64("rep"), "rep").limit(count).select("vec").collect()
    pivots = _units(pd.Series([r["vec"] for r in chosen]))
    bits = max(1, math.ceil(math.log2(max(2.0, n / max(block, BLOCK)))))
    planes = np.random.default_rng(SEED).standard_normal((TABLES * bits, pivots.shape[1]))
    shared = entries.sparkSession.sparkContext.broadcast((pivots, planes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, planes = shared.value
        for batch in batches:
            if n := batch.num_rows:
                m = _scaled(_matrix(batch.column("vec")))
                angles = _angles(m, pivots)
                cell = angles.argmin(axis=1)
                sides = ((m @ planes.T) > 0).reshape(n, TABLES, bits)
                codes = pa.array((sides << np.arange(bits)).sum(axis=2).ravel(), pa.int64())
                codes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * TABLES, pa.int32()), codes)
                found = [pa.array(cell, pa.int32()), pa.array(angles[np.arange(n), cell]), codes]
                yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "cell", "angle", "codes"])

    placed = cut(entries.mapInArrow(place, f"rep {kind}, code string, vec array<double>, cell int, angle double, codes array<long>"))
    # A place in the cell: by steps of the angle, inside a step by hash. Its whole multiples of the block size are the rings.
    step = F.least(F.floor(F.col("angle") / math.pi * RINGS), F.lit(RINGS - 1)).cast("int").alias("step")
    counts = placed.groupBy("cell", step).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("cell").orderBy("step")) - F.col("n")
    sizes = counts.groupBy("cell").agg(F.ceil(F.sum("n") / block).alias("blocks"))
    first = sizes.select("cell", (F.sum("blocks").over(Window.orderBy("cell")) - F.col("blocks")).alias("first"))  # a row per pivot
    table = cut(counts.withColumn("before", before).join(first, "cell"))  # at most MAX_PIVOTS x RINGS rows
    rank = F.col("before") + F.pmod(F.xxhash64("rep"), F.col("n"))
    numbered = placed.withColumn("step", step).join(F.broadcast(table), ["cell", "step"])
    numbered = numbered.select("rep", "code", "vec", "cell", "angle", "codes", (F.col("first") + F.floor(rank / block)).cast("int").alias("block"))
    return cut(numbered), pivots, int(sizes.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0])


def _compare(q_reps, q, t_reps, t, k: int, floor: float | None) -> pd.DataFrame:
    """k best targets of each query by (rounded similarity, id), the query itself excluded."""
    order = np.argsort(t_reps, kind="stable")
    t_reps, t = t_reps[order], t[order]
    sims = np.round(q @ t.T, DIGITS) + 0.0
    place = {rep: i for i, rep in enumerate(t_reps)}
    for row, rep in enumerate(q_reps):
        if rep in place:
            sims[row, place[rep]] = -np.inf
    last = min(k, sims.shape[1]) - 1
    cutoff = -np.partition(-sims, last, axis=1)[:, last]
    good = (sims >= cutoff[:, None]) & np.isfinite(sims)
    if floor is not None:
        good &= sims >= floor
    rows, cols = np.nonzero(good)
    ranked = np.lexsort((cols, -sims[rows, cols], rows))
    rows, cols = rows[ranked], cols[ranked]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
    rows, cols = rows[keep], cols[keep]
    return pd.DataFrame({"source": q_reps[rows], "target": t_reps[cols], "sim": sims[rows, cols]})


def _bucket_bounds(placed: DataFrame, k: int, floor: float | None, block: int) -> DataFrame:
    """(source, target, sim) of the best in the same hyperplane bucket; large buckets are split by hash."""
    each = placed.select("rep", "vec", F.posexplode("codes").alias("no", "side"))
    sizes = each.groupBy("no", "side").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    split = each.join(sizes, ["no", "side"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))

    def inside(rows: pa.Table) -> pa.Table:
        m, reps = _scaled(_matrix(rows.column("vec"))), rows.column("rep").to_numpy()
        return pa.Table.from_pandas(_compare(reps, m, reps, m, k, floor), preserve_index=False)

    return split.select("rep", "vec", "no", "side", "part").groupBy("no", "side", "part").applyInArrow(inside, SCHEMA)


def block_pairs(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """(home, target): pairs of blocks that may hold a neighbour; at most one row per pair.

    ``blocks`` is (block, cell, lo, hi), angles to the own pivot; ``spans`` is (block, need, near, far), the least bound
    and the angles to every pivot. A target lies in reach if its ring, widened by the angle of the bound, meets them.
    """
    reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("need") - SLACK)))
    asked = spans.select(F.col("block").alias("home"), reach.alias("reach"), F.posexplode(F.arrays_zip("near", "far")).alias("cell", "a"))
    asked = asked.select("home", "cell", (F.col("a.near") - F.col("reach") - SLACK).alias("from"), (F.col("a.far") + F.col("reach") + SLACK).alias("to"))
    there = blocks.select(F.col("block").alias("target"), "cell", "lo", "hi")
    met = asked.join(there, "cell").where((F.col("hi") >= F.col("from")) & (F.col("lo") <= F.col("to")) & (F.col("home") != F.col("target")))
    return met.select("home", "target")


class _Side:
    """The rows of one tile, ordered by block, and the best targets found for each so far."""

    def __init__(self, rows: pa.Table, k: int, pivots: np.ndarray):
        order = np.argsort(rows.column("block").to_numpy(), kind="stable")
        column = lambda c: rows.column(c).to_numpy()[order]
        self.rep, self.need, block, cell, angle = (column(c) for c in ("rep", "need", "block", "cell", "angle"))
        self.m, self.k = _scaled(_matrix(rows.column("vec"))[order]), k
        self.single = self.m.astype(np.float32)
        self.slack = SLACK + (self.m.shape[1] + 2) * 2.0**-23
        self.starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        self.stops = np.r_[self.starts[1:], len(order)]
        self.low, self.high = np.minimum.reduceat(angle, self.starts), np.maximum.reduceat(angle, self.starts)
        self.centres = pivots[cell[self.starts]]
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, targets, similarities
        self.pending = 0

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Runs of whole blocks of about CHUNK rows."""
        first = 0
        for i in range(1, len(self.starts) + 1):
            if i == len(self.starts) or self.stops[i] - self.starts[first] > CHUNK:
                yield first, i
                first = i

    def reaches(self, other: _Side) -> np.ndarray:
        """(own block, other block): whether a row of the first may have a neighbour in the second."""
        out = np.zeros((len(self.starts), len(other.starts)), bool)
        for a, b in self.blocks():
            rows = slice(self.starts[a], self.stops[b - 1])
            angle = _angles(self.m[rows], other.centres)
            gap = np.maximum(0.0, np.maximum(angle - other.high, other.low - angle))
            able = np.cos(np.minimum(gap, np.pi)) + SLACK >= self.need[rows][:, None]
            out[a:b] = np.logical_or.reduceat(able, self.starts[a:b] - self.starts[a], axis=0)
        return out

    def bound(self, rows: slice | np.ndarray) -> np.ndarray:
        """What a product in single precision must reach to be looked at."""
        return (self.need[rows] - self.slack).astype(np.float32)

    def take(self, rows: np.ndarray, other: _Side, targets: np.ndarray) -> None:
        for at in range(0, len(rows), HITS):
            i, j = rows[at : at + HITS], targets[at : at + HITS]
            sim = np.round(np.einsum("ij,ij->i", self.m[i], other.m[j]), DIGITS) + 0.0
            good = (sim >= self.need[i]) & (self.rep[i] != other.rep[j])
            self.held.append((i[good], other.rep[j[good]], sim[good]))
            self.pending += int(good.sum())
            if self.pending > max(HITS, self.k * len(self.rep)):
                self.shrink()

    def shrink(self) -> None:
        """Keep the k best targets of each row; the last of them raises its bound."""
        if not self.held:
            return
        rows, targets, sim = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((targets, -sim, rows))
        rows, targets, sim = rows[order], targets[order], sim[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
        last = place == self.k - 1
        self.need[rows[last]] = np.maximum(self.need[rows[last]], sim[last])
        kept = place < self.k
        self.held, self.pending = [(rows[kept], targets[kept], sim[kept])], 0

    def found(self) -> list[np.ndarray]:
        self.shrink()
        rows, targets, sim = self.held[0] if self.held else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return [self.rep[rows], targets, sim]


def _hits(sims: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that reach the bound. They are few, so eight marks are looked at together first."""
    marks = (sims >= bound).ravel()
    last = len(marks) // 8 * 8
    some = np.flatnonzero(marks[:last].view(np.uint64) != 0)
    spots = (some[:, None] * 8 + np.arange(8))[marks[:last].reshape(-1, 8)[some]]
    return np.divmod(np.r_[spots, last + np.flatnonzero(marks[last:])], sims.shape[1])


def _meet(left: _Side, right: _Side | None) -> None:
    """Compare the blocks of two tiles that reach each other, or those of one tile."""
    other = left if right is None else right
    wanted = left.reaches(other)
    if right is not None:
        wanted |= right.reaches(left).T
    sizes = other.stops - other.starts
    for a, b in left.blocks():
        rows = slice(left.starts[a], left.stops[b - 1])
        cols = np.flatnonzero(np.repeat(wanted[a:b].any(axis=0), sizes))
        for at in range(0, len(cols), CHUNK):
            part = cols[at : at + CHUNK]
            sims = left.single[rows] @ other.single[part].T
            i, j = _hits(sims, left.bound(rows)[:, None])
            left.take(i + rows.start, other, part[j])
            if right is not None:
                i, j = _hits(sims, right.bound(part))
                right.take(part[j], left, i + rows.start)


def _search(entries: DataFrame, k: int, floor: float | None, block: int) -> DataFrame:
    """(source, target, sim): the k nearest other entries of each entry; ``rep`` is its number."""
    n = entries.count()
    placed, pivots, count = _cells(entries, "long", n, block)
    shared = entries.sparkSession.sparkContext.broadcast(pivots)

    def at_home(rows: pa.Table) -> pa.Table:
        m, reps = _scaled(_matrix(rows.column("vec"))), rows.column("rep").to_numpy()
        found = pa.Table.from_pandas(_compare(reps, m, reps, m, k, floor), preserve_index=False)
        angles = _angles(m, shared.value)
        spans = {"block": rows.column("block")[:1], "near": pa.array([angles.min(axis=0)]), "far": pa.array([angles.max(axis=0)])}
        return pa.concat_tables([found, pa.table(spans)], promote_options="default")

    home = cut(placed.groupBy("block").applyInArrow(at_home, f"{SCHEMA}, block int, near array<double>, far array<double>"))
    found = home.where("block IS NULL").select("source", "target", "sim")
    if count <= 1:
        return found
    known = found.unionByName(_bucket_bounds(placed, k, floor, max(block, BLOCK))).groupBy("source", "target").agg(F.min("sim").alias("sim"))
    best = F.sort_array(F.collect_list("sim"), asc=False)  # at most (1 + TABLES) * k of each source
    bound = known.groupBy("source").agg(F.try_element_at(best, F.lit(k)).alias("worst"))
    lowest = -1.0 if floor is None else float(floor)
    need = F.greatest(F.coalesce(F.col("worst"), F.lit(lowest)), F.lit(lowest))
    queries = cut(placed.join(bound, placed["rep"] == bound["source"], "left").select("rep", "vec", "block", "cell", "angle", need.alias("need")))
    spans = home.where("block IS NOT NULL").select("block", "near", "far").join(queries.groupBy("block").agg(F.min("need").alias("need")), "block")
    rings = queries.groupBy("block", "cell").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    own = rings.select(F.col("block").alias("home"), F.col("block").alias("target"))
    width = max(1, TILE * BLOCK // block)  # blocks in a tile
    width = max(width, min(WIDE * width, -(-count // TILES)))
    tile = lambda c: F.floor(F.col(c) / width).cast("int")
    visits = block_pairs(rings, spans).unionByName(own)
    visits = visits.select("home", "target", F.least(tile("home"), tile("target")).alias("a"), F.greatest(tile("home"), tile("target")).alias("b"))
    ends = cut(visits.select("a", "b", F.explode(F.array("home", "target")).alias("block")).distinct())  # blocks x tiles at most
    sent = queries.join(ends, "block")
    left, right = sent.where(tile("block") == F.col("a")), sent.where((tile("block") == F.col("b")) & (F.col("a") < F.col("b")))

    right = right.toDF(*[f"{c}_b" for c in right.columns])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = [_Side(rows, k, shared.value) for rows in (left, right.rename_columns(left.column_names)) if rows.num_rows]
        if sides:
            _meet(sides[0], sides[1] if len(sides) > 1 else None)
        parts = [side.found() for side in sides] or [[np.zeros(0, int), np.zeros(0, int), np.zeros(0)]]
        source, target, sim = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table({"source": pa.array(source, pa.int64()), "target": pa.array(target, pa.int64()), "sim": sim})

    met = by_key(left, "a", "b").groupBy("a", "b").cogroup(by_key(right, "a_b", "b_b").groupBy("a_b", "b_b")).applyInArrow(meet, SCHEMA)
    return top_per_key(met, ["source"], [F.desc("sim"), F.asc("target")], k).drop("rank")


def nearest(vectors: DataFrame, key: str, k: int = 5, floor: float | None = None, block: int = BLOCK) -> DataFrame:
    """(source, target, rank, cosine_similarity): the k nearest other rows of every row.

    ``vectors`` is (key, vec), key unique. Ranks follow the rounded similarity, then the target key.
    With ``floor``, neighbours below it are left out, which prunes the search further.
    """
    vectors = cut(vectors.select(key, unit("vec").alias("vec")))
    members, entries = _distinct(vectors, key)
    entries = cut(entries)
    numbers = consecutive_ids(entries, "code", F.col("rep"), F.col("code"), out="no")
    entries = cut(entries.join(numbers, "code").select(F.col("no").alias("rep"), "code", "vec"))
    found = _search(entries, k, floor, block)
    zero = F.forall("vec", lambda x: x == 0)
    itself = entries.select(F.col("rep").alias("source"), F.col("rep").alias("target"), F.when(zero, F.lit(0.0)).otherwise(F.lit(1.0)).alias("sim"))
    if floor is not None:
        itself = itself.where(F.col("sim") >= floor)
    # A target entry stands for its copies; only the smallest k + 1 keys of it can be among the best.
    copies = top_per_key(members, ["code"], [F.asc(key)], k + 1)
    copies = copies.join(entries.select("code", "rep"), "code").groupBy("rep").agg(F.collect_list(key).alias("keys"))
    wide = found.unionByName(itself).join(copies.withColumnRenamed("rep", "target"), "target")
    options = wide.select("source", "sim", F.explode("keys").alias("target"))
    best = top_per_key(options, ["source"], [F.desc("sim"), F.asc("target")], k + 1)
    lists = best.groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("minus"), F.col("target").alias("target")))).alias("near")
    )
    lists = entries.select("code", F.col("rep").alias("source")).join(lists, "source").select("code", "near")
    rows = lookup(members, cut(lists), "code")
    near = F.slice(F.filter("near", lambda x: x["target"] != F.col(key)), 1, k)
    flat = rows.select(F.col(key).alias("source"), F.posexplode(near).alias("pos", "x"))
    return flat.select("source", F.col("x.target").alias("target"), (F.col("pos") + 1).alias("rank"), (-F.col("x.minus")).alias("cosine_similarity"))


def neighbour_table(corpus: DataFrame, near: DataFrame) -> DataFrame:
    """Neighbours with titles, dates, clusters, operation names and the day gap of both ends.

    An article is the source of at most k rows but may be the target of very many, hence the lookup.
    """
    side = lambda end: corpus.select(
        F.col("link").alias(f"{end}_link"), F.col("titulo").alias(f"{end}_titulo"),
        F.col("data_publicacao_dt").alias(f"{end}_data"), F.col("cluster_id").alias(f"{end}_cluster_id"),
        F.col("nome_operacao").alias(f"{end}_operation_name"),
    )
    ends = near.select(F.col("source").alias("source_link"), F.col("target").alias("target_link"), "rank", "cosine_similarity")
    joined = lookup(cut(ends.join(side("source"), "source_link")), side("target"), "target_link")
    return joined.select(
        "source_link", "source_titulo", "source_data", "target_link", "target_titulo", "target_data", "rank",
        "cosine_similarity", "source_cluster_id", "target_cluster_id", "source_operation_name", "target_operation_name",
        (F.col("source_cluster_id") == F.col("target_cluster_id")).alias("same_cluster"),
        gap_days("source_data", "target_data").alias("gap_days"),
    )


def recurs(threshold: float = 0.70, strict: float = 0.90, min_gap: int = 30) -> Column:
    """Whether a neighbour row is a recurrence: far apart in time, same cluster, and very similar or of one operation."""
    sim, name = F.col("cosine_similarity"), F.col("source_operation_name")
    same_name = (F.coalesce(name, F.lit("")) != "") & (name == F.col("target_operation_name")) & (sim >= threshold)
    alike = (sim >= max(threshold, strict)) | F.coalesce(same_name, F.lit(False))
    return (F.coalesce("gap_days", F.lit(0)) >= min_gap) & F.coalesce("same_cluster", F.lit(False)) & alike


def unique_pairs(pairs: DataFrame) -> DataFrame:
    """One row per unordered pair: the most similar, then the widest gap, then the smaller source."""
    keyed = pairs.withColumns({"__a": F.least("source_link", "target_link"), "__b": F.greatest("source_link", "target_link")})
    order = [F.desc("cosine_similarity"), F.desc("gap_days"), F.asc("source_link")]
    return one_per_key(keyed, ["__a", "__b"], order).drop("__a", "__b")


def recurring_pairs(neighbours: DataFrame, threshold: float = 0.70, strict: float = 0.90, min_gap: int = 30) -> DataFrame:
    kept = unique_pairs(neighbours.where(recurs(threshold, strict, min_gap)))
    return kept.orderBy(F.desc("cosine_similarity"), F.desc("gap_days"), "source_link", "target_link")


def top_pairs(neighbours: DataFrame, floor: float = 0.80, k: int = 10) -> DataFrame:
    pairs = unique_pairs(neighbours.where(F.col("cosine_similarity") >= floor))
    return pairs.orderBy(F.desc("cosine_similarity"), F.desc("gap_days"), "source_link", "target_link").limit(k)


def pairs_of(pairs: DataFrame, link: str, k: int = 20) -> DataFrame:
    """The k best pairs with the link at either end."""
    rows = pairs.where((F.col("source_link") == link) | (F.col("target_link") == link))
    return rows.orderBy(F.desc("cosine_similarity"), F.desc("gap_days"), "source_link", "target_link").limit(k)
