"""Scoring of texts by a hierarchical Pitman-Yor language model.

Restaurants: one per context, whose parent is the unigram restaurant, whose base is uniform over the known tokens and
one unknown. The context of a token is the token before it, the beginning of a text has a context too: there are as many
restaurants as the corpus has token types.

Seating: a dish (word) in a restaurant is kept as its customers c and tables t. A Gibbs sweep takes all customers of a
dish away and seats them anew given all other dishes: up to ``EXACT`` customers the number of tables is drawn from its
exact conditional (by generalised Stirling numbers), further customers sit down one small group after another. All
words are resampled in parallel, each sweep with the table totals of the sweep before. After ``BURN`` sweeps the
predictive probabilities of ``SAMPLES`` sweeps are averaged.

Moves: each piece of the input is cut by word into packed columns, once for counting (learned pairs only) and once for
scoring (with the texts they stand in); nothing of it is stored. All counts of a word meet in one part; words of at least
``HOT_SHARE`` of a piece (at most 1 / HOT_SHARE) are dealt out by word and context, and meet in one number per part and
sweep. What a part has counted is one row of a table in buckets by part, which every sweep reads in place: only messages
are shuffled. The totals of a context are summed up in ``rooms``: every part sends the tables of its contexts there and is
told the sums in the same order. The input is read three times, so it must read the same each time.

Defined results: a null text is empty (its only token is the end); words are told apart by 64-bit hashes, contexts by so
many bits (``context_bits``) that fewer than one in ten thousand is expected to share a restaurant by chance; with no
training row every token is unknown; repeated rows are scored alike and each counts in training; an empty table gives
no rows; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsatlas.llm.frames import query, remainder, table
from newsatlas.llm.words import ODD, mixed, pieces, words
from newsatlas.session import cut, scratch_dir

HOT_SHARE = 0.001
BURN, SAMPLES = 2, 3
EXACT = 40
STRENGTH = 1.0
SEED = 4
PIECE = 5 << 20
PIECE_ROWS = 1 << 15
PART_TOKENS = 4 << 20  # tokens that one part of the words should hold
ROOM_PARTS = 8  # parts for each room
END = xxhash.xxh64_intdigest(b"")  # no word is empty; as a context the beginning of a text
LN10 = np.log(10)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value: a line of types and lengths, then the bytes."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays)
    body = b"".join(a.tobytes() for a in arrays)
    return f"{head};{len(body)}\n".encode("ascii") + pa.Codec("zstd").compress(body, asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    head, _, body = bytes(data).partition(b"\n")
    *kinds, size = head.decode("ascii").split(";")
    body, at, out = pa.Codec("zstd").decompress(body, int(size), asbytes=True), 0, []
    for kind in kinds:
        dtype, _, count = kind.partition(",")
        out.append(np.frombuffer(body, dtype, int(count), at))
        at += out[-1].nbytes
    return out


def small(values: np.ndarray) -> np.ndarray:
    """The same whole numbers (0 and up) in the narrowest type."""
    return values.astype(np.min_scalar_type(int(values.max()))) if len(values) else values.astype(np.uint8)


def delta(values: np.ndarray) -> np.ndarray:
    """Ascending whole numbers as differences, in the narrowest type."""
    return small(np.diff(values, prepend=values[:1] * 0))


def ascending(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=np.uint64)


def context_bits(tokens: int) -> int:
    """Two of n contexts share the low b bits of their hashes with a chance of n / 2**b, and n is at most the tokens."""
    return min(63, 14 + tokens.bit_length())


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token and the number of its text, each text closed by its end, and the number of tokens of each text."""
    found = words(column, lower=True)
    lengths = np.diff(found.bounds) + 1
    last = np.cumsum(lengths) - 1
    total = int(lengths.sum())
    word = np.ones(total, bool)
    word[last] = False
    hashes = np.full(total, END, np.uint64)
    if len(found.names):
        hashes[word] = found.name_hashes()[found.ids]
    return hashes, np.repeat(np.arange(len(lengths)), lengths), lengths


def index(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Position of each value, or -1."""
    if not len(sorted_values):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return np.where(sorted_values[at] == values, at, -1)


def numbered(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The pieces of a task's input, numbered alike whenever it is read."""
    first = TaskContext.get().partitionId() << 24
    for i, piece in enumerate(pieces(batches, text, PIECE, PIECE_ROWS)):
        yield first + i, piece


def frequent(docs: DataFrame, key: str, text: str) -> tuple[np.ndarray, int, DataFrame]:
    """Hot words (ascending hashes), the number of tokens, and (piece, data, ids): the lengths and keys of each piece.

    A word that holds a share of all tokens holds that share of some piece, so only such words are counted.
    """
    ids = T.ArrayType(docs.schema[key].dataType)
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("word", "n", "piece")] + [T.StructField("data", T.BinaryType()), T.StructField("ids", ids)])
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece in numbered(batches, text):
            hashes, _, lengths = tokens(piece.column(text))
            seen, n = np.unique(hashes, return_counts=True)
            some = n >= HOT_SHARE * len(hashes)
            rows = [{"word": w, "n": c} for w, c in zip(seen[some].view(np.int64).tolist(), n[some].tolist())]
            head = {"n": len(hashes), "piece": number, "data": packed(small(lengths)), "ids": piece.column(key).to_pylist()}
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in schema.names} for r in [*rows, head]], arrow_schema)

    found = cut(docs.mapInArrow(run, schema))
    heads = found.where("piece IS NOT NULL").select("piece", "data", "ids", "n")
    total = heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words_ = found.where("piece IS NULL").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_SHARE * total / 2)
    rows = words_.orderBy(F.desc("n"), "word").limit(int(1 / HOT_SHARE)).collect()
    hot = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    return np.sort(hot), total, heads.drop("n")


def dealt(docs: DataFrame, text: str, hot: np.ndarray, parts: int, bits: int, owners: bool) -> DataFrame:
    """(piece, part, data, owner): the tokens of each piece by part of the words; all with their texts, or the learned only.

    The words and all contexts, the number of contexts of each word, the context and the tokens of each such pair.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for number, piece in numbered(batches, text):
            hashes, owner, lengths = tokens(piece.column(text))
            seen, word = np.unique(hashes, return_inverse=True)
            context = np.empty_like(word)
            context[1:] = word[:-1]
            context[np.cumsum(lengths) - lengths] = index(seen, np.array([END], np.uint64))[0]
            part = mod(seen, parts)[word]
            split = np.flatnonzero((index(hot, seen) >= 0)[word])
            part[split] = mod(mixed(seen[word[split]] + seen[context[split]] * ODD), parts)
            pair = word * len(seen) + context
            learned = piece.column("__learn").to_numpy(zero_copy_only=False).astype(np.int64)[owner]
            order = np.argsort(pair, kind="stable")
            order = order[np.argsort(small(part[order]), kind="stable")]
            part, pair, word, context, owner, learned = (x[order] for x in (part, pair, word, context, owner, learned))
            bounds = np.searchsorted(part, np.arange(parts + 1))
            names_of_contexts = seen & np.uint64((1 << bits) - 1)
            rows = []
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                i, j = bounds[p : p + 2]
                first = np.flatnonzero(np.r_[True, pair[i + 1 : j] != pair[i : j - 1]])
                rooms, place = np.unique(names_of_contexts[context[i:j][first]], return_inverse=True)  # also those of texts to score
                sizes = np.diff(np.r_[first, j - i]) if owners else np.add.reduceat(learned[i:j], first)
                some = sizes > 0
                place, sizes = place[some], sizes[some]
                names, per_word = np.unique(word[i:j][first][some], return_counts=True)
                data = packed(seen[names], delta(rooms), small(per_word), small(place), small(sizes))
                rows.append((number, p, data, packed(owner[i:j].astype(np.uint16)) if owners else None))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(("piece", "part", "data", "owner"), r)) for r in rows], arrow_schema)

    schema = T.StructType([T.StructField("piece", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("owner", T.BinaryType())])
    arrow_schema = to_arrow_schema(schema)
    return docs.mapInArrow(run, schema)


def mod(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


MESSAGE = "part int, room int, data binary, hashes binary, sums array<double>"  # room -1: what the part keeps


def messages(part: int, rooms: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """A row for each room; ``rooms``: number of contexts of the part by room, the columns are in this order."""
    ends = np.cumsum(rooms)
    return [(part, r, packed(*[small(c[ends[r] - rooms[r] : ends[r]]) for c in columns]), None, None) for r in np.flatnonzero(rooms).tolist()]


def stepwise(values: np.ndarray, rooms: np.ndarray) -> np.ndarray:
    """Values that ascend within each room as differences, the first of a room in full."""
    out = np.diff(values, prepend=values[:1] * 0)
    starts = (np.cumsum(rooms) - rooms)[rooms > 0]
    out[starts] = values[starts]
    return out


def bucketed(rows: DataFrame, parts: int) -> DataFrame:
    """A table in the shared folder with a bucket for each part: grouping by part reads it in place."""
    name, path = f"parts_{uuid.uuid4().hex}", scratch_dir(rows.sparkSession, "parts")
    rows.write.bucketBy(parts, "part").option("path", path).format("parquet").saveAsTable(name)
    return rows.sparkSession.table(name)


def counts(dealt: DataFrame, hot: np.ndarray, rooms: int, parts: int) -> DataFrame:
    """What each part keeps (its words; its contexts by room; its pairs of them and their customers), and messages.

    A pair is word * number of contexts + context. Messages have the hashes, customers and words of the contexts.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        blocks = [unpacked(data) for data in group["data"]]
        blocks = [(b[0], ascending(b[1]), *b[2:]) for b in blocks]
        every = np.unique(np.concatenate([b[1] for b in blocks]))
        room = mod(every, rooms)
        order = np.argsort(room, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        found, place, n = [], [], []
        for names, contexts, per_word, context, sizes in blocks:  # a context that is only asked for has no customers here
            found.append(np.repeat(names, per_word))
            place.append(rank[np.searchsorted(every, contexts)][context])
            n.append(sizes.astype(np.int64))
        names, word = np.unique(np.concatenate(found), return_inverse=True)
        code, at = np.unique(word * len(every) + np.concatenate(place), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate(n), minlength=len(code)).astype(np.int64)
        context, word = code % len(every), code // len(every)
        customers, types = np.bincount(context, weights=c, minlength=len(every)).astype(np.int64), np.bincount(context, minlength=len(every))
        per_room = np.bincount(room, minlength=rooms)
        of_word, n_word = np.bincount(word, minlength=len(names)), np.bincount(word, weights=c, minlength=len(names))
        h = index(hot, names)
        cold = of_word[h < 0]
        sums = [c.sum(), len(cold), (c == 1).sum(), (c == 2).sum(), (cold == 1).sum(), (cold == 2).sum()]
        sums = np.r_[sums, np.bincount(h[h >= 0], weights=n_word[h >= 0], minlength=len(hot)), np.bincount(h[h >= 0], weights=of_word[h >= 0], minlength=len(hot))]
        hashes = every[order]
        kept = (part, -1, packed(small(of_word), small(context), small(c), h.astype(np.int16), small(per_room)), packed(names, hashes), sums.astype(float).tolist())
        return pd.DataFrame([kept, *messages(part, per_room, stepwise(hashes, per_room), customers, types)], columns=COLUMNS)

    return bucketed(dealt.select("part", "data").groupBy("part").applyInPandas(run, MESSAGE), parts)


COLUMNS = ["part", "room", "data", "hashes", "sums"]


def met(sent: DataFrame) -> DataFrame:
    """(part, room, data): the place of each context in its room, its customers and words (or its tables), over all parts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        got = [unpacked(data) for data in group["data"]]
        ends = np.cumsum([len(g[0]) for g in got])[:-1]
        if len(got[0]) == 3:
            _, at = np.unique(np.concatenate([ascending(g[0]) for g in got]), return_inverse=True)
            sums = [np.bincount(at, weights=np.concatenate([g[k] for g in got]))[at].astype(np.int64) for k in (1, 2)]
            told = zip(*[np.split(x, ends) for x in (at, *sums)])
            data = [packed(small(np.diff(at, prepend=0)), small(c), small(n)) for at, c, n in told]
        else:
            at = np.concatenate([np.cumsum(g[0], dtype=np.int64) for g in got])
            data = [packed(small(t)) for t in np.split(np.bincount(at, weights=np.concatenate([g[1] for g in got]))[at].astype(np.int64), ends)]
        return pd.DataFrame({"part": group["part"], "room": group["room"], "data": data})

    return cut(sent.where("room >= 0").select("part", "room", "data").groupBy("room").applyInPandas(run, "part int, room int, data binary"))


def answers(group: pd.DataFrame) -> list[np.ndarray]:
    """What the rooms told a part, in the order of its contexts; the first column of three are places as differences."""
    rows = group[group["no"] >= 0].sort_values("no")["data"]
    return [np.concatenate(x).astype(np.int64) for x in zip(*map(unpacked, rows))]


def log_stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers for up to ``most`` customers."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[0, 0] = 0
    for c in range(most):
        seats = np.maximum(c - discount * np.arange(most + 1), 0)
        with np.errstate(divide="ignore"):
            stay = table[c] + np.log(seats)
        table[c + 1] = stay
        table[c + 1, 1:] = np.logaddexp(stay[1:], table[c, :-1])
    return table


def seated(c: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its c customers were seated anew; ``others``: tables of the other dishes there."""
    t = np.minimum(c, 1).astype(np.int64)
    small = np.minimum(c, EXACT)
    for n in np.unique(small[small > 1]).tolist():
        rows = np.flatnonzero(small == n)
        step = max(1, (1 << 20) // n)
        for at in range(0, len(rows), step):
            r = rows[at : at + step]
            open_table = np.log(STRENGTH + discount * (others[r, None] + np.arange(n))) + np.log(base[r, None])
            logits = stirling[n, 1 : n + 1] + np.cumsum(open_table, axis=1)
            weights = np.cumsum(np.exp(logits - logits.max(axis=1, keepdims=True)), axis=1)
            t[r] = 1 + (weights < rng.random(len(r))[:, None] * weights[:, -1:]).sum(axis=1)
    rows = np.flatnonzero(c > EXACT)
    sitting = np.full(len(rows), EXACT, np.int64)
    while len(rows):
        group = np.minimum(np.maximum(1, sitting // 20), c[rows] - sitting)
        opening = (STRENGTH + discount * (others[rows] + t[rows])) * base[rows]
        t[rows] += rng.binomial(group, np.clip(opening / (opening + sitting - discount * t[rows]), 0, 1))
        sitting += group
        left = sitting < c[rows]
        rows, sitting = rows[left], sitting[left]
    return t


class Totals:
    """What all parts share: per context its customers and tables, and the same of the unigram restaurant (last)."""

    def __init__(self, contexts: int, tokens: int, known: int, discount: tuple[float, float]):
        self.contexts, self.tokens, self.known, self.discount = contexts, tokens, known, discount
        self.customers, self.tables = np.zeros(contexts + 1), np.zeros(contexts + 1)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        d = self.discount[1]
        spare = (STRENGTH + d * self.tables[-1]) / (self.known + 1)
        return (customers - d * tables + spare) / (STRENGTH + self.customers[-1])

    def predict(self, context: np.ndarray, customers: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        d = self.discount[0]
        return (customers - d * tables + (STRENGTH + d * self.tables[context]) * parent) / (STRENGTH + self.customers[context])


class Hot:
    """Hot words: their tokens, customers and tables in the unigram restaurant."""

    def __init__(self, tokens: np.ndarray, customers: np.ndarray):
        self.tokens, self.customers, self.tables = tokens, customers, np.minimum(tokens, 1)


def added(rows: DataFrame) -> np.ndarray:
    """The sum of all arrays ``sums``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [np.sum(group["sums"].tolist(), axis=0).tolist()]})

    some = rows.where("sums is not null").select((F.col("part") % 16).alias("g"), "sums").groupBy("g").applyInPandas(run, "sums array<double>").collect()
    return np.sum([r["sums"] for r in some], axis=0) if some else np.zeros(0)


def rowed(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select("part", F.lit(kind).alias("kind"), F.col("room").cast("long").alias("no"), "data", F.lit(None).cast("binary").alias("owner"))


def seats(kept: bytes) -> tuple[np.ndarray, ...]:
    """Word, context and customers of each pair, place of each word among the hot ones or -1, contexts by room."""
    of_word, context, c, h, per_room = unpacked(kept)
    return np.repeat(np.arange(len(of_word)), of_word), context.astype(np.int64), c.astype(np.int64), h.astype(np.int64), per_room.astype(np.int64)


def local(totals: Totals, customers: np.ndarray, tables: np.ndarray) -> Totals:
    """The totals with the contexts of one part."""
    out = Totals(len(customers), totals.tokens, totals.known, totals.discount)
    out.customers, out.tables = np.r_[customers, totals.customers[-1]], np.r_[tables, totals.tables[-1]]
    return out


def parents(totals: Totals, hot: Hot, h: np.ndarray, word: np.ndarray, t: np.ndarray, t0: np.ndarray) -> np.ndarray:
    """Probability of each word of a part in the unigram restaurant."""
    customers, tables = np.bincount(word, weights=t, minlength=len(h)), t0.astype(float)
    customers[h >= 0], tables[h >= 0] = hot.customers[h[h >= 0]], hot.tables[h[h >= 0]]
    return totals.parent(customers, tables)


def sweep(kept: DataFrame, directory: DataFrame, before: tuple[DataFrame, DataFrame] | None, totals: Totals, hot: Hot, number: int) -> tuple[DataFrame, DataFrame, Totals, Hot]:
    """One Gibbs sweep over all parts: the new tables of the parts and of the contexts, and the new totals."""
    shared = kept.sparkSession.sparkContext.broadcast((totals, hot))
    rows = rowed(directory, "place")
    for frame, kind in zip(before or (), ("tables", "context")):
        rows = rows.unionByName(rowed(frame, kind))

    def run(own: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        totals, hot = shared.value
        part, of = int(own["part"].iloc[0]), {k: g for k, g in group.groupby("kind")}
        rng = np.random.default_rng([SEED, number, part])
        word, context, c, h, per_room = seats(own["data"].iloc[0])
        place, customers, tables = answers(of["place"])
        if "tables" in of:
            (tables,) = answers(of["context"])
            t, t0 = (x.astype(np.int64) for x in unpacked(of["tables"]["data"].iloc[0]))
        else:
            t, t0 = np.ones(len(c), np.int64), np.ones(len(h), np.int64)
        total = local(totals, customers, tables)
        stirling = [log_stirling(d, EXACT) for d in total.discount]
        parent = parents(total, hot, h, word, t, t0)
        t = seated(c, np.maximum(total.tables[context] - t, 0), parent[word], total.discount[0], stirling[0], rng)
        served = np.bincount(word, weights=t, minlength=len(h)).astype(np.int64)
        cold = h < 0
        others = np.maximum(total.tables[-1] - t0[cold], 0)
        t0 = np.zeros(len(h), np.int64)
        t0[cold] = seated(served[cold], others, np.full(cold.sum(), 1 / (total.known + 1)), total.discount[1], stirling[1], rng)
        sums = np.r_[served.sum(), t0.sum(), np.bincount(h[~cold], weights=served[~cold], minlength=len(hot.tokens))]
        mine = np.bincount(context, weights=t, minlength=len(customers)).astype(np.int64)
        return pd.DataFrame([(part, -1, packed(small(t), small(t0)), None, sums.tolist()), *messages(part, per_room, place, mine)], columns=COLUMNS)

    done = cut(kept.select("part", "data").groupBy("part").cogroup(rows.groupBy("part")).applyInPandas(run, MESSAGE))
    new, new_hot = Totals(0, totals.tokens, totals.known, totals.discount), Hot(hot.tokens, hot.customers)
    sums = added(done)
    if len(sums):
        new_hot.customers = sums[2:]
        rng, d = np.random.default_rng([SEED, number, 1 << 31]), totals.discount[1]
        others = np.maximum(totals.tables[-1] - hot.tables, 0)
        new_hot.tables = seated(sums[2:].astype(np.int64), others, np.full(len(others), 1 / (totals.known + 1)), d, log_stirling(d, EXACT), rng)
        new.customers, new.tables = sums[:1], sums[1:2] + new_hot.tables.sum()
    return done.where("room = -1"), met(done), new, new_hot


def fitted(dealt: DataFrame, hot: np.ndarray, parts: int) -> tuple[DataFrame, DataFrame, list[tuple[Totals, Hot]]]:
    """The counts of each part; rows (part, kind, no, data, owner) of the directory and of the sampled tables; the totals of each sample."""
    state = counts(dealt, hot, -(-parts // ROOM_PARTS), parts)
    kept, directory = state.where("room = -1"), met(state)
    sums = added(kept)
    if not len(sums):
        sums = np.zeros(6 + 2 * len(hot))
    n_hot, types = sums[6:].reshape(2, -1)
    tokens, known, *n = sums[:6] + [0, (n_hot > 0).sum(), 0, 0, (types == 1).sum(), (types == 2).sum()]
    d = [float(np.clip(a / (a + 2 * b), 0.1, 0.95)) if a + b else 0.5 for a, b in (n[:2], n[2:])]
    totals, of_hot = Totals(0, int(tokens), int(known), tuple(d)), Hot(n_hot, types)
    totals.customers[-1] = totals.tables[-1] = known
    before, samples, out = None, [], rowed(directory, "place")
    for number in range(BURN + SAMPLES):
        *before, totals, of_hot = sweep(kept, directory, before, totals, of_hot, number)
        if number >= BURN:
            for frame, kind in zip(before, ("tables", "context")):
                out = out.unionByName(rowed(frame, f"{kind}{len(samples)}"))
            samples.append((totals, of_hot))
    return kept, out, samples


def score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row; the model learns where ``learn`` holds."""
    spark = docs.sparkSession
    docs = docs.select(key, text, F.coalesce(learn, F.lit(False)).alias("__learn"))
    hot, total, heads = frequent(docs, key, text)
    parts, bits = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_TOKENS)), context_bits(total)
    kept, model, samples = fitted(dealt(docs, text, hot, parts, bits, False), hot, parts)
    tokens, known = samples[0][0].tokens, samples[0][0].known
    sent = spark.sparkContext.broadcast(samples)

    def base(n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.1) / (tokens + 0.1 * (known + 1)))

    def of_part(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        of = {k: g for k, g in rows.groupby("kind")}
        if "piece" not in of:
            return pd.DataFrame({"piece": [], "data": []})
        group = of["piece"]
        word, context, c, h, _ = seats(own["data"].iloc[0])
        names, hashes = unpacked(own["hashes"].iloc[0])
        _, customers, _ = answers(of["place"])
        n_word = np.r_[np.bincount(word, weights=c, minlength=len(names)), 0]
        n_word[:-1][h >= 0] = sent.value[0][1].tokens[h[h >= 0]]
        code, by = word * len(hashes) + context, np.argsort(hashes)
        fitted = []
        for i, (totals, hot_) in enumerate(sent.value):
            t, t0 = (x.astype(np.int64) for x in unpacked(of[f"tables{i}"]["data"].iloc[0]))
            total = local(totals, customers, *answers(of[f"context{i}"]))
            parent = np.r_[parents(total, hot_, h, word, t, t0), total.parent(np.zeros(1), np.zeros(1))]
            fitted.append((total, np.r_[t, 0], parent))
        c = np.r_[c, 0]
        out = []
        for piece, data, owner in zip(group["no"], group["data"], group["owner"]):
            seen, rooms, per_word, place, sizes = unpacked(data)
            (owner,) = unpacked(owner)
            w, u = np.repeat(index(names, seen), per_word), by[np.searchsorted(hashes[by], ascending(rooms))][place]
            missing = np.flatnonzero((w < 0) & (index(hot, np.repeat(seen, per_word)) >= 0))
            entry = np.where(w >= 0, index(code, w * len(hashes) + u), -1)
            p, n = np.zeros(len(w)), n_word[w]
            if len(missing):  # a hot word that other parts have learned
                at = index(hot, np.repeat(seen, per_word)[missing])
                n[missing] = sent.value[0][1].tokens[at]
            for (total, t, parent), (_, hot_) in zip(fitted, sent.value):
                above = parent[w]
                if len(missing):
                    above[missing] = total.parent(hot_.customers[at], hot_.tables[at])
                p += total.predict(u, c[entry], t[entry], above)
            p = np.log10(p / len(fitted))
            docs = np.unique(owner)
            at = np.searchsorted(docs, owner)
            sums = [np.bincount(at, weights=np.repeat(x, sizes), minlength=len(docs)) for x in (n > 0, base(n), p)]
            out.append((piece, packed(docs, *sums)))
        return pd.DataFrame(out, columns=["piece", "data"])

    asked = dealt(docs, text, hot, parts, bits, True).select("part", F.lit("piece").alias("kind"), F.col("piece").alias("no"), "data", "owner")
    rows = asked.unionByName(model)  # the pieces come first, so that their tasks keep the numbers of the input's partitions
    partial = kept.select("part", "data", "hashes").groupBy("part").cogroup(rows.groupBy("part")).applyInPandas(of_part, "piece long, data binary")
    both = partial.select("piece", "data", F.lit(None).cast(heads.schema["ids"].dataType).alias("ids")).unionByName(heads)
    kind = heads.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        is_head = group["ids"].notna()
        head = group[is_head].iloc[0]
        (lengths,) = unpacked(head["data"])
        known, first, second = np.zeros((3, len(lengths)))
        for data in sorted(group["data"][~is_head]):  # the sums don't depend on the order of arrival
            docs, *sums = unpacked(data)
            for total, part in zip((known, first, second), sums):
                total[docs] += part
        return pd.DataFrame({key: list(head["ids"]), "n_tokens": lengths, "n_known": known.astype(np.int64), "train_tokens": tokens, "base_score": first, "score": second})

    return both.groupBy("piece").applyInPandas(whole, schema)


@query("op4_lm_scoring")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 10) == 0
    scored = score(docs, ~held_out)
    return scored.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
