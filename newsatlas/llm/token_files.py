"""Token ids of all documents as ORC files.

Layout: one row per document, in ascending order of the id over all files: the id, the number of the file, the place of
the document's first token in its file, the number of its tokens, and the tokens themselves, closed by the end id. ORC
stores whole numbers run-length encoded; every stripe has an index of rows with the least and greatest ids and a Bloom
filter of the ids. So a scan is split by stripes, and a search for ids reads only the row groups that may hold them.
Places are relative to the file, so that files are written independently; sums over one row per file make them global.

Encoding: a byte-level tokenizer never joins what stands on both sides of certain borders, such as that in front of a
blank and a visible character. Texts are cut there, and equal cuttings are encoded once: a blank and letters by the
tokenizer's model directly, since its pattern would leave them whole, all others glued to long texts. Then the ids are
put together again. With any other kind of tokenizer whole texts are encoded.

Defined results: a null or empty text has the end id alone; strings of special tokens are ordinary text; a null id comes
before all others; rows of equal ids are ordered by their text's hash; repeated rows are encoded each; an empty table
gives files without rows; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsatlas.llm.frames import query, table
from newsatlas.llm.words import Words, pieces, slices, utf8
from newsatlas.session import scratch_dir

END = 0
FILE_BYTES = 32 << 20  # of text in a file
STRIPE_BYTES = 8 << 20
STRIPE_CHECK = 100  # rows after which a stripe's size is looked at, as documents may be long
ROW_GROUP = 1000  # rows under an index entry and its Bloom filter
FALSE_HITS = 0.01
CACHE = 400_000  # cuttings that a worker process remembers
GROUP = 1000  # files whose sums are added up in one task

GLUED = 4000  # cuttings that are encoded as one text

#: Bytes that surely begin or end a visible character: ASCII, and leads of blocks that hold no white space.
VISIBLE = np.array([0x21 <= b <= 0x7E or 0xC3 <= b <= 0xDF or 0xE4 <= b <= 0xF4 for b in range(256)])
LATER = 0xD4  # lead byte of U+0500 and above, where versions of Unicode may tell letters apart differently
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
STOP = np.isin(np.arange(256), list(b".,;:!?"))


def borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks bytes that begin a cutting: starts of texts, a blank before a visible character, a stop after a letter, and a
    single line break between visible characters together with what follows it."""
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    inner = ~first[1:-1]  # this byte and the one before it are of one text
    cut_up = (data[1:] != 0x20) | ~VISIBLE[np.r_[data[2:], 0]][: len(data) - 1] | first[2:]
    first[1:-1] |= inner & ~cut_up
    first[1:-1] |= inner & STOP[data[1:]] & LETTER[data[:-1]]
    broken = 1 + np.flatnonzero((data[1:-1] == 10) & VISIBLE[data[:-2]] & (data[:-2] < 0x7F) & VISIBLE[data[2:]] & inner[:-1] & inner[1:])
    first[broken] = first[broken + 1] = True
    return first[:-1]


def signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: visible Latin-1 for itself, then U+0100 onwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, each closed by the end id."""

    def __init__(self, definition: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}
        self.end = np.array([end], np.uint32).tobytes()
        parts = json.loads(definition)
        before = parts.get("pre_tokenizer") or {}
        self.separable = parts.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.model, self.signs = self.tokenizer.model, signs()
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a sign of a byte-level token is a byte
        self.lengths[list(vocabulary.values())] = [len(t) for t in vocabulary]

    def cuttings(self, column: pa.Array) -> Words:
        data, offsets = utf8(column)
        if self.separable and len(data) > 2:
            first = borders(data, offsets)
        else:
            first = np.zeros(len(data) + 1, bool)
            first[offsets] = True
            first = first[:-1]
        starts = np.flatnonzero(first)
        lengths = np.diff(np.r_[starts, len(data)])
        coded = slices(data, np.ones(len(data), bool), lengths).dictionary_encode()
        return Words(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.searchsorted(starts, offsets))

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def ids(self, names: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        new = [n for n in names if n not in self.known]
        led = [n for n in new if self.separable and len(n) > 1 and n[0] == 0x20 and VISIBLE[n[1]]]
        words = [n for n in led if max(n) < LATER and n[1:].decode("utf-8").isalpha()]
        tokenize, table = self.model.tokenize, self.signs
        self.known.update((n, array("I", [t.id for t in tokenize(n.decode("latin-1").translate(table))]).tobytes()) for n in words)
        led = [n for n in led if n not in self.known]
        for at in range(0, len(led), GLUED):
            part = led[at : at + GLUED]
            (found,) = self.texts([b"".join(part)])
            until, ends = np.cumsum(self.lengths[found]), np.cumsum([len(n) for n in part])
            stops = np.searchsorted(until, ends) + 1
            if not np.array_equal(until[stops - 1], ends):
                raise ValueError("a token crosses the border of two cuttings")
            raw = found.tobytes()
            self.known.update((n, raw[4 * a : 4 * b]) for n, a, b in zip(part, np.r_[0, stops[:-1]].tolist(), stops.tolist()))
        rest = [n for n in new if n not in self.known]
        self.known.update(zip(rest, (x.tobytes() for x in self.texts(rest))))
        return [self.known[n] for n in names]

    def encode(self, column: pa.Array) -> pa.ListArray:
        found = self.cuttings(column)
        parts = [*self.ids(found.names.to_pylist()), self.end]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begins = np.cumsum(sizes) - sizes
        order = np.insert(found.ids.astype(np.int64), found.bounds[1:], len(parts) - 1)  # the end behind each text
        lengths = sizes[order]
        stops = np.cumsum(lengths)
        at = np.repeat((begins[order] - (stops - lengths)).astype(np.int32), lengths)
        at += np.arange(len(at), dtype=np.int32)
        flat = np.frombuffer(b"".join(parts), np.uint32)[at]
        bounds = np.r_[0, stops[found.bounds[1:] + np.arange(len(column))]]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int32)))


@lru_cache(maxsize=1)
def encoder(definition: str, end: int = END) -> Encoder:
    """The encoder of a worker process, with what it remembers: later tasks of the process go on with it."""
    return Encoder(definition, end)


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END, file_bytes: int = FILE_BYTES) -> None:
    """Write the tokens of all documents; ``tokenizer`` is the file of its definition."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    files = max(spark.sparkContext.defaultParallelism, -(-total // file_bytes))
    row = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    arrow_row = to_arrow_schema(row)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = encoder(shared.value, end).encode, 0
        part = TaskContext.get().partitionId()
        for piece in pieces(batches, text):
            ids = encode(piece.column(text))
            n = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            first = before + np.cumsum(n) - n
            before += int(n.sum())
            columns = [piece.column(key), pa.array(np.full(len(n), part, np.int32)), pa.array(first), pa.array(n), ids]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow_row)], schema=arrow_row)

    order = [F.col(key).asc_nulls_first(), F.xxhash64(text), F.monotonically_increasing_id()]
    placed = docs.select(key, text, *[c.alias(f"__{i}") for i, c in enumerate(order[1:])])
    by = [order[0], "__0", "__1"]
    sorted_rows = placed.repartitionByRange(files, *by).sortWithinPartitions(*by).select(key, text)
    options = {
        "orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": str(ROW_GROUP), "orc.create.index": "true",
        "orc.rows.between.memory.checks": str(STRIPE_CHECK),
        "orc.bloom.filter.columns": key, "orc.bloom.filter.fpp": str(FALSE_HITS), "compression": "zstd",
    }
    sorted_rows.mapInArrow(run, row).write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, part, first, n_tokens, ids). Conditions on the key reach the indexes and Bloom filters."""
    return spark.read.orc(path)


def starts(files: DataFrame) -> DataFrame:
    """(part, __start): tokens of all files before each; one row per file, added up in groups of ``GROUP``."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("__n")).withColumn("__group", F.floor(F.col("part") / GROUP))
    group = totals.groupBy("__group").agg(F.sum("__n").alias("__all"))
    before = group.select("__group", (F.sum("__all").over(Window.orderBy("__group")) - F.col("__all")).alias("__before"))
    inside = F.sum("__n").over(Window.partitionBy("__group").orderBy("part")) - F.col("__n")
    return totals.withColumn("__inside", inside).join(before, "__group").select("part", (F.col("__before") + F.col("__inside")).alias("__start"))


def digests(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) from what the files hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            bounds, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(values[a:b].data) for a, b in zip(bounds[:-1], bounds[1:])]
            columns = [batch.column(key), batch.column("part"), batch.column("first"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "part", "first", "n_tokens", "ids_crc32"])

    kind = files.schema[key].dataType.simpleString()
    each = files.select(key, "part", "first", "ids").mapInArrow(run, f"`{key}` {kind}, part int, first long, n_tokens long, ids_crc32 long")
    joined = each.join(starts(files), "part")
    return joined.select(key, (F.col("__start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


@query("op13_token_files")
def op13(spark, sf_dir):
    import public_tokenizers

    path = scratch_dir(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(read(spark, path))
