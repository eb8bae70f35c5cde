"""Words, windows and lines of whole texts, cut from Arrow buffers without a loop over rows or words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

#: The bytes that part words, U+0020 and U+0009 to U+000D.
SPACES = [9, 10, 11, 12, 13, 32]
IS_SPACE = np.isin(np.arange(256), SPACES)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
PIECE_BYTES = 4 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """Word ``k`` is ``names[ids[k]]``; text ``i`` has the words ``bounds[i]:bounds[i + 1]``."""

    ids: np.ndarray
    names: pa.Array
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word; only the distinct words of the batch are hashed one by one."""
        return self.name_hashes()[self.ids] if len(self.names) else np.zeros(0, np.uint64)

    def name_hashes(self) -> np.ndarray:
        names = self.names.to_pylist()
        return np.fromiter((xxhash.xxh64_intdigest(x) for x in names), np.uint64, len(names))

    def texts(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text and ``most`` rows, one at least: memory stays bounded."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        at, rows = 0, batch.num_rows
        while at < rows:
            end = min(at + most, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and the last ends; null counts as the empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of marked bytes; a run ends where its text ends."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marks lie in each text."""
    return np.diff(np.searchsorted(np.flatnonzero(marks), offsets))


def slices(data: np.ndarray, kept: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary array of neighbouring pieces: the kept bytes in order, cut by lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])


def words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = utf8(column)
    return split(LOWER[data] if lower else data, offsets)


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> Words:
    """Runs of the marked bytes, by default of all that are not white space."""
    inside = ~IS_SPACE[data] if inside is None else inside
    starts, ends = runs(inside, offsets)
    coded = slices(data, inside, ends - starts).dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.searchsorted(starts, offsets))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and 64-bit hash of every window of ``size`` words that lies in one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(bounds[1:], np.diff(bounds))[:n] - size
    first = np.flatnonzero(np.arange(n) <= last)
    total = hashes[:n].copy()
    for k in range(1, size):
        total = total * ODD + hashes[k : n + k]
    return first, mixed(total[first])


def repeated(values: np.ndarray, texts: np.ndarray, keep: str | bool = False) -> np.ndarray:
    """Marks values found twice or more in their text (all of them, or all but the first)."""
    return pd.Index(values.astype(np.uint64) + texts.astype(np.uint64) * ODD).duplicated(keep=keep)


def distinct(values: np.ndarray, texts: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Values without repeats, ascending in each text, and their bounds."""
    order = np.lexsort((values, texts))
    values, texts = values[order], texts[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])
    return values[new], np.searchsorted(texts[new], np.arange(count + 1))
