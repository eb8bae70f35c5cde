"""Character n-grams of many texts at once: sorted codes instead of rows.

A window of bytes is an n-gram inside a padded word when all its bytes but the first and the last are no white space. Its
code, five bytes at most, and the place of its text fill one whole number, so that sorting these numbers counts the n-grams
of all texts of a chunk. Texts must be ASCII, as folded texts are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES, CHUNK_TEXTS = 4 << 20, 30_000  # of texts counted together
LONGEST = 5
PLACE_BITS = 24
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])


@dataclass
class Cells:
    """Cells of a chunk, sorted by n-gram and text: distinct codes, where their cells begin, and each cell's text and count."""

    numbers: np.ndarray  # of the texts
    codes: np.ndarray
    starts: np.ndarray
    text: np.ndarray
    tf: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts, append=len(self.text))


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """Numbers and texts (columns 0 and 1) of consecutive rows, up to the size of a chunk."""
    numbers: list[np.ndarray] = []
    texts: list[pa.Array] = []
    size = 0
    for batch in batches:
        ends = _ends(batch.column(1))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + CHUNK_BYTES - size)))
            stop = min(stop, batch.num_rows, at + CHUNK_TEXTS)
            own = batch.column(0).slice(at, stop - at).to_numpy(zero_copy_only=False)
            first = numbers[0][0] if numbers else own[0]
            if numbers and (size + ends[stop - 1] - done > CHUNK_BYTES or sum(map(len, numbers)) + len(own) > CHUNK_TEXTS or own.min() < first or own.max() - first > CHUNK_TEXTS):
                yield np.concatenate(numbers), texts
                numbers, texts, size = [], [], 0
                continue
            near = np.flatnonzero((own < own[0]) | (own - first > CHUNK_TEXTS))
            if len(near):
                stop, own = at + int(near[0]), own[: near[0]]
            numbers.append(own)
            texts.append(batch.column(1).slice(at, stop - at))
            size += int(ends[stop - 1] - done)
            at = stop
    if numbers:
        yield np.concatenate(numbers), texts


def _ends(column: pa.Array) -> np.ndarray:
    return np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))


def plain(texts: list[pa.Array]) -> bool:
    """Whether all bytes are ASCII and none is zero."""
    data = np.frombuffer("".join("".join(t.to_pylist()) for t in texts).encode(), np.uint8)
    return not len(data) or bool(data.min() > 0 and data.max() < 128)


def cells(numbers: np.ndarray, texts: list[pa.Array], low: int, high: int) -> Cells:
    """The counted n-grams of a chunk of texts, of three bytes at least."""
    rows = [t for column in texts for t in column.to_pylist()]
    data = np.frombuffer((" " + "  ".join(rows) + " ").encode() + b" " * LONGEST, np.uint8)
    sizes = np.array([len(r) + 2 for r in rows])
    place = np.repeat(np.arange(len(rows), dtype=np.uint64), sizes)
    many = int(sizes.sum())
    white = _SPACE[data]
    data = np.where(white, np.uint8(32), data).astype(np.uint64)
    inner = ~white
    keys = []
    code = np.zeros(many, np.uint64)
    able = np.ones(many, bool)
    for n in range(1, high + 1):
        code |= data[n - 1 : n - 1 + many] << np.uint64(PLACE_BITS + 8 * (LONGEST - n))
        if n >= 3:
            able &= inner[n - 2 : n - 2 + many]
        if n >= low:
            at = np.flatnonzero(able)
            keys.append(code[at] | place[at])
    keys = np.concatenate(keys)
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    tf = np.diff(first, append=len(keys))
    own = keys[first]
    gram = own >> np.uint64(PLACE_BITS)
    starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, int)
    return Cells(numbers, gram[starts].astype(np.int64), starts, (own & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64), tf)


def spelled_out(codes: np.ndarray) -> pa.Array:
    """The n-grams of codes, as strings."""
    letters = np.ascontiguousarray(codes.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 8 - LONGEST :]
    sizes = (letters != 0).sum(axis=1)
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(ends.tobytes()), pa.py_buffer(letters[letters != 0].tobytes()))
