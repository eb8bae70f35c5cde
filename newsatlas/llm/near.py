"""Core of the n-gram Jaccard join: sets, prefixes and signatures of a batch of texts, and comparisons of sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from newsatlas.llm.words import ODD, distinct, mixed, windows, words

SHINGLE = 5
PERCENT = 80  # two sets link when 100 * intersection >= PERCENT * union
EXTRA = 0.2  # share of a set by which its prefix is extended
FREQUENT = 64  # tokens of more documents than this are indexed in combinations of two


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word shingles of each text as ascending hashes, and their bounds.

    A text of 1 to 4 words has one: the whole sequence.
    """
    found = words(column, lower=True)
    hashes, bounds, count = found.hashes(), found.bounds, len(column)
    first, keys = windows(hashes, bounds, SHINGLE)
    owner = np.searchsorted(bounds, first, "right") - 1
    lengths = np.diff(bounds)
    few = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    short = np.zeros(len(few), np.uint64)
    for k in range(SHINGLE - 1):
        has = lengths[few] > k
        short[has] = short[has] * ODD + hashes[bounds[few[has]] + k] + np.uint64(1)
    short = mixed(short ^ lengths[few].astype(np.uint64))
    return distinct(np.r_[keys, short], np.r_[owner, few], count)


def must_share(n: np.ndarray) -> np.ndarray:
    """Least overlap of a set of n with any set that it links with."""
    return -(-PERCENT * n // 100)


def extended(n: np.ndarray) -> np.ndarray:
    """Tokens by which a prefix of n tokens is longer than a partner's errors allow."""
    return 1 + np.floor(EXTRA * n).astype(np.int64)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - must_share(n) + extended(n), 0)


def least_common(n: np.ndarray) -> np.ndarray:
    """Tokens that the extended prefixes of a set of n and of any partner have in common, at least."""
    return extended(must_share(n))


def groups(common: int) -> int:
    """Into how many groups frequent tokens are dealt: the largest power of two below ``common``, or none."""
    return 1 << (common - 1).bit_length() - 1 if common > 1 else 0


def signatures(tokens: np.ndarray, spread: np.ndarray, n: int) -> np.ndarray:
    """Signatures of a set of n from the tokens of its extended prefix that others have, and in how many documents.

    Tokens are ordered by frequency. Rare ones are signatures; frequent ones are dealt into groups, and every pair
    within a group is one. The prefix is extended by a token for each group that it touches.
    """
    size = np.array([n])
    common = int(least_common(size)[0])
    if len(tokens) < common:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, spread))
    tokens, often = tokens[order], spread[order] > FREQUENT
    partners = np.array([int(must_share(size)[0]), n, 100 * n // PERCENT])
    out = []
    for dealt in sorted({groups(int(c)) for c in least_common(partners)}):
        need = len(tokens) - common + 1
        if not dealt:
            out.append(tokens[:need])
            continue
        group = (tokens % np.uint64(dealt)).astype(np.int64)
        first = np.zeros(len(tokens), bool)  # the first frequent token of a group covers nothing
        at = np.flatnonzero(often)
        first[at[np.unique(group[at], return_index=True)[1]]] = True
        cover = np.cumsum(~first)
        end = int(np.searchsorted(cover, need)) + 1
        part, many, group = tokens[:end], often[:end], group[:end]
        out.append(part[~many])
        frequent, group = part[many], group[many]
        by = np.lexsort((frequent, group))
        frequent, group = frequent[by], group[by]
        for step in range(1, len(frequent)):
            same = group[step:] == group[:-step]
            if not same.any():
                break
            out.append(mixed(frequent[:-step][same] * ODD + frequent[step:][same] + np.uint64(dealt)))
    return np.unique(np.concatenate(out))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    seen = np.unique(np.concatenate(left))
    out = np.zeros((len(left), len(right)), np.int64)
    rows = np.zeros((len(left), len(seen)), bool)
    for i, s in enumerate(left):
        rows[i, np.searchsorted(seen, s)] = True
    for j, s in enumerate(right):
        at = np.minimum(np.searchsorted(seen, s), len(seen) - 1)
        out[:, j] = rows[:, at[seen[at] == s]].sum(axis=1)
    return out
