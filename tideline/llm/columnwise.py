"""Column-wise construction of a collection's positional Burrows-Wheeler transform and common prefixes.

The strings stand in columns. Rounds go from the last column to the first, and each inserts one symbol a string: the
column read in the order of the strings' suffixes behind it is the transform, sorting it stably is the order of the
suffixes that begin in it, and what neighbours have in common is one more than the least common prefix between the
places that they came from. A round takes time and memory in proportion to the strings, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last] for each pair, first <= last, from tables of spans of powers of two.

    Tables are built one after the other, up to the widest range that is asked for.
    """
    if not len(first):
        return np.empty(0, values.dtype)
    level = (np.frexp((last - first + 1).astype(np.float64))[1] - 1).astype(np.uint8)
    by_level = np.argsort(level, kind="stable")
    first, last = first[by_level], last[by_level]
    levels = int(level.max()) + 1
    cuts = np.searchsorted(level[by_level], np.arange(levels + 1)).tolist()
    found, table = np.empty(len(first), values.dtype), values
    for k in range(levels):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        i, j = cuts[k], cuts[k + 1]
        found[i:j] = np.minimum(table[first[i:j]], table[last[i:j] - (1 << k) + 1])
    out = np.empty_like(found)
    out[by_level] = found
    return out


def in_columns(data: np.ndarray, offsets: np.ndarray, lead: np.ndarray, width: int) -> np.ndarray:
    """Symbols [width, strings]: byte + 1, 0 where a string has none. ``lead`` is the column of each string's first byte.

    No byte may be above 254; UTF-8 has none.
    """
    size = np.diff(offsets)
    out = np.zeros((width, len(size)), np.uint8)
    out[np.arange(len(data)) + np.repeat(lead - offsets[:-1], size), np.repeat(np.arange(len(size)), size)] = data + np.uint8(1)
    return out


def rounds(symbols: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, order, common) from the last column to the first.

    ``order`` has the strings by what stands from the column on, ties as they came; ``common`` says how many symbols each
    shares with the one before it, up to ``most`` (255 at most) and counting the ends' zeros.
    """
    width, n = symbols.shape
    order, common = np.arange(n), np.zeros(n, np.uint8)
    for x in range(width - 1, -1, -1):
        transform = symbols[x][order]
        by = np.argsort(transform, kind="stable")
        own = transform[by]
        k = np.flatnonzero(own[1:] == own[:-1]) + 1
        new = np.zeros(n, np.uint8)
        new[k] = np.minimum(range_min(common, by[k - 1] + 1, by[k]), most - 1) + 1
        order, common = order[by], new
        yield x, order, common


def later_windows(symbols: np.ndarray, length: int, windows: int) -> np.ndarray:
    """[windows, strings]: True where the ``length`` symbols from a column on also stand there in a string before it.

    Only the first ``windows`` columns are asked for. Windows with ends' zeros are the caller's to leave out.
    """
    later = np.zeros((windows, symbols.shape[1]), bool)
    for x, order, common in rounds(symbols, length):
        if x < windows:
            equal = common >= length
            if equal.any():
                head = np.flatnonzero(~equal)
                first = np.minimum.reduceat(order, head)
                later[x, order] = order != np.repeat(first, np.diff(np.append(head, len(order))))
    return later
