"""Texts as sequences of repeating units: a worker tokenizes a unit once and gathers the ids of all its places.

A unit is a run of ASCII white space with the run of other bytes after it.  Units of the slice at hand are told apart exactly
(Arrow dictionary encoding), not by a hash; ids of earlier units are kept up to a bound and then dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .words import text_buffer

ASCII_SPACE = frozenset(" \t\n\x0b\x0c\r")
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in ASCII_SPACE]] = True


_WORD = np.zeros(256, bool)
_WORD[[c for c in range(128) if chr(c).isalnum()]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[ord(c) for c in ASCII_SPACE]] = ord(" ")


def units_of(column: pa.Array, fine: bool = False, whole: tuple[bytes, ...] = ()) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Units of some texts one after another, and the number of units of each text; joined they are the texts.

    ``fine`` is for tokenizers that drop white space and end a token where an ASCII letter or digit is followed by an
    ASCII mark: units end there too, and all white space is written as spaces, so fewer units are different.
    No unit ends within a place of one of the strings ``whole``.
    """
    data, offsets = text_buffer(column)
    if not len(data):
        return pa.array([], pa.large_string()).dictionary_encode(), np.zeros(len(column), np.int64)
    space = _SPACE[data]
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    if fine:
        begins[1:] |= _MARK[data[1:]] & _WORD[data[:-1]]
    if whole:
        flat = data.tobytes()
        for token in whole:
            at = flat.find(token)
            while at >= 0:
                begins[at + 1:at + len(token)] = False
                at = flat.find(token, at + 1)
    if fine:
        data = _BLANK[data]
    begins[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    starts = np.flatnonzero(begins)
    units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data))
    edges = np.searchsorted(starts, offsets)
    return units.dictionary_encode(), np.diff(edges)


def gathered(values: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` (run i is from ends[i] to ends[i + 1]) one after another, and the length of each."""
    start = ends[places]
    n = ends[places + 1] - start
    total = np.cumsum(n)
    return values[np.repeat(start - total + n, n) + np.arange(int(total[-1]) if len(n) else 0)], n


def per_group(n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive numbers, so many in each group."""
    total, edges = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(sizes))
    return total[edges[1:]] - total[edges[:-1]]


class Known:
    """Ids of units seen so far.  ``encode`` gives the ids of a list of units one after another, and the number of each."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000, fine: bool = False, whole: tuple[bytes, ...] = ()):
        self.encode, self.most, self.fine, self.whole = encode, most, fine, whole
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.arena, self.ends, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), 0

    def _add(self, units: list[str]) -> None:
        ids, sizes = self.encode(units)
        first, n = len(self.places), self.size + int(sizes.sum())
        while len(self.arena) < n:
            self.arena = np.append(self.arena, np.zeros_like(self.arena))
        while len(self.ends) < first + len(units) + 1:
            self.ends = np.append(self.ends, np.zeros_like(self.ends))
        self.arena[self.size:n] = ids
        self.ends[first + 1:first + 1 + len(units)] = self.size + np.cumsum(sizes)
        self.places.update(zip(units, range(first, first + len(units)), strict=True))
        self.size = n

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts one after another, and the number of ids of each text."""
        units, per_text = units_of(column, self.fine, self.whole)
        distinct = units.dictionary.to_pylist()
        new = [u for u in distinct if u not in self.places]
        if len(self.places) + len(new) > self.most:
            self.forget()
            new = distinct
        for lo in range(0, len(new), 50_000):
            self._add(new[lo:lo + 50_000])
        place = np.fromiter(map(self.places.__getitem__, distinct), np.int64, len(distinct))[units.indices.to_numpy()]
        ids, n = gathered(self.arena, self.ends, place)
        return ids, per_group(n, per_text)
