"""Words of Arrow text columns as numpy arrays of 64-bit hashes, without a Python object per word.

A word is a run of bytes other than separators.  White space is ``[\\x20\\x09-\\x0D]``; none of these bytes occurs
inside a UTF-8 character, so cutting bytes cuts whole characters.  A null text is an empty one: it has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACE = 32
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def byte_table(separators: bytes = b"\t\n\x0b\x0c\r", lower: bool = True) -> np.ndarray:
    """256-entry map of bytes: separators to a space, A-Z to a-z if asked for."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = SPACE
    return table


#: White space separates; letters A-Z are lowered.
WHITE = byte_table()
#: Every ASCII character but letters, digits and the apostrophe separates; letters A-Z are lowered.
ALNUM = byte_table(bytes(i for i in range(128) if not (chr(i).isalnum() or chr(i) == "'")))


class Words(NamedTuple):
    """Words of some texts in order: hash, number of the text, first byte and byte length in the text buffer."""

    hashes: np.ndarray
    docs: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


_powers = np.ones(1, np.uint64)


def _weights(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096), _BASE, np.uint64)]))
    return _powers


def words_of(column: pa.Array, table: np.ndarray = WHITE) -> Words:
    """Words of a column.  Works through the buffer a megabyte at a time; a longer word makes its chunk longer."""
    data, offsets = text_buffer(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, none)
    firsts = offsets[:-1][offsets[1:] > offsets[:-1]]
    parts, at, n = [], 0, len(data)
    while at < n:
        end = min(at + CHUNK, n)
        if end < n:  # back to the last place where no word goes on
            window = table[data[at:end]]
            gaps = np.flatnonzero(window == SPACE)
            cut = at + (int(gaps[-1]) + 1 if len(gaps) else 0)
            i = np.searchsorted(firsts, end, side="right") - 1
            cut = max(cut, int(firsts[i]) if i >= 0 else 0)
            while cut <= at:  # one word fills the chunk
                more = np.flatnonzero(table[data[end:end + CHUNK]] == SPACE)
                i = np.searchsorted(firsts, end, side="left")
                stops = [end + int(more[0])] if len(more) else [min(end + CHUNK, n)]
                if i < len(firsts):
                    stops.append(int(firsts[i]))
                done = len(more) or min(stops) < min(end + CHUNK, n) or min(stops) == n
                end = min(stops)
                cut = end if done else at
            end = cut
        chunk = table[data[at:end]]
        inside = chunk != SPACE
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        lo, hi = np.searchsorted(firsts, [at, end])
        heads = firsts[lo:hi] - at
        begins[heads] = inside[heads]
        starts = np.flatnonzero(begins)
        if len(starts):
            gaps = ~inside
            gaps[heads] |= True
            places = np.flatnonzero(gaps)
            stops = np.append(places, len(chunk))[np.searchsorted(places, starts, side="right")]
            lengths = stops - starts
            kept = np.flatnonzero(inside)
            within = np.arange(len(kept)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            values = (chunk[kept].astype(np.uint64) + np.uint64(1)) * _weights(int(lengths.max()))[within]
            sums = np.add.reduceat(values, np.cumsum(lengths) - lengths)
            parts.append((mix(sums + lengths.astype(np.uint64)), starts + at, lengths))
        at = end
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, none)
    hashes, starts, lengths = (np.concatenate(x) for x in zip(*parts))
    return Words(hashes, np.searchsorted(offsets, starts, side="right") - 1, starts, lengths)


def ngrams(words: Words, n: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words that lie within one text, and the index of each run's first word.

    With ``skip``, ``n`` is 2 and so many words are left out between the two.
    """
    span = n + skip
    m = len(words.hashes) - span + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(words.docs[:m] == words.docs[span - 1:])
    picks = range(n) if not skip else (0, span - 1)
    value = np.full(len(first), (n * 0x9E37 + skip * 0x79B9 + 1) & 0xFFFFFFFF, np.uint64)
    for k in picks:
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + words.hashes[first + k])
    return value, first


def give_back() -> None:
    """Return freed memory to the machine: a worker that is kept for later tasks would hold on to it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most so many text bytes (or one row), so that memory does not follow the batch size."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end
    give_back()
