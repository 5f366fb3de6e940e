"""Token ids of documents packed into training sequences: overlong documents cut into full windows, the rest by best-fit decreasing.

A task encodes its texts and gathers documents up to ``GROUP_IDS`` ids.  A document longer than the window gives full windows as it comes; what
remains of it, and every shorter document, is a piece.  Pieces go, longest first, into the open window with the least room that
still takes them; a segment tree over the room left (leaf r: windows with r ids free) finds it in as many steps as the window has binary digits.

Windows that best fit leaves with more than ``window // SLACK`` free places are then closed: the emptiest give their ids to the
fullest, cut where a gap ends, until one window of a group is left, and that one is cut at powers of two, which need no padding.  So
padding is below one place in ``SLACK`` whatever the lengths are, and nearly all documents up to a window's length stay whole.

No shuffle: a group is what one task reads, its memory is bounded by ``GROUP_IDS`` and one text, and a repeated task gives the same
sequences under the same numbers (partition and count within it).

Cases: a null or empty text is the end id alone (no piece at all without one).  A null doc_id is kept.  Repeated rows are documents of
their own.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokenfile import tokenizer_units
from .words import slices

WINDOW = 4096
#: A window with at most this part of it (one in so many places) free counts as full.
SLACK = 256
#: Ids that a task gathers before it packs them, about.
GROUP_IDS = 4_000_000
#: Ids of an output batch, about.
BATCH_IDS = 1 << 19
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Room:
    """Open windows by the room they have left: the tightest that takes a length, by a segment tree over rooms."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def _count(self, room: int, change: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += change
            at >>= 1

    def add(self, window: int, room: int) -> None:
        if room:
            self.open[room].append(window)
            self._count(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """A window with the least room of at least ``length``, and that room; it is no longer open."""
        tree, at = self.tree, length + self.size
        while not tree[at]:
            while at & 1:  # a right child: what lies further right hangs from an ancestor
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at *= 2
            if not tree[at]:
                at += 1
        room = at - self.size
        self._count(room, -1)
        return self.open[room].pop(), room


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each piece by best-fit decreasing, and the load of each window."""
    room, home, loads = Room(window), np.zeros(len(lengths), np.int64), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[piece])
        if found := room.take(length):
            number, left = found
        else:
            number, left = len(loads), window
            loads.append(0)
        home[piece] = number
        loads[number] += length
        room.add(number, left - length)
    return home, np.array(loads, np.int64)


def closed(pieces: list[list[tuple[int, int, int]]], loads: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows with hardly any padding: wide gaps filled from the emptiest windows, the last rest cut at powers of two.

    A piece is (document, start, length); windows are lists of pieces.
    """
    full = window - window // SLACK
    gaps = [i for i in np.argsort(-loads, kind="stable").tolist() if loads[i] < full]
    out = [own for own, load in zip(pieces, loads.tolist(), strict=True) if load >= full]
    first, last = 0, len(gaps) - 1
    while first < last:
        target, gap = pieces[gaps[first]], window - int(loads[gaps[first]])
        while gap and first < last:
            source = pieces[gaps[last]]
            doc, start, length = source.pop()
            taken = min(gap, length)
            target.append((doc, start + length - taken, taken))
            if taken < length:
                source.append((doc, start, length - taken))
            gap -= taken
            loads[gaps[last]] -= taken
            if not source:
                last -= 1
        loads[gaps[first]] = window - gap
        if not gap:
            out.append(target)
            first += 1
    if first == last and first < len(gaps):
        rest, left = pieces[gaps[first]], int(loads[gaps[first]])
        while left:
            size = min(1 << (left.bit_length() - 1), window)
            own, need = [], size
            while need:
                doc, start, length = rest.pop(0)
                taken = min(need, length)
                own.append((doc, start, taken))
                if taken < length:
                    rest.insert(0, (doc, start + taken, length - taken))
                need -= taken
            out.append(own)
            left -= size
    return out


def _group(lengths: np.ndarray, starts: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of the pieces (by place) of a group."""
    home, loads = best_fit(lengths, window)
    pieces: list[list[tuple[int, int, int]]] = [[] for _ in range(len(loads))]
    for i, (number, start, length) in enumerate(zip(home.tolist(), starts.tolist(), lengths.tolist(), strict=True)):
        pieces[number].append((i, start, length))
    return closed(pieces, loads, window)


class _Sequences:
    """Gathers the documents of a task and hands their pieces on as batches."""

    def __init__(self, window: int, group_ids: int):
        self.window, self.group_ids = window, group_ids
        self.number = TaskContext.get().partitionId() << 33 if TaskContext.get() else 0
        self._clear()

    def _clear(self) -> None:
        self.docs, self.totals, self.starts, self.rests, self.held = [], [], [], [], 0

    def add(self, doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Documents of a slice: full windows of the long ones at once, the rests when their group is whole."""
        ends = np.cumsum(sizes)
        for lo in range(0, len(sizes), 4096):
            some = np.arange(lo, min(lo + 4096, len(sizes)))
            whole = sizes[some] // self.window
            doc = np.repeat(some, whole)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)) * self.window
            # a batch holds some windows, whatever the length of a document
            for a in range(0, len(doc), max(1, BATCH_IDS // self.window)):
                d, s = doc[a:a + max(1, BATCH_IDS // self.window)], start[a:a + max(1, BATCH_IDS // self.window)]
                at = (ends - sizes)[d] + s
                flat = ids[at[:, None] + np.arange(self.window)].ravel()
                numbers = self.number + np.arange(len(d))
                self.number += len(d)
                yield _batch(doc_ids[d], known[d], s, np.full(len(d), self.window), sizes[d], numbers, np.zeros(len(d), np.int64), flat)
        rest = sizes % self.window
        some = np.flatnonzero(rest)
        lo = 0
        while lo < len(some):  # up to a whole group
            n = np.cumsum(rest[some[lo:]])
            hi = lo + max(1, int(np.searchsorted(n, self.group_ids - self.held, side="right")))
            own = some[lo:hi]
            self.docs.append((doc_ids[own], known[own]))
            self.totals.append(sizes[own])
            self.starts.append(sizes[own] - rest[own])
            first = ends[own] - rest[own]
            self.rests.append((rest[own], ids[np.repeat(first - np.cumsum(rest[own]) + rest[own], rest[own]) + np.arange(int(rest[own].sum()))]))
            self.held += int(rest[own].sum())
            lo = hi
            if self.held >= self.group_ids or lo < len(some):
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        doc_ids, known = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        totals, starts = np.concatenate(self.totals), np.concatenate(self.starts)
        lengths, ids = (np.concatenate(x) for x in zip(*self.rests, strict=True))
        self._clear()
        sequences = _group(lengths, np.zeros(len(lengths), np.int64), self.window)
        table = np.array([(self.number + n, *piece) for n, own in enumerate(sequences) for piece in own], np.int64)
        self.number += len(sequences)
        number, doc, start, length = table.T
        fresh = np.append(True, number[1:] != number[:-1])
        before = np.cumsum(length) - length
        offset = before - np.repeat(before[fresh], np.diff(np.append(np.flatnonzero(fresh), len(number))))
        places = np.append(0, np.cumsum(lengths))
        for lo in range(0, len(doc), 4096):  # some 4 MB at most: pieces are shorter than a window
            d, s, n = doc[lo:lo + 4096], start[lo:lo + 4096], length[lo:lo + 4096]
            edges = np.append(0, np.cumsum(n))
            cuts = [0, *(np.searchsorted(edges, np.arange(BATCH_IDS, edges[-1], BATCH_IDS)).tolist()), len(d)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    first = places[d[a:b]] + s[a:b]
                    flat = ids[np.repeat(first - np.cumsum(n[a:b]) + n[a:b], n[a:b]) + np.arange(int(n[a:b].sum()))]
                    yield _batch(doc_ids[d[a:b]], known[d[a:b]], starts[d[a:b]] + s[a:b], n[a:b], totals[d[a:b]], number[lo + a:lo + b], offset[lo + a:lo + b], flat)


def _batch(doc_ids, known, start, length, total, number, offset, ids) -> pa.RecordBatch:
    edges = pa.py_buffer(np.append(0, np.cumsum(length) * 4).astype(np.int32))
    blobs = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, edges, pa.py_buffer(ids.astype("<u4"))])
    return pa.record_batch([pa.array(doc_ids, mask=~known), *(pa.array(x.astype(np.int64)) for x in (start, length, total, number, offset)), blobs],
                           ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int | None = 2, group_ids: int = GROUP_IDS) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit, little-endian) of every piece of every text's ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, sequences = tokenizer_units(tokenizer), _Sequences(window, group_ids)
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                ids, sizes = units.ids(part.column("text"))
                if end_id is not None:
                    ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                column = part.column("doc_id")
                known = column.is_valid().to_numpy(zero_copy_only=False)
                yield from sequences.add(column.fill_null(0).to_numpy(), known, sizes, ids)
        yield from sequences.flush()
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, SCHEMA)
