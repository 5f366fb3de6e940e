"""Byte-level BPE in numpy: encoding by rounds of merges over padded matrices, decoding by table.

Texts are cut into pretokens by the tokenizer's pattern, in units that repeat (``units``): no pretoken reaches over the start of a
run of ASCII white space, so a unit is cut by itself; texts that hold other Unicode white space are cut whole.  Different pretokens
are put in matrices by length, a row each.  In a round each row merges its leftmost pair of least rank; ranks are looked up in
a hash table of all pairs that form a token; rows without such a pair leave the matrix.  A pretoken of over ``LONG`` bytes would
make a wide matrix with as many rounds, and is merged with a heap of pairs instead, with equal results.

Every row is encoded where it is read: no shuffle, and memory follows the slice of a few megabytes.

Cases: a null or empty text has no ids and decodes to nothing.  A null doc_id is handed on.  Repeated rows are encoded each.  Other
columns are not read.  Bytes that are not in the table of ranks raise an error; published tables hold all 256.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .units import ASCII_SPACE, Known, gathered, per_group
from .words import give_back, slices, text_buffer

LONG = 256
NONE = np.int32(2 ** 31 - 1)
#: White space beyond ASCII, where a unit would not be cut as in its text.
_OTHER_SPACE = regex.compile(r"[\x85\xa0  -     　]")


class Pairs:
    """Open-addressing hash table of (left id, right id) to the id that they form."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ids: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(ids)) * 4))))
        self.keys, self.ids = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        keys = self._key(left, right)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] < 0
            self.keys[at[todo[free]]] = keys[todo[free]]  # of several for a slot, the last stays
            won = self.keys[at[todo]] == keys[todo]
            self.ids[at[todo[won]]] = ids[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Formed ids, ``NONE`` where a pair forms none or either id is negative (padding)."""
        out = np.full(left.shape, NONE, np.int32)
        real = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = self._key(left.ravel()[real], right.ravel()[real])
        at, flat = self._slot(keys), out.reshape(-1)
        while len(real):
            there = self.keys[at]
            same = there == keys
            flat[real[same]] = self.ids[at[same]]
            on = ~same & (there >= 0)
            real, keys, at = real[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class Encoder:
    """Encodes and decodes by a table of ranks (bytes to id, an id is its rank) and a pattern of pretokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        triples = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = Pairs(*(np.array(x, np.int32) for x in zip(*triples, strict=True))) if triples else Pairs(*[np.zeros(0, np.int32)] * 3)
        self._triples = np.array(triples, np.int32).reshape(-1, 3)
        n = max(ranks.values()) + 1
        pieces = [b""] * n
        for t, r in ranks.items():
            pieces[r] = t
        self.ends = np.append(0, np.cumsum([len(p) for p in pieces])).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.known = Known(self._units)

    @cached_property
    def lookup(self) -> dict[tuple[int, int], int]:
        """Pairs to formed ids, for the heap; made when a long pretoken comes."""
        return {(a, b): r for a, b, r in self._triples.tolist()}

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units.  Those between white space and white space are cut by one call over all of them joined."""
        inner = np.array([u[0] in ASCII_SPACE and u[-1] not in ASCII_SPACE for u in units], bool)
        order = np.append(np.flatnonzero(inner), np.flatnonzero(~inner))
        joined = self.pattern.findall("".join(u for u, i in zip(units, inner.tolist(), strict=True) if i))
        alone = [self.pattern.findall(units[i]) for i in np.flatnonzero(~inner).tolist()]
        n_joined = len(joined)
        for cut in alone:
            joined += cut
        pretokens = pa.array(joined, pa.large_string()).dictionary_encode()
        ids, ends = self.merged(pretokens.dictionary)
        # how many pretokens each unit has: by bytes for the joined ones
        place = pretokens.indices.to_numpy()
        bytes_at = np.cumsum(pc.binary_length(pretokens.dictionary).to_numpy()[place[:n_joined]])
        unit_ends = np.cumsum(pc.binary_length(pa.array([units[i] for i in order[:len(order) - len(alone)].tolist()], pa.large_string())).to_numpy())
        counts = np.append(np.diff(np.append(0, np.searchsorted(bytes_at, unit_ends, side="right"))), [len(c) for c in alone]).astype(np.int64)
        flat, n = gathered(ids, ends, place)
        sizes = per_group(n, counts)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return gathered(flat, np.append(0, np.cumsum(sizes)), back)

    def merged(self, pretokens: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pretokens one after another, and where each begins (and the last ends)."""
        data, offsets = text_buffer(pretokens)
        sizes = np.diff(offsets)
        flats, whose, counts = [], [], []
        for i in np.flatnonzero(sizes > LONG).tolist():
            flats.append(self._by_heap(data[offsets[i]:offsets[i + 1]]))
            whose.append([i])
            counts.append([len(flats[-1])])
        rest = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        rest = rest[np.argsort(sizes[rest], kind="stable")]
        ordered, at = sizes[rest], 0
        while at < len(rest):  # rows of alike lengths, a few hundred thousand cells at most
            width = int(ordered[at])
            width = max(2, width if width <= 16 else 1 << (width - 1).bit_length())
            end = min(int(np.searchsorted(ordered, width, side="right")), at + max(1, (1 << 18) // width))
            own = rest[at:end]
            columns = np.arange(width)
            inside = columns < sizes[own][:, None]
            cells = np.where(inside, self.byte_ids[data[np.where(inside, offsets[own][:, None] + columns, 0)]], -1).astype(np.int32)
            done, n = self._rounds(cells)
            flats.append(done[done >= 0].astype(np.uint32))
            whose.append(own)
            counts.append(n)
            at = end
        ends = np.zeros(len(sizes) + 1, np.int64)
        if not flats:
            return np.zeros(0, np.uint32), ends
        flat, whose, counts = np.concatenate(flats), np.concatenate(whose), np.concatenate(counts)
        ends[whose + 1] = counts
        ends = np.cumsum(ends)
        back = np.argsort(whose, kind="stable")
        return gathered(flat, np.append(0, np.cumsum(counts)), back)[0], ends

    def _rounds(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged rows, padded with -1, and their lengths."""
        done = np.full(cells.shape, -1, np.int32)
        rows = np.arange(len(cells))
        ranks = self.pairs(cells[:, :-1], cells[:, 1:])
        while len(rows):
            place = ranks.argmin(1)  # the leftmost of least rank
            here = np.arange(len(rows))
            least = ranks[here, place]
            stop = least == NONE
            if stop.any():
                done[rows[stop], :cells.shape[1]] = cells[stop]
                on = ~stop
                rows, cells, ranks, place, least = rows[on], cells[on], ranks[on], place[on], least[on]
                here = here[:len(rows)]
                if not len(rows):
                    break
            cells[here, place] = least
            width = cells.shape[1]
            columns = np.arange(width - 1)
            cells = np.take_along_axis(cells, columns + (columns > place[:, None]), 1)
            if width == 2:
                done[rows, :1] = cells
                break
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= place[:, None]), 1)
            left = np.flatnonzero(place > 0)
            ranks[left, place[left] - 1] = self.pairs(cells[left, place[left] - 1], cells[left, place[left]])
            right = np.flatnonzero(place < width - 2)
            ranks[right, place[right]] = self.pairs(cells[right, place[right]], cells[right, place[right] + 1])
        return done, (done >= 0).sum(1)

    def _by_heap(self, text: np.ndarray) -> np.ndarray:
        ids = self.byte_ids[text].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get = self.lookup.get
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if (x := get((r, ids[k]))) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            h = before[i]
            if h >= 0 and (x := get((ids[h], r))) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts one after another, and the number of each."""
        odd = [i for i, t in enumerate(column.to_pylist()) if t and not t.isascii() and _OTHER_SPACE.search(t)]
        if not odd:
            return self.known.ids(column)
        plain = pa.array([None if i in set(odd) else t for i, t in enumerate(column.to_pylist())], pa.large_string())
        ids, sizes = self.known.ids(plain)
        parts, at = np.split(ids, np.cumsum(sizes)[:-1]), set(odd)
        parts = [self._whole(column[i].as_py()) if i in at else p for i, p in enumerate(parts)]
        return np.concatenate(parts).astype(np.uint32), np.array([len(p) for p in parts], np.int64)

    def _whole(self, text: str) -> np.ndarray:
        pretokens = pa.array(self.pattern.findall(text), pa.large_string()).dictionary_encode()
        return gathered(*self.merged(pretokens.dictionary), pretokens.indices.to_numpy())[0]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of some texts' ids one after another, and the number of each text's."""
        text, n = gathered(self.bytes, self.ends, ids.astype(np.int64))
        return text, per_group(n, sizes)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as source:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source)}


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One a worker: the file is at the same place on every machine."""
    return Encoder(read_ranks(path), pattern)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the text decoded from them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for doc_id, ids, sizes in _encoded(batches, bpe):
            text, lengths = bpe.decode(ids, sizes)
            yield pa.record_batch([doc_id, pa.array(sizes), _binary(ids.astype("<u4").view(np.uint8), sizes * 4), _binary(text, lengths).cast(pa.string())], ["doc_id", "n_tokens", "ids", "text"])
    return _texts(docs).mapInArrow(task, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: round trip of every text, told by digests where it was made."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for doc_id, ids, sizes in _encoded(batches, bpe):
            text, lengths = bpe.decode(ids, sizes)
            yield pa.record_batch([doc_id, pa.array(sizes), _sha256(ids.astype("<u4").view(np.uint8), sizes * 4), _sha256(text, lengths)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return _texts(docs).mapInArrow(task, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def _encoded(batches: Iterator[pa.RecordBatch], bpe: Encoder) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in slices(batch, most=1 << 20):
            yield part.column("doc_id"), *bpe.encode(part.column("text"))
    bpe.known.forget()  # a worker is kept for tasks of other stages
    give_back()


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _sha256(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    view, edges = memoryview(np.ascontiguousarray(data)), np.append(0, np.cumsum(sizes)).tolist()
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(edges[:-1], edges[1:], strict=True)])
