"""Token files: ids ranked by frequency, in byte-aligned variable-length coding with the control bytes apart.

A folder holds a table of ids by rank (``ranks``, unsigned 32-bit) and files ``part-<number>``.  A file is a row of blocks of whole documents,
then a directory (for each block: its offset, documents, ids; unsigned 64-bit each), the number of blocks, and ``MAGIC``.  A block holds

    doc_ids   signed 64-bit, a document each (a null is the least integer)
    sizes     unsigned 32-bit: ids of each document
    control   a byte for four ids, two bits each from the low end: bytes of the id's rank, less one
    data      ranks, one to four bytes each, little-endian

The frequent ids have ranks below 256 and take one byte.  Decoding looks a control byte up in a table of four lengths; no branch or
loop runs over ids.  Files follow one another in ascending doc_id order; a file appears whole or not at all, under a
name that a repeated task gives again.

Flow.  Texts are encoded once into a table in the shared folder; ids are counted (task by task, then by id: at most as many rows as the vocabulary
has ids, which bounds what reaches the driver); the table is dealt by ranges of doc_id and written; files are read back a block at a time.

Cases: a null or empty text is the end id alone.  A null doc_id comes first.  Repeated rows and doc_ids are written each, in the order
of reading.  An empty table gives no files and no rows.  Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, new_folder, open_file, put_file
from .units import Known, gathered
from .words import slices

MAGIC = b"RANKVB01"
NULL_ID = np.iinfo(np.int64).min
BLOCK_IDS = 1 << 18
#: Ids of a file, about.
FILE_IDS = 8_000_000

#: Lengths of the four ranks of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes."""
    ranks = ranks.astype("<u4")
    sizes = 1 + (ranks >= 1 << 8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[:len(ranks)] = sizes - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control, ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]]


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ranks of some control and data bytes."""
    sizes = LENGTHS[control].ravel()[:n]
    start = np.cumsum(sizes) - sizes
    padded = np.append(data, np.zeros(4, np.uint8))
    out = padded[start].astype(np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(sizes > k)
        if not len(at):
            break
        out[at] |= padded[start[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: Letters that no normal form or lower case splits; İ becomes two characters.
_LETTERS = re.compile("[ ]*[A-Za-zÀ-ÖØ-öø-įıĲ-ſ]+")


@lru_cache(2)
def tokenizer_units(path: str) -> Known:
    """Encodes texts as the library does, unit by unit."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    whole = tuple(t.content.encode() for t in tokenizer.get_added_tokens_decoder().values())  # the library finds these in a text
    suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
    ends = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    for token, i in tokenizer.get_vocab().items() if suffix else ():
        ends[i] = token.endswith(suffix)

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # a word of plain letters ends with its one token that ends a word, so one call can take all of these
        plain = np.array([suffix is not None and _LETTERS.fullmatch(u) is not None for u in units], bool)
        order = np.append(np.flatnonzero(plain), np.flatnonzero(~plain))
        joined, *rest = (x.ids for x in tokenizer.encode_batch_fast(
            [" ".join(u for u, p in zip(units, plain.tolist(), strict=True) if p), *(units[i] for i in np.flatnonzero(~plain).tolist())], add_special_tokens=False))
        joined = np.array(joined, np.uint32)
        sizes = np.append(np.diff(np.append(-1, np.flatnonzero(ends[joined]))), [len(x) for x in rest]).astype(np.int64)
        ids = np.append(joined, np.fromiter((i for x in rest for i in x), np.uint32, sum(map(len, rest))))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return gathered(ids, np.append(0, np.cumsum(sizes)), back)
    return Known(encode, fine=True, whole=whole)


def id_kind(tokenizer: str) -> str:
    """Two bytes an id where they do."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def encode_texts(docs: DataFrame, tokenizer: str, end_id: int | None = 1, kind: str = "<u4") -> DataFrame:
    """doc_id, ids (binary, unsigned integers of ``kind``): the ids of every text with the end id.

    White space is dropped by these tokenizers and bounds every token, so units between it are encoded by themselves; added tokens stay whole.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer_units(tokenizer)
        for batch in batches:
            for part in slices(batch, most=8 << 20):
                ids, sizes = known.ids(part.column("text"))
                if end_id is not None:
                    ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                edges = pa.py_buffer(np.append(0, np.cumsum(sizes) * np.dtype(kind).itemsize).astype(np.int32))
                yield pa.record_batch([part.column("doc_id"), pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, edges, pa.py_buffer(ids.astype(kind))])], ["doc_id", "ids"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, "doc_id long, ids binary")


def _counted(kind: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            own = np.bincount(_flat(batch.column("ids"), kind)[0])
            if len(own) > len(counts):
                counts = np.append(counts, np.zeros(len(own) - len(counts), np.int64))
            counts[:len(own)] += own
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], ["id", "n"])
    return task


def _flat(blobs: pa.BinaryArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some rows one after another, and the number of each."""
    _, offsets, data = blobs.buffers()
    offsets = np.frombuffer(offsets, np.int32)[blobs.offset:blobs.offset + len(blobs) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].view(kind) if data is not None else np.zeros(0, kind), np.diff(offsets) // np.dtype(kind).itemsize


def _block(doc_ids: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    return b"".join([doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def _file(folder: str, kind: str):
    """Writes the rows of a task as one file; gives its name and number of ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = mapped(f"{folder}/ranks", "<u4")
        rank_of = np.zeros(int(ranks.max(initial=0)) + 1, np.uint32)
        rank_of[ranks] = np.arange(len(ranks))
        blocks: list[tuple[int, int, int]] = []
        name, first = "", None

        def parts() -> Iterator[bytes]:
            nonlocal name, first
            at = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                name = name or f"part-{batch.column('part')[0].as_py():08d}"
                ids, sizes = _flat(batch.column("ids"), kind)
                doc_ids = batch.column("doc_id").fill_null(int(NULL_ID)).to_numpy()
                first = int(doc_ids[0]) if first is None else first
                edges, lo = np.append(0, np.cumsum(sizes)), 0
                while lo < len(sizes):
                    hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + BLOCK_IDS, side="right")) - 1)
                    block = _block(doc_ids[lo:hi], sizes[lo:hi], rank_of[ids[edges[lo]:edges[hi]]])
                    blocks.append((at, hi - lo, int(edges[hi] - edges[lo])))
                    at += len(block)
                    yield block
                    lo = hi
            yield np.array(blocks, "<u8").tobytes() + np.array([len(blocks)], "<u8").tobytes() + MAGIC
        source = parts()
        head = next(source)
        if not blocks:  # no rows, no file
            return
        size = put_file(f"{folder}/{name}", _chain(head, source))
        yield pa.record_batch([pa.array([name]), pa.array([sum(n for _, _, n in blocks)], pa.int64()), pa.array([size], pa.int64())], ["name", "n_ids", "n_bytes"])
    return task


def _chain(head: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield head
    yield from rest


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = 1) -> tuple[str, DataFrame]:
    """Writes the ids of all texts; gives the folder and its files in order: name, n_ids, n_bytes, start (ids of all files before)."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    kind = id_kind(tokenizer)
    encode_texts(docs, tokenizer, end_id, kind).withColumn("seq", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{folder}/encoded")
    rows = spark.read.schema("doc_id long, ids binary, seq long").parquet(f"{folder}/encoded")
    counts = rows.select("ids").mapInArrow(_counted(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    counts = counts.sort_values(["n", "id"], ascending=[False, True])
    put_file(f"{folder}/ranks", [counts["id"].to_numpy("<u4").tobytes()])
    files = max(1, -(-int(counts["n"].sum()) // FILE_IDS))
    dealt = rows.repartitionByRange(files, "doc_id", "seq").sortWithinPartitions("doc_id", "seq").withColumn("part", F.spark_partition_id())
    dealt.select("doc_id", "ids", "part").mapInArrow(_file(folder, kind), "name string, n_ids long, n_bytes long").write.parquet(f"{folder}/files")
    made = spark.read.schema("name string, n_ids long, n_bytes long").parquet(f"{folder}/files")
    # a row a file: names sort as their ranges do
    listed, start = [], 0
    for r in made.orderBy("name").collect():
        listed.append((r.name, r.n_ids, r.n_bytes, start))
        start += r.n_ids
    return folder, spark.createDataFrame(listed, "name string, n_ids long, n_bytes long, start long").repartition(max(1, len(listed)), "name")


def _blocks(folder: str, name: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, sizes and ids of the blocks of a file."""
    ranks = mapped(f"{folder}/ranks", "<u4")
    with open_file(f"{folder}/{name}") as source:
        end = source.size()
        tail = source.read_at(16, end - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{name} is not a token file")
        n = int(np.frombuffer(tail, "<u8", 1)[0])
        directory = np.frombuffer(source.read_at(24 * n, end - 16 - 24 * n), "<u8").reshape(n, 3).astype(np.int64)
        stops = np.append(directory[1:, 0], end - 16 - 24 * n)
        for (at, docs, ids), stop in zip(directory.tolist(), stops.tolist(), strict=True):
            block = np.frombuffer(source.read_at(stop - at, at), np.uint8)
            control = docs * 12 + (ids + 3) // 4
            yield block[:docs * 8].view("<i8"), block[docs * 8:docs * 12].view("<u4"), ranks[unpack(block[docs * 12:control], block[control:], ids)]


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, unsigned 32-bit) of every document, from the files."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, start, sizes, ids in _read(batches, folder):
            edges = pa.py_buffer(np.append(0, np.cumsum(sizes) * 4).astype(np.int32))
            yield pa.record_batch([doc_ids, start, pa.array(sizes), pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, edges, pa.py_buffer(ids.astype("<u4"))])], ["doc_id", "start", "n_tokens", "ids"])
    return files.select("name", "start").mapInArrow(task, "doc_id long, start long, n_tokens long, ids binary")


def read_digests(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, start, sizes, ids in _read(batches, folder):
            view, edges = memoryview(ids.astype("<u4").view(np.uint8)), np.append(0, np.cumsum(sizes) * 4).tolist()
            crc = [zlib.crc32(view[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.record_batch([doc_ids, start, pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    return files.select("name", "start").mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for name, before in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
            for doc_ids, sizes, ids in _blocks(folder, name):
                sizes = sizes.astype(np.int64)
                start = before + np.cumsum(sizes) - sizes
                before += len(ids)
                yield pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(start), sizes, ids
