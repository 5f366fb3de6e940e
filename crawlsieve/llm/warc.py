"""WARC archives with a two-level capture index.

Writing.  Pages become WARC/1.1 records, each a gzip member of its own, in files of about ``FILE_BYTES``.  Of records with equal payloads of
at least ``REVISIT_BYTES`` bytes the one of the least page_id is a response, the others are revisits without payload that name it.

Index.  A capture has a line: its URL with the host reversed (``com,example)/path?query``), file, offset, length.  Lines are sorted by
ranges of the key and cut into compressed blocks of ``BLOCK_LINES``; a directory holds the first key of each block.  A look-up finds the
index part (one key a part, which the driver knows), finds the block in the part's directory by binary search, reads that range of the
index and then that range of the archive.  Look-ups are sorted, so each block is read once a look-up task; a key whose captures fill many
blocks is dealt out block by block, and archive ranges are dealt out anew before they are read.

Files appear whole or not at all and a repeated task writes the same ones: the rows of a task are sorted before.

Cases: a null html is an empty payload; a null or empty URL has the key "".  Rows without page_id are records as well; they are
responses unless another row with an id has their payload.  Of repeated rows (equal page_id and payload) one is the response
and the others revisit it.  An empty table gives no archive and no rows.  Other columns are not read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, open_file, put_file, written

REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
BLOCK_LINES = 1_000
#: Captures of an index part, about.
PART_LINES = 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile("[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host, port if any, path and query; the fragment and scheme do not count."""
    url = _CONTROL.sub(lambda m: quote(m.group()), url or "")
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:  # not a URL: sorted as it is written
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _record_id(seq: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(seq))}>"


def record(seq: int, page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: tuple[int, int | None, str | None] | None) -> bytes:
    """One WARC record; ``revisit`` is (seq, page_id, url) of the response that holds its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(seq)), ("WARC-Date", DATE)]
    if url:
        head.append(("WARC-Target-URI", _CONTROL.sub(lambda m: quote(m.group()), url)))
    if page_id is not None:
        head.append(("Page-Id", str(page_id)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(revisit[0]))]
        if revisit[1] is not None:
            head.append(("Refers-To-Page-Id", str(revisit[1])))
        if revisit[2]:
            head.append(("WARC-Refers-To-Target-URI", _CONTROL.sub(lambda m: quote(m.group()), revisit[2])))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record; names of fields are in lower case."""
    if not data.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


_CAPTURE = "key string, file string, offset long, length long"


def _archive(folder: str):
    """Writes the pages of a task; gives their captures."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        members: list[bytes] = []
        lines: list[tuple[str, str, int, int]] = []
        size = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("seq", "page_id", "url", "html", "digest", "head_seq", "head_id", "head_url")]
            for row in range(batch.num_rows):
                seq, page_id, url, html, digest, head, head_id, head_url = (c[row].as_py() for c in columns)
                member = gzip.compress(record(seq, page_id, url, (html or "").encode(), digest, None if head is None else (head, head_id, head_url)), 6, mtime=0)
                lines.append((url_key(url), f"part-{part:06d}-{number:04d}.warc.gz", size, len(member)))
                members.append(member)
                size += len(member)
                if size >= FILE_BYTES:
                    yield _put_archive(folder, lines, members)
                    members, lines, size, number = [], [], 0, number + 1
        if members:
            yield _put_archive(folder, lines, members)
    return task


def _put_archive(folder: str, lines: list[tuple], members: list[bytes]) -> pa.RecordBatch:
    put_file(f"{folder}/{lines[0][1]}", members)
    return pa.record_batch([pa.array(x) for x in zip(*lines, strict=True)], ["key", "file", "offset", "length"])


def _index(folder: str):
    """Writes the sorted captures of a task as an index part with its directory; gives the part's first key."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"index-{TaskContext.get().partitionId():06d}"
        firsts: list[str] = []
        places: list[tuple[int, int]] = []

        def blocks() -> Iterator[bytes]:
            held: list[tuple[str, str]] = []
            at = 0
            for batch in batches:
                held += [(k, f"{k}\t{f}\t{o}\t{n}") for k, f, o, n in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True)]
                while len(held) >= BLOCK_LINES:
                    yield (block := zlib.compress("\n".join(x for _, x in held[:BLOCK_LINES]).encode()))
                    firsts.append(held[0][0])
                    places.append((at, len(block)))
                    at += len(block)
                    held = held[BLOCK_LINES:]
            if held:
                yield (block := zlib.compress("\n".join(x for _, x in held).encode()))
                firsts.append(held[0][0])
                places.append((at, len(block)))
        source = blocks()
        head = next(source, None)
        if head is None:
            return

        def parts() -> Iterator[bytes]:
            yield head
            yield from source
        put_file(f"{folder}/{name}", parts())
        keys = [k.encode() for k in firsts]
        ends = np.cumsum([len(k) for k in keys]).astype("<u8")
        put_file(f"{folder}/{name}.directory", [struct.pack("<Q", len(keys)), np.array(places, "<u8").tobytes(), ends.tobytes(), b"".join(keys)])
        yield pa.record_batch([pa.array([firsts[0]]), pa.array([name])], ["first", "name"])
    return task


@dataclass
class Archive:
    """A folder of archives, and the first key and name of each index part in order (one row a part)."""

    folder: str
    firsts: list[str]
    names: list[str]


def write_archive(pages: DataFrame) -> Archive:
    """Writes every row of (page_id, url, html) and the index over all captures."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    staged = written(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"),
                                  F.octet_length(html).alias("bytes"), F.monotonically_increasing_id().alias("seq")), "pages")
    large = staged.filter(F.col("bytes") >= REVISIT_BYTES).select("seq", "page_id", "url", "digest")
    heads = large.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "seq", "url")).alias("head"), F.count("*").alias("n")).filter("n > 1 AND NOT head.last")
    revisits = large.select("seq", "digest").join(heads, "digest").filter("seq <> head.seq").select(
        "seq", F.col("head.seq").alias("head_seq"), F.col("head.page_id").alias("head_id"), F.col("head.url").alias("head_url"))
    rows = staged.join(written(revisits, "revisits"), "seq", "left").select("seq", "page_id", "url", "html", "digest", "head_seq", "head_id", "head_url").sortWithinPartitions("seq")
    captures = written(rows.mapInArrow(_archive(folder), _CAPTURE), "captures")
    parts = max(1, -(-captures.count() // PART_LINES))
    ordered = captures.repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    made = sorted((r.name, r.first) for r in written(ordered.mapInArrow(_index(folder), "first string, name string"), "index").collect())
    return Archive(folder, [x for _, x in made], [x for x, _ in made])


def _directory(folder: str, name: str) -> tuple[list[bytes], np.ndarray]:
    with open_file(f"{folder}/{name}.directory") as source:
        data = source.read()
    n = struct.unpack_from("<Q", data)[0]
    places = np.frombuffer(data, "<u8", 2 * n, 8).reshape(n, 2).astype(np.int64)
    ends = np.frombuffer(data, "<u8", n, 8 + 16 * n).astype(np.int64)
    keys = data[8 + 24 * n:]
    return [keys[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)], places


def _blocks_of(archive: Archive):
    """(index, at, size, key): the blocks that may hold each key."""
    firsts = [x.encode() for x in archive.firsts]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, list[bytes], np.ndarray] = (-1, [], np.zeros((0, 2), np.int64))
        for batch in batches:
            out = []
            for url in batch.column("url").to_pylist():
                key = url_key(url)
                raw = key.encode()
                # a part or block holds the key if it begins at or before it and the next one does not begin before it
                for p in range(max(0, bisect.bisect_left(firsts, raw) - 1), bisect.bisect_right(firsts, raw)):
                    if held[0] != p:
                        held = (p, *_directory(archive.folder, archive.names[p]))
                    for b in range(max(0, bisect.bisect_left(held[1], raw) - 1), bisect.bisect_right(held[1], raw)):
                        out.append((archive.names[p], *held[2][b].tolist(), key))
                if len(out) >= 10_000:
                    yield _places(out)
                    out = []
            if out:
                yield _places(out)
    return task


def _places(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x) for x in zip(*rows, strict=True)], ["index", "at", "size", "key"])


def _captures_in(folder: str):
    """Captures of the keys that are asked of each block; rows come block by block."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lines, keys = None, [], []
        for batch in batches:
            out, names = [], batch.column("index").to_pylist()
            for name, at, size, key in zip(names, batch.column("at").to_pylist(), batch.column("size").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if block != (name, at):
                    with open_file(f"{folder}/{name}") as source:
                        lines = [x.split("\t") for x in zlib.decompress(source.read_at(size, at)).decode().split("\n")]
                    keys, block = [x[0].encode() for x in lines], (name, at)
                raw = key.encode()
                out += [(x[0], x[1], int(x[2]), int(x[3])) for x in lines[bisect.bisect_left(keys, raw):bisect.bisect_right(keys, raw)]]
            if out:
                yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], ["key", "file", "offset", "length"])
    return task


def look_up(archive: Archive, urls: DataFrame) -> DataFrame:
    """key, file, offset, length of every capture of the URLs (column ``url``), each once."""
    keys = urls.select("url").distinct().sortWithinPartitions("url")
    places = written(keys.mapInArrow(_blocks_of(archive), "index string, at long, size long, key string").distinct(), "places")  # URLs may share a key
    tasks = max(1, -(-places.count() // TASK_KEYS))
    return places.repartition(tasks, "index", "at").sortWithinPartitions("index", "at", "key").mapInArrow(_captures_in(archive.folder), _CAPTURE)


#: Archive bytes, and keys of URLs, that a task looks up, about.
TASK_BYTES, TASK_KEYS = 16 << 20, 20_000
_RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _records(folder: str, with_payload: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for file, at, length in zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if name != file:
                    if source:
                        source.close()
                    name, source = file, open_file(f"{folder}/{file}")
                fields, http, payload = parse(gzip.decompress(source.read_at(length, at)))
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                revisit = fields["warc-type"] == "revisit"
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{file} at {at}: the payload is not what its digest says")
                number = lambda k: int(fields[k]) if k in fields else None
                rows.append((number("page-id"), fields.get("warc-target-uri"), fields["warc-type"], digest, int(http["content-length"]) if revisit else len(payload),
                             number("refers-to-page-id"), payload if with_payload and not revisit else None))
                size += len(payload) if with_payload else 0
                if size >= 8 << 20:
                    yield _record_batch(rows)
                    rows, size = [], 0
            if rows:
                yield _record_batch(rows)
        if source:
            source.close()
    return task


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_records(archive: Archive, captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of captures, by range reads in the order of the files; a payload is checked against its digest.

    A capture is a row of some bytes and a record may be megabytes, so tasks are numbered by the bytes they read.
    """
    captures = written(captures, "captures")
    tasks = max(1, -(-(captures.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    dealt = captures.repartition(tasks, "file", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_records(archive.folder, with_payload), _RECORD)


