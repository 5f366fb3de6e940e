"""Sorted arrays in the shared folder, written by tasks and memory-mapped by workers: look-ups without a join or a broadcast."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import found, mapped, new_folder, put_file, written
from .words import mix

#: Rows of one file, about.
FILE_ROWS = 500_000


@dataclass
class SharedMap:
    """Keys (64-bit, in order within the file of their first ``bits`` bits) with a run of 64-bit values each.

    Keys are scrambled hashes, so files are alike in size whatever the rows are.
    """

    folder: str
    bits: int
    size: int

    def rows(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """File by file: places of ``keys`` that are in it, how many values each has, and the values one after another."""
        if not self.size or not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        home = (ordered >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        firsts = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
        for lo, hi in zip(firsts, np.append(firsts[1:], len(keys))):
            name = f"{self.folder}/{{}}-{int(home[lo])}"
            try:
                own = mapped(name.format("keys"), "u8")
            except FileNotFoundError:  # no key falls there
                continue
            hit, at = found(own, ordered[lo:hi])
            if not hit.any():
                continue
            at, ends = at[hit], mapped(name.format("ends"), "i8")
            stop = np.asarray(ends[at])
            start = np.where(at > 0, ends[np.maximum(at - 1, 0)], 0)
            n = stop - start
            places = np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            yield order[lo:hi][hit], n, np.asarray(mapped(name.format("values"), "i8")[places]) if len(places) else places

    def files(self) -> Iterator[np.ndarray]:
        """The keys, file by file."""
        for bucket in range(1 << self.bits if self.size else 0):
            with suppress(FileNotFoundError):
                yield mapped(f"{self.folder}/keys-{bucket}", "u8")

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for at, _, _ in self.rows(keys):
            out[at] = True
        return out


def share(rows: DataFrame, name: str, size: int) -> SharedMap:
    """A map of ``rows`` (key long, perhaps value long).  ``size`` is their number, or more.

    A key's values stay in one file: callers give keys with few rows each.
    """
    bits = max(0, math.ceil(math.log2(max(1, size / FILE_ROWS))))
    out = SharedMap(new_folder(rows.sparkSession, name), bits, size)
    if not size:
        return out
    valued = "value" in rows.columns

    def task(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        keys = group.column("key").to_numpy().view(np.uint64)
        values = group.column("value").to_numpy() if valued else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ends = np.append(firsts[1:], len(keys)).astype(np.int64)
        put_file(f"{out.folder}/keys-{bucket}", [keys[firsts].tobytes()])
        put_file(f"{out.folder}/ends-{bucket}", [(ends if valued else np.zeros(len(firsts), np.int64)).tobytes()])
        put_file(f"{out.folder}/values-{bucket}", [values[order].tobytes() if valued else b""])
        return pa.table({"n": pa.array([len(firsts)], pa.int64())})

    bucket = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    rows.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(task, "n long").agg(F.sum("n")).collect()
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array(mix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], ["key"])


def without(rows: DataFrame, column: str, dropped: DataFrame, name: str) -> DataFrame:
    """The rows whose number (``column``, long, never null) is not in ``dropped`` (one long column).

    The rows stay where they are: the dropped numbers are looked up in files that tasks share, so no text is shuffled however many numbers there are.
    """
    keys = written(dropped.distinct().mapInArrow(_hashed, "key long"), name)
    known = share(keys, name, keys.count())
    place = rows.columns.index(column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = known.has(mix(batch.column(place).to_numpy().view(np.uint64)))
            yield batch.filter(pa.array(~hit)) if hit.any() else batch
    return rows.mapInArrow(task, rows.schema)
