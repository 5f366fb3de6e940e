"""Shared folder, files in it, and input columns, as the operators of this subpackage use them."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words in Java patterns: a space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand texts on some megabytes at a time, unless the session was started with a setting of its own.

    With the default of 64 MB, twice that while a batch grows, and a batch in each direction in each running task, these buffers take more of an
    executor's memory than everything else outside its heap.
    """
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made, and only for a local master: a cluster's executors and driver do
    not see each other's disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, lineage cut, safe when executors are lost."""
    small_batches(df.sparkSession)
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("s3a:"):
        uri = "s3:" + uri[4:]
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, parts: Iterable[bytes]) -> int:
    """Write a file so that it appears whole or not at all; a repeated task puts the same file again.  Returns its size."""
    system, path = _file_system(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft, size = f"{path}.{uuid.uuid4().hex}.draft", 0
    with system.open_output_stream(draft, compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(draft, path)
    return size


def open_file(uri: str) -> pa.NativeFile:
    """A file for reads at given places."""
    system, path = _file_system(uri)
    return system.open_input_file(path)


_mapped: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()
#: Files that a worker keeps mapped (each holds a descriptor); the one used longest ago goes first.
MAPPED = 256


def mapped(uri: str, kind: str) -> np.ndarray:
    """A file of fixed-width numbers as an array.

    On a mounted folder the file is memory-mapped, so that workers of a machine share its pages; from an object store
    it is fetched once a worker.
    """
    if (uri, kind) not in _mapped:
        system, path = _file_system(uri)
        if isinstance(system, fs.LocalFileSystem):
            _mapped[uri, kind] = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        else:
            with system.open_input_file(path) as source:
                _mapped[uri, kind] = np.frombuffer(source.read(), kind)
        while len(_mapped) > MAPPED:
            _mapped.popitem(last=False)
    _mapped.move_to_end((uri, kind))
    return _mapped[uri, kind]


def found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur in a sorted array, and where.  Keys are best given in order: neighbours share pages."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys, at


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an integer's decimal text, modulo; null for a null."""
    return F.crc32(F.col(column).cast("string")) % modulus


def is_held_out(column: str, modulus: int, value: int) -> Column:
    """A row without an id is never held out."""
    return F.coalesce(remainder(column, modulus) == value, F.lit(False))


def whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches in the order of the group's columns."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        change = np.logical_or.reduce([(x := table.column(n).to_numpy(zero_copy_only=False)) != x[-1] for n in names])
        last = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
        if last:
            yield table.slice(0, last)
        held, size = table.slice(last).to_batches(), table.num_rows - last
    if held:
        yield pa.Table.from_batches(held)
