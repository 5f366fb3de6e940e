"""Chosen-path similarity join of texts on the Jaccard similarity of their sets of five-word shingles.

Texts with equal sets are one class and are joined as one row (a class keeps its number of texts).  In each of several runs a
class chooses each of its shingles with chance ``choices / (threshold * size)`` by a hash of (path, shingle); each chosen shingle
leads it to a bucket.  Large buckets are split again by choices under the longer path, except those that a sample of
sketches shows to be alike throughout; those, and what is still large at the last level, are dealt by bands of set size
(two sets of the threshold share a band) and compared in square blocks.
Small buckets are compared pair by pair: sizes, then sketches of 64 minima, then the sets themselves.  A pair that meets in
several buckets counts in the bucket with the least key both have, so links are counted without listing pairs.

Recall.  Two sets at the threshold share at least ``threshold * size`` of the larger set's shingles, so with c choices a level
keeps the pair with at least 1 - exp(-c), and any number of deeper levels with s = 1 - exp(-DEEPER * s).  The first level makes more choices
than the deeper ones, where more would let a passage that a third of all texts share stay together from level to level.
Runs are repeated until the chance to miss such a pair is below 1 - ``target_recall``; nearer pairs are missed more rarely still.  A set
whose paths outside large buckets reach that by themselves does not follow the large ones (``_needs_deeper``): most texts that have a line which a third of all
texts have.  The sketch test is 5.5 standard deviations wide (1e-7).

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a text of one to four words has one shingle, all its words.  Sets are known by
64-bit hashes, and classes by a 64-bit hash of the set and its size.

Cases: a null or empty text has no shingle: it is a class of its own without links.  A null doc_id is kept as a row; a component
takes its least known id (null only if it has none).  Repeated rows are texts with equal sets.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_groups, written
from .components import components
from .sharedmap import SharedMap, share
from .words import WHITE, Words, mix, ngrams, slices, words_of

WIDTH = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.99999
CHOICES, DEEPER = 4.0, 1.5
#: Classes in a bucket that is compared as it is, rows of a block of a larger one, levels of splitting.
SMALL, BLOCK, LEVELS = 512, 512, 3
BINS = 64
_ALIKE = 0.6


def n_runs(target_recall: float = TARGET_RECALL) -> int:
    s = 1.0
    for _ in range(1000):
        s = 1 - math.exp(-DEEPER * s)
    return max(1, math.ceil(math.log(1 - target_recall) / (-CHOICES * s)))


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, text by text, and their numbers; a short text has its words as one."""
    words = words_of(column, WHITE)
    grams, first = ngrams(words, width)
    docs = words.docs[first]
    counts = np.bincount(words.docs, minlength=len(column))
    for n in range(1, width):
        few = counts[words.docs] == n
        if few.any():
            short, at = ngrams(Words(*(x[few] for x in words)), n)
            grams, docs = np.append(grams, short), np.append(docs, words.docs[few][at])
    order = np.lexsort((grams, docs))
    grams, docs = grams[order], docs[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
    grams, docs = grams[new], docs[new]
    return grams, np.bincount(docs, minlength=len(column)).astype(np.int64)


def class_ids(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number for each set, alike for equal sets; 0 for an empty one."""
    ends = np.cumsum(sizes)
    sums = np.append(np.uint64(0), np.cumsum(mix(grams), dtype=np.uint64))
    ids = mix((sums[ends] - sums[ends - sizes]) * np.uint64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64))
    return np.where(sizes > 0, ids, np.uint64(0))


def sketches(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A byte for each of 64 bins: of the least hash that falls there; 0 if none does."""
    scrambled = mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    row = np.repeat(np.arange(len(sizes)), sizes)
    least = np.full(len(sizes) * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, row * BINS + (scrambled >> np.uint64(58)).astype(np.int64), scrambled & np.uint64((1 << 58) - 1))
    empty = least == np.iinfo(np.uint64).max
    return np.where(empty, 0, mix(least) % np.uint64(255) + np.uint64(1)).astype(np.uint8).reshape(len(sizes), BINS)


def _chosen(paths: np.ndarray, row: np.ndarray, grams: np.ndarray, sizes: np.ndarray, threshold: float, choices: float) -> tuple[np.ndarray, np.ndarray]:
    """Longer paths of (path, row) and their rows: every shingle of the row is tried under the path."""
    n = sizes[row]
    starts = (np.cumsum(sizes) - sizes)[row]
    at = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    key = mix(np.repeat(paths, n) * np.uint64(0x9E3779B97F4A7C15) + grams[at])
    most = np.minimum(choices / (threshold * n), 1.0) * 2.0 ** 63
    keep = (key >> np.uint64(1)) <= np.repeat(most, n).astype(np.uint64)
    return mix(key[keep] ^ np.uint64(0x5DEECE66D)), np.repeat(row, n)[keep]


def _first_paths(grams: np.ndarray, sizes: np.ndarray, threshold: float, runs: int) -> tuple[np.ndarray, np.ndarray]:
    row = np.flatnonzero(sizes)
    row, run = np.tile(row, runs), np.repeat(np.arange(runs), len(row))
    return _chosen(mix(run.astype(np.uint64)), row, grams, sizes, threshold, CHOICES)


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(row, kind="stable")
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order].view(np.int64)))


def _blobs(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _described(threshold: float, runs: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                grams, sizes = shingle_sets(part.column("text"))
                paths, row = _first_paths(grams, sizes, threshold, runs)
                ids = class_ids(grams, sizes)
                yield pa.record_batch([part.column("doc_id"), pa.array(ids.view(np.int64), mask=sizes == 0), pa.array(sizes.astype(np.int32)), _blobs(sketches(grams, sizes)), _lists(paths, row, len(sizes))],
                                      ["doc_id", "class", "size", "sketch", "paths"])
    return task


def _sets_of(part: pa.RecordBatch, classes: SharedMap | None):
    """Sets of the rows whose class is in the map (by the id of the class's first row), as ``shingle_sets`` gives them."""
    ids = part.column("doc_id").to_numpy(zero_copy_only=False) if not part.column("doc_id").null_count else None
    if ids is not None and classes is not None:
        hit = classes.has(mix(ids.astype(np.int64).view(np.uint64)))
        part = part.filter(pa.array(hit))
    return shingle_sets(part.column("text"))


def _needs_deeper(row: np.ndarray, large: np.ndarray, n: int, threshold: float, target_recall: float) -> np.ndarray:
    """Which of ``n`` sets must follow their large buckets: those whose other paths, of all runs, may miss a partner more often than the target allows.

    A share f of a set's paths leads to large buckets (taken two standard deviations higher than seen), so of its other shingles a partner shares at
    least (threshold - f) / (1 - f), and misses all m other paths with one less that to the power of m.  It is enough if one of two partners stays.
    """
    total = np.bincount(row, minlength=n)
    k = np.bincount(row[large], minlength=n)
    f = k / np.maximum(total, 1)
    f = np.minimum(f + 2 * np.sqrt(f * (1 - f) / np.maximum(total, 1)), 1.0)
    shared = np.clip((threshold - f) / np.maximum(1 - f, 1e-9), 0.0, 1.0)
    return (k > 0) & ((1 - shared) ** (total - k) > 1 - target_recall)


def _deeper(threshold: float, target_recall: float, firsts: SharedMap, large: list[SharedMap]):
    """Paths one level below the large buckets of the last level."""
    runs = n_runs(target_recall)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                grams, sizes = _sets_of(part, firsts)
                paths, row = _first_paths(grams, sizes, threshold, runs)
                for depth, level in enumerate(large):
                    hit = level.has(paths)
                    if not depth:
                        hit &= _needs_deeper(row, hit, len(sizes), threshold, target_recall)[row]
                    paths, row = _chosen(paths[hit], row[hit], grams, sizes, threshold, DEEPER)
                yield pa.record_batch([_signed(paths), _signed(class_ids(grams, sizes)[row])], ["key", "class"])
    return task


def _pairs(start: np.ndarray, n: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within the groups that begin at ``start``, some groups at a time."""
    group = np.repeat(np.arange(len(n)), n)
    place = np.repeat(start, n) + (np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n))
    later = np.repeat(start + n, n) - place - 1
    edges = np.searchsorted(np.cumsum(later), np.arange(0, int(later.sum()) + most, most))
    for lo, hi in zip(edges[:-1], np.append(edges[1:-1], len(place))):
        m, a = later[lo:hi], place[lo:hi]
        left = np.repeat(a, m)
        yield left, left + 1 + (np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m))


def _likely(a: np.ndarray, b: np.ndarray, size: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of some pairs of places that may reach the threshold, by their sizes and sketches."""
    ok = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
    a, b = a[ok], b[ok]
    ok = np.zeros(len(a), bool)
    for lo in range(0, len(a), 50_000):
        x, y = sketch[a[lo:lo + 50_000]], sketch[b[lo:lo + 50_000]]
        n = ((x | y) != 0).sum(1)
        same = ((x == y) & (x != 0)).sum(1)
        ok[lo:lo + 50_000] = same >= threshold * n - 5.5 * np.sqrt(threshold * (1 - threshold) * n)
    return a[ok], b[ok]


def _is_least_common(a: np.ndarray, b: np.ndarray, key: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of some pairs of places, whether no key smaller than that of the bucket is in both padded lists."""
    out = np.ones(len(a), bool)
    for column in range(keys.shape[1]):
        value = keys[a, column]
        at = np.flatnonzero(out & (value < key[a]))
        for lo in range(0, len(at), 20_000):
            i = at[lo:lo + 20_000]
            out[i[(keys[b[i]] == value[i, None]).any(1)]] = False
    return out


_PAD = np.iinfo(np.int64).max


def _padded(lists: pa.ChunkedArray) -> np.ndarray:
    lists = lists.combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    out = np.full((len(n), int(n.max(initial=1))), _PAD, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
    return out


def _matrix(blobs: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(-1, BINS)


def _groups(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key, cell = table.column("key").to_numpy(), table.column("cell").to_numpy()
    start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
    return start, np.diff(np.append(start, len(key)))


def _likely_members(threshold: float):
    """Members of a bucket that have a likely partner in it, by sizes and sketches."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("key", "cell")):
            size, sketch, side, key = table.column("size").to_numpy(), _matrix(table.column("sketch")), table.column("side").to_numpy(), table.column("key").to_numpy()
            keys, crossing = _padded(table.column("keys")), table.column("crossing").to_numpy()
            marked = np.zeros(len(size), bool)
            for a, b in _pairs(*_groups(table)):
                ok = (side[a] != side[b]) | ~crossing[a]
                a, b = a[ok], b[ok]
                for column in range(min(3, keys.shape[1])):  # most pairs that met before meet at the same place of their lists
                    ok = (keys[a, column] != keys[b, column]) | (keys[a, column] >= key[a])
                    a, b = a[ok], b[ok]
                a, b = _likely(a, b, size, sketch, threshold)
                ok = _is_least_common(a, b, key, keys)
                marked[a[ok]] = marked[b[ok]] = True
            kept = table.filter(pa.array(marked))
            yield from kept.select(["key", "cell", "side", "crossing", "class", "first_id", "texts", "keys"]).to_batches()
    return task


def _with_sets(firsts: SharedMap, members: SharedMap):
    """(place, set): the set of a class for each place at which it is to be compared."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                grams, sizes = _sets_of(part, firsts)
                ids = class_ids(grams, sizes)
                once, at_once = np.unique(ids, return_index=True)
                ends = np.cumsum(sizes)
                for at, n, values in members.rows(once):
                    own = [grams[ends[i] - sizes[i]:ends[i]].tobytes() for i in at_once[at]]
                    # a set travels once for each bucket; slices keep the batch small
                    row = np.repeat(np.arange(len(at)), n)
                    for lo in range(0, len(row), 256):
                        r = row[lo:lo + 256]
                        yield pa.record_batch([_signed(once[at][r]), pa.array(values[lo:lo + 256]), pa.array([own[i] for i in r.tolist()], pa.binary())], ["class", "place", "grams"])
    return task


def _compared(threshold: float):
    """Links of a bucket, by sets: for each member the texts it is linked to and the least member it hangs together with."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("key", "cell"), 300):
            ids, key = table.column("class").to_numpy(), table.column("key").to_numpy()
            side, crossing, texts = table.column("side").to_numpy(), table.column("crossing").to_numpy(), table.column("texts").to_numpy()
            keys = _padded(table.column("keys"))
            linked, root, links = np.zeros(len(ids), np.int64), ids.copy(), []
            grams = table.column("grams")
            for start, n in zip(*_groups(table)):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in grams.slice(start, n)]
                shared = _shared(sets)
                sizes = np.array([len(x) for x in sets], float)
                hit = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-6
                a, b = np.nonzero(np.triu(hit, 1))
                a, b = a + start, b + start
                ok = ((side[a] != side[b]) | ~crossing[a]) & (ids[a] != ids[b])
                a, b = a[ok], b[ok]
                ok = _is_least_common(a, b, key, keys)
                a, b = a[ok], b[ok]
                np.add.at(linked, a, texts[b])
                np.add.at(linked, b, texts[a])
                links.append((a, b))
            a, b = (np.concatenate(x) for x in zip(*links))
            while len(a):  # least member that is reached in this bucket
                low = np.minimum(root[a], root[b])
                old = root.copy()
                np.minimum.at(root, a, low)
                np.minimum.at(root, b, low)
                if (old == root).all():
                    break
            some = linked > 0
            yield pa.record_batch([pa.array(ids[some]), pa.array(linked[some]), pa.array(root[some])], ["class", "linked", "root"])
    return task


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of some sets."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]], float)
    tokens = np.concatenate(sets)
    member = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, member = tokens[order], member[order]
    new = np.append(True, tokens[1:] != tokens[:-1])
    column = np.cumsum(new) - 1
    often = (np.bincount(column) > 1)
    keep = often[column]
    column, member = (np.cumsum(often) - 1)[column[keep]], member[keep]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    edges = np.searchsorted(column, np.arange(0, int(often.sum()) + width, width))
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        block = np.zeros((len(sets), width), np.float32)
        block[member[lo:hi], column[lo:hi] - k * width] = 1
        out += block @ block.T
    return out.astype(float)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Large buckets, and whether eight sketches drawn from each are alike."""
    for batch in batches:
        drawn = np.stack([np.frombuffer(b"".join(batch.column(f"s{i}").to_pylist()), np.uint8).reshape(-1, BINS) for i in range(8)], 1)
        same = np.zeros(batch.num_rows)
        for i in range(8):
            for j in range(i):
                same += ((drawn[:, i] == drawn[:, j]) & (drawn[:, i] != 0)).sum(1) / np.maximum(((drawn[:, i] | drawn[:, j]) != 0).sum(1), 1)
        yield pa.record_batch([batch.column("key"), pa.array(same / 28 >= _ALIKE)], ["key", "alike"])


def similar(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, n_links, copy_id for every row of (doc_id, text).

    class_id is the least doc_id that links lead to, n_links the number of other rows with a similarity at or above
    the threshold, copy_id the least doc_id with an equal set.
    """
    runs = n_runs(target_recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(texts.mapInArrow(_described(threshold, runs), "doc_id long, class long, size int, sketch binary, paths array<long>"), "described")
    classes = written(rows.filter("class IS NOT NULL").groupBy("class").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("texts"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")), "classes")

    # buckets, level by level
    members = classes.selectExpr("explode(paths) AS key", "class")
    leaves, large, firsts = [], [], None
    for level in range(LEVELS):
        if level:
            members = texts.mapInArrow(_deeper(threshold, target_recall, firsts, large), "key long, class long").distinct()
        members = written(members.join(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"), "members")
        leaves.append(members.filter(F.col("n") <= SMALL))
        wide = members.filter(F.col("n") > SMALL)
        if level == LEVELS - 1:
            leaves.append(wide)
            break
        split = wide.select("key").distinct()
        if not level:
            draws = [F.min_by("sketch", F.xxhash64("class", F.lit(i))).alias(f"s{i}") for i in range(8)]
            judged = wide.join(classes.select("class", "sketch"), "class").groupBy("key").agg(*draws).mapInArrow(_alike, "key long, alike boolean")
            judged = written(judged, "judged")
            leaves.append(wide.join(judged.filter("alike"), "key", "left_semi"))
            split = judged.filter("NOT alike").select("key")
        n = split.count()
        if not n:
            break
        large.append(share(split, "large", n))
        if not level:  # the classes that go deeper; later levels have some of these
            firsts = _firsts(wide.join(split, "key", "left_semi").select("class").distinct().join(classes.select("class", "first_id"), "class"))

    leaf = leaves[0]
    for more in leaves[1:]:
        leaf = leaf.unionByName(more)
    band = f"CAST(floor(ln(size) / {math.log(1 / threshold) * 1.0001}) AS INT)"
    banded = leaf.filter(F.col("n") > SMALL).join(classes.select("class", "size"), "class").selectExpr("class", "key", f"explode(array({band}, {band} + 1)) AS band")
    leaf = written(leaf.filter(F.col("n") <= SMALL).select("key", "class").unionByName(banded.select(F.xxhash64("key", "band").alias("key"), "class")), "leaves")
    # of buckets with the same members one is enough
    sizes = leaf.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")).filter("n > 1")
    leaf = written(leaf.join(sizes.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), "key"), "leaves")
    keys = leaf.groupBy("class").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # bounded: paths of one class
    known = classes.select("class", "first_id", "texts", "size", "sketch").join(keys, "class")
    blocks = (leaf.join(known, "class")
              .withColumn("square", F.when(F.col("n") > SMALL, F.ceil(F.col("n") / BLOCK)).otherwise(1).cast("int"))
              .withColumn("block", F.pmod(F.xxhash64("class", F.lit(99)), F.col("square")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("square") - 1)))
              .selectExpr("key", "CAST(least(block, other) AS LONG) * square + greatest(block, other) AS cell", "IF(block <= other, 0, 1) AS side",
                          "block <> other AS crossing", "class", "first_id", "texts", "size", "sketch", "keys"))  # across two blocks only pairs across count
    near = blocks.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(
        _likely_members(threshold), "key long, cell long, side int, crossing boolean, class long, first_id long, texts long, keys array<long>")
    near = written(near.withColumn("place", F.xxhash64("key", "cell")), "near")

    n = near.count()
    firsts = _firsts(near.select("class", "first_id").distinct())
    places = share(near.select(F.col("class").alias("key"), F.col("place").alias("value")), "places", n)
    sets = texts.mapInArrow(_with_sets(firsts, places), "class long, place long, grams binary")
    compared = (near.join(sets.dropDuplicates(["class", "place"]), ["class", "place"])
                .repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_compared(threshold), "class long, linked long, root long"))
    compared = written(compared, "compared")
    roots = components(compared.select(F.col("class").alias("u"), F.col("root").alias("v")))
    linked = compared.groupBy("class").agg(F.sum("linked").alias("linked"))
    grouped = classes.select("class", "first_id", "texts").join(roots, F.col("class") == F.col("node"), "left").join(linked, "class", "left")
    grouped = written(grouped.selectExpr("class", "first_id", "texts - 1 + coalesce(linked, 0) AS n_links", "coalesce(root, class) AS root"), "grouped")
    least = grouped.groupBy("root").agg(F.min("first_id").alias("class_id"))
    answer = grouped.join(least, "root").select("class", "class_id", "n_links", F.col("first_id").alias("copy_id"))
    found = rows.select("doc_id", "class").filter("class IS NOT NULL").join(answer, "class").select("doc_id", "class_id", "n_links", "copy_id")
    alone = rows.filter("class IS NULL").selectExpr("doc_id", "doc_id AS class_id", "0L AS n_links", "doc_id AS copy_id")
    return found.unionByName(alone)


def _firsts(rows: DataFrame) -> SharedMap:
    """Ids of the first texts of some classes (class, first_id), scrambled, so that other copies need not be cut into words."""
    ids = written(rows.select("first_id").filter("first_id IS NOT NULL").distinct().mapInArrow(_scrambled, "key long"), "firsts")
    return share(ids, "firsts", max(1, ids.count()))


def _scrambled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([_signed(mix(batch.column(0).to_numpy().view(np.uint64)))], ["key"])
