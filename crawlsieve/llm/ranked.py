"""Ranked lexical search: the k best documents for each item, by range-maximum tables over posting lists and best-first splitting.

Index.  A task cuts its documents into shards of about ``SHARD_WORDS`` terms and writes each as one file: documents in the order of doc_id with their number of
terms, and for each term (known by a 64-bit hash) its posting list, documents ascending, with the times it occurs there.

Search.  Totals over all shards give each term's weight.  Items are dealt in blocks of ``ITEMS``; a task takes some shards and all blocks, one after
another.  For the lists that the items need, a sparse table (level j: the maximum of every 2**j postings in a row) answers which posting of any
range weighs most, with two look-ups.  An interval of documents is bounded by the sum of these maxima over an item's terms.
Best-first: of the intervals that can still hold one of the k best, those with the highest bounds are split at the document of their
heaviest posting; that document is scored, and the two parts are bounded anew.  An interval is dropped when its bound is below the k-th score, or equal to it
where all its documents come after the k-th; no other document is left out, so the result is exact.  All items of a block move on together,
``AHEAD`` intervals each at a time, and the k-th scores go on from shard to shard of a task.

Score.  N documents have terms, L is the number of all their terms; a term in df documents weighs w = floor(1000 ln((2N + 2) / (2 df + 1))).  A document of n
terms has m = 75 + 25 n N div L; a term occurring tf times in it gives w * (10**9 tf div (1000 tf + 12 m)), for each time the item has the term.

A term is a run of characters other than ASCII non-alphanumerics, A-Z lowered.

Cases: a null or empty text has no terms and is never found; an item without terms, or whose terms occur nowhere, has no rows.  A null doc_id is found like others and
comes last among equals.  Repeated rows are documents, or items, of their own.  Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, open_file, put_file, written
from .sharedmap import SharedMap, share
from .words import byte_table, give_back, slices, words_of

TERMS = byte_table(bytes(i for i in range(128) if not chr(i).isalnum()))
#: Terms of a shard, items of a block, about; intervals of an item that are split in one step; shards of a task on large tables.
SHARD_WORDS, ITEMS, AHEAD, SHARDS = 2_000_000, 512, 4, 16
NULL_ID = np.iinfo(np.int64).max


@dataclass
class Index:
    """A folder of shards, the table of their names, and the totals over all of them."""

    folder: str
    shards: DataFrame
    n_shards: int
    docs: int
    words: int


def _put(uri: str, **arrays: np.ndarray) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    put_file(uri, [out.getbuffer()])


def _get(uri: str) -> dict[str, np.ndarray]:
    with open_file(uri) as source, np.load(io.BytesIO(source.read()), allow_pickle=False) as arrays:
        return dict(arrays)


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and times for each term of each text, text by text, and the number of terms of each text."""
    words = words_of(column, TERMS)
    order = np.lexsort((words.hashes, words.docs))
    docs, terms = words.docs[order], words.hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (terms[1:] != terms[:-1])
    first = np.flatnonzero(new)
    return docs[first], terms[first], np.diff(np.append(first, len(docs))), np.bincount(words.docs, minlength=len(column))


def _least_kind(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def build_index(docs: DataFrame) -> Index:
    """The index of (doc_id, text)."""
    folder = new_folder(docs.sparkSession, "index")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, doc_ids, sizes = 0, [], [], []

        def shard() -> pa.RecordBatch:
            nonlocal number
            name = f"shard-{TaskContext.get().partitionId():08d}-{number:06d}"
            number += 1
            ids, n = np.concatenate(doc_ids), np.concatenate(sizes)
            doc, term, times = (np.concatenate(x) for x in zip(*held, strict=True))
            by_id = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[by_id] = np.arange(len(ids))
            doc = place[doc]
            order = np.lexsort((doc, term))
            doc, term, times = doc[order], term[order], times[order]
            first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            _put(f"{folder}/{name}", doc_ids=ids[by_id], sizes=_least_kind(n[by_id]), terms=term[first], ends=_least_kind(np.append(first[1:], len(term))),
                 docs=_least_kind(doc), times=_least_kind(times))
            held.clear(), doc_ids.clear(), sizes.clear()
            give_back()
            return pa.record_batch([pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["name", "docs", "words"])

        words, count = 0, 0
        for batch in batches:
            for part in slices(batch):
                doc, term, times, n = term_counts(part.column("text"))
                some = np.flatnonzero(n)  # texts without a term are not found by any item
                if not len(some):
                    continue
                place = np.cumsum(n > 0) - 1 + count
                held.append((place[doc], term, times))
                doc_ids.append(part.column("doc_id").fill_null(int(NULL_ID)).to_numpy()[some])
                sizes.append(n[some])
                words, count = words + int(n.sum()), count + len(some)
                if words >= SHARD_WORDS:
                    yield shard()
                    words, count = 0, 0
        if count:
            yield shard()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = written(texts.mapInArrow(task, "name string, docs long, words long"), "shards")
    total = shards.agg(F.count("*").alias("shards"), F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    return Index(folder, shards.select("name"), total.shards, total.docs or 0, total.words or 0)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            item, term, times, _ = term_counts(part.column("text"))
            at = pa.array(item)
            yield pa.record_batch([part.column("item").take(at), part.column("item_id").take(at), pa.array(term.view(np.int64)), pa.array(times)], ["item", "item_id", "term", "times"])


def _document_counts(folder: str, wanted: SharedMap):
    """term, n: how many documents of a task's shards have it, for the terms that are wanted."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                shard = _get(f"{folder}/{name}")
                hit = wanted.has(shard["terms"])
                yield pa.record_batch([pa.array(shard["terms"][hit].view(np.int64)), pa.array(np.diff(shard["ends"].astype(np.int64), prepend=0)[hit])], ["term", "n"])
    return task


def _put_block(folder: str):
    """Writes the items of a block: their terms, one after another, with what each term weighs in the item."""

    def task(rows: pa.Table) -> pa.Table:
        item = rows.column("item").to_numpy()
        order = np.argsort(item, kind="stable")
        numbers, first = np.unique(item[order], return_index=True)
        block = rows.column("block")[0].as_py()
        _put(f"{folder}/items-{block}", items=numbers, first=np.append(first, len(item)), terms=rows.column("term").to_numpy().view(np.uint64)[order],
             weights=rows.column("weight").to_numpy()[order])
        return pa.table({"block": pa.array([block], pa.int32())})
    return task


class Lists:
    """The posting lists of a shard that some terms need, one after another, and the range-maximum table over their impacts."""

    def __init__(self, shard: dict[str, np.ndarray], terms: np.ndarray, docs: int, words: int):
        at = np.searchsorted(shard["terms"], terms)
        at[at == len(shard["terms"])] = 0
        self.terms = np.flatnonzero(shard["terms"][at] == terms)  # of the given ones, those that have a list
        at = at[self.terms]
        ends = shard["ends"].astype(np.int64)
        start = np.where(at > 0, ends[np.maximum(at - 1, 0)], 0)
        n = ends[at] - start
        self.n_docs, self.doc_ids = len(shard["doc_ids"]), shard["doc_ids"]
        places = np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        doc, times = shard["docs"][places].astype(np.int64), shard["times"][places].astype(np.int64)
        m = 75 + 25 * shard["sizes"].astype(np.int64) * docs // words
        self.doc, self.impact = doc, 1_000_000_000 * times // (1000 * times + 12 * m[doc])
        #: (list, document) as one number, ascending over all lists.
        self.keys = np.repeat(np.arange(len(n)), n) * self.n_docs + doc
        level = self.impact.astype(np.uint64) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(len(doc), dtype=np.uint64))
        levels, width = [level], 1
        while 2 * width <= int(n.max(initial=0)):  # rows may run past the end of a list; no question does
            level = np.maximum(level[:len(level) - width], level[width:])
            levels.append(np.pad(level, (0, len(doc) - len(level))))
            width *= 2
        self.levels = np.stack(levels)

    def places(self, lists: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Where in its list the first posting of a document at or after the given one is."""
        return np.searchsorted(self.keys, lists * self.n_docs + docs)

    def heaviest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest impact of each (not empty) range of places, and the first place that has it."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        best = np.maximum(self.levels[level, lo], self.levels[level, hi - (1 << level)])
        return (best >> np.uint64(32)).astype(np.int64), 0xFFFFFFFF - (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Best:
    """The k best documents so far of each of some items: by score descending, then doc_id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        #: Score and doc_id that a document must beat.
        self.least, self.last = np.zeros(n, np.int64), np.full(n, -1, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.append(a, b) for a, b in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.searchsorted(item, item)
        rank = np.arange(len(item)) - first
        kept = (rank < self.k) & (score > 0)
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]
        kth = rank[kept] == self.k - 1
        self.least[self.item[kth]], self.last[self.item[kth]] = self.score[kth], self.doc[kth]

    def may_enter(self, item: np.ndarray, bound: np.ndarray, first_doc: np.ndarray) -> np.ndarray:
        """Whether an interval with this bound and least doc_id can still change an item's best."""
        return (bound > self.least[item]) | ((bound == self.least[item]) & (bound > 0) & (first_doc < self.last[item]))


def _search_shard(lists: Lists, first: np.ndarray, term: np.ndarray, weight: np.ndarray, best: Best) -> int:
    """Best-first over the intervals of all items; gives the number of intervals that were split.

    Item i has the terms (numbers of lists) and weights from first[i] to first[i + 1].
    """
    def spread(item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each (row, term of its item), and where the term is."""
        n = first[item + 1] - first[item]
        return np.repeat(np.arange(len(item)), n), np.repeat(first[item] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))

    def bounded(item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """Those intervals that may hold a document to enter: item, lo, hi, bound, document to split at."""
        row, at = spread(item)
        a, b = lists.places(term[at], lo[row]), lists.places(term[at], hi[row])
        some = a < b
        row, at = row[some], at[some]
        impact, place = lists.heaviest(a[some], b[some])
        value = impact * weight[at]
        bound = _sums(row, value, len(item))
        top = np.zeros(len(item), np.int64)
        np.maximum.at(top, row, value)
        split = np.zeros(len(item), np.int64)
        is_top = value == top[row]
        split[row[is_top][::-1]] = lists.doc[place[is_top][::-1]]
        keep = best.may_enter(item, bound, lists.doc_ids[np.minimum(lo, lists.n_docs - 1)])
        return item[keep], lo[keep], hi[keep], bound[keep], split[keep]

    items = np.flatnonzero(np.diff(first))
    waiting = bounded(items, np.zeros(len(items), np.int64), np.full(len(items), lists.n_docs))
    steps = 0
    while len(waiting[0]):
        item, lo, hi, bound, split = waiting
        order = np.lexsort((-bound, item))
        ahead = np.zeros(len(item), bool)
        ranked = item[order]
        ahead[order] = np.arange(len(item)) - np.searchsorted(ranked, ranked) < AHEAD
        own, cut = item[ahead], split[ahead]
        steps += len(own)
        row, at = spread(own)
        place = np.minimum(lists.places(term[at], cut[row]), len(lists.doc) - 1)
        hit = lists.keys[place] == term[at] * lists.n_docs + cut[row]
        score = _sums(row[hit], lists.impact[place[hit]] * weight[at[hit]], len(own))
        best.add(own, score, lists.doc_ids[cut])
        left, right = lo[ahead] < cut, cut + 1 < hi[ahead]
        parts = bounded(np.append(own[left], own[right]), np.append(lo[ahead][left], cut[right] + 1), np.append(cut[left], hi[ahead][right]))
        still = ~ahead & best.may_enter(item, bound, lists.doc_ids[lo])
        waiting = tuple(np.append(x[still], y) for x, y in zip(waiting, parts, strict=True))
    return steps


def _sums(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Whole sums by ascending row."""
    total = np.append(0, np.cumsum(value))
    edges = np.searchsorted(row, np.arange(n + 1))
    return total[edges[1:]] - total[edges[:-1]]


def _searched(index_folder: str, folder: str, blocks: list[int], docs: int, words: int, k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name for batch in batches for name in batch.column("name").to_pylist()]
        for block in blocks if names else ():
            own = _get(f"{folder}/items-{block}")
            terms, number = np.unique(own["terms"], return_inverse=True)
            item = np.repeat(np.arange(len(own["items"])), np.diff(own["first"]))
            best = Best(len(own["items"]), k)
            for name in sorted(names):
                lists = Lists(_get(f"{index_folder}/{name}"), terms, docs, words)
                at = np.full(len(terms), -1)
                at[lists.terms] = np.arange(len(lists.terms))
                listed = at[number] >= 0
                if listed.any():
                    first = np.append(0, np.cumsum(np.bincount(item[listed], minlength=len(own["items"]))))
                    _search_shard(lists, first, at[number][listed], own["weights"][listed], best)
            yield pa.record_batch([pa.array(own["items"][best.item]), pa.array(best.doc, mask=best.doc == NULL_ID), pa.array(best.score)], ["item", "doc_id", "score"])
        give_back()
    return task


def search(index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents for every row of (item_id, text)."""
    spark = items.sparkSession
    rows = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    asked = written(rows.mapInArrow(_item_terms, f"item long, item_id {kind}, term long, times long"), "asked")
    count = asked.agg(F.count_distinct("item").alias("items"), F.count("*").alias("terms")).first()
    empty = "item_id, CAST(NULL AS INT) AS rank, CAST(NULL AS LONG) AS doc_id, CAST(NULL AS LONG) AS score"
    if not count["items"] or not index.n_shards:
        return items.selectExpr(*empty.split(", ")).limit(0)
    tasks = max(min(index.n_shards, 4 * spark.sparkContext.defaultParallelism), index.n_shards // SHARDS)
    shards = index.shards.repartition(tasks)
    wanted = share(asked.select(F.col("term").alias("key")).distinct(), "terms", count.terms)
    counts = shards.mapInArrow(_document_counts(index.folder, wanted), "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    folder, blocks = new_folder(spark, "blocks"), -(-count["items"] // ITEMS)
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.docs + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("times")
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")
    weighted = asked.join(counts, "term").select("item", "term", weight.alias("weight"), block)
    made = sorted(r.block for r in weighted.groupBy("block").applyInArrow(_put_block(folder), "block int").collect())  # a number a block of items
    found = shards.mapInArrow(_searched(index.folder, folder, made, index.docs, index.words, k), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")
