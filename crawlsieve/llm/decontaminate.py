"""Benchmark decontamination: word triples join passages to test items, Smith-Waterman alignment scores the pairs.

Words are runs of letters, digits, apostrophes and bytes above 127, A-Z lowered.  A triple is three words in order, next to each other or with
one other word after the first or the second.  A text that has a triple of an item gives the passage around it, as long as the item and as many words on
either side as an alignment of the threshold can have inserted; hits of one item that lie on diagonals further apart give passages of their own.
A passage is aligned with the item word by word (match 2, other word -1, gap -1); its similarity is the score over that of the whole item.

Rare seeds.  A first pass counts how often each triple of an item occurs in all texts.  M matches and S shared triples score at most M + S + 2 (where three
matches in a row are no triple, two edits lie between them), so an alignment of similarity ``EXACT_FROM`` or more with an item of n words shares at least
k = (2 * EXACT_FROM - 1) * n - 2 of its triples, and one of all but the k - 1 most frequent ones.  These are the item's seeds: a phrase that thousands of items and
most texts have is none.  So every copy from ``EXACT_FROM`` on is aligned; one between the threshold and that is, if it has one of the seeds.  A triple that no text has is
not counted.  Passages for which M + S + 2 is below the threshold, M being the words of the item that they have, are left out before the alignment, which loses none.
Seeds lie in mapped files and may grow.  Passages and items meet in a join that Spark may broadcast by the measured size of the item table, and else splits where an item is hot.

Cases: a null or empty text or item has no words and matches nothing.  An item of fewer words than ``MIN_ITEM_WORDS`` cannot be told
from ordinary use and matches nothing.  An item of over ``PART`` words is compared in overlapping parts and keeps the best.  Repeated items are found each.  Rows without doc_id are
compared too; several rows of one doc_id give one result, of the best passage.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .sharedmap import SharedMap, share
from .words import ALNUM, mix, slices, words_of

MIN_ITEM_WORDS = 5
MIN_SIMILARITY = 0.5
#: From this similarity on no copy is missed.
EXACT_FROM = 0.6
PART = 2_000
MATCH, OTHER, GAP = 2, -1, -1


def _triples(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the triples that lie within one text, and the index of each one's first word; spacing does not change the hash."""
    step = lambda value, words: mix(value * np.uint64(0x9E3779B97F4A7C15) + words)
    n = len(hashes)
    if n < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    one = mix(hashes)
    two = step(one[:n - 1], hashes[1:])
    grams = [step(two[:n - 2], hashes[2:]), step(two[:n - 3], hashes[3:]), step(step(one[:n - 3], hashes[2:n - 1]), hashes[3:])]
    near, wide = np.flatnonzero(docs[:n - 2] == docs[2:]), np.flatnonzero(docs[:n - 3] == docs[3:])
    return np.concatenate([g[at] for g, at in zip(grams, (near, wide, wide), strict=True)]), np.concatenate([near, wide, wide])


def _item_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, triples and their places of each item; an item over ``PART`` words in halfway overlapping parts."""
    for batch in batches:
        for part in slices(batch):
            words = words_of(part.column("text"), ALNUM)
            n = np.bincount(words.docs, minlength=part.num_rows)
            rows: list[list] = [[], [], [], [], []]
            for item, k, end in zip(part.column("item_id").to_pylist(), n.tolist(), np.cumsum(n).tolist(), strict=True):
                for lo in range(end - k, max(end - PART // 2, end - k + 1), PART // 2) if k >= MIN_ITEM_WORDS else ():
                    high = min(lo + PART, end)
                    own, places = _triples(words.hashes[lo:high], words.docs[lo:high])
                    for column, value in zip(rows, (item, words.hashes[lo:high].tobytes(), own.view(np.int64).tolist(), places.tolist(), high - lo), strict=True):
                        column.append(value)
            kinds = (part.column("item_id").type, pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            yield pa.record_batch([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["item_id", "words", "grams", "places", "length"])


class _Filter:
    """A bit for each of 2 ** 20 slots, to pass over nearly all n-grams before they are looked up."""

    def __init__(self, grams: SharedMap):
        self.grams, self.slots = grams, np.zeros(1 << 20, bool)
        for own in grams.files():
            self.slots[np.asarray(own) & np.uint64((1 << 20) - 1)] = True

    def hits(self, grams: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.slots[grams & np.uint64((1 << 20) - 1)])
        return at[self.grams.has(grams[at])]


def _overlap(passages: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """How many words of each item its passage has, or more."""
    tagged = [mix(np.concatenate(x) + np.repeat(np.arange(len(x), dtype=np.uint64), list(map(len, x))) * np.uint64(0x9E3779B97F4A7C15)) for x in (passages, items)]
    has = np.isin(tagged[1], tagged[0])
    return np.bincount(np.repeat(np.arange(len(items)), list(map(len, items))), has, len(items)).astype(np.int64)


def _left_out(length):
    """How many of the most frequent triples of an item of so many words are no seeds."""
    return np.maximum(np.ceil((2 * EXACT_FROM - 1) * length - 2 - 1e-9) - 1, 0).astype(np.int64)


def _frequencies(grams: SharedMap):
    """(key, n): how often the triples of items occur, summed over some megabytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Filter(grams)
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"), ALNUM)
                own, _ = _triples(words.hashes, words.docs)
                gram, n = np.unique(own[known.hits(own)], return_counts=True)
                yield pa.record_batch([pa.array(gram.view(np.int64)), pa.array(n)], ["key", "n"])
    return task


def rare_seeds(texts: DataFrame, triples: DataFrame) -> DataFrame:
    """(key, value) of the triples (item, length, key, place) that are seeds: those that occur in ``texts``, without the most frequent ones of each item."""
    keys = written(triples.select("key").distinct(), "triples")
    counts = texts.mapInArrow(_frequencies(share(keys, "triples", keys.count())), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # an item (or part of one) has some thousand triples at most
    of_item = Window.partitionBy("item")
    kept = F.col("total") - F.greatest(F.ceil((2 * EXACT_FROM - 1) * F.col("length") - 2 - 1e-9) - 1, F.lit(0))
    ranked = triples.join(counts, "key").withColumn("rank", F.row_number().over(of_item.orderBy("n", "key", "place"))).withColumn("total", F.count("*").over(of_item))
    # numbers fit: an item's place and length take 16 bits each; longer items come in parts
    return ranked.filter(F.col("rank") <= kept).selectExpr("key", "shiftleft(CAST(item AS LONG), 32) + shiftleft(CAST(place AS LONG), 16) + length AS value")


def _passages(seeds: SharedMap, item_words: SharedMap, min_similarity: float):
    """(doc_id, item, words): passages of texts around the seeds of items that may reach the similarity."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Filter(seeds)
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"), ALNUM)
                own, first = _triples(words.hashes, words.docs)
                at = known.hits(own)
                got = []
                for hit, n, values in seeds.rows(own[at]):
                    # a value: number of the item, place of the seed in it, length of the item
                    place = np.repeat(first[at[hit]], n)
                    got.append(np.stack([values >> 32, words.docs[place], place - ((values >> 16) & 0xFFFF), values & 0xFFFF]))
                if not got:
                    continue
                item, doc, start, length = np.concatenate(got, 1)
                order = np.lexsort((start, item, doc))
                item, doc, start, length = (x[order] for x in (item, doc, start, length))
                pair = np.append(True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]))
                new = pair.copy()
                new[1:] |= start[1:] - start[:-1] > length[1:] // 2
                head = np.flatnonzero(new)
                last = np.append(head[1:], len(item)) - 1
                n_seeds = np.bincount(np.cumsum(pair) - 1)[(np.cumsum(pair) - 1)[head]]
                n = np.bincount(words.docs, minlength=part.num_rows)
                ends = np.cumsum(n)
                margin = np.ceil(2 * max(0.0, 1 - min_similarity) * length[head]).astype(np.int64)
                low = np.maximum(start[head] - margin, (ends - n)[doc[head]])
                high = np.minimum(start[last] + length[head] + margin, ends[doc[head]])
                ids = part.column("doc_id").take(pa.array(doc[head]))
                once = np.unique(item)
                texts: dict[int, np.ndarray] = {}
                for k, m, values in item_words.rows(mix(once.view(np.uint64))):
                    texts |= zip(once[k].tolist(), np.split(values.view(np.uint64), np.cumsum(m)[:-1]), strict=True)
                for lo in range(0, len(head), 2000):
                    k = slice(lo, lo + 2000)
                    passages = [words.hashes[a:b] for a, b in zip(low[k].tolist(), high[k].tolist(), strict=True)]
                    most = _overlap(passages, [texts[i] for i in item[head][k].tolist()]) + n_seeds[k] + _left_out(length[head][k]) + 2
                    some = np.flatnonzero(most >= MATCH * min_similarity * length[head][k] - 1e-6)
                    if len(some):
                        yield pa.record_batch([ids[k].take(pa.array(some)), pa.array(item[head][k][some]), pa.array([passages[i].tobytes() for i in some.tolist()], pa.binary())], ["doc_id", "item", "passage"])
    return task


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each passage with its item, all at once, a row of the item at a time."""
    height, width = max(map(len, items)), max(map(len, passages))
    text = np.zeros((len(items), width), np.uint64)
    item = np.zeros((len(items), height), np.uint64)
    for i, (a, b) in enumerate(zip(passages, items, strict=True)):
        text[i, :len(a)], item[i, :len(b)] = a, b
    inside = np.arange(width)[None] < np.array([len(x) for x in passages])[:, None]
    steps = np.arange(width + 1) * -GAP
    row, best = np.zeros((len(items), width + 1), np.int32), np.zeros(len(items), np.int32)
    lengths = np.array([len(x) for x in items])
    for i in range(height):
        gain = np.where((text == item[:, i, None]) & inside, MATCH, OTHER)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(np.maximum(row[:, :-1] + gain, row[:, 1:] + GAP), 0)
        row = (np.maximum.accumulate(new + steps, 1) - steps).astype(np.int32)  # gaps along the passage
        row[i >= lengths] = 0
        best = np.maximum(best, row.max(1))
    return best


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        passages = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("passage")]
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("words")]
        cells = np.array([len(a) * (len(b) + 8) for a, b in zip(passages, items, strict=True)])
        order, score = np.argsort([len(b) for b in items], kind="stable"), np.zeros(len(items), np.int64)
        at = 0
        while at < len(order):
            end = at + max(1, int(np.searchsorted(np.maximum.accumulate(cells[order[at:at + 512]]) * np.arange(1, len(order[at:at + 512]) + 1), 4_000_000)))
            some = order[at:end].tolist()
            score[some] = align([passages[i] for i in some], [items[i] for i in some])
            at = end
        similarity = score / (MATCH * np.array([max(1, len(b)) for b in items]))
        yield pa.record_batch([batch.column("doc_id"), batch.column("item_id"), pa.array(score), pa.array(similarity)], ["doc_id", "item_id", "score", "similarity"])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, value): each word of each item, by the scrambled number of the item."""
    for batch in batches:
        for item, own in zip(batch.column("item").to_pylist(), batch.column("words"), strict=True):
            words = np.frombuffer(own.as_buffer(), np.int64)
            yield pa.record_batch([pa.array(np.repeat(mix(np.array([item], np.uint64)).view(np.int64), len(words))), pa.array(words)], ["key", "value"])


def contaminated(docs: DataFrame, items: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """doc_id, item_id, score, similarity: each row of ``docs`` (doc_id, text) and test item (item_id, text) that align well."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    parts = items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(_item_parts, f"item_id {kind}, words binary, grams array<long>, places array<long>, length long")
    parts = written(parts.withColumn("item", F.monotonically_increasing_id()), "items")
    # numbers of 31 bits in the order of the rows
    starts = parts.select((F.col("item").bitwiseAND((1 << 33) - 1)).alias("n"), F.shiftrightunsigned("item", 33).alias("task"))
    sizes = {r.task: r.n for r in starts.groupBy("task").agg(F.max("n").alias("n")).collect()}
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k] + 1
    if not total:
        return docs.sparkSession.createDataFrame([], f"doc_id long, item_id {kind}, score long, similarity double")
    base = F.create_map(*[F.lit(int(x)) for kv in before.items() for x in kv])
    parts = parts.withColumn("item", base[F.shiftrightunsigned("item", 33)] + F.col("item").bitwiseAND((1 << 33) - 1))

    triples = parts.selectExpr("item", "length", "explode(arrays_zip(grams, places)) AS g").selectExpr("item", "length", "g.grams AS key", "g.places AS place").distinct()
    seeds = written(rare_seeds(texts, written(triples, "item-triples")), "seeds")
    item_words = parts.select(F.col("item").cast("long").alias("item"), "words").mapInArrow(_word_rows, "key long, value long")
    seed_map, word_map = share(seeds, "seeds", seeds.count()), share(item_words, "words", parts.agg(F.sum("length")).first()[0])
    passages = texts.mapInArrow(_passages(seed_map, word_map, min_similarity), "doc_id long, item long, passage binary")
    pairs = passages.join(parts.select("item", "item_id", "words"), "item").mapInArrow(_aligned, f"doc_id long, item_id {kind}, score long, similarity double")
    good = pairs.filter(F.col("similarity") >= min_similarity)
    return good.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("similarity").alias("similarity"))
