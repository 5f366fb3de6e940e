"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped to score.

Tokens are words (``[^\\x20\\x09-\\x0D]+``, A-Z lowered) and one end per text; a start precedes the first token as a context.

Counting.  Tasks turn texts into arrays of 64-bit word hashes, count the distinct pairs of about 4 million tokens at a
time and hand them on in compact pieces: one per bucket of the first word's hash, holding each first word once.  The number
of buckets follows the text, so a bucket stays small.  A first word that would fill more than half a bucket spreads over
several by the hash of the pair; which words these are is estimated from a sample, which decides where counts are summed and
never what they are.  A bucket's task sums its pieces and writes the pairs in order of their 56-bit hash, each with a
byte that codes its count, and the bucket's words with their counts.  A second shuffle sums, by word, before how many different
words it was seen.

Scoring.  A task looks the distinct words and pairs of a few megabytes of text up by binary search in the mapped files, in
order, so that a page is touched once.  Nothing is broadcast but the discounts and the list of spread words, which has at most
two entries a bucket.

Higher orders: ``lm_score`` scores pairs only.  Distinct triples of this kind of text are nearly as many as its tokens, and
counting them needs more shuffle than four times the compressed input; see the README.

Cases: a null or empty text is the end token alone.  A row without doc_id is not held out and is learned from.  Repeated
rows are counted and scored each.  With no training text N and V are 0, both scores are those of a uniform choice among
V + 1 tokens.  Other columns are not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import found, mapped, new_folder, put_file
from .words import mix, slices, words_of

END, START = np.uint64(0x0E0D), np.uint64(0x57A7)
#: Tokens counted together in a task, characters of text a bucket, characters looked at for frequent words.
FLUSH = 4_000_000
BUCKET_CHARS = 6_000_000
SAMPLE_CHARS = 20_000_000

_PIECE = "bucket int, words binary, uses binary, runs binary, nexts binary, times binary"
_KEY = np.uint64(0xFFFFFFFFFFFFFF00)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts in order: each token's context, each token, and the number of tokens of each text."""
    words = words_of(column)
    sizes = np.bincount(words.docs, minlength=len(column)).astype(np.int64) + 1
    ends = np.cumsum(sizes) - 1
    place = np.arange(len(words.hashes)) + words.docs
    after = np.full(int(sizes.sum()), END, np.uint64)
    after[place] = words.hashes
    before = np.full(len(after), START, np.uint64)
    before[place + 1] = words.hashes
    before[ends - sizes + 1] = START
    return before, after, sizes


def pair_hash(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + after)


@dataclass
class Layout:
    """Where counts are summed: the folder, the number of buckets (2 ** bits), and the words that spread, in order."""

    folder: str
    bits: int
    hot: list[int]
    spread: list[int]

    def bucket(self, words: np.ndarray) -> np.ndarray:
        return (words >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(words), np.int64)

    def pair_bucket(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each pair, and whether its first word spreads."""
        bucket = self.bucket(before)
        hot, at = found(np.array(self.hot, np.uint64), before)
        if hot.any():
            over = np.array(self.spread, np.uint64)[at[hot]]
            step = pair_hash(before[hot], after[hot]) % over
            bucket[hot] = (bucket[hot] + (step << np.uint64(self.bits)).astype(np.int64) // over.astype(np.int64)) % (1 << self.bits)
        return bucket, hot


def _runs(*keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal rows of sorted keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _summed(firsts: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, firsts) if len(firsts) else np.zeros(0, values.dtype)


def _pieces(before: np.ndarray, after: np.ndarray, layout: Layout) -> Iterator[pa.RecordBatch]:
    bucket, hot = layout.pair_bucket(before, after)
    order = np.lexsort((after, before, bucket)) if hot.any() else np.lexsort((after, before))
    bucket, before, after = bucket[order], before[order], after[order]
    del order, hot
    firsts = _runs(bucket, before, after)
    times = np.diff(np.append(firsts, len(after))).astype(np.uint32)
    bucket, before, after = bucket[firsts], before[firsts], after[firsts]
    heads = _runs(bucket, before)
    runs = np.diff(np.append(heads, len(after))).astype(np.uint32)
    tokens, uses = np.unique(after, return_inverse=True)
    uses = np.bincount(uses, weights=times).astype(np.uint32)
    # a piece: the words that are contexts in the bucket, then those that are tokens of it
    token_bucket = layout.bucket(tokens)
    n = 1 << layout.bits
    pair_edges, head_edges = np.searchsorted(bucket, np.arange(n + 1)), np.searchsorted(bucket[heads], np.arange(n + 1))
    token_edges = np.searchsorted(token_bucket, np.arange(n + 1))
    rows: list[list] = [[] for _ in range(6)]
    for b in np.flatnonzero((np.diff(pair_edges) > 0) | (np.diff(token_edges) > 0)).tolist():
        p, h, t = (slice(e[b], e[b + 1]) for e in (pair_edges, head_edges, token_edges))
        words = np.concatenate([before[heads[h]], tokens[t]])
        used = np.concatenate([np.zeros(h.stop - h.start, np.uint32), uses[t]])
        for column, value in zip(rows, (b, words.tobytes(), used.tobytes(), runs[h].tobytes(), after[p].tobytes(), times[p].tobytes()), strict=True):
            column.append(value)
        if len(rows[0]) >= 64:
            yield _piece_batch(rows)
            rows = [[] for _ in range(6)]
    if rows[0]:
        yield _piece_batch(rows)


def _piece_batch(rows: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], ["bucket", "words", "uses", "runs", "nexts", "times"])


def _count(layout: Layout):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                before, after, _ = tokens_of(part.column("text"))
                held.append((before, after))
                size += len(after)
                if size >= FLUSH:
                    yield from _pieces(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), layout)
                    held, size = [], 0
        if size:
            yield from _pieces(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), layout)
    return task


def _column(tables: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in tables.column(name) if x.is_valid]


def _classes(values: np.ndarray) -> list[int]:
    """How many values are 1, 2, 3, 4."""
    return [int((values == k).sum()) for k in (1, 2, 3, 4)]


def _bucket_sums(layout: Layout):
    """Sums a bucket, writes its pairs and words, and hands on by word how many different contexts it has here."""

    def task(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        words, uses, runs = _column(group, "words", np.uint64), _column(group, "uses", np.uint32), _column(group, "runs", np.uint32)
        before = np.concatenate([np.repeat(w[:len(r)], r) for w, r in zip(words, runs, strict=True)])
        after = np.concatenate(_column(group, "nexts", np.uint64))
        times = np.concatenate(_column(group, "times", np.uint32)).astype(np.uint64)
        words, uses = np.concatenate(words), np.concatenate(uses).astype(np.uint64)
        order = np.lexsort((after, before))
        before, after, times = before[order], after[order], times[order]
        firsts = _runs(before, after)
        times = _summed(firsts, times)
        before, after = before[firsts], after[firsts]
        heads = _runs(before)
        ones, twos = _summed(heads, (times == 1).astype(np.uint32)), _summed(heads, (times == 2).astype(np.uint32))
        more = np.diff(np.append(heads, len(before))).astype(np.uint32) - ones - twos
        contexts = before[heads]

        order = np.argsort(words, kind="stable")
        words, uses = words[order], uses[order]
        firsts = _runs(words)
        words, uses = words[firsts], _summed(firsts, uses)
        hot, _ = found(np.array(layout.hot, np.uint64), words)
        keep = (layout.bucket(words) == bucket) & (~hot | (uses > 0))  # a spread context is known in its home bucket, if it is a token
        words, uses = words[keep], uses[keep]
        stats = np.zeros((3, len(words)), np.uint32)
        spread, _ = found(np.array(layout.hot, np.uint64), contexts)
        _, at = found(words, contexts[~spread])
        for row, value in zip(stats, (ones, twos, more), strict=True):
            row[at] = value[~spread]

        keys = pair_hash(before, after) & _KEY
        order = np.argsort(keys)
        coded = keys[order] | np.minimum(times[order], np.uint64(255))
        large = order[times[order] >= 255]
        f = layout.folder
        put_file(f"{f}/pairs-{bucket}", [coded.tobytes()])
        put_file(f"{f}/large-{bucket}", [keys[large].tobytes()])
        put_file(f"{f}/times-{bucket}", [times[large].tobytes()])
        put_file(f"{f}/words-{bucket}", [words.tobytes()])
        put_file(f"{f}/uses-{bucket}", [uses.tobytes()])
        put_file(f"{f}/stats-{bucket}", [stats.tobytes()])

        seen, followed = np.unique(after, return_counts=True)
        home = layout.bucket(seen)
        edges = np.searchsorted(home, np.arange((1 << layout.bits) + 1))
        out = [(b, seen[edges[b]:edges[b + 1]].tobytes(), followed[edges[b]:edges[b + 1]].astype(np.uint32).tobytes(), None) for b in np.flatnonzero(np.diff(edges)).tolist()]
        note = {"pairs": _classes(times), "hot": [[int(w), int(x), int(y), int(z)] for w, x, y, z in zip(contexts[spread], ones[spread], twos[spread], more[spread], strict=True)]}
        out.append((bucket, None, None, json.dumps(note)))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "words": pa.array([x[1] for x in out], pa.binary()), "uses": pa.array([x[2] for x in out], pa.binary()), "note": pa.array([x[3] for x in out], pa.string())})
    return task


def _continuations(layout: Layout):
    def task(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        words = mapped(f"{layout.folder}/words-{bucket}", "u8")
        contexts = np.zeros(len(words), np.uint32)
        for seen, followed in zip(_column(group, "words", np.uint64), _column(group, "uses", np.uint32), strict=True):
            contexts[found(words, seen)[1]] += followed
        put_file(f"{layout.folder}/contexts-{bucket}", [contexts.tobytes()])
        notes = [x for x in group.column("note").to_pylist() if x]
        uses = mapped(f"{layout.folder}/uses-{bucket}", "u8")
        notes.append(json.dumps({"bucket": bucket, "tokens": int(uses.sum()), "distinct": int((uses > 0).sum()), "types": int(contexts.sum(dtype=np.int64)), "single": _classes(contexts)}))
        return pa.table({"note": pa.array(notes, pa.string())})
    return task


def discounts(n: list[int]) -> list[float]:
    """Of counts 0, 1, 2, and 3 or more.  Where a class is empty the discount is half of the count, at most 1."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0
    out = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a and b and y else min(1.0, k / 2)
        out.append(min(max(d, 0.05), k - 0.05))
    return out


@dataclass
class Model:
    """What a worker needs besides the files: sizes, discounts and the followers of spread contexts."""

    layout: Layout
    tokens: int
    distinct: int
    types: int
    texts: int
    pair_discounts: list[float]
    word_discounts: list[float]
    left: float
    hot: list[list[int]]
    filled: set[int]

    def _file(self, name: str, bucket: int, kind: str) -> np.ndarray:
        """A file of a bucket; a bucket that no training word fell into has none."""
        return mapped(f"{self.layout.folder}/{name}-{bucket}", kind) if bucket in self.filled else np.zeros(0, kind)

    def words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, number of contexts and followers (3 classes) of distinct words in order; 0 for unknown ones."""
        uses, contexts, stats = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros((3, len(words)))
        bucket = self.layout.bucket(words)
        firsts = _runs(bucket)
        for lo, hi in zip(firsts, np.append(firsts[1:], len(words))):
            b = int(bucket[lo])
            known = self._file("words", b, "u8")
            hit, at = found(known, words[lo:hi])
            at, here = at[hit], lo + np.flatnonzero(hit)
            uses[here] = self._file("uses", b, "u8")[at]
            contexts[here] = self._file("contexts", b, "u4")[at]
            stats[:, here] = self._file("stats", b, "u4").reshape(3, -1)[:, at]
        if self.hot:
            hot = np.array([x[0] for x in self.hot], np.uint64)
            hit, at = found(hot, words)
            stats[:, hit] = np.array([x[1:] for x in self.hot], float).T[:, at[hit]]
        uses[words == START] = self.texts
        return uses, contexts, stats

    def pairs(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Counts of pairs."""
        bucket, _ = self.layout.pair_bucket(before, after)
        keys = pair_hash(before, after) & _KEY
        order = np.lexsort((keys, bucket))
        bucket, keys = bucket[order], keys[order]
        times = np.zeros(len(keys), np.int64)
        firsts = _runs(bucket)
        for lo, hi in zip(firsts, np.append(firsts[1:], len(keys))):
            b, own = int(bucket[lo]), keys[lo:hi]
            coded = self._file("pairs", b, "u8")
            if not len(coded):
                continue
            at = np.searchsorted(coded, own)
            at[at == len(coded)] = 0
            value = np.asarray(coded[at])
            code = np.where(value & _KEY == own, value & np.uint64(255), np.uint64(0)).astype(np.int64)
            big = np.flatnonzero(code == 255)
            if len(big):
                code[big] = self._file("times", b, "u8")[found(self._file("large", b, "u8"), own[big])[1]]
            times[lo:hi] = code
        out = np.empty_like(times)
        out[order] = times
        return out

    def log10(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token after its context: the model's log10 probability, the base's, and whether it is known."""
        words, place = np.unique(np.concatenate([before, after]), return_inverse=True)
        uses, contexts, stats = self.words(words)
        token_uses = np.where(words == START, 0, uses)
        b, a = place[:len(before)], place[len(before):]
        pair, at = np.unique(b * np.int64(len(words)) + a, return_inverse=True)
        b1, a1 = pair // len(words), pair % len(words)
        times = self.pairs(words[b1], words[a1])
        even = 1 / (self.distinct + 1)
        d = np.array(self.word_discounts)
        lower = np.where(contexts > 0, contexts - d[np.minimum(contexts, 3)], 0) / self.types + self.left * even if self.types else np.full(len(words), even)
        d = np.array(self.pair_discounts)
        total = uses[b1].astype(float)
        share = np.divide(times - d[np.minimum(times, 3)], total, out=np.zeros(len(pair)), where=total > 0)
        rest = np.divide((d[1:, None] * stats)[:, b1].sum(0), total, out=np.ones(len(pair)), where=total > 0)
        model = np.log10(share + rest * lower[a1])
        base = np.log10((token_uses + 1) / (self.tokens + self.distinct + 1))
        return model[at], base[a], token_uses[a] > 0


def train(docs: DataFrame) -> Model:
    """A model of all texts of the table (column ``text``)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"))
    n_texts, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = max(0, math.ceil(math.log2(max(1, chars / BUCKET_CHARS))))
    layout = Layout(new_folder(spark, "lm"), bits, [], [])
    layout.hot, layout.spread = _frequent(texts.sample(min(1.0, SAMPLE_CHARS / max(chars, 1)), 17) if chars > SAMPLE_CHARS else texts, bits)
    pieces = texts.mapInArrow(_count(layout), _PIECE)
    sums = pieces.groupBy("bucket").applyInArrow(_bucket_sums(layout), "bucket int, words binary, uses binary, note string")
    notes = [json.loads(r.note) for r in sums.groupBy("bucket").applyInArrow(_continuations(layout), "note string").collect()]
    add = lambda key, n: [sum(x[key][k] for x in notes if key in x) for k in range(n)]
    total = lambda key: sum(x[key] for x in notes if key in x)
    hot: dict[int, list[int]] = {}
    for x in notes:
        for w, *s in x.get("hot", []):
            hot[w] = [p + q for p, q in zip(hot.get(w, [0, 0, 0]), s, strict=True)]
    single, types = add("single", 4), total("types")
    word_discounts = discounts(single)
    classes = [single[0], single[1], sum(x.get("distinct", 0) for x in notes) - single[0] - single[1]]
    left = sum(d * n for d, n in zip(word_discounts[1:], classes, strict=True)) / types if types else 1.0
    return Model(layout, total("tokens"), total("distinct"), types, n_texts, discounts(add("pairs", 4)), word_discounts, left, [[w, *hot[w]] for w in sorted(hot)], {x["bucket"] for x in notes if "bucket" in x})


def _frequent(texts: DataFrame, bits: int) -> tuple[list[int], list[int]]:
    """Contexts that hold over half a bucket's share of a sample, and over how many buckets each is to spread."""
    if not bits:
        return [], []

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, times = np.unique(tokens_of(part.column("text"))[0], return_counts=True)
                most = times > times.sum() / (8 << bits)  # a word over the share everywhere is over half of it somewhere
                yield pa.record_batch([pa.array(words[most].view(np.int64)), pa.array(times[most])], ["word", "times"])
                yield pa.record_batch([pa.array([None], pa.int64()), pa.array([int(times.sum())], pa.int64())], ["word", "times"])
    sums = texts.mapInArrow(task, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))
    total = sums.filter("word IS NULL").first()
    if not total or not total.times:
        return [], []
    rows = sums.filter(F.col("word").isNotNull() & (F.col("times") > total.times / (2 << bits))).collect()
    found_ = sorted((r.word & 0xFFFFFFFFFFFFFFFF, min(1 << bits, math.ceil(r.times / total.times * (2 << bits)))) for r in rows)
    return [w for w, _ in found_], [n for _, n in found_]


def lm_score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of (doc_id, held_out, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                before, after, sizes = tokens_of(part.column("text"))
                score, base, known = model.log10(before, after)
                firsts = np.cumsum(sizes) - sizes
                score, base = np.add.reduceat(score, firsts), np.add.reduceat(base, firsts)
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(sizes), pa.array(np.add.reduceat(known.astype(np.int64), firsts)),
                                       pa.array(np.full(len(sizes), model.tokens, np.int64)), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(-score / sizes, 300))],
                                      ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text")).mapInArrow(
        task, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


