"""Spelling variants: words one code point apart, found with a bit-sliced position index over the vocabulary.

Counting.  A task cuts its texts into words as byte ranges, works out the crc32 that may take a letter from each for all words of a slice at once, and adds equal
words up before they are shuffled.

Buckets.  Two words of lengths t and t or t + 1 that differ by one inserted, deleted or replaced code point share their first t // 2 code points, or
the last t - t // 2.  So a word enters four buckets: by either half, for t its length and its length less one.  A bucket takes one
more word only if half of that word is already in it, so buckets stay small however many words there are; one that does not is cut into blocks, which
meet two at a time.

Index.  Some buckets at a time, a bitset for each (position, letter) tells which words have the letter there.  All words of the
slice are looked up together: per letter of a word, the set of words that agree so far (zero errors) and the three sets with one error move on, by ``and`` with the
bitset of the same position (replaced), of the one before (the looked-up word has a letter more) or after (a letter less).  A pair that shares its first
half counts in that bucket only: elsewhere the zero-error set after the half is taken out.  Bits are in the order of (n descending, word), so the lowest
bit left is the best near word and the number of bits the number of near words; no pair is ever listed.

Roots.  Forms are followed by pointer jumping: the number of rounds grows with the logarithm of the longest chain, and a chain at least doubles n at each step.

Cases: a null or empty text has no words; in a row without doc_id no letter is left out.  Repeated rows count each.  An empty table gives no
rows.  Words of any length are compared whole.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_groups, written
from .words import slices, text_buffer

#: A word is a run of ``[A-Za-z\u00C0-\u00FF]``.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run of a document in so many loses a letter, chosen by crc32.
DAMAGED = 97
#: Words of a block of a large bucket (fewer where words are long), and of a slice that is looked up at once, about.
BLOCK, SLICE = 2048, 512
#: Letters of a block or slice, so that long words make it smaller.
CELLS = 1 << 20
#: Different words that a task holds before it hands them on, about.
HELD = 600_000
#: Bytes of a word whose crc32 is worked out together with others.
LONG = 48


def _crc_table() -> np.ndarray:
    """What a byte does to a crc32, by the byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_CRC = _crc_table()
_LETTER = np.zeros(256, bool)
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
#: U+00C0 to U+00FF are this byte and one more in UTF-8, and nothing else begins with it.
_LEAD = 0xC3
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def _crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """crc32 of a head (given as its crc32) followed by some bytes, for many at a time, letter by letter; long ones singly."""
    out = np.empty(len(starts), np.uint32)
    long = sizes > LONG
    for i in np.flatnonzero(long).tolist():
        out[i] = zlib.crc32(data[starts[i]:starts[i] + sizes[i]], int(heads[i]))
    some = np.flatnonzero(~long)
    order = some[np.argsort(-sizes[some], kind="stable")]
    state, at = heads[order] ^ np.uint32(0xFFFFFFFF), starts[order]
    left = np.searchsorted(-sizes[order], -np.arange(LONG), side="left")  # how many are longer than k
    for k, n in enumerate(left.tolist()):
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _runs(column: pa.Array, ids: list[int | None], damaged: int | None) -> pa.Array:
    """The words of some texts, one after another, letters lowered and left out as the rule says."""
    data, offsets = text_buffer(column)
    inside = _LETTER[data] | (data == _LEAD)
    inside[1:] |= data[:-1] == _LEAD
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    begins[heads] = inside[heads]
    gaps = ~inside
    gaps[heads] = True
    starts = np.flatnonzero(begins)
    places = np.append(np.flatnonzero(gaps), len(data))
    sizes = places[np.searchsorted(places, starts, side="right")] - starts
    wide = np.append(0, np.cumsum(data == _LEAD))
    points = sizes - (wide[starts + sizes] - wide[starts])
    some = points >= LEAST_LENGTH
    starts, sizes, points = starts[some], sizes[some], points[some]
    low = _LOWERED[data]
    edges = np.append(0, np.cumsum(sizes))
    flat = low[np.repeat(starts - edges[:-1], sizes) + np.arange(int(edges[-1]))]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(flat))
    if not damaged or not len(starts):
        return words
    doc = np.searchsorted(offsets, starts, side="right") - 1
    known = np.array([i is not None for i in ids], bool)
    head = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    crc = _crcs(low, starts, sizes, head[doc])
    hit = np.flatnonzero((crc % np.uint32(damaged) == 0) & known[doc])
    shorter = []
    for word, h in zip(words.take(pa.array(hit)).to_pylist(), crc[hit].tolist(), strict=True):
        at = h % len(word)
        shorter.append(word[:at] + word[at + 1:])
    shorter = [w for w in shorter if len(w) >= LEAST_LENGTH]
    rest = np.ones(len(starts), bool)
    rest[hit] = False
    return pa.concat_arrays([words.filter(pa.array(rest)), pa.array(shorter, pa.large_string())])


def _counted(damaged: int | None):
    """word, n: the words of a task's texts, counted some megabytes at a time and then put together."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def together() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()

        for batch in batches:
            for part in slices(batch):
                counts = _runs(part.column("text"), part.column("doc_id").to_pylist(), damaged).value_counts()
                held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
                if sum(t.num_rows for t in held) > HELD:
                    held[:] = [together()]
                    if held[0].num_rows > HELD // 2:
                        yield from _as_rows(held.pop())
        if held:
            yield from _as_rows(together())
    return task


def _as_rows(counts: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from counts.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=20_000)


def vocabulary(docs: DataFrame, damaged: int | None = DAMAGED) -> DataFrame:
    """word, n: runs of letters of at least ``LEAST_LENGTH`` code points that occur at least ``LEAST_COUNT`` times."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(_counted(damaged), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of truth values as rows of 64-bit words, lowest bit first."""
    n = flags.shape[1]
    packed = np.packbits(np.pad(flags, ((0, 0), (0, -n % 64))), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


def near_sets(letters: np.ndarray, t: int, allowed: np.ndarray, first_half: bool) -> np.ndarray:
    """Bitsets (a row a word, a bit a word) of the words one code point away.

    ``letters`` has a row of t + 1 codes a word, all of length t or t + 1 (the last code of the shorter ones is 0).  Words of length t + 1 are not
    compared with one another.  ``allowed`` are the bits that may count.
    """
    alphabet, codes = np.unique(letters, return_inverse=True)
    codes = codes.reshape(letters.shape)
    index = [_bits(codes[:, p] == np.arange(len(alphabet))[:, None]) for p in range(t + 1)]
    long = letters[:, t] > 0
    half, agree = t // 2, allowed
    replaced, more, less = np.zeros_like(allowed), np.zeros_like(allowed), allowed.copy()
    halved = allowed
    for i in range(t):
        same = index[i][codes[:, i]]
        replaced = (replaced & same) | (agree & ~same)
        more = (more & index[i - 1][codes[:, i]]) | agree if i else agree.copy()
        agree = agree & same
        less = (less & index[i + 1][codes[:, i]]) | agree
        if i + 1 == half:
            halved = agree
    more = (more & index[t - 1][codes[:, t]]) | agree
    is_long = _bits(long[None, :])
    near = np.where(long[:, None], more & ~is_long, (replaced & ~is_long) | (less & is_long))
    return near & (halved if first_half else ~halved)


def _slices(table: pa.Table, change: np.ndarray) -> Iterator[pa.Table]:
    """Whole groups, some at a time, of one t and side of the half."""
    starts = np.append(np.flatnonzero(change), len(change))
    t, side = table.column("t").to_numpy(), table.column("side").to_numpy(zero_copy_only=False)
    lo = 0
    for k in range(1, len(starts)):
        at, end = starts[lo], starts[k]
        if k + 1 == len(starts) or starts[k + 1] - at > min(SLICE, CELLS // (t[at] + 1)) or t[end] != t[at] or side[end] != side[at]:
            yield table.slice(at, end - at)
            lo = k


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n_near, form, form_n: near words of each word within its group."""
    names = ("side", "t", "key", "cell")
    for whole in whole_groups(batches, names, 20_000):
        change = np.ones(whole.num_rows, bool)
        change[1:] = np.logical_or.reduce([(x := whole.column(name).to_numpy(zero_copy_only=False))[1:] != x[:-1] for name in names])
        number = pa.array(np.cumsum(change))
        for table in _slices(whole.append_column("group", number), change):
            words, t = table.column("word").to_pylist(), table.column("t")[0].as_py()
            letters = np.array(words, f"U{t + 1}").view(np.uint32).reshape(len(words), t + 1)
            group = table.column("group").to_numpy()
            role, crossing = table.column("role").to_numpy(), table.column("crossing").to_numpy(zero_copy_only=False)
            # a bitset for each (group, role), to be read by those that it is compared with
            part, own = np.unique(group * 2 + (role & crossing), return_inverse=True)
            facing = np.searchsorted(part, np.where(crossing, group * 2 + (1 - role), part[own]))
            bits = np.vstack([_bits(own == np.arange(len(part))[:, None]), np.zeros((1, -(-len(words) // 64)), np.uint64)])
            near = near_sets(letters, t, bits[facing], table.column("side")[0].as_py() == 0)
            count = np.bitwise_count(near).sum(1, dtype=np.int64)
            some = np.flatnonzero(count)
            column = np.argmax(near[some] != 0, axis=1)
            value = near[some, column]
            best = column * 64 + np.bitwise_count((value & (~value + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            word = table.column("word").combine_chunks()
            yield pa.record_batch([word.take(pa.array(some)), pa.array(count[some]), word.take(pa.array(best)), table.column("n").combine_chunks().take(pa.array(best))], ["word", "n_near", "form", "form_n"])


def near_words(words: DataFrame, least: int = 1) -> DataFrame:
    """word, n_near, form, form_n for the words of (word, n) that have a near one; ``form`` is the one of largest n, ties the smallest.

    No word is shorter than ``least``.
    """
    entries = words.selectExpr("word", "n", f"explode(filter(array(length(word), length(word) - 1), t -> t >= {least})) AS t").selectExpr(
        "word", "n", "t", f"explode(array(struct(0 AS side, left(word, t div 2) AS half), struct(1 AS side, right(word, CAST(t - t div 2 AS INT)) AS half))) AS e").selectExpr(
        "word", "n", "CAST(t AS INT) AS t", "e.side", "xxhash64(e.half) AS key")
    bucket = ["side", "t", "key"]
    sizes = entries.groupBy(*bucket).agg(F.count("*").alias("size")).filter("size > 1")
    # a block holds fewer words where they are long; every two blocks of a bucket meet in a cell
    cells = (entries.join(sizes, bucket)
             .withColumn("square", F.ceil(F.col("size") / F.expr(f"greatest(16, least({BLOCK}, {CELLS} div t))")).cast("int"))
             .withColumn("block", F.pmod(F.xxhash64("word", F.lit(7)), F.col("square")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("square") - 1)))
             .selectExpr(*bucket, "CAST(least(block, other) AS LONG) * square + greatest(block, other) AS cell", "CAST(block > other AS INT) AS role",
                         "block <> other AS crossing", "word", "n"))
    near = cells.repartition(*bucket, "cell").sortWithinPartitions(*bucket, "cell", F.desc("n"), "word").mapInArrow(_near, "word string, n_near long, form string, form_n long")
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best"))
    return best.selectExpr("word", "n_near", "best.form AS form", "-best.n AS form_n")


def roots(links: DataFrame, rounds: int = 64) -> DataFrame:
    """word, root for the rows of (word, form), one a word and without circles: forms followed to the last."""
    now = written(links.selectExpr("word", "form AS root"), "roots")
    for _ in range(rounds):
        ahead = now.selectExpr("word AS root", "root AS next")
        if not now.join(ahead, "root", "left_semi").limit(1).count():
            return now
        now = written(now.join(ahead, "root", "left").selectExpr("word", "coalesce(next, root) AS root"), "roots")
    raise RuntimeError("forms lead in a circle")


def forms(words: DataFrame, times: int = 2, least: int = LEAST_LENGTH) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of (word, n), one a word; a form has at least ``times`` the word's n."""
    words = written(words.select("word", "n"), "vocabulary")
    is_form = F.col("form_n") >= F.lit(times) * F.col("n")
    own = words.join(near_words(words, least), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    own = written(own, "forms")
    return own.join(roots(own.filter("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
