"""Spelling variants against every pair of words, packing against the library's ids, with the cases their docstrings define."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from crawlsieve.llm import packing, spelling

SCHEMA = "doc_id long, text string, n long, word string, form string, sequence_id string"


def table_of(spark, texts, ids=None):
    """Documents with further columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 5, "x", "y", "z") for i, t in zip(ids, texts)], SCHEMA)


def counted(rows):
    low = {i: i + 32 for i in range(65, 91)}
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(words):
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and x != w and one_apart(x, w)] for w in words}
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best is not None and words[best] >= 2 * n else None, n, len(near[w]))
    rows = set()
    for w, (form, n, n_near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, words[form] if form else None))
    return rows


def found(words_frame, **options):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.forms(words_frame, **options).collect()}


@pytest.mark.parametrize("slice_rows,block", [(512, 2048), (3, 2048), (40, 16)])
def test_near_words_are_those_of_all_pairs(spark, monkeypatch, slice_rows, block):
    monkeypatch.setattr(spelling, "SLICE", slice_rows)
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(3)
    words = {}
    for _ in range(500):  # few letters, repeated ones, so that several edits give the same word
        w = "".join(rng.choice("aabé") for _ in range(rng.randint(5, 9)))
        words[w] = rng.choice([3, 3, 6, 7, 50, 400])
    words |= {"a" * 300: 9, "a" * 301: 3, "b" + "a" * 300: 4, "ÿ" * 6: 3, "ÿ" * 5: 6}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(frame) == expected(words)


def test_words_of_one_and_two_letters_and_none(spark):
    words = {"a": 4, "b": 9, "ab": 3, "ba": 3, "abc": 1, "x" * 40: 2}
    assert found(spark.createDataFrame(list(words.items()), "word string, n long"), least=1) == expected(words)
    assert found(spark.createDataFrame([], "word string, n long")) == set()


def test_vocabulary_loses_the_letters_that_the_rule_names(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Maître", "house", "HOUSE,s", "straße×x", "abcde fgh", "tablé-"]) + rng.choice(["", "x", "."]) for _ in range(60)) for _ in range(80)]
    texts += [None, "", "none", texts[0], texts[0], "q" * 30_000 + " " + "q" * 30_000 + " " + "q" * 30_000]
    ids = [*range(80), 80, 81, None, 0, None, 85]
    frame = table_of(spark, texts, ids)
    want = counted(zip(ids, texts))
    assert {r.word: r.n for r in spelling.vocabulary(frame).collect()} == want
    assert found(spelling.vocabulary(frame)) == expected(want)
    assert any(len(w) == 4 for w in [re.sub("x$", "", w) for w in want]) or len(want) > 20
    assert found(spelling.vocabulary(frame.limit(0))) == set()


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = counted((r.doc_id, r.text) for r in docs.collect())
    rows = found(spelling.vocabulary(docs))
    assert {(w, n) for w, _, _, n, _, _ in rows} == set(want.items())
    by_length = {}
    for w in want:
        by_length.setdefault(len(w), []).append(w)
    told = {r[0]: r[4] for r in rows}
    for w in random.Random(1).sample(sorted(want), 300):
        assert told[w] == sum(one_apart(x, w) for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if x != w)


# --- packing -----------------------------------------------------------------------------------------------------------------

def checked(pieces, wanted, window):
    """Every id in exactly one piece, sequences without gaps, no longer than a window; gives the padding and the pieces cut."""
    by_doc, by_sequence = {}, {}
    for r in pieces:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length > 0
        by_doc.setdefault(r.doc_id, []).append((r.start, r.doc_tokens, ids))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(wanted)
    for doc_id, parts in by_doc.items():
        parts.sort(key=lambda x: x[0])
        assert np.concatenate([x[2] for x in parts]).tolist() == wanted[doc_id]
        assert [x[0] for x in parts] == np.cumsum([0, *(len(x[2]) for x in parts[:-1])]).tolist()
        assert {x[1] for x in parts} == {len(wanted[doc_id])}
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(2)
    for window in (1, 2, 7, 64, 100):
        for _ in range(30):
            lengths = rng.integers(1, window + 1, rng.integers(0, 60))
            home, loads = packing.best_fit(lengths, window)
            room = []
            for piece in np.argsort(-lengths, kind="stable").tolist():
                fits = [(r, i) for i, r in enumerate(room) if r >= lengths[piece]]
                if fits:
                    best = min(fits)[0]
                    assert room[home[piece]] == best
                else:
                    assert home[piece] == len(room)
                    room.append(window)
                room[home[piece]] -= int(lengths[piece])
            assert [window - r for r in room] == loads.tolist()


@pytest.mark.parametrize("lengths", [[], [1], [100], [60] * 50, [64, 36] * 20, list(range(1, 100)), [99] * 7 + [3, 3], [51, 50, 49, 2, 2]])
def test_closed_windows_hold_every_id_once(lengths):
    lengths = np.array(lengths, np.int64)
    sequences = packing._group(lengths, np.zeros(len(lengths), np.int64), 100)
    seen = sorted((doc, start, length) for own in sequences for doc, start, length in own)
    at = 0
    for doc, n in enumerate(lengths.tolist()):
        end = 0
        while end < n:
            assert seen[at][:2] == (doc, end) and seen[at][2] > 0
            end += seen[at][2]
            at += 1
        assert end == n
    assert at == len(seen)
    loads = [sum(p[2] for p in own) for own in sequences]
    assert all(x <= 100 and (x == 100 or x & (x - 1) == 0) for x in loads)


@pytest.mark.parametrize("group_ids", [500, 4_000_000])
def test_pieces_hold_what_the_library_gives(spark, group_ids):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [f"Some words, İ <|endoftext|> é{i} it's {i * 977} x" * (i % 7) for i in range(80)] + [None, "", "same", "same", "w1 b2 " * 9_000]
    ids = [*range(80), 80, 81, 82, 83, None]
    frame = table_of(spark, texts, ids)
    wanted = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in zip(ids, texts)}
    pieces = packing.pack(frame, path, window=256, group_ids=group_ids).collect()
    padding = checked(pieces, wanted, 256)
    assert padding <= sum(map(len, wanted.values())) / 100
    assert packing.pack(frame.limit(0), path).count() == 0
    twice = table_of(spark, ["a b c"] * 3, [1, 1, 1])
    assert sum(r.length for r in packing.pack(twice, path, window=64, end_id=None).collect()) == 9
    assert packing.pack(table_of(spark, ["", None]), path, end_id=None).count() == 0


def test_whole_given_table_has_little_padding_and_few_cuts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "length", "doc_tokens", "sequence_id").toPandas()
    loads = pieces.groupby("sequence_id")["length"].sum().to_numpy()
    padding = sum(4096 - x for x in loads.tolist() if x & (x - 1))
    assert padding < 0.005 * loads.sum()
    short = pieces[pieces["doc_tokens"] <= 4096]
    assert short.groupby("doc_id").size().gt(1).mean() < 0.05
