"""Words, n-grams and units of Arrow columns against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlsieve.llm.units import units_of
from crawlsieve.llm.words import CHUNK, byte_table, ngrams, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text("ab é\n\t 漢.", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    words = words_of(pa.array(texts, pa.string()), byte_table(lower=False))
    want = [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    assert words.docs.tolist() == [i for i, _ in want]
    assert [len(w.encode()) for _, w in want] == words.lengths.tolist()
    same = {w: h for (_, w), h in zip(want, words.hashes.tolist())}
    assert [same[w] for _, w in want] == words.hashes.tolist() and len(set(same.values())) == len(same)


def test_words_over_chunk_borders():
    texts = ["x" * (CHUNK + 5) + " y", "z" * 10, "", "ab " * (CHUNK // 2), None, "q" * (3 * CHUNK)]
    words = words_of(pa.array(texts))
    assert np.bincount(words.docs, minlength=6).tolist() == [2, 1, 0, CHUNK // 2, 0, 1]
    assert words.lengths.max() == 3 * CHUNK and len(set(words.hashes[words.docs == 3].tolist())) == 1


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_ngrams_stay_within_a_text(texts):
    words = words_of(pa.array(texts, pa.string()), byte_table(lower=False))
    for n, skip in ((1, 0), (2, 0), (3, 0), (2, 1)):
        grams, first = ngrams(words, n, skip)
        span = n + skip
        want = [(i, tuple(w[k:k + span]) if not skip else (w[k], w[k + span - 1])) for i, t in enumerate(texts) for w in [WORD.findall(t or "")] for k in range(len(w) - span + 1)]
        assert words.docs[first].tolist() == [i for i, _ in want]
        assert len({g for _, g in want}) == len(set(grams.tolist()))


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_units_joined_are_the_texts(texts):
    units, n = units_of(pa.array(texts, pa.string()))
    parts, ends = units.to_pylist(), np.cumsum(n)
    assert ["".join(parts[e - k:e]) for k, e in zip(n, ends)] == [t or "" for t in texts]
