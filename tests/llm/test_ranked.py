"""Ranked search against scoring every document, with the cases its docstring defines."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from crawlsieve.llm import ranked

SCHEMA = "doc_id long, text string, item long, term string, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in zip(ids, texts)], SCHEMA)


def items(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "q") for i, t in zip(ids, texts)], "item_id int, text string, weight string")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, asked, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    rows = []
    for item, text in asked:
        scored = []
        for i, c in counted:
            size = sum(c.values())
            m = 100 - 25 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        rows += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return rows


def found(spark, docs, asked, k):
    rows = ranked.search(ranked.build_index(docs), asked, k).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows), key=str)


def same(spark, docs, ids, asked, item_ids, k=5):
    got = found(spark, documents(spark, docs, ids), items(spark, asked, item_ids), k)
    assert got == sorted(brute(zip(ids, docs), zip(item_ids, asked), k), key=str)
    return got


@pytest.mark.parametrize("shard_words,block,ahead", [(2_000_000, 512, 4), (300, 3, 1), (50, 512, 100)])
def test_search_equals_scoring_all(spark, monkeypatch, shard_words, block, ahead):
    monkeypatch.setattr(ranked, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(ranked, "ITEMS", block)
    monkeypatch.setattr(ranked, "AHEAD", ahead)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["É", "ÉÉ", "x'y", "a_b", "9", "Ω"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [rng.choice([" ", ", ", "\x00", "\n"]).join(rng.choices(words, weights, k=rng.randint(1, 40))) for _ in range(300)]
    docs += [docs[0]] * 40 + [None, "", "...", "W0 w0 W1"]
    ids = [*range(len(docs) - 2, 0, -1), None, 0]
    asked = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(25)] + [docs[0], None, "", "unknown", "w0 w0 w0 unknown", docs[0]]
    same(spark, docs, ids, asked, [*range(len(asked) - 1), 3])


def test_odd_tables(spark):
    long = " ".join(f"w{i % 997}" for i in range(30_000)) + " " + "z" * 60_000
    docs = [None, "", "one", "one", "one two", long, long, "two", "-3"]
    same(spark, docs, [4, None, 3, 3, -7, None, 1, None, -2], ["one two", "z" * 60_000 + " w5", "3 3"], [None, 8, 8], k=3)
    assert found(spark, documents(spark, docs).limit(0), items(spark, ["one"]), 3) == []
    assert found(spark, documents(spark, docs), items(spark, ["one"]).limit(0), 3) == []
    assert found(spark, documents(spark, [None, ""]), items(spark, ["one", None]), 3) == []
    # a term of every document weighs nothing once there are many of them
    same(spark, ["a"] * 2000 + ["a b"], range(2001), ["a", "b a"], [0, 1], k=7)


def test_range_maxima_are_those_of_the_lists():
    rng = np.random.default_rng(1)
    n_docs, n_terms = 200, 12
    held = rng.random((n_terms, n_docs)) < rng.random((n_terms, 1))
    held[:, 0] = True
    term, doc = np.nonzero(held)
    times = rng.integers(1, 6, len(doc))
    shard = {"doc_ids": np.arange(n_docs), "sizes": rng.integers(1, 90, n_docs), "terms": np.arange(n_terms, dtype=np.uint64) * np.uint64(3),
             "ends": np.cumsum(held.sum(1)), "docs": doc, "times": times}
    wanted = np.array([0, 1, 3, 9, 30, 33, 34], np.uint64)
    lists = ranked.Lists(shard, wanted, 1000, 40_000)
    assert wanted[lists.terms].tolist() == [0, 3, 9, 30, 33]
    for _ in range(400):
        which = int(rng.integers(0, 5))
        a, b = sorted(rng.integers(0, n_docs + 1, 2).tolist())
        lo, hi = (lists.places(np.array([which]), np.array([x])) for x in (a, b))
        t = int(wanted[lists.terms[which]]) // 3
        own = [d for d in range(a, b) if held[t, d]]
        assert (lists.doc[lo[0]:hi[0]] == own).all() and len(own) == hi[0] - lo[0]
        if own:
            impact, place = lists.heaviest(lo, hi)
            assert impact[0] == lists.impact[lo[0]:hi[0]].max() == lists.impact[place[0]]


def test_bounds_leave_most_intervals_closed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    rng = random.Random(9)
    asked = [" ".join(t.split()[:12]) for t in rng.sample([t for t in texts if len(t.split()) > 12], 20)]
    got = same(spark, texts, range(len(texts)), asked, range(20), k=5)
    assert len(got) == 100
