"""Links of the chosen-path join against every pair, on a given table and where a line is common to most texts."""

import random
import re

import numpy as np
import pytest

from crawlsieve.llm import chosen_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = [w.translate(LOW) for w in WORD.findall(text or "")]
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def links(texts):
    """Links of each text, by the texts that share a shingle with it."""
    sets = [shingles(t) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    out = [0] * len(texts)
    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in holders[g]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                out[i] += 1
                out[j] += 1
    return out


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    return {r.doc_id: r.n_links for r in chosen_path.similar(docs).collect()}


def test_every_link_of_a_given_table(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    want = links(texts)
    got = found(spark, texts)
    assert sum(want) > 150 and [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("length", [7, 30, 120])
def test_every_link_below_a_common_line(spark, monkeypatch, length):
    """Small buckets hold 40 sets here, so the line's are split; texts of few and of many further words, some of them near copies."""
    monkeypatch.setattr(chosen_path, "SMALL", 40)
    monkeypatch.setattr(chosen_path, "BLOCK", 40)
    rng = random.Random(length)
    line = "all rights reserved by the owner of this page and may not be copied"
    texts = []
    for i in range(250):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(length)]
        texts.append(" ".join(words) + "\n" + line)
        if i % 5 == 0:
            words[0] = "changed"
            texts.append(" ".join(words) + "\n" + line)
    want = links(texts)
    got = found(spark, texts)
    assert sum(want) >= 50 and [got[i] for i in range(len(texts))] == want


def test_sets_with_enough_other_paths_stay():
    rng = np.random.default_rng(1)
    runs = chosen_path.n_runs()
    for share, expected in ((0.0, False), (0.1, False), (0.3, False), (0.6, True), (0.8, True), (1.0, True)):
        row = np.repeat(np.arange(400), 5 * runs)
        needs = chosen_path._needs_deeper(row, rng.random(len(row)) < share, 400, 0.8, 0.99999)
        assert (needs.mean() > 0.9) if expected else (needs.mean() < 0.25)
