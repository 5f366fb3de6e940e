"""Rare seeds of the decontamination against aligning every text with every item."""

import random

import numpy as np

from crawlsieve.llm import decontaminate
from crawlsieve.llm.common import written
from test_operators import plain_alignment

DOCS, ITEMS = "doc_id long, text string, item long, passage string", "item_id long, text string, words string, length string"


def tables(spark, texts, items):
    return (spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], DOCS), spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(items)], ITEMS))


def edited(words, share, rng):
    """A copy with about this share of its words left out, replaced or followed by another."""
    out = []
    for w in words:
        if rng.random() >= share:
            out.append(w)
        else:
            out += rng.choice([[], [f"e{rng.randint(0, 30)}"], [w, f"e{rng.randint(0, 30)}"]])
    return out


def test_all_pairs_of_random_items_and_edited_copies(spark):
    rng = random.Random(11)
    common = [["one", "of", "the"], ["at", "the", "end", "of", "the"], ["in", "order", "to"]]
    items = []
    for _ in range(40):
        words = [f"v{rng.randint(0, 60)}" for _ in range(rng.randint(6, 40))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(common)
        items.append(words)
    texts = []
    for _ in range(160):
        words = []
        for _ in range(rng.randint(0, 3)):
            words += rng.choice([edited(rng.choice(items), rng.choice([0, 0.1, 0.25, 0.4]), rng), rng.choice(common), [f"v{rng.randint(0, 60)}" for _ in range(20)]])
        texts.append(words)
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(*tables(spark, [" ".join(t) for t in texts], [" ".join(i) for i in items])).collect()}
    want = {(d, i): plain_alignment(t, item) for d, t in enumerate(texts) for i, item in enumerate(items)}
    exact = {pair: s for pair, s in want.items() if s >= 2 * decontaminate.EXACT_FROM * len(items[pair[1]])}
    over = {pair: s for pair, s in want.items() if s >= 2 * decontaminate.MIN_SIMILARITY * len(items[pair[1]])}
    assert len(exact) > 40 and exact.items() <= found.items() <= over.items()
    assert len(found) >= 0.95 * len(over)


def test_a_phrase_of_all_items_and_texts_is_no_seed(spark):
    """A thousand items share a phrase that every text repeats: it brings no item to any text, and copies are found all the same."""
    phrase = "one of the most"
    items = [phrase + " " + " ".join(f"w{i}x{k}" for k in range(30)) for i in range(1000)]
    texts = [" ".join([phrase] * 50) + f" text {d}" for d in range(100)] + [f"so {items[7]} it ends", items[990].replace("w990x5", "other"), phrase]
    docs, asked = tables(spark, texts, items)
    rows = docs.select("doc_id", "text")
    parts = asked.select("item_id", "text").mapInArrow(decontaminate._item_parts, "item_id long, words binary, grams array<long>, places array<long>, length long").withColumn("item", decontaminate.F.col("item_id"))
    triples = written(parts.selectExpr("item", "length", "explode(arrays_zip(grams, places)) AS g").selectExpr("item", "length", "g.grams AS key", "g.places AS place").distinct(), "triples")
    common = triples.groupBy("key").count().filter("count = 1000").select("key")
    assert common.count() > 0 and decontaminate.rare_seeds(rows, triples).join(common, "key").filter("shiftright(value, 32) NOT IN (7, 990)").count() == 0
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, asked).collect()}
    assert got == {(100, 7), (101, 990)}


def test_as_many_triples_are_left_out_as_the_bound_allows():
    assert decontaminate._left_out(np.array([5, 10, 15, 16, 20, 30, 60])).tolist() == [0, 0, 0, 1, 1, 3, 9]
