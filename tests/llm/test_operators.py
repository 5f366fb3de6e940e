"""The operators against brute force on small data, with the cases their docstrings define."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlsieve.llm import bpe, chosen_path, decontaminate, lm, pii, quality, tokencounts, tokenfile, toxicity, warc
from crawlsieve.llm import words as words_module
from crawlsieve.llm.components import components

SCHEMA = "doc_id long, text string, score double, row long, held_out string, n_tokens string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def table_of(spark, texts, ids=None):
    """Documents with further columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 0.5, 7, "x", "y") for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and long texts, ties, repeated rows and rows without id."""
    long = " ".join(f"w{i % 997}" for i in range(20_000))
    texts = [None, "", " \n", "one", "one", long, long, "a b c d e f g h i j k", "a b c d e f g h i j k", "x" * 50_000]
    return table_of(spark, texts, [0, 1, 2, 3, 3, 5, None, 7, 7, None])


# --- quality rules ---------------------------------------------------------------------------------------------------

def test_quality_counts(spark, odd):
    rows = {r.doc_id: r for r in quality.quality(table_of(spark, ["a b c d e f a b c d e g h i j", "l a\nl a\n\nq\n \n", "x " * 12, None])).collect()}
    assert (rows[0].n_words, rows[0].n_repeat_words, rows[0].base_failed) == (15, 10, True)
    assert (rows[1].n_words, rows[1].n_dup_lines, rows[1].word_chars) == (5, 1, 5)
    assert rows[2].n_repeat_words == 12 and rows[3].n_words == 0 and not rows[3].kept and rows[3].symbol_ratio is None
    assert quality.quality(odd).count() == 10 and quality.quality(odd.limit(0)).count() == 0


def test_quality_is_one_projection(odd):
    plan = quality.quality(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Join|Aggregate", plan)


def test_rules_compile_from_a_table(spark):
    docs = table_of(spark, ["the cat sat on the mat with the other cat of the house"])
    assert quality.quality(docs).first().kept
    strict = quality.quality(docs, (quality.Rule("many", "n_words", 1000), quality.Rule("few", "n_words", None, 3))).first()
    assert not strict.kept and strict.failed_rules == ["many", "few"]
    assert quality.quality(docs, ()).first().kept


# --- language model ----------------------------------------------------------------------------------------------------

def test_lm_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_CHARS", 300)
    monkeypatch.setattr(lm, "FLUSH", 200)
    monkeypatch.setattr(lm, "SAMPLE_CHARS", 2_000)
    texts = [" ".join(f"w{(i * i + k * (i % 7)) % (5 + i % 40)}" for k in range(i % 50)) for i in range(300)] + [None, "", "NEW words Here"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    docs = table_of(spark, texts).drop("held_out").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    model = lm.train(docs.filter("NOT held_out"))
    got = {r.doc_id: r for r in lm.lm_score(docs, model).collect()}
    assert model.layout.bits > 2 and model.layout.hot

    words = [["<s>", *WORD.findall((t or "").translate(LOW)), "</s>"] for t in texts]
    uni, bi = Counter(), Counter()
    for w, h in zip(words, held):
        if not h:
            uni.update(w[1:])
            bi.update(zip(w, w[1:]))
    n, v, types = sum(uni.values()), len(uni), len(bi)
    before = Counter(b for _, b in bi)
    follow, total = defaultdict(lambda: [0, 0, 0]), Counter()
    for (a, _), c in bi.items():
        follow[a][min(c, 3) - 1] += 1
        total[a] += c
    d, e = lm.discounts([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)]), lm.discounts([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])
    left = sum(e[min(c, 3)] for c in before.values()) / types
    low = lambda b: (before[b] - e[min(before[b], 3)] if before[b] else 0) / types + left / (v + 1)
    assert abs(sum(low(w) for w in uni) + left / (v + 1) - 1) < 1e-9
    for i, w in enumerate(words):
        score = 0.0
        for a, b in zip(w, w[1:]):
            p = (max(bi[a, b] - d[min(bi[a, b], 3)], 0) + sum(d[k + 1] * follow[a][k] for k in range(3)) * low(b)) / total[a] if total[a] else low(b)
            score += math.log10(p)
        assert got[i].score == pytest.approx(score, rel=1e-9) and got[i].train_tokens == n and got[i].n_tokens == len(w) - 1
        assert got[i].base_score == pytest.approx(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w[1:]), rel=1e-9)
        assert got[i].n_known == sum(uni[x] > 0 for x in w[1:])


def test_lm_cases(odd):
    docs = odd.withColumn("held_out", F.lit(False))
    empty = lm.train(docs.limit(0))
    rows = lm.lm_score(docs, empty).collect()
    assert len(rows) == 10 and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in rows)
    assert all(math.isfinite(r.score) for r in lm.lm_score(docs, lm.train(docs)).collect())
    assert lm.lm_score(docs.limit(0), empty).count() == 0


# --- similarity join -----------------------------------------------------------------------------------------------------

def brute_groups(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root, links = list(range(len(texts))), [0] * len(texts)
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], links


@pytest.mark.parametrize("small", [3, 512])
def test_similar_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(chosen_path, "SMALL", small)
    monkeypatch.setattr(chosen_path, "BLOCK", small)
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(30))
    base = " ".join(f"q{i}" for i in range(60)).split()
    texts = []
    for i in range(40):  # near copies of one text, each with a word or two changed
        w = list(base)
        for k in rng.integers(0, 60, i % 3):
            w[k] = f"e{i}"
        texts.append(" ".join(w))
    texts += [f"{passage} " + " ".join(f"u{i}x{k}" for k in range(int(rng.integers(5, 60)))) for i in range(60)]
    texts += [texts[0], texts[0].upper(), passage, None, "", "tiny text", "Tiny  text", "tiny texts"]
    roots, links = brute_groups(texts)
    got = {r.doc_id: r for r in chosen_path.similar(table_of(spark, texts)).collect()}
    assert [got[i].class_id for i in range(len(texts))] == roots
    assert [got[i].n_links for i in range(len(texts))] == links
    assert got[100].copy_id == got[101].copy_id == 0


def test_similar_cases(spark, odd):
    rows = chosen_path.similar(odd).collect()
    assert len(rows) == 10
    by = Counter((r.doc_id, r.class_id, r.n_links) for r in rows)
    assert by[3, 3, 1] == 2 and by[7, 7, 1] == 2 and by[5, 5, 1] == 1 and by[None, 5, 1] == 1 and by[0, 0, 0] == 1 and by[None, None, 0] == 1
    assert chosen_path.similar(odd.limit(0)).count() == 0


def test_runs_meet_the_target():
    assert chosen_path.n_runs(0.9) < chosen_path.n_runs(0.99999) == 5


@pytest.mark.parametrize("levels", [0, 1, 2])
@pytest.mark.parametrize("size", [4, 5])
def test_short_texts_meet_also_where_buckets_are_split(size, levels):
    """Sets of 4 or 5 shingles and ones with a shingle more: each of 20 000 pairs has a bucket in common when all buckets are split so many times."""
    n = 20_000
    grams = chosen_path.mix(np.arange(n * (size + 1), dtype=np.uint64)).reshape(n, size + 1)
    grams = np.concatenate([grams[:, :size], grams], 1).ravel()
    sizes = np.tile([size, size + 1], n)
    paths, row = chosen_path._first_paths(grams, sizes, 0.8, chosen_path.n_runs())
    for _ in range(levels):
        paths, row = chosen_path._chosen(paths, row, grams, sizes, 0.8, chosen_path.DEEPER)
    own, other = (np.stack([row[row % 2 == k].astype(np.uint64) // np.uint64(2), paths[row % 2 == k]], 1) for k in (0, 1))
    both = np.concatenate([np.unique(own, axis=0), np.unique(other, axis=0)])
    both, times = np.unique(both, axis=0, return_counts=True)
    assert len(np.unique(both[times == 2, 0])) == n


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[k] == 100 for k in range(100, 160)) and got[201] == got[200] == 200


# --- toxicity ---------------------------------------------------------------------------------------------------------------

def test_toxicity_learns_words_and_pairs(spark, odd):
    rng = np.random.default_rng(1)
    texts, marks = [], []
    for i in range(1500):
        words = [f"w{x}" for x in rng.integers(0, 400, 40)]
        if i % 5 == 0:
            words.insert(int(rng.integers(0, 40)), ("vile", "go away", "vermin")[i % 3])
        texts.append(" ".join(words))
        marks.append(int(i % 5 == 0))
    docs = table_of(spark, texts)
    labels = spark.createDataFrame([*enumerate(marks), (0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in rows if rows[i].held_out} == set(held)
    assert np.mean([rows[i].predicted == marks[i] for i in held]) > 0.97 and len(model.at) < 5000
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.fit(docs, flipped).weights, model.weights)  # labels of held-out rows are never seen
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == 10 and all(0 <= r.score <= 1 for r in scores)
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == 10
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(odd, nothing).collect()} == {0.0} and toxicity.score(odd.limit(0), nothing).count() == 0


def test_ftrl_follows_its_formulas():
    model = toxicity.Ftrl(np.zeros(4), np.zeros(4))
    z, n, w = np.zeros(4), np.zeros(4), np.zeros(4)
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    for step in range(60):
        at, y = np.array([step % 4, (step + 1) % 4]), step % 2
        bias = model.bias()
        for i in at:
            w[i] = 0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)
        p = 1 / (1 + math.exp(-(w[at].sum() + bias)))
        for i in at:
            g = p - y
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a
            z[i] += g - sigma * w[i]
            n[i] += g * g
        model.learn(at, y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


# --- decontamination ----------------------------------------------------------------------------------------------------------

def plain_alignment(a, b):
    best, row = 0, [0] * (len(a) + 1)
    for y in b:
        new = [0] * (len(a) + 1)
        for j, x in enumerate(a, 1):
            new[j] = max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1)
            best = max(best, new[j])
        row = new
    return best


def test_alignment_equals_plain_loops():
    rng = np.random.default_rng(2)
    passages = [rng.integers(0, 6, int(rng.integers(1, 40))).astype(np.uint64) for _ in range(80)]
    items = [rng.integers(0, 6, int(rng.integers(1, 20))).astype(np.uint64) for _ in range(80)]
    assert decontaminate.align(passages, items).tolist() == [plain_alignment(a.tolist(), b.tolist()) for a, b in zip(passages, items)]


def test_contaminated_finds_exact_and_edited_passages(spark, odd):
    item = [f"t{i}" for i in range(30)]
    edited = list(item)
    edited[7] = "other"
    del edited[20]
    edited.insert(12, "added")
    filler = " ".join(f"f{i % 83}" for i in range(400))
    texts = [filler + " " + " ".join(item) + " " + filler, filler + " " + " ".join(edited).upper(), filler, " ".join(item[:8]), " ".join(item), None, ""]
    texts += [f"{filler} " + " ".join(item)] * 50  # a third of the table and more quotes the item
    items = spark.createDataFrame([(1, " ".join(item)), (2, "t1 t2"), (3, None), (4, ""), (5, " ".join(f"z{i}" for i in range(5000)))], "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(table_of(spark, texts), items).collect()}
    assert set(rows) == {(i, 1) for i in (0, 1, 4, *range(7, 57))}
    assert rows[0, 1].similarity == 1 and 0.8 < rows[1, 1].similarity < 1
    whole = table_of(spark, ["x y " + " ".join(f"z{i}" for i in range(5000)) + " q"], [None])
    assert decontaminate.contaminated(whole, items).collect() == [(None, 5, 4000, 1.0)]
    assert decontaminate.contaminated(odd, items).count() == 0
    assert decontaminate.contaminated(odd.limit(0), items).count() == 0 and decontaminate.contaminated(odd, items.limit(0)).count() == 0


def test_contaminated_finds_copies_that_keep_few_trigrams(spark):
    """Also where exact copies and many copies of one edit make what the others keep the frequent part."""
    item = [f"t{i}" for i in range(60)]
    edits = [["other" if i % k == k - 1 else w for i, w in enumerate(item)] for k in (6, 5, 4)]
    edits += [[x for i, w in enumerate(item) for x in ([w, "other"] if i % 2 else [w])], [w for i, w in enumerate(item) if i % 4]]
    edits += [[x for i, w in enumerate(item) for x in ([w, "other"] if i < 36 else [w])]]  # inserted words make its first part twice as long
    filler = " ".join(f"f{i % 83}" for i in range(400))
    texts = [f"{filler} {' '.join(w)} {filler}" for w in [*edits, item, item, *[edits[0]] * 20]] + [filler + " " + " ".join(item[20:40])]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.contaminated(table_of(spark, texts), items).collect()}
    assert set(rows) == set(range(len(texts) - 1))
    assert [rows[i].score for i in range(len(edits))] == [plain_alignment(w, item) for w in edits]


def test_seeds_are_in_every_alignment_over_the_bound():
    rng = np.random.default_rng(8)
    docs, n = np.zeros(400, np.int64), 0
    for _ in range(600):
        item = rng.permutation(1000)[:int(rng.integers(5, 40))].astype(np.uint64)
        text = [y for x in item.tolist() for y in ([[x], [2000, x], [x, 2001], [2002], [], [x]][int(rng.choice(6, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.1]))])]
        score = plain_alignment(text, item.tolist())
        seeds = [decontaminate._triples(x, docs[:len(x)])[0] for x in (np.array(text, np.uint64), item)]
        shared = int(np.isin(*seeds).sum())
        most = int(decontaminate._overlap([np.array(text, np.uint64)], [item])[0]) + shared + 2 if text else 0
        assert score <= most and (shared or score <= len(item) + 2)
        n += score >= len(item)
    assert n > 50


# --- personal data ---------------------------------------------------------------------------------------------------------------

def plain_spans(t):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(4)
    pieces = ["a", "b.", "@", "@", ".", ".c", "1", "2", "25", "+", "+4", " ", "-", "(", ")", "é", "4539578763621486", "x@y.z", "1.2.3.4", "999", "_", "%", "0300"]
    for _ in range(5000):
        text = "".join(rng.choice(pieces, int(rng.integers(0, 25))))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_terms_that_disclose_an_entity_are_found(spark, odd):
    texts = [f"w{i}a é call Zorblat or v{i}b Quimby at zor@x.com now u{i}c w{i}a 1987" for i in range(6)] + [f"the é at or now call text {i}" for i in range(300)]
    texts += ["Zorblat came"] + ["see Copied at one@y.org today"] * 50 + [None, ""]
    docs = table_of(spark, texts)
    terms = pii.disclosing_terms(docs)
    rows = {r.doc_id: r for r in pii.spans(docs, terms).collect()}
    assert rows[0].spans == "email:36:45,generalised:11:18,removed:26:32,removed:58:62" and rows[0].n_email == 1
    assert rows[0].base_sha256 == hashlib.sha256(b"email:36:45").hexdigest()
    assert rows[306].spans == "generalised:0:7"
    assert rows[307].spans == "email:14:23"  # fifty copies of one passage are one surrounding
    assert rows[357].spans == rows[358].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitised(docs, terms).collect()}
    assert clean[0] == "w0a é call [NAME] or v0b  at [EMAIL] now u0c w0a " and clean[10] == texts[10] and clean[357] is None
    none = pii.disclosing_terms(odd.limit(0))
    assert pii.spans(odd, none).count() == 10 and pii.sanitised(odd, none).columns == odd.columns and pii.spans(odd.limit(0), none).count() == 0


def test_spans_of_a_long_text_with_many_matches():
    """Blanks and terms beside matches cost what the text costs; what overlaps a match is left to it."""
    import random
    import time
    rng = random.Random(4)
    for _ in range(200):
        spans = [(k, a, a + rng.randint(1, 9)) for k, a in ((rng.randint(0, 3), rng.randint(0, 50)) for _ in range(rng.randint(0, 6)))]
        text = "".join(rng.choice("abc") for _ in range(60))
        want = list(text)
        for _, a, b in spans:
            want[a:b] = " " * (b - a)
        assert pii._blanked(text, spans) == "".join(want)
        starts, ends = pii._covered(spans)
        for a in range(0, 58):
            free = all(a + 2 <= s or a >= e for _, s, e in spans)
            assert (pii.bisect.bisect_left(starts, a + 2) == pii.bisect.bisect_right(ends, a)) == free

    def seconds(n):
        text = pa.array(["".join(f"a{i}@x.example and more " for i in range(n))])
        start = time.perf_counter()
        spans = pii.base_spans(text[0].as_py())
        pii._blanked(text[0].as_py(), spans)
        return time.perf_counter() - start
    seconds(100)
    assert min(seconds(40_000) for _ in range(3)) <= 8 * min(seconds(10_000) for _ in range(3))


def test_entities_named_several_times_count_once_a_text(spark):
    """A third of the texts name an address twice, 'contact' near it and in half of all texts: 0.63 of the bits, so it is kept."""
    pad = lambda i: " ".join(f"p{i}x{k}" for k in range(10))
    texts = [f"u{i} contact hot@x.com v{i} {pad(i)} w{i} contact hot@x.com x{i}" for i in range(100)]
    texts += [f"contact text {i}" for i in range(50)] + [f"text {i}" for i in range(150)]
    docs = table_of(spark, texts)
    terms = pii.disclosing_terms(docs)
    assert {r.spans.split(":")[0] for r in pii.spans(docs, terms).collect() if r.spans} == {"email"} and terms.size == 0
    assert not any("removed" in r.spans or "generalised" in r.spans for r in pii.spans(docs, terms).collect())


def plain_terms(texts, least=pii.LEAST_CLASSES):
    """Terms that disclose an entity, by plain sets and loops."""
    def words(t):
        low = t.translate(LOW)
        return {w for w in re.findall("[^\\x00-&(-/:-@\\[-`{-\x7f]+", low)}
    seen, by_term = defaultdict(set), defaultdict(set)
    group = {}
    for i, t in enumerate(texts):
        t = t or ""
        spans = pii.base_spans(t)
        own = words(pii._blanked(t, spans))
        for w in words(t):
            by_term[w].add(i)
        if spans:
            hashes = words_module.words_of(pa.array([" ".join(sorted(own))]), words_module.ALNUM).hashes
            scrambled = words_module.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
            group[i] = (int(words_module.mix(np.bitwise_xor.reduce(scrambled, keepdims=True))[0] % np.uint64(pii.CLASSES)) if own else 0, own)
            for k, a, b in spans:
                seen[pii._entity(k, t[a:b])].add(i)
    out = {}
    for entity, mentions in seen.items():
        if len({group[i][0] for i in mentions}) < least:
            continue
        held = -math.log2(len(mentions) / len(texts))
        for term in set().union(*(group[i][1] for i in mentions)):
            both = {i for i in mentions if term in group[i][1]}
            if len({group[i][0] for i in both}) < least or held <= 0:
                continue
            disclosed = math.log2(min(1.0, len(both) / len(by_term[term]))) + held
            if disclosed >= pii.GENERALISE * held - 1e-9:
                out[term] = max(out.get(term, 0), int(disclosed >= pii.REMOVE * held - 1e-9))
    return out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="no table with entities of several texts")
def test_disclosing_terms_of_a_given_table(spark):
    """Texts of a given table in which near copies name the same entities (those of sf* name each in one text): the terms are those of plain loops, and there are some."""
    docs = spark.read.parquet("/root/testdata/check_s/documents.parquet").select("doc_id", "text")
    docs = docs.filter("text RLIKE '@[a-z0-9]+[.]|[0-9] ?[0-9] ?[0-9] ?[0-9]|[0-9][.][0-9]' OR doc_id % 25 = 0")  # a fixture: all that may name an entity, and some others
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    want = plain_terms(texts)
    terms = pii.disclosing_terms(docs)
    names = sorted(want)
    hashes = words_module.words_of(pa.array(names), words_module.ALNUM).hashes
    got = {}
    for at, _, values in terms.rows(hashes):
        got |= zip(np.array(names)[at].tolist(), values.tolist(), strict=True)
    assert len(want) > 0 and got == want and sum(len(x) for x in terms.files()) == len(want)
    assert pii.spans(docs, terms).filter("spans LIKE '%removed%' OR spans LIKE '%generalised%'").count() > 0


def test_disclosing_terms_of_random_texts(spark):
    import random
    rng = random.Random(6)
    words = [f"t{i}" for i in range(40)] + ["É", "Ab's"]
    texts = []
    for _ in range(400):
        own = rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 12))
        for k in range(rng.randint(0, 2)):
            e = rng.randint(0, 6)
            own += [f"a{e}@x.com"] + [f"m{e}"] * (rng.random() < 0.8) + [f"n{e % 3}"] * (rng.random() < 0.5)
        rng.shuffle(own)
        texts.append(" ".join(own))
    texts += [texts[3]] * 40 + [None, "", "a1@x.com", "a1@x.com", "+49 30 123456 A1@X.com m1"]
    want = plain_terms(texts)
    terms = pii.disclosing_terms(table_of(spark, texts))
    names = sorted(want)
    hashes = words_module.words_of(pa.array(names), words_module.ALNUM).hashes
    got = {}
    for at, _, values in terms.rows(hashes):
        got |= zip(np.array(names)[at].tolist(), values.tolist(), strict=True)
    assert len(want) >= 3 and got == want and sum(len(x) for x in terms.files()) == len(want)


# --- byte-level BPE --------------------------------------------------------------------------------------------------------------

def test_bpe_equals_the_library(spark, odd):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = np.random.default_rng(6)
    pieces = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "a", "the", "'s", "'re", "é", "漢", "1", "23", "!", "#$", "<|endoftext|>", "́", "😀", "\r\n", "﻿", "\x00"]
    texts = ["".join(rng.choice(pieces, int(rng.integers(0, 40)))) for _ in range(1500)] + ["a" * 3000, "abc" * 400, " " * 999, None, "", "x" * 257]
    rows = {r.doc_id: r for r in bpe.encoded(table_of(spark, texts), path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        assert np.frombuffer(bytes(rows[i].ids), "<u4").tolist() == want and rows[i].n_tokens == len(want) and rows[i].text == (t or "")
    told = {r.doc_id: r for r in bpe.digests(table_of(spark, texts), path, public_tokenizers.PATTERN).collect()}
    assert all(told[i].ids_sha256 == hashlib.sha256(bytes(rows[i].ids)).hexdigest() and told[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts))
    assert bpe.digests(odd, path, public_tokenizers.PATTERN).count() == 10 and bpe.digests(odd.limit(0), path, public_tokenizers.PATTERN).count() == 0


# --- token files ----------------------------------------------------------------------------------------------------------------

def test_packed_ranks_come_back():
    rng = np.random.default_rng(7)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 2 ** 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = tokenfile.pack(ranks)
        assert len(control) == -(-n // 4) and tokenfile.unpack(control, data, n).tolist() == ranks.tolist()


def test_token_files_hold_what_the_library_gives(spark, odd, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "FILE_IDS", 400)
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 60)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [f"Some words, İ Σ <|endoftext|> é{i} it's {i * 977} x" * (i % 5) for i in range(60)] + [None, ""]
    docs = table_of(spark, texts, [*range(60, 0, -1), 0, None])
    folder, files = tokenfile.write_tokens(docs, path)
    rows = tokenfile.read_tokens(files, folder).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    by_id, start = dict(zip([*range(60, 0, -1), 0, None], texts)), 0
    assert files.count() > 2
    for r in rows:
        want = library.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, np.frombuffer(bytes(r.ids), "<u4").tolist()) == (start, len(want), want)
        start += len(want)
    told = {r.doc_id: r.ids_crc32 for r in tokenfile.read_digests(files, folder).collect()}
    assert all(told[r.doc_id] == zlib.crc32(bytes(r.ids)) for r in rows)
    for case, n in ((odd, 10), (odd.limit(0), 0)):
        folder, files = tokenfile.write_tokens(case, path)
        assert tokenfile.read_digests(files, folder).count() == n


# --- archives ----------------------------------------------------------------------------------------------------------------

def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3_000)
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "PART_LINES", 30)
    same = "<p>é</p>" * 40
    pages = [(i, f"https://www.h{i % 9}.example/p?q={i % 4}", same if i % 3 == 0 else f"<b>{i}</b>" * (i % 30)) for i in range(90)]
    pages += [(None, None, None), (None, "https://h1.example/", same), (200, "not a url", "tiny"), (201, "http://[bad", "tiny"), (5, "https://a.example/\r\nx", "y" * 200), (5, "https://a.example/2", "y" * 200)]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    archive = warc.write_archive(table)
    assert len(archive.names) > 1
    rows = warc.read_records(archive, warc.look_up(archive, table)).collect()
    assert len(rows) == len(pages)
    by = {r.page_id: r for r in rows}
    for i in range(90):
        html = pages[i][2].encode()
        revisit = i % 3 == 0 and i > 0
        assert (by[i].record_type, by[i].payload_bytes, by[i].refers_to) == (("revisit", len(html), 0) if revisit else ("response", len(html), None)) or i == 5
        assert by[i].payload_digest == hashlib.sha256(html).hexdigest() or i == 5
        assert revisit or i == 5 or bytes(by[i].payload) == html
    nameless = {r.payload_bytes: r for r in rows if r.page_id is None}
    assert nameless[0].record_type == "response" and nameless[len(same.encode())].refers_to == 0
    assert by[200].record_type == by[201].record_type == "response"
    assert sorted(r.record_type for r in rows if r.page_id == 5 and r.payload_bytes == 200) == ["response", "revisit"]
    one = warc.look_up(archive, table.filter("page_id = 7").select("url"))
    assert {r.page_id for r in warc.read_records(archive, one).collect()} == {i for i in range(90) if i % 9 == 7 and i % 4 == 3}
    assert warc.look_up(archive, spark.createDataFrame([("https://none.example/",), ("zzz",)], "url string")).count() == 0
    nothing = warc.write_archive(table.limit(0))
    assert warc.read_records(nothing, warc.look_up(nothing, table)).count() == 0


def test_url_keys_sort_by_reversed_host():
    assert warc.url_key("https://www.Example.com:8080/a/b?c=d#e") == "com,example,www:8080)/a/b?c=d" and warc.url_key(None) == "" and warc.url_key("x y") == "x%20y"


# --- token counts ----------------------------------------------------------------------------------------------------------------

CHANGES = "op string, doc_id long, version string, source string, lang string, n_tokens long"


def test_rollup_follows_any_order_of_changes(spark):
    rng = np.random.default_rng(8)
    rollup, state = tokencounts.Rollup(spark), {}
    for turn in range(5):
        rows = {}
        for _ in range(40):
            key = (int(rng.integers(0, 30)), f"v{rng.integers(0, 2)}")
            rows[key] = (str(rng.choice(["insert", "revise", "delete"])), *key, f"s{rng.integers(0, 3)}", str(rng.choice(["en", "de"])), int(rng.integers(0, 100)))
        changes = spark.createDataFrame(list(rows.values()), CHANGES)
        assert rollup.commit(f"b{turn}", changes) and not rollup.commit(f"b{turn}", changes)
        for op, doc, version, *rest in rows.values():
            state.pop((doc, version), None)
            if op != "delete":
                state[doc, version] = rest
        want = defaultdict(lambda: [0, 0])
        for (_, version), (source, lang, n) in state.items():
            want[source, lang, version][0] += 1
            want[source, lang, version][1] += n
        assert {(r.source, r.lang, r.version): [r.docs, r.tokens] for r in rollup.totals().collect()} == dict(want)
    assert rollup.ledger().count() == len(state)


def test_rollup_cases(spark):
    rollup = tokencounts.Rollup(spark)
    assert rollup.totals().count() == 0
    rows = [("insert", 1, "v", None, None, None), ("insert", 1, "v", "s", "en", 5), ("insert", None, "v", "s", "en", 2), ("insert", None, "v", "s", "en", 2), ("delete", None, "v", "s", "en", 2), ("delete", 9, "v", "s", "en", 1), ("revise", 2, "v", None, None, 3)]
    rollup.commit("a", spark.createDataFrame(rows, CHANGES))
    assert {tuple(r) for r in rollup.totals().collect()} == {("s", "en", "v", 3, 9), (None, None, "v", 1, 3)}
    rollup.commit("empty", spark.createDataFrame([], CHANGES))
    rollup.commit("gone", spark.createDataFrame([("delete", 2, "v", None, None, None)], CHANGES))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v", 3, 9)]
    with pytest.raises(ValueError):
        rollup.commit("../x", spark.createDataFrame([], CHANGES))


def test_rollup_takes_counts_of_any_tokenizer(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table_of(spark, ["some text here", "more", None])
    counts = bpe.digests(docs, path, public_tokenizers.PATTERN).selectExpr("'insert' AS op", "doc_id", "'byte_bpe_50k' AS version", "'s' AS source", "'en' AS lang", "n_tokens")
    rollup = tokencounts.Rollup(spark)
    rollup.commit("one", counts)
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "byte_bpe_50k", 3, sum(r.n_tokens for r in counts.collect()))]


def test_a_small_batch_reads_its_part_of_the_ledger(spark):
    rollup = tokencounts.Rollup(spark)
    rollup.commit("all", spark.createDataFrame([("insert", i, "v", "s", "en", 1) for i in range(400)], CHANGES))
    one = rollup.ledger([3])
    assert 0 < one.count() < 100 and one.union(rollup.ledger([b for b in range(tokencounts.BUCKETS) if b != 3])).count() == rollup.ledger().count() == 400
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "bucket#" in plan
    rollup.commit("few", spark.createDataFrame([("delete", 7, "v", None, None, None), ("revise", 8, "v", "s", "en", 5)], CHANGES))
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "v", 399, 403)]


def test_rollup_refuses_unknown_changes(spark):
    rollup = tokencounts.Rollup(spark)
    schema = "op string, doc_id long, version string, source string, lang string, n_tokens long"
    for op in ("upsert", None, ""):
        with pytest.raises(ValueError):
            rollup.commit("a", spark.createDataFrame([("insert", 1, "v", "s", "l", 5), (op, 2, "v", "s", "l", 5)], schema))
    assert rollup.totals().count() == 0 and rollup.commit("a", spark.createDataFrame([("insert", 1, "v", "s", "l", 5)], schema))


def test_archive_is_read_back_in_tasks_by_its_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 4_000)
    monkeypatch.setattr(warc, "TASK_KEYS", 20)
    rng = np.random.default_rng(3)
    pages = spark.createDataFrame([(i, f"https://h{i % 9}.example/{i}", rng.bytes(300).hex()) for i in range(120)], "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    rows = warc.read_records(archive, warc.look_up(archive, pages), with_payload=True).withColumn("task", F.spark_partition_id())
    got = rows.select("page_id", "payload", "task").collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {r.page_id: r.html for r in pages.collect()} and len({r.task for r in got}) > 1
    assert warc.read_records(archive, warc.look_up(archive, pages.limit(0))).count() == 0
