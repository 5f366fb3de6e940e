"""Personal data: patterns for addresses and numbers, and terms that give such an entity away by how they occur with it.

Patterns (leftmost, not overlapping within a kind): e-mail addresses, IPv4 addresses, payment cards (16 to 19 digits, Luhn), phone numbers
with a country code (8 to 15 digits).  Matches that fail their test are dropped.

Terms.  An entity is a match without its spelling (case, spaces, dashes); the terms of a text are its words, matches left out.
With P(e) the share of texts that mention entity e and P(e|t) the share of the texts with term t that do,
t discloses log2(P(e|t) / P(e)) bits of the -log2 P(e) bits that e holds.  Where that is ``GENERALISE`` of them or more, t is replaced by
its class (number, name, term) in every text; from ``REMOVE`` on it is taken out.  How a term occurs cannot be told from copies of one text: texts are put in
``CLASSES`` classes by a hash of their set of words, and an entity, and a pair, counts only if texts of ``LEAST_CLASSES`` classes have it.

First the entities of so many classes are counted, and only these are paired with the terms of their texts, wherever in the text they stand; pairs are
summed slice by slice and task by task before they are shuffled.  Then the candidate terms are counted in all texts, and texts are searched for those that remain
through a mapped file.  Nothing is collected.

Cases: a null or empty text has no match and stays as it is.  A null doc_id is handed on.  Repeated rows count each towards P and are
treated alike.  ``sanitised`` keeps all columns, writes ``text``, and ``n_chars`` where the text changed; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .sharedmap import SharedMap, share
from .words import ALNUM, mix, slices, text_buffer, words_of

CLASSES, LEAST_CLASSES = 64, 3
#: (entity, term) pairs of a text that are worked on at once, about.
PAIRS = 1 << 20
GENERALISE, REMOVE = 0.9, 0.98
KINDS = ("email", "ip", "card", "phone")
#: What the method adds, and what takes a term's place.
TERM_KINDS = ("generalised", "removed")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match ends with its run of digits, so the next begins with one
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # kind, start, end


def _luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches that pass their test, by kind and place; places are code points."""
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = at = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                last = m.end()
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m.group())) <= 15]
    return out


def _suspects(column: pa.Array) -> np.ndarray:
    """Texts that may have a match: an @, or four digits (no other kind has fewer)."""
    data, offsets = text_buffer(column)
    if not len(data):
        return np.zeros(0, np.int64)
    digits = np.append(0, np.cumsum((data >= 48) & (data <= 57), dtype=np.int64))
    signs = np.append(0, np.cumsum(data == 64, dtype=np.int64))
    return np.flatnonzero((digits[offsets[1:]] - digits[offsets[:-1]] >= 4) | (signs[offsets[1:]] > signs[offsets[:-1]]))


def _entity(kind: int, text: str) -> str:
    return f"{kind}:{text.lower() if kind < 2 else _DIGITS.sub('', text)}"


def _covered(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the places that some spans cover together, in order and apart."""
    starts, ends = [], []
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _blanked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for start, end in zip(*_covered(spans), strict=True):
        out += [text[at:start], " " * (end - start)]
        at = end
    return "".join([*out, text[at:]])


def _hash(texts: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for t in texts], np.uint64)


def _read(column: pa.Array) -> Iterator[tuple[np.ndarray, int, str]]:
    """Of each text with matches: the distinct entities, its class, and the text without matches."""
    rows = []
    for i in _suspects(column).tolist():
        text = column[i].as_py()
        spans = base_spans(text)
        if spans:
            rows.append((np.unique(_hash([_entity(k, text[a:b]) for k, a, b in spans])), _blanked(text, spans)))
    words = words_of(pa.array([blank for _, blank in rows], pa.string()), ALNUM)
    order = np.lexsort((words.hashes, words.docs))
    docs, hashes = words.docs[order], words.hashes[order]
    new = np.append(True, (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1]))[:len(docs)]
    docs, hashes = docs[new], hashes[new]
    edges = np.searchsorted(docs, np.arange(len(rows) + 1))
    for (entities, _), lo, hi in zip(rows, edges[:-1], edges[1:], strict=True):
        terms = hashes[lo:hi]
        yield entities, int(mix(np.bitwise_xor.reduce(mix(terms ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True))[0] % np.uint64(CLASSES)) if len(terms) else 0, terms


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, class, n): how many texts of a class mention an entity."""
    for batch in batches:
        for part in slices(batch):
            found = [(entities, np.full(len(entities), c)) for entities, c, _ in _read(part.column("text"))]
            if found:
                entity, c = (np.concatenate(x) for x in zip(*found, strict=True))
                (entity, c), n = _summed(entity, c.astype(np.uint64))
                yield pa.record_batch([pa.array(entity.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n)], ["entity", "class", "n"])


def _summed(*columns: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct rows of some columns, and how often each occurs."""
    order = np.lexsort(columns)
    ordered = [x[order] for x in columns]
    new = np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in ordered]))[:len(order)]
    first = np.flatnonzero(new)
    return tuple(x[first] for x in ordered), np.diff(np.append(first, len(order)))


def _pairs(known: SharedMap):
    """(entity, term, class, n): how many texts of a class have a term and mention an entity, for known entities."""

    def rows(held: list) -> pa.RecordBatch:
        (entity, term, c), n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.record_batch([pa.array(entity.view(np.int64)), pa.array(term.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n)], ["entity", "term", "class", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                held, size = [], 0
                for entities, c, terms in _read(part.column("text")):
                    entities = entities[known.has(entities)]
                    for lo in range(0, len(entities) if len(terms) else 0, max(1, PAIRS // len(terms))) if len(terms) else ():
                        some = entities[lo:lo + max(1, PAIRS // len(terms))]
                        held.append((np.repeat(some, len(terms)), np.tile(terms, len(some)), np.full(len(some) * len(terms), c, np.uint64)))
                        size += len(some) * len(terms)
                        if size >= PAIRS:
                            yield rows(held)
                            size = 0
                if held:
                    yield rows(held)
    return task


def _frequencies(terms: SharedMap):
    """How many texts have each of some terms, summed over a task, some hundred thousand terms at a time."""

    def together(held: list) -> tuple[np.ndarray, np.ndarray]:
        term, n = (np.concatenate(x) for x in zip(*held, strict=True))
        once, place = np.unique(term, return_inverse=True)
        return once, np.bincount(place, n, len(once)).astype(np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << 20, bool)
        for own in terms.files():
            slots[np.asarray(own) & np.uint64((1 << 20) - 1)] = True
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"), ALNUM)
                at = np.flatnonzero(slots[words.hashes & np.uint64((1 << 20) - 1)])
                at = at[terms.has(words.hashes[at])]
                pairs = np.unique(np.stack([words.docs[at].astype(np.uint64), words.hashes[at]], 1), axis=0)
                held.append(np.unique(pairs[:, 1], return_counts=True))
                size += len(held[-1][0])
                if size > PAIRS:
                    held = [together(held)]
                    size = len(held[0][0])
                    if size > PAIRS // 2:
                        yield _term_counts(*held.pop())
                        size = 0
        if held:
            yield _term_counts(*together(held))
    return task


def _term_counts(term: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(term.view(np.int64)), pa.array(n)], ["term", "texts"])


def disclosing_terms(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, least_classes: int = LEAST_CLASSES) -> SharedMap:
    """Hashes of the terms that disclose an entity, with 0 (to generalise) or 1 (to remove)."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    by_class = texts.mapInArrow(_entities, "entity long, class int, n long").groupBy("entity", "class").agg(F.sum("n").alias("n"))
    entities = written(by_class.groupBy("entity").agg(F.count("*").alias("classes"), F.sum("n").alias("mentions")).filter(F.col("classes") >= least_classes), "entities")
    known = share(entities.select(F.col("entity").alias("key")), "entities", entities.count())
    pairs = texts.mapInArrow(_pairs(known), "entity long, term long, class int, n long").groupBy("entity", "term", "class").agg(F.sum("n").alias("n"))
    pairs = written(pairs.groupBy("entity", "term").agg(F.count("*").alias("classes"), F.sum("n").alias("both")).filter(F.col("classes") >= least_classes), "pairs")
    candidates = pairs.select(F.col("term").alias("key")).distinct()
    n = candidates.count()
    if not n:
        return share(candidates, "terms", 0)
    found = share(candidates, "candidates", n)
    total = texts.count()
    frequency = texts.mapInArrow(_frequencies(found), "term long, texts long").groupBy("term").agg(F.sum("texts").alias("texts"))
    bits = pairs.join(frequency, "term").join(entities, "entity").select(
        "term", (F.log2(F.least(F.lit(1.0), F.col("both") / F.col("texts"))) - F.log2(F.col("mentions") / total)).alias("disclosed"),
        (-F.log2(F.col("mentions") / total)).alias("held"))
    bad = bits.filter((F.col("disclosed") >= generalise * F.col("held")) & (F.col("held") > 0))
    bad = written(bad.groupBy(F.col("term").alias("key")).agg(F.max((F.col("disclosed") >= remove * F.col("held")).cast("long")).alias("value")), "terms")
    return share(bad, "terms", bad.count())


def _term_spans(column: pa.Array, terms: SharedMap) -> tuple[np.ndarray, ...]:
    """Text, kind, start and end (code points) of the terms in some texts, in order."""
    if not terms.size:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    words = words_of(column, ALNUM)
    kind = np.full(len(words.hashes), -1)
    for at, _, value in terms.rows(words.hashes):
        kind[at] = value
    at = np.flatnonzero(kind >= 0)
    data, offsets = text_buffer(column)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64))
    before = points[offsets[words.docs[at]]]
    return words.docs[at], kind[at] + len(KINDS), points[words.starts[at]] - before, points[words.starts[at] + words.lengths[at]] - before


def _all_spans(column: pa.Array, terms: SharedMap) -> dict[int, list[Span]]:
    """Spans of the texts that have any; a term inside a match is part of it."""
    out = {i: base_spans(column[i].as_py()) for i in _suspects(column).tolist()}
    covered = {i: _covered(own) for i, own in out.items()}
    for i, kind, start, end in zip(*(x.tolist() for x in _term_spans(column, terms)), strict=True):
        starts, ends = covered.get(i, ([], []))
        if bisect.bisect_left(starts, end) == bisect.bisect_right(ends, start):  # as many begin before its end as end before its start
            out.setdefault(i, []).append((kind, start, end))
    return {i: sorted(s) for i, s in out.items() if s}


def _joined(spans: list[Span]) -> str:
    names = KINDS + TERM_KINDS
    return ",".join(f"{names[k]}:{s}:{e}" for k, s, e in spans)


def spans(docs: DataFrame, terms: SharedMap) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of (doc_id, text)."""
    nothing = hashlib.sha256(b"").hexdigest()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n = part.num_rows
                counts, digest, shown = np.zeros((len(KINDS), n), np.int64), [nothing] * n, [""] * n
                for i, own in _all_spans(part.column("text"), terms).items():
                    base = [s for s in own if s[0] < len(KINDS)]
                    for k, _, _ in base:
                        counts[k, i] += 1
                    digest[i], shown[i] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(own)
                yield pa.record_batch([part.column("doc_id"), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(shown, pa.string())],
                                      ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        task, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def _class_of(term: str) -> str:
    return "[NUMBER]" if any(c.isdigit() for c in term) else "[NAME]" if term[:1].isupper() else "[TERM]"


def redact(text: str, spans: list[Span]) -> str:
    """A text with its spans replaced; of spans that overlap, the first one's mark stands for all."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]" if kind < len(KINDS) else _class_of(text[start:end]) if kind == len(KINDS) else ""]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, terms: SharedMap) -> DataFrame:
    """The rows of ``docs`` with matches replaced by their kind, and disclosing terms generalised or removed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = _all_spans(part.column("text"), terms)
                if own:
                    texts = part.column("text").to_pylist()
                    for i, s in own.items():
                        texts[i] = redact(texts[i], s)
                    part = part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, part.column("text").type))
                    if "n_chars" in part.schema.names and pa.types.is_integer(part.schema.field("n_chars").type):
                        sizes = part.column("n_chars").to_pylist()
                        for i in own:
                            sizes[i] = len(texts[i])
                        part = part.set_column(part.schema.get_field_index("n_chars"), "n_chars", pa.array(sizes, part.schema.field("n_chars").type))
                yield part
    return docs.mapInArrow(task, docs.schema)
