"""Registered queries of the operators, with production parameters over whole tables, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chosen_path, decontaminate, lm, packing, pii, quality, ranked, spelling, tokencounts, tokenfile, toxicity, warc
from .common import is_held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = warc.write_archive(pages)
    records = warc.read_records(archive, warc.look_up(archive, pages), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
h AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> head THEN head END AS refers_to
FROM h"""


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents: two versions inserted, texts with repeated lines revised, short ones deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    rollup = tokencounts.Rollup(spark)
    for version in tokencounts.COUNTERS:
        rollup.commit(version, docs.select(F.lit("insert").alias("op"), "doc_id", F.lit(version).alias("version"), "source", "lang", tokencounts.counted(F.col("text"), version).alias("n_tokens")))
    lines = docs.withColumn("lines", F.split("text", "\n")).filter(F.size("lines") > F.size(F.array_distinct("lines"))).withColumn("text", F.array_join(F.array_distinct("lines"), "\n"))
    counts = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), tokencounts.counted(F.col("text"), v).alias("n_tokens")) for v in tokencounts.COUNTERS]))
    revised = lines.select("doc_id", "source", "lang", counts.alias("c")).select(F.lit("revise").alias("op"), "doc_id", "c.version", "source", "lang", "c.n_tokens")
    rollup.commit("lines-once", revised)
    rollup.commit("lines-once", revised)  # as after a lost answer: changes nothing
    short = rollup.ledger().filter("version = 'words-1' AND n_tokens < 10").select("doc_id")
    rollup.commit("short", rollup.ledger().join(short, "doc_id", "left_semi").withColumn("op", F.lit("delete")))
    return rollup.totals()


_OP4_SQL = r"""
WITH d AS (SELECT source, lang, array_to_string(list_distinct(string_split(coalesce(text, ''), chr(10))), chr(10)) AS t FROM documents),
c AS (SELECT source, lang, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(t, '\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]')) AS pieces FROM d)
SELECT source, lang, 'words-1' AS version, count(*) AS docs, sum(words)::BIGINT AS tokens FROM c WHERE words >= 10 GROUP BY ALL
UNION ALL SELECT source, lang, 'pieces-1', count(*), sum(pieces)::BIGINT FROM c WHERE words >= 10 GROUP BY ALL"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.spans(docs, pii.disclosing_terms(docs))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", is_held_out("doc_id", 7, 2).alias("held_out"))
    model = lm.train(docs.filter(~F.col("held_out")))
    return lm.lm_score(docs, model)


def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.similar(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = tokenfile.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read_digests(files, folder)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(ranked.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=20)


_OP11_SQL = r"""
WITH doc_terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
item_terms AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM item_terms GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (doc_id), totals GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 20"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.forms(spelling.vocabulary(table(spark, sf_dir, "documents")))


_OP12_SQL = r"""
WITH RECURSIVE letters AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM letters WHERE length(run) >= 5 GROUP BY ALL),
bits AS (SELECT i, i AS c, 0 AS step FROM range(256) AS r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
points AS (SELECT *, list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda c: unicode(c)::BIGINT) AS points FROM runs),
crcs AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 | (p >> 6), 128 | (p & 63)] END))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM points, steps),
kept AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM crcs),
v AS (SELECT word, sum(times)::BIGINT AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cut AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut AS a JOIN cut AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cut AS c JOIN v ON c.rest = v.word
  UNION SELECT v.word, c.word, c.n FROM cut AS c JOIN v ON c.rest = v.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS tip, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT chain.word, f.form, step + 1 FROM chain JOIN f ON f.word = chain.tip WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(tip, step) AS root FROM chain GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN ends USING (word)"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


_WORD = r"[^\x20\x09-\x0D]+"
_OP5_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines FROM t),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + 4]) AS times FROM places),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range(5) AS r(k) WHERE times > 1 GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in sorted(set(quality.STOP_WORDS)))}))) AS stops,
    len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS letters, len(lines) AS n_lines,
    len(list_filter(lines, lambda l: regexp_matches(l, '^\s*[-*•]'))) AS bullets, len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)\s*$'))) AS ellipses
  FROM w LEFT JOIN repeats USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words BETWEEN 10 AND 1000000 AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= 0.1 AND stops / n_words >= 0.03
  AND letters / n_words >= 0.7 AND bullets / n_lines <= 0.9 AND ellipses / n_lines <= 0.3 AND n_dup_lines / n_lines <= 0.334 AS kept
FROM b"""

QUERIES = {"op1_toxicity": op1_toxicity, "op2_warc": op2_warc, "op3_byte_bpe": op3_byte_bpe, "op4_token_counts": op4_token_counts, "op5_quality": op5_quality, "op6_pii": op6_pii, "op7_lm": op7_lm, "op8_chosen_path": op8_chosen_path, "op9_token_files": op9_token_files, "op10_decontaminate": op10_decontaminate,
           "op11_ranked_search": op11_ranked_search, "op12_spelling": op12_spelling, "op13_packing": op13_packing}
ORACLES = {"op2_warc": _OP2_SQL, "op4_token_counts": _OP4_SQL, "op5_quality": _OP5_SQL, "op11_ranked_search": _OP11_SQL, "op12_spelling": _OP12_SQL}
