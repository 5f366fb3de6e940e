"""Text scalars over the ``documents``, ``part`` and ``pages`` tables."""

from __future__ import annotations

from ..functions import text as tx
from ..functions.sql import col
from ..functions.urls import image_src
from .common import d_collapse, d_issue_id, d_limit, table

QUERIES, ORACLES = {}, {}


def scalar(name, source, key, columns, sql):
    def run(spark, sf):
        return table(spark, sf, source).select(key, *[col(expr).alias(alias) for alias, expr in columns.items()])
    QUERIES[name] = run
    ORACLES[name] = sql


scalar("text_scalars", "documents", "doc_id", {
    "collapsed": tx.collapse_ws("text"), "limited": tx.limit_text("text", 120), "short": tx.limit_text("text", 3), "chars": f"CAST({tx.char_count('text')} AS BIGINT)",
    "cleaned": tx.clean("text", 60), "n_words": f"CAST(size({tx.words_of(tx.collapse_ws('text'))}) AS BIGINT)",
}, f"""SELECT doc_id, {d_collapse('text')} AS collapsed, {d_limit('text', 120)} AS limited, left(text, 3) AS short, CAST(length(text) AS BIGINT) AS chars, nullif({d_limit(d_collapse('text'), 60)}, '') AS cleaned,
CAST(CASE WHEN {d_collapse('text')} = '' THEN 0 ELSE len(string_split({d_collapse('text')}, ' ')) END AS BIGINT) AS n_words FROM documents""")

scalar("issue_ids", "documents", "doc_id", {"id": tx.issue_id("source", "lang", "text")}, f"SELECT doc_id, {d_issue_id('source', 'lang', 'text')} AS id FROM documents")

scalar("link_text_norm", "documents", "doc_id", {"norm": tx.norm_link_text("text")},
       r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N} ]', '', 'g')) AS norm FROM documents")

# Text with one entity of each kind around words of the document: real ones, made-up ones and ones without a semicolon.
_DECORATED = "concat('&lt; AT&T &R; ', left(lang, 2), ' &#8226; &#x41; &notanentity; &amp ', doc_id, ' &lt; &COPY;')"
scalar("html_entities", "documents", "doc_id", {"entities": f"array_join({tx.html_entities(_DECORATED)}, ' ')"}, "SELECT doc_id, '&lt; &#8226; &#x41; &COPY;' AS entities FROM documents")

_PATH = "concat('/p/', replace(p_name, ' ', '%20'), CASE p_partkey % 4 WHEN 0 THEN '/%C3%A4+b' WHEN 1 THEN '/%E4' WHEN 2 THEN '/100%' ELSE '' END)"
scalar("safe_decode", "part", "p_partkey", {"decoded": tx.safe_decode(_PATH)}, """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/p/' || p_name || '/ä+b' WHEN 1 THEN '/p/' || replace(p_name, ' ', '') || '/' WHEN 2 THEN '/p/' || replace(p_name, ' ', '') || '/100%'
ELSE '/p/' || p_name END AS decoded FROM part""")

_SRC = "CASE p_partkey % 4 WHEN 0 THEN concat('data:image/png;base64,', repeat('A', p_size)) WHEN 1 THEN concat('/img/', replace(p_name, ' ', '%20'), '.jpg?w=', p_size) WHEN 2 THEN concat(p_name, '.png#x/y') ELSE '' END"
scalar("image_addresses", "part", "p_partkey", {"file_name": tx.file_name(_SRC), "src": image_src(_SRC, "'https://s.example/dir/page'")}, """SELECT p_partkey,
CASE p_partkey % 4 WHEN 1 THEN p_name || '.jpg' WHEN 2 THEN p_name || '.png' ELSE '' END AS file_name,
CASE p_partkey % 4 WHEN 0 THEN CASE WHEN 22 + p_size > 60 THEN left('data:image/png;base64,' || repeat('A', p_size), 57) || '...' ELSE 'data:image/png;base64,' || repeat('A', p_size) END
WHEN 1 THEN 'https://s.example/img/' || replace(p_name, ' ', '%20') || '.jpg?w=' || p_size WHEN 2 THEN 'https://s.example/dir/' || replace(p_name, ' ', '%20') || '.png#x/y' END AS src FROM part""")
