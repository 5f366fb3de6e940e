"""Queries over the crawled pages as they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..functions.sql import col
from ..operators import inputs, links, nodes, report, rollup, site
from ..operators.issues import issue_rows
from ..operators.pages import CHECK_GROUPS, columns_of, page_columns, parsed
from ..operators.rules import RULES, report_rules, rules
from ..operators.skew import materialise
from ..sources.crawl import html_pages
from .common import (D_BODY, D_ENCODED, D_LINKS, D_TITLE, crawl, decorated, d_collapse, d_host, d_issue_id, d_key, d_limit, d_origin, d_unescape, issues_of, rows_of, table)

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("crawl_scan", "SELECT page_id, url AS final_url, 200 AS status, CAST(0 AS BIGINT) AS n_redirects, CAST(octet_length(encode(html)) AS BIGINT) AS body_bytes FROM pages")
def crawl_scan(spark, sf):
    return html_pages(crawl(spark, sf)).selectExpr("seq AS page_id", "final_url", "status", "CAST(size(redirects) AS BIGINT) AS n_redirects", "body_bytes")


@query("url_scalars", f"""
SELECT page_id, regexp_replace(url, '#.*$', '') AS url, {d_key('url')} AS page_key, {d_origin('url')} AS origin, {d_host('url')} AS site_host,
       regexp_replace(url, '#.*$', '') AS without_fragment, CAST(NULL AS VARCHAR) AS reason FROM pages""")
def url_scalars(spark, sf):
    n = urls.normalize_url("url")
    return crawl(spark, sf).select(
        F.col("seq").alias("page_id"), col(f"{n}.url").alias("url"), col(urls.page_key("url")).alias("page_key"), col(urls.origin("url")).alias("origin"),
        col(urls.site_host("url")).alias("site_host"), col(urls.without_fragment("url")).alias("without_fragment"), col(f"{n}.reason").alias("reason"))


# Spellings of each address: as it is, in capitals with a default port and dots, relative to it, and refused ones.
@query("url_spellings", f"""
WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u, {d_origin('url')} AS o, regexp_extract(url, '^https?') AS s, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages)
SELECT page_id, 'dots' AS spelling, o || '/b/c' AS url, CAST(NULL AS VARCHAR) AS reason FROM p
UNION ALL SELECT page_id, 'query', o || '/a/b?q=1', NULL FROM p
UNION ALL SELECT page_id, 'relative', o || '/a/x%20y', NULL FROM p
UNION ALL SELECT page_id, 'protocol', s || '://other.example/z', NULL FROM p
UNION ALL SELECT page_id, 'no-scheme', NULL, 'not a valid URL (missing http:// or https://)' FROM p
UNION ALL SELECT page_id, 'ftp', NULL, 'unsupported protocol ftp: (only http and https)' FROM p
UNION ALL SELECT page_id, 'empty-host', NULL, 'not a valid URL' FROM p""")
def url_spellings(spark, sf):
    host = f"{urls.parts('url')}[1]"
    scheme = f"{urls.parts('url')}[0]"
    base = f"concat({urls.origin('url')}, '/a/b')"
    rows = crawl(spark, sf).select(F.col("seq").alias("page_id"), col(f"""inline(array(
        named_struct('spelling', 'dots', 'value', concat(upper({scheme}), '://', upper({host}), CASE WHEN {scheme} = 'http' THEN ':80' ELSE ':443' END, '/a/../b/./c#top')),
        named_struct('spelling', 'query', 'value', {urls.absolute_url("'?q=1'", base)}),
        named_struct('spelling', 'relative', 'value', {urls.absolute_url("'x y'", base)}),
        named_struct('spelling', 'protocol', 'value', {urls.absolute_url("'//other.example/z'", base)}),
        named_struct('spelling', 'no-scheme', 'value', {host}),
        named_struct('spelling', 'ftp', 'value', concat('ftp://', {host}, '/')),
        named_struct('spelling', 'empty-host', 'value', 'https://')))"""))
    return rows.withColumn("n", col(urls.normalize_url("value"))).selectExpr("page_id", "spelling", "n.url AS url", "n.reason AS reason")


@query("resolved_urls", f"""
WITH e AS (SELECT page_id AS seq, regexp_replace(url, '#.*$', '') AS url, {d_key('url')} AS k, page_id % 7 = 3 AS m FROM pages
           UNION ALL SELECT 1000000 + page_id, regexp_replace(upper(regexp_extract(url, '^https?://[^/?#]+')), '^HTTP', 'http') , {d_origin('url')} || '/', false FROM pages),
f AS (SELECT seq, CASE WHEN seq >= 1000000 THEN k ELSE url END AS url, k, m FROM e)
SELECT k AS page_key, arg_min(url, seq) AS url, min(seq) AS seq, bool_or(m) AS marked FROM f GROUP BY k""")
def resolved_urls(spark, sf):
    pages = table(spark, sf, "pages")
    # Each page as an argument, then its home page in capital letters.
    entries = pages.selectExpr("page_id AS seq", "url AS value", "'argument' AS source", "CAST(NULL AS STRING) AS sitemap", "page_id % 7 = 3 AS lighthouse", "CAST(NULL AS STRING) AS rejected") \
        .unionByName(pages.select(col("1000000 + page_id").alias("seq"), col(f"upper({urls.origin('url')})").alias("value"), F.lit("list:1").alias("source"),
                                  F.lit(None).cast("string").alias("sitemap"), F.lit(False).alias("lighthouse"), F.lit(None).cast("string").alias("rejected")))
    return inputs.resolve_urls(entries).select("page_key", "url", "seq", "marked")


@query("resolved_urls_limited", f"""
WITH f AS (SELECT {d_key('url')} AS k, arg_min(regexp_replace(url, '#.*$', ''), page_id) AS url, min(page_id) AS seq, bool_or(page_id % 7 = 3) AS marked FROM pages GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM f)
SELECT k AS page_key, url, seq, marked FROM r WHERE n <= 40 OR marked""")
def resolved_urls_limited(spark, sf):
    entries = table(spark, sf, "pages").selectExpr("page_id AS seq", "url AS value", "'argument' AS source", "CAST(NULL AS STRING) AS sitemap",
                                                   "page_id % 7 = 3 AS lighthouse", "CAST(NULL AS STRING) AS rejected")
    return inputs.resolve_urls(entries, limit=40).select("page_key", "url", "seq", "marked")


# --- nodes and facts ------------------------------------------------------------------------------------------------

TAGS = ("title", "meta", "style", "script", "nav", "ul", "li", "a", "div", "article", "h1", "p", "b", "br", "footer")


@query("nodes", "WITH t AS (SELECT page_id, unnest([" + ", ".join(f"'{t}'" for t in TAGS) + r"""]) AS tag, html FROM pages)
SELECT page_id, tag, CAST(len(regexp_extract_all(html, '<' || tag || '[ >]')) AS BIGINT) AS n FROM t WHERE len(regexp_extract_all(html, '<' || tag || '[ >]')) > 0""")
def node_counts(spark, sf):
    rows = nodes.extract_nodes(html_pages(crawl(spark, sf))).selectExpr("seq AS page_id", "inline(nodes)")
    return rows.filter(F.col("tag").isin(*TAGS)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("node_containment", """
SELECT page_id, CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<nav>.*</nav>'), '<a ')) AS BIGINT) AS nav_links,
       CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<article>.*</article>'), '<p>')) AS BIGINT) AS article_paragraphs,
       CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<head>.*</head>'), '<(meta|title|style|script)[ >]')) AS BIGINT) AS head_elements FROM pages""")
def node_containment(spark, sf):
    tree = nodes.extract_nodes(html_pages(crawl(spark, sf)))
    inside = lambda area, test: (f"CAST(size(filter(transform(array(get(filter(nodes, a -> a.tag = '{area}'), 0)), a -> filter(nodes, d -> d.pre > a.pre AND d.pre <= a.last "
                                 f"AND {test}))[0], d -> true)) AS BIGINT)")
    return tree.select(F.col("seq").alias("page_id"), col(inside("nav", "d.tag = 'a'")).alias("nav_links"),
                       col(inside("article", "d.tag = 'p'")).alias("article_paragraphs"),
                       col("CAST(size(filter(nodes, n -> n.near.head >= 0 AND n.tag IN ('meta', 'title', 'style', 'script'))) AS BIGINT)").alias("head_elements"))


@query("title", f"SELECT page_id, nullif({D_TITLE}, '') AS title FROM pages")
def title(spark, sf):
    return page_columns(crawl(spark, sf), "title").selectExpr("seq AS page_id", "title")


_H1 = d_collapse(d_unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))


@query("h1s", f"SELECT page_id, {_H1} AS h1 FROM pages WHERE {_H1} <> ''")
def h1s(spark, sf):
    return rows_of(page_columns(crawl(spark, sf), "h1s"), "h1s", "seq AS page_id").selectExpr("page_id", "row AS h1")


_TEXT = d_collapse(d_unescape(f"regexp_replace({D_BODY}, '<[^>]*>', '', 'g')"))


@query("word_count", f"SELECT page_id, CAST(len(string_split({_TEXT}, ' ')) AS BIGINT) AS words FROM pages")
def word_count(spark, sf):
    return page_columns(crawl(spark, sf), "word_count").selectExpr("seq AS page_id", "CAST(word_count AS BIGINT) AS words")


_SPACED = lambda part: d_collapse(d_unescape(f"regexp_replace({part}, '<[^>]*>', ' ', 'g')"))
_ARTICLE = _SPACED("regexp_extract(html, '(?s)<article>(.*)</article>', 1)")


@query("main_text", f"SELECT page_id, 'article' AS area, {d_limit(_ARTICLE, 1500)} AS main_text FROM pages")
def main_text(spark, sf):
    return page_columns(crawl(spark, sf), "main_area", "main_text").selectExpr("seq AS page_id", "main_area AS area", "main_text")


_AFTER_H1 = _SPACED(f"regexp_extract({D_BODY}, '(?s)</h1>(.*)$', 1)")


@query("headings", f"SELECT page_id, CAST(1 AS BIGINT) AS level, {d_limit(_H1, 120)} AS text, {d_limit(_AFTER_H1, 200)} AS excerpt FROM pages")
def headings(spark, sf):
    return rows_of(page_columns(crawl(spark, sf), "heading_outline"), "heading_outline", "seq AS page_id").select("page_id", "row.*").selectExpr(
        "page_id", "CAST(level AS BIGINT) AS level", "text", "excerpt")


@query("page_links", rf"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')) AS tag FROM pages),
h AS (SELECT page_id, url, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, regexp_extract(tag, '>([^<]*)<', 1) AS text FROM l)
SELECT page_id, {d_origin('url')} || {D_ENCODED} AS href, {d_unescape('text')} AS text, true AS internal, false AS nofollow FROM h""")
def page_links(spark, sf):
    return rows_of(page_columns(crawl(spark, sf), "page_links"), "page_links", "seq AS page_id").select("page_id", "row.*")


@query("link_counts", f"SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=\"')) AS BIGINT) AS internal, CAST(0 AS BIGINT) AS external, CAST(0 AS BIGINT) AS nofollow FROM pages")
def link_counts(spark, sf):
    return page_columns(crawl(spark, sf), "link_counts").selectExpr(
        "seq AS page_id", "CAST(link_counts.internal AS BIGINT) AS internal", "CAST(link_counts.external AS BIGINT) AS external", "CAST(link_counts.nofollow AS BIGINT) AS nofollow")


@query("link_samples", "SELECT page_id, CAST(least(len(regexp_extract_all(html, '<a href=\"')), 25) AS BIGINT) AS samples FROM pages")
def link_samples(spark, sf):
    return page_columns(crawl(spark, sf), "link_samples").selectExpr("seq AS page_id", "CAST(size(link_samples) AS BIGINT) AS samples")


_EDGES = f"WITH l AS (SELECT page_id, url, {D_LINKS} AS href FROM pages), e AS (SELECT DISTINCT page_id, url, {d_origin('url')} || {D_ENCODED} AS target FROM l)"


@query("internal_targets", f"{_EDGES} SELECT page_id, target FROM e")
def internal_targets(spark, sf):
    return links.link_edges(page_columns(crawl(spark, sf), "internal_targets")).selectExpr("seq AS page_id", "target")


@query("link_targets", f"{_EDGES} SELECT target, CAST(count(*) AS BIGINT) AS pages FROM e GROUP BY target")
def link_targets(spark, sf):
    return links.link_targets(links.link_edges(page_columns(crawl(spark, sf), "internal_targets"))).select("target", "pages")


@query("targets_to_fetch", f"""{_EDGES}, t AS (SELECT target, count(*) AS pages, min(page_id) AS first_seq FROM e WHERE target NOT IN (SELECT regexp_replace(url, '#.*$', '') FROM pages) GROUP BY target)
SELECT target, CAST(pages AS BIGINT) AS pages FROM t ORDER BY pages DESC, first_seq, target LIMIT 500""")
def targets_to_fetch(spark, sf):
    pages = page_columns(crawl(spark, sf), "internal_targets", "canonical", keep=("seq", "url", "final_url", "status", "redirects", "error"))
    edges = links.link_edges(pages)
    return links.targets_to_fetch(edges, links.known_outcomes(pages), limit=500)[0]


@query("targets_left_out", f"""{_EDGES}, t AS (SELECT DISTINCT target FROM e WHERE target NOT IN (SELECT regexp_replace(url, '#.*$', '') FROM pages))
SELECT CAST(least(count(*), 500) AS BIGINT) AS checked, CAST(greatest(count(*) - 500, 0) AS BIGINT) AS unchecked FROM t""")
def targets_left_out(spark, sf):
    pages = page_columns(crawl(spark, sf), "internal_targets", "canonical", keep=("seq", "url", "final_url", "status", "redirects", "error"))
    return links.targets_to_fetch(links.link_edges(pages), links.known_outcomes(pages), limit=500)[1]


# --- checks that fire on the pages as they are ------------------------------------------------------------------------

FIXED = {
    "missing-main-landmark": ("info", "<body>"), "missing-viewport": ("warning", '<meta name="viewport" content="width=device-width, initial-scale=1">'),
    "missing-open-graph": ("info", "<head>"), "missing-twitter-card": ("info", '<meta name="twitter:card" content="summary_large_image">'),
    "missing-description": ("warning", "<head>"), "missing-canonical": ("warning", "<head>"),
}
_FIXED_SQL = " UNION ALL ".join(
    f"SELECT page_id, url, '{k}' AS type, '{s}' AS severity, '{RULES[k]['category']}' AS category, '{c}' AS context FROM pages" for k, (s, c) in FIXED.items())
_REAL_CHECKS = ("main_landmark", "viewport_and_lang", "social", "description", "canonical")


@query("missing_landmark_viewport_social", f"SELECT page_id, type, severity, category, context FROM ({_FIXED_SQL})")
def fixed_checks(spark, sf):
    return issues_of(crawl(spark, sf), *_REAL_CHECKS, columns="type, severity, category, context")


@query("page_issue_ids", f"SELECT page_id, type, {d_issue_id('url', 'type', 'context')} AS id FROM ({_FIXED_SQL})")
def page_issue_ids(spark, sf):
    return issues_of(crawl(spark, sf), *_REAL_CHECKS, columns="type, id")


# --- roll-ups ---------------------------------------------------------------------------------------------------------

_DUP = f"""d AS (SELECT lower(nullif({D_TITLE}, '')) AS v, page_id, url, nullif({D_TITLE}, '') AS shown, {d_key('url')} AS k FROM pages),
g AS (SELECT v, count(DISTINCT k) AS pages, arg_min(shown, page_id) AS shown FROM d WHERE v IS NOT NULL GROUP BY v HAVING count(DISTINCT k) > 1),
hd AS (SELECT lower({_H1}) AS v, page_id, url, {_H1} AS shown, {d_key('url')} AS k FROM pages WHERE {_H1} <> ''),
hg AS (SELECT v, count(DISTINCT k) AS pages, arg_min(shown, page_id) AS shown FROM hd GROUP BY v HAVING count(DISTINCT k) > 1),
m AS (SELECT 'duplicate-title' AS type, 'seo' AS category, g.v, page_id, url, pages, {d_limit("'<title>' || g.shown || '</title>'", 120)} AS context FROM d JOIN g ON d.v = g.v
      UNION ALL SELECT 'duplicate-h1', 'best-practice', hg.v, page_id, url, pages, {d_limit("'<h1>' || hg.shown || '</h1>'", 120)} FROM hd JOIN hg ON hd.v = hg.v)"""


# What cross-page checks compare, and what is kept of the crawl record for them.
_FACTS = ("title", "description", "h1s", "canonical", "hreflang")
_RECORD = ("seq", "url", "final_url", "status", "redirects", "headers", "body_bytes", "error")


def _audited(spark, sf, *checks):
    """The page table of the real crawl, written once when the cluster names a shared folder."""
    pages = page_columns(crawl(spark, sf), *_FACTS, "issues", only_checks=checks or _REAL_CHECKS, keep=_RECORD)
    return materialise(pages, "query-pages")


def _members(pages):
    return site.duplicates(site.site_pages(pages))


@query("duplicates", f"WITH {_DUP} SELECT type, category, context, pages AS n, page_id, url FROM m")
def duplicates(spark, sf):
    rows = _members(_audited(spark, sf, "main_landmark"))
    return rows.select("type", "category", "context", col("CAST(regexp_extract(message, ' on ([0-9]+) pages', 1) AS BIGINT)").alias("n"), F.col("seq").alias("page_id"), "url")


@query("site_issue_heads", f"""WITH {_DUP} SELECT type, 'warning' AS severity, context, CAST(count(*) AS BIGINT) AS n_urls,
CAST(sum(CAST('0x' || left(md5(url), 8) AS BIGINT)) AS BIGINT) AS urls_digest,
type || '-' || left(sha1(CAST(CAST(sum(CAST('0x' || left(md5(url), 8) AS BIGINT)) AS BIGINT) AS VARCHAR) || chr(10) || type || chr(10) || context), 8) AS id FROM m GROUP BY type, v, context""")
def site_issue_heads(spark, sf):
    return site.issue_heads(_members(_audited(spark, sf, "main_landmark"))).select("type", "severity", "context", "n_urls", "urls_digest", "id")


_HITS = f"""WITH {_DUP}, f AS ({_FIXED_SQL}),
hits AS (SELECT page_id, url, type, severity, category, context, url || type AS hit FROM f
         UNION ALL SELECT page_id, url, type, 'warning', category, context, type || v FROM m)"""


def _hits(spark, sf):
    pages = _audited(spark, sf)
    return pages, rollup.hits(issue_rows(pages), materialise(_members(pages), "query-members"))


# What the rules find in the markup and addresses that the pages have.  A page without markup is only told to be no HTML.
_TIMES = "len(regexp_extract_all(html, '{}'))".format
_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
_CANONICAL = "regexp_extract(html, '<link rel=\"canonical\" href=\"([^\"]*)\"', 1)"
_FOUND = {
    "errors": (f"({D_TITLE} = '')::INT", f"{_TIMES('<img[ >]')} - {_TIMES('<img [^>]*alt=')}"),
    "warnings": (
        f"(length({D_TITLE}) > 60)::INT", f"({_TIMES('<h1[ >]')} = 0)::INT", "(trim(regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1)) = '')::INT",
        f"{_TIMES('<img[ >]')} - {_TIMES('<img [^>]*(width=[^>]*height=|height=[^>]*width=)')}", "(NOT contains(html, '<meta name=\"viewport\"'))::INT", "(NOT contains(html, '<meta name=\"description\"'))::INT",
        f"({_CANONICAL} = '')::INT", "(octet_length(encode(html)) > 2097152)::INT",
        f"CASE WHEN starts_with(url, 'https:') THEN {_TIMES('<(img|source|script|iframe|audio|video) [^>]*src=' + chr(34) + 'http:')} ELSE 0 END"),
    "infos": (
        f"({_TIMES('<h1[ >]')} > 1)::INT", "(NOT contains(html, '<main'))::INT", "(NOT contains(html, '<meta property=\"og:'))::INT", "(NOT contains(html, '<meta name=\"twitter:card\"'))::INT",
        "coalesce(length(regexp_replace(url, '#.*$', '')) > 100, false)::INT", f"coalesce(contains({_PATH}, '_'), false)::INT", f"coalesce({_PATH} <> lower({_PATH}), false)::INT"),
}
_FOUND_SQL = ", ".join(f"CASE WHEN html IS NULL THEN {int(name == 'infos')} ELSE {' + '.join(counts)} END AS {name}" for name, counts in _FOUND.items())


@query("summary", f"""WITH {_DUP}, i AS (SELECT {_FOUND_SQL} FROM pages),
e AS (SELECT DISTINCT {d_key('url')} AS k FROM pages WHERE {_CANONICAL} <> '' AND {d_key(_CANONICAL)} <> {d_key('url')})
SELECT count(*) AS pages, CAST(coalesce(sum(errors), 0) AS BIGINT) AS errors, CAST(coalesce(sum(warnings), 0) + (SELECT count(DISTINCT type || v) FROM m) AS BIGINT) AS warnings,
CAST(coalesce(sum(infos), 0) + (SELECT count(*) FROM e) AS BIGINT) AS infos FROM i""")
def summary(spark, sf):
    """Totals over every page check and every cross-page check that needs only the pages.

    Pages are parsed once; each group of checks and each cross-page check is planned and written by itself.
    """
    tree = materialise(parsed(crawl(spark, sf)), "query-nodes")
    pages = materialise(columns_of(tree, *_FACTS, "issues", only_checks=CHECK_GROUPS[0], keep=_RECORD), "query-pages")
    issues = issue_rows(pages).select("severity")
    for group in CHECK_GROUPS[1:]:
        issues = issues.unionByName(issue_rows(materialise(columns_of(tree, "issues", only_checks=group, keep=("seq", "url")), "query-issues")).select("severity"))
    keys = materialise(site.site_pages(pages), "query-site-pages")
    members = reduce(DataFrame.unionByName, [materialise(check(keys), "query-members") for check in site.SITE_CHECKS])
    return rollup.summary(pages, issues, site.issue_heads(members))


@query("group_issues", f"{_HITS} SELECT type, min(severity) AS severity, min(category) AS category, count(DISTINCT url) AS pages, count(DISTINCT hit) AS hits FROM hits GROUP BY type")
def group_issues(spark, sf):
    return rollup.order_findings(rollup.group_issues(_hits(spark, sf)[1]))


@query("split_findings", f"""{_HITS} SELECT CASE WHEN severity = 'info' THEN 'note' ELSE 'fix' END AS part, type FROM (SELECT type, min(severity) AS severity FROM hits GROUP BY type)""")
def split_findings(spark, sf):
    fix, notes = rollup.split_findings(rollup.group_issues(_hits(spark, sf)[1]))
    return fix.select(F.lit("fix").alias("part"), "type").unionByName(notes.select(F.lit("note").alias("part"), "type"))


_COUNTS = f"{_HITS}, c AS (SELECT p.page_id, p.url, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM pages p LEFT JOIN hits h ON p.url = h.url GROUP BY ALL)"


@query("page_lines", f"{_COUNTS} SELECT page_id, url, errors, warnings, infos FROM c")
def page_lines(spark, sf):
    pages = _audited(spark, sf)
    counts = rollup.page_counts_in_row(pages, _members(pages).select("url", "severity"))
    return rollup.page_lines(rollup.worst_first(counts)).selectExpr("seq AS page_id", "url", "errors", "warnings", "infos")


@query("page_health", f"{_COUNTS} SELECT count(*) FILTER (errors > 0) AS errors, count(*) FILTER (errors = 0 AND warnings > 0) AS warnings, count(*) FILTER (errors = 0 AND warnings = 0) AS clean FROM c")
def page_health(spark, sf):
    pages = _audited(spark, sf)
    return rollup.page_health(rollup.page_counts(pages, rollup.pages_with_site_issues(pages, issue_rows(pages), _members(pages))))


@query("pages_with_site_issues", f"{_HITS} SELECT url, type, context FROM hits")
def pages_with_site_issues(spark, sf):
    pages = _audited(spark, sf)
    return rollup.pages_with_site_issues(pages, issue_rows(pages), _members(pages)).select("url", "type", "context")


@query("digest_messages", f"""WITH {_DUP}, x AS (SELECT type, 'Same ' || CASE type WHEN 'duplicate-title' THEN 'title' ELSE 'h1' END || ' on ' || pages || ' pages' AS message, url, page_id FROM m),
c AS (SELECT type, message, count(DISTINCT url) AS pages, min(page_id) AS s FROM x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY pages DESC, s, message) AS n, count(*) OVER (PARTITION BY type) AS total FROM c)
SELECT type, CAST(n AS BIGINT) AS n, message, pages, CAST(greatest(total - 3, 0) AS BIGINT) AS more_messages FROM r WHERE n <= 3""")
def digest_messages(spark, sf):
    out = rollup.digest_messages(rollup.hits(None, materialise(_members(_audited(spark, sf, "main_landmark")), "query-members")))
    return rows_of(out, "messages", "type", "CAST(more_messages AS BIGINT) AS more_messages").selectExpr(
        "type", "CAST(pos + 1 AS BIGINT) AS n", "row.message AS message", "row.pages AS pages", "more_messages")


@query("digest_variants", f"""WITH {_DUP}, c AS (SELECT type, context, count(DISTINCT url) AS pages, min(page_id) AS s FROM m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY pages DESC, s, context) AS n, count(*) OVER (PARTITION BY type) AS total FROM c),
u AS (SELECT type, context, url, row_number() OVER (PARTITION BY type, context ORDER BY page_id, url) AS k FROM (SELECT type, context, url, min(page_id) AS page_id FROM m GROUP BY ALL))
SELECT type, CAST(n AS BIGINT) AS n, context, pages, (SELECT string_agg(url, ' ' ORDER BY k) FROM u WHERE u.type = r.type AND u.context = r.context AND k <= 3) AS urls,
CAST(greatest(total - 5, 0) AS BIGINT) AS more_variants FROM r WHERE n <= 5""")
def digest_variants(spark, sf):
    out = rollup.digest_variants(rollup.hits(None, materialise(_members(_audited(spark, sf, "main_landmark")), "query-members")))
    return rows_of(out, "variants", "type", "CAST(more_variants AS BIGINT) AS more_variants").selectExpr(
        "type", "CAST(pos + 1 AS BIGINT) AS n", "row.context AS context", "row.pages AS pages", "array_join(row.urls, ' ') AS urls", "more_variants")


_HIT_MESSAGES = """CASE type WHEN 'missing-canonical' THEN 'Page has no canonical link' WHEN 'missing-description' THEN 'Page has no meta description' WHEN 'missing-open-graph' THEN 'Page has no Open Graph tags'
WHEN 'missing-twitter-card' THEN 'Page has no twitter:card' WHEN 'missing-main-landmark' THEN 'Page has no main landmark' WHEN 'missing-viewport' THEN 'Page has no viewport tag' END"""


@query("digest_findings", f"""{_HITS}, dg_rows AS (SELECT page_id, url, type, category, context, severity, hit, {_HIT_MESSAGES} AS message FROM hits WHERE type NOT LIKE 'duplicate%'
  UNION ALL SELECT page_id, url, type, category, context, 'warning', type || v, 'Same ' || CASE type WHEN 'duplicate-title' THEN 'title' ELSE 'h1' END || ' on ' || pages || ' pages' FROM m),
dg_types AS (SELECT type, min(CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END) AS rank, min(category) AS category, count(DISTINCT url) AS pages, count(DISTINCT hit) AS hits,
  count(DISTINCT message) AS n_messages, count(DISTINCT context) AS n_variants FROM dg_rows GROUP BY type),
dg_messages AS (SELECT type, message, count(DISTINCT url) AS n, min(page_id) AS s FROM dg_rows GROUP BY ALL),
dg_message_places AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, s, message) AS place FROM dg_messages),
dg_variants AS (SELECT type, context, count(DISTINCT url) AS n, min(page_id) AS s FROM dg_rows GROUP BY ALL),
dg_variant_places AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, s, context) AS place FROM dg_variants),
dg_urls AS (SELECT type, context, url, page_id, row_number() OVER (PARTITION BY type, context ORDER BY page_id, url) AS k FROM (SELECT type, context, url, min(page_id) AS page_id FROM dg_rows GROUP BY ALL)),
dg_shown AS (SELECT type, context, string_agg(url, ' ' ORDER BY k) AS urls FROM dg_urls WHERE k <= 3 GROUP BY ALL),
dg_first AS (SELECT type, context, min(message) AS message FROM dg_rows SEMI JOIN dg_urls ON dg_urls.type = dg_rows.type AND dg_urls.context = dg_rows.context AND dg_urls.url = dg_rows.url AND dg_urls.page_id = dg_rows.page_id AND dg_urls.k = 1 GROUP BY ALL)
SELECT type, CASE rank WHEN 1 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END AS severity, category, pages, hits, true AS has_advice,
  (SELECT string_agg(message || ' (' || n || ')', '; ' ORDER BY place) FROM dg_message_places WHERE dg_message_places.type = dg_types.type AND place <= 3) AS messages, CAST(greatest(n_messages - 3, 0) AS BIGINT) AS more_messages,
  (SELECT string_agg(dg_first.message || ' | ' || dg_variant_places.context || ' | ' || n || ' | ' || urls, '; ' ORDER BY place) FROM dg_variant_places JOIN dg_shown USING (type, context) JOIN dg_first USING (type, context) WHERE dg_variant_places.type = dg_types.type AND place <= 5) AS variants,
  CAST(greatest(n_variants - 5, 0) AS BIGINT) AS more_variants FROM dg_types""")
def digest_findings(spark, sf):
    """Every column of a digest line; lists as text, in their order."""
    found = rollup.digest_findings(_hits(spark, sf)[1], rules(spark))
    return found.select(
        "type", "severity", "category", "pages", "hits", col("title IS NOT NULL AND fix IS NOT NULL").alias("has_advice"), col("array_join(transform(messages, m -> concat(m.message, ' (', m.pages, ')')), '; ')").alias("messages"),
        "more_messages", col("array_join(transform(variants, v -> concat(v.message, ' | ', v.context, ' | ', v.pages, ' | ', array_join(v.urls, ' '))), '; ')").alias("variants"), "more_variants")



@query("report_rules", f"{_HITS} SELECT DISTINCT type FROM hits")
def query_report_rules(spark, sf):
    return report_rules(rules(spark), _hits(spark, sf)[1]).select("type")


@query("fail_on", f"{_HITS} SELECT 'error' AS level, count(*) FILTER (severity = 'error') > 0 AS fails FROM hits UNION ALL SELECT 'warning', count(*) FILTER (severity IN ('error', 'warning')) > 0 FROM hits")
def fail_on(spark, sf):
    pages = _audited(spark, sf)
    totals = rollup.summary(pages, issue_rows(pages), site.issue_heads(_members(pages)))
    return rollup.fail_on(totals, "error").select(F.lit("error").alias("level"), "fails").unionByName(rollup.fail_on(totals, "warning").select(F.lit("warning").alias("level"), "fails"))


@query("issue_rows", f"{_HITS} SELECT severity, type, url FROM hits")
def issue_sink(spark, sf):
    return _hits(spark, sf)[1].select("severity", "type", "url")


@query("report_pages", f"""SELECT page_id, url, 200 AS status, {d_limit(D_TITLE, 300)} AS title, CAST({len(FIXED)} AS BIGINT) AS n_issues,
CASE WHEN {_H1} <> '' THEN {d_limit(_H1, 300)} END AS h1 FROM pages""")
def report_pages(spark, sf):
    docs = report.report_pages(_audited(spark, sf))
    return docs.selectExpr("seq AS page_id", "url", "status", "facts.title AS title", "CAST(size(issues) AS BIGINT) AS n_issues", "get(facts.h1s, 0) AS h1")


_FLAT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://', ''), '[^A-Za-z0-9.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')"


@query("content_table", f"""WITH b AS (SELECT page_id, url, html, left({_FLAT}, 100) AS base FROM pages), n AS (SELECT *, count(*) OVER (PARTITION BY lower(base)) AS k FROM b)
SELECT page_id, base || CASE WHEN k = 1 THEN '' ELSE '-' || left(sha1(url || chr(10) || page_id), 12) END || '.md' AS content_name, 'article' AS area, {d_limit(_ARTICLE, 1500)} AS main_text FROM n""")
def content_table(spark, sf):
    pages = page_columns(crawl(spark, sf), "title", "main_area", "main_text")
    return report.content_table(pages, crawl(spark, sf).select("seq", "url")).selectExpr("seq AS page_id", "content_name", "main_area AS area", "main_text")


@query("unique_ids", """WITH i AS (SELECT page_id, url, unnest([1, 2, 3]) AS n FROM pages)
SELECT page_id, n, 'demo-' || left(sha1(url || chr(10) || 'demo' || chr(10) || 'same'), 8) || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS id FROM i""")
def unique_ids(spark, sf):
    one = tx.issue_id("url", "'demo'", "'same'")
    return crawl(spark, sf).select(F.col("seq").alias("page_id"), col(f"posexplode({tx.unique_ids(f'array({one}, {one}, {one})')})").alias("pos", "id")).selectExpr("page_id", "pos + 1 AS n", "id")


@query("duplicate_descriptions", f"""WITH p AS (SELECT page_id, url, {d_key('url')} AS k, 'About ' || (page_id // 3) AS v FROM pages), g AS (SELECT v, count(DISTINCT k) AS pages FROM p GROUP BY v HAVING count(DISTINCT k) > 1),
f AS (SELECT lower(v) AS v, arg_min(CASE WHEN page_id % 2 = 0 THEN v ELSE upper(v) END, page_id) AS shown FROM p GROUP BY lower(v))
SELECT page_id, 'Same meta description on ' || pages || ' pages' AS message, '<meta name="description" content="' || shown || '">' AS context FROM p JOIN g USING (v) JOIN f ON f.v = lower(p.v)""")
def duplicate_descriptions(spark, sf):
    """Descriptions that three pages share, in two spellings."""
    text = "concat('About ', seq div 3)"
    pages = decorated(spark, sf, head=f"concat('<meta name=\"description\" content=\"', CASE WHEN seq % 2 = 0 THEN {text} ELSE upper({text}) END, '\">')")
    facts = page_columns(pages, "title", "description", "h1s", "canonical", "hreflang", "issues", only_checks=("main_landmark",), keep=("seq", "url", "final_url", "status", "redirects", "headers", "body_bytes", "error"))
    rows = site.duplicates(site.site_pages(materialise(facts, "query-pages"))).filter("type = 'duplicate-description'")
    return rows.select(F.col("seq").alias("page_id"), "message", "context")
