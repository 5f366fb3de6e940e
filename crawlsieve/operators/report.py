"""Report, digest, coverage and content tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import col
from ..functions.text import MAX_URL, limit_text
from ..functions.urls import parts

SCHEMA_VERSION, DIGEST_VERSION = 1, 1  # Fixed values: versions of the document shapes.
MAX_FACT_TEXT, MAX_H1S, MAX_HREFLANG, MAX_NAME = 300, 10, 100, 100


def report_facts(audited: DataFrame) -> DataFrame:
    """Facts as a report shows them: long texts and lists capped."""
    return audited.withColumns({
        "title": col(limit_text("title", MAX_FACT_TEXT)), "description": col(limit_text("description", MAX_FACT_TEXT)),
        "h1s": col(f"transform(slice(h1s, 1, {MAX_H1S}), h -> {limit_text('h', MAX_FACT_TEXT)})"),
        "hreflang": col(f"transform(slice(hreflang, 1, {MAX_HREFLANG}), h -> named_struct('lang', h.lang, 'href', {limit_text('h.href', MAX_URL)}))"),
    })


def _base_name(url: str = "url") -> str:
    flat = f"transform(array({parts(url)}), p -> concat(regexp_replace(lower(p[1]), '^.*@', ''), CASE WHEN p[2] = '' THEN '/' ELSE p[2] END, p[3]))[0]"
    safe = f"nullif(left(regexp_replace(regexp_replace({flat}, '[^A-Za-z0-9.-]+', '_'), '^[._]+|[._]+$', ''), {MAX_NAME}), '')"
    return f"coalesce({safe}, 'page')"


def content_table(audited: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Main text of each page that has HTML, under a safe unique name from host, path and query.

    A name that several of ``addresses`` (seq, url; the pages themselves unless given) would have, ignoring case, gets a
    hash of the page's address and number, so names are unique without numbering a group.  Clashing names are counted
    task by task and joined to the pages; given the addresses of the crawl, no markup is parsed for that.
    """
    html = audited.filter("main_area IS NOT NULL").select("seq", "url", "title", "main_area", "main_text", col(_base_name()).alias("base"))
    clashing = (addresses if addresses is not None else audited).select(col(f"lower({_base_name()})").alias("name")).groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")
    named = html.join(clashing.select("name", F.lit(True).alias("clashes")), F.lower("base") == F.col("name"), "left")
    own = "CASE WHEN clashes THEN concat('-', left(sha1(concat(url, '\n', seq)), 12)) ELSE '' END"
    return named.select("seq", "url", col(f"concat(base, {own}, '.md')").alias("content_name"), "title", "main_area", "main_text")


def coverage(totals: dict, links: DataFrame, *, limit: int | None = None, sitemaps: int = 0, sitemaps_complete: bool = True,
             lab_asked: bool = False, lab_ran: bool = False, links_asked: bool = True) -> DataFrame:
    """What was looked at and what was left out, and why (A16).  ``links`` is ``links_complete``."""
    found, audited = totals["found"], totals["audited"]
    lab = "'not asked for'" if not lab_asked else "NULL" if lab_ran else "'no page it was asked for returned HTML'"
    orphan = ("CASE " + ("" if sitemaps else "WHEN true THEN 'needs a sitemap' ") + ("" if sitemaps_complete else "WHEN true THEN 'a sitemap file could not be read' ")
              + f"WHEN {audited} <> {found} THEN 'only {audited} of {found} URLs were audited' WHEN unchecked > 0 THEN concat('checked ', checked, ' link targets, ', unchecked, ' were not checked') "
              "WHEN NOT complete THEN 'where some links lead is not known' END")
    not_run = (f"filter(array(named_struct('check', 'lighthouse', 'reason', CAST({lab} AS STRING)), named_struct('check', 'links', 'reason', "
               f"{'CAST(NULL AS STRING)' if links_asked else chr(39) + 'not asked for' + chr(39)}), named_struct('check', 'orphan-page', 'reason', {orphan if links_asked else 'CAST(NULL AS STRING)'})), n -> n.reason IS NOT NULL)")
    return links.select(F.lit(found).cast("bigint").alias("found"), F.lit(audited).cast("bigint").alias("audited"), F.lit(limit).cast("int").alias("limit"),
                        F.lit(sitemaps_complete).alias("sitemaps_complete"), "checked", "unchecked", "complete", col(not_run).alias("not_run"))


def orphans_skipped(links: DataFrame, found: int, audited: int, sitemaps: int, sitemaps_complete: bool = True) -> DataFrame:
    """Why orphan pages cannot be told apart, NULL when they can."""
    cov = coverage({"found": found, "audited": audited}, links, sitemaps=sitemaps, sitemaps_complete=sitemaps_complete)
    return cov.select(col("get(filter(not_run, n -> n.check = 'orphan-page'), 0).reason").alias("reason"))


def origins_report(access: DataFrame, platforms: DataFrame) -> DataFrame:
    """Crawler access, content signal and platform of each audited origin."""
    platform = platforms.select("origin", F.struct("name", "theme").alias("platform"))
    return access.join(platform, "origin", "left")


def report_pages(audited: DataFrame, attached: DataFrame | None = None, content: DataFrame | None = None) -> DataFrame:
    """One document per page: response, capped facts, issues (A18).  A report is a table of these, never one value."""
    facts = [c for c in ("title", "description", "h1s", "canonical", "lang", "viewport", "robots", "nosnippet_elements", "heading_outline", "word_count", "main_text",
                         "link_counts", "link_samples", "image_counts", "image_samples", "open_graph", "twitter_card", "hreflang", "jsonld_types", "authorship",
                         "page_dates", "author", "products", "platform") if c in audited.columns]
    pages = report_facts(audited).select("seq", "url", "final_url", "status", "redirects", "issues", F.when(col("h1s IS NOT NULL"), F.struct(*facts)).alias("facts"))
    if attached is not None:
        pages = pages.join(attached.select("url", "lab"), "url", "left")
    if content is not None:
        pages = pages.join(content.select("url", F.col("content_name").alias("content")), "url", "left")
    return pages


def write_report(path: str, pages: DataFrame, **tables: DataFrame) -> None:
    """The report as JSON lines: ``pages`` and one folder per further table."""
    for name, table in {"pages": pages, **tables}.items():
        table.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def write_digest(path: str, findings: DataFrame, lines: DataFrame, summary: DataFrame, **tables: DataFrame) -> None:
    """The short form: findings in order, page lines, totals."""
    head = summary.withColumn("digest_version", F.lit(DIGEST_VERSION)).withColumn("schema_version", F.lit(SCHEMA_VERSION))
    for name, table in {"findings": findings, "pages": lines, "summary": head, **tables}.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def write_issues(path: str, all_hits: DataFrame) -> None:
    """Issues as rows, by severity."""
    all_hits.write.mode("overwrite").partitionBy("severity").parquet(path)


def write_content(path: str, content: DataFrame) -> None:
    """Page texts as one table, not one file a page."""
    content.write.mode("overwrite").parquet(path)
