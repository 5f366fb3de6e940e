"""A run from its inputs to its coverage: arguments, lists and sitemaps are merged and limited, what they name is audited, and what was left out is told."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import col
from ..functions.urls import page_key
from ..operators import report
from ..operators.inputs import resolve_urls, skipped_entries
from ..operators.skew import materialise
from ..sources.crawl import as_crawl
from ..sources.sitemaps import expand_sitemap_index, sitemap_entries, sitemap_files
from .audit import Audit, audit

NOT_STORED = "no stored record"


@dataclass
class Inputs:
    """Merged inputs: all entries in order, the pages to audit, the inputs that name none with the reason, and one row of totals (found, audited, sitemaps_complete)."""

    entries: DataFrame
    urls: DataFrame
    skipped: DataFrame
    totals: DataFrame


@dataclass
class Run:
    """An audit with the inputs it came from.  ``urls`` are the pages asked for, as far as the limit goes; ``skipped`` the inputs that name none, with the reason."""

    audit: Audit
    urls: DataFrame
    skipped: DataFrame
    coverage: DataFrame


def _ordered(rows: DataFrame, part: int, name: str = "''", a: str = "0", b: str = "0", c: str = "0") -> DataFrame:
    """Entries whose ``seq`` sorts as the inputs were given: by part, then by the list's name or the sitemap's place, then by line."""
    seq = f"struct({part} AS part, CAST({name} AS STRING) AS name, CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b, CAST({c} AS BIGINT) AS c) AS seq"
    have = set(rows.columns)
    field = lambda f, default: f if f in have else f"CAST({default} AS {'BOOLEAN' if f == 'lighthouse' else 'STRING'}) AS {f}"
    return rows.selectExpr(seq, "value", field("source", "'argument'"), field("sitemap", "NULL"), field("lighthouse", "false"), field("rejected", "NULL"))


def gather_entries(args: DataFrame | None = None, lists: DataFrame | None = None, listed: DataFrame | None = None, marked: DataFrame | None = None) -> DataFrame:
    """All entries of a run in the order of its inputs: arguments (``entries_from_args``), lists (``parse_url_list``), sitemaps (``expand_sitemap_index``), pages marked for lab runs (value)."""
    parts = []
    if args is not None:
        parts.append(_ordered(args, 0, a="seq"))
    if lists is not None:
        parts.append(_ordered(lists, 1, name="name", a="line_no"))
    if listed is not None:
        parts.append(_ordered(listed, 2, a="ord.a", b="ord.b", c="ord.pos"))
    if marked is not None:
        parts.append(_ordered(marked.withColumn("lighthouse", F.lit(True)).withColumn("source", F.lit("--lighthouse-page")), 3))
    if not parts:
        raise ValueError("a run needs arguments, a list or a sitemap")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def records_of(crawl: DataFrame, urls: DataFrame) -> DataFrame:
    """The stored record of each page asked for (the first by ``seq``), under the spelling that was kept; a page without one has an error.

    Which record it is, is settled on keys; markup is joined once.
    """
    keyed = crawl.withColumn("_key", col(page_key("url")))
    first = keyed.groupBy("_key").agg(F.min("seq").alias("_seq"))
    chosen = urls.select(F.col("page_key").alias("_key"), F.col("url").alias("_url")).join(first, "_key", "left")
    held = keyed.join(chosen.filter("_seq IS NOT NULL"), "_key").filter("seq = _seq").withColumn("url", F.col("_url")).drop("_key", "_seq", "_url")
    # after all stored pages, in no order among themselves
    missing = chosen.filter("_seq IS NULL").selectExpr("(1L << 62) + (xxhash64(_url) & ((1L << 61) - 1)) AS seq", "_url AS url", "CAST(NULL AS STRING) AS html", f"'{NOT_STORED}' AS error", "CAST(NULL AS INT) AS status")
    return held.unionByName(as_crawl(missing), allowMissingColumns=True)


def _coverage(totals: DataFrame, result: Audit, *, limit: int | None, sitemaps: bool, lab_asked: bool) -> DataFrame:
    """What was looked at and what was left out, and why, one row (A16).  All of it is worked out when it is read."""
    links = result.links_complete
    if links is not None:
        totals = totals.withColumns({name: links.select(name).scalar() for name in ("checked", "unchecked", "complete")})
    else:
        totals = totals.withColumns({"checked": F.lit(None).cast("bigint"), "unchecked": F.lit(None).cast("bigint"), "complete": F.lit(None).cast("boolean")})
    if result.lab is not None:
        totals = totals.withColumn("lab_pages", result.lab.agg(F.count_if(col("lab IS NOT NULL OR lab_error IS NOT NULL"))).scalar())
    lab = "'not asked for'" if not lab_asked else "CASE WHEN lab_pages = 0 THEN 'no page it was asked for returned HTML' END" if result.lab is not None else "'no runs are stored'"
    orphan = ("CASE " + ("" if sitemaps else "WHEN true THEN 'needs a sitemap' ") + "WHEN NOT sitemaps_complete THEN 'a sitemap file could not be read' "
              "WHEN audited <> found THEN concat('only ', audited, ' of ', found, ' URLs were audited') "
              "WHEN unchecked > 0 THEN concat('checked ', checked, ' link targets, ', unchecked, ' were not checked') WHEN NOT complete THEN 'where some links lead is not known' END")
    entry = lambda check, reason: f"named_struct('check', '{check}', 'reason', CAST({reason} AS STRING))"
    reasons = [entry("lighthouse", lab), entry("links", "NULL" if links is not None else "'not asked for'"), entry("orphan-page", orphan if links is not None else "NULL")]
    return totals.select("found", "audited", F.lit(limit).cast("int").alias("limit"), "sitemaps_complete", "checked", "unchecked", "complete",
                         col(f"filter(array({', '.join(reasons)}), n -> n.reason IS NOT NULL)").alias("not_run"))


def resolve_inputs(*, args: DataFrame | None = None, lists: DataFrame | None = None, sitemap_bodies: DataFrame | None = None, marked: DataFrame | None = None,
                   limit: int | None = None, folder: str | None = None) -> Inputs:
    """Merge the inputs of a run into the list of pages to audit.

    ``sitemap_bodies`` are stored files (``sources.sitemaps.FILE_SCHEMA``), those that were ``given`` and others that an index may name; without that column all were
    given.  ``limit`` keeps the first pages and every marked one.
    """
    listed = unread = None
    if sitemap_bodies is not None:
        bodies = sitemap_bodies if "given" in sitemap_bodies.columns else sitemap_bodies.withColumn("given", F.lit(True))
        files = sitemap_files(bodies).join(bodies.groupBy("url").agg(F.max("given").alias("given")), "url")
        listed, unread = expand_sitemap_index(files, sitemap_entries(files))
        failed = files.filter("given AND error IS NOT NULL").selectExpr("url AS input", "'--sitemap' AS source", "concat('could not read sitemap: ', error) AS reason")
        unread = materialise(unread.unionByName(failed), "unread-sitemaps", folder)
    entries = materialise(gather_entries(args, lists, listed, marked), "entries", folder)
    urls = materialise(resolve_urls(entries, limit), "urls", folder)
    totals = resolve_urls(entries).agg(F.count("*").alias("found")).withColumns({
        "audited": urls.agg(F.count("*")).scalar(), "sitemaps_complete": F.lit(True) if unread is None else unread.agg(F.count("*")).scalar() == 0})
    skipped = skipped_entries(entries).select("input", "source", "reason")
    return Inputs(entries, urls, skipped if unread is None else unread.unionByName(skipped), totals)


def run_audit(crawl: DataFrame, *, args: DataFrame | None = None, lists: DataFrame | None = None, sitemap_bodies: DataFrame | None = None, marked: DataFrame | None = None,
              limit: int | None = None, link_outcomes: DataFrame | None = None, lab_runs: DataFrame | None = None, folder: str | None = None, **more) -> Run:
    """Merge the inputs (``resolve_inputs``), audit what they name, and tell what was left out.

    Orphan pages are told only when every sitemap was read, no page was cut and every link is known.  ``more`` goes to ``audit``.
    """
    inputs = resolve_inputs(args=args, lists=lists, sitemap_bodies=sitemap_bodies, marked=marked, limit=limit, folder=folder)
    whole = inputs.totals.select(col(f"{'true' if sitemap_bodies is not None else 'false'} AND sitemaps_complete AND audited = found").alias("whole"))
    picked = inputs.urls.filter("marked").select("url") if marked is not None else None
    result = audit(records_of(crawl, inputs.urls), sitemap_bodies=sitemap_bodies, entries=inputs.entries, link_outcomes=link_outcomes, lab_runs=lab_runs, picked=picked, whole=whole, folder=folder, **more)
    cover = _coverage(inputs.totals, result, limit=limit, sitemaps=sitemap_bodies is not None, lab_asked=lab_runs is not None or marked is not None)
    return Run(audit=result, urls=inputs.urls, skipped=inputs.skipped, coverage=cover)


def write_run(path: str, run: Run) -> None:
    """Report, digest tables, coverage and skipped inputs of a run under one folder."""
    pages = report.report_pages(run.audit.pages, run.audit.lab, run.audit.content)
    report.write_report(f"{path}/report", pages, coverage=run.coverage, skipped=run.skipped, site_issues=run.audit.site_issues)
    report.write_digest(f"{path}/digest", run.audit.findings, run.audit.page_lines, run.audit.summary, coverage=run.coverage, skipped=run.skipped)
    report.write_issues(f"{path}/issues", run.audit.hits)
    report.write_content(f"{path}/content", run.audit.content)
