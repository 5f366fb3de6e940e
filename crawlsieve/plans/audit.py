"""A whole audit: page facts and issues, cross-page checks, roll-ups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import lab, links, platform, report, robots, rollup, site, sitemaps
from ..operators.inputs import listings as listings_of
from ..operators.pages import page_audit
from ..operators.issues import issue_rows
from ..operators.rules import rules
from ..operators.skew import materialise
from ..sources.lab import parse_lab_runs
from ..sources.robots import robots_sets, robots_status
from ..sources.sitemaps import first_lastmod, sitemap_entries, sitemap_files
from ..functions.urls import page_key


@dataclass
class Audit:
    """The tables of an audit.  Pages, their keys, the member rows and the groups of the digest are written when it is made; the others are lazy."""

    pages: DataFrame
    page_issues: DataFrame
    site_members: DataFrame
    site_issues: DataFrame
    hits: DataFrame
    summary: DataFrame
    health: DataFrame
    findings: DataFrame
    page_lines: DataFrame
    origins: DataFrame | None
    lab: DataFrame | None
    content: DataFrame
    rules: DataFrame
    work_list: DataFrame
    links_checked: DataFrame
    links_complete: DataFrame | None = None
    average_scores: DataFrame | None = None
    lab_audits: DataFrame | None = None


def audit(crawl: DataFrame, *, robots_files: DataFrame | None = None, sitemap_bodies: DataFrame | None = None, entries: DataFrame | None = None,
          link_outcomes: DataFrame | None = None, lab_runs: DataFrame | None = None, picked: DataFrame | None = None, checks=(), page_checks=(), whole: DataFrame | None = None, folder: str | None = None) -> Audit:
    """Audit crawl records, with whatever else was stored beside them.

    ``whole`` is one row with a boolean: whether ``entries`` are all pages of their sitemaps and all were audited; where it is false no orphan page is told.
    ``page_checks`` are functions that give the SQL of an array of raw issues over a page's columns, ``checks`` functions from the page table to member rows (``operators.site.MEMBER_COLUMNS``) of the user's own.
    The page table is written once to shared storage (``spark.checkpoint.dir`` or ``folder``), because every later
    table reads some of its columns and the markup must not be parsed again for each.
    """
    spark = crawl.sparkSession
    audited = page_audit(crawl, page_checks)
    if sitemap_bodies is not None:
        lastmods = first_lastmod(sitemap_entries(sitemap_files(sitemap_bodies)), page_key)
        keyed = audited.selectExpr("*", f"{page_key('url')} AS _key")
        audited = keyed.join(lastmods.withColumnRenamed("page_key", "_key"), "_key", "left").drop("_key")
    pages = materialise(audited, "pages", folder)
    keys = materialise(site.site_pages(pages), "site-pages", folder)
    member_rows = [site.site_checks(keys)]
    origins = attached = all_known = None
    if robots_files is not None:
        sets = robots_sets(robots_status(robots_files))
        checked = materialise(robots.robots_pages(keys, sets), "robots-pages", folder)
        member_rows.append(robots.robots_checks(checked))
        if sitemap_bodies is None:
            member_rows.append(sitemaps.no_sitemap_declared(checked))
        origins = report.origins_report(robots.crawler_access(checked), platform.origin_platform(pages))
    listed = listings_of(entries) if entries is not None else None
    if sitemap_bodies is not None:
        files = sitemap_files(sitemap_bodies)
        file_entries = sitemap_entries(files)
        member_rows.append(sitemaps.sitemap_file_checks(files, file_entries))
        if robots_files is not None:
            member_rows.append(sitemaps.off_host(files, file_entries, sets))
    if listed is not None:
        member_rows.append(sitemaps.sitemap_entry_checks(keys, listed))
    edges = links.link_edges(pages)
    outcomes = links.known_outcomes(pages)
    if link_outcomes is not None:
        outcomes = outcomes.unionByName(link_outcomes.join(outcomes.select("url"), "url", "left_anti"))
        member_rows.append(links.link_checks(edges, outcomes))
        all_known = links.links_complete(outcomes, links.targets_checked(edges, outcomes), pages)
        if listed is not None:
            # Only when every link of every page leads somewhere known can a page be told to have none.
            complete = all_known.select("complete")
            orphans = links.orphan_pages(keys, listed, links.inbound_links(edges, outcomes))
            member_rows.append(orphans.filter(complete.scalar() if whole is None else complete.scalar() & whole.scalar()))
    for check in checks:
        member_rows.append(check(pages))
    rows = member_rows[0]
    for more in member_rows[1:]:
        rows = rows.unionByName(more)
    members = materialise(rows, "site-members", folder)
    issues = issue_rows(pages)
    if lab_runs is not None:
        runs = parse_lab_runs(lab_runs)
        attached = lab.attach_lab(keys, lab.lab_summary(runs), lab.failed_runs(runs), picked)
        lab_found = lab.lab_issues(attached)
        issues = issues.unionByName(lab_found, allowMissingColumns=True)
    heads = site.issue_heads(members)
    all_hits = rollup.hits(issues, members)
    listed_by = members.select("url", "severity")
    if attached is not None:
        listed_by = listed_by.unionByName(lab_found.select("url", "severity"))
    counts = rollup.page_counts_in_row(pages, listed_by)
    content = report.content_table(pages)
    return Audit(
        pages=pages, page_issues=issues, site_members=members, site_issues=heads, hits=all_hits, summary=rollup.summary(pages, issues, heads),
        health=rollup.page_health(counts), findings=rollup.order_findings(rollup.digest_findings(all_hits, rules(spark), folder)),
        page_lines=rollup.page_lines(counts, attached, content), origins=origins, lab=attached, content=content,
        rules=rules(spark), work_list=links.targets_to_fetch(edges, outcomes)[0], links_checked=links.targets_checked(edges, outcomes), links_complete=all_known,
        average_scores=lab.average_scores(attached) if attached is not None else None, lab_audits=lab.lab_audits(attached) if attached is not None else None)
