"""Internal links between pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import col, lit
from ..functions.text import context as cut_context
from ..functions.text import limit_text
from ..functions.urls import page_key, url_path, without_fragment
from .site import members
from .skew import salted_join

OUTCOME_SCHEMA = ("url STRING, status INT, final_url STRING, redirects ARRAY<STRUCT<url: STRING, status: INT, location: STRING>>, "
                  "canonical STRING, failed STRING")


def link_edges(audited: DataFrame) -> DataFrame:
    """(seq, url, final_url, target): each internal target of each page, once per page."""
    return audited.select("seq", "url", "final_url", col("explode_outer(internal_targets)").alias("target")).filter("target IS NOT NULL")


def link_targets(edges: DataFrame) -> DataFrame:
    """(target, pages): how many pages link to each target (J24).  A hub is counted by partial aggregation, its pages
    stay in the edge table."""
    return edges.groupBy("target").agg(F.count("*").alias("pages"), F.min("seq").alias("first_seq"))


def known_outcomes(audited: DataFrame) -> DataFrame:
    """What the audit knows about an address: under the one given, and under the final one."""
    failed = col("CASE WHEN error IS NOT NULL THEN 'the page could not be loaded' END").alias("failed")
    base = audited.select("seq", "url", "status", "final_url", "redirects", "canonical", failed)
    given = base.withColumn("rank", F.lit(0))
    final = base.filter("failed IS NULL").withColumns({"url": col(without_fragment("final_url")), "rank": F.lit(1), "redirects": col("slice(redirects, 1, 0)")})
    # The later of two inputs with one address wins, an address given wins over one landed on.
    fields = F.struct("status", "final_url", "redirects", "canonical", "failed")
    order = F.struct(F.col("rank"), F.when(F.col("rank") == 0, -F.col("seq")).otherwise(F.col("seq")).alias("seq"))
    return given.unionByName(final).groupBy("url").agg(F.min_by(fields, order).alias("o")).select("url", "o.*")


def targets_to_fetch(edges: DataFrame, known: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The unknown targets, most linked first, and how many of them a ``limit`` of the caller leaves out."""
    unknown = link_targets(edges).join(known.select(F.col("url").alias("target")), "target", "left_anti")
    work = unknown.orderBy(F.desc("pages"), "first_seq", "target")
    most = "n" if limit is None else str(limit)
    counted = unknown.agg(F.count("*").alias("n")).select(col(f"least(n, {most})").alias("checked"), col(f"greatest(n - {most}, 0)").alias("unchecked"))
    return (work if limit is None else work.limit(limit)).select("target", "pages"), counted


def targets_checked(edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: how many targets have a stored outcome, and how many have none."""
    known = outcomes.select(F.col("url").alias("target")).distinct().withColumn("known", F.lit(True))
    return link_targets(edges).join(known, "target", "left").agg(F.count("known").alias("checked"), (F.count("*") - F.count("known")).alias("unchecked"))


def outcome_issue() -> str:
    """STRUCT<type, context> of what an outcome means for the links to ``target``, NULL when they are fine."""
    address = lambda u: limit_text(u, 2000)
    where = f"CASE WHEN size(redirects) > 0 THEN concat({address('target')}, ' -> ', {address('o_final')}) ELSE {address('target')} END"
    http = f"concat({where}, ' (HTTP ', status, ')')"
    hops = f"concat({where}, ' (', array_join(transform(redirects, r -> CAST(r.status AS STRING)), ', '), ')')"
    row = lambda kind, ctx: f"named_struct('type', {lit(kind)}, 'context', {ctx})"
    unreachable = f"concat({address('target')}, ' (', {cut_context('failed')}, ')')"
    other = f"concat({address('target')}, ' -> canonical ', {address('canonical')})"
    return (f"CASE WHEN failed IS NOT NULL THEN {row('link-target-unreachable', unreachable)} "
            f"WHEN status = 429 OR status >= 500 THEN {row('link-target-unreachable', http)} "
            f"WHEN status >= 400 AND status NOT IN (401, 403, 407) THEN {row('broken-link', http)} "
            f"WHEN size(redirects) > 0 AND status < 400 THEN {row('link-to-redirect', hops)} "
            f"WHEN status = 200 AND canonical RLIKE '(?i)^https?://' AND {page_key('canonical')} <> {page_key('o_final')} THEN {row('link-to-non-canonical', other)} END")


MESSAGES = {
    "broken-link": "An internal link leads to an error", "link-target-unreachable": "An internal link target did not load",
    "link-to-redirect": "An internal link leads to a redirect", "link-to-non-canonical": "An internal link leads to a duplicate page",
}


def link_checks(edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Member rows: each page with a link to a bad target (J27).  Only bad targets are joined to the edges."""
    judged = outcomes.withColumnsRenamed({"url": "target", "final_url": "o_final"}).withColumn("found", col(outcome_issue())).filter("found IS NOT NULL")
    hit = salted_join(edges.select("seq", "url", "target"), judged.select("target", "found"), ["target"])
    out = None
    for kind, message in MESSAGES.items():
        rows = members(hit.filter(f"found.type = {lit(kind)}"), kind, lit(message), "found.context", ["target"])
        out = rows if out is None else out.unionByName(rows)
    return out


def inbound_links(edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(page_key, source): pages each page is reached from, through verified destinations."""
    good = outcomes.filter("failed IS NULL AND status < 400").select(F.col("url").alias("target"), col(page_key("final_url")).alias("page_key"))
    reached = salted_join(edges.select("url", "target", col(page_key("final_url")).alias("source")), good, ["target"], salts=4)
    return reached.select("page_key", "source").distinct()


def orphan_pages(pages: DataFrame, listings: DataFrame, inbound: DataFrame) -> DataFrame:
    """Sitemap pages no other page links to, the home page left out."""
    listed = pages.join(listings.select("url").distinct(), "url", "left_semi")
    elsewhere = inbound.filter("source <> page_key").select("page_key").distinct()
    # One pass over the listed pages tells both numbers.
    marked = listed.join(elsewhere.withColumn("linked", F.lit(True)), "page_key", "left").withColumn("orphan", col(f"has_facts AND linked IS NULL AND {url_path('final_url')} NOT IN ('', '/')"))
    counts = marked.agg(F.count("*").alias("listed"), F.count_if("orphan").alias("orphans"))
    sized = marked.join(F.broadcast(counts.withColumn("orphan", F.lit(True))), "orphan")  # one row
    return members(sized, "orphan-page", lit("No other page links to these sitemap pages"),
                   "concat(orphans, ' of ', listed, ' sitemap pages')", [])


def links_complete(outcomes: DataFrame, counted: DataFrame, audited: DataFrame) -> DataFrame:
    """One row: whether every link of every page is known and led somewhere known (J30); ``counted`` is ``targets_checked``."""
    open_ends = outcomes.agg(F.count_if(col("failed IS NOT NULL OR status = 429 OR status >= 500")).alias("unresolved"))
    unread = audited.agg(F.count_if(col("exists(issues, i -> i.type IN ('check-failed', 'html-too-large'))")).alias("unread"))
    return counted.withColumns({"unresolved": open_ends.scalar(), "unread": unread.scalar()}).withColumn("complete", col("unchecked = 0 AND unread = 0 AND unresolved = 0"))
