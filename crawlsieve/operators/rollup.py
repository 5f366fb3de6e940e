"""Roll-ups over issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sql import col
from ..functions.text import limit_text
from .rules import severity_rank
from .skew import materialise, top_k

MAX_VARIANTS, MAX_MESSAGES, MAX_URLS = 5, 3, 3  # Fixed values: how long the lists of a digest are.
HIT_COLUMNS = ("hit", "type", "severity", "category", "message", "context", "selector", "html", "actual", "expected", "seq", "url")


SEVERITIES = (("error", "errors"), ("warning", "warnings"), ("info", "infos"))


def count_severities(*, prefix: str = "") -> list:
    """Aggregates errors, warnings, infos (A1)."""
    return [F.count_if(F.col("severity") == s).alias(f"{prefix}{name}") for s, name in SEVERITIES]


def hits(page_issues: DataFrame | None, site_members: DataFrame | None = None) -> DataFrame:
    """Page and site issues, or one of them, in one shape: one row per hit and page; a site issue is one hit with many rows."""
    missing = lambda df: [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in HIT_COLUMNS[1:]]
    parts = []
    if page_issues is not None:
        parts.append(page_issues.select(F.concat_ws(" ", "url", "id").alias("hit"), *missing(page_issues)))
    if site_members is not None:
        parts.append(site_members.select(F.col("issue_key").alias("hit"), *missing(site_members)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def summary(n_pages: DataFrame, page_issues: DataFrame, site_heads: DataFrame) -> DataFrame:
    """Pages and issues by severity, page and site issues together (A2)."""
    both = page_issues.select("severity").unionByName(site_heads.select("severity"))
    return both.agg(*count_severities()).withColumn("pages", n_pages.agg(F.count("*")).scalar())


def group_issues(all_hits: DataFrame) -> DataFrame:
    """One row per issue type: worst severity, hits, pages (A3).

    Pairs of type and page are made distinct before they are counted, so a type found on every page is counted in
    many tasks.
    """
    rank = severity_rank("severity")
    per_hit = all_hits.groupBy("type", "hit").agg(F.min(col(rank)).alias("rank"), F.min("category").alias("category"))
    by_type = per_hit.groupBy("type").agg(F.count("*").alias("hits"), F.min("rank").alias("rank"), F.min("category").alias("category"))
    pages = all_hits.select("type", "url").distinct().groupBy("type").agg(F.count("*").alias("pages"))
    return by_type.join(pages, "type").select("type", col("element_at(array('error', 'warning', 'info'), CAST(rank AS INT))").alias("severity"), "category", "pages", "hits")


def order_findings(groups: DataFrame) -> DataFrame:
    """Severity, then pages, then type."""
    return groups.orderBy(col(severity_rank("severity")), F.desc("pages"), "type")


def pages_with_site_issues(pages: DataFrame, page_issues: DataFrame, site_members: DataFrame) -> DataFrame:
    """Every issue a page has or is listed by (A4): (url, type, severity, ...)."""
    fields = ("url", "type", "severity", "category", "message", "context")
    listed = site_members.select(*fields).join(pages.select("url"), "url", "left_semi")
    return page_issues.select(*fields).unionByName(listed)


def page_counts(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Severity counts of every page, clean ones included, from rows of issues."""
    counts = issues.groupBy("url").agg(*count_severities())
    joined = pages.select("seq", "url", "final_url", "status").join(counts, "url", "left")
    return joined.fillna(0, ["errors", "warnings", "infos"])


def page_counts_in_row(pages: DataFrame, more: DataFrame) -> DataFrame:
    """Severity counts of every page: its own issues are counted where they lie, and only ``more`` (url, severity), the issues that list it, is joined.

    Inputs with the same address share what either has, as ``page_counts`` has it.
    """
    names = [name for _, name in SEVERITIES]
    own = [col(f"coalesce(CAST(size(filter(issues, i -> i.severity = '{severity}')) AS BIGINT), 0L)").alias(f"own_{name}") for severity, name in SEVERITIES]
    listed = more.groupBy("url").agg(*count_severities())
    joined = pages.select("seq", "url", "final_url", "status", *own).join(listed, "url", "left")
    # the join has the pages by address, so inputs with one address are together without another shuffle
    alike = W.partitionBy("url")
    return joined.select("seq", "url", "final_url", "status", *[(F.sum(f"own_{name}").over(alike) + F.coalesce(name, F.lit(0))).alias(name) for name in names])


def worst_first(counts: DataFrame) -> DataFrame:
    """Most errors, then warnings, then infos, then input order."""
    return counts.orderBy(F.desc("errors"), F.desc("warnings"), F.desc("infos"), "seq")


def page_health(counts: DataFrame) -> DataFrame:
    """Pages by their worst state (A5)."""
    return counts.agg(F.count_if(F.col("errors") > 0).alias("errors"), F.count_if(col("errors = 0 AND warnings > 0")).alias("warnings"),
                      F.count_if(col("errors = 0 AND warnings = 0")).alias("clean"))


#: Kinds of group that a digest counts pages (or hits) of: a message, a variant, the pages of a type, the hits of a type.
MESSAGE, VARIANT, PAGES, HITS = "message", "variant", "pages", "hits"
_GROUP = ["type", "kind", "k1", "k2"]


def _counted_groups(all_hits: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One row per group of a type: how many pages it has, and its first page and hit.  Evidence stays behind.

    Every hit row enters one group of each kind, so one aggregate makes (group, page) distinct and one counts, whatever the kinds.
    """
    entry = {
        MESSAGE: f"named_struct('kind', '{MESSAGE}', 'k1', message, 'k2', '', 'who', url)",
        VARIANT: f"named_struct('kind', '{VARIANT}', 'k1', coalesce(selector, ''), 'k2', context, 'who', url)",
        PAGES: f"named_struct('kind', '{PAGES}', 'k1', '', 'k2', '', 'who', url)",
        HITS: f"named_struct('kind', '{HITS}', 'k1', '', 'k2', '', 'who', hit)",
    }
    rows = all_hits.select("type", "seq", "hit", "category", col(severity_rank("severity")).alias("rank"), col(f"explode(array({', '.join(entry[k] for k in kinds)}))").alias("g"))
    rows = rows.select("type", "seq", "hit", "category", "rank", "g.*")
    once = rows.groupBy(*_GROUP, "who").agg(F.min(F.struct("seq", "hit")).alias("first"), F.min("rank").alias("rank"), F.min("category").alias("category"))
    return once.groupBy(*_GROUP).agg(F.count("*").alias("n"), F.min(F.struct("first.seq", "who", "first.hit")).alias("first"), F.min("rank").alias("rank"), F.min("category").alias("category"))


def _most_pages(counted: DataFrame) -> DataFrame:
    """The messages and variants of each type that are on most pages, as many as a digest shows."""
    most = max(MAX_MESSAGES, MAX_VARIANTS)
    top = top_k(counted.filter(F.col("kind").isin(MESSAGE, VARIANT)), ["type", "kind"], [F.desc("n"), F.col("first.seq"), F.col("k1"), F.col("k2")], most, number="place")
    return top.filter((F.col("kind") == VARIANT) & (F.col("place") <= MAX_VARIANTS) | (F.col("kind") == MESSAGE) & (F.col("place") <= MAX_MESSAGES))


def _shown_variants(all_hits: DataFrame, top: DataFrame) -> DataFrame:
    """(type, place, v): evidence of the first hit of each variant, and its first pages.

    At most five variants of each of the types: a broadcast finds their rows, and only their first hits' rows carry evidence on.
    """
    chosen = top.filter(F.col("kind") == VARIANT).select("type", F.col("k1").alias("selector_key"), F.col("k2").alias("context"), "place", F.col("n").alias("pages"),
                                                         F.col("first.seq").alias("first_seq"), F.col("first.hit").alias("first_hit"))
    rows = all_hits.withColumn("selector_key", F.coalesce("selector", F.lit(""))).join(F.broadcast(chosen), ["type", "selector_key", "context"])
    evidence = F.when(col("seq = first_seq AND hit = first_hit"), F.struct("message", "context", "selector", "html", "actual", "expected", "pages"))
    per_page = rows.groupBy("type", "place", "url").agg(F.min("seq").alias("seq"), F.first(evidence, ignorenulls=True).alias("f"))
    first = top_k(per_page, ["type", "place"], [F.col("seq"), F.col("url")], MAX_URLS)
    shown = first.groupBy("type", "place").agg(F.first("f", ignorenulls=True).alias("f"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "url"))), lambda u: u["url"]).alias("urls"))
    cut = (f"named_struct('place', place, 'message', {limit_text('f.message', 2000)}, 'context', {limit_text('f.context', 2000)}, 'selector', {limit_text('f.selector', 2000)}, "
           f"'html', f.html, 'actual', {limit_text('f.actual', 2000)}, 'expected', f.expected, 'pages', f.pages, 'urls', urls)")
    return shown.select("type", col(cut).alias("v"))


def _digest(all_hits: DataFrame, kinds: tuple[str, ...], folder: str | None = None) -> DataFrame:
    """A row per type with whatever the kinds give: pages, hits, severity, category; messages; variants; and how many more there are.

    The counted groups are written when it is made.
    """
    counted = materialise(_counted_groups(all_hits, kinds), "digest-groups", folder)  # read three times below, a row per group
    top = _most_pages(counted)
    n_of = lambda kind, name: F.max(F.when(F.col("kind") == kind, F.col("n"))).alias(name)
    parts = counted.select("type", "kind", "n", "rank", "category")
    found = [n_of(PAGES, "pages"), n_of(HITS, "hits"), F.min("rank").alias("rank"), F.min("category").alias("category")]
    if MESSAGE in kinds:
        message = f"named_struct('place', place, 'message', {limit_text('k1', 2000)}, 'pages', n)"
        parts = parts.unionByName(top.filter(F.col("kind") == MESSAGE).select("type", col(message).alias("m")), allowMissingColumns=True)
        found += [F.count_if(F.col("kind") == MESSAGE).alias("n_messages"), F.array_sort(F.collect_list("m")).alias("m")]
    if VARIANT in kinds:
        parts = parts.unionByName(_shown_variants(all_hits, top), allowMissingColumns=True)
        found += [F.count_if(F.col("kind") == VARIANT).alias("n_variants"), F.array_sort(F.collect_list("v")).alias("v")]
    return parts.groupBy("type").agg(*found)


_MESSAGES = ("transform(m, x -> named_struct('message', x.message, 'pages', x.pages)) AS messages", f"greatest(n_messages - {MAX_MESSAGES}, 0) AS more_messages")
_VARIANTS = ("transform(v, x -> named_struct('message', x.message, 'context', x.context, 'selector', x.selector, 'html', x.html, 'actual', x.actual, 'expected', x.expected, "
             "'pages', x.pages, 'urls', x.urls)) AS variants", f"greatest(n_variants - {MAX_VARIANTS}, 0) AS more_variants")


def digest_messages(all_hits: DataFrame) -> DataFrame:
    """The three messages on most pages of each type, and how many more there are."""
    return _digest(all_hits, (MESSAGE,)).selectExpr("type", *_MESSAGES)


def digest_variants(all_hits: DataFrame) -> DataFrame:
    """The five elements or values on most pages of each type, three pages of each."""
    return _digest(all_hits, (VARIANT,)).selectExpr("type", *_VARIANTS)


def digest_findings(all_hits: DataFrame, rules: DataFrame, folder: str | None = None) -> DataFrame:
    """A digest line per issue type."""
    groups = _digest(all_hits, (MESSAGE, VARIANT, PAGES, HITS), folder).selectExpr(
        "type", "element_at(array('error', 'warning', 'info'), CAST(rank AS INT)) AS severity", "category", "pages", "hits", *_MESSAGES, *_VARIANTS)
    return (groups.join(F.broadcast(rules.select("type", "title", "why", "fix")), "type", "left")
            .select("type", "severity", "category", "pages", "hits", "title", "why", "fix", "messages", "more_messages", "variants", "more_variants"))


def page_lines(counts: DataFrame, attached: DataFrame | None = None, content: DataFrame | None = None) -> DataFrame:
    """One line per page with its counts (A11), lab scores and content name where there are some."""
    lines = counts.withColumn("final_url", col("CASE WHEN final_url <> url THEN final_url END"))
    if attached is not None:
        lab = attached.filter("lab IS NOT NULL").select("url", col("lab.scores").alias("scores"), col("nullif(lab.omitted_audits, 0)").alias("omitted_audits"),
                                                        col("nullif(size(lab.warnings), 0)").alias("lab_warnings"))
        lines = lines.join(lab, "url", "left")
    if content is not None:
        lines = lines.join(content.select("url", F.col("content_name").alias("content")), "url", "left")
    return lines


def site_wide_issues(site_members: DataFrame, pages: DataFrame) -> DataFrame:
    """Site issues that list no audited page (A12): their keys and types."""
    on_pages = site_members.join(pages.select("url"), "url", "left_semi").select("issue_key").distinct()
    return site_members.select("issue_key", "type", "severity", "message", "context").distinct().join(on_pages, "issue_key", "left_anti")


def fail_on(totals: DataFrame, level: str) -> DataFrame:
    """Whether a run fails at a severity level (A19); ``totals`` is ``summary``."""
    test = {"error": "errors > 0", "warning": "errors + warnings > 0", "info": "errors + warnings + infos > 0", "none": "false"}[level]
    return totals.select(col(test).alias("fails"))


def split_findings(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to fix, and notes."""
    return groups.filter("severity <> 'info'"), groups.filter("severity = 'info'")
