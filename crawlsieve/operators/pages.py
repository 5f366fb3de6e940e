"""Page audit: crawl records in, facts and issues of each page out, without a shuffle.

Columns are built in stages.  ``page_columns`` works out which columns of each stage the wanted ones need, so a
job that asks for titles plans and computes titles only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..functions.sql import bound, bound_parser, col
from ..sources.crawl import html_pages
from . import checks, facts, families, issues, jsonld, markup, platform, products
from .codes import hreflang_codes
from .nodes import extract_nodes

_NAME = re.compile(r"[a-z_][a-z0-9_]*")
# Checks in the order their issues are listed.
CHECKS = {
    "response": checks.response, "images": checks.images, "form_labels": checks.form_labels, "duplicate_ids": checks.duplicate_ids,
    "main_landmark": checks.main_landmark, "links": checks.links, "title": checks.title, "description": checks.description,
    "canonical": checks.canonical, "escaped_text": checks.escaped_text, "headings": checks.headings, "robots_meta": checks.robots_meta,
    "viewport_and_lang": checks.viewport_and_lang, "snippets": checks.snippets, "social": checks.social,
    "structured_data": jsonld.structured_data, "products": products.checks, "hreflang": checks.hreflang, "address": checks.address,
    "html_size": checks.html_size, "mixed_content": checks.mixed_content, "client_side": checks.client_side,
}
FACTS = (
    "title", "description", "h1s", "canonical", "lang", "viewport", "robots", "robots_header_fact", "nosnippet_elements",
    "heading_outline", "word_count", "main_area", "main_text", "link_counts", "link_samples", "image_counts", "image_samples", "open_graph",
    "twitter_card", "hreflang", "jsonld_types", "authorship", "page_dates", "author", "products", "platform",
)
#: The checks in groups that are planned apart: planning all at once takes a driver more than 500 MB.  Checks that add to one issue (noindex, nofollow) are together.
CHECK_GROUPS = (
    ("response", "main_landmark", "title", "description", "robots_meta", "viewport_and_lang", "social", "html_size"),
    ("canonical", "escaped_text", "snippets"), ("images", "duplicate_ids"), ("form_labels", "client_side"), ("links",),
    ("headings", "mixed_content", "address"), ("structured_data",), ("products",), ("hreflang",),
)
RESPONSE = ("seq", "url", "final_url", "status", "redirects", "content_type", "truncated", "robots_header", "headers", "body_bytes", "error")


def _stages(df: DataFrame, wanted_checks, own_checks=()) -> list[dict[str, str]]:
    stages = [
        *families.stages(), *markup.label_stages(), *facts.stages(), *jsonld.block_stages(), *jsonld.authorship_stages(), *products.stages(), *platform.stages(),
        *jsonld.check_stages(), *checks.hreflang_stages(), *checks.image_stages(),
    ]
    if wanted_checks or own_checks:
        stages += issue_stages(df, wanted_checks, own_checks)
    return stages


def _once_read(sql: str) -> str:
    """An expression that takes ``html`` from the row once: each use of a binary column copies all its bytes."""
    return _bound(sql, ["html"])


def _bound(sql: str, names) -> str:
    """An expression that takes the columns ``names`` from the row once.

    Spark puts a column that is used once in place of its name, also inside a lambda, where it would be worked out for each element.
    """
    for name in names[1:]:
        sql = bound(name, name, sql)
    return f"transform(array({names[0]}), {names[0]} -> {sql})[0]" if names else sql


def _bind_stages(plan: list[dict[str, str]]) -> list[dict[str, str]]:
    """Stages whose lambdas read the worked-out columns of earlier stages from outside of them."""
    worked_out, stages = set(), []
    for stage in plan:
        stages.append({name: _bound(sql, sorted(worked_out & set(_NAME.findall(sql)))) if "->" in sql else sql for name, sql in stage.items()})
        worked_out |= {name for name, sql in stage.items() if "->" in sql}
    return stages


def issue_stages(df: DataFrame, names, own_checks=()) -> list[dict[str, str]]:
    """Raw issues of each check, then those of the user's own, then merged, then with evidence and ids."""
    raw = {}
    for name in CHECKS:
        if name in names:
            sql = CHECKS[name](hreflang_codes(df.sparkSession)) if name == "hreflang" else CHECKS[name]()
            # The response is checked on every record, markup only where there is some.
            raw[f"raw_{name}"] = sql if name == "response" else _once_read(f"CASE WHEN nodes IS NULL THEN array() ELSE {sql} END")
    for i, check in enumerate(own_checks):
        raw[f"raw_own_{i}"] = _once_read(f"CASE WHEN nodes IS NULL THEN array() ELSE {check()} END")
    merged = f"concat({', '.join(raw)})" if len(raw) > 1 else next(iter(raw))
    return [raw, {"issues_raw": issues.merge_robots(merged)}, {"issues_found": _once_read(issues.with_evidence("issues_raw"))},
            {"issues": issues.with_ids("issues_found", "url")}]


def parsed(crawl: DataFrame) -> DataFrame:
    """Crawl records with the nodes of their markup, for callers that write them once and work out ``columns_of`` in several jobs."""
    return extract_nodes(html_pages(crawl))


def page_columns(crawl: DataFrame, *wanted: str, only_checks=None, keep=("seq", "url", "final_url", "status"), extra_checks=()) -> DataFrame:
    """The wanted page columns: facts, ``issues``, ``internal_targets`` or any intermediate one.

    ``only_checks`` names the checks ``issues`` is made of; all by default.  ``extra_checks`` are functions that give the
    SQL of an array of raw issues (``operators.issues.issue``) over the page's columns, as the built-in checks do.
    """
    return columns_of(parsed(crawl), *wanted, only_checks=only_checks, keep=keep, extra_checks=extra_checks)


def columns_of(tree: DataFrame, *wanted: str, only_checks=None, keep=("seq", "url", "final_url", "status"), extra_checks=()) -> DataFrame:
    """``page_columns`` of records that are parsed already."""
    bound_parser(tree.sparkSession)
    chosen = tuple(only_checks or CHECKS) if "issues" in wanted else ()
    needed = set(wanted)
    plan: list[dict[str, str]] = []
    for stage in reversed(_stages(tree, chosen, tuple(extra_checks) if "issues" in wanted else ())):
        used = {name: sql for name, sql in stage.items() if name in needed}
        for sql in used.values():
            needed.update(_NAME.findall(sql))
        plan.insert(0, used)
    df = tree
    for stage in _bind_stages(plan):
        if stage:
            df = df.withColumns({name: col(sql) for name, sql in stage.items()})
    return df.select(*[c for c in keep if c not in wanted], *wanted)


def page_audit(crawl: DataFrame, extra_checks=()) -> DataFrame:
    """Everything the cross-page checks and the report read, one row per crawl record.

    ``extra_checks`` as in ``page_columns``.
    """
    return page_columns(crawl, *FACTS, "internal_targets", "issues", keep=RESPONSE, extra_checks=extra_checks)


def page_issues(crawl: DataFrame, *only_checks: str) -> DataFrame:
    """One row per page issue."""
    return issues.issue_rows(page_columns(crawl, "issues", only_checks=only_checks or None))
