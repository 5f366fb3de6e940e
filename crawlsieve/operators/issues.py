"""The shape of an issue, and how issues of one page are put together."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.sql import col, each, each_indexed, fresh, let, lit
from ..functions.text import context as cut_context
from ..functions.text import issue_id, limit_text, unique_ids
from .markup import evidence_fields, selector
from .rules import RULES

NO_ISSUES = "array()"
ISSUE_FIELDS = ("type", "severity", "category", "source", "message", "context", "selector", "html", "parent_html", "actual",
                "actual_num", "expected")


def issue(kind: str, message: str, context: str, *, pre: str | None = None, pres: str | None = None, severity: str | None = None,
          category: str | None = None, source: str | None = None, actual: str | None = None, actual_num: str | None = None,
          expected: str | None = None, whole: bool = False) -> str:
    """SQL of one raw issue.  ``message`` and the like are SQL text; defaults come from the rule dimension."""
    rule = RULES[kind]
    values = {
        "type": lit(kind),
        "severity": severity or lit(rule["severity"]),
        "category": category or lit(rule["category"]),
        "source": source or lit(rule["source"]),
        "message": message,
        "context": context if whole else cut_context(context),
        "pre": f"CAST({pre or 'NULL'} AS INT)",
        "pres": f"CAST({pres or 'NULL'} AS ARRAY<INT>)",
        "actual": f"CAST({actual or 'NULL'} AS STRING)",
        "actual_num": f"CAST({actual_num or 'NULL'} AS DOUBLE)",
        "expected": f"CAST({expected or 'NULL'} AS STRING)",
    }
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


def when(condition: str, *issues: str) -> str:
    return f"CASE WHEN {condition} THEN array({', '.join(issues)}) ELSE {NO_ISSUES} END"


def per(array: str, body) -> str:
    """Issues of each element of an array; ``body`` gives an array of issues."""
    return f"coalesce(flatten({each(array, body)}), {NO_ISSUES})"


def merge_robots(raw: str) -> str:
    """One noindex and one nofollow issue a page: contexts of meta tag and header share the room, evidence is the tag's."""
    def merged(xs: str) -> str:
        x, i, y, z = fresh("x"), fresh("i"), fresh("y"), fresh("z")
        same = f"filter({xs}, {y} -> {y}.type = {x}.type)"
        def joined(ys: str) -> str:
            contexts = f"array_distinct(transform({ys}, {z} -> {z}.context))"
            room = lambda cs: f"CAST(floor((120 - 5 * (size({cs}) - 1)) / size({cs})) AS INT)"
            return let(contexts, lambda cs: let(room(cs), lambda r: f"array_join({each(cs, lambda c: limit_text(c, r))}, ' and ')"))
        first_pre = lambda ys: f"get(filter(transform({ys}, {z} -> {z}.pre), {z} -> {z} IS NOT NULL), 0)"
        fields = "".join(f", '{f}', {x}.{f}" for f in ("type", "severity", "category", "source", "message"))
        rebuilt = let(same, lambda ys: (f"named_struct({fields[2:]}, 'context', {joined(ys)}, 'pre', {first_pre(ys)}, 'pres', {x}.pres, "
                                        f"'actual', {x}.actual, 'actual_num', {x}.actual_num, 'expected', {x}.expected)"))
        robots = f"{x}.type IN ('noindex', 'nofollow')"
        is_first = f"NOT exists(slice({xs}, 1, {i}), {y} -> {y}.type = {x}.type)"
        marked = (f"transform({xs}, ({x}, {i}) -> CASE WHEN NOT {robots} THEN {x} WHEN {is_first} THEN {rebuilt} END)")
        return f"filter({marked}, {x} -> {x} IS NOT NULL)"
    return let(raw, lambda xs: f"CASE WHEN exists({xs}, r -> r.type IN ('noindex', 'nofollow')) THEN {merged(xs)} ELSE {xs} END")


def with_evidence(raw: str) -> str:
    """Selector and markup of the element each issue is about."""
    def complete(x: str) -> str:
        sel, html, parent = evidence_fields(f"{x}.pre")
        many = f"array_join({each(x + '.pres', selector)}, ', ')"
        own = "".join(f", '{f}', {x}.{f}" for f in ("type", "severity", "category", "source", "message", "context"))
        on = lambda v: f"CASE WHEN {x}.pre IS NOT NULL THEN {v} END"
        return (f"named_struct({own[2:]}, 'selector', CASE WHEN {x}.pre IS NOT NULL THEN {sel} WHEN {x}.pres IS NOT NULL THEN {many} END, "
                f"'html', {on(html)}, 'parent_html', {on(parent)}, 'actual', {x}.actual, 'actual_num', {x}.actual_num, "
                f"'expected', {x}.expected)")
    return each(raw, complete)


def with_ids(issues: str, where: str) -> str:
    """Adds the id, unique within the page, and the order of the issue."""
    ids = each(issues, lambda x: issue_id(where, f"{x}.type", f"coalesce({x}.selector, {x}.context)"))
    fields = lambda x: "".join(f", '{f}', {x}.{f}" for f in ISSUE_FIELDS)
    return let(unique_ids(ids), lambda u: each_indexed(issues, lambda x, i: f"named_struct('id', {u}[{i}], 'ord', {i}{fields(x)})"))


def issue_rows(audited: DataFrame) -> DataFrame:
    """``page_issues``: one row per issue of each page.

    An outer generator and a filter on its output: with an inner one Catalyst adds a filter on the size of the array
    below it, which would work out every check of the page a second time.
    """
    return audited.select("seq", "url", col("inline_outer(issues)")).filter("id IS NOT NULL")
