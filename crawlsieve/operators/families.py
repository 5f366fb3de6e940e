"""Element families of each page (one pass each) that facts and checks share.

The second projection of a page audit: it turns the node array into small typed arrays, in document order.
"""

from __future__ import annotations


from ..functions import urls
from ..functions.sql import each, first, keep, let, lit
from ..functions.text import clean, collapse_ws
from .markup import all_text, attr, bound_flag, has_attr, id_index, own_tokens, svg_titles, tagged, trimmed_attr, visible_text


def _lower(n: str, name: str) -> str:
    return f"lower(coalesce({attr(n, name)}, ''))"


def _meta(n: str) -> str:
    content = f"coalesce({attr(n, 'content')}, '')"
    return (f"named_struct('pre', {n}.pre, 'name', {_lower(n, 'name')}, 'prop', {_lower(n, 'property')}, 'written', "
            f"{attr(n, 'name')}, 'raw', {content}, 'content', {collapse_ws(content)})")


def _link(n: str) -> str:
    return (f"named_struct('pre', {n}.pre, 'rel', {own_tokens(_lower(n, 'rel'))}, 'href', {trimmed_attr(n, 'href')}, "
            f"'has_href', {has_attr(n, 'href')}, 'lang', {trimmed_attr(n, 'hreflang')}, 'has_lang', {has_attr(n, 'hreflang')}, "
            f"'in_head', {n}.near.head >= 0)")


def _heading(n: str) -> str:
    return (f"named_struct('pre', {n}.pre, 'last', {n}.last, 'level', CAST(substr({n}.tag, 2, 1) AS INT), 'nested', "
            f"nodes[{n}.parent].near.heading >= 0, 'text', {collapse_ws(visible_text(n))})")


def _anchor(n: str) -> str:
    return f"named_struct('pre', {n}.pre, 'raw', {trimmed_attr(n, 'href')}, 'rel', coalesce({attr(n, 'rel')}, ''))"


def _script(n: str) -> str:
    return (f"named_struct('pre', {n}.pre, 'type', trim({_lower(n, 'type')}), 'src', {attr(n, 'src')}, "
            f"'body', {all_text(n)})")


def stages() -> list[dict[str, str]]:
    """Columns by stage: a stage may use the columns of the ones before it.  Pages without HTML keep them NULL."""
    base = keep("nodes", lambda n: f"{n}.tag = 'base' AND {has_attr(n, 'href')}")
    resolved_base = f"coalesce({urls.absolute_url('base_href', 'final_url')}, final_url)"
    anchors = keep("nodes", lambda n: f"{n}.tag = 'a' AND {has_attr(n, 'href')}")
    return [
        {
            "bound": bound_flag(),
            "metas": each(tagged("meta"), _meta),
            "head_links": each(tagged("link"), _link),
            "headings": each(tagged("h1", "h2", "h3", "h4", "h5", "h6"), _heading),
            "anchors": each(anchors, _anchor),
            "imgs": tagged("img"),
            "scripts": each(tagged("script"), _script),
            "title_node": first(keep("nodes", lambda n: f"{n}.tag = 'title' AND {n}.near.svg < 0")),
            "html_node": "nodes[0]",
            "body_node": first(tagged("body")),
            "svg_title": svg_titles(),
            "id_pre": id_index(),
            "base_href": let(first(base), lambda b: trimmed_attr(b, "href")),
        },
        {"base_url": f"CASE WHEN nodes IS NOT NULL THEN CASE WHEN coalesce(base_href, '') = '' THEN final_url ELSE {resolved_base} END END"},
        {
            "base_parts": urls.parts("base_url"),
            "here": urls.site_host("final_url"),
            "title_text": f"CASE WHEN title_node IS NOT NULL THEN {collapse_ws(all_text('title_node'))} END",
            "canonicals": keep("head_links", lambda l: f"array_contains({l}.rel, 'canonical') AND {l}.in_head"),
            "alternates": keep("head_links", lambda l: f"array_contains({l}.rel, 'alternate') AND {l}.in_head AND {l}.has_lang"),
        },
    ]


def resolve(href: str) -> str:
    """Absolute form of an address on the page."""
    return urls.absolute_from_parts(href, "base_parts")


def meta_content(test, max_chars: int = 120) -> str:
    """First non-empty content of the meta tags that pass ``test``."""
    values = each(keep("metas", test), lambda m: clean(f"{m}.content", max_chars))
    return first(keep(values, lambda v: f"{v} IS NOT NULL"))


def named(name: str):
    return lambda m: f"{m}.name = {lit(name)}"


def og(name: str):
    return lambda m: f"{m}.prop = {lit('og:' + name)} OR {m}.name = {lit('og:' + name)}"


def twitter(name: str):
    return lambda m: f"{m}.name = {lit('twitter:' + name)} OR {m}.prop = {lit('twitter:' + name)}"


def prop_or_name(value: str):
    return lambda m: f"{m}.prop = {lit(value)} OR {m}.name = {lit(value)}"

