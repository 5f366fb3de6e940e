"""Facts of each page (F1-F17): projections over the element families, no shuffle."""

from __future__ import annotations

from ..functions import urls
from ..functions.sql import each, each_indexed, first, flat, keep, let, lit
from ..functions.text import MAX_URL, clean, collapse_ws, limit_text, words_of
from .families import meta_content, named, og, prop_or_name, resolve, twitter
from .markup import attr, has_attr, is_bound, prose, subtree, tagged, trimmed_attr, visible_text

MAX_MAIN_TEXT, MAX_EXCERPT, MAX_IMAGE_TEXT, MAX_SIDE = 1500, 200, 150, 75
MAX_HEADINGS, MAX_LINK_SAMPLES, MAX_IMAGES = 40, 25, 20


def _prose_texts(n: str, chrome: bool) -> str:
    """Visible text nodes in an area; ``chrome`` also leaves out navigation, header, footer and aside."""
    skip = f" AND x.near.chrome < 0" if chrome else ""
    return f"filter({subtree(n)}, x -> x.tag = '#text' AND x.near.raw < 0 AND x.near.svg < 0{skip})"


def _area(test, gap: str = "gap") -> str:
    root = first(keep("nodes", test))
    return let(root, lambda r: f"CASE WHEN {r} IS NOT NULL THEN nullif({prose(_prose_texts(r, False), gap)}, '') END")


def _main() -> str:
    """STRUCT<area, text>: main, else article, else body without page chrome; an area without text is passed over."""
    main = _area(lambda n: f"{n}.tag = 'main' OR ({n}.tag <> '#text' AND lower({attr(n, 'role')}) = 'main')")
    article = _area(lambda n: f"{n}.tag = 'article'")
    body = f"nullif({prose(_prose_texts('body_node', True), 'body_gap')}, '')"

    def chosen(area: str, text: str, otherwise: str | None) -> str:
        pair = lambda t: f"named_struct('area', {lit(area)}, 'text', {t})"
        if otherwise is None:
            return let(text, pair)
        return let(text, lambda t: f"CASE WHEN {t} IS NOT NULL THEN {pair(t)} ELSE {otherwise} END")

    areas = chosen("main", main, chosen("article", article, chosen("body", body, None)))
    return f"CASE WHEN nodes IS NOT NULL THEN {areas} END"


def _excerpt(h: str, i: str) -> str:
    """The words under a heading, up to the next heading; a heading inside a heading has none of its own."""
    def between(nxt: str) -> str:
        texts = (f"filter(slice(nodes, {h}.last + 2, coalesce({nxt}.pre, size(nodes)) - {h}.last - 1), "
                 f"x -> x.tag = '#text' AND x.near.raw < 0 AND x.near.svg < 0 AND x.near.body >= 0)")
        return clean(prose(texts), MAX_EXCERPT)
    nxt = f"get(tops, array_position(transform(tops, t -> t.pre), {h}.pre))"
    return f"CASE WHEN {h}.nested OR nodes[{h}.pre].near.svg >= 0 OR nodes[{h}.pre].near.body < 0 THEN NULL ELSE {let(nxt, between)} END"


def _heading_facts() -> str:
    body = each_indexed(f"slice(headings, 1, {MAX_HEADINGS})", lambda h, i: (
        f"named_struct('level', {h}.level, 'text', coalesce({clean(h + '.text')}, ''), 'excerpt', {_excerpt(h, i)})"))
    tops = keep("headings", lambda h: f"NOT {h}.nested AND nodes[{h}.pre].near.svg < 0")
    # Only the headings up to one past the shown ones can end an excerpt.
    return f"transform(array(slice({tops}, 1, {MAX_HEADINGS + 1})), tops -> {body})[0]"


def _links() -> str:
    def image_alt(n: str) -> str:
        img = first(keep(subtree(n), lambda x: f"{x}.tag = 'img' AND {has_attr(x, 'alt')}"))
        return let(img, lambda i: clean(attr(i, "alt")))
    def fact(a: str) -> str:
        n = f"nodes[{a}.pre]"
        return (f"named_struct('href', {a}.href, 'text', coalesce({clean(let(n, visible_text))}, {let(n, image_alt)}, ''), "
                f"'internal', {urls.site_host(a + '.href')} = here, 'nofollow', {a}.rel RLIKE r'(?i)\\bnofollow\\b')")
    hrefs = each("anchors", lambda a: f"named_struct('pre', {a}.pre, 'raw', {a}.raw, 'rel', {a}.rel, 'href', {resolve(a + '.raw')})")
    kept = keep(hrefs, lambda a: f"{a}.href RLIKE '^https?:' AND NOT startswith({a}.raw, '#')")
    return each(kept, fact)


def _side(i: str, before: bool) -> str:
    """Up to 75 characters on one side of an image, within the surrounding block, cut at a word."""
    block = f"greatest(nodes[{i}.parent].near.block, 0)"
    span = (f"slice(nodes, {block} + 2, {i}.pre - {block} - 1)" if before
            else f"slice(nodes, {i}.last + 2, nodes[{block}].last - {i}.last)")
    texts = f"filter({span}, x -> x.tag = '#text' AND x.near.raw < 0 AND x.near.svg < 0)"
    text = prose(texts)
    if before:
        return let(text, lambda t: f"CASE WHEN char_length({t}) <= {MAX_SIDE} THEN {t} ELSE regexp_replace(right({t}, {MAX_SIDE}), r'^\\S*\\s', '') END")
    return let(text, lambda t: f"CASE WHEN char_length({t}) <= {MAX_SIDE} THEN {t} ELSE regexp_replace(left({t}, {MAX_SIDE}), r'\\s\\S*$', '') END")


def _image_fact(i: str) -> str:
    figure = f"nodes[{i}.near.figure]"
    caption = first(keep(subtree(figure), lambda x: f"{x}.tag = 'figcaption'"))
    caption_text = f"CASE WHEN {i}.near.figure >= 0 THEN nullif({let(caption, lambda c: collapse_ws(visible_text(c)))}, '') END"
    around = collapse_ws(f"concat({_side(i, True)}, ' ', {_side(i, False)})")
    src = let(trimmed_attr(i, "src"), lambda s: f"CASE WHEN {s} = '' THEN NULL WHEN {s} RLIKE '(?i)^data:' THEN {limit_text(s, 60)} "
                                               f"ELSE {limit_text('coalesce(' + resolve(s) + ', ' + s + ')', MAX_URL)} END")
    alt = f"CASE WHEN {has_attr(i, 'alt')} THEN {limit_text(collapse_ws(attr(i, 'alt')), 120)} END"
    return f"named_struct('src', {src}, 'alt', {alt}, 'context', nullif({limit_text(f'coalesce({caption_text}, {around})', MAX_IMAGE_TEXT)}, ''))"


def _robots() -> str:
    tags = keep("metas", lambda m: f"{m}.name IN ('robots', 'googlebot')")
    rules = flat(tags, lambda m: f"split(lower({m}.raw), ',')")
    parts = keep(each(rules, collapse_ws), lambda r: f"{r} <> ''")
    return clean(f"array_join(array_distinct({parts}), ', ')", MAX_URL)


def _canonical() -> str:
    href = first(keep("canonicals", lambda c: f"{c}.href <> ''"))
    return let(href, lambda c: f"CASE WHEN {c} IS NOT NULL THEN {resolve(c + '.href')} END")


def stages() -> list[dict[str, str]]:
    """One column per fact.  Values stay whole; ``report_facts`` caps them at the sink."""
    word_text = visible_text("body_node")
    facts = {
        "title": "nullif(title_text, '')",
        "description": first(keep(each(keep("metas", named("description")), lambda m: f"{m}.content"), lambda v: f"{v} <> ''")),
        "h1s": f"array_distinct(transform(filter(headings, h -> h.level = 1 AND h.text <> ''), h -> h.text))",
        "canonical": _canonical(),
        "lang": clean(attr("html_node", "lang")),
        "viewport": meta_content(named("viewport")),
        "robots": _robots(),
        "robots_header_fact": clean("robots_header", MAX_URL),
        "nosnippet_elements": f"size({keep(tagged('span', 'div', 'section'), lambda n: has_attr(n, 'data-nosnippet'))})",
        "heading_outline": _heading_facts(),
        "word_count": f"CASE WHEN nodes IS NULL THEN NULL ELSE size({words_of(word_text)}) END",
        "main": _main(),
        "page_links": _links(),
        "image_counts": (f"CASE WHEN nodes IS NULL THEN NULL ELSE named_struct('total', size(imgs), 'missing_alt', "
                         f"size({keep('imgs', lambda i: 'NOT ' + has_attr(i, 'alt') + ' AND NOT ' + is_bound(i, 'alt'))})) END"),
        "image_samples": each(f"slice(imgs, 1, {MAX_IMAGES})", _image_fact),
        "open_graph": (f"CASE WHEN nodes IS NULL THEN NULL ELSE named_struct('title', {meta_content(og('title'))}, 'description', "
                       f"{meta_content(og('description'))}, 'image', {meta_content(og('image'), MAX_URL)}, 'type', "
                       f"{meta_content(og('type'))}, 'url', {meta_content(og('url'), MAX_URL)}) END"),
        "twitter_card": meta_content(twitter("card")),
        "meta_author": meta_content(named("author")),
        "meta_published": meta_content(prop_or_name("article:published_time"), 60),
        "meta_modified": f"coalesce({meta_content(prop_or_name('article:modified_time'), 60)}, {meta_content(prop_or_name('og:updated_time'), 60)})",
        "last_modified": clean("headers['last-modified']", 60),
        "hreflang": each("alternates", lambda l: f"named_struct('lang', {l}.lang, 'href', coalesce({resolve(l + '.href')}, {l}.href))"),
    }
    counted = lambda test: f"size(filter(page_links, l -> {test}))"
    derived = {
        "main_area": "main.area",
        "main_text": limit_text("main.text", MAX_MAIN_TEXT),
        "link_counts": f"CASE WHEN page_links IS NOT NULL THEN named_struct('internal', {counted('l.internal')}, 'external', "
                       f"{counted('NOT l.internal')}, 'nofollow', {counted('l.nofollow')}) END",
        "link_samples": f"transform(slice(page_links, 1, {MAX_LINK_SAMPLES}), l -> named_struct('href', {limit_text('l.href', MAX_URL)}, "
                        "'text', l.text, 'internal', l.internal, 'nofollow', l.nofollow))",
        "internal_targets": f"array_distinct(transform(filter(page_links, l -> l.internal), l -> {urls.without_fragment('l.href')}))",
    }
    return [facts, derived]
