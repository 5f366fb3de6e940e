"""Structured data of each page (F18-F24, C21-C24): JSON-LD scripts as VARIANT, walked with bounded nesting."""

from __future__ import annotations

from ..functions.sql import any_of, each, each_indexed, first, flat, in_list, keep, let, lit, looked_up, sorted_index
from ..functions.text import MAX_URL, trim_ws
from ..functions.variant import as_array, as_list, as_map, as_string, key, text, text_value
from .issues import NO_ISSUES, issue, per, when
from .rules import SOURCES

MAX_DEPTH = 4  # Fixed value: how deep arrays, @graph and nested properties are followed.
URL_PROPERTIES = ("url", "image", "logo", "sameAs", "contentUrl", "item")
NO_RICH_RESULT = ("HowTo", "FAQPage", "SpecialAnnouncement", "CourseInfo", "EstimatedSalary", "LearningVideo", "ClaimReview", "VehicleListing")


def objects_in(v: str) -> str:
    """Every object of a value, looking into lists and @graph, in order; one step opens one level of nesting."""
    items = f"array(named_struct('v', {v}, 'done', false))"
    def opened(i: str) -> str:
        graph = f"try_variant_get({i}.v, '$[\"@graph\"]', 'variant')"
        fresh_items = lambda xs: each(xs, lambda x: f"named_struct('v', {x}, 'done', false)")
        below = f"CASE WHEN {graph} IS NULL THEN array() ELSE array(named_struct('v', {graph}, 'done', false)) END"
        return (f"CASE WHEN {i}.done THEN array({i}) WHEN {as_array(i + '.v')} IS NOT NULL THEN {fresh_items(as_array(i + '.v'))} "
                f"WHEN {as_map(i + '.v')} IS NOT NULL THEN concat(array(named_struct('v', {i}.v, 'done', true)), {below}) ELSE array() END")
    for _ in range(MAX_DEPTH + 1):
        items = flat(items, opened)
    return each(keep(items, lambda i: f"{i}.done"), lambda i: as_map(f"{i}.v"))


def types_of(m: str) -> str:
    return keep(each(as_list(key(m, "@type")), as_string), lambda t: f"{t} IS NOT NULL")


def block_stages() -> list[dict[str, str]]:
    """``ld_blocks`` (each script, parsed or not) and ``ld_objects`` (every object in order)."""
    scripts = keep("scripts", lambda s: f"{s}.type = 'application/ld+json'")
    blocks = each(scripts, lambda s: f"named_struct('pre', {s}.pre, 'text', {s}.body, 'value', try_parse_json({s}.body))")
    record = lambda m, b: f"named_struct('block', {b}, 'm', {m}, 'id', {as_string(key(m, '@id'))}, 'types', {types_of(m)})"
    nested = each_indexed("ld_blocks", lambda b, i: (
        f"CASE WHEN {b}.value IS NULL THEN array() ELSE {each(objects_in(b + '.value'), lambda m: record(m, i))} END"))
    numbered = each_indexed("flatten(ld_nested)", lambda o, i: (
        f"named_struct('ord', {i}, 'block', {o}.block, 'm', {o}.m, 'id', {o}.id, 'types', {o}.types)"))
    starts = "transform(sequence(0, greatest(size(ld_nested), 1) - 1), i -> aggregate(slice(ld_nested, 1, i), 0, (n, os) -> n + size(os)))"
    ids = sorted_index("transform(filter(ld_objects, o -> o.id IS NOT NULL), o -> struct(o.id AS k, o.ord AS v))")
    return [{"ld_blocks": blocks}, {"ld_nested": nested}, {"ld_objects": numbered, "ld_starts": starts}, {"ld_ids": ids}]


def by_id(ref: str) -> str:
    """The object an @id refers to; the last one with that id."""
    return let(looked_up("ld_ids", ref), lambda o: f"CASE WHEN {o} IS NOT NULL THEN ld_objects[{o}] END")


def name_of(item: str) -> str:
    """The name behind a value: plain, in an object, or one reference away."""
    def obj(m: str) -> str:
        return (f"CASE WHEN {m} IS NULL THEN {text(as_text(item))} ELSE coalesce({text_value(key(m, 'name'))}, "
                f"{let(by_id(as_string(key(m, '@id'))), lambda o: text_value(key(o + '.m', 'name')))}) END")
    as_text = lambda i: f"CASE WHEN {as_string(i)} IS NOT NULL THEN {i} END"
    return let(as_map(item), obj)


def names_of(value: str) -> str:
    found = keep(each(as_list(value), name_of), lambda n: f"{n} IS NOT NULL")
    return f"array_distinct({found})"


def authorship_stages() -> list[dict[str, str]]:
    """``authorship``, ``jsonld_types``, ``page_dates`` and ``author``."""
    def node(o: str) -> str:
        m = f"{o}.m"
        same_as = keep(each(as_list(key(m, "sameAs")), lambda u: text(u, MAX_URL)), lambda u: f"{u} IS NOT NULL")
        return (f"named_struct('types', {o}.types, 'name', coalesce({text_value(key(m, 'headline'))}, {text_value(key(m, 'name'))}), "
                f"'authors', slice({names_of(key(m, 'author'))}, 1, 5), 'publisher', {first(names_of(key(m, 'publisher')))}, "
                f"'date_published', {text_value(key(m, 'datePublished'), 60)}, 'date_modified', {text_value(key(m, 'dateModified'), 60)}, "
                f"'same_as', slice({same_as}, 1, 5))")
    date = lambda f: first(keep(f"transform(authorship_all, n -> n.{f})", lambda d: f"{d} IS NOT NULL"))
    return [
        {"authorship_all": each(keep("ld_objects", lambda o: f"size({o}.types) > 0"), node)},
        {
            "authorship": "slice(authorship_all, 1, 10)",
            "jsonld_types": "slice(array_distinct(flatten(transform(ld_objects, o -> o.types))), 1, 20)",
            "page_dates": f"CASE WHEN nodes IS NOT NULL THEN named_struct('published', coalesce({date('date_published')}, meta_published), "
                          f"'modified', coalesce({date('date_modified')}, meta_modified), 'last_modified', last_modified) END",
            "author": "coalesce(meta_author, array_join(get(filter(transform(authorship_all, n -> n.authors), a -> size(a) > 0), 0), ', '))",
        },
    ]


# --- checks ---------------------------------------------------------------------------------------------------------

def _relative_urls(v: str) -> str:
    """Relative addresses a URL property holds: a text, a list, or an object with a url."""
    # A text stays as it is; lists and objects give way to what they hold.
    step = lambda x: f"CASE WHEN {as_string(x)} IS NOT NULL THEN array({x}) ELSE coalesce({as_array(x)}, array(try_variant_get({x}, '$.url', 'variant'))) END"
    items = f"array({v})"
    for _ in range(MAX_DEPTH):
        items = flat(items, step)
    texts = each(keep(items, lambda x: f"{x} IS NOT NULL"), as_string)
    return keep(texts, lambda t: f"{t} IS NOT NULL AND {trim_ws(t)} <> '' AND NOT {trim_ws(t)} RLIKE r'^([A-Za-z][A-Za-z0-9+.-]*:|//)'")


def _nested_properties(m: str) -> str:
    """All properties of a node at any nesting as (k, v); one step looks into the objects and lists of one level."""
    entries = lambda mm, also: (f"transform(filter(map_entries({mm}), e -> e.key <> '@graph'{also}), e -> named_struct('k', e.key, 'v', e.value))")
    def inside(p: str) -> str:
        # The url of an object held by a URL property was read with that property.
        url_read = f" AND NOT (e.key = 'url' AND {in_list(p + '.k', URL_PROPERTIES)})"
        of_item = lambda x: f"coalesce({entries(as_map(x), url_read)}, array())"
        return flat(f"concat(array({p}.v), coalesce({as_array(p + '.v')}, array()))", of_item)
    def walk(current: str, depth: int) -> str:
        rest = walk(flat("LEVEL", inside), depth + 1) if depth < MAX_DEPTH else None
        return let(current, lambda ps: ps if rest is None else f"concat({ps}, {rest.replace('LEVEL', ps)})")
    return walk(entries(m, ""), 0)


def check_stages() -> list[dict[str, str]]:
    """``ld_props``: the properties of each typed object; ``ld_relative``: relative addresses among them."""
    # One entry for each object, so an object finds its own by number; untyped ones have none.
    props = each("ld_objects", lambda o: f"named_struct('ord', {o}.ord, 'props', filter(CASE WHEN size({o}.types) > 0 THEN {_nested_properties(o + '.m')} END, p -> {in_list('p.k', URL_PROPERTIES)}))")
    pair = lambda p, u: f"named_struct('k', {p}.k, 'u', {u})"
    found = lambda o: flat(f"coalesce({o}.props, array())", lambda p: each(_relative_urls(f"{p}.v"), lambda u: pair(p, u)))
    relative = each("ld_props", lambda o: f"named_struct('ord', {o}.ord, 'found', {found(o)})")
    # Objects at the top of each block that lack a @context while something typed is in or under them.
    def lacks(m: str) -> str:
        under = let(f"coalesce({m}['@graph'], parse_json('[]'))", objects_in)
        def judge(gs: str) -> str:
            typed_in = f"filter({gs}, g -> size({types_of('g')}) > 0)"
            return let(typed_in, lambda ts: f"(size({types_of(m)}) > 0 OR size({ts}) > 0) AND NOT exists({ts}, g -> {_has('g', '@context')})")
        return f"NOT {_has(m, '@context')} AND {let(under, judge)}"
    top = lambda b: f"filter({each(as_list(b + '.value'), as_map)}, m -> m IS NOT NULL)"
    context = each("ld_blocks", lambda b: f"coalesce({any_of(top(b), lacks)}, false)")
    return [{"ld_props": props, "ld_lacks_context": context}, {"ld_relative": relative}]


def _has(m: str, name: str) -> str:
    v = key(m, name)
    return f"coalesce({v} IS NOT NULL AND NOT is_variant_null({v}) AND coalesce({as_string(v)}, 'x') <> '', false)"


def structured_data() -> str:
    def node(o: str) -> str:
        m = f"{o}.m"
        retired = per(f"filter({o}.types, t -> {in_list('t', NO_RICH_RESULT)})", lambda t: (
            "array(" + issue("unsupported-schema-type", f"concat({t}, ' markup has no rich result')", f"concat('\"@type\": \"', {t}, '\"')") + ")"))
        urls_found = f"get(ld_relative, {o}.ord).found"
        relative = per(urls_found, lambda p: "array(" + issue(
            "json-ld-relative-url", f"concat('The ', {p}.k, ' in ', array_join({o}.types, ', '), ' markup is not a full address')",
            f"concat('\"', {p}.k, '\": \"', {p}.u, '\"')") + ")")
        product = f"array_contains({o}.types, 'Product')"
        crumbs = f"array_contains({o}.types, 'BreadcrumbList')"
        offer = " OR ".join(_has(m, k) for k in ("offers", "review", "aggregateRating"))
        absent = (f"filter(array(CASE WHEN {product} AND NOT {_has(m, 'name')} THEN 'name' END, CASE WHEN {product} AND NOT ({offer}) THEN "
                  f"'one of offers, review or aggregateRating' END, CASE WHEN {crumbs} AND NOT {_has(m, 'itemListElement')} THEN 'itemListElement' END), a -> a IS NOT NULL)")
        first_type = f"get(filter({o}.types, t -> t IN ('Product', 'BreadcrumbList')), 0)"
        missing = let(absent, lambda a: when(f"size({a}) > 0", issue(
            "missing-schema-property", f"concat('Required property missing, ', {first_type}, ': ', array_join({a}, ', '))",
            f"concat('\"@type\": \"', array_join({o}.types, ', '), '\"')",
            source=f"CASE WHEN {product} THEN {lit(SOURCES['productSnippet'])} ELSE {lit(SOURCES['breadcrumb'])} END")))
        return f"concat({retired}, {relative}, {missing})"
    def block(b: str, i: str) -> str:
        typed = f"filter(slice(ld_objects, ld_starts[{i}] + 1, size(ld_nested[{i}])), o -> size(o.types) > 0)"
        context = when(f"ld_lacks_context[{i}]", issue("json-ld-missing-context", lit("Structured data has no @context"), f"trim({b}.text)"))
        broken = issue("invalid-json-ld", lit("Structured data is not valid JSON"), f"trim({b}.text)")
        return f"CASE WHEN {b}.value IS NULL THEN array({broken}) ELSE concat({context}, {per(typed, node)}) END"
    return f"coalesce(flatten({each_indexed('ld_blocks', block)}), {NO_ISSUES})"
