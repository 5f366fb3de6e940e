"""Expressions over the node array of a page: subtrees, text, names and evidence.

A node argument ``n`` is the SQL text of a node struct; ``nodes`` and ``html`` are columns of the row.
"""

from __future__ import annotations

from ..functions.sql import any_of, count_keys, each, each_indexed, first, flat, fresh, is_key, keep, let, lit, looked_up, sorted_index, sorted_keys
from ..functions.text import SPACES, collapse_ws, limit_text, plain_letters, trim_ws

FRAME = "('html', 'head', 'body')"


def attr(n: str, name: str) -> str:
    return f"{n}.attrs[{lit(name)}]"


def trimmed_attr(n: str, name: str) -> str:
    return trim_ws(f"coalesce({attr(n, name)}, '')")


def has_attr(n: str, name: str) -> str:
    return f"coalesce(map_contains_key({n}.attrs, {lit(name)}), false)"


def subtree(n: str) -> str:
    return f"slice(nodes, {n}.pre + 2, {n}.last - {n}.pre)"


def tagged(*tags: str) -> str:
    names = ", ".join(lit(t) for t in tags)
    return keep("nodes", lambda n: f"{n}.tag IN ({names})")


def all_text(n: str) -> str:
    texts = keep(subtree(n), lambda x: f"{x}.tag = '#text'")
    return f"array_join({each(texts, lambda x: f'{x}.data')}, '')"


def visible_text(n: str) -> str:
    """Text a visitor reads, with nothing between elements; script, style and noscript content is left out."""
    texts = keep(subtree(n), lambda x: f"{x}.tag = '#text' AND {x}.near.raw < 0")
    return f"array_join({each(texts, lambda x: f'{x}.data')}, '')"


def prose(texts: str, gap: str = "gap") -> str:
    """Text nodes in order with a space wherever an element starts or ends between two of them."""
    def spaced(ts: str) -> str:
        t, i = fresh("t"), fresh("i")
        return (f"array_join(transform({ts}, ({t}, {i}) -> CASE WHEN {i} > 0 AND {ts}[{i} - 1].{gap} < {t}.{gap} "
                f"THEN concat(' ', {t}.data) ELSE {t}.data END), '')")
    return collapse_ws(let(texts, spaced))


def own_tokens(value: str) -> str:
    """The words of an attribute such as rel, class or aria-labelledby."""
    t = fresh("t")
    return f"filter(split(coalesce({value}, ''), {SPACES}), {t} -> {t} <> '')"


# Attributes with which scripting frameworks set the text of an element.
BOUND_TEXT = (
    "'v-text', 'v-html', 'x-text', 'x-html', 'ng-bind', 'ng-bind-html', '[textcontent]', '[innertext]', '[innerhtml]', "
    "'data-ng-bind', 'data-ng-bind-html'"
)
BOUND_ANY = r"^(:|v-|x-|ng-|data-ng-|\[)"


def is_bound(n: str, name: str) -> str:
    """An attribute whose value a client-side framework fills in (F32)."""
    short = rf"|^(data-)?ng-{name}$" if name in ("src", "srcset", "href") else ""
    pattern = rf"^(:|v-bind:|x-bind:){name}(\..*)?$|^\[(attr\.)?{name}\]$|^(data-)?ng-attr-{name}${short}"
    return f"(bound AND {any_of(f'map_keys({n}.attrs)', lambda k: f'{k} RLIKE r{chr(39)}{pattern}{chr(39)}')})"


def has_bound_text(n: str) -> str:
    return f"(bound AND {any_of(f'map_keys({n}.attrs)', lambda k: f'{k} IN ({BOUND_TEXT})')})"


def bound_flag() -> str:
    return any_of("nodes", lambda n: f"{n}.tag <> '#text' AND exists(map_keys({n}.attrs), k -> k RLIKE r'{BOUND_ANY}')")


def svg_titles() -> str:
    """Index of the title text of each outermost svg that has one, by node number."""
    svgs = keep("nodes", lambda n: f"{n}.tag = 'svg' AND {n}.near.svg = {n}.pre")
    title = lambda s: first(keep(subtree(s), lambda t: f"{t}.tag = 'title' AND {t}.parent = {s}.pre"))
    pairs = each(svgs, lambda s: f"struct({s}.pre AS k, coalesce({let(title(s), all_text)}, '') AS v)")
    return sorted_index(keep(pairs, lambda p: p + ".v <> " + lit("")))


def id_index() -> str:
    """Index of the node number of the first element with each id."""
    firsts = keep("nodes", lambda n: f"{n}.id_nth = 1")
    return sorted_index(each(firsts, lambda n: "struct(" + attr(n, "id") + f" AS k, {n}.pre AS v)"))


#: Characters of a label's name that issues show.
SHOWN_NAME = 300


def label_stages() -> list[dict[str, str]]:
    """The elements that some aria-labelledby points at, each read once however many point at it.

    ``label_targets`` are their node numbers, ``label_names`` their names, ``label_facts`` what checks ask of them: whether they are named, whether
    a script names them, the start of the name, and the name as generic wording compares it (if that is short).  Large names are never passed on by element.
    """
    pointing = keep("nodes", lambda n: f"{n}.tag <> '#text' AND {has_attr(n, 'aria-labelledby')}")
    ids = f"array_distinct({flat(pointing, lambda n: own_tokens(attr(n, 'aria-labelledby')))})"
    numbers = f"array_distinct({keep(each(ids, lambda i: looked_up('id_pre', i)), lambda p: p + ' IS NOT NULL')})"
    own = lambda t: "nullif(" + collapse_ws(attr(t, "aria-label")) + ", '')"
    inner = lambda t: (f"CASE WHEN {t}.tag = 'img' THEN {collapse_ws('coalesce(' + attr(t, 'alt') + ', ' + lit('') + ')')} "
                       f"ELSE {content_text(t, 'true', f'({t}.near.hidden = {t}.pre)')} END")
    names = each("label_targets.keys", lambda p: let(f"nodes[{p}]", lambda t: f"coalesce({own(t)}, {inner(t)})"))
    scripted = lambda t: f"({is_bound(t, 'aria-label')} OR {has_bound_text(t)} OR {_bound_inside(t, 'true', f'({t}.near.hidden = {t}.pre)')})"
    fact = lambda p, i: (f"named_struct('named', label_names[{i}] <> '', 'shown', left(label_names[{i}], {SHOWN_NAME}), "
                         f"'plain', left(trim({plain_letters(f'label_names[{i}]')}), 64), 'scripted', {let(f'nodes[{p}]', scripted)})")
    return [{"label_targets": sorted_keys(numbers)}, {"label_names": names}, {"label_facts": each_indexed("label_targets.keys", fact)}]


def _label_numbers(n: str) -> str:
    """Places of an element's labels in ``label_targets``, NULL without the attribute."""
    places = each(own_tokens(attr(n, "aria-labelledby")), lambda i: let(looked_up("id_pre", i), lambda p: f"CASE WHEN {p} IS NOT NULL THEN {count_keys('label_targets', p)} - 1 END"))
    return f"CASE WHEN {has_attr(n, 'aria-labelledby')} THEN {keep(places, lambda p: p + ' IS NOT NULL')} END"


def has_label_text(n: str) -> str:
    """Whether an aria-labelledby gives a name."""
    return f"coalesce({any_of(_label_numbers(n), lambda p: f'label_facts[{p}].named')}, false)"


def content_text(n: str, images: str, include_hidden: str = "false") -> str:
    """Text, image alt, nested labels and svg titles inside an element; hidden subtrees add nothing."""
    up = lambda x: f"nodes[{x}.parent].near"
    seen = lambda x: (
        f"{x}.near.raw <= {n}.pre AND ({include_hidden} OR {x}.near.hidden <= {n}.pre) AND {up(x)}.label <= {n}.pre "
        f"AND NOT ({up(x)}.svg > {n}.pre AND {is_key('svg_title', up(x) + '.svg')})"
    )
    part = lambda x: (
        f"CASE WHEN {x}.tag = '#text' THEN {x}.data WHEN {x}.tag = 'img' THEN CASE WHEN {images} THEN coalesce({attr(x, 'alt')}, '') END "
        f"WHEN {x}.near.label = {x}.pre THEN {attr(x, 'aria-label')} WHEN {x}.tag = 'svg' THEN {looked_up('svg_title', x + '.pre')} END"
    )
    parts = keep(each(keep(subtree(n), seen), part), lambda p: f"{p} IS NOT NULL")
    return collapse_ws(f"array_join({parts}, ' ')")


def labelled_text(n: str) -> str:
    """Names of the elements an aria-labelledby points at, NULL when it gives none."""
    names = keep(each(_label_numbers(n), lambda p: f"label_names[{p}]"), lambda x: f"{x} <> ''")
    return f"nullif(array_join({names}, ' '), '')"


def _own_name(n: str, images: bool, content: bool) -> list[str]:
    """What names an element besides other elements, in order."""
    flag = "true" if images else "false"
    options = [f"nullif({collapse_ws(attr(n, 'aria-label'))}, '')"]
    if content:
        options.append(f"nullif({content_text(n, flag)}, '')")
    return [*options, collapse_ws(attr(n, "title")), "''"]


def accessible_name(n: str, images: bool = True, content: bool = True) -> str:
    """What a screen reader announces for an element, '' for nothing."""
    return f"coalesce({labelled_text(n)}, {', '.join(_own_name(n, images, content))})"


def is_named(n: str, images: bool = True, content: bool = True) -> str:
    """Whether ``accessible_name`` gives something."""
    return f"({has_label_text(n)} OR coalesce({', '.join(_own_name(n, images, content))}) <> '')"


def link_name(n: str) -> str:
    """STRUCT<shown, plain>: a link's name for messages, and as generic wording compares it; '' for a link without a name."""
    own = let(f"coalesce({', '.join(_own_name(n, False, True))})", lambda name: f"named_struct('shown', {name}, 'plain', trim({plain_letters(name)}))")
    def labelled(ps: str) -> str:
        several = let(f"array_join(transform({ps}, p -> label_facts[p].shown), ' ')", lambda name: f"named_struct('shown', {name}, 'plain', trim({plain_letters(name)}))")
        return (f"CASE WHEN size({ps}) = 1 THEN named_struct('shown', label_facts[{ps}[0]].shown, 'plain', label_facts[{ps}[0]].plain) "
                f"WHEN size({ps}) > 1 THEN {several} ELSE {own} END")
    return let(keep(_label_numbers(n), lambda p: f"label_facts[{p}].named"), labelled)


def _bound_inside(n: str, images: str, include_hidden: str = "false") -> str:
    inside = lambda x: (
        f"{x}.tag <> '#text' AND {x}.near.raw <= {n}.pre AND ({include_hidden} OR {x}.near.hidden <= {n}.pre) AND "
        f"CASE WHEN {x}.tag = 'img' THEN {images} AND {is_bound(x, 'alt')} ELSE {has_bound_text(x)} OR {is_bound(x, 'aria-label')} END"
    )
    return any_of(subtree(n), inside)


def named_by_script(n: str, images: bool = True, content: bool = True) -> str:
    flag = "true" if images else "false"
    own = " OR ".join(is_bound(n, a) for a in ("aria-label", "aria-labelledby", "title"))
    target = f"coalesce({any_of(_label_numbers(n), lambda p: f'label_facts[{p}].scripted')}, false)"
    inner = f" OR {has_bound_text(n)} OR {_bound_inside(n, flag)}" if content else ""
    return f"(bound AND ({own} OR {target}{inner}))"


def visible_images(n: str) -> str:
    return keep(subtree(n), lambda x: f"{x}.tag = 'img' AND {x}.near.hidden <= {n}.pre AND {x}.near.raw <= {n}.pre")


def selector(pre: str) -> str:
    """The nearest unique #id, else a path of tag:nth-of-type steps."""
    s, k = fresh("s"), fresh("k")
    def step(c: str) -> str:
        own_id = (f"coalesce({c}.id_total = 1 AND {attr(c, 'id')} RLIKE '^[A-Za-z][A-Za-z0-9_-]*$', false)")
        name = (f"CASE WHEN {own_id} THEN concat('#', {attr(c, 'id')}) WHEN {c}.same > 1 THEN "
                f"concat({c}.tag, ':nth-of-type(', {c}.nth, ')') ELSE {c}.tag END")
        return (f"named_struct('cur', CASE WHEN {own_id} THEN -1 ELSE {c}.parent END, 'path', "
                f"concat({name}, CASE WHEN {s}.path = '' THEN '' ELSE ' > ' END, {s}.path))")
    walk = (f"aggregate(sequence(0, nodes[{pre}].depth), named_struct('cur', {pre}, 'path', ''), ({s}, {k}) -> "
            f"CASE WHEN {s}.cur < 0 THEN {s} ELSE {let(f'nodes[{s}.cur]', step)} END, {s} -> {s}.path)")
    return walk


def source_of(n: str, limit: int | None = None) -> str:
    """Markup as served, white space collapsed, whole or cut at a number of characters.

    Of a long element its start is read first; what follows only where the start is nearly all white space and does not fill the room.
    """
    end = f"CASE WHEN {n}.tag IN {FRAME} THEN {n}.open_end ELSE {n}.src_end END"
    read = lambda size: collapse_ws(f"CAST(substring(html, {n}.src + 1, {size}) AS STRING)")
    if limit is None:
        text = let(f"{end} - {n}.src", read)
    else:
        enough = lambda size, start: f"CASE WHEN {size} <= {limit * 8} OR char_length({start}) > {limit + 3} THEN {start} ELSE {read(size)} END"
        text = limit_text(let(f"{end} - {n}.src", lambda size: let(read(f"least({size}, {limit * 8})"), lambda start: enough(size, start))), limit)
    return f"coalesce(nullif({text}, ''), concat('<', {n}.tag, '>'))"


def snippet(n: str) -> str:
    return source_of(n, 120)


def evidence_fields(pre: str) -> tuple[str, str, str]:
    """selector, html and parent_html of one element."""
    node = f"nodes[{pre}]"
    parent = f"nodes[{node}.parent]"
    inner = f"{node}.parent >= 0 AND {parent}.tag NOT IN {FRAME}"
    return (selector(pre), let(node, lambda n: source_of(n, 500)),
            f"CASE WHEN {node}.parent < 0 THEN NULL WHEN {inner} THEN {let(parent, lambda n: source_of(n, 200))} END")
