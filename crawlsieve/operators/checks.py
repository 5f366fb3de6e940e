"""Page checks on markup and response (C1-C20, C29-C37).  Each function gives the SQL of an array of raw issues."""

from __future__ import annotations

from ..functions import urls
from ..functions.sql import any_of, count_keys, each, first, flat, fresh, in_list, is_key, keep, let, lit, looked_up, sorted_index, sorted_keys
from ..functions.text import SPACES, collapse_ws, file_name, html_entities, safe_decode, trim_ws
from .families import meta_content, named, og, resolve, twitter
from .issues import NO_ISSUES, issue, per, when
from .markup import (attr, has_attr, has_label_text, is_bound, is_named, link_name, named_by_script, own_tokens, snippet, source_of, subtree, tagged,
                     trimmed_attr, visible_images, visible_text)
from .rules import SOURCES

#: Room of a context, and how much of the text after an entity is shown in it.
CONTEXT_ROOM, AROUND = 120, 20
# Limits and word lists of the checks.
TITLE_MAX, DESCRIPTION_MIN, DESCRIPTION_MAX, URL_MAX, SHELL_MAX_WORDS = 60, 70, 160, 100, 20
GENERIC_FILES = ("img", "image", "pic", "picture", "photo", "dsc", "dscn", "untitled", "screenshot")
GENERIC_LINKS = ("click here", "here", "read more", "more", "learn more", "link", "this link")
ID_REFERENCES = ("aria-labelledby", "aria-describedby", "aria-controls", "aria-owns", "for")
UNLABELLED_INPUTS = ("hidden", "submit", "button", "reset", "image")
VALUE_RULES = ("unavailable_after", "max-snippet", "max-image-preview", "max-video-preview")
NEEDS_SCRIPT = ("enable javascript", "require javascript", "requires javascript", "javascript required", "javascript is required", "javascript disabled", "javascript is disabled")
APP_ROOTS = ("root", "app", "__next", "__nuxt", "svelte")


def _node(x: str) -> str:
    return f"nodes[{x}.pre]"


def _markup(pre: str) -> str:
    """The context an issue shows for an element."""
    return let(f"nodes[{pre}]", snippet)


# --- images -------------------------------------------------------------------------------------------------------

def images() -> str:
    def judge(img: str) -> str:
        def facts(f: str) -> str:
            shown = f"{f}.shown"
            make = lambda kind, message: issue(kind, message, shown, pre=f"{img}.pre", whole=True)
            only_content = f"{img}.near.link >= 0 AND coalesce({looked_up('image_links', img + '.near.link')} = {img}.pre, false)"
            alt = (f"CASE WHEN {f}.bound_alt OR ({f}.alt IS NOT NULL AND trim({f}.alt) <> '') THEN {NO_ISSUES} WHEN {f}.alt IS NULL THEN "
                   f"array({make('missing-alt', lit('Image has no alt attribute'))}) WHEN {only_content} THEN "
                   f"array({make('empty-alt-in-link', lit('A link or button holds only an image, and its alt is empty'))}) ELSE "
                   f"array({make('empty-alt', lit('Image alt is empty, which is right only for decoration'))}) END")
            stem = f"regexp_replace({f}.name, r'(?i)\\.[a-z0-9]+$', '')"
            words = f"lower(trim(coalesce({f}.alt, '')))"
            src = when(f"{f}.src = '' AND coalesce({attr(img, 'srcset')}, '') = '' AND NOT {is_bound(img, 'src')} AND NOT {is_bound(img, 'srcset')}",
                       make("missing-src", lit("Image has neither src nor srcset")))
            generic = when(f"{f}.name <> '' AND {in_list(_without_number(stem), GENERIC_FILES)}",
                           make("generic-filename", f"concat('Image file name \"', {f}.name, '\" is generic')"))
            same = when(f"{f}.name <> '' AND {words} <> '' AND ({words} = lower({f}.name) OR {words} = lower({stem}))",
                        make("alt-is-filename", lit("Alt text is the file name")))
            size = when(f"NOT ({has_attr(img, 'width')} AND {has_attr(img, 'height')})",
                        make("missing-dimensions", lit("Image lacks width or height")))
            return f"concat({alt}, {src}, {generic}, {same}, {size})"
        bound_src = is_bound(img, "src")
        src = f"CASE WHEN {bound_src} THEN '' ELSE {trimmed_attr(img, 'src')} END"
        record = let(src, lambda s: (
            f"named_struct('bound_alt', {is_bound(img, 'alt')}, 'alt', CASE WHEN NOT {is_bound(img, 'alt')} THEN {attr(img, 'alt')} END, "
            f"'src', {s}, 'name', {file_name(s)}, 'shown', {snippet(img)})"))
        return let(record, facts)
    return per("imgs", judge)


def image_links() -> str:
    """Index of the links and buttons around images that nothing names but images without alt: the first of their visible images."""
    unnamed = lambda i: f"trim(coalesce({attr(i, 'alt')}, '')) = '' AND NOT {is_bound(i, 'alt')}"
    alone = lambda v: f"CASE WHEN forall({v}, i -> {unnamed('i')}) THEN {first(v)}.pre END"
    judge = lambda link: (f"CASE WHEN NOT {is_named(link, images=False)} AND NOT {named_by_script(link, images=False)} "
                          f"THEN {let(visible_images(link), alone)} END")
    around = "array_distinct(transform(filter(imgs, i -> i.near.link >= 0), i -> i.near.link))"
    return sorted_index(keep(each(around, lambda p: f"struct({p} AS k, {let(f'nodes[{p}]', judge)} AS v)"), lambda e: f"{e}.v IS NOT NULL"))


def image_stages() -> list[dict[str, str]]:
    return [{"image_links": image_links()}]


def _without_number(stem: str) -> str:
    """A file name in lower case without the digits at its end and a separator before them."""
    return f"regexp_replace(lower({stem}), '[-_ ]?[0-9]*$', '')"


# --- accessibility ------------------------------------------------------------------------------------------------

def _input_type(n: str) -> str:
    return f"lower(coalesce({attr(n, 'type')}, ''))"


def form_labels() -> str:
    labelable = lambda x: (f"(({x}.tag = 'input' AND {_input_type(x)} <> 'hidden') OR "
                           f"{in_list(x + '.tag', ('select', 'textarea', 'button', 'meter', 'output', 'progress'))})")
    named_labels = keep(tagged("label"), lambda l: f"{is_named(l)} OR {named_by_script(l)}")
    aim = lambda l: (f"named_struct('id', {attr(l, 'for')}, 'pre', CASE WHEN NOT {has_attr(l, 'for')} THEN "
                     f"{first(keep(subtree(l), labelable))}.pre END)")
    controls = keep("nodes", lambda c: (
        f"(({c}.tag = 'input' AND NOT {in_list(_input_type(c), UNLABELLED_INPUTS)}) OR {c}.tag IN ('select', 'textarea')) "
        f"AND coalesce({attr(c, 'aria-hidden')}, '') <> 'true'"))
    def judge(named: str) -> str:
        def one(c: str) -> str:
            labelled = f"{is_key(named + '.pres', c + '.pre')} OR ({has_attr(c, 'id')} AND {is_key(named + '.ids', attr(c, 'id'))})"
            own = f"{is_named(c, content=False)} OR {named_by_script(c, content=False)}"
            broken = f"{has_attr(c, 'aria-labelledby')} AND NOT {has_label_text(c)}"
            message = f"CASE WHEN {broken} THEN 'Form field is unnamed, its aria-labelledby names nothing' ELSE 'Form field has no label' END"
            return when(f"NOT ({labelled}) AND NOT ({own})",
                        issue("form-input-no-label", message, snippet(c), pre=f"{c}.pre", whole=True))
        return per(controls, one)
    # what the labels of the page name: ids, and controls inside a label
    aims = lambda ls: (f"named_struct('ids', {sorted_keys('filter(transform(' + ls + ', l -> l.id), i -> i <> ' + lit('') + ')')}, "
                       f"'pres', {sorted_keys('filter(transform(' + ls + ', l -> l.pre), p -> p IS NOT NULL)')})")
    return let(let(each(named_labels, aim), aims), judge)


def duplicate_ids() -> str:
    references = " || ".join(own_tokens(attr("n", a)) for a in ID_REFERENCES)
    referenced = f"array_distinct(flatten(transform(filter(nodes, n -> n.tag <> '#text' AND size(n.attrs) > 0), n -> {references})))"
    doubled = keep("nodes", lambda n: f"{n}.id_nth = 1 AND {n}.id_total > 1 AND {attr(n, 'id')} <> ''")
    def one(n: str, used: str) -> str:
        hit = is_key(used, attr(n, "id"))
        message = (f"concat('id \"', {attr(n, 'id')}, '\" occurs ', {n}.id_total, ' times', CASE WHEN {hit} "
                   f"THEN ' and a label or ARIA attribute refers to it' ELSE '' END)")
        return "array(" + issue("duplicate-id", message, snippet(n), pre=f"{n}.pre", whole=True,
                                severity=f"CASE WHEN {hit} THEN 'error' ELSE 'warning' END",
                                category=f"CASE WHEN {hit} THEN 'accessibility' ELSE 'best-practice' END") + ")"
    return let(doubled, lambda ds: f"CASE WHEN size({ds}) = 0 THEN {NO_ISSUES} ELSE {let(sorted_keys(referenced), lambda used: per(ds, lambda n: one(n, used)))} END")


def main_landmark() -> str:
    has_main = any_of("nodes", lambda n: f"{n}.tag = 'main' OR ({n}.tag <> '#text' AND coalesce({attr(n, 'role')}, '') = 'main')")
    return when(f"NOT {has_main}", issue("missing-main-landmark", lit("Page has no main landmark"), lit("<body>")))


# --- links --------------------------------------------------------------------------------------------------------

def links() -> str:
    def judge(a: str) -> str:
        def on(n: str) -> str:
            def named_(name: str) -> str:
                def found(by_script: str) -> str:
                    make = lambda kind, message: issue(kind, message, snippet(n), pre=f"{n}.pre", whole=True)
                    none = when(f"{name}.shown = '' AND NOT {by_script} AND size({visible_images(n)}) = 0",
                                make("link-no-name", lit("Link has no text, aria-label or title")))
                    generic = when(f"{in_list(name + '.plain', GENERIC_LINKS)} AND NOT {by_script}",
                                   make("link-generic-text", f"concat('Link text \"', {name}.shown, '\" is generic')"))
                    return f"concat({none}, {generic})"
                return let(named_by_script(n, images=False), found)
            placeholder = when(f"{a}.raw = '#' OR {a}.raw RLIKE '(?i)^javascript:'", issue(
                "link-empty-href", f"concat('Link has no target (href=\"', left({a}.raw, 20), '\")')", snippet(n), pre=f"{n}.pre", whole=True))
            return (f"CASE WHEN coalesce({attr(n, 'aria-hidden')}, '') = 'true' THEN {NO_ISSUES} ELSE "
                    f"concat({let(link_name(n), named_)}, {placeholder}) END")
        return let(_node(a), on)
    return per("anchors", judge)


# --- title, description, canonical ----------------------------------------------------------------------------------

def title() -> str:
    n = "char_length(title_text)"
    long = issue("long-title", f"concat('Title has ', {n}, ' characters, results show about {TITLE_MAX}')",
                 "concat('<title>', title_text, '</title>')", pre="title_node.pre", actual_num=n,
                 expected=lit(f"at most {TITLE_MAX} characters"))
    none = issue("missing-title", lit("Page has no title"), lit("<head>"))
    empty = issue("empty-title", lit("Title is empty"), lit("<title></title>"), pre="title_node.pre")
    return (f"CASE WHEN title_node IS NULL THEN array({none}) WHEN title_text = '' THEN array({empty}) "
            f"WHEN {n} > {TITLE_MAX} THEN array({long}) ELSE {NO_ISSUES} END")


def _description_tag(d: str) -> str:
    return f"concat('<meta name=\"description\" content=\"', {d}, '\">')"


def description() -> str:
    def judge(ds: str) -> str:
        many = when(f"size({ds}) > 1", issue(
            "multiple-descriptions", f"concat('Page has ', size({ds}), ' meta descriptions, one is used')",
            f"array_join({each(ds, lambda d: _description_tag(d + '.content'))}, ' ')"))
        def of_first(d: str) -> str:
            n = f"char_length({d}.content)"
            size = lambda kind, message, bound: issue(kind, message, _description_tag(f"{d}.content"), pre=f"{d}.pre", actual_num=n, expected=lit(bound))
            none = issue("missing-description", lit("Page has no meta description"), lit("<head>"))
            long = size("long-description", f"concat('Meta description has ', {n}, ' characters, results show about {DESCRIPTION_MAX}')", f"at most {DESCRIPTION_MAX} characters")
            short = size("short-description", f"concat('Meta description has only ', {n}, ' characters, {DESCRIPTION_MIN} say more')", f"at least {DESCRIPTION_MIN} characters")
            return (f"CASE WHEN {d} IS NULL THEN array({none}) WHEN {n} > {DESCRIPTION_MAX} THEN array({long}) "
                    f"WHEN {n} < {DESCRIPTION_MIN} THEN array({short}) ELSE {NO_ISSUES} END")
        return f"concat({many}, {let(first(keep(ds, lambda d: d + '.content <> ' + lit(''))), of_first)})"
    return let(keep("metas", named("description")), judge)


def canonical() -> str:
    outside = keep("head_links", lambda l: f"array_contains({l}.rel, 'canonical')")
    def missing(o: str) -> str:
        return (f"CASE WHEN {o} IS NULL THEN array({issue('missing-canonical', lit('Page has no canonical link'), lit('<head>'))}) ELSE "
                f"array({issue('missing-canonical', lit('Canonical link is outside the head, where it is ignored'), _markup(o + '.pre'), pre=o + '.pre')}) END")
    distinct = "size(array_distinct(transform(canonicals, c -> c.href)))"
    many = when("size(canonicals) > 1", issue(
        "multiple-canonicals", f"concat('Page has ', size(canonicals), CASE WHEN {distinct} = 1 THEN ' identical' ELSE ' different' END, ' canonical links')",
        f"array_join({each('canonicals', lambda c: _markup(c + '.pre'))}, ' ')", pres="transform(canonicals, c -> c.pre)",
        severity=f"CASE WHEN {distinct} = 1 THEN 'info' ELSE 'warning' END"))
    def one(c: str) -> str:
        make = lambda kind, message, **more: issue(kind, lit(message), _markup(f"{c}.pre"), pre=f"{c}.pre", **more)
        relative = when(f"NOT {c}.href RLIKE r'{urls.ABSOLUTE}'", make("relative-canonical", "Canonical address is relative", actual=f"{c}.href",
                        expected=lit("a full address such as https://example.com/page")))
        fragment = when(f"instr({c}.href, '#') > 0", make("canonical-fragment", "Canonical address has a fragment", actual=f"{c}.href"))
        return f"CASE WHEN {c}.href = '' THEN array({make('empty-canonical', 'Canonical link has no address')}) ELSE concat({relative}, {fragment}) END"
    return f"CASE WHEN size(canonicals) = 0 THEN {let(first(outside), missing)} ELSE concat({many}, {per('canonicals', one)}) END"


# --- text that was escaped twice ------------------------------------------------------------------------------------

def escaped_text() -> str:
    tag = lambda test: first(keep("metas", lambda m: f"({test(m)}) AND {m}.content <> ''"))
    field = lambda label, pre, value, severity, source: (
        f"named_struct('label', {lit(label)}, 'pre', {pre}, 'value', {value}, 'severity', {lit(severity)}, 'source', {lit(source)})")
    fields = [field("Title", "title_node.pre", "title_text", "warning", SOURCES["title"])]
    for label, test, severity, source in (
        ("Meta description", named("description"), "warning", "snippet"), ("og:title", og("title"), "info", "openGraph"),
        ("og:description", og("description"), "info", "openGraph"), ("twitter:title", twitter("title"), "info", "openGraph"),
        ("twitter:description", twitter("description"), "info", "openGraph"),
    ):
        fields.append(let(tag(test), lambda m: field(label, f"{m}.pre", f"{m}.content", severity, SOURCES[source])))
    def judge(f: str) -> str:
        def on(es: str) -> str:
            shown = f"array_join({es}, ', ')"
            return when(f"size({es}) > 0", issue(
                "double-escaped-text", f"concat({f}.label, ' shows ', {shown}, ' as text, it was escaped twice')",
                let(f"nodes[{f}.pre]", lambda n: _escaped_context(n, f"{es}[0]")), pre=f"{f}.pre", severity=f"{f}.severity",
                source=f"{f}.source", actual=shown, expected=lit("the character itself, escaped once")))
        return let(html_entities(f"{f}.value"), on)
    return per(f"filter(array({', '.join(fields)}), f -> instr(f.value, '&') > 0)", judge)


def _escaped_context(n: str, entity: str) -> str:
    """The tag as written.  Where the entity lies past the room, a window of the text that ends shortly after it, behind the tag's opening if that is short."""
    written = f"concat('&amp;', substr({entity}, 2))"
    def shown(h: str) -> str:
        opening = f"regexp_extract({h}, CASE WHEN {n}.tag = 'meta' THEN '^.*? content=.' ELSE '^[^>]*>' END, 0)"
        def window(o: str) -> str:
            text = f"substr({h}, char_length({o}) + 1)"
            def around(w: str) -> str:
                seen = f"concat({w}.before, {w}.entity, left({w}.after, {AROUND}))"
                lead = f"IF(char_length({o}) <= {CONTEXT_ROOM} div 2, {o}, '')"
                more = f"IF(char_length({w}.after) > {AROUND}, '...', '')"
                room = f"{CONTEXT_ROOM} - char_length({lead}) - char_length({more}) - 3"
                fits = f"char_length({o}) + char_length({seen}) <= {CONTEXT_ROOM}"
                return f"IF({fits} OR NOT contains({text}, {w}.entity), {h}, concat({lead}, '...', right({seen}, {room}), {more}))"
            before = lambda e: f"substring_index({text}, {e}, 1)"
            parts = lambda e: f"named_struct('entity', {e}, 'before', {before(e)}, 'after', substr({text}, char_length({before(e)}) + char_length({e}) + 1))"
            return let(let(written, parts), around)
        return let(opening, window)
    return let(source_of(n), shown)


# --- headings -------------------------------------------------------------------------------------------------------

def headings() -> str:
    tag = lambda h: f"concat('<h', {h}.level, '>', {h}.text, '</h', {h}.level, '>')"
    h1s = keep("headings", lambda h: f"{h}.level = 1")
    several = lambda hs: issue("multiple-h1", f"concat('Page has ', size({hs}), ' h1 elements')", f"array_join({each(hs, tag)}, ' ')",
                               pres=each(hs, lambda h: f"{h}.pre"))
    counts = let(h1s, lambda hs: (
        f"CASE WHEN size({hs}) = 0 THEN array({issue('missing-h1', lit('Page has no h1'), lit('<body>'))}) "
        f"WHEN size({hs}) > 1 THEN array({several(hs)}) "
        f"ELSE {NO_ISSUES} END"))
    # Which nodes say something is worked out once; whether a heading holds one is a difference of two counts.
    saying = keep("nodes", lambda x: (
        f"({x}.tag = '#text' AND {x}.near.raw < 0 AND {trim_ws(x + '.data')} <> '') OR "
        f"({x}.tag = 'img' AND {trim_ws('coalesce(' + attr(x, 'alt') + ', ' + lit('') + ')')} <> '')"))
    holds = lambda n, index: f"({let(n + '.last', lambda v: count_keys(index, v))} > {let(n + '.pre', lambda v: count_keys(index, v))})"
    h, i = fresh("h"), fresh("i")
    previous = f"CASE WHEN {i} = 0 THEN 1 ELSE headings[{i} - 1].level END"
    skipped = when(f"{h}.level > {previous} + 1", issue(
        "skipped-heading-level", f"concat('Heading level jumps to h', {h}.level, ' after ', CASE WHEN {i} = 0 THEN 'no heading' ELSE concat('h', {previous}) END)",
        tag(h), pre=f"{h}.pre"))
    def empty(n: str, index: str) -> str:
        unnamed = (f"NOT ({holds(n, index)} OR coalesce({attr(n, 'aria-label')}, '') <> '' OR coalesce({attr(n, 'aria-labelledby')}, '') <> '' "
                   f"OR {named_by_script(n)})")
        return when(unnamed, issue("empty-heading", f"concat('Heading h', {h}.level, ' is empty')", snippet(n), pre=f"{n}.pre", whole=True))
    # A heading with visible text is never empty, so only the others are searched.
    order = lambda index: f"transform(headings, ({h}, {i}) -> concat({skipped}, CASE WHEN {h}.text <> '' THEN {NO_ISSUES} ELSE {let(f'nodes[{h}.pre]', lambda n: empty(n, index))} END))"
    index = f"CASE WHEN exists(headings, h -> h.text = '') THEN {sorted_keys(each(saying, lambda x: x + '.pre'))} END"
    return f"concat({counts}, coalesce(flatten({let(index, order)}), {NO_ISSUES}))"


# --- indexing and snippets ------------------------------------------------------------------------------------------

def agent_rules(header: str, agent: str) -> str:
    """Rules of an X-Robots-Tag header for one crawler: a prefix applies to the rules after it."""
    s, p = fresh("s"), fresh("p")
    part = f"trim(lower({p}))"
    name = f"regexp_extract({part}, r'^([a-z][a-z0-9_-]*)\\s*:\\s*(.*)$', 1)"
    prefixed = f"{name} <> '' AND NOT {in_list(name, VALUE_RULES)}"
    who = f"CASE WHEN {prefixed} THEN {name} ELSE {s}.agent END"
    rule = f"CASE WHEN {prefixed} THEN trim(regexp_extract({part}, r'^([a-z][a-z0-9_-]*)\\s*:\\s*(.*)$', 2)) ELSE {part} END"
    step = (f"named_struct('agent', {who}, 'rules', CASE WHEN {who} IS NULL OR {who} = {lit(agent)} THEN {s}.rules || array({rule}) ELSE {s}.rules END)")
    return (f"aggregate(split({header}, ','), named_struct('agent', CAST(NULL AS STRING), 'rules', CAST(array() AS ARRAY<STRING>)), "
            f"({s}, {p}) -> {step}, {s} -> {s}.rules)")


def rule_sources(names: tuple[str, ...], agent: str) -> str:
    """Every place that gives one crawler rules: its meta tags in order, then the header."""
    tags = keep("metas", lambda m: in_list(f"{m}.name", names))
    rows = each(tags, lambda m: (
        f"named_struct('rules', transform(split(lower({m}.raw), ','), r -> {trim_ws('r')}), 'context', "
        f"concat('<meta name=\"', {m}.written, '\" content=\"', {m}.raw, '\">'), 'pre', {m}.pre)"))
    header = (f"CASE WHEN coalesce(robots_header, '') = '' THEN array() ELSE array(named_struct('rules', {agent_rules('robots_header', agent)}, "
              f"'context', concat('X-Robots-Tag: ', robots_header), 'pre', CAST(NULL AS INT))) END")
    return f"concat({rows}, {header})"


ROBOTS_MESSAGES = {"noindex": "Page asks search engines not to index it", "nofollow": "Page asks search engines not to follow its links"}


def robots_meta() -> str:
    def found(rule: str) -> str:
        tag = first(keep("metas", lambda m: f"{m}.name IN ('robots', 'googlebot') AND exists(split(lower({m}.raw), ','), r -> trim(r) IN ('{rule}', 'none'))"))
        return let(tag, lambda m: when(f"{m} IS NOT NULL", issue(
            rule, lit(ROBOTS_MESSAGES[rule]), f"concat('<meta name=\"', {m}.written, '\" content=\"', {m}.raw, '\">')", pre=f"{m}.pre")))
    return f"concat({found('noindex')}, {found('nofollow')})"


def robots_header() -> str:
    def judge(rules: str) -> str:
        return "concat(" + ", ".join(
            when(f"array_contains({rules}, '{r}') OR array_contains({rules}, 'none')",
                 issue(r, lit(ROBOTS_MESSAGES[r]), "concat('X-Robots-Tag: ', robots_header)")) for r in ("noindex", "nofollow")) + ")"
    return f"CASE WHEN coalesce(robots_header, '') <> '' AND status = 200 THEN {let(agent_rules('robots_header', 'googlebot'), judge)} ELSE {NO_ISSUES} END"


def viewport_and_lang() -> str:
    viewport = when(f"{meta_content(named('viewport'))} IS NULL", issue(
        "missing-viewport", lit("Page has no viewport tag"), lit('<meta name="viewport" content="width=device-width, initial-scale=1">')))
    lang = when(f"{trimmed_attr('html_node', 'lang')} = ''", issue(
        "missing-lang", lit("The html element has no lang"), lit("<html>"), pre="html_node.pre"))
    return f"concat({viewport}, {lang})"


def snippets() -> str:
    pairs = lambda ss: flat(ss, lambda s: each(f"{s}.rules", lambda r: f"named_struct('rule', {r}, 'context', {s}.context, 'pre', {s}.pre)"))
    size = lambda p: f"try_cast(regexp_extract({p}.rule, r'^max-snippet\\s*:\\s*(-?[0-9]+)$', 1) AS BIGINT)"
    closed = lambda ps: any_of(ps, lambda p: f"{p}.rule IN ('noindex', 'none')")
    def google(ps: str) -> str:
        none = first(keep(ps, lambda p: f"{p}.rule = 'nosnippet' OR coalesce({size(p)} = 0, false)"))
        limits = keep(ps, lambda p: f"coalesce({size(p)} > 0, false)")
        a, b = fresh("a"), fresh("b")
        tight = first(f"array_sort({limits}, ({a}, {b}) -> CASE WHEN {size(a)} < {size(b)} THEN -1 WHEN {size(a)} > {size(b)} THEN 1 ELSE 0 END)")
        make = lambda p, message, severity: issue("snippet-restricted", message, f"{p}.context", pre=f"{p}.pre", severity=lit(severity))
        limited = let(tight, lambda p: when(f"{p} IS NOT NULL", make(p, f"concat('Google may show only ', {size(p)}, ' characters of the page (', {p}.rule, ')')", "info")))
        hidden_text = lambda p: f"concat('Google may not show a snippet (', {p}.rule, ')')"
        hidden = let(none, lambda p: f"CASE WHEN {p} IS NOT NULL THEN array({make(p, hidden_text(p), 'warning')}) ELSE {limited} END")
        return f"CASE WHEN {closed(ps)} THEN {NO_ISSUES} ELSE {hidden} END"
    def bing(ps: str) -> str:
        rule = lambda r: first(keep(ps, lambda p: f"{p}.rule = '{r}'"))
        make = lambda p, message, severity: issue("copilot-restricted", lit(message), f"{p}.context", pre=f"{p}.pre", severity=lit(severity))
        archive = let(rule("noarchive"), lambda p: when(f"{p} IS NOT NULL", make(p, "Bing may not use the page in answers (noarchive)", "warning")))
        cache = let(rule("nocache"), lambda p: f"CASE WHEN {p} IS NOT NULL THEN array({make(p, 'Bing may show only title, address and snippet in answers (nocache)', 'info')}) ELSE {archive} END")
        return f"CASE WHEN {closed(ps)} THEN {NO_ISSUES} ELSE {cache} END"
    return (f"concat({let(pairs(rule_sources(('robots', 'googlebot'), 'googlebot')), google)}, "
            f"{let(pairs(rule_sources(('robots', 'bingbot'), 'bingbot')), bing)})")


# --- social ---------------------------------------------------------------------------------------------------------

def social() -> str:
    any_og = any_of("metas", lambda m: f"startswith({m}.prop, 'og:') OR startswith({m}.name, 'og:')")
    absent = "filter(array(" + ", ".join(f"CASE WHEN {meta_content(og(n))} IS NULL THEN 'og:{n}' END" for n in ("title", "description", "image")) + "), v -> v IS NOT NULL)"
    incomplete = let(absent, lambda a: when(f"size({a}) > 0", issue(
        "incomplete-open-graph", f"concat('Open Graph lacks ', array_join({a}, ', '))", f"concat('<meta property=\"', {a}[0], '\" content=\"...\">')")))
    graph = f"CASE WHEN NOT {any_og} THEN array({issue('missing-open-graph', lit('Page has no Open Graph tags'), lit('<head>'))}) ELSE {incomplete} END"
    card = when(f"{meta_content(twitter('card'))} IS NULL", issue(
        "missing-twitter-card", lit("Page has no twitter:card"), lit('<meta name="twitter:card" content="summary_large_image">')))
    return f"concat({graph}, {card})"


# --- hreflang -------------------------------------------------------------------------------------------------------

def valid_hreflang(value: str, languages, scripts, regions) -> str:
    """x-default, or a known language with an optional known script and region."""
    v = f"lower({value})"
    part = lambda k: f"regexp_extract({v}, '^([a-z]{{2,3}})(?:-([a-z]{{4}}))?(?:-([a-z]{{2}}|[0-9]{{3}}))?$', {k})"
    one = lambda x, codes: in_list(x, sorted(codes))
    return (f"({v} = 'x-default' OR ({one(part(1), languages)} AND ({part(2)} = '' OR {one(part(2), scripts)}) "
            f"AND ({part(3)} = '' OR {one(part(3), regions)})))")


def hreflang_stages() -> list[dict[str, str]]:
    """``alternate_goals``: each alternate with the page it names; ``own_keys``: the page itself and its canonical."""
    goal = lambda href: urls.page_key(f"coalesce({resolve(href)}, {href})")
    canonical_href = "get(filter(canonicals, c -> c.href <> ''), 0).href"
    return [{
        "alternate_goals": each("alternates", lambda l: f"named_struct('pre', {l}.pre, 'lang', {l}.lang, 'href', {l}.href, 'goal', {goal(l + '.href')})"),
        "own_keys": let(canonical_href, lambda c: f"array({urls.page_key('final_url')}, CASE WHEN {c} IS NOT NULL THEN {goal(c)} END)"),
    }]


def hreflang(codes: dict[str, frozenset[str]]) -> str:
    def one(l: str) -> str:
        make = lambda kind, message, **more: issue(kind, message, _markup(f"{l}.pre"), pre=f"{l}.pre", **more)
        bad = when(f"NOT {valid_hreflang(l + '.lang', codes['languages'], codes['scripts'], codes['regions'])}", make(
            "invalid-hreflang", f"concat('Hreflang \"', {l}.lang, '\" is not a known language or region')", actual=f"{l}.lang",
            expected=lit("a language code such as en, en-GB, or x-default")))
        relative = when(f"NOT {l}.href RLIKE r'{urls.ABSOLUTE}'", make(
            "relative-hreflang", f"CASE WHEN {l}.href = '' THEN 'Hreflang link has no address' ELSE 'Hreflang address is relative' END",
            actual=f"{l}.href", expected=lit("a full address such as https://example.com/en/page")))
        return f"concat({bad}, {relative})"
    def doubled(v: str) -> str:
        def group(g: str) -> str:
            same = f"size(array_distinct(transform({g}, l -> l.goal))) = 1"
            return when(f"size({g}) > 1", issue(
                "duplicate-hreflang", f"concat('Hreflang \"', {v}, '\" is declared ', size({g}), ' times ', CASE WHEN {same} THEN 'for one address' ELSE 'for different addresses' END)",
                f"array_join({each(g, lambda l: _markup(l + '.pre'))}, ' ')", pres=f"transform({g}, l -> l.pre)",
                severity=f"CASE WHEN {same} THEN 'info' ELSE 'warning' END"))
        return let(keep("alternate_goals", lambda l: f"lower({l}.lang) = {v}"), group)
    langs = "array_distinct(filter(transform(alternate_goals, l -> lower(l.lang)), v -> v <> ''))"
    no_self = when("NOT exists(alternate_goals, l -> coalesce(array_contains(own_keys, l.goal), false))", issue(
        "missing-self-hreflang", lit("Hreflang links leave out this page"), "final_url", expected=lit("an alternate link to this page")))
    no_default = when("NOT exists(alternate_goals, l -> lower(l.lang) = 'x-default')", issue(
        "missing-x-default", lit("Hreflang links have no x-default"), lit("<head>"), expected=lit('<link rel="alternate" hreflang="x-default" href="...">')))
    return (f"CASE WHEN size(alternate_goals) = 0 THEN {NO_ISSUES} ELSE concat({per('alternate_goals', one)}, {per(langs, doubled)}, "
            f"{no_self}, {no_default}) END")


# --- hygiene --------------------------------------------------------------------------------------------------------

def address() -> str:
    def judge(p: str) -> str:
        def on(d: str) -> str:
            n = f"char_length({d}.shown)"
            make = lambda kind, message, context, **more: issue(kind, message, context, **more)
            return "concat(" + ", ".join((
                when(f"{n} > {URL_MAX}", make("long-url", f"concat('Address has ', {n}, ' characters, over {URL_MAX}')", f"{d}.shown", actual_num=n, expected=lit(f"at most {URL_MAX} characters"))),
                when(f"instr({d}.path, '_') > 0", make("url-underscores", lit("Address path has underscores"), f"{p}[2]")),
                when(f"{d}.path <> lower({d}.path)", make("url-uppercase", lit("Address path has upper case"), f"{p}[2]")),
            )) + ")"
        path = safe_decode(f"{p}[2]")
        return let(path, lambda q: let(f"named_struct('path', {q}, 'shown', concat({p}[0], '://', {p}[1], {q}, {safe_decode(p + '[3]')}))", on))
    return let(urls.serialise("final_url"), lambda u: f"CASE WHEN {u} IS NULL THEN {NO_ISSUES} ELSE {let(urls.parts(u), judge)} END")


def html_size() -> str:
    limit = 2 * 1024 * 1024
    return when("truncated", issue("html-too-large", lit("HTML is over 2 MB, the rest is not indexed or checked"), lit(f"more than {limit} bytes"), expected=lit(f"at most {limit} bytes")))


def mixed_content() -> str:
    loads = lambda n: (f"({n}.tag IN ('img', 'source') OR ({n}.tag IN ('script', 'iframe', 'audio', 'video') AND {has_attr(n, 'src')}) OR "
                       f"({n}.tag = 'link' AND {has_attr(n, 'href')} AND array_contains({own_tokens('lower(' + attr(n, 'rel') + ')')}, 'stylesheet')))")
    candidates = lambda n: (f"filter(concat(array({trimmed_attr(n, 'src')}, {trimmed_attr(n, 'href')}), "
                            f"transform(split(coalesce({attr(n, 'srcset')}, ''), ','), c -> get(split({trim_ws('c')}, {SPACES}), 0))), v -> v <> '')")
    loopback = lambda u: f"{urls.parts(u)}[1] RLIKE r'^(.*@)?(localhost|127\\.[0-9]+\\.[0-9]+\\.[0-9]+|\\[::1\\]|.*\\.localhost)(:[0-9]+)?$'"
    insecure = lambda n: any_of(each(candidates(n), resolve), lambda u: f"coalesce(startswith({u}, 'http:') AND NOT {loopback(u)}, false)")
    # On a secure page an address is insecure only if it says http: itself, or the base does.
    def one(n: str) -> str:
        return when(insecure(n), issue("mixed-content", f"concat('Secure page loads ', {n}.tag, ' over http')", snippet(n), pre=f"{n}.pre", whole=True))
    return f"CASE WHEN startswith(final_url, 'https:') THEN {per(keep('nodes', loads), one)} ELSE {NO_ISSUES} END"


def client_side() -> str:
    root = first(keep("nodes", lambda n: f"{n}.tag <> '#text' AND {in_list(attr(n, 'id'), APP_ROOTS)}"))
    content = any_of("nodes", lambda n: f"{n}.tag IN ('main', 'article', 'form') AND {n}.near.body >= 0 AND {n}.near.shell < 0 AND {n}.near.raw < 0")
    noscript = collapse_ws(f"array_join(transform(filter(nodes, x -> x.tag = '#text' AND x.near.raw >= 0 AND nodes[x.near.raw].tag = 'noscript'), x -> x.data), '')")
    asks = lambda text: "(" + " OR ".join(f"contains({text}, {lit(phrase)})" for phrase in NEEDS_SCRIPT) + ")"
    def judge(r: str) -> str:
        def on(s: str) -> str:
            empty_root = f"({s}.empty AND NOT {s}.content)"
            needs = f"({s}.needs AND ({s}.empty OR word_count = 0))"
            tag = f"concat('<', {r}.tag, ' id=\"', {attr(r, 'id')}, '\"></', {r}.tag, '>')"
            return when(f"{empty_root} OR {needs}", issue(
                "client-side-rendered", lit("Page has almost no text in its HTML and seems built in the browser"),
                f"CASE WHEN {empty_root} THEN {tag} ELSE '<noscript>' END"))
        state = (f"named_struct('empty', coalesce({collapse_ws(visible_text(r))} = '', false), 'content', {content}, 'needs', {let(f'lower({noscript})', asks)})")
        return let(state, on)
    return f"CASE WHEN word_count >= {SHELL_MAX_WORDS} THEN {NO_ISSUES} ELSE {let(root, judge)} END"


# --- response -------------------------------------------------------------------------------------------------------

def response() -> str:
    chain = "array_join(concat(array(url), transform(redirects, r -> r.location)), ' -> ')"
    hops = "array_join(transform(redirects, r -> CAST(r.status AS STRING)), ', ')"
    several = issue("redirect-chain", f"concat('Redirects ', size(redirects), ' times (', {hops}, ')')", chain)
    one = issue("redirect", f"concat('Redirects (', {hops}, '), the final address was checked')", chain)
    redirect = f"CASE WHEN size(redirects) > 1 THEN array({several}) WHEN size(redirects) = 1 THEN array({one}) ELSE {NO_ISSUES} END"
    landed = "CASE WHEN final_url = url THEN '' ELSE final_url END"
    bad = issue("http-status", "concat('HTTP status ', status, ', page checks skipped')", landed)
    other = issue("not-html", "concat('Not HTML (content type ', coalesce(nullif(content_type, ''), 'none'), '), page checks skipped')", landed)
    state = f"CASE WHEN status <> 200 THEN array({bad}) WHEN html IS NULL THEN array({other}) ELSE {NO_ISSUES} END"
    failed = issue("fetch-failed", "concat('Page could not be loaded: ', error)", "''")
    broken = when("parse_error IS NOT NULL", issue("check-failed", "concat('Page could not be processed: ', parse_error)", "''"))
    return f"CASE WHEN error IS NOT NULL THEN array({failed}) ELSE concat({redirect}, {state}, {robots_header()}, {broken}) END"
