"""Text scalars (P8-P16, P21) as SQL expression text."""

from __future__ import annotations

from html.entities import html5

from .sql import count_keys, each, each_indexed, fresh, keep, let, lit, sorted_keys

# White space as browsers see it, which is Unicode white space with U+FEFF and without U+0085.
SPACE_CLASS = r"[\s\x{FEFF}&&[^\x{85}]]"
SPACES = f"r'(?U){SPACE_CLASS}+'"
# White space that collapsing changes: single blanks, which most of a text's are, stay as they are.
UNEVEN_SPACES = rf"r'(?U) {SPACE_CLASS}+|[\s\x{{FEFF}}&&[^\x{{85}} ]]{SPACE_CLASS}*'"
MAX_URL = 2000
MAX_CONTEXT = 120


def collapse_ws(s: str) -> str:
    return f"trim(regexp_replace({s}, {UNEVEN_SPACES}, ' '))"


def trim_ws(s: str) -> str:
    return f"regexp_replace({s}, r'(?U)^{SPACE_CLASS}+|{SPACE_CLASS}+$', '')"


def char_count(s: str) -> str:
    return f"char_length({s})"


def limit_text(s: str, n: int | str) -> str:
    """At most ``n`` code points, ending in three dots when something was cut."""
    if isinstance(n, int) and n <= 3:
        return f"left({s}, {max(n, 0)})"
    if isinstance(n, int):
        return f"regexp_replace({s}, r'(?s)^(.{{{n - 3}}}).{{4,}}$', '$1...')"
    return let(s, lambda v: f"CASE WHEN char_length({v}) > {n} THEN concat(left({v}, {n} - 3), '...') ELSE {v} END")


def context(s: str) -> str:
    return limit_text(s, MAX_CONTEXT)


def clean(s: str, n: int = 120) -> str:
    """Collapsed, limited, and NULL when nothing is left."""
    return f"nullif({limit_text(collapse_ws(s), n)}, '')"


def html_entities(s: str) -> str:
    """Distinct character references, with their semicolon, that decode to something else."""
    named = ", ".join(lit(n) for n in sorted(k for k in html5 if k.endswith(";")))
    refs = f"regexp_extract_all({s}, r'(?i)&(?:#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*);', 0)"
    real = keep(refs, lambda e: f"substr({e}, 2, 1) = '#' OR substr({e}, 2) IN ({named})")
    return f"CASE WHEN instr({s}, '&') = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array_distinct({real}) END"


def safe_decode(path: str) -> str:
    """Percent-decoded, or without its escapes when they are not valid UTF-8."""
    decoded = f"try_url_decode(replace({path}, '+', '%2B'))"
    bad = lambda v: f"({v} IS NULL OR instr({v}, '\\uFFFD') > 0)"
    return let(decoded, lambda v: f"CASE WHEN instr({path}, '%') = 0 THEN {path} WHEN {bad(v)} "
                                  f"THEN regexp_replace({path}, '(?i)%[0-9a-f]{{2}}', '') ELSE {v} END")


def file_name(src: str) -> str:
    """Last part of the path, decoded; nothing for an inline image."""
    last = f"element_at(split(regexp_extract({src}, '^[^?#]*', 0), '/'), -1)"
    decoded = let(last, lambda v: f"CASE WHEN instr({v}, '%') = 0 THEN {v} "
                                  f"ELSE coalesce(try_url_decode(replace({v}, '+', '%2B')), {v}) END")
    return f"CASE WHEN {src} = '' OR startswith({src}, 'data:') THEN '' ELSE {decoded} END"


def plain_letters(s: str) -> str:
    """Lower-case letters, digits and spaces of a text."""
    return f"regexp_replace(lower({s}), r'[^\\p{{L}}\\p{{N}} ]', '')"


def norm_link_text(s: str) -> str:
    return f"trim({plain_letters(s)})"


def issue_id(where: str, kind: str, detail: str) -> str:
    return f"concat({kind}, '-', substr(sha1(concat_ws('\\n', {where}, {kind}, coalesce({detail}, ''))), 1, 8))"


def unique_ids(ids: str) -> str:
    """Repeats inside one array get -2, -3; an array without repeats costs one hash pass.

    Ids are sorted with their places; how far one lies behind the first of its kind is its number.
    """
    def numbered(v: str) -> str:
        s, i = fresh("s"), fresh("i")
        places = each_indexed(v, lambda x, i: f"named_struct('k', {x}, 'i', {i})")
        def ranked(places: str) -> str:
            index = sorted_keys(f"{places}.k")
            rank = lambda k: f"transform({places}, ({s}, {i}) -> named_struct('i', {s}.i, 'k', {s}.k, 'n', {i} - {let(s + '.k', lambda x: count_keys(k, x, '<'))}))"
            return let(index, rank)
        shown = each(f"array_sort({let(f'array_sort({places})', ranked)})", lambda e: f"CASE WHEN {e}.n = 0 THEN {e}.k ELSE concat({e}.k, '-', {e}.n + 1) END")
        return shown
    return let(ids, lambda v: f"CASE WHEN size(array_distinct({v})) = size({v}) THEN {v} ELSE {numbered(v)} END")


def number_text(d: str) -> str:
    """A double the way it reads in a page: no trailing zero for whole numbers."""
    return let(d, lambda v: f"CASE WHEN {v} = floor({v}) AND abs({v}) < 1e15 THEN CAST(CAST({v} AS BIGINT) AS STRING) "
                            f"ELSE CAST({v} AS STRING) END")


def joined(array: str, sep: str = "") -> str:
    return f"array_join({array}, {lit(sep)})"


def words_of(s: str) -> str:
    return f"filter(split({s}, {SPACES}), w -> w <> '')"


__all__ = [n for n in dir() if not n.startswith("_")] + ["each"]
