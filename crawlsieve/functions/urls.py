"""URL scalars (P1-P7, P14) as SQL expression text.

A URL is taken apart with one regular expression into scheme, authority, path, query and fragment.  Browsers
accept addresses that ``java.net.URI`` (and so ``parse_url``) refuses, such as unescaped letters in a path.
"""

from __future__ import annotations

from .sql import fresh, let
from .text import limit_text

# Schemes whose addresses have a host, and characters written as they are in a path.
SPECIAL = "'http', 'https', 'ftp', 'ws', 'wss'"
PATH_UNSAFE = r"[^\x21-\x7E]|[\x22<>`{}]"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def cleaned(value: str) -> str:
    return f"regexp_replace({value}, r'^[\\x00-\\x20]+|[\\x00-\\x20]+$|[\\t\\r\\n]+', '')"


def parts(url: str) -> str:
    """[scheme, authority, path, query with its mark, fragment with its mark]; missing parts are ''."""
    pattern = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
    return f"split(regexp_replace({url}, r'{pattern}', concat('$1', chr(1), '$2', chr(1), '$3', chr(1), '$4', chr(1), '$5')), chr(1))"


def percent_encode(s: str) -> str:
    c = fresh("c")
    coded = (f"array_join(transform(regexp_extract_all({s}, '(?s).', 0), {c} -> CASE WHEN {c} RLIKE r'{PATH_UNSAFE}' "
             f"THEN replace(url_encode({c}), '+', '%20') ELSE {c} END), '')")
    return f"CASE WHEN {s} RLIKE r'{PATH_UNSAFE}' THEN {coded} ELSE {s} END"


def remove_dots(path: str) -> str:
    acc, seg, i = fresh("a"), fresh("s"), fresh("i")
    walk = (f"aggregate(slice(split({path}, '/'), 2, 100000), CAST(array() AS ARRAY<STRING>), ({acc}, {seg}) -> "
            f"CASE WHEN {seg} = '..' THEN slice({acc}, 1, greatest(size({acc}) - 1, 0)) WHEN {seg} = '.' THEN {acc} "
            f"ELSE {acc} || array({seg}) END)")
    tail = f"CASE WHEN {path} RLIKE r'/\\.\\.?$' THEN '/' ELSE '' END"
    plain = let(walk, lambda a: f"concat('/', array_join({a}, '/'), CASE WHEN size({a}) = 0 THEN '' ELSE {tail} END)")
    return f"CASE WHEN {path} RLIKE r'/\\.\\.?(/|$)' THEN {plain} ELSE {path} END"


def _host(authority: str) -> str:
    return f"lower(regexp_replace({authority}, '^.*@', ''))"


def _special(p: str) -> str:
    """Serialise the parts of an http-like address, NULL when its host is not one."""
    scheme = f"lower({p}[0])"
    user = f"regexp_extract({p}[1], '^.*@', 0)"
    host = let(_host(f"{p}[1]"), lambda h: (
        f"CASE WHEN {h} NOT RLIKE r'^(\\[[0-9a-f:.]+\\]|[^\\s:<>\\[\\]\\^|%/#?]+)(:[0-9]{{0,5}})?$' THEN NULL "
        f"WHEN {scheme} IN ('http', 'ws') THEN regexp_replace({h}, ':(80)?$', '') "
        f"WHEN {scheme} IN ('https', 'wss') THEN regexp_replace({h}, ':(443)?$', '') "
        f"ELSE regexp_replace({h}, ':(21)?$', '') END"))
    raw = f"replace({p}[2], chr(92), '/')"
    path = let(f"CASE WHEN {p}[2] = '' THEN '/' WHEN startswith({raw}, '/') THEN {raw} ELSE concat('/', {raw}) END",
               lambda v: percent_encode(remove_dots(v)))
    return f"concat({scheme}, '://', {user}, {host}, {path}, {percent_encode(p + '[3]')}, {percent_encode(p + '[4]')})"


def serialise(url: str) -> str:
    """The address as a browser writes it, or NULL when it is not an absolute URL."""
    def known(u: str) -> str:
        special = f"lower(regexp_extract({u}, r'^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ({SPECIAL})"
        slashes = f"regexp_replace({u}, r'^([A-Za-z]+):[/\\\\]*', '$1://')"
        return (f"CASE WHEN NOT {u} RLIKE r'{SCHEME}' THEN NULL WHEN {special} THEN {let(parts(slashes), _special)} "
                f"ELSE concat(lower(regexp_extract({u}, r'{SCHEME}', 0)), regexp_replace({u}, r'{SCHEME}', '')) END")
    return let(url, known)


def absolute_from_parts(href: str, base: str) -> str:
    """Resolve ``href`` against an address given as its ``parts``; NULL when it cannot be."""
    origin_ = f"concat({base}[0], '://', {base}[1])"

    def relative(h: str) -> str:
        return (f"CASE WHEN startswith({h}, '//') THEN concat({base}[0], ':', {h}) "
                f"WHEN startswith({h}, '/') THEN concat({origin_}, {h}) "
                f"WHEN {h} = '' THEN concat({origin_}, {base}[2], {base}[3]) "
                f"WHEN startswith({h}, '#') THEN concat({origin_}, {base}[2], {base}[3], {h}) "
                f"WHEN startswith({h}, '?') THEN concat({origin_}, {base}[2], {h}) "
                f"ELSE concat({origin_}, regexp_extract(concat('/', {base}[2]), '^/?(.*/)', 1), {h}) END")

    return let(cleaned(href), lambda h: serialise(f"CASE WHEN {h} RLIKE r'{SCHEME}' THEN {h} ELSE {relative(h)} END"))


def absolute_url(href: str, base: str) -> str:
    return let(parts(base), lambda b: absolute_from_parts(href, b))


def without_fragment(url: str) -> str:
    return f"regexp_replace({url}, '(?s)#.*$', '')"


def normalize_url(value: str) -> str:
    """STRUCT<url, key, reason>: the address to request, the key of the page, or why it is refused."""
    def judge(s: str) -> str:
        scheme = f"regexp_extract({s}, r'{SCHEME}', 0)"
        url = without_fragment(s)
        key = let(parts(url), lambda p: f"CASE WHEN length({p}[2]) > 1 AND endswith({p}[2], '/') THEN "
                                        f"concat({p}[0], '://', {p}[1], left({p}[2], length({p}[2]) - 1), {p}[3]) "
                                        f"ELSE {url} END")
        nothing = "CAST(NULL AS STRING)"
        return (f"CASE WHEN {s} IS NULL THEN named_struct('url', {nothing}, 'key', {nothing}, 'reason', "
                f"CASE WHEN {cleaned(value)} RLIKE r'{SCHEME}' THEN 'not a valid URL' "
                f"ELSE 'not a valid URL (missing http:// or https://)' END) "
                f"WHEN {scheme} NOT IN ('http:', 'https:') THEN named_struct('url', {nothing}, 'key', {nothing}, "
                f"'reason', concat('unsupported protocol ', {scheme}, ' (only http and https)')) "
                f"ELSE named_struct('url', {url}, 'key', {key}, 'reason', {nothing}) END")
    return let(serialise(cleaned(value)), judge)


def page_key(url: str) -> str:
    return let(normalize_url(url), lambda n: f"coalesce({n}.key, {url})")


def origin(url: str) -> str:
    return let(parts(url), lambda p: f"CASE WHEN {p}[1] = '' THEN NULL ELSE "
                                     f"concat(lower({p}[0]), '://', {_host(p + '[1]')}) END")


def site_host(url: str) -> str:
    return let(parts(url), lambda p: f"regexp_replace({_host(p + '[1]')}, r'^www\\.|:[0-9]+$', '')")


def url_path(url: str) -> str:
    return f"{parts(url)}[2]"


def image_src(src: str, base: str) -> str:
    return (f"CASE WHEN {src} = '' THEN NULL WHEN {src} RLIKE '(?i)^data:' THEN {limit_text(src, 60)} "
            f"ELSE {limit_text(f'coalesce({absolute_url(src, base)}, {src})', 2000)} END")
