"""Reading dynamic JSON held as VARIANT, as SQL expression text.

A JSON object is handled as MAP<STRING, VARIANT>; a missing key is NULL.
"""

from __future__ import annotations

from .sql import each, first_value, let, lit
from .text import clean, number_text

NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"
OBJECT = "map<string, variant>"


def as_map(v: str) -> str:
    return f"try_variant_get({v}, '$', '{OBJECT}')"


def as_array(v: str) -> str:
    return f"try_variant_get({v}, '$', 'array<variant>')"


def as_list(v: str) -> str:
    """The items of a list, or the value itself as the only item; nothing for a missing value."""
    return let(v, lambda x: f"filter(coalesce({as_array(x)}, array({x})), i -> i IS NOT NULL)")


def as_objects(v: str) -> str:
    return f"filter({each(as_list(v), as_map)}, o -> o IS NOT NULL)"


def as_string(v: str) -> str:
    return f"CASE WHEN schema_of_variant({v}) = 'STRING' THEN variant_get({v}, '$', 'string') END"


def key(m: str, name: str) -> str:
    return f"{m}[{lit(name)}]"


def text(v: str, max_chars: int = 120) -> str:
    """A string or number as cleaned text, NULL for anything else."""
    def known(x: str) -> str:
        number = number_text(f"try_variant_get({x}, '$', 'double')")
        return (f"CASE schema_of_variant({x}) WHEN 'STRING' THEN {clean(f"variant_get({x}, '$', 'string')", max_chars)} "
                f"WHEN 'OBJECT' THEN NULL ELSE CASE WHEN schema_of_variant({x}) RLIKE '{NUMBER}' THEN {number} END END")
    return let(v, known)


def text_value(v: str, max_chars: int = 120) -> str:
    """A string, a number, an @value object, or the first usable entry of a list."""
    value = lambda x: f"coalesce(try_variant_get({x}, '$[\"@value\"]', 'variant'), {x})"
    items = lambda x: each(f"coalesce({as_array(x)}, array({x}))", value)
    return let(v, lambda x: first_value(each(items(x), lambda i: text(i, max_chars))))


def amount(v: str) -> str:
    """A price as search engines read it: a number, or digits with a dot for decimals."""
    def known(x: str) -> str:
        digits = f"CASE WHEN {as_string(x)} RLIKE r'^\\s*[0-9]+(\\.[0-9]+)?\\s*$' THEN try_cast(trim({as_string(x)}) AS DOUBLE) END"
        number = f"CASE WHEN schema_of_variant({x}) RLIKE '{NUMBER}' THEN try_variant_get({x}, '$', 'double') END"
        return f"nullif(coalesce({digits}, {number}), double('Infinity'))"
    return let(v, lambda x: let(f"CASE WHEN {as_array(x)} IS NOT NULL THEN get({as_array(x)}, 0) ELSE {x} END", known))


def given(v: str) -> str:
    """A value that says something: text, an object with properties, or a list with one of them."""
    def item(x: str) -> str:
        return f"coalesce(trim({as_string(x)}) <> '' OR size({as_map(x)}) > 0, false)"
    return f"exists({as_list(v)}, g -> {item('g')})"
