"""Small builders of Spark SQL expression text.

Page-level operators work on one row per page and arrays inside it, so they are written as higher-order
functions.  Each builder takes and returns SQL text; ``col`` turns the final text into a Column.
"""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_names = count()
_PLAIN = re.compile(r"[A-Za-z_]\w*(\.\w+)*")


def col(sql: str) -> Column:
    return F.expr(sql)


#: What the SQL parser may keep of the texts it has read, in states of about 8 KB.
PARSER_STATES = 4_000


def bound_parser(spark: SparkSession) -> None:
    """Has the SQL parser let go of what it has learned once that is large, unless the session was started with values of its own.

    It keeps states of every text it has read for as long as the driver lives: over 600 MB after the texts of all page checks.
    """
    for key, value in (("manageParserCaches", "true"), ("parserDfaCacheFlushThreshold", str(PARSER_STATES))):
        if spark.sparkContext.getConf().get(f"spark.sql.parser.{key}") is None:
            spark.conf.set(f"spark.sql.parser.{key}", value)


def fresh(prefix: str = "v") -> str:
    """A lambda variable name not used anywhere else, so nested builders cannot capture each other's names."""
    return f"{prefix}_{next(_names)}"


def let(value: str, body) -> str:
    """Evaluate ``value`` once and use it in ``body(name)``.

    A lambda's variable keeps Catalyst from copying the expression to each of its uses, in particular into
    a lambda where it would run once per element.  A name or field needs no binding.
    """
    if _PLAIN.fullmatch(value):
        return body(value)
    return bound(value, v := fresh(), body(v))


def bound(value: str, name: str, sql: str) -> str:
    """``sql`` with ``name`` standing for ``value``.

    An aggregate of no elements: its type and nullability are those of what it ends with.  An element of a transform asks its body for both, and
    for the type again where its nullability is asked for, so nested ones would take twice the planning at each level.
    """
    return f"aggregate(array(), {value}, ({name}, {fresh('_')}) -> {name}, {name} -> {sql})"


def each(array: str, body) -> str:
    v = fresh()
    return f"transform({array}, {v} -> {body(v)})"


def each_indexed(array: str, body) -> str:
    v, i = fresh(), fresh("i")
    return f"transform({array}, ({v}, {i}) -> {body(v, i)})"


def keep(array: str, test) -> str:
    v = fresh()
    return f"filter({array}, {v} -> {test(v)})"


def any_of(array: str, test) -> str:
    v = fresh()
    return f"exists({array}, {v} -> {test(v)})"


def flat(array: str, body) -> str:
    return f"flatten({each(array, body)})"


def first(array: str) -> str:
    return f"get({array}, 0)"


def first_value(array: str) -> str:
    """First element that is not NULL."""
    return first(keep(array, lambda v: f"{v} IS NOT NULL"))


def lit(text: str | None) -> str:
    """A SQL string literal with the exact characters of ``text``."""
    if text is None:
        return "CAST(NULL AS STRING)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(value: str, options) -> str:
    return f"{value} IN ({', '.join(lit(o) for o in options)})"


# --- look-ups inside a row -------------------------------------------------------------------------------------------
# Spark searches a map, or an array for an element, from its start.  An index is sorted once and searched by halving, so n look-ups
# among n entries take n log n steps.

def _steps(keys: str) -> str:
    """The powers of two up to the number of keys, largest first."""
    return f"filter(array({', '.join(str(1 << b) for b in range(24, -1, -1))}), p -> p <= size({keys}))"


def sorted_index(entries: str) -> str:
    """STRUCT<keys, vals, steps> of an array of STRUCT<k, v>, for ``looked_up``; of entries with one key the last by value counts."""
    return let(f"array_sort({entries})", lambda s: f"named_struct('keys', {s}.k, 'vals', {s}.v, 'steps', {_steps(s)})")


def sorted_keys(values: str) -> str:
    """STRUCT<keys, steps> of an array of values, for ``count_keys``."""
    return let(f"array_sort({values})", lambda s: f"named_struct('keys', {s}, 'steps', {_steps(s)})")


def count_keys(index: str, value: str, test: str = "<=") -> str:
    """How many keys of an index are at most ``value`` (or less, with ``<``).  Both are names."""
    at, p = fresh("at"), fresh("p")
    return f"aggregate({index}.steps, 0, ({at}, {p}) -> CASE WHEN {at} + {p} <= size({index}.keys) AND {index}.keys[{at} + {p} - 1] {test} {value} THEN {at} + {p} ELSE {at} END)"


def looked_up(index: str, value: str) -> str:
    """The value of a key, NULL when there is none."""
    def found(v: str) -> str:
        return let(count_keys(index, v), lambda n: f"CASE WHEN {n} > 0 THEN CASE WHEN {index}.keys[{n} - 1] = {v} THEN {index}.vals[{n} - 1] END END")
    return let(value, found)


def is_key(index: str, value: str) -> str:
    """Whether an index has a key; false for NULL."""
    def found(v: str) -> str:
        return let(count_keys(index, v), lambda n: f"coalesce({n} > 0 AND {index}.keys[{n} - 1] = {v}, false)")
    return let(value, found)
