"""Quality rules: a table of thresholds compiled into one projection of Spark expressions.

Words are runs of ``[^\\x20\\x09-\\x0D]``, lines are cut at ``\\n``.  No user function, shuffle or join: a document is
measured and judged in its own row, so no source or group of copies can be hot.

Base: a document fails with fewer than ``MIN_WORDS`` words, or when over 20 of 100 words lie in a run of five words that
occurs twice or more in the text.  Windows are compared by 64-bit hashes (about 1e-13 chance of a false match for a text of
1 000 words); a text whose windows all differ, which a hash set tells, is done with; only others are sorted.

Cases: a null or empty text has no words, all counts 0, fails the base and is not kept, every ratio being null (a rule on a
ratio without denominator passes).  A null doc_id is handed on.  Repeated rows give repeated rows.  Other columns of the
input are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

#: Frequent function words of the corpus languages, lower case.
STOP_WORDS = ("the be to of and that have with this for was is in it on as by at from "
              "le la les de des du et un une est que qui dans pour avec au "
              "der die das und ist von zu den ein eine nicht mit sich auf "
              "el los las en del y que se por con una su no es al").split()


@dataclass(frozen=True)
class Rule:
    """A measure (a name of ``MEASURES``) and the range in which a document passes; an open end is None."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The default table.  Ratios are shares of words or lines.
RULES = (
    Rule("length", "n_words", MIN_WORDS, 1_000_000),
    Rule("word_length", "mean_word_chars", 2.5, 12),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_word_ratio", 0.03, None),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.3),
    Rule("repeated_lines", "dup_line_ratio", None, 0.334),
    Rule("letters", "letter_word_ratio", 0.7, None),
)


def _share(part: str, whole: str) -> str:
    return f"{part} / nullif({whole}, 0)"


#: Measures by name, over the columns of ``_counted``.
MEASURES = {
    "n_words": "n_words",
    "mean_word_chars": _share("word_chars", "n_words"),
    "symbol_ratio": _share("n_symbols", "n_words"),
    "stop_word_ratio": _share("n_stop_words", "n_words"),
    "bullet_line_ratio": _share("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": _share("n_ellipsis_lines", "n_lines"),
    "dup_line_ratio": _share("n_dup_lines", "n_lines"),
    "letter_word_ratio": _share("n_letter_words", "n_words"),
}


def repeated_words(windows: str, size: int = WINDOW) -> str:
    """SQL text: how many words lie in a window that occurs more than once.

    Windows are sorted by (hash, place), those next to an equal hash are kept by place, and the lengths of their
    union are added up: a window adds ``size`` words, less what the kept window before it covers already.
    """
    ordered = f"sort_array(transform({windows}, (h, i) -> named_struct('h', h, 'i', i)))"
    return f"""
    CASE WHEN size({windows}) <= 1 OR size(array_distinct({windows})) = size({windows}) THEN 0L
    ELSE element_at(transform(array({ordered}), s ->
        element_at(transform(array(sort_array(transform(filter(s, (x, k) ->
            (k > 0 AND get(s, k - 1).h = x.h) OR (get(s, k + 1).h <=> x.h)), x -> x.i))), p ->
            aggregate(zip_with(p, concat(array(-{size}), slice(p, 1, size(p) - 1)), (a, b) -> least({size}, a - b)), 0L, (n, d) -> n + d)), 1)), 1) END"""


def _counted(docs: DataFrame) -> DataFrame:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = text.select("doc_id", "text", F.array_remove(F.split("text", SPACES), "").alias("words"),
                      F.expr(r"filter(split(text, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')").alias("lines"))
    hashed = cut.selectExpr("*", "transform(words, w -> xxhash64(w)) AS hashes")
    places = ", ".join(f"get(hashes, i + {k})" for k in range(WINDOW))
    windowed = hashed.selectExpr(
        "doc_id", "words", "lines",
        f"CASE WHEN size(hashes) > {WINDOW} THEN transform(sequence(0, size(hashes) - {WINDOW}), i -> xxhash64({places})) ELSE array() END AS windows",
        r"CAST(char_length(text) - coalesce(regexp_count(text, '[\\x20\\x09-\\x0D]'), 0) AS BIGINT) AS word_chars",
        "CAST(regexp_count(text, '[#*$%&|<>]') AS BIGINT) AS n_symbols")
    return windowed.selectExpr(
        "doc_id", "CAST(size(words) AS BIGINT) AS n_words", "word_chars", "n_symbols",
        "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT) AS n_dup_lines",
        f"CAST({repeated_words('windows')} AS BIGINT) AS n_repeat_words",
        "CAST(size(lines) AS BIGINT) AS n_lines",
        f"CAST(size(filter(words, w -> lower(w) IN ({stop}))) AS BIGINT) AS n_stop_words",
        "CAST(size(filter(words, w -> w RLIKE '\\\\p{L}')) AS BIGINT) AS n_letter_words",
        r"CAST(size(filter(lines, l -> l RLIKE '^\\s*[-*•]')) AS BIGINT) AS n_bullet_lines",
        r"CAST(size(filter(lines, l -> l RLIKE '(\\.\\.\\.|…)\\s*$')) AS BIGINT) AS n_ellipsis_lines")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, the measures, failed_rules."""
    counts = _counted(docs)
    base = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    tests = []
    for r in rules:
        bounds = [f"m.{r.measure} < {r.least}" if r.least is not None else "", f"m.{r.measure} > {r.most}" if r.most is not None else ""]
        tests.append(f"CASE WHEN {' OR '.join(x for x in bounds if x) or 'false'} THEN '{r.name}' END")
    measures = ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in MEASURES.items())
    measured = counts.selectExpr("*", f"({base}) AS base_failed", f"named_struct({measures}) AS m")
    judged = measured.selectExpr("*", f"array_compact(array({', '.join(tests)})) AS failed_rules" if tests else "CAST(array() AS ARRAY<STRING>) AS failed_rules")
    return judged.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                             "(NOT base_failed AND size(failed_rules) = 0) AS kept",
                             *[f"m.{k} AS {k}" for k in MEASURES if k != "n_words"], "failed_rules")
