"""robots.txt over the audited pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import col, each, keep, let, lit
from ..functions.text import context as cut_context
from ..functions.urls import parts, serialise
from .rules import RULES, SOURCES
from .skew import salted_join

# Crawlers of search products with their names, and tokens that only govern training.
AI_SEARCH = (("OAI-SearchBot", "ChatGPT search", "openaiBots"), ("Claude-SearchBot", "Claude", "anthropicBots"), ("PerplexityBot", "Perplexity", "perplexityBots"))
AI_TRAINING = ("GPTBot", "ClaudeBot", "Google-Extended", "Applebot-Extended", "CCBot")
AGENTS = ("Googlebot", *(a for a, _, _ in AI_SEARCH), *AI_TRAINING)


def is_disallowed(path: str, agent: str, rules: str = "rules") -> str:
    """Whether a rule set keeps an agent out of a path: longest match wins, allow wins a tie."""
    own = f"coalesce({rules}[{lit(agent.lower())}], {rules}['*'])"
    hit = keep(own, lambda r: f"CASE WHEN {r}.regex IS NULL THEN startswith({path}, {r}.pattern) ELSE {path} RLIKE {r}.regex END")
    ranked = each(hit, lambda r: f"named_struct('len', length({r}.pattern), 'allow', {r}.allow)")
    return f"coalesce(NOT array_max({ranked}).allow, false)"


def robots_pages(pages: DataFrame, robots_sets: DataFrame) -> DataFrame:
    """Loaded pages with the state of their origin's robots.txt and the agents it keeps out.

    Rules travel as one bounded row per origin and are tried inside the row, so a page is never multiplied by the
    number of rules; a hot origin is spread by the salted join.
    """
    loaded = pages.filter("status = 200 AND origin IS NOT NULL").select("seq", "url", "final_url", "origin")
    joined = salted_join(loaded, robots_sets, ["origin"], "left")
    path = let(serialise("final_url"), lambda u: let(parts(u), lambda p: f"concat({p}[2], {p}[3])"))
    withpath = joined.withColumn("path", col(path))
    blocked = ", ".join(f"CASE WHEN {is_disallowed('path', a)} THEN {lit(a)} END" for a in AGENTS)
    return withpath.select(
        "seq", "url", "final_url", "origin", F.coalesce("status", F.lit("missing")).alias("robots"), "http_status", "error", "content_signal", "sitemaps",
        col(f"CASE WHEN status = 'ok' THEN filter(array({blocked}), a -> a IS NOT NULL) ELSE CAST(array() AS ARRAY<STRING>) END").alias("blocked"))


def _words(array: str) -> str:
    return (f"CASE WHEN size({array}) < 2 THEN array_join({array}, '') ELSE concat(array_join(slice({array}, 1, size({array}) - 1), ', '), "
            f"' and ', element_at({array}, -1)) END")


def robots_checks(checked: DataFrame) -> DataFrame:
    """Issues of each origin's robots.txt (J9-J11); ``checked`` is ``robots_pages``."""
    file = "concat(origin, '/robots.txt')"
    search = "filter(array(" + ", ".join(f"CASE WHEN array_contains(blocked, {lit(a)}) THEN named_struct('agent', {lit(a)}, 'product', {lit(p)}, 'source', {lit(SOURCES[s])}) END"
                                         for a, p, s in AI_SEARCH) + "), c -> c IS NOT NULL)"
    agents, products = "transform(kept_out, c -> c.agent)", "transform(kept_out, c -> c.product)"
    # A page has one of these issues at most.  The kind and who is kept out leave an outer generator: conditions on them are not moved below it,
    # where the rules of all agents would be tried again for each kind.
    kind = ("CASE robots WHEN 'failed' THEN 'robots-txt-failed' WHEN 'unreachable' THEN 'robots-txt-unreachable' WHEN 'ok' THEN "
            "CASE WHEN array_contains(blocked, 'Googlebot') THEN 'blocked-by-robots' WHEN size(kept_out) > 0 THEN 'ai-search-blocked' END END")
    found = f"inline_outer(transform(array({search}), kept_out -> named_struct('kind', {kind}, 'kept_out', kept_out)))"
    rows = checked.select("seq", "url", "origin", "http_status", "error", col(found)).filter("kind IS NOT NULL")
    texts = {
        "robots-txt-failed": ("concat('robots.txt could not be read (', error, ')')", file, "", None),
        "robots-txt-unreachable": ("concat('robots.txt answered HTTP ', http_status)", file, "", None),
        "blocked-by-robots": (lit("robots.txt keeps Googlebot out of the page"), file, "", None),
        "ai-search-blocked": (f"concat('robots.txt keeps out ', {_words(agents)}, ', so ', {_words(products)}, ' cannot use the page in answers')",
                              cut_context(f"concat({file}, ' disallows ', {_words(agents)})"), f"array_join({agents}, ', ')", "kept_out[0].source"),
    }
    pick = lambda value: "CASE kind " + " ".join(f"WHEN {lit(k)} THEN {value(k)}" for k in texts) + " END"
    keys = pick(lambda k: f"concat_ws('\\n', {lit(k)}, coalesce(origin, '')" + (f", coalesce({texts[k][2]}, '')" if texts[k][2] else "") + ")")
    return rows.select(
        col(f"sha1({keys})").alias("issue_key"), F.col("kind").alias("type"), col(pick(lambda k: lit(RULES[k]["severity"]))).alias("severity"),
        col(pick(lambda k: lit(RULES[k]["category"]))).alias("category"), col(pick(lambda k: texts[k][3] or lit(RULES[k]["source"]))).alias("source"),
        col(pick(lambda k: texts[k][0])).alias("message"), col(pick(lambda k: texts[k][1])).alias("context"), "seq", "url")


def crawler_access(checked: DataFrame) -> DataFrame:
    """allowed, blocked or partial per origin and agent over its audited pages (J12), with the content signal."""
    agents = [a for a in AGENTS if a != "Googlebot"]
    counts = checked.groupBy("origin").agg(
        F.count("*").alias("n"), F.min("robots").alias("robots"), F.min("content_signal").alias("content_signal"),
        *[F.count_if(F.array_contains("blocked", a)).alias(f"b{i}") for i, a in enumerate(agents)])
    access = lambda i: f"CASE WHEN b{i} = 0 THEN 'allowed' WHEN b{i} = n THEN 'blocked' ELSE 'partial' END"
    mapped = lambda names: ("CASE WHEN robots IN ('ok', 'missing') THEN map(" + ", ".join(f"{lit(a)}, {access(agents.index(a))}" for a in names) + ") END")
    return counts.select("origin", F.col("robots").alias("robots_txt"), col(mapped([a for a, _, _ in AI_SEARCH])).alias("ai_search"),
                         col(mapped(AI_TRAINING)).alias("ai_training"), "content_signal")


