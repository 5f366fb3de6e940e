"""Cross-page checks (J1-J6, J18-J23) and the shape of site issues.

A site issue can list a third of all pages, so it is never an array.  Operators give *member rows*: one row per
issue and page, with ``issue_key`` naming the issue.  ``issue_heads`` folds them, with partial aggregation, into one
row per issue: counts and an order-free digest of the pages, no list of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.sql import any_of, col, each, in_list, keep, let, lit
from ..functions.text import context as cut_context
from .rules import RULES, rules
from .skew import hot_keys, salted_join

MEMBER_COLUMNS = ("issue_key", "type", "severity", "category", "source", "message", "context", "seq", "url")


def site_pages(audited: DataFrame) -> DataFrame:
    """The columns of the page table that cross-page checks compare, with the keys they compare them by."""
    return audited.select(
        "seq", "url", "final_url", "status", "redirects", "title", "description", "h1s", "canonical", "hreflang", "headers", "body_bytes",
        col("h1s IS NOT NULL").alias("has_facts"),
        col(urls.page_key("url")).alias("url_key"), col(urls.page_key("final_url")).alias("page_key"),
        col(urls.page_key("coalesce(canonical, final_url)")).alias("canonical_key"), col(urls.origin("final_url")).alias("origin"),
        col("exists(issues, i -> i.type = 'noindex')").alias("noindex"),
    )


def members(rows: DataFrame, kind: str, message: str, context: str, key: list[str], severity: str | None = None,
            source: str | None = None) -> DataFrame:
    """Member rows of one issue type; ``message``, ``context`` and ``key`` are SQL text over ``rows``."""
    rule = RULES[kind]
    parts = ", ".join([lit(kind), *(f"coalesce(CAST({k} AS STRING), '')" for k in key)])
    return rows.select(
        col(f"sha1(concat_ws('\\n', {parts}))").alias("issue_key"), F.lit(kind).alias("type"),
        col(severity or lit(rule["severity"])).alias("severity"), F.lit(rule["category"]).alias("category"),
        col(source or lit(rule["source"])).alias("source"), col(message).alias("message"), col(context).alias("context"), "seq", "url")


def issue_heads(rows: DataFrame) -> DataFrame:
    """One row per site issue: its fields, how many pages it lists, and an id that depends on which ones."""
    fields = [c for c in MEMBER_COLUMNS if c not in ("issue_key", "seq", "url")]
    heads = rows.groupBy("issue_key").agg(
        F.min_by(F.struct(*fields), F.struct("seq", "url")).alias("f"), F.count("*").alias("n_urls"),
        F.sum(col("CAST(conv(left(md5(url), 8), 16, 10) AS BIGINT)")).alias("urls_digest"))
    heads = heads.select("issue_key", "f.*", "n_urls", "urls_digest")
    raw = heads.withColumn("raw_id", col("concat(type, '-', left(sha1(concat_ws('\\n', urls_digest, type, context)), 8))"))
    nth = F.row_number().over(W.partitionBy("raw_id").orderBy("message", "issue_key"))
    return raw.withColumn("nth", nth).withColumn("id", col("CASE WHEN nth = 1 THEN raw_id ELSE concat(raw_id, '-', nth) END")).drop("raw_id", "nth")


# --- duplicates -----------------------------------------------------------------------------------------------------

def duplicates(pages: DataFrame) -> DataFrame:
    """Titles, descriptions and h1s that pages of different canonical groups share, ignoring case."""
    values = (
        "inline(concat(array(named_struct('type', 'duplicate-title', 'value', title)), array(named_struct('type', 'duplicate-description', 'value', "
        "description)), transform(h1s, h -> named_struct('type', 'duplicate-h1', 'value', h))))")
    rows = (pages.filter("has_facts").select("seq", "url", "page_key", "canonical_key", col(values)).filter("value IS NOT NULL")
            .withColumn("value_key", F.lower("value")))
    # One row per (value, group, page) first: a value on a third of all pages is counted in many tasks.
    per_page = rows.groupBy("type", "value_key", "canonical_key", "page_key").agg(F.min(F.struct("seq", "url", "value")).alias("first_seen"))
    per_group = per_page.groupBy("type", "value_key", "canonical_key").agg(F.count("*").alias("n"), F.min("first_seen").alias("first_seen"))
    # A page has one final address and one canonical, but two inputs may land on it from different groups: such a page
    # counts once, so pages are told apart across groups only where a value has several groups.
    shared = per_group.groupBy("type", "value_key").agg(
        F.count("*").alias("groups"), F.min("first_seen")["value"].alias("shown")).filter("groups > 1")
    counted = salted_join(per_page.select("type", "value_key", "page_key"), shared, ["type", "value_key"], spread="page_key")
    page_counts = counted.groupBy("type", "value_key", "page_key").agg(F.first("shown").alias("shown")).groupBy("type", "value_key").agg(
        F.count("*").alias("pages"), F.first("shown").alias("shown"))
    found = salted_join(rows.dropDuplicates(["type", "value_key", "seq", "url"]).drop("value"), page_counts, ["type", "value_key"])
    label = "CASE type WHEN 'duplicate-title' THEN 'title' WHEN 'duplicate-description' THEN 'meta description' ELSE 'h1' END"
    shown = ("CASE type WHEN 'duplicate-title' THEN concat('<title>', shown, '</title>') WHEN 'duplicate-h1' THEN concat('<h1>', shown, '</h1>') "
             "ELSE concat('<meta name=\"description\" content=\"', shown, '\">') END")
    category = f"CASE type WHEN 'duplicate-h1' THEN {lit(RULES['duplicate-h1']['category'])} ELSE 'seo' END"
    source = (f"CASE type WHEN 'duplicate-title' THEN {lit(RULES['duplicate-title']['source'])} WHEN 'duplicate-h1' THEN "
              f"{lit(RULES['duplicate-h1']['source'])} ELSE {lit(RULES['duplicate-description']['source'])} END")
    return found.select(
        col("sha1(concat_ws('\\n', type, value_key))").alias("issue_key"), "type", F.lit("warning").alias("severity"), col(category).alias("category"),
        col(source).alias("source"), col(f"concat('Same ', {label}, ' on ', pages, ' pages')").alias("message"),
        col(cut_context(shown)).alias("context"), "seq", "url")


def canonical_elsewhere(pages: DataFrame) -> DataFrame:
    """Pages whose canonical names another page, once per final page."""
    rows = pages.filter("canonical IS NOT NULL AND canonical_key <> page_key")
    return members(rows, "canonical-elsewhere", lit("Canonical names another address"), cut_context("canonical"), ["page_key"])


# --- language alternates --------------------------------------------------------------------------------------------

def audited_index(pages: DataFrame) -> DataFrame:
    """Every key a page audited as HTML is known by: that of its final address and of each input."""
    html = pages.filter("has_facts")
    return html.select("page_key", col("explode(array_distinct(array(page_key, url_key)))").alias("known_as")).distinct()


def _alternate_edges(pages: DataFrame) -> DataFrame:
    """(page_key, known_as): the alternates that each final page names; its first input speaks for it."""
    html = pages.filter("has_facts")
    first = html.filter("size(hreflang) > 0").groupBy("page_key").agg(F.min_by("hreflang", "seq").alias("hreflang"))
    return first.select("page_key", col(f"explode(array_distinct(transform(hreflang, h -> {urls.page_key('h.href')})))").alias("known_as"))


def hot_alternates(pages: DataFrame) -> list:
    """Addresses that a large share of all pages names as an alternate, such as one x-default of a site."""
    named = pages.filter("has_facts AND size(hreflang) > 0").select(col(f"explode(transform(hreflang, h -> {urls.page_key('h.href')}))").alias("known_as"))
    return hot_keys(named, "known_as")


def alternate_pairs(pages: DataFrame, hot: list | None = None) -> DataFrame:
    """Edges from a page to another audited page it names as an alternate, each once.

    An address that most pages name (``hot``, found by a sketch unless given) is joined in many tasks.
    """
    hot = hot_alternates(pages) if hot is None else hot
    known = audited_index(pages).withColumnRenamed("page_key", "target")
    found = salted_join(_alternate_edges(pages), known, ["known_as"], spread="page_key", hot=("known_as", hot))
    return found.filter("page_key <> target").select(F.col("page_key").alias("source"), "target").distinct()


def hreflang_targets(pages: DataFrame) -> DataFrame:
    """Alternates that do not link back, are noindex, or have a canonical elsewhere."""
    hot = hot_alternates(pages)
    # The pages behind hot addresses: as many as these are, some hundreds at most.
    hot_targets = sorted({r.page_key for r in audited_index(pages).filter(F.col("known_as").isin(hot)).select("page_key").distinct().collect()}) if hot else []
    pairs = alternate_pairs(pages, hot)
    reverse = pairs.select(F.col("target").alias("source"), F.col("source").alias("target"))
    html = pages.filter("has_facts").select("seq", "url", "final_url", "page_key", "canonical_key", "canonical", "noindex")
    facts = html.groupBy("page_key").agg(F.min_by(F.struct("final_url", "noindex", "canonical", "canonical_key"), "seq").alias("p")).select("page_key", "p.*")
    one_sided = pairs.join(reverse, ["source", "target"], "left_anti")
    named = one_sided.join(facts.select(F.col("page_key").alias("source"), F.col("final_url").alias("source_url")), "source")
    named = salted_join(named, facts.select(F.col("page_key").alias("target"), F.col("final_url").alias("target_url")), ["target"], spread="source", hot=("target", hot_targets))
    sides = named.select("source", "target", "source_url", "target_url", col("explode(array(source, target))").alias("page_key"))
    # the other side has a row an input of the page
    inputs = html.select("page_key", "seq", "url")
    own = salted_join(sides, inputs, ["page_key"], spread="source", hot=("page_key", hot_targets))
    missing = members(own, "hreflang-missing-return", lit("Hreflang alternate does not link back"),
                      cut_context("concat(target_url, ' has no hreflang link to ', source_url)"), ["source", "target"])
    bad = facts.filter("noindex OR (canonical IS NOT NULL AND canonical_key <> page_key)").select(
        F.col("page_key").alias("target"), "final_url", "noindex", col("canonical IS NOT NULL AND canonical_key <> page_key").alias("elsewhere"))
    hit = salted_join(pairs, bad, ["target"], spread="source", hot=("target", hot_targets))
    # The target's own inputs and every source that names it.
    listed = hit.select("target", "final_url", "noindex", "elsewhere", col("explode(array(target, source))").alias("page_key")).distinct()
    rows = listed.join(inputs, "page_key")
    noindex = members(rows.filter("noindex"), "hreflang-target-noindex", lit("Hreflang alternate is noindex"), cut_context("final_url"), ["target"])
    moved = members(rows.filter("elsewhere"), "hreflang-target-canonicalised", lit("Hreflang alternate has a canonical elsewhere"),
                    cut_context("final_url"), ["target"])
    return missing.unionByName(noindex).unionByName(moved)


# --- response headers -----------------------------------------------------------------------------------------------

# The directives that govern each use, nearest first.
GOVERNING = {"elements": ("script-src-elem", "script-src", "default-src"), "attributes": ("script-src-attr", "script-src", "default-src"),
             "eval": ("script-src", "default-src"), "framing": ("frame-ancestors",)}
MIN_COMPRESSIBLE_BYTES = 1400
# The grammar of a nonce or hash source.
_BASE64 = "[a-z0-9+/_-]+={0,2}"
NONCE_OR_HASH = f" '(nonce|sha(256|384|512))-{_BASE64}' "


def csp_sources(header: str, use: str) -> str:
    """ARRAY of the source lists that govern a use, one for each policy of the header that restricts it.

    A policy is searched as one string, ``;directive source source;``; a list has a space around each source.  The
    first directive of a name counts, and of the names the nearest one that is there.
    """
    policies = each(f"split(lower({header}), ',')", lambda p: f"concat(';', regexp_replace({p}, r'\\s+', ' '), ';')")
    found = lambda p: " ".join(f"WHEN {p} RLIKE '; ?{name}[ ;]' THEN concat(regexp_extract({p}, '; ?{name}((?: [^;]*)?);', 1), ' ')" for name in GOVERNING[use])
    return keep(let(policies, lambda ps: each(ps, lambda p: f"CASE {found(p)} END")), lambda s: f"{s} IS NOT NULL")


def _granted(header: str, use: str, source: str, unless: str = "false") -> str:
    """Whether each of the policies that govern a use lists the source; what none governs is not granted by a policy."""
    return let(csp_sources(header, use), lambda lists: (
        f"(size({lists}) > 0 AND forall({lists}, s -> instr(s, {lit(f' {source} ')}) > 0 AND NOT ({unless})))"))


def csp_weaknesses(value: str) -> str:
    bound = f"instr(s, {lit(chr(32) + chr(39) + 'strict-dynamic' + chr(39) + chr(32))}) > 0 OR s RLIKE {lit(NONCE_OR_HASH)}"
    inline = " OR ".join(_granted(value, use, "'unsafe-inline'", bound) for use in ("elements", "attributes"))
    evaluated = _granted(value, "eval", "'unsafe-eval'")
    return (f"array_compact(array(CASE WHEN {inline} THEN \"inline scripts ('unsafe-inline' without a nonce or hash)\" END, "
            f"CASE WHEN {evaluated} THEN \"eval ('unsafe-eval')\" END))")


def frame_ancestors(value: str) -> str:
    """STRUCT<restricted, directive> of the frame-ancestors directives, NULL when there is none.

    A source admits any site if nothing, or a star, is left of it without scheme, port and path.
    """
    host = lambda x: f"regexp_replace(regexp_replace({x}, '^[a-z][a-z0-9+.-]*:(//|$)', ''), '[:/].*$', '')"
    closed = lambda s: f"forall(split(trim({s}), ' '), x -> x = '' OR {host('x')} NOT IN ('', '*'))"
    return let(csp_sources(value, "framing"), lambda lists: (
        f"CASE WHEN size({lists}) > 0 THEN named_struct('restricted', exists({lists}, s -> {closed('s')}), 'directive', concat('frame-ancestors', rtrim({lists}[0]))) END"))


def _hsts_on(value: str) -> str:
    """The first header value has one max-age above 0 and no directive twice."""
    parts = f"filter(transform(split(get(split({value}, ','), 0), ';'), d -> trim(d)), d -> d <> '')"
    def judge(ds: str) -> str:
        names = f"transform({ds}, d -> lower(trim(get(split(d, '='), 0))))"
        age = f"get(filter({ds}, d -> lower(trim(get(split(d, '='), 0))) = 'max-age'), 0)"
        digits = f"regexp_extract({age}, r'(?i)^max-age\\s*=\\s*(?:([0-9]+)|\"([0-9]+)\")$', 1)"
        quoted = f"regexp_extract({age}, r'(?i)^max-age\\s*=\\s*(?:([0-9]+)|\"([0-9]+)\")$', 2)"
        return (f"coalesce(size(array_distinct({names})) = size({ds}) AND try_cast(concat({digits}, {quoted}) AS DOUBLE) > 0, false)")
    return let(parts, judge)


def header_findings(headers: str = "headers") -> str:
    """Array of (type, message, context) for the response of one HTML page."""
    h = lambda name: f"{headers}[{lit(name)}]"
    row = lambda kind, message, ctx: f"named_struct('type', {lit(kind)}, 'message', {message}, 'context', {ctx})"
    hsts = (f"CASE WHEN NOT startswith(final_url, 'https:') THEN NULL WHEN {h('strict-transport-security')} IS NULL THEN "
            f"{row('missing-hsts', lit('No Strict-Transport-Security header'), lit('no Strict-Transport-Security'))} "
            f"WHEN NOT {_hsts_on(h('strict-transport-security'))} THEN "
            f"{row('missing-hsts', lit('Strict-Transport-Security has no max-age above 0'), h('strict-transport-security'))} END")
    x = "x-content-type-options"
    nosniff = (f"CASE WHEN lower(trim(get(split({h(x)}, ','), 0))) = 'nosniff' THEN NULL WHEN {h(x)} IS NULL THEN "
               f"{row('missing-x-content-type-options', lit('No X-Content-Type-Options header'), lit('no X-Content-Type-Options'))} ELSE "
               f"{row('missing-x-content-type-options', lit('X-Content-Type-Options is not nosniff'), h(x))} END")
    xfo = h("x-frame-options")
    values = f"array_distinct(transform(split({xfo}, ','), v -> lower(trim(v))))"
    blocks = let(values, lambda vs: (
        f"coalesce(CASE WHEN size({vs}) > 1 THEN exists({vs}, v -> {in_list('v', ('deny', 'sameorigin', 'allowall'))}) "
        f"ELSE {vs}[0] IN ('deny', 'sameorigin') END, false)"))
    xfo_shown = f"coalesce({xfo}, 'no X-Frame-Options')"
    def framing(f: str) -> str:
        only_report = f"{frame_ancestors(h('content-security-policy-report-only'))} IS NOT NULL"
        text = f"CASE WHEN {only_report} THEN 'Page can be framed: frame-ancestors is only reported, not enforced' ELSE 'Page can be framed: no X-Frame-Options or frame-ancestors' END"
        return (f"CASE WHEN {f}.restricted THEN NULL WHEN {f} IS NOT NULL THEN {row('missing-clickjacking-protection', lit('Page can be framed: frame-ancestors admits any site'), f + '.directive')} "
                f"WHEN {blocks} THEN NULL ELSE {row('missing-clickjacking-protection', text, xfo_shown)} END")
    csp = h("content-security-policy")
    weak_text = lambda w: f"concat('Content-Security-Policy allows ', array_join({w}, ' and '))"
    weak = let(csp_weaknesses(csp), lambda w: (
        f"CASE WHEN size({w}) > 0 THEN {row('weak-csp', weak_text(w), csp)} END"))
    packed = f"lower(trim({h('content-encoding')}))"
    plain = (f"CASE WHEN body_bytes >= {MIN_COMPRESSIBLE_BYTES} AND coalesce({packed}, '') IN ('', 'identity') THEN "
             f"{row('no-compression', lit('HTML is sent without compression'), lit('no Content-Encoding'))} END")
    return f"filter(array({hsts}, {nosniff}, {let(frame_ancestors(csp), framing)}, {weak}, {plain}), f -> f IS NOT NULL)"


def response_headers(pages: DataFrame) -> DataFrame:
    """Header findings by origin; the header of the first page is the evidence (J23).  Unknown headers are skipped."""
    known = pages.filter("has_facts AND headers IS NOT NULL")
    rows = known.select("seq", "url", "origin", col(f"inline_outer({header_findings()})")).filter("type IS NOT NULL")
    rule = F.broadcast(_rule_columns(rows.sparkSession))
    rows = rows.join(rule, "type")
    return rows.select(
        col("sha1(concat_ws('\\n', type, origin, message))").alias("issue_key"), "type", "severity", "category", "source", "message",
        col(cut_context("concat(origin, ': ', context)")).alias("context"), "seq", "url")


def _rule_columns(spark) -> DataFrame:
    return rules(spark).select("type", "severity", "category", "source")


#: The checks that need only the pages, each a function from their keys to member rows.
SITE_CHECKS = (duplicates, canonical_elsewhere, hreflang_targets, response_headers)


def site_checks(pages: DataFrame) -> DataFrame:
    """Member rows of the checks that need only the pages."""
    return reduce(DataFrame.unionByName, (check(pages) for check in SITE_CHECKS))
