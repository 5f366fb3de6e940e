"""Facts and page checks on markup added to every real page.

``seq`` (the page id) picks one of a few variants for each page, so every page takes part and the SQL knows the
outcome from the page id alone.
"""

from __future__ import annotations

from ..functions.sql import col
from ..operators.pages import page_columns
from .common import D_BODY, crawl, d_collapse, d_limit, d_origin, d_unescape, decorated, issues_of

QUERIES, ORACLES = {}, {}


def variants(n: int, **cases: str) -> str:
    """SQL that picks markup by ``seq % n``; ``v0=...`` and so on, '' for the rest."""
    arms = " ".join(f"WHEN {k[1:]} THEN {v}" for k, v in cases.items())
    return f"CASE seq % {n} {arms} ELSE '' END"


def expected(n: int, rows: dict[int, list[tuple[str, ...]]], columns=("type", "severity", "context")) -> str:
    """SQL of the rows each variant gives; values are SQL text over page_id and url."""
    parts = []
    for v, outcomes in rows.items():
        for values in outcomes:
            parts.append(f"SELECT page_id, {', '.join(f'{x} AS {c}' for x, c in zip(values, columns))} FROM pages WHERE page_id % {n} = {v}")
    return " UNION ALL ".join(parts)


def check(name, checks, n, rows, head="''", body="''", columns=("type", "severity", "context"), **crawl_columns):
    """Register a check query: markup by variant, expected issues by variant."""
    def run(spark, sf):
        return issues_of(decorated(spark, sf, head, body, **crawl_columns), *checks, columns=", ".join(columns))
    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = expected(n, rows, columns)


def fact(name, select, sql, head="''", body="''", wanted=(), explode=None, **crawl_columns):
    """Register a fact query over decorated pages."""
    def run(spark, sf):
        df = page_columns(decorated(spark, sf, head, body, **crawl_columns), *wanted)
        if explode:
            df = df.selectExpr("seq", "url", explode)
        return df.selectExpr("seq AS page_id", *select)
    QUERIES[name] = run
    ORACLES[name] = sql


q = lambda text: "'" + text.replace("'", "''") + "'"

# --- head -------------------------------------------------------------------------------------------------------------

DESCRIPTION = variants(
    5, v1="concat('<meta name=\"description\" content=\"Short text ', seq, '\">')", v2="concat('<meta name=description content=\"', repeat('long ', 40), '\">')",
    v3="concat('<meta name=\"Description\" content=\"  \"><META NAME=\"description\" CONTENT=\"', repeat('x', 80), '\">')",
    v4="concat('<meta name=\"description\" content=\"', repeat('y', 100), '\">')")
_LONG = "trim(repeat('long ', 40))"
check("description_checks", ["description"], 5, {
    0: [("'missing-description'", "'warning'", "'<head>'", "CAST(NULL AS DOUBLE)")],
    1: [("'short-description'", "'info'", "'<meta name=\"description\" content=\"Short text ' || page_id || '\">'", "CAST(length('Short text ' || page_id) AS DOUBLE)")],
    2: [("'long-description'", "'info'", d_limit(f"'<meta name=\"description\" content=\"' || {_LONG} || '\">'", 120), "CAST(199 AS DOUBLE)")],
    3: [("'multiple-descriptions'", "'warning'", d_limit("'<meta name=\"description\" content=\"\"> <meta name=\"description\" content=\"' || repeat('x', 80) || '\">'", 120), "CAST(NULL AS DOUBLE)")],
}, head=DESCRIPTION, columns=("type", "severity", "context", "actual_num"))
fact("description", ["description"], f"""SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'Short text ' || page_id WHEN 2 THEN {_LONG} WHEN 3 THEN repeat('x', 80) WHEN 4 THEN repeat('y', 100) END AS description FROM pages""",
     head=DESCRIPTION, wanted=("description",))

CANONICAL = variants(
    6, v1="concat('<link rel=\"canonical\" href=\"https://c.example/p/', seq, '\">')",
    v2="concat('<link rel=canonical href=https://c.example/d>', '<link rel=\"x canonical\" href=\"https://c.example/d\">')",
    v3="concat('<link rel=\"canonical\" href=\"/rel/', seq, '\"><link rel=\"canonical\" href=\"https://c.example/x#f\">')", v4="'<link rel=\"Canonical\" href=\" \">'")
CANONICAL_BODY = variants(6, v5="'<link rel=\"canonical\" href=\"https://c.example/body\">'")
_NULL = "CAST(NULL AS VARCHAR)"
check("canonical_checks", ["canonical"], 6, {
    0: [("'missing-canonical'", "'warning'", "'<head>'", _NULL)],
    2: [("'multiple-canonicals'", "'info'", d_limit("'<link rel=canonical href=https://c.example/d> <link rel=\"x canonical\" href=\"https://c.example/d\">'", 120), "'html > head > link:nth-of-type(1), html > head > link:nth-of-type(2)'")],
    3: [("'multiple-canonicals'", "'warning'", d_limit("'<link rel=\"canonical\" href=\"/rel/' || page_id || '\"> <link rel=\"canonical\" href=\"https://c.example/x#f\">'", 120), "'html > head > link:nth-of-type(1), html > head > link:nth-of-type(2)'"),
        ("'relative-canonical'", "'warning'", "'<link rel=\"canonical\" href=\"/rel/' || page_id || '\">'", "'html > head > link:nth-of-type(1)'"),
        ("'canonical-fragment'", "'warning'", "'<link rel=\"canonical\" href=\"https://c.example/x#f\">'", "'html > head > link:nth-of-type(2)'")],
    4: [("'empty-canonical'", "'warning'", "'<link rel=\"Canonical\" href=\" \">'", "'html > head > link'")],
    5: [("'missing-canonical'", "'warning'", "'<link rel=\"canonical\" href=\"https://c.example/body\">'", "'html > body > link'")],
}, head=CANONICAL, body=CANONICAL_BODY, columns=("type", "severity", "context", "selector"))
fact("canonical", ["canonical"], f"""SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'https://c.example/p/' || page_id WHEN 2 THEN 'https://c.example/d' WHEN 3 THEN {d_origin('url')} || '/rel/' || page_id END AS canonical FROM pages""",
     head=CANONICAL, body=CANONICAL_BODY, wanted=("canonical",))
fact("base_url", ["base_url", "canonical"], f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://b.example/dir/' WHEN 1 THEN {d_origin('url')} || '/in/' ELSE url END AS base_url,
CASE page_id % 3 WHEN 0 THEN 'https://b.example/dir/c' WHEN 1 THEN {d_origin('url')} || '/in/c' ELSE regexp_extract(url, '^https?://[^?#]*/') || 'c' END AS canonical FROM pages""",
     head="concat('<link rel=canonical href=c>', CASE seq % 3 WHEN 0 THEN '<base href=\"https://b.example/dir/x\">' WHEN 1 THEN '<base href=\"/in/\">' ELSE '' END)".replace("dir/x", "dir/"),
     wanted=("base_url", "canonical"))

TITLE = "CASE seq % 4 WHEN 0 THEN '' WHEN 1 THEN '<title> </title>' WHEN 2 THEN concat('<title>', repeat('w', 70), '</title>') ELSE '<svg><title>icon</title></svg>' END"


def _title_checks(spark, sf):
    base = crawl(spark, sf)
    stripped = base.withColumn("html", col(f"replace(regexp_replace(html, '<title>[^<]*</title>', ''), '</head>', concat({TITLE}, '</head>'))"))
    return issues_of(stripped, "title", columns="type, severity, context, actual_num")


QUERIES["title_checks"] = _title_checks
ORACLES["title_checks"] = expected(4, {
    0: [("'missing-title'", "'error'", "'<head>'", "CAST(NULL AS DOUBLE)")], 1: [("'empty-title'", "'error'", "'<title></title>'", "CAST(NULL AS DOUBLE)")],
    2: [("'long-title'", "'warning'", "'<title>' || repeat('w', 70) || '</title>'", "CAST(70 AS DOUBLE)")], 3: [("'missing-title'", "'error'", "'<head>'", "CAST(NULL AS DOUBLE)")],
}, ("type", "severity", "context", "actual_num"))

ROBOTS = variants(
    8, v0="'<meta name=\"robots\" content=\"noindex, nofollow\">'", v1="'<meta name=\"GoogleBot\" content=\"None\">'", v2="'<meta name=robots content=nosnippet>'",
    v3="'<meta name=\"robots\" content=\"max-snippet:50\"><meta name=\"googlebot\" content=\"max-snippet: 20\">'", v4="'<meta name=\"robots\" content=\"NOARCHIVE\">'",
    v5="'<meta name=\"bingbot\" content=\"noarchive, nocache\">'", v6="'<meta name=\"robots\" content=\"max-snippet:-1\">'")
# The header adds to the tags: for every crawler, for one crawler, or with an agent in front.
HEADER = "CASE seq % 3 WHEN 0 THEN 'noindex' WHEN 1 THEN 'bingbot: noindex, nofollow, googlebot: max-snippet:30' END"
_tag = lambda name, content: f"'<meta name=\"{name}\" content=\"{content}\">'"
check("robots_meta_checks", ["robots_meta"], 8, {
    0: [("'noindex'", "'warning'", _tag("robots", "noindex, nofollow")), ("'nofollow'", "'info'", _tag("robots", "noindex, nofollow"))],
    1: [("'noindex'", "'warning'", _tag("GoogleBot", "None")), ("'nofollow'", "'info'", _tag("GoogleBot", "None"))],
}, head=ROBOTS)
QUERIES["robots_header_checks"] = lambda spark, sf: issues_of(decorated(spark, sf, ROBOTS, robots_header=HEADER, status="CASE WHEN seq % 5 = 4 THEN 404 ELSE 200 END"), "response", "robots_meta")
ORACLES["robots_header_checks"] = f"""WITH p AS (SELECT page_id, url, page_id % 8 AS v, page_id % 3 = 0 AS header, page_id % 5 = 4 AS gone FROM pages),
t AS (SELECT *, CASE v WHEN 0 THEN {_tag('robots', 'noindex, nofollow')} WHEN 1 THEN {_tag('GoogleBot', 'None')} END AS tag FROM p)
SELECT page_id, 'http-status' AS type, 'error' AS severity, '' AS context FROM t WHERE gone
UNION ALL SELECT page_id, 'noindex', 'warning', CASE WHEN header AND tag IS NOT NULL THEN 'X-Robots-Tag: noindex and ' || {d_limit('tag', 57)} WHEN header THEN 'X-Robots-Tag: noindex' ELSE tag END FROM t WHERE NOT gone AND (header OR tag IS NOT NULL)
UNION ALL SELECT page_id, 'nofollow', 'info', tag FROM t WHERE NOT gone AND tag IS NOT NULL"""
check("snippet_checks", ["snippets"], 8, {
    2: [("'snippet-restricted'", "'warning'", _tag("robots", "nosnippet"))], 3: [("'snippet-restricted'", "'info'", _tag("googlebot", "max-snippet: 20"))],
    4: [("'copilot-restricted'", "'warning'", _tag("robots", "NOARCHIVE"))], 5: [("'copilot-restricted'", "'info'", _tag("bingbot", "noarchive, nocache"))],
}, head=ROBOTS)
QUERIES["snippet_header_checks"] = lambda spark, sf: issues_of(decorated(spark, sf, robots_header=HEADER), "snippets")
ORACLES["snippet_header_checks"] = """SELECT page_id, 'snippet-restricted' AS type, 'info' AS severity, 'X-Robots-Tag: bingbot: noindex, nofollow, googlebot: max-snippet:30' AS context FROM pages WHERE page_id % 3 = 1"""
fact("robots", ["robots", "robots_header_fact AS robots_header"], """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'noindex, nofollow' WHEN 1 THEN 'none' WHEN 2 THEN 'nosnippet' WHEN 3 THEN 'max-snippet:50, max-snippet: 20'
WHEN 4 THEN 'noarchive' WHEN 6 THEN 'max-snippet:-1' END AS robots, CASE page_id % 3 WHEN 0 THEN 'noindex' WHEN 1 THEN 'bingbot: noindex, nofollow, googlebot: max-snippet:30' END AS robots_header FROM pages""",
     head=ROBOTS, wanted=("robots", "robots_header_fact"), robots_header=HEADER)

SOCIAL = "concat(" + variants(
    4, v1="'<meta property=\"og:title\" content=\"T\">'",
    v2="concat('<meta property=\"og:title\" content=\" \"><meta property=\"OG:title\" content=\"Title ', seq, '\"><meta property=\"og:description\" content=\"D\"><meta property=\"og:image\" content=\"https://i.example/', seq, '.png\">')",
    v3="'<meta name=\"og:title\" content=\"N\"><meta name=\"og:description\" content=\"D\"><meta property=\"og:type\" content=\"article\"><meta property=\"og:image\" content=\"\">'") + \
    ", CASE seq % 3 WHEN 0 THEN '<meta name=\"twitter:card\" content=\"summary\">' WHEN 1 THEN '<meta property=\"twitter:card\" content=\"player\">' ELSE '' END, CASE seq % 2 WHEN 0 THEN '<meta name=\"viewport\" content=\"width=device-width\"><meta name=author content=\"Ann B\">' ELSE '' END)"
QUERIES["social_checks"] = lambda spark, sf: issues_of(decorated(spark, sf, SOCIAL), "social", "viewport_and_lang")
ORACLES["social_checks"] = """SELECT page_id, 'missing-open-graph' AS type, 'info' AS severity, '<head>' AS context FROM pages WHERE page_id % 4 = 0
UNION ALL SELECT page_id, 'incomplete-open-graph', 'info', '<meta property="og:description" content="...">' FROM pages WHERE page_id % 4 = 1
UNION ALL SELECT page_id, 'incomplete-open-graph', 'info', '<meta property="og:image" content="...">' FROM pages WHERE page_id % 4 = 3
UNION ALL SELECT page_id, 'missing-twitter-card', 'info', '<meta name="twitter:card" content="summary_large_image">' FROM pages WHERE page_id % 3 = 2
UNION ALL SELECT page_id, 'missing-viewport', 'warning', '<meta name="viewport" content="width=device-width, initial-scale=1">' FROM pages WHERE page_id % 2 = 1"""
fact("meta_content", ["open_graph.title AS og_title", "open_graph.description AS og_description", "open_graph.image AS og_image", "open_graph.type AS og_type", "twitter_card", "viewport", "author", "lang"],
     """SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'T' WHEN 2 THEN 'Title ' || page_id WHEN 3 THEN 'N' END AS og_title, CASE WHEN page_id % 4 >= 2 THEN 'D' END AS og_description,
CASE page_id % 4 WHEN 2 THEN 'https://i.example/' || page_id || '.png' END AS og_image, CASE page_id % 4 WHEN 3 THEN 'article' END AS og_type, CASE page_id % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'player' END AS twitter_card,
CASE page_id % 2 WHEN 0 THEN 'width=device-width' END AS viewport, CASE page_id % 2 WHEN 0 THEN 'Ann B' END AS author, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""",
     head=SOCIAL, wanted=("open_graph", "twitter_card", "viewport", "author", "lang"))

ALTERNATES = variants(
    6, v0="concat('<link rel=\"alternate\" hreflang=\"en\" href=\"', split(url, '#')[0], '\"><link rel=\"alternate\" hreflang=\"x-default\" href=\"https://d.example/\">')",
    v1="concat('<link rel=\"alternate\" hreflang=\"en-UK\" href=\"/uk/\"><link rel=\"alternate\" hreflang=\"fi\" href=\"', split(url, '#')[0], '\">')",
    v2="concat('<link rel=\"alternate\" hreflang=\"X-Default\" href=\"', split(url, '#')[0], '\"><link rel=\"alternate\" hreflang=\"fr\" href=\"https://f.example/a/\"><link rel=\"alternate\" hreflang=\"FR\" href=\"https://f.example/a\">')",
    v3="'<link rel=\"alternate\" hreflang=\"zh-Hant-TW\" href=\"https://f.example/1\"><link rel=\"alternate\" hreflang=\"zh-Hant-TW\" href=\"https://f.example/2\"><link rel=\"alternate\" hreflang=\"es-419\" href=\"https://f.example/3\">'",
    v4="'<link rel=\"stylesheet alternate\" hreflang=\"eng\" href=\"\">'")
_L = lambda lang, href: f"'<link rel=\"alternate\" hreflang=\"{lang}\" href=\"{href}\">'"
check("hreflang_checks", ["hreflang"], 6, {
    1: [("'invalid-hreflang'", "'warning'", _L("en-UK", "/uk/")), ("'relative-hreflang'", "'warning'", _L("en-UK", "/uk/")), ("'missing-x-default'", "'info'", "'<head>'")],
    2: [("'duplicate-hreflang'", "'info'", d_limit(f"{_L('fr', 'https://f.example/a/')} || ' ' || {_L('FR', 'https://f.example/a')}", 120))],
    3: [("'duplicate-hreflang'", "'warning'", d_limit(f"{_L('zh-Hant-TW', 'https://f.example/1')} || ' ' || {_L('zh-Hant-TW', 'https://f.example/2')}", 120)),
        ("'missing-self-hreflang'", "'warning'", "url"), ("'missing-x-default'", "'info'", "'<head>'")],
    4: [("'invalid-hreflang'", "'warning'", "'<link rel=\"stylesheet alternate\" hreflang=\"eng\" href=\"\">'"), ("'relative-hreflang'", "'warning'", "'<link rel=\"stylesheet alternate\" hreflang=\"eng\" href=\"\">'"),
        ("'missing-x-default'", "'info'", "'<head>'")],
}, head=ALTERNATES)
fact("hreflang", ["l.lang AS lang", "l.href AS href"], f"""SELECT page_id, unnest(CASE page_id % 6 WHEN 0 THEN ['en', 'x-default'] WHEN 1 THEN ['en-UK', 'fi'] WHEN 2 THEN ['X-Default', 'fr', 'FR'] WHEN 3 THEN ['zh-Hant-TW', 'zh-Hant-TW', 'es-419'] WHEN 4 THEN ['eng'] ELSE [] END) AS lang,
unnest(CASE page_id % 6 WHEN 0 THEN [regexp_replace(url, '#.*$', ''), 'https://d.example/'] WHEN 1 THEN [{d_origin('url')} || '/uk/', regexp_replace(url, '#.*$', '')] WHEN 2 THEN [regexp_replace(url, '#.*$', ''), 'https://f.example/a/', 'https://f.example/a']
WHEN 3 THEN ['https://f.example/1', 'https://f.example/2', 'https://f.example/3'] WHEN 4 THEN [regexp_replace(url, '#.*$', '')] ELSE [] END) AS href FROM pages""",
     head=ALTERNATES, wanted=("hreflang",), explode="explode(hreflang) AS l")

ESCAPED = variants(4, v0="'<meta name=\"description\" content=\"Made with love &amp;lt;3 &amp;amp; AT&amp;T &amp;R;\">'", v1="concat('<meta property=\"og:title\" content=\"', repeat('z', 150), '&amp;#8226;\">')",
                   v2="'<meta name=\"twitter:title\" content=\"Q&amp;A\">'")
_CUT = "'<meta property=\"og:title\" content=\"' || repeat('z', 150) || '&amp;#8226;\">'"
_TEXT_AT = len('<meta property="og:title" content="')
_END = _TEXT_AT + 150 + len("&amp;#8226;") + 2
_TAIL = 120 - _TEXT_AT - 3
check("escaped_text_checks", ["escaped_text"], 4, {
    0: [("'double-escaped-text'", "'warning'", "'<meta name=\"description\" content=\"Made with love &amp;lt;3 &amp;amp; AT&amp;T &amp;R;\">'", "'&lt;, &amp;'")],
    1: [("'double-escaped-text'", "'info'", f"left({_CUT}, {_TEXT_AT}) || '...' || right({_CUT}, {_TAIL})", "'&#8226;'")],
}, head=ESCAPED, columns=("type", "severity", "context", "actual"))

# --- body -------------------------------------------------------------------------------------------------------------

IMAGES = "concat('<section>', " + variants(
    8, v0="'<img src=\"/u/IMG_00023.JPG\" alt=\"A dog\" width=1 height=1>'", v1="'<img src=\"/u/puppy.jpg\" alt=\"Puppy.jpg\" width=1 height=1>'", v2="'<img alt=\"no source\" width=1 height=1>'",
    v3="'<a href=\"/cart\"><img src=\"/i/cart.svg\" alt=\"\" width=1 height=1></a>'", v4="'<a href=\"/home\"><img src=\"/i/home.svg\" alt=\"\" width=1 height=1> Home</a>'",
    v5="'<img src=\"/i/swirl.png\" width=1>'", v6="'<button aria-label=\"Go\"><img src=\"/i/go.png\" alt=\"\" width=1 height=1></button>'", v7="'<img :src=\"x\" :alt=\"y\" width=1 height=1>'") + ", '</section>')"
_I = lambda html: q(html)
check("image_checks", ["images"], 8, {
    0: [("'generic-filename'", "'info'", _I('<img src="/u/IMG_00023.JPG" alt="A dog" width=1 height=1>'), "'html > body > section > img'")],
    1: [("'alt-is-filename'", "'warning'", _I('<img src="/u/puppy.jpg" alt="Puppy.jpg" width=1 height=1>'), "'html > body > section > img'")],
    2: [("'missing-src'", "'warning'", _I('<img alt="no source" width=1 height=1>'), "'html > body > section > img'")],
    3: [("'empty-alt-in-link'", "'error'", _I('<img src="/i/cart.svg" alt="" width=1 height=1>'), "'html > body > section > a > img'")],
    4: [("'empty-alt'", "'info'", _I('<img src="/i/home.svg" alt="" width=1 height=1>'), "'html > body > section > a > img'")],
    5: [("'missing-alt'", "'error'", _I('<img src="/i/swirl.png" width=1>'), "'html > body > section > img'"), ("'missing-dimensions'", "'warning'", _I('<img src="/i/swirl.png" width=1>'), "'html > body > section > img'")],
    6: [("'empty-alt'", "'info'", _I('<img src="/i/go.png" alt="" width=1 height=1>'), "'html > body > section > button > img'")],
}, body=IMAGES, columns=("type", "severity", "context", "selector"))
fact("image_counts", ["CAST(image_counts.total AS BIGINT) AS total", "CAST(image_counts.missing_alt AS BIGINT) AS missing_alt"],
     "SELECT page_id, CAST(1 AS BIGINT) AS total, CAST(CASE WHEN page_id % 8 = 5 THEN 1 ELSE 0 END AS BIGINT) AS missing_alt FROM pages", body=IMAGES, wanted=("image_counts",))
SAMPLES = ("concat('<figure><img src=\"/f/', seq, '.png\" alt=\" two  words \"><figcaption>Figure <b>', seq, '</b></figcaption></figure><p>Before <i>it</i> ', "
           "'<img src=\"data:image/png;base64,', repeat('A', 100), '\"> after it</p><div>', repeat('word ', 40), '<img src=\"x y.png\" alt=\"\">', ' tail</div>')")
fact("image_samples", ["s.src AS src", "s.alt AS alt", "s.context AS context"], f"""
SELECT page_id, {d_origin('url')} || '/f/' || page_id || '.png' AS src, 'two words' AS alt, 'Figure ' || page_id AS context FROM pages
UNION ALL SELECT page_id, left('data:image/png;base64,' || repeat('A', 100), 57) || '...', NULL, 'Before it after it' FROM pages
UNION ALL SELECT page_id, regexp_extract(url, '^https?://[^?#]*/') || 'x%20y.png', '', trim(repeat('word ', 15)) || ' tail' FROM pages""",
     body=SAMPLES, wanted=("image_samples",), explode="explode(image_samples) AS s")

FORMS = variants(
    8, v0="'<input name=a>'", v1="'<label>Name <input name=a></label>'", v2="'<label for=f1>Name</label><input id=f1>'", v3="'<label for=f1> </label><select id=f1></select>'",
    v4="'<textarea aria-label=\"Text\"></textarea><input type=hidden><input type=\"SUBMIT\">'", v5="'<span id=n1>Name</span><input aria-labelledby=\"zz n1\">'", v6="'<input aria-labelledby=\"nope\">'",
    v7="'<label>Both <input title=\"\"><input name=second></label>'")
check("form_label_checks", ["form_labels"], 8, {
    0: [("'form-input-no-label'", "'error'", q("<input name=a>"), "'Form field has no label'")], 3: [("'form-input-no-label'", "'error'", q("<select id=f1></select>"), "'Form field has no label'")],
    6: [("'form-input-no-label'", "'error'", q('<input aria-labelledby="nope">'), "'Form field is unnamed, its aria-labelledby names nothing'")],
    7: [("'form-input-no-label'", "'error'", q("<input name=second>"), "'Form field has no label'")],
}, body=FORMS, columns=("type", "severity", "context", "message"))

IDS = variants(4, v0="'<p id=a></p><div id=a></div>'", v1="'<label for=\"b c\">x</label><input id=b><input id=b>'", v2="'<p id=\"\"></p><p id=\"\"></p><p id=one></p>'", v3="'<p id=t></p><p id=t></p><p id=t aria-describedby=\"t\"></p>'")
check("duplicate_id_checks", ["duplicate_ids"], 4, {
    0: [("'duplicate-id'", "'warning'", "'best-practice'", q("<p id=a></p>"), "'html > body > p'")], 1: [("'duplicate-id'", "'error'", "'accessibility'", q("<input id=b>"), "'html > body > input:nth-of-type(1)'")],
    3: [("'duplicate-id'", "'error'", "'accessibility'", q("<p id=t></p>"), "'html > body > p:nth-of-type(1)'")],
}, body=IDS, columns=("type", "severity", "category", "context", "selector"))

LINKS = "concat('<section>', " + variants(
    8, v0="'<a href=\"/x\"></a>'", v1="'<a href=\"/x\">Read  more!</a>'", v2="'<a href=\"#\">Open menu</a>'", v3="'<a href=\"javascript:void(0);doSomething()\">Go</a>'", v4="'<a href=\"/x\" aria-hidden=\"true\"></a><a name=y></a>'",
    v5="'<a href=\"/x\"><img src=a.png alt=\"\"></a><a href=\"/y\" title=\"Y\"></a>'", v6="'<a href=\"/x\"><span hidden>here</span><svg><title>Icon</title><text>t</text></svg></a>'", v7="'<a href=\"/x\" aria-label=\"HERE\">long text</a>'") + ", '</section>')"
check("link_checks", ["links"], 8, {
    0: [("'link-no-name'", "'error'", "'accessibility'", q('<a href="/x"></a>'))], 1: [("'link-generic-text'", "'info'", "'accessibility'", q('<a href="/x">Read more!</a>'))],
    2: [("'link-empty-href'", "'info'", "'best-practice'", q('<a href="#">Open menu</a>'))], 3: [("'link-empty-href'", "'info'", "'best-practice'", q('<a href="javascript:void(0);doSomething()">Go</a>'))],
    7: [("'link-generic-text'", "'info'", "'accessibility'", q('<a href="/x" aria-label="HERE">long text</a>'))],
}, body=LINKS, columns=("type", "severity", "category", "context"))


def _names(spark, sf):
    from ..operators.markup import accessible_name, named_by_script
    body = ("concat('<div id=lab>La<b>bel</b> ', seq, '<i hidden>no</i></div><a id=t href=1 aria-labelledby=\"lab zz\">x</a><a id=t href=2 aria-label=\" Own  label \">x</a>"
            "<a id=t href=3><img alt=\"Pic ', seq, '\"><span aria-label=\"in\">out</span><noscript>n</noscript><i aria-hidden=true>h</i></a><a id=t href=4 title=\"Tip\"><svg><g><title>deep</title></g></svg></a>"
            "<a id=t href=5 v-text=\"name\"></a>')")
    df = page_columns(decorated(spark, sf, body=body), "anchors", "nodes", "bound", "svg_title", "id_pre", "label_targets", "label_names", "label_facts")
    rows = f"filter(transform(anchors, a -> nodes[a.pre]), n -> n.attrs['id'] = 't')"
    named = f"transform({rows}, n -> named_struct('link', n.attrs['href'], 'name', {accessible_name('n')}, 'bound', {named_by_script('n')}))"
    return df.select(col("seq").alias("page_id"), col(f"inline({named})"))


QUERIES["accessible_name"] = _names
ORACLES["accessible_name"] = """SELECT page_id, '1' AS link, 'La bel ' || page_id AS name, false AS bound FROM pages UNION ALL SELECT page_id, '2', 'Own label', false FROM pages
UNION ALL SELECT page_id, '3', 'Pic ' || page_id || ' in', false FROM pages UNION ALL SELECT page_id, '4', 'deep', false FROM pages UNION ALL SELECT page_id, '5', '', true FROM pages"""

HEADINGS = variants(5, v0="'<h2>Two</h2><h4>Four</h4><h2></h2>'", v1="'<h1>Another</h1><h3><img alt=\"pic\" src=x></h3>'", v2="'<h3>Three</h3>'", v3="'<h2 aria-label=\"x\"></h2><h2><noscript>t</noscript></h2>'", v4="'<h2 v-html=\"y\"></h2><h3>ok</h3>'")
_DRIVER_H1 = "'<h1>' || " + d_collapse(d_unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")) + " || '</h1>'"
check("heading_checks", ["headings"], 5, {
    0: [("'skipped-heading-level'", "'warning'", q("<h4>Four</h4>")), ("'empty-heading'", "'warning'", q("<h2></h2>"))],
    1: [("'multiple-h1'", "'info'", d_limit(f"'<h1>Another</h1> ' || {_DRIVER_H1}", 120)), ("'skipped-heading-level'", "'warning'", q("<h3></h3>"))],
    2: [("'skipped-heading-level'", "'warning'", q("<h3>Three</h3>"))], 3: [("'empty-heading'", "'warning'", q("<h2><noscript>t</noscript></h2>"))],
}, body=HEADINGS)
NO_H1 = "regexp_replace(html, '(?s)<h1>.*?</h1>', '')"
QUERIES["missing_h1"] = lambda spark, sf: issues_of(crawl(spark, sf).withColumn("html", col(NO_H1)), "headings")
ORACLES["missing_h1"] = "SELECT page_id, 'missing-h1' AS type, 'warning' AS severity, '<body>' AS context FROM pages"

EVIDENCE = "concat('<section><p id=\"u', seq, '\"><img   src=\"/i/', seq, '.png\"></p><ul><li>a<li><img src=b></ul></section>')"
QUERIES["evidence"] = lambda spark, sf: issues_of(decorated(spark, sf, body=EVIDENCE), "images", columns="type, selector, html, parent_html")
ORACLES["evidence"] = """SELECT page_id, unnest(['missing-alt', 'missing-dimensions']) AS type, '#u' || page_id || ' > img' AS selector, '<img src="/i/' || page_id || '.png">' AS html, '<p id="u' || page_id || '"><img src="/i/' || page_id || '.png"></p>' AS parent_html FROM pages
UNION ALL SELECT page_id, unnest(['missing-alt', 'missing-dimensions']), 'html > body > section > ul > li:nth-of-type(2) > img', '<img src=b>', '<li><img src=b>' FROM pages"""

MIXED = variants(6, v0="'<img src=\"http://i.example/a.png\">'", v1="'<script src=\"//s.example/a.js\"></script>'", v2="'<source srcset=\"https://a.example/1 1x, http://a.example/2 2x\">'", v3="'<iframe src=\"http://localhost/x\"></iframe>'",
                 v4="'<link rel=\"preload stylesheet\" href=\"http://c.example/c.css\">'", v5="'<a href=\"http://x.example/\">x</a>'")
QUERIES["mixed_content_checks"] = lambda spark, sf: issues_of(decorated(spark, sf, body=MIXED), "mixed_content")
ORACLES["mixed_content_checks"] = """SELECT page_id, 'mixed-content' AS type, 'warning' AS severity, CASE page_id % 6 WHEN 0 THEN '<img src="http://i.example/a.png">' WHEN 2 THEN '<source srcset="https://a.example/1 1x, http://a.example/2 2x">'
WHEN 4 THEN '<link rel="preload stylesheet" href="http://c.example/c.css">' END AS context FROM pages WHERE page_id % 6 IN (0, 2, 4) AND starts_with(url, 'https:')"""

SHELL = "concat('<html lang=en><head><title>t</title></head><body>', CASE seq % 5 WHEN 0 THEN '<div id=\"root\"></div>' WHEN 1 THEN '<div id=app><p>text</p></div>' WHEN 2 THEN '<div id=\"__next\"></div><main>content</main>' " \
        "WHEN 3 THEN '<noscript>Please enable JavaScript.</noscript>' ELSE concat('<div id=root></div>', repeat('word ', 30)) END, '</body></html>')"
QUERIES["client_side_checks"] = lambda spark, sf: issues_of(crawl(spark, sf).withColumn("html", col(SHELL)), "client_side")
ORACLES["client_side_checks"] = """SELECT page_id, 'client-side-rendered' AS type, 'info' AS severity, CASE page_id % 5 WHEN 0 THEN '<div id="root"></div>' ELSE '<noscript>' END AS context FROM pages WHERE page_id % 5 IN (0, 3)"""

BLOCKS = "concat('<main>', CASE seq % 2 WHEN 0 THEN '<script>no()</script>' ELSE concat('Main<p>para</p>gra<b>ph</b> ', seq, '<svg><text>no</text></svg><nav>menu</nav>') END, '</main><div data-nosnippet>a</div><p data-nosnippet>b</p><section data-nosnippet></section>')"
fact("main_area", ["main_area AS area", "CASE WHEN seq % 2 = 1 THEN main_text END AS text", "CAST(nosnippet_elements AS BIGINT) AS nosnippet"],
     "SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'article' ELSE 'main' END AS area, CASE page_id % 2 WHEN 1 THEN 'Main para gra ph ' || page_id || ' menu' END AS text, CAST(2 AS BIGINT) AS nosnippet FROM pages",
     body=BLOCKS, wanted=("main_area", "main_text", "nosnippet_elements"))
QUERIES["body_text"] = lambda spark, sf: page_columns(crawl(spark, sf).withColumn("html", col("regexp_replace(regexp_replace(html, '<article>', '<section>'), '</article>', '</section>')")), "main_area", "main_text").selectExpr(
    "seq AS page_id", "main_area AS area", "main_text")
_PLAIN = d_collapse(d_unescape(f"regexp_replace(regexp_replace(regexp_replace({D_BODY}, '(?s)<nav>.*</nav>', ''), '(?s)<footer>.*$', ''), '<[^>]*>', ' ', 'g')"))
ORACLES["body_text"] = f"SELECT page_id, 'body' AS area, {d_limit(_PLAIN, 1500)} AS main_text FROM pages"

LINKED = ("concat('<a href=\"https://www.', regexp_replace(split(split(url, '://')[1], '[/?#]')[0], '^www\\\\.', ''), '/in#x\" rel=\"nofollow ugc\">In <b>side</b></a><a href=\"mailto:a@b.example\">m</a><a href=\"#top\">t</a>"
          "<a href=\"//out.example/p q\"><img alt=\"Out  pic\"></a><a href=\"\">self</a>')")
QUERIES["link_kinds"] = lambda spark, sf: page_columns(decorated(spark, sf, body=LINKED), "page_links").selectExpr("seq AS page_id", "inline(slice(page_links, 1, 3))")
ORACLES["link_kinds"] = """SELECT page_id, 'https://www.' || regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') || '/in#x' AS href, 'In side' AS text, true AS internal, true AS nofollow FROM pages
UNION ALL SELECT page_id, regexp_extract(url, '^https?:') || '//out.example/p%20q', 'Out pic', false, false FROM pages UNION ALL SELECT page_id, regexp_replace(url, '#.*$', ''), 'self', true, false FROM pages"""

# --- address and response ---------------------------------------------------------------------------------------------

CLEAN = "concat('https://h.example/p/', seq, CASE seq % 4 WHEN 0 THEN '' WHEN 1 THEN '/snake_case%20x' WHEN 2 THEN '/%C3%84%zz' ELSE concat('/', repeat('%C3%A4', 120)) END)"
QUERIES["address_checks"] = lambda spark, sf: issues_of(decorated(spark, sf, final_url=CLEAN), "address", columns="type, severity, context, actual_num")
ORACLES["address_checks"] = f"""SELECT page_id, 'url-underscores' AS type, 'info' AS severity, '/p/' || page_id || '/snake_case%20x' AS context, CAST(NULL AS DOUBLE) AS actual_num FROM pages WHERE page_id % 4 = 1
UNION ALL SELECT page_id, 'long-url', 'info', {d_limit("'https://h.example/p/' || page_id || '/' || repeat('ä', 120)", 120)}, CAST(length('https://h.example/p/' || page_id || '/') + 120 AS DOUBLE) FROM pages WHERE page_id % 4 = 3"""
HOPS = ("CASE seq % 3 WHEN 1 THEN array(named_struct('url', url, 'status', 301, 'location', 'https://r.example/1')) WHEN 2 THEN array(named_struct('url', url, 'status', 302, 'location', 'https://r.example/1'), "
        "named_struct('url', 'https://r.example/1', 'status', 301, 'location', 'https://r.example/2')) ELSE CAST(array() AS ARRAY<STRUCT<url: STRING, status: INT, location: STRING>>) END")
QUERIES["response_checks"] = lambda spark, sf: issues_of(decorated(
    spark, sf, redirects=HOPS, status="CASE WHEN seq % 4 = 1 THEN 410 ELSE 200 END", content_type="CASE WHEN seq % 4 = 2 THEN 'application/pdf' ELSE 'TEXT/HTML' END",
    error="CASE WHEN seq % 4 = 3 THEN 'timeout' END", final_url="CASE WHEN seq % 3 = 0 THEN url ELSE concat('https://r.example/', seq % 3) END"), "response", columns="type, severity, message, context")
ORACLES["response_checks"] = f"""WITH p AS (SELECT page_id, url, page_id % 4 AS v, page_id % 3 AS r FROM pages)
SELECT page_id, 'fetch-failed' AS type, 'error' AS severity, 'Page could not be loaded: timeout' AS message, '' AS context FROM p WHERE v = 3
UNION ALL SELECT page_id, 'redirect', 'info', 'Redirects (301), the final address was checked', {d_limit("url || ' -> https://r.example/1'", 120)} FROM p WHERE v <> 3 AND r = 1
UNION ALL SELECT page_id, 'redirect-chain', 'warning', 'Redirects 2 times (302, 301)', {d_limit("url || ' -> https://r.example/1 -> https://r.example/2'", 120)} FROM p WHERE v <> 3 AND r = 2
UNION ALL SELECT page_id, 'http-status', 'error', 'HTTP status 410, page checks skipped', CASE WHEN r = 0 THEN '' ELSE 'https://r.example/' || r END FROM p WHERE v = 1
UNION ALL SELECT page_id, 'not-html', 'info', 'Not HTML (content type application/pdf), page checks skipped', CASE WHEN r = 0 THEN '' ELSE 'https://r.example/' || r END FROM p WHERE v = 2"""
BIG = "CASE WHEN seq % 50 = 7 THEN concat(html, repeat('ä', 1100000)) ELSE html END"
QUERIES["html_size_checks"] = lambda spark, sf: issues_of(crawl(spark, sf).withColumn("html", col(BIG)), "html_size")
ORACLES["html_size_checks"] = "SELECT page_id, 'html-too-large' AS type, 'warning' AS severity, 'more than 2097152 bytes' AS context FROM pages WHERE page_id % 50 = 7"

PLATFORM = variants(
    8, v0="'<link rel=\"stylesheet\" href=\"//cdn.shopify.com/s/a.css\"><script>var a = 1; Shopify.theme = {\"name\":\"Copy {x}\",\"schema_name\":\"Dawn; 2\"};</script>'", v1="'<link rel=\"preload\" href=\"/blog/wp-content/themes/twenty/style.css\">'",
    v2="'<meta name=\"generator\" content=\"Wix.com Website Builder\">'", v3="'<script src=\"https://static1.squarespace.com/a.js\"></script>'", v4="'<meta name=\"generator\" content=\"Webflow\">'", v5="'<a href=\"https://cdn.shopify.com/x\">x</a>'",
    v6="'<meta name=\"generator\" content=\"WordPress 6\"><script type=\"application/json\">Shopify.theme = {}</script>'")
_NAME = "CASE page_id % 8 WHEN 0 THEN 'Shopify' WHEN 1 THEN 'WordPress' WHEN 2 THEN 'Wix' WHEN 3 THEN 'Squarespace' WHEN 4 THEN 'Webflow' WHEN 6 THEN 'WordPress' END"
_THEME = "CASE page_id % 8 WHEN 0 THEN 'Dawn; 2' WHEN 1 THEN 'twenty' END"
fact("platform", ["platform.name AS name", "platform.theme AS theme"], f"SELECT page_id, {_NAME} AS name, {_THEME} AS theme FROM pages", head=PLATFORM, wanted=("platform",))


def _origin_platform(spark, sf):
    from ..operators.platform import origin_platform
    return origin_platform(page_columns(decorated(spark, sf, PLATFORM), "platform"))


QUERIES["origin_platform"] = _origin_platform
ORACLES["origin_platform"] = f"""WITH p AS (SELECT page_id, {d_origin('url')} AS origin, {_NAME} AS name, {_THEME} AS theme FROM pages),
n AS (SELECT origin, name, count(*) AS c, min(page_id) AS s FROM p WHERE name IS NOT NULL GROUP BY ALL), b AS (SELECT origin, name FROM n QUALIFY row_number() OVER (PARTITION BY origin ORDER BY c DESC, s) = 1),
t AS (SELECT origin, name, theme, count(*) AS c, min(page_id) AS s FROM p WHERE theme IS NOT NULL GROUP BY ALL), bt AS (SELECT origin, name, theme FROM t QUALIFY row_number() OVER (PARTITION BY origin, name ORDER BY c DESC, s) = 1)
SELECT b.origin, b.name, bt.theme FROM b LEFT JOIN bt ON b.origin = bt.origin AND b.name = bt.name"""

# --- rules that the queries above do not produce -----------------------------------------------------------------------

QUERIES["missing_lang"] = lambda spark, sf: issues_of(crawl(spark, sf).withColumn("html", col("CASE seq % 3 WHEN 0 THEN regexp_replace(html, '<html[^>]*>', '<html>') WHEN 1 THEN regexp_replace(html, '<html[^>]*>', '<html lang=>') ELSE html END")), "viewport_and_lang").filter("type = 'missing-lang'")
ORACLES["missing_lang"] = "SELECT page_id, 'missing-lang' AS type, 'warning' AS severity, '<html>' AS context FROM pages WHERE page_id % 3 < 2"
QUERIES["url_uppercase"] = lambda spark, sf: issues_of(crawl(spark, sf).withColumn("final_url", col("concat('https://Host', seq % 2, '.example/', CASE seq % 3 WHEN 0 THEN 'Up' WHEN 1 THEN 'low?Q=A' ELSE 'low%2F' END, '/', seq)")), "address").filter("type = 'url-uppercase'")
ORACLES["url_uppercase"] = "SELECT page_id, 'url-uppercase' AS type, 'info' AS severity, '/Up/' || page_id AS context FROM pages WHERE page_id % 3 = 0"
