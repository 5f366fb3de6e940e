"""The shop or site builder a page runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.sql import any_of, each, in_list, keep, let, lit
from ..functions.text import clean
from .families import named
from .markup import attr, has_attr, own_tokens, trimmed_attr

# What each platform leaves in the pages it serves, in the order they are tried.
PLATFORMS = {
    "Shopify": {"hosts": ("cdn.shopify.com",), "path": "^/cdn/shop/", "generator": None, "inline": r"\bShopify\.(theme|shop)\s*="},
    "WordPress": {"hosts": (), "path": "/wp-(content|includes)/", "generator": "wordpress", "inline": None},
    "Wix": {"hosts": ("wixstatic.com", "parastorage.com"), "path": None, "generator": "wix.com", "inline": None},
    "Squarespace": {"hosts": ("squarespace.com",), "path": None, "generator": None, "inline": None},
    "Webflow": {"hosts": ("website-files.com",), "path": None, "generator": "webflow", "inline": None},
}
ASSET_RELS = ("stylesheet", "preload", "modulepreload", "icon")
JAVASCRIPT = r"(?i)^(|module|(text|application)/(x-)?(java|ecma)script)$"


def stages() -> list[dict[str, str]]:
    rel = lambda n: own_tokens(f"lower({attr(n, 'rel')})")
    loads = keep("nodes", lambda n: (
        f"({n}.tag = 'script' AND {has_attr(n, 'src')}) OR ({n}.tag = 'link' AND {has_attr(n, 'href')} AND "
        f"exists({rel(n)}, r -> {in_list('r', ASSET_RELS)}))"))
    # Only host and path of an asset are compared, so relative addresses may resolve against any page.
    address = lambda n: let(urls.absolute_url(f"CASE WHEN {n}.tag = 'script' THEN {trimmed_attr(n, 'src')} ELSE {trimmed_attr(n, 'href')} END", "'https://page.invalid/'"),
                            lambda u: f"CASE WHEN {u} IS NOT NULL THEN {urls.parts(u)} END")
    assets = keep(each(loads, address), lambda a: f"{a} IS NOT NULL")
    generators = each(keep("metas", named("generator")), lambda m: f"lower({m}.content)")
    inline = f"array_join(transform(filter(scripts, s -> s.src IS NULL AND s.type RLIKE r'{JAVASCRIPT}'), s -> s.body), '\\n')"
    return [{"assets": assets, "generators": generators, "inline_script": inline}, {"platform": _platform()}]


# A JSON string, and the members of a flat object before the one that is wanted.
_STRING = r'"(?:[^"\\]|\\.)*+"'
_THEME_NAME = rf'\bShopify\.theme\s*=\s*\{{(?:[^{{}}"]|{_STRING}(?!\s*:)|(?!"schema_name"){_STRING})*?"schema_name"\s*:\s*({_STRING})'


def _theme_name() -> str:
    """The string under schema_name in the object assigned to Shopify.theme, found where it stands."""
    return clean(f"try_variant_get(try_parse_json(nullif(regexp_extract(inline_script, r'{_THEME_NAME}', 1), '')), '$', 'string')")


def _platform() -> str:
    theme = {
        "Shopify": f"CASE WHEN inline_script RLIKE r'\\bShopify\\.theme\\s*=\\s*\\{{' THEN {_theme_name()} END",
        "WordPress": clean("get(filter(transform(assets, a -> regexp_extract(a[2], '/wp-content/themes/([^/]+)/', 1)), t -> t <> ''), 0)"),
    }
    cases = []
    for name, marks in PLATFORMS.items():
        tests = []
        if marks["hosts"]:
            host = "regexp_replace(lower(a[1]), '^.*@|:[0-9]*$', '')"
            tests.append(any_of("assets", lambda a: " OR ".join(f"({host} = '{h}' OR endswith({host}, '.{h}'))" for h in marks["hosts"]).replace("a[1]", f"{a}[1]")))
        if marks["path"]:
            tests.append(any_of("assets", lambda a: f"{a}[2] RLIKE r'{marks['path']}'"))
        if marks["generator"]:
            tests.append(any_of("generators", lambda g: f"startswith({g}, '{marks['generator']}')"))
        if marks["inline"]:
            tests.append(f"inline_script RLIKE r'{marks['inline']}'")
        if name == "Webflow":
            tests.append(has_attr("html_node", "data-wf-site"))
        cases.append(f"WHEN {' OR '.join(tests)} THEN named_struct('name', {lit(name)}, 'theme', {theme.get(name, 'CAST(NULL AS STRING)')})")
    return f"CASE WHEN nodes IS NULL THEN NULL {' '.join(cases)} END"


def origin_platform(pages: DataFrame) -> DataFrame:
    """The platform most pages of an origin show, with the theme most of those name; ties go to the first seen.

    Two partial aggregations on (origin, name, theme) and (origin, name) keep what is shuffled small whatever the
    number of pages of an origin.
    """
    found = pages.filter("status = 200 AND platform IS NOT NULL").select(
        F.expr(urls.origin("final_url")).alias("origin"), F.col("platform.name").alias("name"), F.col("platform.theme").alias("theme"), "seq")
    themes = found.groupBy("origin", "name", "theme").agg(F.count("*").alias("n"), F.min("seq").alias("seen"))
    best_theme = F.max(F.when(F.col("theme").isNotNull(), F.struct("n", (-F.col("seen")).alias("early"), "theme")))["theme"]
    names = themes.groupBy("origin", "name").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"), best_theme.alias("theme"))
    best = F.max(F.struct("n", (-F.col("seen")).alias("early"), "name", "theme"))
    return names.groupBy("origin").agg(best.alias("b")).select("origin", "b.name", "b.theme")


