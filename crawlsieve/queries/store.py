"""Structured data and lab results: a row of ``part`` becomes a product page, ``events`` become lab runs.

The SQL reads the same tables and never sees markup or JSON, so each query is a round trip through both.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sql import col
from ..operators import lab
from ..operators.pages import page_columns
from ..sources.crawl import as_crawl
from ..sources.lab import parse_lab_runs
from .common import issues_of, rows_of, spread, table

QUERIES, ORACLES = {}, {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def product_pages(spark, sf, json: str, more_head: str = "''"):
    """One page per part; ``json`` is SQL text of its structured data over the columns of ``part``."""
    html = (f"concat('<!DOCTYPE html><html lang=\"en\"><head><title>', p_name, '</title>', {more_head}, '<script type=\"application/ld+json\">', {json}, "
            "'</script></head><body><main><h1>', p_name, '</h1></main></body></html>')")
    return as_crawl(spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("seq"), col("concat('https://shop.example/p/', p_partkey)").alias("url"), col(html).alias("html")))


# A plain product with one offer; price as a number or a text, brand as a name, an object or a reference.
_BRAND = "CASE p_partkey % 3 WHEN 0 THEN concat('\"', p_brand, '\"') WHEN 1 THEN concat('{\"@type\":\"Brand\",\"name\":\"', p_brand, '\"}') ELSE '{\"@id\":\"#brand\"}' END"
_PRICE = "CASE p_partkey % 2 WHEN 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS STRING) ELSE concat('\" ', CAST(p_retailprice AS DECIMAL(12, 2)), ' \"') END"
PRODUCT = (f"concat('{{\"@context\":\"https://schema.org\",\"@graph\":[{{\"@type\":\"Product\",\"@id\":\"#p\",\"name\":\"', p_name, '\",\"sku\":', p_partkey, ',\"brand\":', {_BRAND}, "
           f"',\"image\":[\"https://i.example/', p_partkey, '.png\"],\"gtin13\":\"', p_size, '\",\"offers\":{{\"@type\":\"Offer\",\"price\":', {_PRICE}, ',\"priceCurrency\":\"EUR\",\"availability\":\"https://schema.org/InStock\"}},', "
           "'\"aggregateRating\":{\"ratingValue\":\"4.5\",\"reviewCount\":', p_size, '}},{\"@id\":\"#brand\",\"name\":\"', p_brand, '\"},{\"@type\":[\"Organization\"],\"name\":\"Shop\",\"hasShippingService\":{\"x\":1}}]}')")


@register("products", """SELECT p_partkey, p_name AS name, p_brand AS brand, CAST(p_partkey AS VARCHAR) AS sku, CAST(p_size AS VARCHAR) AS gtin, 'https://i.example/' || p_partkey || '.png' AS image, CAST(round(p_retailprice, 2) AS DOUBLE) AS price,
'EUR' AS currency, 'InStock' AS availability, CAST(4.5 AS DOUBLE) AS rating, CAST(p_size AS DOUBLE) AS ratings, 'organization' AS shipping, CAST(NULL AS VARCHAR) AS returns FROM part""")
def products(spark, sf):
    df = rows_of(page_columns(product_pages(spark, sf, PRODUCT), "products"), "products", "seq AS p_partkey").withColumnRenamed("row", "p")
    return df.selectExpr("p_partkey", "p.name AS name", "p.brand AS brand", "p.sku AS sku", "p.gtin AS gtin", "p.image AS image", "p.offers.low_price AS price", "p.offers.price_currency AS currency",
                         "array_join(p.offers.availability, ' ') AS availability", "p.rating.value AS rating", "p.rating.count AS ratings", "p.shipping AS shipping", "p.return_policy AS returns")


@register("jsonld_types", "SELECT p_partkey, 'Product Organization' AS types FROM part")
def jsonld_types(spark, sf):
    return page_columns(product_pages(spark, sf, PRODUCT), "jsonld_types").selectExpr("seq AS p_partkey", "array_join(jsonld_types, ' ') AS types")


@register("jsonld_objects", "SELECT p_partkey, unnest([0, 1, 2, 3]) AS ord, unnest([NULL, '#p', '#brand', NULL]) AS id, unnest(['', 'Product', '', 'Organization']) AS types FROM part")
def jsonld_objects(spark, sf):
    return rows_of(page_columns(product_pages(spark, sf, PRODUCT), "ld_objects"), "ld_objects", "seq AS p_partkey").selectExpr(
        "p_partkey", "row.ord AS ord", "row.id AS id", "array_join(row.types, ' ') AS types")


@register("jsonld_blocks", "SELECT p_partkey, p_size > 25 AS valid FROM part")
def jsonld_blocks(spark, sf):
    json = "CASE WHEN p_size > 25 THEN concat('{\"name\":\"', p_name, '\"}') ELSE concat('{\"name\": ', p_name, '}') END"
    return rows_of(page_columns(product_pages(spark, sf, json), "ld_blocks"), "ld_blocks", "seq AS p_partkey").selectExpr("p_partkey", "row.value IS NOT NULL AS valid")


@register("product_details_checks", """SELECT p_partkey AS page_id, 'product-details-missing' AS type, 'info' AS severity, 'Product leaves out hasMerchantReturnPolicy' AS message, '"name": "' || p_name || '"' AS context FROM part""")
def product_details_checks(spark, sf):
    return issues_of(product_pages(spark, sf, PRODUCT), "products", columns="type, severity, message, context")


# A group whose variants are inline, or products that refer to it; each variant has its own price.
GROUP = ("concat('[{\"@context\":\"https://schema.org\",\"@type\":\"ProductGroup\",\"@id\":\"#g\",\"name\":\"', p_name, '\",\"brand\":\"', p_brand, '\"', CASE p_partkey % 2 WHEN 0 THEN concat(',\"hasVariant\":[{\"@type\":\"Product\",\"sku\":\"A\",\"offers\":{\"@type\":\"Offer\",\"price\":', "
         "p_size, ',\"priceCurrency\":\"USD\"}},{\"@id\":\"#v\"}]},{\"@type\":\"Product\",\"@id\":\"#v\",\"image\":{\"url\":\"https://i.example/v.png\"},\"offers\":[{\"price\":', p_size + 10, ',\"priceCurrency\":\"USD\"},{\"price\":1,\"priceCurrency\":\"EUR\"}]}]') "
         "ELSE concat('},{\"@type\":\"Product\",\"sku\":\"B\",\"isVariantOf\":{\"@id\":\"#g\"},\"offers\":{\"@type\":\"AggregateOffer\",\"lowPrice\":', p_size, ',\"highPrice\":\"', p_size + 5, '\",\"priceCurrency\":\"USD\"}}]') END)")


@register("product_variants", """SELECT p_partkey, p_name AS name, p_brand AS brand, CASE p_partkey % 2 WHEN 0 THEN 'A' ELSE 'B' END AS sku, CAST(CASE p_partkey % 2 WHEN 0 THEN 3 ELSE 1 END AS BIGINT) AS n_offers, CAST(p_size AS DOUBLE) AS low,
CAST(CASE p_partkey % 2 WHEN 0 THEN p_size + 10 ELSE p_size + 5 END AS DOUBLE) AS high, 'USD' AS currency, CASE p_partkey % 2 WHEN 0 THEN 'https://i.example/v.png' END AS image FROM part""")
def product_variants(spark, sf):
    df = rows_of(page_columns(product_pages(spark, sf, GROUP), "products"), "products", "seq AS p_partkey").withColumnRenamed("row", "p")
    return df.selectExpr("p_partkey", "p.name AS name", "p.brand AS brand", "p.sku AS sku", "CAST(p.offers.count AS BIGINT) AS n_offers", "p.offers.low_price AS low", "p.offers.high_price AS high",
                         "p.offers.price_currency AS currency", "p.image AS image")


@register("product_offer_checks", """SELECT p_partkey AS page_id, 'product-offer-incomplete' AS type, 'warning' AS severity, 'Product has offers but lacks an image, an Offer (an AggregateOffer is not enough)' AS message FROM part WHERE p_partkey % 2 = 1
UNION ALL SELECT p_partkey, 'product-details-missing', 'info', 'Product leaves out an identifier (gtin or mpn), availability, shippingDetails, hasMerchantReturnPolicy' FROM part
UNION ALL SELECT p_partkey, 'product-brand-is-site', 'info', 'Brand "' || p_brand || '" is the name of the site' FROM part WHERE p_size % 5 = 0""")
def product_offer_checks(spark, sf):
    site_name = "CASE WHEN p_size % 5 = 0 THEN concat('<meta property=\"og:site_name\" content=\"', upper(p_brand), '\">') ELSE '' END"
    return issues_of(product_pages(spark, sf, GROUP, site_name), "products", columns="type, severity, message")


# Three nodes: the first shares an @id with the second and a name with the third, so all are one product.
CONFLICT = ("concat('[{\"@context\":\"https://schema.org\",\"@type\":\"Product\",\"@id\":\"#x\",\"url\":\"https://shop.example/p?variant=1\",\"name\":\"', p_name, '\",\"offers\":{\"price\":', p_size, ',\"priceCurrency\":\"EUR\"}},"
            "{\"@type\":\"Product\",\"@id\":\"#x\",\"offers\":{\"price\":', p_size + p_partkey % 3, ',\"priceCurrency\":\"EUR\"}},{\"@type\":\"Product\",\"name\":\"', upper(p_name), '\",\"aggregateRating\":{\"ratingValue\":4,\"reviewCount\":1}},"
            "{\"@type\":\"Product\",\"name\":\"Other\"}]')")


@register("product_conflict_checks", """SELECT p_partkey AS page_id, 'conflicting-product-data' AS type, '3 Product nodes for "' || p_name || '" disagree on price (' || p_size || ' vs ' || (p_size + p_partkey % 3) || ')' AS message FROM part WHERE p_partkey % 3 > 0""")
def product_conflict_checks(spark, sf):
    return issues_of(product_pages(spark, sf, CONFLICT), "products", columns="type, message")


# Structured data with a problem by size: no context, relative addresses, a retired type, missing properties, broken JSON.
BAD = ("CASE p_size % 6 WHEN 0 THEN concat('{\"@type\":\"Product\",\"name\":\"', p_name, '\",\"offers\":{\"url\":\"/o/', p_partkey, '\"},\"image\":[\"https://i.example/a\",{\"url\":\"b.png\"}]}') "
       "WHEN 1 THEN '{\"@context\":\"https://schema.org\",\"@graph\":[{\"@type\":\"FAQPage\"},{\"@type\":[\"BreadcrumbList\",\"HowTo\"]}]}' WHEN 2 THEN '{\"@graph\":[{\"@type\":\"Product\",\"@context\":\"https://schema.org\",\"review\":{}}]}' "
       "WHEN 3 THEN '{\"@context\":\"https://schema.org\",' WHEN 4 THEN '[{\"@context\":\"https://schema.org\",\"@type\":\"Thing\",\"publisher\":{\"logo\":{\"@type\":\"ImageObject\",\"contentUrl\":\"l.png\"}},\"sameAs\":[\"//ok.example\",\"mailto:a\"]}]' "
       "ELSE '{\"@context\":\"https://schema.org\",\"name\":\"untyped\",\"url\":\"/x\"}' END")


@register("structured_data_checks", """
SELECT p_partkey AS page_id, 'json-ld-missing-context' AS type, 'warning' AS severity, '' AS shown FROM part WHERE p_size % 6 = 0
UNION ALL SELECT p_partkey, 'json-ld-relative-url', 'warning', unnest(['"url": "/o/' || p_partkey || '"', '"image": "b.png"']) FROM part WHERE p_size % 6 = 0
UNION ALL SELECT p_partkey, 'unsupported-schema-type', 'info', unnest(['"@type": "FAQPage"', '"@type": "HowTo"']) FROM part WHERE p_size % 6 = 1
UNION ALL SELECT p_partkey, 'missing-schema-property', 'warning', '"@type": "BreadcrumbList, HowTo"' FROM part WHERE p_size % 6 = 1
UNION ALL SELECT p_partkey, 'missing-schema-property', 'warning', '"@type": "Product"' FROM part WHERE p_size % 6 = 2
UNION ALL SELECT p_partkey, 'invalid-json-ld', 'warning', '{"@context":"https://schema.org",' FROM part WHERE p_size % 6 = 3
UNION ALL SELECT p_partkey, 'json-ld-relative-url', 'warning', '"contentUrl": "l.png"' FROM part WHERE p_size % 6 = 4""")
def structured_data_checks(spark, sf):
    rows = issues_of(product_pages(spark, sf, BAD), "structured_data", columns="type, severity, context")
    return rows.selectExpr("page_id", "type", "severity", "CASE WHEN type = 'json-ld-missing-context' THEN '' ELSE context END AS shown")


# Articles: authors by name, by reference and doubled; dates in markup or in meta tags.
ARTICLE = ("concat('{\"@context\":\"https://schema.org\",\"@graph\":[{\"@type\":\"Article\",\"headline\":\"', p_name, '\",\"author\":[{\"@id\":\"#a\"},\"', p_brand, '\",{\"name\":\"', p_brand, '\"}],\"publisher\":{\"@id\":\"#o\"}', "
           "CASE p_partkey % 2 WHEN 0 THEN concat(',\"datePublished\":\"2024-01-', lpad(1 + p_size % 28, 2, '0'), '\"') ELSE '' END, ',\"sameAs\":[\"https://a.example/1\",7]},{\"@id\":\"#a\",\"name\":{\"@value\":\"Ann ', p_size, '\"}},{\"@type\":\"Organization\",\"@id\":\"#o\",\"name\":\"', p_type, '\"}]}')")
_META = "concat('<meta property=\"article:published_time\" content=\"2023-05-01\"><meta name=\"article:modified_time\" content=\"2023-06-', lpad(1 + p_size % 28, 2, '0'), '\">')"


@register("authorship", """SELECT p_partkey, unnest(['Article', 'Organization']) AS types, unnest([p_name, p_type]) AS name, unnest(['Ann ' || p_size || ', ' || p_brand, '']) AS authors, unnest([p_type, NULL]) AS publisher,
unnest([CASE p_partkey % 2 WHEN 0 THEN '2024-01-' || lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0') END, NULL]) AS published, unnest(['https://a.example/1 7', '']) AS same_as FROM part""")
def authorship(spark, sf):
    df = rows_of(page_columns(product_pages(spark, sf, ARTICLE, _META), "authorship"), "authorship", "seq AS p_partkey").select("p_partkey", "row.*")
    return df.selectExpr("p_partkey", "array_join(types, ' ') AS types", "name", "array_join(authors, ', ') AS authors", "publisher", "date_published AS published", "array_join(same_as, ' ') AS same_as")


@register("page_dates", """SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN '2024-01-' || lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0') ELSE '2023-05-01' END AS published, '2023-06-' || lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0') AS modified,
'Ann ' || p_size || ', ' || p_brand AS author FROM part""")
def page_dates(spark, sf):
    return page_columns(product_pages(spark, sf, ARTICLE, _META), "page_dates", "author").selectExpr("seq AS p_partkey", "page_dates.published AS published", "page_dates.modified AS modified", "author")


# --- lab results --------------------------------------------------------------------------------------------------------

# An event is a run of the page of its user: performance falls with its value, other numbers follow from it.
_RESULT = ("concat('{\"lighthouseVersion\":\"12.0\",\"finalUrl\":\"https://lab.example/', user_id, '\",\"categories\":{\"performance\":{\"score\":', CASE WHEN event_type = 'signup' THEN 'null' ELSE CAST(greatest(0, 100 - CAST(value AS INT)) / 100 AS STRING) END, "
           "',\"auditRefs\":[{\"id\":\"largest-contentful-paint\"},{\"id\":\"unused-css\"}]},\"seo\":{\"score\":0.8', CAST(event_id % 10 AS INT), ',\"auditRefs\":[{\"id\":\"unused-css\"},{\"id\":\"crawlable\"}]}},\"audits\":{"
           "\"largest-contentful-paint\":{\"id\":\"largest-contentful-paint\",\"title\":\"LCP\",\"scoreDisplayMode\":\"numeric\",\"score\":0.5,\"numericValue\":', value * 100, ',\"description\":\"Paint. [Learn more](https://l.example/(x)).\"},"
           "\"cumulative-layout-shift\":{\"id\":\"cumulative-layout-shift\",\"scoreDisplayMode\":\"numeric\",\"score\":0.95,\"numericValue\":', value / 1000, '},\"total-blocking-time\":{\"id\":\"total-blocking-time\",\"scoreDisplayMode\":\"numeric\",\"score\":1,\"numericValue\":', value * 8, '},"
           "\"unused-css\":{\"id\":\"unused-css\",\"title\":\"CSS\",\"scoreDisplayMode\":\"metricSavings\",\"score\":0.2', CAST(event_id % 10 AS INT), ',\"metricSavings\":{\"LCP\":', value, ',\"FCP\":0},\"details\":{\"type\":\"table\",\"overallSavingsBytes\":', event_id, ',\"items\":[{\"url\":\"https://c.example/', event_id, '.css\",\"wastedBytes\":', value, '},"
           "{\"type\":\"list\",\"items\":[{\"node\":{\"selector\":\"#n', user_id, '\",\"snippet\":\"<p>\"}},{\"type\":\"node\",\"selector\":\"b\"}]},{\"label\":\"four\"}]}},\"crawlable\":{\"id\":\"crawlable\",\"scoreDisplayMode\":\"error\",\"errorMessage\":\"broke\"},\"note\":{\"id\":\"note\",\"scoreDisplayMode\":\"informative\",\"score\":0}}}')")


def lab_runs(spark, sf):
    events = spread(table(spark, sf, "events"))
    return events.select(col("concat('https://lab.example/', user_id)").alias("url"), F.col("event_id").cast("int").alias("run"),
                         col(f"CASE WHEN event_type <> 'error' THEN {_RESULT} END").alias("result"), col("CASE WHEN event_type = 'error' THEN concat('crash ', event_id) END").alias("error"))


_RUNS = """WITH r AS (SELECT user_id, event_id, value, event_type, CASE WHEN event_type = 'signup' THEN NULL ELSE greatest(0, 100 - CAST(trunc(value) AS INT)) END AS perf, 80 + event_id % 10 AS seo FROM (SELECT user_id, event_id, event_type, value FROM events) WHERE event_type <> 'error'),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(perf, -100), event_id) AS n, count(*) OVER (PARTITION BY user_id) AS runs FROM r), m AS (SELECT * FROM k WHERE n = (runs - 1) // 2 + 1)"""


@register("lab_summary", f"""{_RUNS} SELECT 'https://lab.example/' || user_id AS url, CAST(runs AS BIGINT) AS runs, CAST(perf AS BIGINT) AS performance, CAST(seo AS BIGINT) AS seo, floor(value * 100 + 0.5) AS lcp, round(value / 1000, 3) AS cls, floor(value * 8 + 0.5) AS tbt,
'Audit crawlable failed: broke' AS warnings FROM m""")
def lab_summary(spark, sf):
    return lab.lab_summary(parse_lab_runs(lab_runs(spark, sf))).selectExpr(
        "url", "CAST(runs AS BIGINT) AS runs", "CAST(scores['performance'] AS BIGINT) AS performance", "CAST(scores['seo'] AS BIGINT) AS seo", "metrics['lcp'] AS lcp", "metrics['cls'] AS cls", "metrics['tbt'] AS tbt",
        "array_join(warnings, '; ') AS warnings")


@register("lab_failing_audits", f"""{_RUNS} SELECT 'https://lab.example/' || user_id AS url, unnest(['unused-css', 'largest-contentful-paint']) AS id, 'performance' AS category, unnest([CAST(20 + event_id % 10 AS BIGINT), CAST(50 AS BIGINT)]) AS score FROM m""")
def lab_failing_audits(spark, sf):
    return rows_of(lab.lab_summary(parse_lab_runs(lab_runs(spark, sf))), "audits", "url").selectExpr("url", "row.id AS id", "row.category AS category", "CAST(row.score AS BIGINT) AS score")


@register("lab_audit_items", f"""{_RUNS} SELECT 'https://lab.example/' || user_id AS url, unnest(['https://c.example/' || event_id || '.css', NULL, NULL]) AS item_url, unnest([NULL, '#n' || user_id, 'b']) AS selector,
unnest([CASE WHEN floor(value + 0.5) > 0 THEN CAST(floor(value + 0.5) AS BIGINT) END, NULL, NULL]) AS wasted, CAST(CASE WHEN event_id > 0 THEN event_id END AS BIGINT) AS bytes, CASE WHEN floor(value + 0.5) > 0 THEN floor(value + 0.5) END AS lcp_savings FROM m""")
def lab_audit_items(spark, sf):
    df = rows_of(lab.lab_summary(parse_lab_runs(lab_runs(spark, sf))), "audits", "url").filter("row.id = 'unused-css'")
    return rows_of(df, "row.items", "url AS page", "row.savings AS savings").withColumnRenamed("row", "i").selectExpr(
        "page AS url", "i.url AS item_url", "i.selector AS selector", "i.wasted_bytes AS wasted", "savings.bytes AS bytes", "savings.metrics['lcp'] AS lcp_savings")


@register("lab_score_spread", f"""{_RUNS} SELECT 'https://lab.example/' || user_id AS url, CAST(min(perf) AS BIGINT) AS lo, CAST(max(perf) AS BIGINT) AS hi FROM k GROUP BY user_id HAVING count(*) > 1""")
def lab_score_spread(spark, sf):
    return lab.median_runs(parse_lab_runs(lab_runs(spark, sf))).filter("runs > 1").selectExpr(
        "url", "CAST(score_spread['performance'].lo AS BIGINT) AS lo", "CAST(score_spread['performance'].hi AS BIGINT) AS hi")


@register("lab_audit_notes", "SELECT 'largest-contentful-paint' AS id, 'Paint. Learn more.' AS description, 'https://l.example/(x)' AS learn_more FROM events LIMIT 1")
def lab_audit_notes(spark, sf):
    return lab.audit_notes(lab.lab_summary(parse_lab_runs(lab_runs(spark, sf))))


def lab_pages(spark, sf):
    """Pages of the events' users: two inputs land on each final address, one of four is not HTML."""
    users = table(spark, sf, "events").select("user_id").distinct()
    return users.selectExpr("explode(array(user_id * 2, user_id * 2 + 1)) AS seq", "user_id").selectExpr(
        "seq", "concat('https://in.example/', seq) AS url", "concat('https://lab.example/', user_id) AS final_url", "200 AS status", "seq % 4 <> 3 AS has_facts")


def attached(spark, sf):
    runs = parse_lab_runs(lab_runs(spark, sf))
    picked = lab_pages(spark, sf).filter("seq % 2 = 0").select("url")
    return lab.attach_lab(lab_pages(spark, sf), lab.lab_summary(runs), lab.failed_runs(runs), picked)


_ATT = f"""{_RUNS}, fails AS (SELECT user_id, 'crash ' || max(event_id) AS error FROM events GROUP BY user_id HAVING count(*) FILTER (event_type <> 'error') = 0),
pg AS (SELECT DISTINCT user_id, user_id * 2 + d AS seq, (user_id * 2 + d) % 4 <> 3 AS html FROM events, (SELECT unnest([0, 1]) AS d)),
a AS (SELECT pg.seq, pg.user_id, m.value, m.perf, m.seo, m.event_id, f.error, 'https://in.example/' || pg.seq AS url FROM pg LEFT JOIN m ON m.user_id = pg.user_id LEFT JOIN fails f ON f.user_id = pg.user_id WHERE html)"""


@register("lab_attached", f"{_ATT} SELECT url, CAST(CASE WHEN event_id IS NULL THEN NULL WHEN seq % 2 = 0 THEN 3 ELSE 0 END AS BIGINT) AS items, error FROM a")
def lab_attached(spark, sf):
    return attached(spark, sf).filter("has_facts").selectExpr("url", "CAST(size(get(filter(lab.audits, a -> a.id = 'unused-css'), 0).items) AS BIGINT) AS items", "lab_error AS error")


@register("lab_issues", f"""{_ATT} SELECT url, 'lcp-slow' AS type, CASE WHEN floor(value * 100 + 0.5) > 4000 THEN 'warning' ELSE 'info' END AS severity, floor(value * 100 + 0.5) AS actual_num FROM a WHERE floor(value * 100 + 0.5) > 2500
UNION ALL SELECT url, 'cls-high', CASE WHEN round(value / 1000, 3) > 0.25 THEN 'warning' ELSE 'info' END, round(value / 1000, 3) FROM a WHERE round(value / 1000, 3) > 0.1
UNION ALL SELECT url, 'tbt-high', CASE WHEN floor(value * 8 + 0.5) > 600 THEN 'warning' ELSE 'info' END, floor(value * 8 + 0.5) FROM a WHERE floor(value * 8 + 0.5) > 200
UNION ALL SELECT url, 'score-low-performance', CASE WHEN perf < 50 THEN 'warning' ELSE 'info' END, perf FROM a WHERE perf < 90 UNION ALL SELECT url, 'score-low-seo', 'info', seo FROM a WHERE seo < 90
UNION ALL SELECT url, 'lighthouse-failed', 'info', NULL FROM a WHERE error IS NOT NULL""")
def lab_issues(spark, sf):
    return lab.lab_issues(attached(spark, sf)).select("url", "type", "severity", "actual_num")


@register("average_scores", f"""{_ATT}, d AS (SELECT DISTINCT user_id, perf, seo FROM a WHERE event_id IS NOT NULL) SELECT 'performance' AS category, count(*) AS pages, CAST(floor(avg(perf) + 0.5) AS BIGINT) AS score FROM d
UNION ALL SELECT 'seo', count(*), CAST(floor(avg(seo) + 0.5) AS BIGINT) FROM d""")
def average_scores(spark, sf):
    return lab.average_scores(attached(spark, sf)).selectExpr("category", "pages", "CAST(score AS BIGINT) AS score")


@register("lab_audits", f"""{_ATT}, d AS (SELECT user_id, min(seq) AS seq, arg_min(url, seq) AS url, min(20 + event_id % 10) AS score FROM a WHERE event_id IS NOT NULL GROUP BY user_id)
SELECT 'unused-css' AS id, count(*) AS pages, CAST(min(score) AS BIGINT) AS worst_score, (SELECT string_agg(url, ' ' ORDER BY score, seq) FROM (SELECT * FROM d ORDER BY score, seq LIMIT 3)) AS urls FROM d
UNION ALL SELECT 'largest-contentful-paint', count(*), 50, (SELECT string_agg(url, ' ' ORDER BY seq) FROM (SELECT * FROM d ORDER BY seq LIMIT 3)) FROM d""")
def lab_audits(spark, sf):
    return lab.lab_audits(attached(spark, sf)).selectExpr("id", "pages", "CAST(worst_score AS BIGINT) AS worst_score", "array_join(urls, ' ') AS urls")


@register("metric_bands", """SELECT event_id, CASE WHEN value * 100 <= 2500 THEN 'good' WHEN value * 100 > 4000 THEN 'poor' ELSE 'average' END AS lcp, CASE WHEN value / 1000 <= 0.1 THEN 'good' WHEN value / 1000 > 0.25 THEN 'poor' ELSE 'average' END AS cls, 'unknown' AS fcp FROM events""")
def metric_bands(spark, sf):
    return table(spark, sf, "events").select("event_id", col(lab.metric_band("'lcp'", "(value * 100)")).alias("lcp"), col(lab.metric_band("'cls'", "(value / 1000)")).alias("cls"),
                                             col(lab.metric_band("'fcp'", "CAST(NULL AS DOUBLE)")).alias("fcp"))
