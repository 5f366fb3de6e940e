"""Page checks: a clean page has no issue; each fixture page has the ones it was made for."""

from crawlsieve import page_issues
from crawlsieve.sources.crawl import as_crawl

CLEAN = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Gentle shampoo for daily use</title>
<meta name="description" content="A mild shampoo made from plants, for hair that is washed every day, in three sizes."><link rel="canonical" href="https://shop.example/shampoo">
<meta name="viewport" content="width=device-width"><meta property="og:title" content="Shampoo"><meta property="og:description" content="Mild"><meta property="og:image" content="https://shop.example/a.png">
<meta name="twitter:card" content="summary"></head><body><main><h1>Shampoo</h1><h2>Sizes</h2><p>Three sizes of bottle.</p><img src="/bottle-small.png" alt="A small bottle" width="1" height="1">
<a href="/conditioner">Conditioner for dry hair</a><form><label>Mail <input name="mail"></label></form></main></body></html>"""


def types(spark, html, checks=(), **columns):
    rows = [(1, columns.pop("url", "https://shop.example/shampoo"), html)]
    df = as_crawl(spark.createDataFrame(rows, "seq BIGINT, url STRING, html STRING").selectExpr("*", *[f"{v} AS {k}" for k, v in columns.items()]))
    return sorted((r.type, r.severity) for r in page_issues(df, *checks).collect())


def test_clean_page(spark):
    assert types(spark, CLEAN) == []


def test_broken_page_is_an_issue_of_that_page(spark, monkeypatch):
    from crawlsieve.operators import nodes
    read = nodes.read_page

    def fails(html):
        if html == "boom":
            raise ValueError("no tree")
        return read(html)

    monkeypatch.setattr(nodes, "read_page", fails)
    pages = as_crawl(spark.createDataFrame([(1, "https://a.example/", "boom"), (2, "https://b.example/", CLEAN)], "seq BIGINT, url STRING, html STRING"))
    found = page_issues(pages, "response", "title").collect()
    assert [(r.seq, r.type, r.message) for r in found] == [(1, "check-failed", "Page could not be processed: ValueError: no tree")]


def test_label_of_first_control_only(spark):
    html = "<label>A <input><input></label><label for=x>B</label><input id=x><label for=y></label><input id=y><select title=T></select>"
    assert types(spark, html, ["form_labels"]) == [("form-input-no-label", "error")] * 2


def test_bound_values_are_not_judged(spark):
    html = "<img :src=x><a href=/x v-text=t></a><h2 x-text=t></h2><input :aria-label=l><img ng-src=y [alt]=z>"
    assert types(spark, html, ["images", "links", "headings", "form_labels"]) == [
        ("missing-alt", "error"), ("missing-dimensions", "warning"), ("missing-dimensions", "warning"), ("missing-h1", "warning")]


def test_repeated_ids_of_issues_are_numbered(spark):
    html = "<script type=application/ld+json>{bad</script>" * 3
    df = as_crawl(spark.createDataFrame([(1, "https://a.example/", html)], "seq BIGINT, url STRING, html STRING"))
    ids = [r.id for r in page_issues(df, "structured_data").orderBy("ord").collect()]
    assert ids[1:] == [ids[0] + "-2", ids[0] + "-3"]


def test_title_limits(spark):
    assert types(spark, f"<title>{'w' * 60}</title>", ["title"]) == []
    assert types(spark, f"<title>{'😀' * 61}</title>", ["title"]) == [("long-title", "warning")]


def test_pages_without_html(spark):
    assert types(spark, CLEAN, url="https://shop.example/x.pdf", content_type="'application/pdf'") == [("not-html", "info")]
    assert types(spark, CLEAN, status="500") == [("http-status", "error")]
    assert types(spark, CLEAN, error="'timeout'") == [("fetch-failed", "error")]


def test_a_check_of_the_users_own(spark):
    from crawlsieve.functions.sql import lit
    from crawlsieve.operators.issues import issue, when
    from crawlsieve.operators.pages import page_columns
    from crawlsieve.operators.rules import RULES
    from crawlsieve.sources.crawl import as_crawl
    crawl = as_crawl(spark.createDataFrame([(1, "https://a.example/", "<html><head><title>Draft</title></head><body>x</body></html>"), (2, "https://a.example/b", "<html><head><title>Fine</title></head><body>x</body></html>")], "seq long, url string, html string"))
    draft = lambda: when("title_text = 'Draft'", issue(next(iter(RULES)), lit("The page is a draft"), "title_text"))
    rows = {r.seq: [i.message for i in r.issues] for r in page_columns(crawl, "issues", only_checks=("main_landmark",), extra_checks=(draft,)).collect()}
    assert "The page is a draft" in rows[1] and "The page is a draft" not in rows[2]
