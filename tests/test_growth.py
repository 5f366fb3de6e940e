"""Work over a page grows with the page: four times as many elements take at most eight times as long, where rescanning takes sixteen."""

import time

import pytest

from crawlsieve.operators.pages import page_columns, page_issues
from crawlsieve.sources.crawl import as_crawl

MOST = 8


def seconds(spark, html, wanted, check):
    page = as_crawl(spark.createDataFrame([(0, "https://a.example/", html)], "seq BIGINT, url STRING, html STRING")).coalesce(1)
    made = page_columns(page, wanted, only_checks=(check,) if check else None)
    start = time.perf_counter()
    made.selectExpr(f"size({wanted})").collect()
    return time.perf_counter() - start


def assert_linear(spark, n, page, wanted="issues", check=None):
    """The fastest of some runs each, taking turns, without what a page of no size takes; other work on the machine may call for more runs."""
    sizes = [page(1), page(n), page(4 * n)]
    best = [float("inf")] * 3
    for run in range(8):
        best = [min(b, seconds(spark, html, wanted, check)) for b, html in zip(best, sizes, strict=True)]
        small, large = max(best[1] - best[0], 0.05), best[2] - best[0]
        if run and large <= MOST * small:
            return
    raise AssertionError(f"{best}")


def repeated(n, part):
    return "".join(part(i) for i in range(n))


PAGES = {
    "fields inside labels": ("form_labels", 4000, lambda n: repeated(n, lambda i: '<label><input type="checkbox"> x</label>')),
    "fields named by labels elsewhere": ("form_labels", 4000, lambda n: repeated(n, lambda i: f'<label for="f{i}">x</label><input id="f{i}">')),
    "fields without a name": ("form_labels", 4000, lambda n: "<input>" * n),
    "links named by other elements": ("links", 3000, lambda n: repeated(n, lambda i: f'<span id="l{i}">Item</span><a href="/{i}" aria-labelledby="l{i}"></a>')),
    "many fields named by one large element": ("form_labels", 3000, lambda n: f'<div id="l">{"<b>word</b>" * n}</div>' + repeated(n, lambda i: f'<input id="f{i}" aria-labelledby="l">')),
    "many fields pointing at one empty element": ("form_labels", 2000, lambda n: f'<div id="l">{"<b></b>" * n}</div>' + repeated(n, lambda i: f'<input id="f{i}" aria-labelledby="l">')),
    "one long name of many links": ("links", 2000, lambda n: f'<div id="l">{"!" * 25 * n}</div>' + '<a href="/" aria-labelledby="l"></a>' * n),
    "a link around many images": ("images", 2000, lambda n: f'<a href="/">{"<img src=/a.png alt= width=1 height=1>" * n}</a>'),
    "a heading around many images": ("headings", 5000, lambda n: f'<h1>Title</h1><h2>{"<img src=/a.png alt=>" * n}</h2>'),
    "empty headings inside each other": ("headings", 4000, lambda n: "<h1>Title</h1>" + "<h2><span>" * (n // 50) + "<i></i>" * n + "</span></h2>" * (n // 50)),
    "ids that occur twice, all referred to": ("duplicate_ids", 2000, lambda n: repeated(n, lambda i: f'<p id="d{i}"></p><label for="d{i}">x</label><p id="d{i}"></p>')),
    "issues alike on many elements": ("images", 3000, lambda n: "<p id=x>" + "<img src=/a.png>" * n),
}


@pytest.mark.parametrize("case", list(PAGES))
def test_checks_are_linear(spark, case):
    check, n, page = PAGES[case]
    assert_linear(spark, n, page, check=check)


def test_names_by_reference_are_linear(spark):
    """Articles whose author is a reference to one of as many persons."""
    def page(n):
        articles = ", ".join(f'{{"@type": "Article", "headline": "h{i}", "author": {{"@id": "#p{i}"}}}}' for i in range(n))
        persons = ", ".join(f'{{"@type": "Person", "@id": "#p{i}", "name": "n{i}"}}' for i in range(n))
        return f'<script type="application/ld+json">{{"@context": "https://schema.org", "@graph": [{articles}, {persons}]}}</script>'
    assert_linear(spark, 1000, page, wanted="authorship_all")


def test_look_ups_find_what_a_scan_finds(spark):
    from crawlsieve.functions.sql import is_key, looked_up, sorted_index, sorted_keys
    for n in (0, 1, 2, 3, 7, 8, 100):
        keys = [f"k{i * 7 % 31}" for i in range(n)]
        frame = spark.createDataFrame([(keys, [f"k{i}" for i in range(-1, 33)] + [None])], "keys ARRAY<STRING>, asked ARRAY<STRING>")
        frame = frame.selectExpr("asked", f"{sorted_index('transform(keys, (k, i) -> struct(k AS k, i AS v))')} AS x", f"{sorted_keys('keys')} AS y")
        row = frame.selectExpr("asked", f"transform(asked, a -> {looked_up('x', 'a')}) AS found", f"transform(asked, a -> {is_key('y', 'a')}) AS held").first()
        last = {k: i for i, k in enumerate(keys)}
        assert row.found == [last.get(a) for a in row.asked] and row.held == [a in last for a in row.asked]


def test_repeated_ids_are_numbered_in_order(spark):
    from crawlsieve.functions.text import unique_ids
    row = spark.sql(f"SELECT {unique_ids('x')} AS y FROM VALUES (array('b', 'a', 'b', 'c', 'a', 'b')) AS t(x)").first()
    assert row.y == ["b", "a", "b-2", "c", "a-2", "b-3"]


def test_markup_behind_much_white_space_is_shown_whole(spark):
    """The start that is read first holds next to nothing; the room is filled all the same."""
    html = "<body><img" + " " * 5000 + "src=/a.png" + "\n" * 9000 + "title=t>"
    row = page_issues(as_crawl(spark.createDataFrame([(0, "https://a.example/", html)], "seq BIGINT, url STRING, html STRING")), "images").first()
    assert row.context == row.html == "<img src=/a.png title=t>"
