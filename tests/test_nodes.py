"""The node helper: nesting with implied tags, raw text, ids, containment and growth."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st

from crawlsieve.operators.nodes import NEAR, read_page

TAG, PARENT, DATA = 4, 2, 6


def shape(html):
    nodes, _ = read_page(html)
    return [(n[TAG], nodes[n[PARENT]][TAG] if n[PARENT] >= 0 else None) for n in nodes]


def test_frame_is_always_there():
    assert shape("") == [("html", None), ("head", "html"), ("body", "html")]
    assert shape("<p>x") == [("html", None), ("head", "html"), ("body", "html"), ("p", "body"), ("#text", "p")]


def test_end_tags_that_may_be_left_out():
    assert [p for t, p in shape("<p><b>one<br><p>two") if t == "p"] == ["body", "body"]
    assert [p for t, p in shape("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") if t == "li"] == ["ul"] * 4
    assert [p for t, p in shape("<table><tr><td>1<td>2<tr><td>3</table>") if t == "td"] == ["tr"] * 3
    assert [p for t, p in shape("<a href=1>x<a href=2>y") if t == "a"] == ["body", "body"]


def test_script_text_is_not_markup():
    nodes, _ = read_page('<head><script>var t="</p>";if(a<b){}</script><title>a &amp; <b></title></head><body><noscript><p>x</p></noscript>')
    assert [n[DATA] for n in nodes if n[TAG] == "#text"] == ['var t="</p>";if(a<b){}', "a & <b>", "<p>x</p>"]


def test_template_content_is_dropped():
    assert "b" not in [t for t, _ in shape("<p>a<template><b>x</b><template></template></template><i>y</i>")]


def test_numbers_of_siblings_and_ids():
    nodes, _ = read_page("<p id=x></p><div></div><p id=x></p>")
    p = [n for n in nodes if n[TAG] == "p"]
    assert [(n[7], n[8], n[9], n[10]) for n in p] == [(1, 2, 1, 2), (2, 2, 2, 2)]


def test_attributes():
    nodes, _ = read_page("<a HREF='x&amp;y' title=\"a>b\" data-x=1/2 hidden href=second q=a&copy=1>")
    assert nodes[3][5] == {"href": "x&y", "title": "a>b", "data-x": "1/2", "hidden": "", "q": "a&copy=1"}


def test_offsets_are_bytes():
    html = "<body>äö<img alt=é>x"
    nodes, _ = read_page(html)
    img = next(n for n in nodes if n[TAG] == "img")
    assert html.encode()[img[11]:img[13]].decode() == "<img alt=é>"


def test_depth_is_capped():
    nodes, _ = read_page("<div>" * 5000)
    assert max(n[3] for n in nodes) < 513 and len(nodes) == 5003


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<a href=x>", "</a>", "<table>", "<td>", "</table>", "text", "<svg/>", "<template>", "</template>", "<br>", "<", "<!-- x", "-->", "<title>", "</title>", "</head>", "<body>", "&amp;"]), max_size=40))
def test_any_input_gives_a_tree(parts):
    nodes, near = read_page("".join(parts))
    for n, around in zip(nodes, near):
        assert n[1] >= n[0] and n[0] == nodes.index(n)
        if n[PARENT] >= 0:
            up = nodes[n[PARENT]]
            assert up[0] < n[0] and n[1] <= up[1] and n[3] == up[3] + 1
        for name, at in zip(NEAR, around):
            assert at == -1 or nodes[at][0] <= n[0] <= nodes[at][1], name


def test_time_grows_with_the_page():
    def best(n):
        html = "<ul>" + "<li><a href=/x class=y>word</a><p>text" * n
        times = []
        for _ in range(3):
            start = time.perf_counter()
            read_page(html)
            times.append(time.perf_counter() - start)
        return min(times)
    assert best(8000) <= 8 * best(2000)
