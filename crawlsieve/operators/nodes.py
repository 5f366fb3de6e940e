"""Page markup as an array of nodes (F0), the one Python stage of a page audit.

``extract_nodes`` runs inside the map side of the scan: a page comes in, the same page goes out with its elements and
texts in document order.  Everything after it is Spark expressions over that array, so auditing a page needs no
shuffle.  A node's position in the array is its number, ``last`` the number of its last descendant, and ``near``
holds the number of the closest enclosing element (itself included) of each class, -1 for none.  Containment is
therefore a comparison of two integers instead of an interval join.
"""

from __future__ import annotations

import gc
import re
import sys
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Executors get this helper with the task, so nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEAR = ("head", "body", "svg", "raw", "chrome", "shell", "hidden", "label", "link", "figure", "heading", "block", "field")
NEAR_TYPE = "STRUCT<" + ", ".join(f"{n}: INT" for n in NEAR) + ">"
NODE_TYPE = (
    "STRUCT<pre: INT, last: INT, parent: INT, depth: INT, tag: STRING, attrs: MAP<STRING, STRING>, data: STRING, nth: INT, "
    f"same: INT, id_nth: INT, id_total: INT, src: INT, open_end: INT, src_end: INT, gap: INT, body_gap: INT, near: {NEAR_TYPE}>"
)

# Element names of the HTML standard by how they nest.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
RAW = frozenset("script style noscript iframe xmp noembed noframes plaintext".split())
RCDATA = frozenset(("title", "textarea"))
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul xmp listing".split()
)
SPECIAL = CLOSES_P | frozenset(
    "applet body button caption col colgroup frameset head html iframe img input link marquee meta noscript object param "
    "script select source style tbody td template textarea tfoot th thead title tr track wbr".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template body".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Which open elements a start tag closes, and where the search for them stops.
IMPLIED = {
    "li": (("li",), frozenset(("ul", "ol", "menu", "dir"))),
    "dd": (("dd", "dt"), frozenset(("dl",))),
    "dt": (("dd", "dt"), frozenset(("dl",))),
    "option": (("option",), frozenset(("select", "datalist"))),
    "optgroup": (("option", "optgroup"), frozenset(("select",))),
    "tr": (("tr", "td", "th"), frozenset(("table",))),
    "td": (("td", "th"), frozenset(("tr", "table"))),
    "th": (("td", "th"), frozenset(("tr", "table"))),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), frozenset(("table",))),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), frozenset(("table",))),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), frozenset(("table",))),
    "rt": (("rt", "rp"), frozenset(("ruby",))),
    "rp": (("rt", "rp"), frozenset(("ruby",))),
}
NOT_PROSE = frozenset("script style noscript template svg".split())
CHROME = frozenset("nav header footer aside".split())
APP_ROOTS = frozenset(("root", "app", "__next", "__nuxt", "svelte"))
CLASSED = frozenset("head body svg script style noscript a button label figure p li td article section div".split()) | HEADINGS | CHROME
BLOCKS = frozenset("figure p li td article section div body".split())
MAX_DEPTH = 513  # Fixed value: how deep browsers nest elements.

_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)?))?""")
_TAG = re.compile(
    r"""<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)?)*+)>"""
)
_REF = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)(?:;|(?![=A-Za-z0-9]))")


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        name = m[1].lower()
        if name not in found:
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            found[name] = _REF.sub(lambda r: unescape(r[0]), value) if "&" in value else value
    return found


class _Page:
    """The tree of one page while it is read."""

    def __init__(self, html: str):
        self.html = html
        self.nodes: list[list] = []  # the fields of NODE_TYPE up to body_gap
        self.near: list[tuple] = []
        self.open: list[int] = []
        self.gap = self.body_gap = 0
        self.dropped = 0
        self.head = self.body = -1
        self.head_done = False
        self.siblings: list[dict] = []
        self.ids: dict[str, list[int]] = {}

    def classes(self, pre: int, tag: str, attrs: dict, up: tuple) -> tuple:
        near = None

        def mark(k: int) -> None:
            nonlocal near
            near = near or list(up)
            near[k] = pre

        if tag in BLOCKS:
            mark(11)
        if tag == "head":
            mark(0)
        elif tag == "body":
            mark(1)
        elif tag == "svg" and up[2] < 0:
            mark(2)
        elif tag in ("script", "style", "noscript"):
            mark(3)
        elif tag in ("a", "button"):
            mark(8)
        elif tag in HEADINGS:
            mark(10)
        elif tag in CHROME:
            mark(4)
            if tag != "aside":
                mark(5)
        elif tag == "figure":
            mark(9)
        elif tag == "label" and "for" not in attrs:
            mark(12)
        if attrs:
            if attrs.get("id") in APP_ROOTS:
                mark(5)
            if attrs.get("aria-hidden") == "true" or "hidden" in attrs:
                mark(6)
            if attrs.get("aria-label"):
                mark(7)
        return tuple(near) if near else up

    def push(self, tag: str, attrs: dict, start: int, end: int, stays: bool = True) -> None:
        if len(self.open) >= MAX_DEPTH:
            self.pop(start)
        parent = self.open[-1] if self.open else -1
        pre = len(self.nodes)
        nth, peers = 1, None
        if parent >= 0:
            peers = self.siblings[-1].setdefault(tag, [])
            nth = len(peers) + 1
            peers.append(pre)
        up = self.near[parent] if parent >= 0 else (-1,) * len(NEAR)
        near = self.classes(pre, tag, attrs, up) if attrs or tag in CLASSED else up
        same_id = self.ids.setdefault(attrs["id"], []) if "id" in attrs else None
        if same_id is not None:
            same_id.append(pre)
        self.step(tag, near)
        self.nodes.append([pre, pre, parent, len(self.open), tag, attrs, None, nth, 1, len(same_id) if same_id else 0, 0, start, end, end,
                           self.gap, self.body_gap])
        self.near.append(near)
        if stays:
            self.open.append(pre)
            self.siblings.append({})
        else:
            self.step(tag, near)

    def step(self, tag: str, near: tuple) -> None:
        """An element starts or ends: text on its two sides does not touch, unless the element is not prose."""
        if tag not in NOT_PROSE and near[2] < 0:
            self.gap += 1
            if near[4] < 0:
                self.body_gap += 1

    def pop(self, at: int) -> None:
        pre = self.open.pop()
        node = self.nodes[pre]
        node[1], node[13] = len(self.nodes) - 1, at
        for peers in self.siblings.pop().values():
            if len(peers) > 1:
                for p in peers:
                    self.nodes[p][8] = len(peers)
        self.step(node[4], self.near[pre])

    def pop_to(self, depth: int, at: int, end: int) -> None:
        while len(self.open) > depth + 1:
            self.pop(at)
        self.pop(end)

    def find(self, names, stops) -> int:
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.nodes[self.open[depth]][4]
            if tag in names:
                return depth
            if tag in stops:
                return -1
        return -1

    def close_implied(self, names, stops, at: int) -> None:
        depth = self.find(names, stops)
        while depth >= 0:
            self.pop_to(depth, at, at)
            depth = self.find(names, stops)

    def frame(self, tag: str, at: int) -> None:
        """Open html, head and body as they are needed."""
        if not self.nodes:
            self.push("html", {}, at, at)
        if self.head < 0:
            self.head = len(self.nodes)
            self.push("head", {}, at, at)
        if tag == "body" and self.body < 0:
            if len(self.open) > 1:
                self.pop_to(1, at, at)
            self.body = len(self.nodes)
            self.push("body", {}, at, at)

    def start(self, tag: str, attrs: dict, start: int, end: int, closed: bool) -> None:
        if tag == "template":
            self.dropped += 1
            return
        if self.dropped:
            return
        if tag in ("html", "head", "body"):
            at = {"html": 0 if self.nodes else -1, "head": self.head, "body": self.body}[tag]
            if at < 0:
                if tag == "html":
                    self.push("html", attrs, start, end)
                    return
                self.frame("head" if tag == "head" else "body", start)
                at = self.head if tag == "head" else self.body
                self.nodes[at][11:14] = [start, end, end]
            node = self.nodes[at]
            if tag != "head" or not node[5]:
                for k, v in attrs.items():
                    node[5].setdefault(k, v)
            if "id" in attrs and not node[9]:
                self.ids.setdefault(node[5]["id"], []).append(at)
                node[9] = len(self.ids[node[5]["id"]])
            return
        if self.body < 0:
            if tag in HEAD:
                self.frame("head", start)
                if self.head_done and len(self.open) == 1:  # after </head>: these still belong to the head
                    self.open.append(self.head)
                    self.siblings.append({})
                    self.add(tag, attrs, start, end, closed)
                    if len(self.open) > 1 and self.open[-1] == self.head:
                        self.pop(end)
                    return
            else:
                self.frame("body", start)
        self.add(tag, attrs, start, end, closed)

    def add(self, tag: str, attrs: dict, start: int, end: int, closed: bool) -> None:
        foreign = self.near[self.open[-1]][2] >= 0
        if not foreign:
            if tag in CLOSES_P:
                self.close_implied(("p",), SCOPE | {"button"}, start)
            if tag in IMPLIED:
                self.close_implied(*IMPLIED[tag], start)
            elif tag in HEADINGS:
                if self.nodes[self.open[-1]][4] in HEADINGS:
                    self.pop(start)
            elif tag in ("a", "button", "nobr"):
                self.close_implied((tag,), SCOPE, start)
        self.push(tag, attrs, start, end, stays=not (tag in VOID or (foreign or tag == "svg" or tag == "math") and closed))

    def end(self, tag: str, start: int, end: int) -> None:
        if tag == "template":
            self.dropped = max(0, self.dropped - 1)
            return
        if self.dropped or tag in ("html", "body"):
            return
        if tag == "head":
            if self.body < 0 and self.head >= 0 and len(self.open) > 1:
                self.pop_to(1, start, end)
                self.head_done = True
            return
        if tag in HEADINGS:
            depth = self.find(HEADINGS, SCOPE)
        elif tag == "p":
            depth = self.find(("p",), SCOPE | {"button"})
            if depth < 0:
                self.start("p", {}, start, start, False)
                depth = len(self.open) - 1
        elif tag in FORMATTING:
            depth = self.find((tag,), SPECIAL)
        elif tag in SPECIAL:
            depth = self.find((tag,), frozenset(("html", "body")) if tag == "table" else frozenset(("table", "body")))
        else:
            depth = self.find((tag,), SPECIAL)
        if depth > 0:
            self.pop_to(depth, start, end)

    def text(self, data: str, start: int, end: int) -> None:
        if self.dropped or not data:
            return
        if self.body < 0 and not (self.open and self.nodes[self.open[-1]][4] in RAW | RCDATA):
            if not data.strip():
                return
            self.frame("body", start)
        parent = self.open[-1]
        pre = len(self.nodes)
        self.nodes.append([pre, pre, parent, len(self.open), "#text", None, data, 0, 0, 0, 0, start, end, end, self.gap, self.body_gap])
        self.near.append(self.near[parent])

    def read(self) -> None:
        html, pos, n = self.html, 0, len(self.html)
        lower = None
        while pos < n:
            lt = html.find("<", pos)
            if lt < 0:
                self.text(unescape(html[pos:]), pos, n)
                break
            nxt = html[lt + 1 : lt + 2]
            if not (nxt.isascii() and nxt.isalpha() or nxt in ("/", "!", "?")) or nxt == "":
                lt2 = html.find("<", lt + 1)
                lt2 = n if lt2 < 0 else lt2
                self.text(unescape(html[pos:lt2]), pos, lt2)
                pos = lt2
                continue
            if lt > pos:
                self.text(unescape(html[pos:lt]), pos, lt)
            if html.startswith("<!--", lt):
                close = html.find("-->", lt + 2 if html.startswith("<!-->", lt) else lt + 4)
                pos = n if close < 0 else close + 3
                continue
            m = _TAG.match(html, lt) if nxt not in "!?" else None
            if m is None:
                close = html.find(">", lt)
                pos = n if close < 0 else close + 1
                continue
            tag, pos = m[2].lower(), m.end()
            if m[1]:
                self.end(tag, lt, pos)
                continue
            self.start(tag, _attributes(m[3]) if m[3] else {}, lt, pos, m[3].endswith("/"))
            if tag in RAW or tag in RCDATA:
                if lower is None:
                    lower = html.lower()
                    if len(lower) != n:  # a few letters change length when lowered
                        lower = re.sub("[A-Z]", lambda c: c[0].lower(), html)
                close = n if tag == "plaintext" else lower.find("</" + tag, pos)
                close = n if close < 0 else close
                body = html[pos:close]
                self.text(unescape(body) if tag in RCDATA else body, pos, close)
                pos = close
        if self.body < 0:
            self.frame("body", n)
        while self.open:
            self.pop(n)
        for same in self.ids.values():
            for p in same:
                self.nodes[p][10] = len(same)
        if not html.isascii():
            self.to_byte_offsets()

    def to_byte_offsets(self) -> None:
        at, byte, where = 0, 0, {}
        for offset in sorted({o for node in self.nodes for o in node[11:14]}):
            byte += len(self.html[at:offset].encode("utf-8", "replace"))
            at, where[offset] = offset, byte
        for node in self.nodes:
            node[11:14] = [where[o] for o in node[11:14]]


def read_page(html: str) -> tuple[list[list], list[tuple]]:
    page = _Page(html)
    page.read()
    return page.nodes, page.near


def _node_arrays(pages: list) -> pa.Array:
    """Arrow list of node structs, built from flat columns."""
    columns: list[list] = [[] for _ in range(16)]
    nears: list[list] = [[] for _ in NEAR]
    keys, values, map_offsets, offsets, valid = [], [], [0], [0], []
    for page in pages:
        valid.append(page is not None)
        if page is not None:
            nodes, near = page
            for c, column in zip(columns, zip(*nodes)):
                c.extend(column)
            for c, column in zip(nears, zip(*near)):
                c.extend(column)
            for node in nodes:
                if node[5]:
                    keys.extend(node[5])
                    values.extend(node[5].values())
                map_offsets.append(len(keys))
        offsets.append(len(columns[0]))
    def text(xs: list) -> pa.Array:
        try:
            return pa.array(xs, pa.string())
        except UnicodeEncodeError:  # a character reference to half of a pair
            return pa.array([None if x is None else x.encode("utf-8", "replace").decode("utf-8") for x in xs], pa.string())

    ints = lambda xs: pa.array(xs, pa.int32())
    attrs = pa.MapArray.from_arrays(ints(map_offsets), text(keys), text(values))
    near = pa.StructArray.from_arrays([ints(c) for c in nears], list(NEAR))
    fields = ["pre", "last", "parent", "depth", "tag", "attrs", "data", "nth", "same", "id_nth", "id_total", "src", "open_end",
              "src_end", "gap", "body_gap"]
    arrays = [attrs if f == "attrs" else text(c) if f in ("tag", "data") else ints(c) for f, c in zip(fields, columns)]
    struct = pa.StructArray.from_arrays(arrays + [near], fields + ["near"])
    mask = pa.array([not v for v in valid])
    return pa.ListArray.from_arrays(ints(offsets), struct, mask=mask)


def _parse_batches(batches):
    for batch in batches:
        # A page can grow many times over as nodes, so a batch is handed on in slices of bounded text.
        start = size = 0
        for i, length in enumerate(pc.binary_length(batch.column("html")).to_pylist()):
            size += length or 0
            if size > 4_000_000 or i - start >= 255:
                yield _parse_batch(batch.slice(start, i - start + 1))
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield _parse_batch(batch.slice(start))


def _parse_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    pages, errors = [], []
    gc.disable()  # a tree has no cycles, and many small lists make the collector run all the time
    for html in batch.column("html").to_pylist():
        try:
            pages.append(None if html is None else read_page(html))
            errors.append(None)
        except Exception as error:  # one bad page must not stop the job: it becomes an issue of that page
            pages.append(None)
            errors.append(f"{type(error).__name__}: {error}")
    gc.enable()
    names = list(batch.schema.names)
    columns = [batch.column(n).cast(pa.binary()) if n == "html" else batch.column(n) for n in names]
    return pa.RecordBatch.from_arrays(columns + [_node_arrays(pages), pa.array(errors, pa.string())],
                                      names + ["nodes", "parse_error"])


def extract_nodes(pages: DataFrame) -> DataFrame:
    """Adds ``nodes`` and ``parse_error``; ``html`` becomes binary so that evidence is cut out by byte offset.

    Input is ``html_pages`` output: rows without HTML pass through with ``nodes`` NULL.
    """
    fields = [f"`{f.name}` {'BINARY' if f.name == 'html' else f.dataType.simpleString()}" for f in pages.schema.fields]
    return pages.mapInArrow(_parse_batches, ", ".join(fields + [f"nodes ARRAY<{NODE_TYPE}>", "parse_error STRING"]))


def node_rows(tree: DataFrame) -> DataFrame:
    """One row per node, for ad-hoc analysis of markup."""
    return tree.selectExpr("url", "inline(nodes)")
