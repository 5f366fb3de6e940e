"""Cross-page operators, inputs, sources, skew and streams."""

import gzip
import json
import os

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crawlsieve import audit, run_audit, write_run
from crawlsieve.operators import links, report, rollup, site, sitemaps
from crawlsieve.operators.pages import CHECK_GROUPS, CHECKS
from crawlsieve.operators.rules import RULES, rules
from crawlsieve.operators.skew import hot_keys, salted_join, shared_folder
from crawlsieve.queries.site import page_table
from crawlsieve.sources.crawl import as_crawl, entries_from_args, read_url_list
from crawlsieve.sources.lab import read_lab_runs
from crawlsieve.sources.sitemaps import read_sitemaps, sitemap_entries, sitemap_files
from crawlsieve.streaming.stream import STREAM_SCHEMA, read_crawl_stream, stream_summary, summary_counts, summary_health


def test_rules_are_complete():
    assert len(RULES) == 107 and all(r["title"] and r["fix"] for r in RULES.values())


def test_pages_of_one_canonical_group_are_no_duplicates(spark):
    rows = [(1, "https://a.example/1", "T", "https://a.example/1"), (2, "https://a.example/2", "t", "https://a.example/1/"), (3, "https://a.example/3", "U", None), (4, "https://a.example/4/", "u", None), (5, "https://a.example/4", "U", None)]
    pages = page_table(spark.createDataFrame(rows, "seq BIGINT, url STRING, title STRING, canonical STRING"))
    found = site.duplicates(site.site_pages(pages)).orderBy("seq").collect()
    assert [(r.seq, r.context, r.message) for r in found] == [(s, "<title>U</title>", "Same title on 2 pages") for s in (3, 4, 5)]


def test_salted_join_equals_a_join(spark):
    many = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("url"))
    one = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k BIGINT, v STRING")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain, salted = many.join(one, "k", how), salted_join(many, one, ["k"], how)
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.select(plain.columns).collect()))


def test_only_hot_keys_are_repeated(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"), F.col("id").cast("string").alias("url"))
    one = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("v").alias("v")).unionByName(spark.createDataFrame([("hot", "h")], "k STRING, v STRING"))
    assert "hot" in (hot := hot_keys(many, "k", 0.1)) and len(hot) <= 10
    assert hot_keys(many.limit(0), "k") == []
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain, salted = many.join(one, "k", how), salted_join(many, one, ["k"], how, hot=("k", ["hot"]))
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.select(plain.columns).collect()))


def test_one_x_default_of_all_pages(spark):
    """An address that every page names as an alternate is found, joined in many tasks, and gives what a plain join gives."""
    lang = "ARRAY<STRUCT<lang: STRING, href: STRING>>"
    rows = spark.range(4000).selectExpr(
        "id AS seq", "concat('https://a.example/', id) AS url", f"CAST(array(named_struct('lang', 'x-default', 'href', 'https://a.example/0'), named_struct('lang', 'fi', 'href', concat('https://a.example/', id + 1 - 2 * (id % 2)))) AS {lang}) AS hreflang")
    pages = site.site_pages(page_table(rows))
    pages.write.mode("overwrite").parquet(path := f"{shared_folder(spark)}/x-default")
    pages = spark.read.parquet(path)
    assert "https://a.example/0" in site.hot_alternates(pages)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for key, value in zip(before, ("false", "16", "-1"), strict=True):
            spark.conf.set(key, value)
        hot = site.hot_alternates(pages)
        edges = site._alternate_edges(pages).filter("known_as = 'https://a.example/0'")
        joined = salted_join(edges, site.audited_index(pages).withColumnRenamed("page_key", "target"), ["known_as"], spread="page_key", hot=("known_as", hot))
        tasks = joined.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
        assert len(tasks) >= 8 and max(r.n for r in tasks) < 4000 / 3
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    pairs = {tuple(r) for r in site.alternate_pairs(pages).collect()}
    url = lambda i: f"https://a.example/{i}"
    assert pairs == {(url(i), url(j)) for i in range(4000) for j in (0, i + 1 - 2 * (i % 2)) if i != j}
    assert pairs == {tuple(r) for r in site.alternate_pairs(pages, []).collect()}
    missing = site.hreflang_targets(pages).filter("type = 'hreflang-missing-return'")
    assert missing.select("issue_key").distinct().count() == 3998 and missing.count() == 2 * 3998


def test_median_run_sorts_no_documents(spark):
    """The window holds addresses, scores and run numbers; the document joins later."""
    from crawlsieve.operators.lab import median_runs
    from crawlsieve.sources.lab import parse_lab_runs
    docs = [("u", n, json.dumps({"categories": {"performance": {"score": s}}, "pad": "x" * 50})) for n, s in ((1, 0.9), (2, 0.1), (3, 0.5), (4, 0.5))]
    frame = spark.createDataFrame([(u, n, d, None) for u, n, d in docs], "url STRING, run INT, body STRING, error STRING")
    runs = frame.selectExpr("url", "run", "parse_json(body) AS lhr", "error")
    made = median_runs(runs)
    assert [(r.run, r.runs) for r in made.select("run", "runs").collect()] == [(3, 4)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("lhr" in line for line in windows)
    assert parse_lab_runs


def test_one_title_on_a_third_of_all_pages(spark):
    pages = page_table(spark.range(3000).selectExpr("id AS seq", "concat('https://a.example/', id) AS url", "CASE WHEN id % 3 = 0 THEN 'Hot' ELSE concat('t', id) END AS title"))
    rows = site.duplicates(site.site_pages(pages))
    heads = site.issue_heads(rows).collect()
    assert [(h.n_urls, h.message) for h in heads] == [(1000, "Same title on 1000 pages")] and rows.count() == 1000


def test_groups_hold_every_check_once():
    assert sorted(name for group in CHECK_GROUPS for name in group) == sorted(CHECKS)
    assert any({"response", "robots_meta"} <= set(group) for group in CHECK_GROUPS)


def test_summary_counts_what_every_check_finds(spark, folder):
    """Images, titles, addresses, responses and canonicals count, not only markup that every page lacks; the SQL counts the same."""
    page = lambda head, body: f'<!DOCTYPE html><html lang="en"><head>{head}</head><body>{body}</body></html>'
    rows = [
        (1, "https://a.example/one", page("<title>A</title>", '<h1>B</h1><p>x</p><img src="/i.png">')),
        (2, "https://a.example/Two_x", "<!DOCTYPE html><html><head></head><body><p>x</p></body></html>"),
        (3, "https://a.example/three", None),
        (4, "https://a.example/four", page('<title>a</title><link rel="canonical" href="https://a.example/five">', "<h1>C</h1><p>x</p>")),
    ]
    spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    sql = db.execute(entry.oracle_sql()["summary"])
    want = dict(zip([d[0] for d in sql.description], sql.fetchone(), strict=True))
    # Errors: an image without alt, no title.  Warnings: size of the image, no lang, no h1, one shared title, and what each page lacks.
    assert want == {"pages": 4, "errors": 2, "warnings": 4 + 3 + 3 + 2, "infos": 1 + 2 + 1 + 3 + 3 + 3}
    assert [r.asDict() for r in entry.queries()["summary"](spark, folder).collect()] == [want]


def test_arguments_and_list_files(spark, folder):
    assert [tuple(r)[:3] for r in entries_from_args(spark, ["a", "b"]).orderBy("seq").collect()] == [(0, "a", "argument"), (1, "b", "argument")]
    with open(f"{folder}/urls.txt", "w") as f:
        f.write("# x\nhttps://a.example/#frag\n\nhttps://b.example/ lighthouse\nhttps://c.example/ oops\n")
    rows = read_url_list(spark, f"{folder}/urls.txt").orderBy("line_no").collect()
    assert [(r.value, r.lighthouse, r.rejected is not None) for r in rows] == [
        ("https://a.example/#frag", False, False), ("https://b.example/", True, False), ("https://c.example/ oops", False, True)]
    assert rows[0].source.endswith("urls.txt:2")


def test_packed_sitemap(spark, folder):
    with gzip.open(f"{folder}/s.xml.gz", "wt") as f:
        f.write("<?xml version='1.0'?><urlset><url><loc><![CDATA[https://a.example/?a&b]]></loc><lastmod/></url><url/></urlset>")
    entries = sitemap_entries(sitemap_files(read_sitemaps(spark, f"{folder}/s.xml.gz"))).orderBy("pos").collect()
    assert [(e.loc, e.lastmod) for e in entries] == [("https://a.example/?a&b", None), ("", None)]


def test_lab_files(spark, folder):
    with open(f"{folder}/1.json", "w") as f:
        json.dump({"finalUrl": "https://a.example/", "categories": {}, "audits": {}}, f)
    with open(f"{folder}/2.json", "w") as f:
        f.write("nothing")
    rows = read_lab_runs(spark, f"{folder}/*.json").collect()
    assert sorted((r.url, r.error) for r in rows if r.url) == [("https://a.example/", None)] and {r.error for r in rows} == {None, "no result"}


def test_audit_with_a_check_of_the_user(spark):
    pages = as_crawl(spark.createDataFrame([(1, "https://a.example/", "<title>A</title><a href=/x>x</a>"), (2, "https://a.example/2", "<title>a</title>")], "seq BIGINT, url STRING, html STRING"))
    own = lambda table: site.members(table.filter("title = 'A'"), "orphan-page", "'own check'", "url", ["url"])
    result = audit(pages, checks=[own])
    assert {(r.type, r.url) for r in result.site_members.collect()} == {("duplicate-title", "https://a.example/"), ("duplicate-title", "https://a.example/2"), ("orphan-page", "https://a.example/")}
    totals = result.summary.collect()[0]
    assert totals.pages == 2 and totals.errors == 0 and totals.warnings > 2


def test_page_audit_needs_no_shuffle(spark, folder):
    from crawlsieve import page_columns
    spark.createDataFrame([(1, "https://a.example/", "<title>A</title>")], "seq BIGINT, url STRING, html STRING").write.parquet(f"{folder}/pages")
    plan = page_columns(as_crawl(spark.read.parquet(f"{folder}/pages")), "title", "page_links", "issues", only_checks=("title", "links"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<seq:bigint,url:string,html:string>" in plan


def _stream_of(spark, folder):
    stream = read_crawl_stream(spark, f"{folder}/in/*")
    return stream.selectExpr("seq", "url", "final_url", "status", "array() AS redirects", "'text/html' AS content_type", "html", "false AS truncated", "robots_header", "headers", "body_bytes", "error", "fetched_at")


def _put(spark, folder, name, rows):
    """Crawl records (seq, url, html, time) as a file that a stream finds."""
    os.makedirs(f"{folder}/in", exist_ok=True)
    row = as_crawl(spark.createDataFrame(rows, "seq BIGINT, url STRING, html STRING, at STRING")).join(
        spark.createDataFrame([(r[0], r[3]) for r in rows], "seq BIGINT, at STRING"), "seq").withColumn("fetched_at", F.col("at").cast("timestamp"))
    row.selectExpr(*[f"CAST({f.split(' ')[0]} AS {' '.join(f.split(' ')[1:])}) AS {f.split(' ')[0]}" for f in ("seq BIGINT", "url STRING", "final_url STRING", "status INT", "html STRING", "fetched_at TIMESTAMP")]).write.parquet(f"{folder}/in/{name}")


def test_stream_summary_replaces_older_records(spark, folder):
    for name, title, at, expected in (("a", "<p>x", "2026-01-01 00:00:00", 1), ("b", "<title>ok</title>", "2026-01-02 00:00:00", 0), ("c", "<p>old", "2025-01-01 00:00:00", 0), ("d", "<p>no time", None, 0)):
        _put(spark, folder, name, [(1, "https://a.example/", title, at)])
        stream_summary(_stream_of(spark, folder), f"{folder}/out", only_checks=("title",)).trigger(availableNow=True).start().awaitTermination()
        assert [r.errors for r in summary_counts(spark, f"{folder}/out").collect()] == [expected]
        assert [tuple(r) for r in summary_health(spark, f"{folder}/out").collect()] == [(expected, 0, 1 - expected)]
    assert "fetched_at" in STREAM_SCHEMA


def test_stream_summary_costs_what_a_batch_holds(spark, folder):
    """The second batch touches the state of its own pages only, reads no earlier changes, and health still covers all pages."""
    _put(spark, folder, "a", [(i, f"https://a.example/{i}", "<p>x", "2026-01-01 00:00:00") for i in range(60)])
    first = stream_summary(_stream_of(spark, folder), f"{folder}/out", only_checks=("title",)).trigger(availableNow=True).start()
    first.awaitTermination()
    # three records of one page, the newest not last; a new page; a stale record
    _put(spark, folder, "b", [(100, "https://a.example/1", "<p>x", "2026-01-02 00:00:00"), (101, "https://a.example/1", "<title>ok</title>", "2026-01-04 00:00:00"), (102, "https://a.example/1", "<p>x", "2026-01-03 00:00:00"),
                              (103, "https://a.example/new", "<title>ok</title>", None), (104, "https://a.example/2", "<title>ok</title>", "2025-01-01 00:00:00")])
    second = stream_summary(_stream_of(spark, folder), f"{folder}/out", only_checks=("title",)).trigger(availableNow=True).start()
    second.awaitTermination()
    state = second.lastProgress["stateOperators"][0]
    assert (state["numRowsTotal"], state["numRowsUpdated"], second.lastProgress["numInputRows"]) == (61, 2, 5)
    changes = spark.read.parquet(f"{folder}/out/changes/epoch=1").orderBy("url").collect()
    assert [(r.url, r.seq, r.errors, r.was, r.now) for r in changes] == [("https://a.example/1", 101, 0, "errors", "clean"), ("https://a.example/new", 103, 0, None, "clean")]
    assert [tuple(r) for r in summary_health(spark, f"{folder}/out").collect()] == [(59, 0, 2)]
    assert summary_counts(spark, f"{folder}/out").filter("errors = 1").count() == 59


def test_digest_is_one_aggregate_of_the_hits(spark):
    """Eight shuffles at most, two of them over all hits; evidence is read for the chosen variants only, lists and counts are whole."""
    rows = [(i, f"https://a.example/{i:03}", f"t{k}", f"h{i}-{k}-{j}", "warning" if k else "info", "seo", f"m{j}", f"c{(i * j) % 7}", None if j else f"s{i % 2}", f"html{i}", f"a{i}", "e")
            for i in range(90) for k in range(2) for j in range(5) if (i + j) % (k + 1) == 0]
    names = ["seq", "url", "type", "hit", "severity", "category", "message", "context", "selector", "html", "actual", "expected"]
    schema = ", ".join(f"{n} {'BIGINT' if n == 'seq' else 'STRING'}" for n in names)
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path := f"{shared_folder(spark)}/digest-hits")
    found = rollup.digest_findings(spark.read.parquet(path), rules(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 6 and plan.count("FileScan parquet [" ) <= 5
    got = {r.type: r for r in found.collect()}
    for kind in ("t0", "t1"):
        own = [dict(zip(names, r)) for r in rows if r[2] == kind]
        r = got[kind]
        assert (r.pages, r.hits, r.severity) == (len({h["url"] for h in own}), len(own), "warning" if kind == "t1" else "info")
        pages_of = lambda key: sorted(((-len({h["url"] for h in own if key(h) == k}), min(h["seq"] for h in own if key(h) == k), k) for k in {key(h) for h in own}))
        best = pages_of(lambda h: h["message"])
        assert [(m.message, m.pages) for m in r.messages] == [(k, -n) for n, _, k in best[:3]] and r.more_messages == len(best) - 3
        best = pages_of(lambda h: (h["selector"] or "", h["context"]))
        assert r.more_variants == max(0, len(best) - 5)
        for v, (n, seq, k) in zip(r.variants, best[:5], strict=True):
            mine = [h for h in own if (h["selector"] or "", h["context"]) == k]
            first = min(mine, key=lambda h: (h["seq"], h["hit"]))
            assert (v.pages, v.context, v.selector, v.message, v.html, v.actual) == (-n, k[1], first["selector"], first["message"], first["html"], first["actual"])
            assert v.urls == [u for _, u in sorted({(h["seq"], h["url"]) for h in mine})][:3]


def test_page_counts_are_taken_in_the_row(spark):
    """Own issues need no shuffle of their own; inputs with one address share what either has."""
    issue = lambda *severities: [(s,) for s in severities]
    pages = spark.createDataFrame([(0, "a", "a", 200, issue("error", "info")), (1, "b", "b", 200, []), (2, "a", "a", 200, issue("warning")), (3, "c", "c", 404, None)],
                                  "seq BIGINT, url STRING, final_url STRING, status INT, issues ARRAY<STRUCT<severity: STRING>>")
    listed = spark.createDataFrame([("a", "warning"), ("b", "info"), ("b", "info"), ("elsewhere", "error")], "url STRING, severity STRING")
    rows = rollup.page_counts_in_row(pages, listed).orderBy("seq").collect()
    assert [(r.errors, r.warnings, r.infos) for r in rows] == [(1, 2, 1), (0, 0, 2), (1, 2, 1), (0, 0, 0)]


def test_size_limits_of_sitemaps(spark, monkeypatch):
    from crawlsieve.operators import sitemaps
    from crawlsieve.sources import sitemaps as source
    monkeypatch.setattr(sitemaps, "MAX_ENTRIES", 2)
    monkeypatch.setattr(source, "MAX_BYTES", 200)
    body = "<urlset>" + "".join(f"<url><loc>https://a.example/{i}</loc></url>" for i in range(3)) + "</urlset>"
    rows = [(1, "https://a.example/1.xml", "https://a.example/1.xml", body, 200), (2, "https://a.example/2.xml", "https://a.example/2.xml", body + " " * 200, 200)]
    files = source.sitemap_files(spark.createDataFrame(rows, source.FILE_SCHEMA))
    found = sitemaps.sitemap_file_checks(files, source.sitemap_entries(files)).collect()
    assert sorted((r.type, r.severity, r.context) for r in found) == [
        ("sitemap-too-large", "error", "https://a.example/2.xml"), ("sitemap-too-many-urls", "error", "https://a.example/1.xml has 3")]


def test_stored_sitemaps_are_read_in_splits(spark, folder, monkeypatch):
    """A large file in many tasks, gzip, an index, a file that is no sitemap, comments over entries, and a cut-off end: as the whole texts read."""
    from crawlsieve.sources import sitemaps as source
    entries = "".join(f"<url>\n<loc>https://a.example/?x=1&amp;i={i}</loc>{'<lastmod>2026-01-01</lastmod>' if i % 3 else ''}</url>" + ("<!-- <url><loc>no</loc></url> -->" if i % 50 == 0 else "") for i in range(6000))
    bodies = {
        "large.xml": f'<?xml version="1.0"?>\n<urlset xmlns="x">{entries}</urlset>', "index.xml": "<sitemapindex><sitemap><loc>https://a.example/1.xml</loc></sitemap><sitemap/></sitemapindex>",
        "other.xml": "<html><url><loc>no</loc></url></html>", "none.xml": "no markup", "single.xml": "<urlset><url/><url ><loc><![CDATA[ https://b?a&b ]]></loc></url ></urlset>",
        "cut.xml": "<urlset><url><loc>https://a.example/1</loc></url><url><loc>https://a.example/2</loc>", "comments.xml": "<urlset><!-- <url></url> --><!-- a --><url><loc>1</loc></url><!-- <url></url><url><loc>3</loc></url>--></urlset>"}
    for name, body in bodies.items():
        with open(f"{folder}/{name}", "w") as out:
            out.write(body)
    with gzip.open(f"{folder}/packed.xml.gz", "wt") as out:
        out.write(bodies["large.xml"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        chunks = source.read_sitemap_chunks(spark, folder)
        tasks = chunks.filter("url LIKE '%large.xml'").select(F.spark_partition_id()).distinct().count()
        files = source.stored_sitemap_files(chunks)
        got = sorted(tuple(r) for r in source.stored_sitemap_entries(chunks, files).selectExpr("file_url", "pos", "loc", "lastmod").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = source.sitemap_files(read_sitemaps(spark, folder))
    want = sorted(tuple(r) for r in source.sitemap_entries(whole).selectExpr("file_url", "pos", "loc", "lastmod").collect())
    assert tasks >= 10 and len(want) == 2 * 6000 + 6 and got == want
    key = lambda r: (r.url, r.kind, r.error, r.too_large)
    assert sorted(map(key, files.collect()), key=str) == sorted(map(key, whole.collect()), key=str)
    monkeypatch.setattr(source, "MAX_BYTES", 200)
    large = source.stored_sitemap_files(chunks)
    assert {r.url.split("/")[-1] for r in large.filter("too_large").collect()} == {"large.xml", "packed.xml.gz"}
    assert source.stored_sitemap_entries(chunks, large).filter("file_url LIKE '%large%'").count() == 0


def test_audit_with_everything_stored(spark):
    """Sitemap, robots.txt, link outcomes and lab runs beside the crawl: an orphan is found because all links are known."""
    html = "<title>{}</title><a href=/a>a</a>"
    pages = as_crawl(spark.createDataFrame([(0, "https://s.example/", html.format("h")), (1, "https://s.example/a", html.format("a")), (2, "https://s.example/b", html.format("b"))], "seq BIGINT, url STRING, html STRING"))
    locs = "".join(f"<url><loc>https://s.example/{p}</loc><lastmod>2026-01-0{i + 1}</lastmod></url>" for i, p in enumerate(("", "a", "b")))
    bodies = spark.createDataFrame([(0, "https://s.example/m.xml", "https://s.example/m.xml", f"<urlset>{locs}</urlset>", 200)], "file_seq INT, url STRING, final_url STRING, body STRING, http_status INT")
    entries = spark.createDataFrame([(i, f"https://s.example/{p}", "sitemap", "https://s.example/m.xml", False, None) for i, p in enumerate(("", "a", "b"))],
                                    "seq BIGINT, value STRING, source STRING, sitemap STRING, lighthouse BOOLEAN, rejected STRING")
    robots = spark.createDataFrame([("https://s.example", 200, "User-agent: *\nDisallow: /b", None)], "origin STRING, http_status INT, body STRING, error STRING")
    outcomes = spark.createDataFrame([], "url STRING, status INT, final_url STRING, redirects ARRAY<STRUCT<url: STRING, status: INT, location: STRING>>, canonical STRING, failed STRING")
    lab = spark.createDataFrame([("https://s.example/a", 1, json.dumps({"categories": {"seo": {"score": 0.4, "auditRefs": []}}, "audits": {}}), None)], "url STRING, run INT, result STRING, error STRING")
    result = audit(pages, robots_files=robots, sitemap_bodies=bodies, entries=entries, link_outcomes=outcomes, lab_runs=lab)
    found = {(r.type, r.url) for r in result.site_members.collect()}
    assert found == {("orphan-page", "https://s.example/b"), ("blocked-by-robots", "https://s.example/b")}
    assert {(r.url, r.severity) for r in result.page_issues.filter("type = 'score-low-seo'").collect()} == {("https://s.example/a", "warning")}
    assert [r.sitemap_lastmod for r in result.pages.orderBy("seq").collect()] == ["2026-01-01", "2026-01-02", "2026-01-03"]
    assert result.origins.collect()[0].ai_search["OAI-SearchBot"] == "partial"
    assert result.health.collect()[0].asDict() == {"errors": 0, "warnings": 3, "clean": 0}
    assert result.findings.filter("type = 'orphan-page'").collect()[0].pages == 1 and result.page_lines.count() == 3


def _run_inputs(spark):
    """Three pages in a sitemap, one more in an argument; every link leads to a page of the crawl."""
    html = "<title>{}</title><a href=/a>a</a>"
    pages = as_crawl(spark.createDataFrame([(0, "https://s.example/", html.format("h")), (1, "https://s.example/a#x", html.format("a")), (2, "https://s.example/b", html.format("b")), (3, "https://s.example/a", "later"), (9, "https://s.example/unasked", "x")], "seq BIGINT, url STRING, html STRING"))
    locs = "".join(f"<url><loc>https://s.example/{p}</loc></url>" for p in ("", "a", "b"))
    schema = "file_seq INT, url STRING, final_url STRING, body STRING, http_status INT, given BOOLEAN"
    bodies = [(0, "https://s.example/m.xml", "https://s.example/m.xml", f"<urlset>{locs}</urlset>", 200, True)]
    return pages, bodies, schema, spark.createDataFrame([], links.OUTCOME_SCHEMA)


def test_run_from_inputs_to_coverage(spark, folder):
    pages, bodies, schema, outcomes = _run_inputs(spark)
    run = run_audit(pages, sitemap_bodies=spark.createDataFrame(bodies, schema), link_outcomes=outcomes)
    assert {(r.seq, r.url) for r in run.audit.pages.collect()} == {(0, "https://s.example/"), (1, "https://s.example/a"), (2, "https://s.example/b")}
    assert {r.url for r in run.audit.site_members.filter("type = 'orphan-page'").collect()} == {"https://s.example/b"}
    row = run.coverage.first()
    assert (row.found, row.audited, row.limit, row.sitemaps_complete, row.complete) == (3, 3, None, True, True)
    assert [(n.check, n.reason) for n in row.not_run] == [("lighthouse", "not asked for")] and run.skipped.count() == 0
    write_run(folder, run)
    assert spark.read.json(f"{folder}/report/coverage").first().audited == 3 and spark.read.json(f"{folder}/digest/findings").count() > 0


def test_a_cut_or_unread_run_tells_no_orphans(spark):
    pages, bodies, schema, outcomes = _run_inputs(spark)
    args = entries_from_args(spark, ["https://s.example/b", "ftp://s.example/x", "https://s.example/gone"])
    cut = run_audit(pages, args=args, sitemap_bodies=spark.createDataFrame(bodies, schema), link_outcomes=outcomes, limit=2)
    row = cut.coverage.first()
    assert (row.found, row.audited, row.limit) == (4, 2, 2) and [n.reason for n in row.not_run] == ["not asked for", "only 2 of 4 URLs were audited"]
    assert {(r.url, r.error) for r in cut.audit.pages.collect()} == {("https://s.example/b", None), ("https://s.example/gone", "no stored record")}
    assert cut.audit.page_issues.filter("type = 'fetch-failed'").count() == 1
    assert [(r.input, r.source) for r in cut.skipped.collect()] == [("ftp://s.example/x", "argument")]
    assert cut.audit.site_members.filter("type = 'orphan-page'").count() == 0
    index = (1, "https://s.example/i.xml", "https://s.example/i.xml", "<sitemapindex><sitemap><loc>https://s.example/m2.xml</loc></sitemap><sitemap><loc>https://s.example/lost.xml</loc></sitemap></sitemapindex>", 200, True)
    child = (None, "https://s.example/m2.xml", "https://s.example/m2.xml", bodies[0][3], 200, False)
    unread = run_audit(pages, sitemap_bodies=spark.createDataFrame([index, child], schema), link_outcomes=outcomes, marked=spark.createDataFrame([("https://s.example/a",)], "value STRING"))
    row = unread.coverage.first()
    assert (row.found, row.audited, row.sitemaps_complete) == (3, 3, False)
    assert [(n.check, n.reason) for n in row.not_run] == [("lighthouse", "no runs are stored"), ("orphan-page", "a sitemap file could not be read")]
    assert unread.audit.site_members.filter("type = 'orphan-page'").count() == 0 and [r.url for r in unread.urls.filter("marked").collect()] == ["https://s.example/a"]
    assert [r.input for r in unread.skipped.collect()] == ["https://s.example/lost.xml"]


def test_targets_without_an_outcome_are_open_ends(spark):
    edges = spark.createDataFrame([(1, "https://a.example/", "https://a.example/", "https://a.example/x"), (1, "https://a.example/", "https://a.example/", "https://a.example/y")], "seq int, url string, final_url string, target string")
    outcomes = spark.createDataFrame([("https://a.example/x", 200, "https://a.example/x", [], None, None)], links.OUTCOME_SCHEMA)
    pages = spark.createDataFrame([(1, [])], "seq int, issues array<struct<type:string>>")
    row = links.links_complete(outcomes, links.targets_checked(edges, outcomes), pages).first()
    assert (row.checked, row.unchecked, row.complete) == (1, 1, False)
    assert links.targets_to_fetch(edges, outcomes)[0].count() == 1


def test_content_names_stay_unique(spark):
    urls = ["https://a.example/x", "http://a.example/x", "https://a.example/x-2", "https://a.example/X", "https://a.example/y"]
    pages = spark.createDataFrame([(i, u, "t", "main", "text") for i, u in enumerate(urls)], "seq int, url string, title string, main_area string, main_text string")
    names = {r.seq: r.content_name for r in report.content_table(pages).collect()}
    assert len({n.lower() for n in names.values()}) == 5 and names[4] == "a.example_y.md" and names[2] == "a.example_x-2.md"


def test_every_foreign_host_of_a_sitemap_is_tested(spark):
    hosts = [f"https://h{i:02}.example" for i in range(30)]
    files = spark.createDataFrame([(1, "https://s.example/map.xml", "https://s.example/map.xml", "urlset")], "file_seq int, url string, final_url string, kind string")
    entries = spark.createDataFrame([("https://s.example/map.xml", "urlset", i, f"{h}/p") for i, h in enumerate(hosts)], "file_url string, kind string, pos int, loc string")
    named = spark.createDataFrame([(h, "ok", ["https://s.example/map.xml"]) for h in hosts[:29]], "origin string, status string, sitemaps array<string>")
    assert [r.context for r in sitemaps.off_host(files, entries, named).collect()] == ["https://s.example/map.xml lists https://h29.example"]
    assert sitemaps.off_host(files, entries, named.unionByName(spark.createDataFrame([(hosts[29], "ok", ["https://s.example/map.xml"])], named.schema))).count() == 0


def test_link_labels_replace_links(spark):
    from crawlsieve.operators import lab
    texts = {"see [the guide](https://a.example/x_(y)) now": "see the guide now", "a [b](c d) e": "a [b](c d) e", "([x](https://u.example)).": "(x).", "no link](here": "no link](here", "": ""}
    for text, want in texts.items():
        row = spark.createDataFrame([(text,)], "t string").selectExpr(f"array_join({lab._unlinked(lab._link_parts('t'))}, '') AS out").first()
        assert row.out == want
