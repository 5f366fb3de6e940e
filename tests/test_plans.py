"""What Spark makes of a query: expensive columns are worked out once, and small files are dealt out to tasks."""

import os
import re
import time

import pytest

import __spark_entry__ as entry
from crawlsieve.functions.sql import col, let
from crawlsieve.functions.text import SPACES, collapse_ws
from crawlsieve.operators.pages import _bind_stages, page_audit, page_columns
from crawlsieve.sources.crawl import as_crawl
from crawlsieve.queries.store import PRODUCT, product_pages


def optimized(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxPlanStringLength", 2**30)
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture()
def sf(spark, folder):
    """Two rows of part and six events of two users."""
    spark.sql("SELECT * FROM VALUES (1L, 'red ring', 'Brand#1', 'SMALL', 7, 1.5D), (2L, 'hot bolt', 'Brand#2', 'LARGE', 30, 2.0D) AS t(p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)").write.parquet(f"{folder}/part.parquet")
    spark.sql("SELECT id AS event_id, id % 2 AS user_id, CASE id WHEN 3 THEN 'error' ELSE 'view' END AS event_type, 10.0D * id AS value FROM range(6)").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ("products", "product_variants", "authorship", "jsonld_objects", "jsonld_blocks"))
def test_array_is_not_worked_out_for_a_filter(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert optimized(df).count("parse_json") + optimized(df).count("parseJson") <= 1
    assert df.select("p_partkey").distinct().count() == 2


@pytest.mark.parametrize("name,scans", (("lab_failing_audits", 2), ("lab_audit_items", 2), ("lab_score_spread", 2), ("lab_audits", 6)))
def test_document_is_parsed_once_a_scan(spark, sf, name, scans):
    plan = optimized(entry.queries()[name](spark, sf))
    assert len(re.findall("parseJson|parse_json", plan)) <= scans


def test_lab_runs_rank_and_range(spark, sf):
    rows = {r.url[-1]: (r.lo, r.hi) for r in entry.queries()["lab_score_spread"](spark, sf).collect()}
    assert rows == {"0": (60, 100), "1": (50, 90)}


def test_rows_of_a_small_file_are_dealt_out(spark, sf):
    assert product_pages(spark, sf, PRODUCT).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_column_of_an_earlier_stage_is_read_outside_of_lambdas(spark, sf):
    first, second = _bind_stages([{"a": "transform(nodes, n -> n.x)"}, {"b": "filter(nodes, n -> array_contains(a, n.y))", "c": "size(a)"}])
    assert first == {"a": "transform(nodes, n -> n.x)"}
    assert second == {"b": "transform(array(a), a -> filter(nodes, n -> array_contains(a, n.y)))[0]", "c": "size(a)"}
    assert page_columns(product_pages(spark, sf, PRODUCT), "products").count() == 2


@pytest.mark.parametrize("files", (1, 3))
def test_stream_reads_a_table_of_one_file_or_several(spark, folder, files):
    pages = spark.sql("SELECT id AS page_id, concat('https://a.example/', id) AS url, '<html><body>x</body></html>' AS html FROM range(6)")
    pages.repartition(files).write.parquet(f"{folder}/{'pages.parquet' if files > 1 else 'one'}")
    if files == 1:
        part = next(f for f in os.listdir(f"{folder}/one") if f.endswith(".parquet"))
        os.link(f"{folder}/one/{part}", f"{folder}/pages.parquet")
    assert entry.queries()["stream_page_audit"](spark, folder).count() == 18


def test_rules_of_agents_are_tried_once_a_page(spark, folder):
    spark.sql("SELECT id AS c_custkey, id % 7 AS c_nationkey, 'AUTO' AS c_mktsegment FROM range(14)").write.parquet(f"{folder}/customer.parquet")
    spark.sql("SELECT id AS n_nationkey FROM range(7)").write.parquet(f"{folder}/nation.parquet")
    df = entry.queries()["robots_checks"](spark, folder)
    assert len(re.findall("googlebot", optimized(df))) == 1
    found = {}
    for r in df.collect():
        found.setdefault(r.type, set()).add(int(r.url.rsplit("/", 1)[1]))
    assert found == {"robots-txt-failed": {4, 11}, "robots-txt-unreachable": {2, 9}, "blocked-by-robots": {1, 8, 6, 13}}


@pytest.mark.parametrize("name", ("sitemap_file_findings", "sitemap_file_checks", "sitemap_off_host", "site_wide_issues"))
def test_entries_are_cut_out_once(spark, folder, name):
    spark.sql("SELECT id AS o_orderkey, id % 2 AS o_custkey, DATE '2024-01-01' AS o_orderdate FROM range(36)").write.parquet(f"{folder}/orders.parquet")
    spark.sql("SELECT id AS c_custkey, id % 7 AS c_nationkey, 'AUTO' AS c_mktsegment FROM range(4)").write.parquet(f"{folder}/customer.parquet")
    df = entry.queries()[name](spark, folder)
    assert "</url" not in optimized(df) and df.count() > 0


def test_language_pages_are_keyed_once(spark, folder):
    spark.sql("SELECT id AS c_custkey, 1L AS c_nationkey FROM range(60)").write.parquet(f"{folder}/customer.parquet")
    df = entry.queries()["hreflang_targets"](spark, folder)
    assert "c_custkey" not in optimized(df)
    assert df.groupBy("type").count().collect() and df.filter("type = 'hreflang-missing-return'").count() == 40


def test_types_of_nested_values_are_worked_out_in_proportion(spark):
    nested = lambda n, value: value if n == 0 else let(f"concat({value}, '-')", lambda v: nested(n - 1, v))
    start = time.time()
    assert spark.range(1).select(col(nested(24, "CAST(id AS STRING)")).alias("v")).first().v == "0" + "-" * 24
    assert time.time() - start < 20


def test_names_bound_together_are_worked_out_in_proportion(spark):
    names = [f"c{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(22)]
    stages = _bind_stages([{name: f"transform(array({i}), x -> x)" for i, name in enumerate(names)}, {"total": f"transform(array(0), x -> x + {' + '.join(f'{n}[0]' for n in names)})"}])
    start, df = time.time(), spark.range(1)
    for stage in stages:
        df = df.withColumns({name: col(sql) for name, sql in stage.items()})
    assert df.first().total == [sum(range(22))]
    assert time.time() - start < 30


def test_whole_page_audit_is_planned_in_a_minute(spark):
    html = "<html><head><title>a</title></head><body><h1>b</h1><p>one&nbsp; two\n<a href=/x>c  d</a></body></html>"
    crawl = as_crawl(spark.createDataFrame([(1, "https://a.example/", html)], "seq BIGINT, url STRING, html STRING"))
    start = time.time()
    row = page_audit(crawl)
    optimized(row)
    assert time.time() - start < 60
    found = row.select("word_count", "main_text", "link_samples").first()
    assert (found.word_count, found.main_text, found.link_samples[0].text) == (4, "b one two c d", "c d")


def test_white_space_is_collapsed_as_before(spark):
    texts = ["", " ", "a b", " a  b ", "\t a\n\nb\t", "a\u00a0b", "a \u00a0 b", "\u0085a \u0085b", "a\u2003\ufeff\u3000b", "a\x0b\x1cb \u2028", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").selectExpr(f"{collapse_ws('t')} AS now", f"trim(regexp_replace(t, {SPACES}, ' ')) AS before")
    assert all(r.now == r.before for r in df.collect()) and df.count() == len(texts)
