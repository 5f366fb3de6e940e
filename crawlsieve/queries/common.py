"""Readers of the given tables and the SQL fragments that oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.sql import col
from ..operators.issues import issue_rows
from ..operators.pages import page_columns
from ..sources.crawl import as_crawl, read_crawl


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task makes into records.
ROWS_A_TASK = 20_000


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small file dealt out to tasks, for work that is long for a row: at least one a core, more with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK)))


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_crawl(spark, f"{sf_dir}/pages.parquet", spread=spark.sparkContext.defaultParallelism)


def decorated(spark: SparkSession, sf_dir: str, head: str = "''", body: str = "''", **columns: str) -> DataFrame:
    """Every page of ``pages`` with markup added at the end of its head and the start of its body.

    ``head``, ``body`` and further crawl columns are SQL text over (seq, url).
    """
    pages = table(spark, sf_dir, "pages").withColumnRenamed("page_id", "seq")
    added = f"replace(replace(html, '</head>', concat({head}, '</head>')), '<body>', concat('<body>', {body}))"
    return as_crawl(pages.withColumn("html", col(added)).withColumns({k: col(v) for k, v in columns.items()}))


def issues_of(df: DataFrame, *checks: str, columns: str = "type, severity, context") -> DataFrame:
    rows = issue_rows(page_columns(df, "issues", only_checks=checks))
    return rows.selectExpr("seq AS page_id", *[c.strip() for c in columns.split(", ")])


def rows_of(df: DataFrame, array: str, *columns: str) -> DataFrame:
    """A row per element of an array, as ``pos`` and ``row``.

    An outer generator and a filter on its output: with an inner one Catalyst adds a filter on the size of the array below it, which works out the array twice.
    """
    return df.selectExpr(*columns, f"posexplode_outer({array}) AS (pos, row)").filter("pos IS NOT NULL")


# DuckDB fragments over pages.
WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def d_collapse(s: str) -> str:
    return f"trim(regexp_replace({s}, '{WS}', ' ', 'g'))"


def d_unescape(s: str) -> str:
    return (f"replace(replace(replace(regexp_replace({s}, '&amp;?', '&', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·')")


def d_key(url: str) -> str:
    return f"regexp_replace(regexp_replace({url}, '#.*$', ''), '^(https?://[^/?#]+/[^?#]*[^/?#])/(\\?.*)?$', '\\1\\2')"


def d_origin(url: str) -> str:
    return f"regexp_extract({url}, '^https?://[^/?#]+')"


def d_host(url: str) -> str:
    return f"regexp_replace(regexp_extract({url}, '^https?://([^/?#]+)', 1), '^www\\.', '')"


def d_limit(s: str, n: int) -> str:
    return f"CASE WHEN length({s}) > {n} THEN left({s}, {n - 3}) || '...' ELSE {s} END"


def d_issue_id(url: str, kind: str, detail: str) -> str:
    return f"{kind} || '-' || left(sha1({url} || chr(10) || {kind} || chr(10) || {detail}), 8)"


D_TITLE = d_collapse(d_unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)"))
D_BODY = "regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*$', '')"
D_LINKS = "unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))"
D_ENCODED = "replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '+', '%20')"
