"""Crawl records and URL inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRAWL_SCHEMA = (
    "seq BIGINT, url STRING, final_url STRING, status INT, "
    "redirects ARRAY<STRUCT<url: STRING, status: INT, location: STRING>>, content_type STRING, html STRING, "
    "truncated BOOLEAN, robots_header STRING, headers MAP<STRING, STRING>, body_bytes BIGINT, error STRING"
)
ENTRY_SCHEMA = "seq BIGINT, value STRING, source STRING, sitemap STRING, lighthouse BOOLEAN, rejected STRING"
HTML_MAX_BYTES = 2 * 1024 * 1024  # Fixed value: how much of a page a search engine reads.
_DEFAULTS = {
    "final_url": "url", "status": "200", "content_type": "'text/html'", "truncated": "false",
    "redirects": "CAST(array() AS ARRAY<STRUCT<url: STRING, status: INT, location: STRING>>)",
}


def as_crawl(df: DataFrame) -> DataFrame:
    """Bring a table with at least (seq, url, html) to the crawl record shape."""
    have = set(df.columns)
    parts = []
    for field in CRAWL_SCHEMA.split(", "):
        name, kind = field.split(" ", 1) if " " in field else (field, "")
        if ":" in name or not kind or name.endswith(":"):
            continue
        if name in have:
            parts.append(name)
        elif name == "redirects":
            parts.append(f"{_DEFAULTS[name]} AS redirects")
        else:
            sql_type = {"headers": "MAP<STRING, STRING>"}.get(name, kind)
            parts.append(f"CAST({_DEFAULTS.get(name, 'NULL')} AS {sql_type}) AS {name}")
    return df.selectExpr(*parts)


def read_crawl(spark: SparkSession, path: str, spread: int | None = None) -> DataFrame:
    """A parquet table of crawl records, or of plain pages (page_id, url, html).

    Pages are parsed where their splits are read.  Parsing is CPU work: a table of few splits leaves cores idle, and its
    caller may have the rows spread over so many tasks.
    """
    df = spark.read.parquet(path)
    if "page_id" in df.columns and "seq" not in df.columns:
        df = df.withColumnRenamed("page_id", "seq")
    return as_crawl(df.repartition(spread, "seq") if spread else df)


def html_pages(crawl: DataFrame) -> DataFrame:
    """Keep HTML only where a browser would render it, and only as much as a search engine reads."""
    html = "CASE WHEN status = 200 AND error IS NULL AND coalesce(content_type, '') RLIKE '(?i)html' THEN html END"
    size = f"octet_length({html})"
    # The cut is on bytes; a letter split by it is dropped.
    cut = (f"CASE WHEN {size} <= {HTML_MAX_BYTES} THEN {html} ELSE regexp_replace(CAST(substring(CAST({html} AS BINARY), 1, "
           f"{HTML_MAX_BYTES}) AS STRING), r'\\x{{FFFD}}$', '') END")
    return crawl.withColumns({
        "truncated": F.expr(f"coalesce(truncated, false) OR coalesce({size} > {HTML_MAX_BYTES}, false)"),
        "body_bytes": F.expr(f"CASE WHEN {html} IS NOT NULL THEN coalesce(body_bytes, least({size}, {HTML_MAX_BYTES})) END"),
        "html": F.expr(cut),
    })


def entries_from_args(spark: SparkSession, values: list[str]) -> DataFrame:
    """URLs given as arguments, in order."""
    rows = [(i, v, "argument", None, False, None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, ENTRY_SCHEMA)


def parse_url_list(files: DataFrame) -> DataFrame:
    """Lines of URL list files (name, content): comments, blank lines and the marker word as in a list a person writes."""
    lines = files.selectExpr("name", r"posexplode(split(content, '\\r?\\n')) AS (line_no, line)")
    text = lines.withColumn("text", F.expr(r"trim(regexp_replace(line, r'(^|\s)#.*$', ''))")).filter("text <> ''")
    words = text.withColumn("words", F.expr(r"split(text, r'\s+')"))
    rest = "slice(words, 2, size(words))"
    marked = f"size(words) > 1 AND forall({rest}, w -> lower(w) = 'lighthouse')"
    plain = f"(size(words) = 1 OR ({marked}))"
    reason = f"concat('unexpected text after the URL (only \"lighthouse\" may follow it): ', array_join({rest}, ' '))"
    return words.selectExpr(
        "name", "line_no", f"CASE WHEN {plain} THEN words[0] ELSE text END AS value", "concat(name, ':', line_no + 1) AS source",
        "CAST(NULL AS STRING) AS sitemap", f"({marked}) AS lighthouse", f"CASE WHEN NOT {plain} THEN {reason} END AS rejected",
    )


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path AS name", "value AS content")
    return parse_url_list(files)
