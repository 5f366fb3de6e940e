"""Stored robots.txt files (S9, J7): what their answer means, their rules, sitemaps and content signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sql import col
from ..functions.text import limit_text
from ..functions.urls import percent_encode

ROBOTS_SCHEMA = "origin STRING, http_status INT, body STRING, error STRING, redirects INT"
MAX_BYTES, MAX_REDIRECTS, MAX_SIGNAL = 500 * 1024, 5, 300  # Fixed values: how search engines read the file.


def read_robots(spark: SparkSession, path: str) -> DataFrame:
    return robots_status(spark.read.parquet(path))


def robots_status(files: DataFrame) -> DataFrame:
    """ok, missing, unreachable or failed, with the part of the file that counts."""
    redirects = "coalesce(redirects, 0)" if "redirects" in files.columns else "0"
    status = (f"CASE WHEN {redirects} > {MAX_REDIRECTS} THEN 'missing' WHEN error IS NOT NULL THEN 'failed' WHEN http_status = 200 THEN 'ok' "
              f"WHEN http_status >= 500 OR http_status = 429 THEN 'unreachable' ELSE 'missing' END")
    cut = (f"CASE WHEN octet_length(body) <= {MAX_BYTES} THEN body ELSE CAST(substring(CAST(body AS BINARY), 1, {MAX_BYTES}) AS STRING) END")
    return files.select("origin", col(status).alias("status"), "http_status", "error",
                        col(f"CASE WHEN ({status}) = 'ok' THEN coalesce({cut}, '') END").alias("body"))


def robots_lines(robots: DataFrame) -> DataFrame:
    """Keyed lines of each file with the number of the user-agent group they are in.

    A file is at most 500 KiB, so the window of one origin is small whatever the number of its pages.
    """
    lines = robots.filter("status = 'ok'").select("origin", col(r"posexplode(split(body, '\\r\\n|\\r|\\n')) AS (line, raw)"))
    keyed = lines.withColumn("raw", col("regexp_replace(raw, '#.*', '')")).filter("instr(raw, ':') > 0").select(
        "origin", "line", col("lower(trim(substring_index(raw, ':', 1)))").alias("key"),
        col("trim(substr(raw, instr(raw, ':') + 1))").alias("value")).filter("key <> ''")
    order = W.partitionBy("origin").orderBy("line")
    is_agent = F.col("key") == "user-agent"
    starts = is_agent & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    return keyed.withColumn("starts", starts.cast("int")).withColumn(
        "group", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("starts")


def robots_rules(robots: DataFrame) -> DataFrame:
    """(origin, agent, allow, pattern, line): each rule for each agent of its group."""
    lines = robots_lines(robots)
    agents = lines.filter("key = 'user-agent' AND value <> ''").select(
        "origin", "group", col("trim(substring_index(lower(value), '/', 1))").alias("agent")).distinct()
    rules = lines.filter("key IN ('allow', 'disallow') AND value <> ''").select(
        "origin", "group", "line", (F.col("key") == "allow").alias("allow"), col(percent_encode("value")).alias("pattern"))
    return rules.join(agents, ["origin", "group"]).select("origin", "agent", "allow", "pattern", "line")


def robots_sets(robots: DataFrame) -> DataFrame:
    """One row per origin: rules by agent, sitemaps, content signal.  Bounded by the size of one file."""
    escaped = r"regexp_replace(regexp_replace(pattern, r'([.+?^{}()|\[\]\\])', r'\\$1'), r'\$(?!$)', r'\\\$')"
    regex = f"concat('^', replace({escaped}, '*', '.*'))"
    ruled = robots_rules(robots).select(
        "origin", "agent", F.struct("allow", "pattern", col(f"CASE WHEN pattern RLIKE r'[*$]' THEN {regex} END").alias("regex")).alias("rule"))
    by_agent = ruled.groupBy("origin", "agent").agg(F.collect_list("rule").alias("rules")).groupBy("origin").agg(
        F.map_from_entries(F.collect_list(F.struct("agent", "rules"))).alias("rules"))
    lines = robots_lines(robots)
    sitemaps = lines.filter("key = 'sitemap' AND value <> ''").groupBy("origin").agg(F.collect_set("value").alias("sitemaps"))
    return (robots.select("origin", "status", "http_status", "error").join(by_agent, "origin", "left").join(sitemaps, "origin", "left")
            .join(content_signal(robots), "origin", "left"))


def content_signal(robots: DataFrame) -> DataFrame:
    """The Content-Signal for every crawler: in a group for *, or before any group."""
    lines = robots_lines(robots)
    for_all = lines.filter("key = 'user-agent' AND value = '*'").select("origin", "group").distinct().withColumn("for_all", F.lit(True))
    signals = lines.filter("key = 'content-signal' AND value <> ''").join(for_all, ["origin", "group"], "left").filter("group = 0 OR for_all")
    return signals.groupBy("origin").agg(F.min_by("value", "line").alias("v")).select("origin", col(limit_text("v", MAX_SIGNAL)).alias("content_signal"))
