"""Merging URL inputs into the list to audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import col
from ..functions.urls import normalize_url


def normalised_entries(entries: DataFrame) -> DataFrame:
    """Entries with what ``normalize_url`` says about their value, and why they are skipped, if they are."""
    judged = entries.withColumn("n", col(normalize_url("value")))
    return judged.withColumn("reason", col("coalesce(rejected, n.reason)"))


def skipped_entries(entries: DataFrame) -> DataFrame:
    return normalised_entries(entries).filter("reason IS NOT NULL").select("seq", F.col("value").alias("input"), "source", "reason")


def resolve_urls(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """(url, page_key, marked, position): one row per page in input order, the first spelling kept.

    ``limit`` keeps the first pages and every marked one.  Positions come from a global order only when a limit is set.
    """
    usable = normalised_entries(entries).filter("reason IS NULL")
    pages = usable.groupBy(col("n.key").alias("page_key")).agg(
        F.min_by(col("n.url"), "seq").alias("url"), F.min("seq").alias("seq"), F.bool_or(F.coalesce("lighthouse", F.lit(False))).alias("marked"))
    if limit is None:
        return pages
    # The seq of the limit-th page bounds the list: a top-k, not a global sort of all pages.
    last = pages.select("seq").orderBy("seq").limit(limit).agg(F.max("seq").alias("last"))
    return pages.filter((F.col("seq") <= last.scalar()) | F.col("marked"))


def listings(entries: DataFrame) -> DataFrame:
    """(page_key, url, sitemap, listed_url): where sitemaps list each page, under the page's kept spelling."""
    usable = normalised_entries(entries).filter("reason IS NULL")
    spelled = usable.groupBy(col("n.key").alias("page_key")).agg(F.min_by(col("n.url"), "seq").alias("url"))
    listed = usable.filter("sitemap IS NOT NULL").groupBy(col("n.key").alias("page_key"), "sitemap", col("n.url").alias("listed_url")).agg(F.min("seq").alias("seq"))
    return listed.join(spelled, "page_key")


