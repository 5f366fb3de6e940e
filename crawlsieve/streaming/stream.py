"""Page audits over crawl records as they arrive.

The page audit is a projection of each record, so it runs on a stream as it is: no state besides the watermark that
drops repeats of a page.  The running summary keeps keyed state: a row of counts for each page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions.sql import col
from ..functions.urls import page_key
from ..operators.issues import issue_rows
from ..operators.pages import page_columns
from ..operators.rollup import SEVERITIES, count_severities
from ..sources.crawl import CRAWL_SCHEMA

STREAM_SCHEMA = CRAWL_SCHEMA + ", fetched_at TIMESTAMP"


def read_crawl_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_page_audit(crawl: DataFrame, watermark: str = "1 hour", only_checks=None) -> DataFrame:
    """(fetched_at, seq, url, issue...) of each new page, once per page key within the watermark."""
    fresh = crawl.withColumn("page_key", col(page_key("url"))).withWatermark("fetched_at", watermark).dropDuplicatesWithinWatermark(["page_key"])
    audited = page_columns(fresh, "issues", only_checks=only_checks, keep=("seq", "url", "final_url", "status", "fetched_at"))
    return audited.select("fetched_at", "seq", "url", "status", "issues")


def stream_issue_rows(audited: DataFrame) -> DataFrame:
    return issue_rows(audited)


def latest_counts(state: DataFrame) -> DataFrame:
    """Severity counts of the newest record of each page (T2), of a table of records."""
    newest = state.withColumn("r", F.row_number().over(W.partitionBy("url").orderBy(F.desc("fetched_at"), F.desc("seq")))).filter("r = 1")
    rows = newest.select("url", col("explode_outer(issues)").alias("i")).select("url", "i.severity")
    return rows.groupBy("url").agg(*count_severities())


_STATE = "fetched BIGINT, seq BIGINT, errors BIGINT, warnings BIGINT, infos BIGINT"
#: A page whose counts changed: since which record, the counts, and its worst state before (NULL for a new page) and now.
CHANGE_SCHEMA = f"url STRING, {_STATE}, was STRING, now STRING"


def _worst(counts: tuple) -> str:
    _, _, errors, warnings, _ = counts
    return "errors" if errors else "warnings" if warnings else "clean"


def _newest(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the newest record of one page and tells when it replaced an older one.  Rows come in chunks, so a page of many records needs no more memory."""
    known = tuple(state.get) if state.exists else None
    best = known
    for chunk in chunks:
        row = chunk.sort_values(["fetched", "seq"]).iloc[-1]
        found = tuple(int(row[name]) for name in ("fetched", "seq", "errors", "warnings", "infos"))
        if best is None or found[:2] > best[:2]:
            best = found
    if best != known:
        state.update(best)
        yield pd.DataFrame([(key[0], *best, None if known is None else _worst(known), _worst(best))],
                           columns=["url", "fetched", "seq", "errors", "warnings", "infos", "was", "now"])


def page_changes(crawl: DataFrame, only_checks=None) -> DataFrame:
    """A stream of the pages whose newest record changed (T2): the state holds one row of counts a page.

    A batch costs what its own records cost: their audit, one shuffle of five numbers a record, and a look-up of their pages in the state.
    A record that is older than the one known, or as old with no greater ``seq``, changes nothing; one without a time is older than any.
    """
    audited = page_columns(crawl, "issues", only_checks=only_checks, keep=("seq", "url", "final_url", "status", "fetched_at"))
    counts = [col(f"CAST(size(filter(issues, i -> i.severity = '{severity}')) AS BIGINT)").alias(name) for severity, name in SEVERITIES]
    least = -(1 << 63)
    rows = audited.select("url", F.coalesce(F.unix_micros("fetched_at"), F.lit(least)).alias("fetched"), F.coalesce(F.col("seq").cast("bigint"), F.lit(least)).alias("seq"), *counts)
    return rows.groupBy("url").applyInPandasWithState(_newest, CHANGE_SCHEMA, _STATE, "update", "NoTimeout")


def stream_summary(crawl: DataFrame, folder: str, only_checks=None):
    """A streaming writer that keeps, under ``folder``, counts per page and page health up to date.

    A batch writes the pages that changed in it (``changes/epoch=n``) and, from these and the row before it, the health of all pages
    (``health/epoch=n``).  No earlier changes are read.  A batch that is run again gives the same rows and overwrites its own folders.
    """
    def update(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/changes/epoch={epoch}")
        changes = spark.read.schema(CHANGE_SCHEMA).parquet(f"{folder}/changes/epoch={epoch}")
        moved = changes.agg(*[(F.count_if(F.col("now") == name) - F.count_if(F.col("was") == name)).alias(name) for name in HEALTH])
        if epoch:
            before = spark.read.schema(_HEALTH_SCHEMA).parquet(f"{folder}/health/epoch={epoch - 1}")
            moved = moved.unionByName(before).agg(*[F.sum(name).alias(name) for name in HEALTH])
        moved.write.mode("overwrite").parquet(f"{folder}/health/epoch={epoch}")

    return page_changes(crawl, only_checks).writeStream.outputMode("update").foreachBatch(update).option("checkpointLocation", f"{folder}/_checkpoint")


HEALTH = ("errors", "warnings", "clean")
_HEALTH_SCHEMA = ", ".join(f"{name} BIGINT" for name in HEALTH)


def summary_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the newest record of every page that ``stream_summary`` has seen: url, errors, warnings, infos."""
    changes = spark.read.schema(f"{CHANGE_SCHEMA}, epoch BIGINT").parquet(f"{folder}/changes")
    newest = changes.groupBy("url").agg(F.max_by(F.struct("errors", "warnings", "infos"), "epoch").alias("c"))
    return newest.select("url", "c.*")


def summary_health(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by their worst state after the last batch, one row."""
    rows = spark.read.schema(f"{_HEALTH_SCHEMA}, epoch BIGINT").parquet(f"{folder}/health")
    return rows.orderBy(F.desc("epoch")).limit(1).select(*HEALTH)
