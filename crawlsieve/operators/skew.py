"""Joins and materialisation that hold when one key has a third of all rows, and when executors are lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 16


#: A key is hot that may hold more than this share of the rows; there are at most its inverse of them.
HOT_SHARE = 1 / 256


def hot_keys(rows: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys that hold more than ``share`` of the rows, by a sketch of frequent items: one pass, no shuffle of rows, at most 1 / ``share`` keys.

    The sketch misses no such key; others that it names are salted in vain, which costs little.
    """
    found = rows.select(F.col(key).alias("key")).filter("key IS NOT NULL").stat.freqItems(["key"], share).first()
    return sorted(found[0] or [])


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", spread: str = "url", salts: int = SALTS, hot: tuple[str, list] | None = None) -> DataFrame:
    """Equi-join of a possibly skewed side with a side that has one row a key.

    Rows of a hot key are spread over ``salts`` tasks by a hash of ``spread``; the other side's row of that key is repeated once per
    salt.  ``hot`` names a column of the join and its hot values (``hot_keys``): only these are spread and repeated.  Without it every key is, with fewer
    salts where the other side is long.  Inner, left, semi and anti joins keep their meaning.
    """
    if hot is not None and not hot[1]:
        return many.join(one, keys, how)
    is_hot = F.lit(True) if hot is None else F.coalesce(F.col(hot[0]).isin(hot[1]), F.lit(False))
    salted = many.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    repeated = one.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def top_k(df: DataFrame, keys: list[str], order: list, k: int, number: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; ``number`` names a column for their places from 1.

    A filter on ``row_number`` makes Spark cut each group to ``k`` rows a task before the shuffle, so a group that
    holds most of the table still reaches its window as a few rows per task.
    """
    ranked = df.withColumn(number or "_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(number or "_r") <= k)
    return ranked if number else ranked.drop("_r")


def shared_folder(spark) -> str:
    """The checkpoint folder of the cluster, as its session names it.

    A local master may go without: it gets a temporary folder.  Elsewhere executors and driver do not see each other's
    disks, so a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write a table once and read it back: lineage is cut on shared storage, and consumers prune its columns."""
    folder = folder or shared_folder(df.sparkSession)
    path = f"{folder.rstrip('/')}/crawlsieve/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
