"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch holds changes of documents' counts: inserts, deletes and revisions.  Its effect on the totals is the sum of its new counts less what
the ledger holds for the same (doc_id, version).  Committing a batch writes these sums and its ledger rows under the batch's name;
totals are the sum over all batches, so they never have to be counted again from texts.

The ledger lies in folders by a hash of (doc_id, version), so a small batch reads the part of it that its own documents fall into.

A commit is complete when Spark's marker of the last of its two tables is there.  A batch that is complete is not committed
again, one that was interrupted is written anew: repeating a commit changes nothing.  Batches are committed one after another,
by one writer.

Cases: several rows of one (doc_id, version) in a batch count as one, the greatest count (then source, lang).  An insert of a pair that the ledger
has revises it; a revision of one that it has not inserts it; a delete of one that it has not does nothing.  Rows without doc_id
cannot be addressed later: inserts count each, others do nothing.  A null n_tokens counts as 0, null source and lang are groups of their own.
A batch with another op, or a null one, is refused whole.
Groups whose documents are all deleted leave the totals.  Empty batches are batches.  Other columns are not read.
"""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _file_system, new_folder

_GROUP = ["source", "lang", "version"]
_LEDGER = "doc_id long, version string, source string, lang string, n_tokens long, live boolean, turn int, bucket int"
#: Folders of a batch's ledger rows, by a hash of document and version: a commit reads those that its own rows fall into.
BUCKETS = 16
_DELTA = "source string, lang string, version string, docs long, tokens long, turn int"

#: Counts by name: white-space words; runs of letters, runs of digits and single other characters.
COUNTERS: dict[str, str] = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-1": r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]",
}


def counted(text: Column, version: str) -> Column:
    """How many tokens of a version a text has."""
    return F.coalesce(F.regexp_count(text, F.lit(COUNTERS[version])), F.lit(0)).cast("long")


class Rollup:
    """A folder of batches.  ``commit`` adds one, ``totals`` sums them all, ``ledger`` tells the count of each document."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or new_folder(spark, "token-counts")

    def _done(self, batch: str) -> bool:
        system, path = _file_system(f"{self.folder}/deltas/batch={batch}/_SUCCESS")
        return system.get_file_info(path).type == fs.FileType.File

    def _batches(self) -> list[str]:
        """Complete batches."""
        system, path = _file_system(f"{self.folder}/deltas")
        if system.get_file_info(path).type != fs.FileType.Directory:
            return []
        names = [f.base_name.removeprefix("batch=") for f in system.get_file_info(fs.FileSelector(path))]
        return sorted(b for b in names if self._done(b))

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/batch={b}" for b in self._batches()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths).drop("batch")

    def ledger(self, buckets: list[int] | None = None) -> DataFrame:
        """doc_id, version, source, lang, n_tokens of every document that is counted (of some buckets); of several batches the last tells."""
        rows = self._read("ledger", _LEDGER)
        last = (rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))).groupBy("doc_id", "version").agg(F.max_by(F.struct("source", "lang", "n_tokens", "live"), "turn").alias("x"))
        return last.filter("x.live").select("doc_id", "version", "x.source", "x.lang", "x.n_tokens")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens."""
        sums = self._read("deltas", _DELTA).groupBy(*_GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 OR tokens <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of (op, doc_id, version, source, lang, n_tokens), op being insert, delete or revise; False if it is there."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"not a name for a batch: {batch!r}")
        if self._done(batch):
            return False
        if changes.filter("op IS NULL OR op NOT IN ('insert', 'delete', 'revise')").limit(1).count():
            raise ValueError("a change is an insert, a delete or a revise")
        turn = len(self._batches())
        rows = changes.select("op", F.col("doc_id").cast("long").alias("doc_id"), F.col("version").cast("string").alias("version"), F.col("source").cast("string").alias("source"),
                              F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
        known = rows.filter("doc_id IS NOT NULL").groupBy("doc_id", "version").agg(F.max(F.struct((F.col("op") != "delete").alias("live"), "n_tokens", "source", "lang")).alias("x"))
        known = known.select("doc_id", "version", "x.source", "x.lang", "x.n_tokens", "x.live", F.lit(turn).alias("turn"),
                             F.pmod(F.xxhash64("doc_id", "version"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        path = f"{self.folder}/ledger/batch={batch}"
        known.repartition(BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        known = self.spark.read.schema(_LEDGER).parquet(path)
        before = self.ledger([r.bucket for r in known.select("bucket").distinct().collect()])  # at most BUCKETS
        added = known.filter("live").select(*_GROUP, F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"))
        nameless = rows.filter("doc_id IS NULL AND op = 'insert'").select(*_GROUP, F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"))
        taken = before.join(known.select("doc_id", "version"), ["doc_id", "version"], "left_semi").select(*_GROUP, F.lit(-1).alias("docs"), (-F.col("n_tokens")).alias("tokens"))
        deltas = added.unionByName(nameless).unionByName(taken).groupBy(*_GROUP).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").alias("tokens"))
        deltas.withColumn("turn", F.lit(turn)).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")
        return True
