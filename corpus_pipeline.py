"""From raw documents to token ids: toxicity, near duplicates, benchmark passages, personal data, byte-level BPE.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.  ``run`` writes
what a stage returns to the shared folder and reads it back for the next.  Rows are told apart by a number of their own, so null
or repeated doc_ids, and columns of any name, pass through.  An empty table passes all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsieve.llm import bpe, chosen_path, decontaminate, pii, toxicity
from crawlsieve.llm.common import table, written
from crawlsieve.llm.sharedmap import without


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number each, written once so that every later read sees the same numbers; and the column's name."""
    name = "row"
    while name in docs.columns:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the document of the least doc_id (a row without one only if no other has one)."""
    rows, row = _numbered(docs)
    groups = chosen_path.similar(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col("class_id").alias("_group"))
    members = written(groups.join(rows.select(row, "doc_id"), row), "members")  # numbers only
    first = members.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row)).alias("first")).select(F.col(f"first.{row}").alias(row))
    return without(rows, row, members.select(row).join(first, row, "left_anti"), "copies").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    rows, row = _numbered(docs)
    bad = decontaminate.contaminated(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, row, bad.select("doc_id"), "contaminated").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    return pii.sanitised(docs, pii.disclosing_terms(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the text that these decode to."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("byte_bpe", encode),
]

#: Learned weights and token merges are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
