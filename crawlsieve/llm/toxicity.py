"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the different words, pairs of neighbours and pairs with one word between, each hashed to one of 2 ** ``BITS``
coordinates and present or not.  Words are runs of letters, digits, apostrophes and bytes above 127, A-Z lowered.

Fit.  About ``MAX_ROWS`` labelled rows (chosen by a hash of doc_id; a documented bound, not a share of the input) go to
shards of about ``SHARD_ROWS``.  Each runs FTRL over its rows, and the state (z, n) of each coordinate is averaged over the shards, ``ROUNDS`` times: iterative
parameter mixing.  L1 leaves some hundreds to thousands of weights of at most 2 ** BITS, which travel with the scoring task.

Scoring is one pass without a shuffle.  Labels, language, source and doc_id are no features.

Cases: a null or empty text has no features: its score is that of the bias.  Rows without doc_id are scored, never learned from.
Labels of a doc_id that occurs twice count once (the greater); of equal doc_ids with different texts the least text is
learned from.  Null labels are left out.  Without labelled rows every score is 0.  Other columns are handed on by
``keep_clean`` as they are and are not read by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, mapped, new_folder, put_file, written
from .words import ALNUM, give_back, ngrams, slices, words_of

BITS = 22
MAX_ROWS, SHARD_ROWS, ROUNDS, EPOCHS = 32_768, 4_096, 2, 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.01


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and texts of all words, pairs and skip pairs, with repetitions."""
    words = words_of(column, ALNUM)
    shift = np.uint64(64 - BITS)
    parts = [(g, words.docs[at]) for g, at in (ngrams(words, 1), ngrams(words, 2), ngrams(words, 2, 1))]
    return np.concatenate([(g >> shift).astype(np.int32) for g, _ in parts]), np.concatenate([d for _, d in parts])


@dataclass
class Ftrl:
    """Per-coordinate state: sum of adjusted gradients, sum of squared gradients."""

    z: np.ndarray
    n: np.ndarray
    bias_z: float = 0.0
    bias_n: float = 0.0

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2), 0)

    def bias(self) -> float:
        return -self.bias_z / ((BETA + np.sqrt(self.bias_n)) / ALPHA)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / ALPHA * w
        root = np.sqrt(self.bias_n)
        self.bias_n += g * g
        self.bias_z += g - (np.sqrt(self.bias_n) - root) / ALPHA * b


@dataclass
class Toxicity:
    """Weights that are not zero, their coordinates, and the bias; None if nothing was learned."""

    at: np.ndarray
    weights: np.ndarray
    bias: float | None

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weights
        return out


def _learned(state: str | None):
    """FTRL over the rows of a shard, from the state in a file; gives the coordinates that it touched, -1 for the bias."""

    def task(group: pa.Table) -> pa.Table:
        rows, labels = [], []
        for batch in group.select(["text", "label"]).combine_chunks().to_batches():
            for part in slices(batch, most=1 << 20):
                at, doc = features(part.column("text"))
                pairs = np.unique(doc * (1 << BITS) + at)
                doc, at = pairs >> BITS, (pairs & ((1 << BITS) - 1)).astype(np.int32)
                rows += np.split(at, np.searchsorted(doc, np.arange(1, part.num_rows)))
                labels += part.column("label").to_pylist()
        model = Ftrl(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32))
        if state:
            old = mapped(state, "f8").reshape(3, -1)
            at = old[0, 1:].astype(np.int64)
            model = Ftrl(model.z, model.n, old[1, 0], old[2, 0])
            model.z[at], model.n[at] = old[1, 1:], old[2, 1:]
        order = np.random.default_rng(7)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                model.learn(rows[i], labels[i])
        at = np.flatnonzero((model.z > L1 / 4) | (model.z < -L1 / 4))
        out = pa.table({"at": pa.array(np.append(-1, at)), "z": pa.array(np.append(model.bias_z, model.z[at].astype(float))), "n": pa.array(np.append(model.bias_n, model.n[at].astype(float)))})
        del rows, model
        give_back()
        return out
    return task


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Toxicity:
    """Learns ``toxic`` of ``labels`` (doc_id, toxic) from the texts of ``docs``; rows with crc32(doc_id) mod 5 = 0 are left for tests."""
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id", 5, 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    n = known.count()
    if not n:
        return Toxicity(np.zeros(0, np.int64), np.zeros(0), None)
    shards = -(-min(n, max_rows) // SHARD_ROWS)
    share = int(min(1.0, max_rows / n) * 1_000_003)
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) <= share)  # about max_rows rows of 12 bytes: a broadcast
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    rows = written(rows.select("text", "label", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)).cast("int").alias("shard")), "labelled")
    state = None
    for _ in range(ROUNDS):
        states = rows.groupBy("shard").applyInArrow(_learned(state), "at long, z double, n double")
        mixed = states.groupBy("at").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).filter(f"abs(z) > {L1 * shards / 4} OR at < 0").toPandas().sort_values("at")
        if not len(mixed):
            return Toxicity(np.zeros(0, np.int64), np.zeros(0), None)
        values = np.stack([mixed["at"].to_numpy(float), mixed["z"] / shards, mixed["n"] / shards])
        state = f"{new_folder(spark, 'ftrl')}/state"
        put_file(state, [values.tobytes()])
    at = values[0, 1:].astype(np.int64)
    model = Ftrl(values[1, 1:], values[2, 1:], values[1, 0], values[2, 0])
    weights = model.weights()
    return Toxicity(at[weights != 0], weights[weights != 0].astype(np.float32), float(model.bias()))


def _scores(model: Toxicity, dense: np.ndarray, column: pa.Array) -> np.ndarray:
    if model.bias is None:
        return np.zeros(len(column))
    at, doc = features(column)
    w = dense[at]
    some = np.flatnonzero(w)
    pairs = np.unique(doc[some] * (1 << BITS) + at[some])
    sums = np.bincount(pairs >> BITS, weights=dense[pairs & ((1 << BITS) - 1)], minlength=len(column)) + model.bias
    return 1 / (1 + np.exp(-np.clip(sums, -500, 500)))


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of (doc_id, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            for part in slices(batch):
                p = _scores(model, dense, part.column("text"))
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", is_held_out("doc_id", 5, 0).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        task, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Toxicity) -> DataFrame:
    """Rows of ``docs`` that the model does not call toxic, with all their columns."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(_scores(model, dense, part.column("text")) < 0.5))
    return docs.mapInArrow(task, docs.schema)
