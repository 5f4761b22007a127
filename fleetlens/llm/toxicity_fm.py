"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words and their first 4, 5 and 6 bytes, lower-cased in
ASCII and hashed.  The machine scores presence of terms with one weight per
term and one vector per term whose inner products weigh pairs, so that an
insult next to a group mention can count for more than the two alone.

Null and empty texts have no terms and get the score of the bias alone.
Repeated rows get equal scores.  Without labelled rows of both kinds the score
is the smoothed share of toxic rows among the labelled ones.  Columns other
than doc_id and text (and doc_id and toxic of the labels) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import textblocks as B
from fleetlens.llm.samples import one_of_each

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
TRAINING_ROWS = 20_000  # labelled rows that the machine is fitted on
TERMS = 4096  # terms that it keeps, by how far they set toxic rows apart
FACTORS = 8


def term_buckets(data: np.ndarray | None) -> np.ndarray:
    """Distinct buckets of a text's terms."""
    if data is None or not len(data):
        return np.zeros(0, np.int64)
    data = B.LOWER[data]
    starts, ends = B.word_bounds(data, B.SYMBOLS)
    sums = B.prefix_sums(B.BYTE_CODES[data])
    parts = [B.span_hashes(sums, starts, ends)]
    for n in PREFIXES:
        at = starts[ends - starts > n]
        parts.append(B.span_hashes(sums, at, at + n) ^ np.uint64(n))
    return np.unique(np.concatenate(parts) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class FactorizationMachine:
    """Weights and factors of the kept terms; ``slot`` finds a bucket's term or -1."""

    slot: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def terms(self, buckets: np.ndarray) -> np.ndarray:
        found = self.slot[buckets]
        return found[found >= 0]

    def score(self, buckets: np.ndarray) -> float:
        at = self.terms(buckets)
        v = self.factors[at]
        z = self.bias + self.weights[at].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], toxic: np.ndarray, slot: np.ndarray, n_terms: int, epochs: int = 30, rate: float = 0.05, ridge: float = 1e-4, seed: int = 11) -> FactorizationMachine:
    """Adam on the logistic loss, in shuffled batches of 256 rows."""
    rng = np.random.default_rng(seed)
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    p = {"b": np.array([np.log(share / (1 - share))]), "w": np.zeros(n_terms), "v": rng.normal(0, 0.02, (n_terms, FACTORS))}
    if n_terms and 0 < toxic.sum() < len(toxic):
        first = {k: np.zeros_like(x) for k, x in p.items()}
        second = {k: np.zeros_like(x) for k, x in p.items()}
        step = 0
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
                step += 1
                at = np.concatenate([rows[i] for i in batch])
                row = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
                v = p["v"][at]
                sums = np.zeros((len(batch), FACTORS))
                np.add.at(sums, row, v)
                squares = np.bincount(row, (v**2).sum(1), len(batch))
                z = p["b"][0] + np.bincount(row, p["w"][at], len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[batch]) / len(batch)
                grad = {"b": np.array([error.sum()]), "w": np.bincount(at, error[row], n_terms) + ridge * p["w"], "v": np.zeros_like(p["v"])}
                np.add.at(grad["v"], at, error[row, None] * (sums[row] - v))
                grad["v"] += ridge * p["v"]
                for k in p:
                    first[k] = 0.9 * first[k] + 0.1 * grad[k]
                    second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                    p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(slot, float(p["b"][0]), p["w"], p["v"])


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, text and toxic of ``rows`` rows at most, by a hash of the id, one row of each.

    An id labelled both ways counts as toxic.
    """
    picked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rows)
    )
    chosen = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    return one_of_each(chosen, "doc_id")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each bucket, by class, summed within the task."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for data, toxic in zip(B.texts(batch.column("text")), batch.column("toxic").to_pylist()):
            counts[toxic, term_buckets(data)] += 1
    at = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[1, at]), pa.array(counts[0, at])], ["bucket", "toxic", "clean"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, terms: int = TERMS) -> FactorizationMachine:
    """Choose the terms with a first pass over the sample, fit on a second."""
    sample = training_rows(docs, labels, rows)
    n1, n0 = F.col("n1") + 0.5, F.col("n0") + 0.5
    totals = sample.groupBy("toxic").count().collect()
    all1, all0 = (sum(r["count"] for r in totals if r["toxic"] == c) + 1.0 for c in (1, 0))
    # Likelihood-ratio statistic of presence by class.
    gain = F.abs(n1 * F.log(n1 / all1) - n1 * F.log((n1 + n0) / (all1 + all0)) + n0 * F.log(n0 / all0) - n0 * F.log((n1 + n0) / (all1 + all0)))
    kept = (
        sample.select("text", "toxic").mapInArrow(_term_counts, "bucket bigint, toxic bigint, clean bigint")
        .groupBy("bucket").agg(F.sum("toxic").alias("n1"), F.sum("clean").alias("n0"))
        .where(F.col("n1") + F.col("n0") >= 4)
        .orderBy(gain.desc(), "bucket").limit(terms).select("bucket").toPandas()["bucket"].to_numpy(np.int64)
    )
    slot = np.full(BUCKETS, -1, np.int32)
    slot[kept] = np.arange(len(kept))

    def kept_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slot[b][slot[b] >= 0] for b in map(term_buckets, B.texts(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([f.astype(np.int32).tobytes() for f in found], pa.binary())], ["doc_id", "toxic", "terms"])

    found = sample.mapInArrow(kept_terms, "doc_id bigint, toxic int, terms binary").toPandas().sort_values(["doc_id", "terms"])
    return fit([np.frombuffer(t, np.int32) for t in found["terms"]], found["toxic"].to_numpy(float), slot, len(kept))


def score_documents(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([machine.score(term_buckets(data)) for data in B.texts(batch.column("text"))], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    chosen = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return chosen.mapInArrow(scored, "doc_id bigint, held_out boolean, score double, predicted int")
