"""Language identification with error-correcting output codes.

Every language gets a codeword of bits.  For each bit a logistic classifier
over byte n-gram frequencies separates the languages with a 1 from those with
a 0.  A text gets the language whose codeword has the smallest sum of losses,
each bit weighed by how well it fits that language in training.  When the
runner-up is close, the text is flagged as ambiguous.

Null texts and texts without a letter are ``und`` with score 0, also if no
language was learned.  One learned language is the answer for all texts.
Repeated rows get equal answers; other columns than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import textblocks as B
from fleetlens.llm.samples import one_of_each

GRAM_BUCKETS = 4096
ROWS_PER_LANGUAGE = 1000  # labelled rows that the classifiers are fitted on
AMBIGUOUS = 0.8  # flagged if the winner's share is below this
UNKNOWN = "und"
HASH_RANGE = 1 << 30


def gram_profile(data: np.ndarray) -> np.ndarray:
    """Square roots of the shares of a text's byte 1-, 2- and 3-grams, by bucket; unit length."""
    counts = np.zeros(GRAM_BUCKETS)
    for at in range(0, len(data), B.BLOCK):
        x = B.LOWER[data[at : at + B.BLOCK + 2]].astype(np.uint32)
        last = at + B.BLOCK >= len(data)
        for n in (1, 2, 3):
            m = min(len(x) - n + 1, len(x) if last else B.BLOCK)
            if m > 0:
                key = np.full(m, n, np.uint32)
                for j in range(n):
                    key = key * np.uint32(257) + x[j : j + m]
                key = (key * np.uint32(2654435769)) >> np.uint32(20)
                counts += np.bincount(key, minlength=GRAM_BUCKETS)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """A row of -1 and 1 per language: every split for few, the best of random codes for many."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 5:
        return np.array([(1, *bits) for bits in product((1, -1), repeat=n - 1)][1:], float).T
    rng = np.random.default_rng(seed)
    length = int(np.ceil(10 * np.log2(n)))
    best, distance = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, length))
        code = code[:, np.abs(code.sum(0)) < n]
        between = (code.shape[1] - code @ code.T) / 2 + 1e9 * np.eye(n)
        if between.min() > distance:
            best, distance = code, between.min()
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages by bits
    trust: np.ndarray  # languages by bits, rows sum to 1
    weights: np.ndarray  # buckets by bits
    bias: np.ndarray

    def decode(self, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language by number and its share of the evidence."""
        if len(self.languages) < 2:
            return np.zeros(len(profiles), np.int64), np.ones(len(profiles))
        margins = profiles @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust[None]
        evidence = -self.code.shape[1] * loss.sum(2)
        share = np.exp(evidence - evidence.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        return best, share[np.arange(len(best)), best]


def fit(profiles: np.ndarray, langs: np.ndarray, steps: int = 150, rate: float = 0.5, ridge: float = 1e-6) -> LanguageModel:
    """One logistic classifier per bit, rows weighed so that languages count alike."""
    languages = sorted(set(langs))
    code = codewords(len(languages))
    bits = code.shape[1]
    w, b = np.zeros((GRAM_BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    trust = np.full(code.shape, 1 / max(bits, 1))
    if bits:
        y = np.searchsorted(np.array(languages), langs)
        target = code[y]
        target, weight = target.astype(np.float32), ((1 / np.bincount(y))[y][:, None] / len(languages)).astype(np.float32)
        first, second = np.zeros((GRAM_BUCKETS + 1, bits), np.float32), np.zeros((GRAM_BUCKETS + 1, bits), np.float32)
        for step in range(1, steps + 1):
            error = -target * weight / (1 + np.exp(np.clip(target * (profiles @ w + b), -30, 30)))
            grad = np.vstack([profiles.T @ error + ridge * w, error.sum(0)])
            first = 0.9 * first + 0.1 * grad
            second = 0.99 * second + 0.01 * grad**2
            move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + np.float32(1e-8))
            w, b = w - move[:-1], b - move[-1]
        right = (target * (profiles @ w + b) > 0).astype(float)
        trust = np.array([right[y == i].mean(0) for i in range(len(languages))]) + 1e-3
        trust /= trust.sum(1, keepdims=True)
    return LanguageModel(languages, code, trust, w, b)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [gram_profile(data).astype(np.float16).tobytes() for data in B.texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(found, pa.binary())], ["doc_id", "lang", "profile"])


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Fit on a bounded number of labelled documents of every language, picked by a hash of their id, one row of each."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # The model holds a codeword for each language, so their counts are small.
    sizes = usable.groupBy(F.col("lang").cast("string").alias("lang")).count().collect()
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint"), F.lit(7)), F.lit(HASH_RANGE))
    # Places below a language's bound hold about four times the rows that are wanted, however many it has.
    bounds = {r["lang"]: min(HASH_RANGE, 4 * rows_per_language * HASH_RANGE // r["count"]) for r in sizes}
    bound = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]) if bounds else F.lit(None).cast("map<string,bigint>")
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    picked = (
        usable.where(place < F.try_element_at(bound, F.col("lang").cast("string"))).where(F.col("text").rlike(r"\p{L}"))
        .select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), place.alias("place")).distinct()
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows_per_language).select("doc_id", "lang")
    )
    chosen = docs.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("text").cast("string")).join(
        F.broadcast(picked), ["doc_id", "lang"]
    )
    found = one_of_each(chosen.where(F.col("text").rlike(r"\p{L}")), "doc_id", "lang").mapInArrow(_profiles, "doc_id bigint, lang string, profile binary").toPandas().sort_values(["doc_id", "lang", "profile"])
    profiles = np.frombuffer(b"".join(found["profile"]), np.float16).reshape(-1, GRAM_BUCKETS).astype(np.float32)
    return fit(profiles, found["lang"].to_numpy(str) if len(found) else np.zeros(0, str))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every document."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
            lang, score = [UNKNOWN] * len(letters), np.zeros(len(letters))
            at = np.flatnonzero(letters)
            for part in np.array_split(at, max(1, -(-len(at) // 512))):
                wanted = set(part.tolist())
                if wanted:
                    column = batch.column("text").slice(part[0], part[-1] - part[0] + 1)
                    profiles = np.array([gram_profile(d) for i, d in enumerate(B.texts(column), part[0]) if i in wanted])
                    best, share = model.decode(profiles)
                    score[part] = share
                    for i, n in zip(part, best):
                        lang[i] = model.languages[n]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(letters & (score < AMBIGUOUS))],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    chosen = docs.select(
        F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    return chosen.mapInArrow(predicted, "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")
