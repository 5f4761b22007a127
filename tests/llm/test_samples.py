"""Samples that models learn from are bounded by rows, whatever shares an id."""

import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F

from fleetlens.llm import language_codes, quality_forest, samples, toxicity_fm

ROWS = 30_000


@pytest.fixture(scope="module")
def crowded(spark):
    """Very many rows under one id, some ids of their own, and one row without an id."""
    many = spark.range(ROWS).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"))
    own = spark.range(2, 60).select(F.col("id").alias("doc_id"), F.concat(F.lit("other words "), F.col("id").cast("string")).alias("text"))
    odd = frame(spark, [(None, "no id", "en"), (60, None, "en")]).select("doc_id", "text")
    return many.unionByName(own).unionByName(odd).withColumn("lang", F.lit("en"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.range(61).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"), (F.col("id") % 2).cast("int").alias("quality"))


def test_one_row_of_each_id(crowded):
    found = samples.one_of_each(crowded.where("doc_id IS NOT NULL"), "doc_id").collect()
    assert sorted(r["doc_id"] for r in found) == list(range(1, 61))
    first = min((r for r in crowded.where("doc_id = 1").withColumn("h", F.xxhash64("text")).collect()), key=lambda r: r["h"])
    assert next(r["text"] for r in found if r["doc_id"] == 1) == first["text"]


def test_toxicity_sample(crowded, labels):
    assert toxicity_fm.training_rows(crowded, labels, 40).count() <= 40
    kept = toxicity_fm.training_rows(crowded, labels, 1000).select("doc_id").collect()
    assert len(kept) == len(set(kept)) and (1,) in kept


def test_quality_and_language_samples(crowded, labels, monkeypatch):
    held = {}

    def quality(n, x, good, keep_good):
        held["quality"] = len(n), len(x), len(good)

    def language(profiles, langs):
        held["language"] = len(profiles), len(langs)

    monkeypatch.setattr(quality_forest, "fit", quality)
    monkeypatch.setattr(language_codes, "fit", language)
    quality_forest.train(crowded, labels, rows=50)
    language_codes.train(crowded, 20)
    assert max(held["quality"]) <= 50 and max(held["language"]) <= 20


def test_quality_learns_from_all_labelled_rows(spark):
    """More rows than any sample had: middle, limits and threshold are those of all of them."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), 12 + F.col("id") % 17), lambda i: F.repeat(F.lit("a"), (1 + F.xxhash64("id", i) % 7 + 7).cast("int"))), " ")
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 == 0, F.concat(words, F.lit(" ### $$$"))).otherwise(words).alias("text"))
    labels = spark.range(24_000).select(F.col("id").alias("doc_id"), (F.col("id") % 9 != 0).cast("int").alias("quality"))
    model = quality_forest.train(docs, labels)
    found = quality_forest.rule_statistics(docs).join(labels, "doc_id").toPandas()
    found = found[~quality_forest.base_failed(found["n_words"], found["n_repeat_words"])]
    x, n, good = found[list(quality_forest.FEATURES)].to_numpy(), found["n_words"].to_numpy(), found["quality"].to_numpy() == 1
    assert np.allclose(model.middle, np.median(x[good], 0), rtol=1e-12, atol=0)
    shrunk = (x * n[:, None] + 20 * model.middle) / (n[:, None] + 20)
    reached = np.quantile(shrunk[good], 0.998, axis=0)
    assert np.allclose(model.high, model.middle + 1.5 * (reached - model.middle), rtol=1e-9, atol=1e-12)
    score = model.score(n, x)
    assert (score[good] < model.threshold).mean() >= 0.998 > 0.5 > (score[~good] < model.threshold).mean()
