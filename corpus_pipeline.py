"""From raw documents to tokens: quality, near duplicates, repeated passages, benchmark passages, BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept; ``run`` writes each stage's rows as Parquet to the shared folder
and hands them, read again, to the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, bwt_dedup, decontaminate, jaccard_rtree, quality_forest
from fleetlens.llm.anchors import stored
from fleetlens.llm.queries import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their forest keep."""
    return quality_forest.keep_good_documents(docs, quality_forest.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates."""
    return jaccard_rtree.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start earlier in the corpus."""
    cut = bwt_dedup.cut_documents(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark items."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Count and digest of each document's tokens, and the digest of what they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), digest=True)


STAGES = [
    ("quality rules", good_quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", no_benchmarks),
    ("BPE encoding and decoding", tokens),
]

# A forest, components and BPE are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
