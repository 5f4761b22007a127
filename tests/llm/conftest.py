import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

# Names that operators use inside; as columns of the input they must not matter.
CLASHING = ("n", "version", "words", "window", "start", "set", "anchor", "first", "spans", "n_words", "score", "at", "shingle", "kept")


def frame(spark, rows):
    """documents with further columns of clashing names."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(d, t, lang, "s", len(t or ""), *["x"] * len(CLASHING)) for d, t, lang in rows], schema)


def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows and rows that share a doc_id."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8)))
    prose = [word() for _ in range(400)]
    passage = " ".join(prose[:80])
    long_text = " ".join(word() for _ in range(30_000)) + " " + passage
    near = prose[:]
    near[200] = "changed"
    rows = [
        (9001, None, "en"), (9002, "", "en"), (9003, " \n\t ", None), (None, passage, "en"), (None, None, None),
        (9004, " ".join(prose), "en"), (9005, " ".join(near), "en"), (9006, " ".join(near), "en"),
        (9007, "repeated row " + passage, "en"), (9007, "repeated row " + passage, "en"), (9007, "one id, other text " + passage.upper(), "en"),
        (9008, long_text, "en"), (9009, "x" * 70_000 + " " + "ab" * 500, "en"), (9010, "é漢字 " * 60 + passage, "fr"),
        (9011, "one", "de"), (9012, "one", "de"), (9013, "A b c  " * 40, "es"), (9014, "12 34 - !", "es"),
        (9015, "Released  under the\nMIT License. cc by-nc cc by nc", "en"), (9016, "licensed under the Apache License, version 2.0", "en"),
        (9017, "<|endoftext|> a <|endoftext|>", "en"), (9018, "same line\nsame line\n\nsame line", "en"),
    ]
    return rows


@pytest.fixture(scope="session")
def rows(spark, data_dir):
    table = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    return [tuple(r) for r in table] + edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
