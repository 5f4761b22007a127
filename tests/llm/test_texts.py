"""Scans, scores and tokens against brute force, the public library, and held-out rows."""

import random
import time
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from checks.compare import compare, open_tables
from conftest import frame
from tokenizers import Tokenizer

import corpus_pipeline
from fleetlens.llm import bpe, decontaminate, language_codes, license_votes, quality_forest, queries, toxicity_fm

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
pairs = lambda rows: [(d, t) for d, t, _ in rows]


def collected(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "Short item, here"), (3, "rareword"),
    (4, None), (5, "..."), (None, "short item here"), (2, "short other"), (10, "SHORT ITEM here"), (6, "é漢字 é漢字"),
]


@pytest.fixture(scope="module")
def items(spark, data_dir):
    held = [tuple(r) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").select("item_id", "text").collect()] + ITEMS
    return held, spark.createDataFrame([(i, t, "x", "y") for i, t in held], "item_id bigint, text string, words string, n string")


PLANTED = [
    (9101, "a one two three four five six seven eight nine ten eleven twelve thirteen fourteen b", "en"),
    (9102, "zero one TWO three four five six seven eight nine ten eleven twelve thirteen short ITEM-here rareword", "en"),
    (9103, "rareword", "en"), (9104, " ".join(["w"] * 400) + " short item here", "en"), (9105, "One two three four", "en"), (9106, "É漢字 é漢字", "fr"),
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_contamination(spark, rows, items, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rows = rows + PLANTED
    got = collected(decontaminate.contamination(frame(spark, rows), items[1]), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == Counter(brute.contamination(pairs(rows), items[0]))


def test_contamination_runs_no_python(spark, rows, items):
    plan = decontaminate.contamination(frame(spark, rows[:20]), items[1])._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_clean_documents_stay(spark, rows, items):
    rows = rows + PLANTED
    kept = decontaminate.clean_documents(frame(spark, rows), items[1])
    bad = Counter((d, t) for (d, t), r in zip(pairs(rows), brute.contamination(pairs(rows), items[0])) if r[-1])
    assert collected(kept, "doc_id", "text") == Counter(pairs(rows)) - bad


def test_contamination_matches_its_sql(spark, data_dir):
    frame_ = queries.QUERIES["op4_decontaminate"](spark, data_dir)
    assert compare(frame_, open_tables(data_dir), queries.ORACLES["op4_decontaminate"]) is None


def test_license_base(docs, rows):
    got = collected(license_votes.license_labels(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == Counter(brute.license_base(pairs(rows)))


def test_license_votes(spark):
    notice = "This work is licensed under the GNU General Public License, version 3."
    texts = [notice, "a b c " * 50 + notice + " d", notice.replace("General ", "General and "), "general public", "licensed under the apache license version 2 0", "x" * 5]
    found = {r["doc_id"]: r for r in license_votes.license_labels(frame(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert [found[i]["labels"] for i in range(6)] == ["gpl-3", "gpl-3", "gpl-3", "", "apache-2", ""]
    assert found[0]["score"] == 1.0 and 0 < found[2]["score"] <= 1 and found[4]["base_labels"] == "apache-2" and found[5]["score"] == 0


def test_quality_base(spark, docs, rows, data_dir):
    model = quality_forest.train(docs, spark.read.parquet(f"{data_dir}/labels.parquet"))
    got = quality_forest.score_documents(docs, model)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collected(got, *columns) == Counter(brute.quality_base(pairs(rows)))
    assert got.where("base_failed AND kept").count() == 0
    kept = quality_forest.keep_good_documents(docs, model)
    assert kept.columns == docs.columns
    assert collected(kept, "doc_id") == collected(got.where("kept"), "doc_id")


def test_quality_on_rows_not_learned_from(spark):
    where = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_forest.train(documents, labels.where("doc_id % 2 = 0"))
    seen = quality_forest.score_documents(documents, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").toPandas()
    assert seen[seen.quality == 1].kept.mean() > 0.95
    assert seen[seen.quality == 0].kept.mean() < 0.3


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    score = quality_forest.IsolationForest().fit(x).score(x)
    assert score[-1] == score.max() and 0 < score.min()


@pytest.mark.parametrize("labels", [[], [(0, 1, 0)], [(None, 1, 1), (1, None, None)]])
def test_models_without_usable_labels(spark, labels):
    documents = frame(spark, [(i, f"word number {i} of this short text that has ten words", "en") for i in range(4)] + [(None, None, None)])
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert quality_forest.score_documents(documents, quality_forest.train(documents, table)).where("kept").count() == 4
    scores = toxicity_fm.score_documents(documents, toxicity_fm.train(documents, table)).toPandas()
    assert len(scores) == 5 and scores.score.between(0, 1).all()


def test_toxicity_on_rows_not_learned_from(spark):
    where = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    scores = toxicity_fm.score_documents(documents, toxicity_fm.train(documents, labels)).toPandas()
    assert (scores.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in scores.doc_id]).all()
    unseen = scores[scores.held_out].merge(labels.toPandas(), on="doc_id")
    assert unseen[unseen.toxic == 0].predicted.mean() < 0.03
    assert (scores.predicted == (scores.score >= 0.5)).all()


def test_pairs_of_terms_can_outweigh_their_sum():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(bits) for bits in rng.integers(0, 2, (1500, 6))]
    toxic = np.array([float({0, 1} <= set(r)) for r in rows])
    machine = toxicity_fm.fit(rows, toxic, np.arange(6), 6, epochs=60)
    assert machine.score(np.array([0, 1])) > 0.9 > 0.1 > max(machine.score(np.array([0])), machine.score(np.array([1])))


def test_languages_on_rows_not_learned_from(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_codes.predict(documents, language_codes.train(documents)).toPandas().merge(documents.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (found.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in found.doc_id]).all()
    unseen = found[found.held_out]
    assert (unseen.lang_pred == unseen.lang).mean() > 0.97


def test_languages_of_edge_cases(docs, rows, empty):
    model = language_codes.train(docs)
    found = language_codes.predict(docs, model).toPandas()
    letterless = [d for d, t in pairs(rows) if not any(c.isalpha() for c in t or "")]
    assert sorted(found[found.lang_pred == "und"].doc_id.dropna()) == sorted(d for d in letterless if d is not None)
    nothing = language_codes.train(empty)
    assert set(language_codes.predict(docs, nothing).toPandas().lang_pred) == {"und"}


def test_codewords_differ_in_many_bits():
    for n in (2, 3, 4, 5, 12):
        code = language_codes.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= max(1, code.shape[1] // 4)


def test_bpe_round_trip(docs, rows):
    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for doc_id, text in pairs(rows):
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(library.decode(ids, skip_special_tokens=False))))
    got = collected(bpe.encode(docs, VOCABULARY, digest=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == Counter(want)


def test_bpe_decodes_its_ids(docs, rows):
    back = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    assert collected(back, "doc_id", "text") == Counter((d, t or "") for d, t in pairs(rows))


def test_bpe_joins_are_exact(monkeypatch):
    library = Tokenizer.from_file(VOCABULARY)
    with open(VOCABULARY, encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    monkeypatch.setattr(bpe, "SHORT", 8)
    monkeypatch.setattr(bpe, "CHUNK", 50)
    rng = random.Random(1)
    for n in (0, 1, 7, 8, 9, 60, 200, 1000):
        for letters in ("ab", "aaaab", "abcdefghijklmnopqrstuvwxyz", "the in on ", "é漢a", " ", "\n ", "-=", "012", "'s t"):
            text = "".join(rng.choice(letters) for _ in range(n))
            want = library.encode(text, add_special_tokens=False).ids
            assert list(bpe.unpack(vocabulary.encode(text))) == want
            pieces = [(kind, number, vocabulary.encode_piece(kind, data)) for kind, number, data in vocabulary.pieces(text)]
            assert list(bpe.unpack(vocabulary.join_pieces(pieces))) == want


@pytest.mark.parametrize("operator", [
    lambda e, s: decontaminate.contamination(e, s.createDataFrame(ITEMS, "item_id bigint, text string")),
    lambda e, s: decontaminate.clean_documents(e, s.createDataFrame([], "item_id bigint, text string")),
    lambda e, s: license_votes.license_labels(e), lambda e, s: bpe.encode(e, VOCABULARY, digest=True),
    lambda e, s: quality_forest.score_documents(e, quality_forest.train(e, s.createDataFrame([], "doc_id bigint, quality int"))),
    lambda e, s: toxicity_fm.score_documents(e, toxicity_fm.train(e, s.createDataFrame([], "doc_id bigint, toxic int"))),
    lambda e, s: language_codes.predict(e, language_codes.train(e)),
])
def test_empty_table(spark, empty, operator):
    assert operator(empty, spark).count() == 0


def test_pipeline_against_brute_force(spark, data_dir):
    """Each stage's rows from the rows of the stage before."""
    documents = spark.read.parquet(f"{data_dir}/documents.parquet")
    now = documents
    library = Tokenizer.from_file(VOCABULARY)
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in now.select("doc_id", "text").collect()]
        out = stage(spark, now, data_dir).cache()
        if name != "BPE encoding and decoding":
            assert out.columns == documents.columns
            after = Counter((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect())
        if name == "quality rules":
            failed = {r[0] for r in brute.quality_base(before) if r[-1]}
            assert not failed & {d for d, _ in after} and not after - Counter(before)
        elif name == "n-gram Jaccard join":
            leads = {d for d, n, c in brute.jaccard(before) if d == c or n == 0}
            assert after == Counter((d, t) for d, t in before if d in leads)
        elif name == "suffix-array dedup":
            want = {d: n - gone for d, n, gone, _, _ in brute.suffix_dedup(before)}
            assert all(len(t.encode()) <= want[d] for d, t in after)
            assert {d for d, _ in after} >= {d for d, n in want.items() if n > 8}
        elif name == "benchmark decontamination":
            bench = [tuple(r) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").select("item_id", "text").collect()]
            bad = {r[0] for r in brute.contamination(before, bench) if r[-1]}
            assert after == Counter((d, t) for d, t in before if d not in bad)
        else:
            assert {(r["doc_id"], r["n_tokens"]) for r in out.collect()} == {(d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in before}
        now = out


def test_duckdb_reads_the_oracle(data_dir):
    assert duckdb.sql("SELECT 1").fetchall() and set(queries.ORACLES) <= set(queries.QUERIES)


def test_licenses_are_told_apart(spark):
    notices = [(text, label) for label, text in license_votes.TEMPLATES]
    gnu = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License"
    creative = "This work is licensed under a Creative Commons Attribution{} International License."
    notices += [
        ("Licensed under CC BY 4.0", ""), ("Released under the Apache License", ""), ("released under the same license", ""),
        (gnu.format("program", "General", 2), ""), (gnu.format("program", "General", 3), "gpl-3"), (gnu.format("program", "Affero General", 3), ""),
        (gnu.format("library", "Lesser General", 3), "lgpl"), ("Licensed under the Apache License, Version 1.1.", ""), ("Licensed under the Apache License 2.0.", "apache-2"),
        (creative.format("-NonCommercial-ShareAlike 4.0"), ""), (creative.format("-NoDerivatives 4.0"), ""), (creative.format(" 3.0"), "cc-by"),
        ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", "apache-2,mit"),
        (creative.format(" 4.0") + " " + creative.format("-NonCommercial 4.0"), "cc-by,cc-by-nc"),
    ]
    rows = [(i, text, "en") for i, (text, _) in enumerate(notices)]
    found = {r["doc_id"]: r["labels"] for r in license_votes.license_labels(frame(spark, rows)).collect()}
    assert [(text, found[i]) for i, (text, _) in enumerate(notices)] == notices


def test_a_very_long_text_of_one_notice(spark):
    """Time grows with the text, not with its square."""
    notice = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    rows = [(1, notice * 8000, "en"), (2, notice, "en"), (3, notice * 2 + "and other words " * 60 + notice, "en")]
    started = time.monotonic()
    found = {r["doc_id"]: r for r in license_votes.license_labels(frame(spark, rows)).collect()}
    assert found[1]["labels"] == found[2]["labels"] == found[3]["labels"] == "apache-2"
    assert found[1]["n_words"] == 8000 * found[2]["n_words"]
    assert time.monotonic() - started < 120


def test_decontamination_of_a_very_long_text(spark):
    """Passages are found wherever they stand, in time that grows with the text and not its square."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    item, short = [rng.choice(words) for _ in range(40)], ["Only", "twó"]
    text = [rng.choice(words) for _ in range(300_000)]
    spots = sorted({0, 127 - 12, 128, 128 * 50 - 20, 299_960, *(rng.randrange(0, 299_900) for _ in range(40))})
    for at in spots:
        text[at : at + 40] = item
    text[150_000:150_002] = short
    rows = [(1, " ".join(text), "en"), (2, " ".join(text[:129] + item[:13]), "en"), (3, " ".join(item[1:13]), "en")]
    items = [("long", " ".join(item)), ("short", " ".join(short).upper())]
    started = time.monotonic()
    found = decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id string, text string"))
    assert Counter(tuple(r) for r in found.collect()) == Counter(brute.contamination([(d, t) for d, t, _ in rows], items))
    assert time.monotonic() - started < 120


def test_repeated_long_texts_are_encoded_once(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh  ") for _ in range(bpe.CHUNK * 2 + i)) for i in range(3)]
    rows = [(None, texts[i % 3], "en") for i in range(60)] + [(7, texts[0], "en"), (7, texts[1], "en"), (7, texts[1], "en"), (8, texts[2], "en")]
    found = bpe.encode(frame(spark, rows), VOCABULARY)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids = {t: bpe.pack(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts}
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in found.collect()) == Counter((d, ids[t]) for d, t, _ in rows)


def test_frequent_parts_outlive_a_full_cache(monkeypatch):
    """A word that keeps coming is encoded once, however many others come in between."""
    monkeypatch.setattr(bpe, "CACHED", 50)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    seen, encode_part = [], vocabulary.encode_part
    monkeypatch.setattr(vocabulary, "encode_part", lambda data: seen.append(data) or encode_part(data))
    found = {vocabulary.encode(f"frequent word{'abcdefghij'[i % 10]}{'x' * (i // 10 + 1)}") for i in range(200)}
    assert seen.count(b"frequent") == 1 and len(found) == 200
    assert len(vocabulary.cache) <= 50 and len(vocabulary.older) <= 50
