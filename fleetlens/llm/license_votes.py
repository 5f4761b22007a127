"""License scans by diagonal voting.

Word k-grams of documents are joined to their places in license templates.
Each match votes for the diagonal document place minus template place, so a
passage that follows a template puts its votes on one diagonal, or on
neighbouring ones where words were added or left out.  Neighbouring diagonals
are merged into spans, and a span counts when enough of the template's words
stand in it in order, with the words that set its license apart and none that
name another one.  Of templates that meet in one span the one with the most
words matched counts, then the one with the fewest others.  Fixed phrases (the
base) are found on their own.

Null and empty texts have no words, no labels and score 0.  Repeated rows get
equal rows each.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import textblocks as B
from fleetlens.session import cut

# Base phrases and the labels they stand for.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Opening words of well-known license notices, by SPDX-like label.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
# Phrases that set a license apart, one of which must stand in a span if the template has any of them ...
DEMANDED = {
    "mit": ("mit",),
    "apache-2": ("version 2", "license 2", "v 2", "v2", "apache 2"),
    "gpl-3": ("version 3", "license 3", "v 3", "v3"),
    "lgpl": ("lesser general",),
    "mpl-2": ("v 2", "version 2", "license 2", "v2"),
    "cc-by-nc": ("noncommercial", "non commercial", "by nc"),
    "cc-by-sa": ("sharealike", "share alike", "by sa"),
}
# ... and phrases of other licenses, none of which may.
_SA, _ND = ("sharealike", "share alike", "nc sa", "by sa"), ("noderivatives", "noderivs", "no derivatives", "no derivs", "by nd", "nc nd")
_NC = ("noncommercial", "non commercial", "by nc")
FORBIDDEN = {
    "gpl-3": ("lesser general", "library general", "affero general"),
    "cc-by": (*_NC, *_SA, *_ND), "cc-by-nc": (*_SA, *_ND), "cc-by-sa": (*_NC, *_ND),
}
K = 3  # words of a gram
NEIGHBOURS = 2  # diagonals so far apart still belong together
ENOUGH = 0.8  # share of a template's words that a span must have in order
FILTER_BITS = 20


def codes_of(text: str) -> np.ndarray:
    return B.word_codes(B.LOWER[np.frombuffer(text.encode(), np.uint8)], B.SYMBOLS)[0]


def template_grams(templates=TEMPLATES, k: int = K) -> list[tuple[int, int, int]]:
    """(gram, template, place) of every template; as many rows as the templates have words."""
    return [(int(np.int64(g.view(np.int64))), t, place) for t, (_, text) in enumerate(templates) for place, g in enumerate(B.gram_hashes(codes_of(text), k))]


def common_in_order(template: np.ndarray, span: np.ndarray) -> int:
    """Words of the template that stand in the span in the same order (longest common subsequence)."""
    row = np.zeros(len(span) + 1, np.int64)
    for code in template:
        took = np.where(span == code, row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], took))
    return int(row[-1])


def has_any(words: np.ndarray, phrases: tuple[str, ...]) -> bool:
    """Whether any of some phrases stands in the words."""
    for phrase in phrases:
        codes = codes_of(phrase).view(np.int64)
        at = np.flatnonzero(words[: max(0, len(words) - len(codes) + 1)] == codes[0])
        if any(np.array_equal(words[i : i + len(codes)], codes) for i in at.tolist()):
            return True
    return False


def own_license(label: str, template: np.ndarray, span: np.ndarray) -> bool:
    """Whether the span has what sets the template's license apart, and nothing of others."""
    demanded = DEMANDED.get(label, ())
    return (not has_any(template, demanded) or has_any(span, demanded)) and not has_any(span, FORBIDDEN.get(label, ()))


def strongest(found: list[dict]) -> list[int]:
    """Templates left when spans that overlap compete: most words matched, then fewest others."""
    kept, lows, highs = set(), [], []  # spans that were kept do not overlap
    for s in sorted(found, key=lambda s: (-s["matched"], s["others"], s["template"], s["low"])):
        i = bisect_left(lows, s["low"])
        if (i == len(lows) or s["high"] <= lows[i]) and (i == 0 or highs[i - 1] <= s["low"]):
            lows.insert(i, s["low"])
            highs.insert(i, s["high"])
            kept.add(s["template"])
    return sorted(kept)


def _scanner(templates, phrases, k: int):
    """Per document: words, base places and labels, gram matches that may be in a template, and the words around them."""
    grams = np.array([g for g, _, _ in template_grams(templates, k)], np.int64).view(np.uint64)
    may = np.zeros(1 << FILTER_BITS, bool)
    may[grams >> np.uint64(64 - FILTER_BITS)] = True
    reach = max((len(codes_of(text)) for _, text in templates), default=0) + NEIGHBOURS
    base = [(label, codes_of(text)) for text, label in phrases]
    base = [(label, codes, B.gram_hashes(codes, len(codes))[0]) for label, codes in base if len(codes)]

    def row(data: np.ndarray | None) -> tuple:
        codes = codes_of_bytes(data)
        places, labels = [], set()
        for label, phrase, whole in base:
            if len(codes) >= len(phrase):
                at = np.flatnonzero(codes[: len(codes) - len(phrase) + 1] == phrase[0])
                for i in at.tolist():
                    if np.array_equal(codes[i : i + len(phrase)], phrase):
                        places.append(i)
                        labels.add(label)
        found = B.gram_hashes(codes, k)
        at = np.flatnonzero(may[found >> np.uint64(64 - FILTER_BITS)])
        regions, matches = [], []
        if len(at):
            # One region for matches that may belong to one template, with the words around it.
            part = np.flatnonzero(np.diff(at, prepend=at[0] - reach - 1) > reach)
            for r, (low, high) in enumerate(zip(part, np.append(part[1:], len(at)))):
                low_word, high_word = max(0, at[low] - NEIGHBOURS), min(len(codes), at[high - 1] + k + NEIGHBOURS)
                regions.append({"region": r, "first": int(low_word), "codes": codes[low_word:high_word].view(np.int64).tolist()})
                matches += [{"region": r, "place": int(p), "gram": int(g)} for p, g in zip(at[low:high], found[at[low:high]].view(np.int64))]
        return len(codes), len(places), min(places, default=None), max(places, default=None), sorted(labels), matches, regions

    return row


def codes_of_bytes(data: np.ndarray | None) -> np.ndarray:
    if data is None or not len(data):
        return np.zeros(0, np.uint64)
    return B.word_codes(B.LOWER[data], B.SYMBOLS)[0]


_SCANNED = (
    "doc_id bigint, version bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, "
    "matches array<struct<region: int, place: bigint, gram: bigint>>, regions array<struct<region: int, first: bigint, codes: array<bigint>>>"
)
_TYPES = [
    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()),
    pa.list_(pa.struct([("region", pa.int32()), ("place", pa.int64()), ("gram", pa.int64())])),
    pa.list_(pa.struct([("region", pa.int32()), ("first", pa.int64()), ("codes", pa.list_(pa.int64()))])),
]
_NAMES = ["doc_id", "version", "n_words", "n_base", "first_word", "last_word", "base", "matches", "regions"]


def scan(docs: DataFrame, templates=TEMPLATES, phrases=BASE_PHRASES, k: int = K) -> DataFrame:
    """One row per document, see ``_scanner``; only documents with matches carry words."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = _scanner(templates, phrases, k)
        keys = ((d, v, data) for b in batches for d, v, data in zip(b.column("doc_id").to_pylist(), b.column("version").to_pylist(), B.texts(b.column("text"))))
        return B.rows_in_batches(((d, v, *row(data)) for d, v, data in keys), _NAMES, _TYPES)

    chosen = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).alias("version"), F.col("text").cast("string"))
    return chosen.mapInArrow(scanned, _SCANNED)


def diagonals(scanned: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """Votes by document, region, template and diagonal, from the join of grams to template places."""
    spark = scanned.sparkSession
    places = spark.createDataFrame(template_grams(templates, k), "gram bigint, template int, template_place bigint")
    matches = scanned.select("doc_id", "version", F.explode("matches").alias("m")).select("doc_id", "version", "m.region", "m.place", "m.gram").distinct()
    # The templates are a parameter of the operator, not data: a few hundred rows.
    return (
        matches.join(F.broadcast(places), "gram")
        .groupBy("doc_id", "version", "region", "template", (F.col("place") - F.col("template_place")).alias("diagonal"))
        .agg(F.count("*").alias("votes"), F.min("place").alias("low"), (F.max("place") + k).alias("high"))
    )


def spans(votes: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Diagonals that lie close together, as one span each."""
    same = Window.partitionBy("doc_id", "version", "region", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(same) > neighbours).cast("int"), F.lit(1))
    grouped = votes.withColumn("new", new).withColumn("band", F.sum("new").over(same))
    return grouped.groupBy("doc_id", "version", "region", "template", "band").agg(
        F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def verified(found: DataFrame, scanned: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Spans with the words of their template that stand in them in order, their share, and whether they have what sets its license apart."""
    words = [codes_of(text).view(np.int64) for _, text in templates]
    names = ["doc_id", "version", "template", "low", "high"]

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, bytes], tuple[int, bool]] = {}  # a notice that is repeated is compared once
        for batch in batches:
            low, high, codes = batch.column("low").to_pylist(), batch.column("high").to_pylist(), batch.column("codes")
            bounds, values = codes.offsets.to_numpy(), codes.values.to_numpy()
            matched, others, share, own = [], [], [], []
            for i, (t, a, b) in enumerate(zip(batch.column("template").to_pylist(), low, high)):
                span = values[bounds[i] : bounds[i + 1]]
                key = t, span.tobytes()
                if key not in known:
                    if len(known) >= 4096:
                        known.clear()
                    known[key] = common_in_order(words[t], span), own_license(templates[t][0], words[t], span)
                common, mine = known[key]
                matched.append(common)
                others.append(len(words[t]) - common + max(0, b - a - common))
                share.append(common / len(words[t]))
                own.append(mine)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(matched, pa.int64()), pa.array(others, pa.int64()), pa.array(share, pa.float64()), pa.array(own, pa.bool_())],
                [*names, "matched", "others", "share", "own"],
            )

    regions = scanned.select(F.col("doc_id").alias("r_id"), F.col("version").alias("r_version"), F.explode("regions").alias("r")).distinct()
    same = found["doc_id"].eqNullSafe(regions["r_id"]) & (found["version"] == regions["r_version"]) & (found["region"] == F.col("r.region"))
    # Only the span's own words go on, however long the region around it is.
    start = F.greatest(F.col("low") - NEIGHBOURS, F.col("r.first")) - F.col("r.first")
    words_of_span = F.slice(F.col("r.codes"), (start + 1).cast("int"), (F.col("high") + NEIGHBOURS - F.col("r.first") - start).cast("int"))
    both = found.join(regions, same).select("doc_id", "version", "template", "low", "high", words_of_span.alias("codes"))
    return both.mapInArrow(shares, "doc_id bigint, version bigint, template int, low bigint, high bigint, matched bigint, others bigint, share double, own boolean")


def license_labels(docs: DataFrame, templates=TEMPLATES, phrases=BASE_PHRASES, k: int = K, enough: float = ENOUGH) -> DataFrame:
    """n_words, base places and labels, all labels and the best score of every document.

    Base labels have score 1; a document without label has the share of its
    best span, or 0.
    """
    scanned = cut(scan(docs, templates, phrases, k))
    checked = verified(spans(diagonals(scanned, templates, k)), scanned, templates)
    passing = F.when((F.col("share") >= enough) & F.col("own"), F.struct("template", "low", "high", "matched", "others"))
    # The spans of one document: no more than its text has matches.
    spanned = checked.groupBy(F.col("doc_id").alias("v_id"), F.col("version").alias("v_version")).agg(
        F.collect_list(passing).alias("passing"), F.max("share").alias("share")
    )

    def elected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            voted = [sorted({templates[t][0] for t in strongest(found)}) for found in batch.column("passing").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("v_id"), batch.column("v_version"), pa.array(voted, pa.list_(pa.string())), batch.column("share")], ["v_id", "v_version", "voted", "share"]
            )

    voted = spanned.mapInArrow(elected, "v_id bigint, v_version bigint, voted array<string>, share double")
    same = scanned["doc_id"].eqNullSafe(voted["v_id"]) & (scanned["version"] == voted["v_version"])
    joined = scanned.drop("matches", "regions").join(voted, same, "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("voted", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
