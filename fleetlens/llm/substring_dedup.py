"""Substring dedup: windows of words around equal seeds.

Seeds are winnowed anchors: of the k-word runs in each window of 35 words the
one with the smallest hash.  Documents meet on equal anchors.  Each window
around an anchor is its words to the left and to the right, compared by their
hashes; places that agree on both sides hold a repeat.  All words of windows
whose words also start elsewhere, in any document, are removed.

Null and empty texts have no words.  Repeated rows (equal doc_id and text) are
one document; rows that share only the doc_id are different documents.  Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlens.llm import anchors as A
from fleetlens.llm import textblocks as B

WORDS = 35  # words of a window
SEED = 16  # words of an anchor
TARGET = 1 << 20  # bytes of text that are compared at once


def word_units(data: np.ndarray) -> np.ndarray:
    return B.word_codes(data, B.SPACES)[0]


def _piece(data: np.ndarray):
    starts, ends = B.word_bounds(data, B.SPACES)
    return lambda low, high: data[starts[low] : ends[high - 1]].tobytes()


def extended(columns: dict, length: int = WORDS, k: int = SEED) -> list[np.ndarray]:
    """For every segment, which of its windows stand in another segment too.

    A window is its anchor with so many words to the left and the rest of its
    words to the right; two places match when both extensions agree.
    """
    keys, counts = [], []
    for anchor, windows, data in zip(columns["anchor"], columns["windows"], columns["content"]):
        codes = word_units(data)
        sums = B.prefix_sums(codes)
        at = A.anchor_place(codes, length, k)
        start = np.arange(windows)
        left = B.span_hashes(sums, start, np.full(windows, at))
        right = B.span_hashes(sums, np.full(windows, at), start + length)
        both = B.mix(left ^ anchor.view(np.uint64)) + B.mix(right ^ (at - start).astype(np.uint64))
        keys.append(both)
        counts.append(windows)
    if not keys:
        return []
    _, back, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    return np.split(times[back] > 1, np.cumsum(counts)[:-1])


def mark_repeats(docs: DataFrame, length: int = WORDS, k: int = SEED) -> DataFrame:
    """doc_id, version, text and the repeated spans (first window, windows) of every document."""
    return A.repeated(A.versioned(docs), word_units, length, k, False, _piece, lambda c: extended(c, length, k), TARGET)


def deduplicated(docs: DataFrame, length: int = WORDS, k: int = SEED, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by blanks (or their digest)."""
    name = "kept_sha256" if digest else "kept"

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            for data, (first, windows) in zip(B.texts(batch.column("text")), A.spans_of(batch.column("spans"))):
                data = np.zeros(0, np.uint8) if data is None else data
                starts, ends = B.word_bounds(data, B.SPACES)
                gone = B.cover(len(starts), first, first + windows + length - 1)
                if len(first):
                    raw = data.tobytes()
                    text = b" ".join(raw[s:e] for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist()))
                else:
                    text = b" ".join(data.tobytes().split())
                n_words.append(len(starts))
                n_removed.append(int(gone.sum()))
                texts.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "n_removed", name],
            )

    return mark_repeats(docs, length, k).select("doc_id", "text", "spans").mapInArrow(kept, f"doc_id bigint, n_words bigint, n_removed bigint, {name} string")
